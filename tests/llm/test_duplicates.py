"""Decontamination, suffix dedup and near-dedup against brute force."""

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievekit.llm import decontaminate, near_dedup, suffix_dedup
from tests.llm.fixtures import SCHEMA, rows, shingles, table, words

EXTRA = ("c",) * 11


def lively(n=160, seed=1):
    """Groups of near copies, shared passages and copies, and clean rows."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(900)]
    passage = " ".join(rng.choice(vocab, 60))
    seeds = [list(rng.choice(vocab, 90)) for _ in range(4)]
    out = []
    for i in range(n):
        kind = i % 4
        w = list(seeds[i % 3]) if kind < 2 else list(rng.choice(vocab, int(rng.integers(3, 120))))
        if kind < 2:
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
        if kind == 2:
            w = w[:25] + passage.split() + w[25:]
        out.append((i, " ".join(w).capitalize(), "en", "s", 1, *EXTRA))
    return out


def brute_components(data):
    low = lambda i: float("-inf") if i is None else i
    sets = [(r[0], shingles(words(r[1]))) for r in data]
    par = {low(i): low(i) for i, _ in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(low(i)), find(low(j))))
                par[y] = x
    back = lambda x: None if x == float("-inf") else x
    return Counter((i, len(s), back(find(low(i))), find(low(i)) == low(i)) for i, s in sets)


def test_members_of_the_main_label_meet_the_others_only(spark):
    """Pairs of hard lists: one label, a main label and a few, all different, tied."""
    rng = np.random.default_rng(4)
    data = [(v, 100 * v + i, 100 + int(rng.integers(0, 40)), int(label))
            for v, labels in enumerate([[1] * 30, [1] * 30 + [2], [1] * 20 + [2] * 3 + [3, 4], range(12), [1, 1, 2, 2], [5]]) for i, label in enumerate(labels)]
    lists = spark.createDataFrame(data, "v long, id long, n long, label long")
    fit = lambda x, y: 100 * min(x, y) >= 75 * max(x, y)
    want = {(x[1], y[1]) for x in data for y in data if x[0] == y[0] and x[1] < y[1] and x[3] != y[3] and fit(x[2], y[2])}
    mixed = near_dedup.mixed_lists(lists)
    assert sorted((r.v, r.size) for r in mixed.collect()) == [(1, 31), (2, 25), (3, 12), (4, 4)]
    got = [tuple(r) for r in near_dedup.cross_pairs(lists, mixed, F.lit(True)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("small", [64, 2])
@pytest.mark.parametrize("data", [rows(), lively(), lively(seed=7)])
def test_near_dedup(spark, data, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)  # 2: nearly all lists go through the full sets
    got = near_dedup.near_dedup(table(spark, data))
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute_components(data)


def test_near_dedup_stage_and_empty(spark):
    docs = table(spark, lively(60))
    out = near_dedup.keep_one(spark, docs, "")
    assert out.columns == docs.columns and out.count() == sum(1 for r in brute_components(lively(60)) if r[3])
    assert near_dedup.near_dedup(table(spark, [])).count() == 0


def brute_suffix(data, length):
    raws = [(r[0], (r[1] or "").encode()) for r in data]
    seen = Counter(x[p:p + length] for _, x in raws for p in range(len(x) - length + 1))
    out = Counter()
    for i, x in raws:
        hit = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p:p + length]] > 1:
                hit[p:p + length] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[(i, len(x), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~hit])).hexdigest())] += 1
    return out


@pytest.mark.parametrize("chunk,piece", [(2048, 1 << 20), (2, 1 << 20), (2048, 3000)])
@pytest.mark.parametrize("data", [rows(), lively()])
def test_suffix_dedup(spark, data, chunk, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)  # 2: nearly all hashes are hot
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)  # 3000: long texts in pieces
    got = suffix_dedup.suffix_dedup(table(spark, data))
    assert Counter(tuple(r) for r in got.collect()) == brute_suffix(data, 200)


def test_suffix_order_and_extensions():
    rng = np.random.default_rng(2)
    blocks = [bytes(rng.integers(97, 99, int(rng.integers(5, 60))).astype(np.uint8)) for _ in range(200)]
    anchor = np.array([min(3, len(b) - 1) for b in blocks])
    group = np.arange(200) % 3
    s = suffix_dedup.Suffixes(group, blocks, anchor)
    order = s.mergesort()
    want = sorted(range(200), key=lambda i: (group[i], blocks[i][anchor[i]:], i))
    assert order.tolist() == want
    common = s.verified_extensions(order, 40)
    for k in range(1, 200):
        i, j = order[k], order[k - 1]
        n = 0
        if group[i] == group[j]:
            for a, b in zip(blocks[i][anchor[i]:], blocks[j][anchor[j]:]):
                if a != b:
                    break
                n += 1
        assert common[k] == min(n, 40)


def test_suffix_empty(spark):
    assert suffix_dedup.suffix_dedup(table(spark, [])).count() == 0


def brute_leaks(docs, items):
    word = re.compile("[a-z0-9\x80-\U0010ffff]+")
    held = [(i, shingles(word.findall((t or "").lower()))) for i, t in items]
    out = Counter()
    for r in docs:
        own = shingles(word.findall((r[1] or "").lower()))
        for i, s in held:
            if s and 100 * len(s & own) >= 75 * len(s):
                out[(r[0], i, len(s), len(s & own))] += 1
        # items of one to four words in a row inside a longer text
        w = word.findall((r[1] or "").lower())
        for i, t in items:
            few = word.findall((t or "").lower())
            if 0 < len(few) < 5 and len(w) > len(few) and any(w[k:k + len(few)] == few for k in range(len(w))):
                if not shingles(few) <= shingles(w):
                    out[(r[0], i, 1, 1)] += 1
    return out


@pytest.mark.parametrize("block", [500_000, 20])
def test_decontaminate(spark, block):
    docs = rows() + lively(40)
    text = lively(40)[2][1].split()
    items = [(1, " ".join(text[25:60])), (2, " ".join(text[30:70]).upper() + "!"), (3, " ".join(text[40:60] + ["zz"] * 4)), (4, None), (5, ""), (6, "one, two; three"),
             (7, "a b c d e f g h " * 3), (8, "nothing like this stands in any document at all"), (2, " ".join(text[30:70]))]
    got = decontaminate.leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_shingles=block)
    assert Counter(tuple(r)[:4] for r in got.collect()) == brute_leaks(docs, items)


@pytest.mark.parametrize("block", [500_000, 5])
def test_short_items_inside_long_texts(spark, block):
    docs = rows() + lively(20)
    first = lively(20)[2][1].split()
    items = [(1, first[7]), (2, " ".join(first[30:33]).upper()), (3, "one, two; three"), (4, "one two three four"), (5, "e f g h"), (6, "THE"), (7, "the"), (7, "the"),
             (None, "the of"), (9, "!!!"), (10, "h a"), (11, "no such words"), (12, " ".join(first[20:60]))]
    table_of = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(table(spark, docs), table_of, block_shingles=block)
    want = brute_leaks(docs, items)
    assert Counter(tuple(r)[:4] for r in got.collect()) == want
    assert {i for _, i, _, _ in want} >= {1, 2, 3, 5, 6, 7, None, 10, 12}
    # the stage drops texts of just a short item's words, and whole leaks
    word = re.compile("[a-z0-9\x80-\U0010ffff]+")
    bare = {tuple(word.findall((t or "").lower())) for _, t in items} - {()}
    held = shingles(word.findall(items[-1][1].lower()))
    clean = [r for r in docs if tuple(w := word.findall((r[1] or "").lower())) not in bare and 100 * len(held & shingles(w)) < 75 * len(held)]
    out = decontaminate.without_leaks(table(spark, docs), table_of, block_shingles=block)
    assert Counter(map(tuple, out.collect())) == Counter(clean)


def test_copies_of_an_item_are_one_text_of_a_block(spark):
    items = spark.createDataFrame([(i, "a b c d e f g h") for i in range(300)] + [(300 + i, "") for i in range(50)] + [(400, "q r s t u v")], "item_id long, text string")
    blocks = [b.value for b in decontaminate.item_blocks(items, 75, 500)]
    assert [len(b["items"]) for b in blocks] == [2]
    docs = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "nothing of it")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(1, i) for i in range(300)]


def test_decontaminate_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(table(spark), none).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_item_blocks_are_bounded_by_words(spark):
    # words joined by marks without white space count one by one
    text = ",".join(f"w{i}" for i in range(40)) + " é中 🙂 K"
    got = spark.createDataFrame([(text,)], "text string").select(F.regexp_count("text", F.lit(decontaminate.WORD))).first()[0]
    assert got == 43
    block = decontaminate.Text(*decontaminate.lower_buffers(pa.array([text])))
    assert block.words[-1] == got


def words_by_character(text):
    """Letters, marks and digits one by one, without a pattern or table."""
    out, last = [], None
    for c in (text or "").lower():
        name = unicodedata.name(c, "")
        if unicodedata.category(c)[0] == "M":
            out.append(c) if last is None else out.__setitem__(-1, out[-1] + c)
            last = last or "run"
        elif c.isalnum():
            alone = name.startswith(("CJK ", "HIRAGANA", "KATAKANA", "THAI", "IDEOGRAPHIC"))
            out.append(c) if alone or last != "run" else out.__setitem__(-1, out[-1] + c)
            last = "alone" if alone else "run"
        else:
            last = None
    return out


def typographic():
    plain = "he said \"yes - we can't, not now\" and left the old house - at once; then all of it was quiet"
    curly = plain.replace(' "', " \u201c").replace('"', "\u201d").replace(" - ", "\u2014").replace("'", "\u2019").replace("the old", "the\u00a0old").replace("; ", "\u2009\u2026\u00ab")
    chinese = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u3002\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\uff0c\u770b\u82b1"
    kana = "\u304d\u3087\u3046\u306f\u3044\u3044\u5929\u6c17\u3067\u3059\u306d\u30b9\u30d1\u30fc\u30af"
    thai = "\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49\u0e2d\u0e32\u0e01\u0e32\u0e28\u0e14\u0e35\u0e21\u0e32\u0e01"
    hindi = "\u0906\u091c \u092e\u094c\u0938\u092e \u092c\u0939\u0941\u0924 \u0905\u091a\u094d\u091b\u093e \u0939\u0948 \u0914\u0930 \u0939\u092e \u0916\u0941\u0936 \u0939\u0948\u0902"
    docs = ["Before: " + curly + " \U0001f642 after", "before " + plain + " after", "x" + chinese.replace("\u3002", "\uff01") + "y z", kana + "abc " + kana[:5], "a " + thai + " b",
            "\u300c" + hindi.replace(" ", "\u3000") + "\u300d", "\u0301odd e\u0301t\u00e9 " + curly[:30], chinese[:4], None, ""]
    items = [(1, plain), (2, curly.upper()), (3, chinese), (4, kana), (5, thai), (6, hindi), (7, "\u3002\u2014\u201c\U0001f642")]
    return [(i, t, "en", "s", 1, *EXTRA) for i, t in enumerate(docs)], items


def test_decontaminate_by_unicode_words(spark):
    docs, items = typographic()
    want = Counter()
    for r in docs:
        own = shingles(words_by_character(r[1]))
        for i, t in items:
            s = shingles(words_by_character(t))
            if s and 100 * len(s & own) >= 75 * len(s):
                want[(r[0], i, len(s), len(s & own))] += 1
    assert {k[:2] for k in want} == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)}
    got = decontaminate.leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r)[:4] for r in got.collect()) == want


def test_words_are_counted_as_they_are_taken(spark):
    texts = [r[1] or "" for r in typographic()[0] + rows()]
    counts = [len(words_by_character(t)) for t in texts]
    block = decontaminate.Text(*decontaminate.lower_buffers(pa.array(texts)))
    assert np.diff(block.words).tolist() == counts
    at = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", F.regexp_count("text", F.lit(decontaminate.WORD)).alias("n"))
    assert [r.n for r in at.orderBy("i").collect()] == counts


def shared_ids():
    """Rows under null and repeated ids: near copies, copies and unlike texts."""
    t = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef"]
    near = lambda x: x + " tail"
    return [(i, x, "en", "s", 1, *EXTRA) for i, x in ((9, t[0]), (9, t[1]), (5, near(t[0])), (None, t[2]), (None, t[2]), (None, t[3]), (None, near(t[3])), (4, t[4]), (4, t[4]),
                                                      (3, near(t[2])), (None, None), (None, ""), (7, ""), (7, t[5]))], t, near


def test_near_dedup_stage_decides_by_row(spark):
    data, t, near = shared_ids()
    docs = table(spark, data)
    out = near_dedup.keep_one(spark, docs, "")
    got = Counter((r.doc_id, r.text) for r in out.collect())
    three = [x for x in got if x[0] is None and x[1] in (t[3], near(t[3]))]
    assert len(three) == 1 and got == Counter([(9, t[1]), (5, near(t[0])), (None, t[2]), three[0], (4, t[4]), (None, None), (None, ""), (7, ""), (7, t[5])])
    assert out.schema == docs.schema
    again = near_dedup.keep_one(spark, table(spark, data[::-1]), "")
    assert Counter((r.doc_id, r.text) for r in again.collect()) == got
    assert near_dedup.keep_one(spark, table(spark, []), "").count() == 0


@pytest.mark.parametrize("block", [500_000, 20])
def test_leaks_are_dropped_by_row(spark, block):
    data, t, _ = shared_ids()
    docs = table(spark, data)
    items = spark.createDataFrame([(1, " ".join(t[1].split()[5:30])), (2, " ".join(t[2].split()[9:40]).upper()), (3, "")], "item_id long, text string")
    out = decontaminate.without_leaks(docs, items, block_shingles=block)
    assert out.schema == docs.schema and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert Counter(map(tuple, out.collect())) == Counter(r for r in map(tuple, docs.collect()) if not (r[1] or "").startswith((t[1], t[2])))
    assert decontaminate.without_leaks(docs.limit(0), items).count() == 0

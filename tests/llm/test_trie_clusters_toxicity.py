"""Prefix trie, centroid clustering and toxicity against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sievekit.llm import centroid_clustering as C
from sievekit.llm import prefix_trie as P
from sievekit.llm import toxicity as T

TURNS = "conv_id long, turn long, role string, text string, box string, ids string, class string, n string"
VECTORS = "vec_id long, embedding array<double>, label int, block string, cluster string, x string"


def trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32], text or ""))
    convs = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def turn_rows():
    random.seed(5)
    rows = [(c, t, ("user", "assistant")[t % 2], random.choice("abcdé") * random.randint(1, 3)) for c in range(60) for t in range(random.randint(1, 7))]
    rows += [(c, t, "user", "the same") for c in range(100, 160) for t in range(4)]                       # a hot conversation
    rows += [(c, t, "user", f"step {t}") for c in range(200, 230) for t in range(c - 195)]               # each the start of the next
    rows += [(300, None, None, None), (300, 1, None, "x"), (300, 1, "user", None), (300, 1, None, "x"), (None, 0, "user", "lost"), (301, 0, "a", "b:c"), (302, 0, "a:b", "c")]
    rows += [(307, t, "user", "long " * 5000) for t in range(400)]
    return rows


@pytest.mark.parametrize("container", [1, 3, 5000])
def test_prefix_trie(spark, container):
    rows = turn_rows()
    random.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)
    got = sorted(tuple(-1 if v is None else v for v in r) for r in P.prefix_trie(df, container).collect())
    assert got == trie(rows)


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert P.prefix_trie(empty).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", *"xxxx")], TURNS)).count() == 0
    one = spark.createDataFrame([(5, 1, None, None, *"xxxx")], TURNS)
    assert sorted(tuple(r)[:3] for r in P.prefix_trie(one).select("depth", "n_convs", "n_leaves").collect())[0] == (0, 1, 1)


def lloyd(rows, k=8, n_rounds=10):
    kept = [(i, [int(np.floor(1024 * float(v))) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and np.isfinite(v) for v in e)]
    start = sorted(((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest()) if i is not None else (True, ""), x) for i, x in kept)[:k]
    cents, x = [list(s[1]) for s in start], np.array([v for _, v in kept], object)
    for r in range(n_rounds + 1):
        d = np.array([[sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents] for v in x], object)
        own = [min(range(len(cents)), key=lambda j: (row[j], j)) for row in d]
        if r < n_rounds:
            for j in range(len(cents)):
                mine = [v for v, o in zip(x, own) if o == j]
                if mine:
                    cents[j] = [int(sum(col)) // len(mine) for col in zip(*mine)]
    sums = defaultdict(int)
    for row, o in zip(d, own):
        sums[o] += int(row[o])
    return sorted((-1 if i is None else i, o, int(row[o]), sums[o], sum(sums.values()), hashlib.sha256(",".join(map(str, cents[o])).encode()).hexdigest())
                  for (i, _), row, o in zip(kept, d, own))


def vector_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    rows = [(i, (centres[i % 12] + rng.normal(size=64) * (0.02 + i % 3)).tolist()) for i in range(300)]
    rows += [(400 + i, [0.25] * 64) for i in range(150)] + [(700, [0.25] * 64)] * 3        # copies
    rows += [(600 + i, [float((i >> j % 4) & 1) for j in range(64)]) for i in range(16)]  # ties
    rows += [(None, [0.1] * 64), (None, [-0.1] * 64), (801, None), (802, []), (803, [0.1] * 63), (804, [0.1] * 65), (805, [None, *[0.1] * 63]),
             (806, [float("nan"), *[0.1] * 63]), (807, [float("-inf"), *[0.1] * 63]), (808, [-0.0, 1e-9, -1e-9, *[0.1] * 61])]
    return rows


@pytest.mark.parametrize("block", [7, 2048])
def test_clusters(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame([(i, e, 1, "x", "x", "x") for i, e in rows], VECTORS).repartition(3)
    seen = []
    got = C.centroid_clusters(df, block=block, seen=seen)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got.collect()) == lloyd(rows)
    popped = [s.agg({"n_popped": "sum"}).first()[0] for s in seen]
    assert popped[0] == len(lloyd(rows)) and sum(popped[1:]) < 10 * popped[0]


def test_few_vectors(spark):
    assert C.centroid_clusters(spark.createDataFrame([], VECTORS)).count() == 0
    for n in (1, 3):
        rows = [(i, [0.5 * i] * 64) for i in range(n)]
        got = C.centroid_clusters(spark.createDataFrame([(i, e, 1, "x", "x", "x") for i, e in rows], VECTORS))
        assert sorted(map(tuple, got.collect())) == lloyd(rows)
    huge = spark.createDataFrame([(1, [1e30] * 64, 1, "x", "x", "x")], VECTORS)
    with pytest.raises(Exception, match="beyond 2"):
        C.centroid_clusters(huge)


def test_separated_vectors_are_not_measured_again(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(64)[i % 8] * 50 + rng.normal(size=64) * 0.01).tolist(), 1, "x", "x", "x") for i in range(800)]
    seen = []
    C.centroid_clusters(spark.createDataFrame(rows, VECTORS), n_rounds=6, seen=seen)
    assert seen[-1].agg({"n_popped": "sum"}).first()[0] < 200


def test_folding():
    for text, want in {"You 1d10t!!": "you idiot", "m0r0n5, tr@sh": "morons trash", "the!! a$$$ 2024": "the a", "іdiоt ｉｄｉｏｔ id\xadiot": "idiot idiot idiot",
                       "so i d i o t s": "so idiots", "": "", None: "", "loser |oser 1oser": "ioser ioser ioser", "été ÉTÉ": "été été", "\u200bidi\u200bot": "idiot"}.items():
        assert T.fold(text).strip() == want


def test_matches_against_plain_search():
    weights, phrases = {"idiot": 3.0, "idi": 1.0, "trash": 2.0, "scum": 1.5}, ["trash can", "an idiot"]

    def plain(text):
        words, hits = T.fold(text).split(), []
        for k, w in enumerate(words):
            best = max((v for e, v in weights.items() if w.startswith(e)), default=0)
            pairs = [" ".join(words[k - 1:k + 1]) if k else "", " ".join(words[k:k + 2])]
            if best and not any(p in phrases for p in pairs):
                hits.append(best)
        return hits

    random.seed(1)
    pool = ["trash", "can", "an", "idiot", "idiots", "idiom", "the", "scum", "trashcan", "tr4sh", "SCUM!"]
    m = T.Matcher(weights, phrases)
    for _ in range(500):
        text = " ".join(random.choice(pool) for _ in range(random.randint(0, 12)))
        assert [w for _, w in m.hits(T.fold(text))] == plain(text), text


DOCS = "doc_id long, text string, word string, score string, toxic string, density string"


def test_learned_lexicon_and_exceptions(spark):
    random.seed(8)
    base = [f"word{random.choice('abcdefgh')}{random.choice('xyz')}" for _ in range(40)]
    docs, labels = [], []
    for i in range(900):
        words = random.choices(base, k=random.randint(20, 60))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(random.randrange(len(words)), random.choice(["grumblix", "gr0mblix".replace("0", "u"), "snarfoo", "vexxoria", "vexxorie"]))
        elif i % 30 == 1:
            at = random.randrange(len(words))
            words[at:at] = ["grumblix", "pie"]
        docs.append((i, " ".join(words), "c", "c", "c", "c"))
        labels.append((i, int(toxic)))
    docs += [(1000, None, *"cccc"), (1001, "", *"cccc"), (1002, "A gru_mblix VEXX0RI4 5narfoo", *"cccc"), (None, "snarfoo vexxoria", *"cccc"), (1003, "grumblix pie " * 20000, *"cccc"), docs[4], docs[4]]
    labels += [(1001, None), (None, 1), (5000, 1), (4, 1)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(d, lab)
    assert {"grumbiix", "snarfoo"} <= set(model["weights"]) and any(w.startswith("vexxor") for w in model["weights"])
    assert "grumbiix pie" in model["phrases"]
    got = defaultdict(list)
    for r in T.toxicity(d, model).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        got[r.doc_id].append(r.predicted)
    wrong = [i for i, t in labels[:900] if zlib.crc32(str(i).encode()) % 3 == 1 and got[i][0] != t]
    assert len(wrong) <= 3
    assert len(got[4]) == 3 and got[1000] == [0] and got[1001] == [0] and got[1002] == [1] and got[None] == [1] and got[1003] == [0]


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b", *"cccc"), (2, None, *"cccc")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.toxicity(d, T.train(d, none)).collect()] == [0.5, 0.5]
    assert T.toxicity(spark.createDataFrame([], DOCS), T.train(d, none)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in T.op13_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in rows)
    assert right / len(rows) > 0.98

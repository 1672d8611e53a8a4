"""Mixing, token files, quality classifier, language ID and the pipeline."""

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sievekit.llm import decontaminate, language_id, mixing, near_dedup, quality_pairs, quality_rules, token_output
from tests.conftest import SF_SMALL
from tests.llm.fixtures import rows, shingles, table, words


def highest_quotients(votes, seats):
    seat = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        seat[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * seat[i] + 1), i))
    return seat


def test_sainte_lague_is_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(300):
        votes = [int(v) for v in rng.integers(0, 2000, rng.integers(1, 9))]
        seats = int(rng.integers(0, 60))
        assert mixing.sainte_lague(votes, seats).tolist() == highest_quotients(votes, seats), (votes, seats)
    assert mixing.sainte_lague([], 5).tolist() == [] and mixing.sainte_lague([0, 0], 5).tolist() == [0, 0]
    assert mixing.sainte_lague([1, 1, 1], 2).tolist() == [1, 1, 0]


@pytest.mark.parametrize("shard_words", [1 << 22, 500])
def test_mix(spark, shard_words):
    data = rows() + [(100 + i, "w " * (5 * i), "en", f"s{i % 3}", 1) + ("c",) * 11 for i in range(120)]
    got = mixing.mix_sources(table(spark, data), shard_words=shard_words).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((x[0], len(words(x[1]))) for x in data)
    total, by = sum(r.size for r in got), defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.full * r.size + r.rest
        by[r.source].append(r)
    for own in by.values():
        assert len({(r.target, r.source_size) for r in own}) == 1 and own[0].source_size == sum(r.size for r in own)
        assert own[0].target <= 3 * own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * mixing.BLOCK
    assert abs(sum(own[0].target for own in by.values()) - total) < 1e-6 * total + 1e-6
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(table(spark, data[::-1]), shard_words=shard_words).collect()))


def test_mix_applied(spark):
    docs = table(spark)
    mix = {(r.doc_id, r.size): r.taken for r in mixing.mix_sources(docs).collect()}
    out = mixing.apply_mix(spark, docs, "")
    assert out.columns == docs.columns
    per_row = Counter((x[0], len(words(x[1]))) for x in rows())
    taken, texts = Counter(), {(x[0], (x[1] or "")) for x in rows()}
    for r in out.collect():
        whole = [t for i, t in texts if i == r.doc_id and t.startswith(r.text)]
        assert whole and r.size == "c"
        taken[(r.doc_id, len(words(whole[0])))] += len(words(r.text))
    for k, n in taken.items():
        assert n == mix[k] * per_row[k], k
    assert mixing.mix_sources(table(spark, [])).count() == 0


def encoder():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(token_output.tokenizer_path())


def test_mix_applied_to_repeated_rows(spark):
    # one doc_id and text under two sources, and rows equal in all three
    data = [(1, "a b c d", "en", src, 7) + ("c",) * 11 for src in ("s1", "s2", None, None)]
    data += [(10 + i, "w x y z " * 30, "en", "s2", 7) + ("c",) * 11 for i in range(4)]
    docs = table(spark, data)
    mix = mixing.mix_sources(docs).collect()
    most = {}
    for r in mix:
        key = (r.doc_id, r.source)
        most[key] = max(most.get(key, (0, 0)), (r.full, r.rest))
    want = Counter()
    for x in data:
        full, rest = most[x[0], x[3]]
        want[x[0], x[3]] += full + (rest > 0)
    got = Counter((r.doc_id, r.source) for r in mixing.apply_mix(spark, docs, "").collect())
    assert got == +want


def test_token_files_round_trip(spark):
    data = rows()
    got = token_output.token_output(table(spark)).orderBy("start").collect()
    tok, start = encoder(), 0
    want = sorted(((x[0] if x[0] is not None else -1, x[1] or "") for x in data))
    for r, (i, text) in zip(got, want, strict=True):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert ((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_output.token_output(table(spark, [])).count() == 0


def test_chunks_encode_as_whole_texts():
    import random
    import pyarrow as pa
    from sievekit.llm.arrays import buffers
    random.seed(3)
    parts = [*" \n\t\r\x0b\x0c\x1c\x00\x7f\x85\xa0 　᠎aBst1'.,_-é中²", "  ", "ll", "'s", "$$$", "<|endoftext|>", "🙂"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(4000)] + [None, ""]
    coder = token_output.ChunkEncoder(token_output.tokenizer_path())
    assert coder.joins
    ids, bounds = coder.encode(*buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == coder.tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_chunks_with_one_key_are_told_apart(monkeypatch):
    import pyarrow as pa
    from sievekit.llm.arrays import buffers
    real, calls = token_output.span_hash, []

    def coarse(pre, start, end):
        calls.append(1)
        return real(pre, start, end) & np.uint64(3 if len(calls) % 2 else (1 << 64) - 1)

    monkeypatch.setattr(token_output, "span_hash", coarse)
    coder = token_output.ChunkEncoder(token_output.tokenizer_path())
    for texts in (["one two"], ["three four five", None, "one"], ["two", "six seven, eight nine ten!"]):
        ids, bounds = coder.encode(*buffers(pa.array(texts)))
        for k, t in enumerate(texts):
            assert ids[bounds[k]:bounds[k + 1]].tolist() == coder.tok.encode(t or "", add_special_tokens=False).ids


def test_damaged_records_are_found():
    rec = token_output.frame(b"\x01\x00\x02\x00")
    assert token_output.unframe(rec) == b"\x01\x00\x02\x00"
    for k in range(len(rec)):
        bad = rec[:k] + bytes([rec[k] ^ 1]) + rec[k + 1:]
        with pytest.raises(ValueError):
            token_output.unframe(bad)


def test_quality_held_out(spark):
    got = quality_pairs.op3_quality_pairs(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (x.predicted == x.quality).mean() > 0.95 and ((x.score >= 0.3) == (x.predicted == 1)).all()
    good, bad = x.score[x.quality == 1].to_numpy(), x.score[x.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_quality_hard_rows(spark):
    from pyspark.sql import functions as F
    docs = table(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    a, b = ({(r.doc_id, round(r.score, 9)) for r in quality_pairs.score_documents(docs, quality_pairs.train(d, labels)).collect()} for d in (docs, docs.orderBy(F.desc("doc_id"))))
    assert a == b and len(a) >= 20
    model = quality_pairs.train(docs, labels.where("label = 1"))
    assert {r.score for r in quality_pairs.score_documents(docs, model).collect()} == {0.5}
    assert quality_pairs.score_documents(table(spark, []), model).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = language_id.op7_language_id(spark, sf)
    x = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(x) > 200 and (x["lang"] == x.lang_pred).mean() > 0.98
    assert got.where("score < 0 OR score > 1 OR lang_pred IS NULL").count() == 0


def test_language_hard_rows(spark):
    docs = table(spark)
    model = language_id.train(docs)
    assert model[0] == ["en", "fr"]
    got = language_id.predict(docs, *model).collect()
    assert len(got) == docs.count()
    letters = {x[0]: any(c.isalpha() for c in x[1] or "") for x in rows() if x[0] not in (2, None)}
    assert all((r.lang_pred != "und") == letters[r.doc_id] for r in got if r.doc_id in letters)
    none = language_id.train(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.predict(docs, *none).collect()} == {"und"}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    data = [r.asDict() for r in docs.collect()]
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    left = [r for r in data if r["doc_id"] in kept]
    root = {}
    for k, r in enumerate(left):
        root[r["doc_id"]] = r["doc_id"]
    sets = {r["doc_id"]: shingles(words(r["text"])) for r in left}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = [r["doc_id"] for r in left]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = [r for r in left if find(r["doc_id"]) == r["doc_id"]]
    from tests.llm.test_duplicates import brute_leaks
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    leaked = {k[0] for k in brute_leaks([(r["doc_id"], r["text"]) for r in left], items)}
    left = [r for r in left if r["doc_id"] not in leaked]
    want = mixing.apply_mix(spark, spark.createDataFrame(left, docs.schema), "")
    tok, start, rec = encoder(), 0, []
    for r in sorted(((x.doc_id, x.text) for x in want.collect())):
        e = np.array(tok.encode(r[1], add_special_tokens=False).ids + [0], "<u4")
        rec.append((r[0], start, len(e), zlib.crc32(e.tobytes())))
        start += len(e)
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == rec
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mixing", "token_output"]
    assert near_dedup.PERCENT == decontaminate.PERCENT == 75

"""Cases that earlier versions got wrong: null and shared ids, clashing columns,
many short texts of a large script, long chains of links."""

import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from sievekit.llm import language_id, license_scan, mixing, near_dedup, quality_pairs
from tests.llm.fixtures import table


def test_license_lines_belong_to_their_row(spark, scratch):
    lic = "a line\nReleased under the MIT License.\nend"
    data = [(None, lic), (None, "a line\nend"), (7, "nothing here"), (7, lic), (7, None), (8, "Released under the MIT License."), (9, ""), (7, lic)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{scratch}/documents.parquet")
    got = license_scan.op1_license_scan(spark, scratch).collect()
    assert Counter((r.doc_id, r.license, r.line_licenses) for r in got) == Counter([
        (None, None, "MIT"), (None, None, None), (7, None, None), (7, None, "MIT"), (7, None, "MIT"), (7, None, None), (8, "MIT", "MIT"), (9, None, None)])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{scratch}/documents.parquet/*.parquet'")
    want = con.sql(license_scan.oracle_sql()).df().astype(object).where(lambda x: x.notna(), None)
    cols = ["doc_id", "digest", "license", "line_licenses"]
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter(map(tuple, want[cols].to_numpy().tolist()))


def test_near_dedup_keeps_columns_named_like_its_own(spark):
    rows = [(1, "one two three four five six", 11, "a"), (2, "one two three four five six", 12, "b"), (3, "other words in this text here", 13, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, _doc string")
    out = near_dedup.keep_one(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_a_long_path_is_one_component(spark, monkeypatch):
    stages = []
    real = near_dedup.checkpoint_stage
    monkeypatch.setattr(near_dedup, "checkpoint_stage", lambda df, name, *a, **k: (stages.append(name), real(df, name, *a, **k))[1])
    edges = spark.range(4096).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.sql("SELECT 10000 + id AS a, 20000 AS b FROM range(50)"))
    got = {r.id: r.root for r in near_dedup.components(edges).collect()}
    assert len(got) == 4097 + 51 and {got[i] for i in range(4097)} == {0} and {got[i] for i in got if i >= 10000} == {10000}
    assert stages.count("cc_hooks") <= 30


def test_short_texts_of_a_large_script_in_bounded_memory():
    rng = np.random.default_rng(0)
    texts = pa.array(["".join(chr(c) for c in rng.integers(0x4E00, 0x9F00, 8)) for _ in range(10_000)])
    memory = language_id.Memory()
    tracemalloc.start()
    n = 0
    for a, b, codes, dense, has in memory.counts(texts):
        n += b - a
        assert dense.size <= max(language_id.CELLS, dense.shape[1]) and (dense.sum(axis=1) == 6).all() and has.all()
        memory.bundled(dense, codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and peak < 600e6


def test_profiles_against_a_plain_one(spark):
    """Prototypes and predictions against letters and trigrams one by one."""
    texts = [("aab abb ccc", "x"), ("abc ABC", "x"), ("zzy yyz", "y"), ("zy zyz 123", "y"), ("été ÉTÉ", "z"), (None, "z"), ("...", "y")]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    langs, proto = language_id.train(docs)

    def profile(text):
        letters, total = language_id.Memory(), np.zeros(language_id.DIM)
        cp = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
        cp = [c for k, c in enumerate(cp) if c or k == 0 or cp[k - 1]]
        for k in range(len(cp) - 2):
            if any(cp[k:k + 3]):
                v = np.ones(language_id.DIM)
                for j in range(3):
                    v = v * np.roll(letters.letter(cp[k + j]), j)
                total += v
        return total

    want = {lang: sum(profile(t) for t, x in texts if x == lang) for _, lang in texts}
    assert langs == sorted(want) and all((proto[i] == want[lang]).all() for i, lang in enumerate(langs))
    for r in language_id.predict(docs, langs, proto).collect():
        v = profile(texts[r.doc_id][0])
        cos = {lang: v @ w / ((np.linalg.norm(v) or 1) * (np.linalg.norm(w) or 1)) for lang, w in want.items()}
        best = max(cos, key=cos.get)
        letters = any(c.isalpha() for c in texts[r.doc_id][0] or "")
        assert r.lang_pred == (best if letters else "und") and abs(r.score - (max(cos[best], 0) if letters else 0)) < 1e-5


def test_a_source_without_words_is_in_no_shard(spark):
    data = [(i, t, "en", src, 1) + ("c",) * 11 for i, (t, src) in enumerate([(None, "a"), ("", "a"), ("  ", "a"), ("one two three", "b"), ("", "b"), (None, None)])]
    got = mixing.mix_sources(table(spark, data)).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 3, 3), (4, 0, 3), (5, 0, 0)])
    assert all((r.taken, r.full, r.rest) == (0, 0, 0) for r in got if not r.size)


def test_labels_of_a_shared_id_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"some words of text number {i} " * (i + 1)) for i in range(200)] + [(2, "x x x !!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(quality_pairs, "fit", lambda x, label: seen.append(x))
    for part in (docs.repartition(5), docs.repartition(2)):
        quality_pairs.train(part, labels, max_labelled=20)
    quality_pairs.train(docs, labels, max_labelled=500)
    assert [len(x) for x in seen] == [20, 20, 201] and (seen[0] == seen[1]).all()

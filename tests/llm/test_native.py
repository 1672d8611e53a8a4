"""Licence scan, line dedup and quality rules on hard cases, against Python."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sievekit.llm import license_scan, line_dedup, quality_rules
from tests.conftest import SF_SMALL
from tests.llm.fixtures import LOWER, rows, table, words

STRIP = " \t\n\x0b\x0c\r"


def test_licenses(spark):
    mit = license_scan.KNOWN["MIT-text"]
    texts = [(1, mit), (2, mit.upper().replace("Copyright (c) <year> <copyright holders>".upper(), "Copyright 2019, 2021 Jane Doe\nAll rights reserved.")),
             (3, "RELEASED under the MIT Licence"), (4, "released under the MIT license and more"), (5, None), (6, ""), (7, "intro\n* Licensed under CC BY-NC 4.0. *\nend"), (None, mit)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan.license_scan(docs).collect()}
    assert got == {1: "MIT-text", 2: "MIT-text", 3: "MIT", 4: None, 5: None, 6: None, 7: None, None: "MIT-text"}
    lines = license_scan.license_scan(docs, unit="line").where("license = 'CC-BY-NC-4.0'").collect()
    assert [(r.doc_id, r.line_no) for r in lines] == [(7, 1)]


def test_line_dedup(spark):
    data = rows()
    key = lambda x: x.strip(STRIP).translate(LOWER)
    low = lambda i: float("-inf") if i is None else i
    held = defaultdict(set)
    for r in data:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(low(r[0]))
    want = Counter()
    for r in data:
        ls = (r[1] or "").split("\n")
        keep = [x for x in ls if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == low(r[0])]
        want[(r[0], len(ls), len(ls) - len(keep), "\n".join(keep))] += 1
    out = line_dedup.line_dedup(table(spark))
    assert set(out.columns) == {*table(spark).columns, "n_lines", "n_dropped"}
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == want
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_line_dedup_threshold(spark):
    docs = spark.createDataFrame([(i, "a line of three\nown %d line here" % i) for i in range(3)], "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.line_dedup(docs, min_docs=4).collect()] == [0, 0, 0]
    assert sorted(r.n_dropped for r in line_dedup.line_dedup(docs, min_docs=3).collect()) == [0, 1, 1]


def brute_measures(text):
    w = words(text, lower=False)
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    at = {q for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] >= 2 for q in (i, i + 1, i + 2)}
    ls = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)


def test_quality_rules(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(table(spark)).collect())
    assert got == Counter((r[0], *brute_measures(r[1])) for r in rows())
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_kept_rows_keep_their_columns(spark):
    clean = (99, "of the " + " ".join(f"w{i}" for i in range(80)), "en", "s1", 1) + ("c",) * 11
    docs = table(spark, rows() + [clean])
    out = quality_rules.keep_good(spark, docs, "")
    assert out.columns == docs.columns
    assert 0 < out.count() < docs.count() and {r.kept for r in out.collect()} == {"c"}


def test_digest_is_of_kept_text(spark):
    docs = spark.createDataFrame([(1, "é\nb")], "doc_id long, text string")
    from pyspark.sql import functions as F
    r = line_dedup.line_dedup(docs).select(F.sha2(F.col("text").cast("binary"), 256).alias("s")).first()
    assert r.s == hashlib.sha256("é\nb".encode()).hexdigest()


def test_quality_stage_keeps_what_the_rules_keep(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("n_words", F.lit("clash"))
    odd = docs.limit(3).withColumn("text", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.lit(None)))
    docs = docs.unionByName(odd)
    want = quality_rules.quality_rules(docs.drop("n_words")).where("kept").select("doc_id")
    got = quality_rules.keep_good(spark, docs, SF_SMALL)
    assert got.columns == docs.columns and want.count() > 0
    assert got.select("doc_id").exceptAll(want).count() == want.exceptAll(got.select("doc_id")).count() == 0
    assert quality_rules.keep_good(spark, docs.limit(0), SF_SMALL).count() == 0


def reflowed(text):
    """In upper case, a line for each paragraph but those of copyright lines."""
    return "\n\n".join(part if "COPYRIGHT (C)" in part else " ".join(part.split()) for part in text.upper().split("\n\n"))


def license_cases():
    """(text, licence) of texts that stand under other titles, owners and line breaks."""
    common = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    out = []
    for file, name in common.items():
        text = open(f"/usr/share/common-licenses/{file}", encoding="utf-8").read()
        out += [(text, f"{name}-text"), (reflowed(text), f"{name}-text"), (text[:-200], None)]
    gpl = open("/usr/share/common-licenses/GPL-3", encoding="utf-8").read()
    out += [(gpl.replace("https:", "http:"), "GPL-3.0-text"), (gpl[:gpl.index("END OF TERMS")], "GPL-3.0-terms")]
    mit = license_scan.KNOWN["MIT-text"].split("\n\n", 2)[2]
    for top in ("MIT License\n\nCopyright (c) Microsoft Corporation.", "The MIT License (MIT)\n\nCopyright The Kit Authors", "The MIT License\nCopyright © Jane Doe", "MIT License\n\nCopyright Jane Doe\nCopyright ACME Ltd. All rights reserved.",
                "MIT License\n\n  Copyright Jane Doe\n\n  Copyright ACME Ltd.\n"):
        out += [(f"{top}\n\n{mit}", "MIT-text"), (f"{top}\n\n{reflowed(mit)}\n", "MIT-text")]
    out += [(f"Copyright Jane Doe\n\n{mit}", "MIT-bare"), (mit, "MIT-bare"), (f"MIT License\n\nCopyright Jane Doe\n\nNot {mit}", None)]
    bsd = open("/usr/share/common-licenses/BSD", encoding="utf-8").read()
    out += [(bsd, "BSD-3-Clause-UC-bare")]
    holders = bsd.split("reserved.", 1)[1].replace("the University", "the copyright holder").replace("REGENTS AND", "COPYRIGHT HOLDERS AND").replace("REGENTS OR", "COPYRIGHT HOLDER OR").replace("THE REGENTS", "THE COPYRIGHT HOLDERS")
    out += [(f"The 3-Clause BSD License\n\nCopyright (c) 2020, X\n{holders}", "BSD-3-Clause-text"), ("Copyright 2020 X\n" + holders.replace("\n1. ", "\n- ").replace("\n2. ", "\n- ").replace("\n3. ", "\n- "), "BSD-3-Clause-bare-bullets")]
    out += [("SPDX-License-Identifier: MPL-2.0", "MPL-2.0-spdx"), ("This project is licensed under the Mozilla Public License 2.0.", "MPL-2.0-project-3"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
            ("Copyright law is a branch of law, and this long paragraph about it begins with the word without being the notice of any owner.", None), (None, None), ("copyright Jane Doe", None)]
    return out


def test_known_licenses(spark):
    import duckdb
    cases = license_cases()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert [(i, got[i].license) for i in range(len(cases))] == [(i, name) for i, (_, name) in enumerate(cases)]
    empty = hashlib.sha256(b"").hexdigest()
    assert got[len(cases) - 3].digest != empty and got[len(cases) - 1].digest == empty
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(cases)])
    assert {r[0]: r[1:3] for r in con.execute(license_scan.oracle_sql()).fetchall()} == {i: (r.digest, r.license) for i, r in got.items()}

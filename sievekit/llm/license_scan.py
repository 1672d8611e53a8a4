"""License scans: canonical digest lookup. Whole texts are normalised (case,
punctuation, copyright lines, equivalent spellings), digested, and hash-joined
to the digests of known licences. Built-in functions only.

The known texts are canonicalised by the same Spark projection as the
documents, so both sides agree by construction. A licence statement is often
one line of a longer document, so the scan can also be run on lines
(``unit="line"``): each line is then an entire text of its own.

Cases: a null text counts as empty; an empty canonical text matches nothing;
several licences with the same canonical text give the first name by code
point; each row is judged by its own text, so null and shared ids mix nothing
up; repeated rows give repeated results; very long texts and lines are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .line_dedup import split_lines

# Public licence texts and the usual one-line notices, with those
# of license_texts.
KNOWN = license_texts.texts() | {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}

KNOWN |= {f"{name}-bare": KNOWN[f"{name}-text"].split("\n", 1)[1] for name in ("MIT", "ISC")}

# Spellings taken as equal, applied in this order to whole words.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
             ("merchantibility", "merchantability"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
             ("whilst", "while"), ("favour", "favor"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
             ("https", "http"), ("the mit license mit", "mit license"), ("mit license mit", "mit license"), ("the mit license", "mit license"), ("the isc license", "isc license"),
             ("isc license isc", "isc license"), ("3 clause bsd license", "bsd 3 clause license"), ("2 clause bsd license", "bsd 2 clause license"),
             ("the bsd 3 clause license", "bsd 3 clause license"), ("the bsd 2 clause license", "bsd 2 clause license"))
# Copyright lines: with a year; with the sign; "the ... authors" and the like; and
# short paragraphs of lines that begin with the word (a wrapped licence text
# has such lines, but not as paragraphs).
_BLANK = r"[ \t\r*#/;>-]*"
_LINE = r"[^\w\n]*(?:copyright[ \t]|all rights reserved)[^\n]{0,100}"
COPYRIGHT_LINE = "|".join((
    r"(?m)^[^\w\n]*(?:copyright\b|\(c\)|©)[^\n]*\b(?:\d{4}|year|yyyy)\b[^\n]*$",
    r"^[^\w\n]*all rights reserved[^\w\n]*$",
    r"^[^\w\n]*copyright[ \t]*(?:\(c\)|©)[^\n]*$",
    r"^[^\w\n]*(?:\(c\)|©)[ \t]*copyright\b[^\n]*$",
    r"^[^\w\n]*copyright[ \t]+(?:by[ \t]+)?the\b[^\n]*\b(?:authors?|contributors?|developers?|team|project|foundation|maintainers?)\b[^\w\n]*(?:all rights reserved)?[^\w\n]*$",
    rf"(?:\A|\n{_BLANK}\n)(?:{_LINE}\n(?:{_BLANK}\n)?){{0,4}}{_LINE}(?:\n{_BLANK}\n|\n{_BLANK}\z|\z)"))


def canonical(text: Column) -> Column:
    """Lower case; copyright lines out; each run of other characters than
    letters and digits is one space; equivalent spellings unified."""
    out = F.lower(F.coalesce(text, F.lit("")))
    # the pattern is slow, and matches only where one of these stands
    some = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("©")) | F.contains(out, F.lit("all rights reserved"))
    out = F.when(some, F.regexp_replace(out, COPYRIGHT_LINE, " ")).otherwise(out)
    out = F.concat(F.lit(" "), F.btrim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.btrim(out)


def digests(spark, known: dict[str, str] = KNOWN) -> DataFrame:
    """(_digest, license) of the known texts, one row per canonical text."""
    rows = spark.createDataFrame(sorted(known.items()), "license string, text string")
    return (rows.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("_digest"), "license")
            .groupBy("_digest").agg(F.min("license").alias("license")))


def license_scan(docs: DataFrame, known: dict[str, str] = KNOWN, unit: str = "text") -> DataFrame:
    """(doc_id, [line_no], digest, license): the canonical digest of each
    whole text (or line) and the licence that it is, or null.

    The digest table has one row per known licence: its size is fixed by the
    caller's dictionary, so it is broadcast. Only the scan reads the corpus;
    no row of it is shuffled."""
    if unit == "line":
        src = docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "_t"))
        src = src.where(F.length("_t") > 0)
    else:
        src = docs.select("doc_id", F.col("text").alias("_t"))
    keys = [c for c in src.columns if c != "_t"]
    canon = src.select(*keys, canonical(F.col("_t")).alias("_c"))
    table = digests(docs.sparkSession, known)
    digest = canon.select(*keys, F.sha2(F.col("_c").cast("binary"), 256).alias("_digest"), (F.length("_c") > 0).alias("_any"))
    return (digest.join(F.broadcast(table), "_digest", "left")
            .select(*keys, F.col("_digest").alias("digest"), F.when(F.col("_any"), F.col("license")).alias("license")))


def text_key(text: Column) -> list[Column]:
    """128 bits of the text: rows with one text share their lines' licences."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("_t1"), F.xxhash64(F.lit("second"), t).alias("_t2")]


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """The digest and licence of each whole text, and the licences that are
    whole lines of it (scanned through the same operator). Lines are brought
    back by their text's key and not by doc_id; texts with a licence line alone
    are on that side, once each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed = lambda: docs.select(F.struct("doc_id", *text_key(F.col("text"))).alias("doc_id"), "text")
    own = ["doc_id._t1", "doc_id._t2"]
    whole = license_scan(keyed()).select("doc_id.doc_id", *own, "digest", "license")
    lines = (license_scan(keyed(), unit="line").where("license IS NOT NULL").select(*own, "license")
             .groupBy("_t1", "_t2").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses")))
    return whole.join(lines, ["_t1", "_t2"], "left").select("doc_id", "digest", "license", "line_licenses")


def _sql_canonical(x: str) -> str:
    # RE2 has no word boundary by Unicode; \b there is ASCII as in Java's default
    out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g')"
    out = rf"' ' || trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


def oracle_sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN.items()))
    return f"""
WITH k AS (SELECT sha256({_sql_canonical('t')}) AS digest, min(license) AS license FROM (VALUES {values}) AS x(license, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, t, {_sql_canonical('t')} AS c FROM d),
l AS (SELECT DISTINCT t, line FROM (SELECT t, unnest(string_split(t, chr(10))) AS line FROM (SELECT DISTINCT t FROM d))),
ll AS (SELECT t, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
       FROM (SELECT t, {_sql_canonical('line')} AS c FROM l) JOIN k ON sha256(c) = digest WHERE c <> '' GROUP BY t)
SELECT doc_id, sha256(c) AS digest, CASE WHEN c <> '' THEN license END AS license, line_licenses
FROM c LEFT JOIN k ON sha256(c) = k.digest LEFT JOIN ll ON ll.t = c.t
"""

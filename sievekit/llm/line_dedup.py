"""Line dedup: explode normalised lines, hash, count documents per hash, drop
lines over the threshold, reassemble by position. DataFrame functions only.

Cases: a null or empty text is one empty line; a key shorter than
``min_chars`` code points never loses lines; of the documents that hold a
repeated key the smallest id keeps all its lines; rows that repeat a doc_id
count as one document (each row is reassembled); a null doc_id counts as one
document before all others. Other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import checkpoint_stage

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(_id, _row, _drop): 0-based positions of the lines that each row loses.

    Only 16 bytes of hash per line are shuffled. The count per key is a
    partial aggregate, so a key in every document costs a row per task; the
    join back keeps the key's partitioning and is split by AQE when one key
    is hot."""
    row = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    lines = (row.select("_id", F.xxhash64("_text").alias("_row"),
                        F.posexplode(split_lines(F.col("_text"))).alias("_pos", "_line"))
             .select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
             .where(F.length("_key") >= min_chars)
             # two 64-bit hashes with different seeds: no merge of different keys
             .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"),
                     F.xxhash64(F.lit("second"), F.col("_key")).alias("_h2")))
    lines = checkpoint_stage(lines, "line_keys")
    if min_docs == 2:
        seen = lines.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
        shared = seen.where("_first != _last").select("_h1", "_h2", "_first")
    else:
        seen = lines.groupBy("_h1", "_h2", "_id").agg(F.count(F.lit(1)))
        shared = (seen.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                  .where(F.col("_n") >= min_docs).select("_h1", "_h2", "_first"))
    return (lines.join(shared, ["_h1", "_h2"]).where("_id != _first")
            .groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drop")))


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with its text without repeated lines, plus n_lines and n_dropped."""
    lost = dropped_lines(docs, min_chars, min_docs)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct("*").alias("_doc"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_row"), text.alias("_text"))
    joined = keyed.join(lost, ["_id", "_row"], "left").withColumn("_lines", split_lines(F.col("_text")))
    # array_except works on a hash set: linear in the lines of a document
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop"),
        lambda p: F.get(F.col("_lines"), p)), "\n"))
    own = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return joined.select(*own, kept.alias("text"), F.size("_lines").cast("long").alias("n_lines"),
                         F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND s.first <> k.doc_id AS dropped FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, coalesce(sum(dropped::BIGINT), 0)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

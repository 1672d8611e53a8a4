"""Driver-table scans and the stand-in message views (FIXTURES.md C).

``msg_email`` / ``msg_sms`` / ``msg`` map the driver's tables onto the
canonical message frame; everything downstream only sees that frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DRIVER

# An sms id is bit 62, then 38 bits of conv_id, then 24 bits of turn: apart from
# every doc_id below 2^62 and from every other (conv_id, turn) in range.
SMS_ID_BASE = 1 << 62
TURNS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with the declared schema (pruning/pushdown by Catalyst)."""
    reader = spark.read
    if name in DRIVER:
        reader = reader.schema(DRIVER[name])
    return balance(reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def scan_splits(spark: SparkSession, sf_dir: str, names) -> int:
    """Input splits of the raw scans of ``names`` (sizes the message stages)."""
    return sum(spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet").rdd.getNumPartitions()
               for n in names)


def balance(df: DataFrame) -> DataFrame:
    """Spread an under-split input over the cluster's cores.

    A file written as one row group is one scan task, so every per-row step
    after it (regexes over whole texts) would run on one core. When the scan
    has fewer splits than cores, rows are spread round-robin (a deterministic,
    retry-safe repartition); a large input already has many splits and is
    left as it is. Filters and column pruning still reach the scan below."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def msg_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels: quality 0 -> spam, 1 -> ham, else null.

    Both sides grow with the data, so this is a plain shuffle join on the
    unique ``doc_id`` (no skew possible on a key that is unique per side)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("message_id"),
                    email_quality_label(F.col("quality")).alias("label"),
                    F.col("text").alias("original_text"),
                    F.lit("email").alias("source"),
                    F.lit(0).alias("source_rank")))


def msg_sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as SMS: user turns are 'spam' (synthetic), others 'ham'."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        (F.lit(SMS_ID_BASE) + F.col("conv_id") * TURNS + F.col("turn")).alias("message_id"),
        F.when(F.col("role") == "user", "spam").otherwise("ham").alias("label"),
        F.col("text").alias("original_text"),
        F.lit("sms").alias("source"),
        F.lit(1).alias("source_rank"))


def email_quality_label(quality):
    """quality 0 -> 'spam', 1 -> 'ham', anything else -> null."""
    return F.when(quality == 0, "spam").when(quality == 1, "ham")


def msg_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, original_text) of both sources: lets dedup run on ids and
    texts alone; an id tells its source, and its label is looked up after."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("message_id"), F.col("text").alias("original_text"))
    return docs.unionByName(msg_sms(spark, sf_dir).select("message_id", "original_text"))


def msg_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, label) of both sources, without texts."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("message_id"), email_quality_label(F.col("quality")).alias("label"))
    return labels.unionByName(msg_sms(spark, sf_dir).select("message_id", "label"))


def attach_labels(spark: SparkSession, sf_dir: str, df: DataFrame,
                  num_partitions: int | None = None) -> DataFrame:
    """Left-join label, source and source_rank to (message_id, ...) rows. Both
    sides are hash partitioned by message id, so the join output keeps that
    partitioning (later stages bucket by the same key without reshuffling)."""
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the labels side is left to the planner: AQE broadcasts it when it is
    # small at run time, otherwise it is shuffled to match (message_id, n)
    j = df.repartition(n, "message_id").join(msg_labels(spark, sf_dir), "message_id", "left")
    sms = F.col("message_id") >= F.lit(SMS_ID_BASE)
    return j.withColumns({"source": F.when(sms, "sms").otherwise("email"),
                          "source_rank": F.when(sms, 1).otherwise(0)})


def msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources, e-mail first (P4 union_sources)."""
    from ..operators.prep import union_sources
    return union_sources(msg_email(spark, sf_dir), msg_sms(spark, sf_dir))


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the relational ``spam_raw`` table: id, v1 (label), v2 (text)."""
    return msg(spark, sf_dir).select(F.col("message_id").alias("id"),
                                     F.col("label").alias("v1"),
                                     F.col("original_text").alias("v2"))


def extract_raw(raw: DataFrame) -> DataFrame:
    """``SELECT v1 AS label, v2 AS texto_original`` (projection pushed to the scan)."""
    return raw.select(F.col("v1").alias("label"), F.col("v2").alias("texto_original"))

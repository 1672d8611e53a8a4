"""Structured Streaming forms of the scoring service (I2) and the
corrections feed (I6).

I2 is stateless: every micro-batch of arriving messages goes through the
same batch function as I1 (``foreachBatch``), so a stream and a batch over
the same rows give the same result. Each micro-batch is written to its own
``batch_id=<n>`` folder with overwrite, so a replayed batch (after a failure,
the checkpoint makes Spark re-run the last uncommitted batch) replaces its
own output instead of duplicating it.

I6 keeps one piece of state per message id, the number of correction clicks
(a streaming aggregation in update mode, held in the state store and
checkpointed); each micro-batch emits the messages whose label changed in
that batch together with their current label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring as SC


def _batch_writer(fn: Callable[[DataFrame], DataFrame], sink_dir: str):
    def handle(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")
    return handle


def score_stream(spark: SparkSession, source_dir: str, schema, score: Callable[[DataFrame], DataFrame],
                 sink_dir: str, checkpoint_dir: str, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Messages arriving as files under ``source_dir`` -> ``score`` (the
    batch I1 function, e.g. ``lambda df: score_table(df, fitted, model, cleaner)``)
    -> idempotent per-batch parquet output under ``sink_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    w = (stream.writeStream.foreachBatch(_batch_writer(score, sink_dir))
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def corrections_stream(spark: SparkSession, clicks_dir: str, mailbox: DataFrame, sink_dir: str,
                       checkpoint_dir: str, available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Correction clicks (files with a column ``id``) -> running click
    count per id (state store) -> for every id clicked in the batch, its
    current label as (id, texto_anonimizado, etiqueta_correcta, estado,
    changed); ``changed`` = differs from the stored label (odd clicks)."""
    reader = spark.readStream.schema("id long")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    clicks = reader.parquet(clicks_dir)
    counts = clicks.groupBy("id").agg(F.count(F.lit(1)).alias("clicks"))

    def changed(batch: DataFrame) -> DataFrame:
        j = batch.join(mailbox, "id")            # unknown ids are ignored
        flipped = F.when(F.col("clicks") % 2 == 1, ~F.col("esSpam")).otherwise(F.col("esSpam"))
        return j.select("id", F.col("texto").alias("texto_anonimizado"),
                        flipped.cast("int").alias("etiqueta_correcta"),
                        F.lit(SC.PENDING).alias("estado"),
                        (F.col("clicks") % 2 == 1).alias("changed"))

    w = (counts.writeStream.outputMode("update")
         .foreachBatch(_batch_writer(changed, sink_dir))
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_corrections(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The feed after all batches: of each id the row of its last batch, if
    its label is changed in it. An id clicked back in a later batch leaves."""
    rows = read_sink(spark, sink_dir)
    cols = [c for c in rows.columns if c not in ("id", "batch_id")]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"))
    return last.select("id", *[F.col(f"_r.{c}").alias(c) for c in cols]).where("changed").drop("changed")


def read_sink(spark: SparkSession, sink_dir: str, schema: str | None = None) -> DataFrame:
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    return reader.option("basePath", sink_dir).parquet(f"{sink_dir}/batch_id=*")

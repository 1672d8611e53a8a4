"""Stand-in relations on the driver tables (FIXTURES.md C) for the
evaluation, scoring and profiling operators. Each one is derived from the
given tables by Spark, so its size grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import split_key_col, test_key_limit
from .tables import table

# Experiment grid of the reference (run order, seed).
RUN_SEEDS = (42, 7, 13, 99, 2024)

# Rule "models" scoring a message from its counts: (ord, name, score, threshold).
# The expressions are shared with the oracle SQL, so they avoid decimal
# literals (Spark types 1000.0 as DECIMAL, DuckDB as DOUBLE).
RULE_MODELS = (
    (0, "Digit share", "num_digits / greatest(message_length, 1)", "CAST(0.005 AS DOUBLE)"),
    (1, "Upper share", "num_uppercase / greatest(message_length, 1)", "CAST(0.03 AS DOUBLE)"),
    (2, "Length", "CAST(message_length AS DOUBLE) / (message_length + 1000)",
     "CAST(2000 AS DOUBLE) / 3000"),
)


def run_id(idx: int, seed: int) -> str:
    return f"run_{idx + 1:02d}_seed{seed}"


def run_grid_column(seeds=RUN_SEEDS):
    """The run grid as an array of (run_id, seed, run_ord) structs, to be
    ``inline``-d into each row (bounded replication, no join)."""
    return F.array(*[F.struct(F.lit(run_id(i, s)).alias("run_id"), F.lit(s).alias("seed"),
                              F.lit(i + 1).alias("run_ord")) for i, s in enumerate(seeds)])


def pred_rule(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None,
              test_size: float = 0.2) -> DataFrame:
    """Predictions contract rows: each run's test split (F8 threshold mode,
    per-run seed) scored by each rule model."""
    if labelled is None:
        from ..plans.messages import labelled_messages
        labelled = labelled_messages(spark, sf_dir)
    base = labelled.select("message_id", "label_num", "message_length", "num_uppercase",
                           "num_digits")
    per_run = (base.select("*", F.inline(run_grid_column()))
               .where(split_key_col(F.col("seed"), "message_id") < F.lit(test_key_limit(test_size))))
    models = F.array(*[F.struct(F.lit(o).alias("model_ord"), F.lit(n).alias("model_name"),
                                F.expr(e).cast("double").alias("score"),
                                F.expr(t).cast("double").alias("_thr"))
                       for o, n, e, t in RULE_MODELS])
    return (per_run.select("run_id", "message_id", F.col("label_num").alias("actual"),
                           F.inline(models))
            .select("run_id", "model_name", "model_ord", "message_id", "actual",
                    (F.col("score") >= F.col("_thr")).cast("int").alias("predicted"), "score"))


def mailbox_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored mailbox: id = event_id, texto = event_type, esSpam = (type = 'error')."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), F.col("event_type").alias("texto"),
                     F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("esSpam"))


def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction clicks: events with value > 50 target message event_id % 100."""
    ev = table(spark, sf_dir, "events")
    return ev.where(F.col("value") > 50).select((F.col("event_id") % 100).alias("id"),
                                                F.col("event_id").alias("click_id"))


def props_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props, with two more keys from the row, as the hyperparameter JSON
    of a 'run': one key holds the text ``None`` at times, one is often absent."""
    ev = table(spark, sf_dir, "events")
    more = F.to_json(F.struct(
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_type") == "error", "None")
        .otherwise(F.format_string("%.2f", "value")).alias("alpha"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).alias("n_jobs")))
    return ev.select(F.col("event_id").cast("string").alias("run_id"),
                     F.col("event_type").alias("model_name"), more.alias("hyperparameters"))

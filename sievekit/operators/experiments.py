"""Experiment reporting (E13-E18) and the model version registry (M9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import evaluate as E

# The published metric names and column order.
METRICS = ("accuracy", "precision", "recall", "f1_score", "auc")
RESULT_COLUMNS = ("run_id", "model_name", "accuracy", "precision", "recall", "f1_score", "auc",
                  "tp", "fp", "tn", "fn", "training_time_sec", "inference_time_sec",
                  "dataset_version", "date_trained", "is_best_model", "is_production_model",
                  "hyperparameters")


def hyperparams_json(params: Mapping[str, object]) -> str:
    """E13 (driver side, one small dict per model): JSON object of strings,
    keys in the estimator's order, values as Python ``str`` would print them."""
    import json
    return json.dumps({k: _py_str(v) for k, v in params.items()})


def _py_str(v) -> str:
    if v is None:
        return "None"
    if isinstance(v, bool):
        return "True" if v else "False"
    return str(v)


def hyperparams_wide(df: DataFrame, keys: Sequence[str], json_col: str = "hyperparameters",
                     id_cols: Sequence[str] = ("run_id", "model_name")) -> DataFrame:
    """JSON object -> one ``hp_<key>`` column per key (null when absent).

    ``keys`` is the explicit, ordered key list (no data-dependent pivot
    discovery pass); parsing is a per-row ``from_json`` into a map, so this
    stays a narrow projection instead of explode + groupBy + pivot."""
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(), T.StringType()))
    return df.select(*id_cols, *[F.try_element_at(m, F.lit(k)).alias(f"hp_{k}") for k in keys])


def mean_by_model(results: DataFrame, metrics: Sequence[str] = METRICS,
                  digits: int = 4) -> DataFrame:
    """Mean of each metric per model, rounded."""
    return results.groupBy("model_name").agg(
        *[F.round(F.avg(m), digits).alias(m) for m in metrics])


def run_grid_splits(labelled: DataFrame, seeds: Sequence[int], test_size: float = 0.2) -> DataFrame:
    """E16 (split part): per run, threshold split of the labelled messages;
    counts per (run, split, label). Each row is replicated once per run of
    the fixed grid (an in-row ``inline``, no join)."""
    from ..sources.standins import run_grid_column
    from .features import split_key_col, test_key_limit
    j = labelled.select("message_id", "label_num", F.inline(run_grid_column(seeds)))
    split = F.when(split_key_col(F.col("seed")) < F.lit(test_key_limit(test_size)), "test") \
             .otherwise("train")
    return (j.groupBy("run_id", split.alias("split"), "label_num")
            .agg(F.count(F.lit(1)).alias("n")))


def results_table(pred: DataFrame, hyper: DataFrame | None = None,
                  timings: DataFrame | None = None, dataset_version: str = "v1.0",
                  canonical_run: str = "run_01_seed42", floor: float = -999.0,
                  date_trained=None) -> DataFrame:
    """One row per run x model in the published column order:
    E1-E7 metrics, E9 selection score, E10 best flag, E11 production flag,
    E13 hyperparameters, E17 timings (null when not measured)."""
    keys = ["run_id", "model_name", "model_ord"]
    m = E.metrics(pred, keys)
    auc = E.roc_auc(pred, keys)
    r = m.join(auc, keys, "left").withColumn("sel_score", E.selection_score(6))
    r = E.production_flag(E.best_in_run(r, floor), canonical_run)
    if hyper is not None:
        r = r.join(hyper.select("run_id", "model_name", "hyperparameters"),
                   ["run_id", "model_name"], "left")
    else:
        r = r.withColumn("hyperparameters", F.lit(None).cast("string"))
    if timings is not None:
        r = r.join(timings, ["run_id", "model_name"], "left")
    else:
        r = r.withColumns({"training_time_sec": F.lit(None).cast("double"),
                           "inference_time_sec": F.lit(None).cast("double")})
    r = r.withColumns({"dataset_version": F.lit(dataset_version),
                       "date_trained": (F.lit(None).cast("timestamp") if date_trained is None
                                        else F.lit(date_trained).cast("timestamp"))})
    return r.select(*RESULT_COLUMNS)


# -- M9: version registry ----------------------------------------------------------------

def bump_model_version(spark: SparkSession, registry_path: str) -> int:
    """M9: version = old max + 1 (absent -> 1), appended as a new row of a
    parquet registry table in the shared folder; returns the new version. The
    number is claimed first (``operators.release``), so of two writers at once
    each gets its own."""
    from ..sources.stage import move_file_into, path_exists
    from .release import claim_version
    schema = "version long"
    above = 0
    if path_exists(spark, registry_path):
        above = spark.read.schema(schema).parquet(registry_path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]   # one row
    version = claim_version(spark, f"{registry_path}_versions", above)
    row = f"{registry_path}_versions/rows/{version:09d}"
    spark.createDataFrame([(version,)], schema).coalesce(1).write.parquet(row)
    move_file_into(spark, row, registry_path, f"version-{version:09d}.parquet")   # appends to one folder at once would clash
    return version

"""Bench: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

Each query is forced with a no-op write (full execution, nothing collected).
``experiment_run`` is the whole grid of five seeds and four models, fitted side
by side. The ``fit_*`` / ``predict_*`` entries are the reference's published
the run's written vectors and fits, predict scores and writes the test rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("sievekit-bench")
               .config("spark.sql.shuffle.partitions", str(cpus))
               .config("spark.driver.memory", "16g")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievekit-bench-", dir="/tmp"))

    from sievekit.plans import experiment as XP
    from sievekit.plans import registry as R

    def force(df):
        df.write.format("noop").mode("overwrite").save()

    times = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        force(fn())
        times[name] = round(time.perf_counter() - t0, 3)

    # warm-up (JIT, class loading, Python workers) on the smallest scale, so the
    # first timed query does not pay the JVM's one-off start costs
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        force(R.QUERIES["flagship_nb_confusion"](spark, warm))
    force(R.QUERIES["value_counts"](spark, sf_dir))

    timed("flagship_nb", lambda: R.QUERIES["flagship_nb_confusion"](spark, sf_dir))
    timed("dedup_text_keep_first", lambda: R.QUERIES["dedup_text_keep_first"](spark, sf_dir))
    timed("clean_text_notebook_stemmed", lambda: R.QUERIES["clean_text_notebook_stemmed"](spark, sf_dir))
    timed("tfidf_weights_unbounded", lambda: R.QUERIES["tfidf_weights_unbounded"](spark, sf_dir))
    timed("stratified_split_exact", lambda: R.QUERIES["stratified_split_exact"](spark, sf_dir))
    timed("roc_auc", lambda: R.QUERIES["roc_auc"](spark, sf_dir))
    timed("results_table", lambda: R.QUERIES["results_table"](spark, sf_dir))
    timed("correlation_matrix", lambda: R.QUERIES["correlation_matrix"](spark, sf_dir))
    timed("distinct_counts", lambda: R.QUERIES["distinct_counts"](spark, sf_dir))

    # the whole grid: five seeds, four models, fits side by side
    t0 = time.perf_counter()
    ex = XP.run_experiment(spark, sf_dir)
    force(ex.results)
    times["experiment_run"] = round(time.perf_counter() - t0, 3)
    # one fit after the other for the times a model takes (seed 42, the grid's own vectors)
    vectors = XP.write_grid_vectors(spark, None, XP.RUN_SEEDS, f"{ex.path}/vectors", 3000)
    short = {"Logistic Regression": "lr", "Naive Bayes": "nb", "Support Vector Machine": "svm",
             "Random Forest": "rf"}
    for name in XP.ML.MODEL_ORDER:
        _, fit_s, pred_s = XP.fit_one(spark, vectors, 0, name, f"{ex.path}/bench/{short[name]}", 1000, 100, 30)
        times[f"fit_{short[name]}"] = round(fit_s, 3)
        times[f"predict_{short[name]}"] = round(pred_s, 3)

    # fits and predictions of all runs are inside experiment_run
    headline = [k for k in times if not k.startswith(("fit_", "predict_"))]
    total = round(sum(times[k] for k in headline), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

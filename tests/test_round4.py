"""What a fit reads is made once: class sums, vocabulary, term counts, test messages."""

from pyspark.sql import functions as F

from sievekit.operators import features as FE
from sievekit.operators import naive_bayes as NB
from sievekit.plans import messages as PL
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fit_writes_its_class_sums_once(spark):
    rows = spark.createDataFrame([(1, 0, "a", 0.5), (1, 0, "b", 0.25), (2, 1, "a", 1.0)], "message_id long, label_num int, feature string, value double")
    model = NB.fit_naive_bayes(rows, rows.select("message_id", "label_num").distinct())
    got = {r.feature: (round(r.lt0, 6), round(r.lt1, 6), r.n_rows) for r in model.theta.collect()}
    assert got == {"a": (-0.606136, -0.405465, 2), "b": (-0.788457, -1.098612, 1)}
    assert "Aggregate [feature" not in _plan(model.theta) and "LogicalRDD" not in _plan(model.theta)   # only the written sums


def test_staged_features_do_not_fit_again(spark):
    df = spark.createDataFrame([(1, "aa bb aa", 3, 1, 0), (2, "bb cc", 5, 0, 2)], "message_id long, clean_text string, message_length int, num_uppercase int, num_digits int")
    lazy = FE.fit_features(df, "clean_text")
    staged = lazy.staged()
    assert sorted(staged.vocab.collect()) == sorted(lazy.vocab.collect()) and staged.scale.collect() == lazy.scale.collect()
    assert "Aggregate" not in _plan(staged.vocab) and "Aggregate" not in _plan(staged.scale)


def test_grid_counts_terms_once_for_all_runs(spark, monkeypatch):
    calls = []
    real = FE.term_counts
    monkeypatch.setattr(FE, "term_counts", lambda *a, **k: calls.append(1) or real(*a, **k))
    grid = PL.naive_bayes_grid(spark, SF_SMALL, (42, 7))
    assert len(calls) == 1
    one = PL.flagship(spark, SF_SMALL, 7).withColumn("run_id", F.lit("run_02_seed7"))
    assert sorted(grid.where("run_id = 'run_02_seed7'").collect()) == sorted(one.collect())


def test_stream_reads_many_files_in_each_batch(spark, monkeypatch):
    from sievekit.plans.registry import QUERIES
    from sievekit.streaming import scoring as STR
    real, seen = STR.score_stream, {}

    def start(spark, src, *a, **k):
        seen.update(k, files=len(spark.read.schema("id long, texto string").parquet(src).inputFiles()))
        return real(spark, src, *a, **k)
    monkeypatch.setattr(STR, "score_stream", start)
    got = QUERIES["score_stream"](spark, SF_SMALL)
    cores = spark.sparkContext.defaultParallelism
    assert seen["max_files_per_trigger"] == cores and cores < seen["files"] <= 3 * cores
    assert sorted(got.collect()) == sorted(QUERIES["score_table"](spark, SF_SMALL).collect())


def test_release_joins_by_the_known_number_of_features(spark, monkeypatch):
    from sievekit.plans import experiment as XP
    from sievekit.plans.registry import QUERIES
    bounds = []
    real = XP.fit_naive_bayes
    monkeypatch.setattr(XP, "fit_naive_bayes", lambda *a, **k: bounds.append(k.get("bound_rows")) or real(*a, **k))
    got = QUERIES["release_confusion"](spark, SF_SMALL)
    assert len(bounds) == 1 and 3 < bounds[0] <= 3003
    assert sorted(r["count"] for r in got.collect()) == sorted(r["count"] for r in PL.flagship(spark, SF_SMALL, 42).collect())


def test_forest_statistics_of_four_tasks_fit_an_executor(spark):
    from sievekit.operators import mllib as ML
    assert 4 * ML.candidates(1000)["Random Forest"].getMaxMemoryInMB() <= 1024

"""Plans and cases of the message preparation and the profiling operators."""

from pyspark.sql import functions as F

from sievekit.operators import prep as P
from sievekit.operators import profile as PR
from sievekit.plans import messages as PL
from sievekit.sources import tables as S
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_hash_aggregates_texts(spark):
    plan = _plan(P.first_per_text(S.msg_texts(spark, SF_SMALL)))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    plan = _plan(P.dedup_text_keep_first(S.msg(spark, SF_SMALL)))
    assert "SortAggregate" not in plan


def test_audit_reads_texts_once(spark):
    plan = _plan(P.dedup_audit(S.msg_texts(spark, SF_SMALL)))
    assert plan.count("Scan parquet") == 2 and "SortAggregate" not in plan     # one per source


def test_audit_counts_nulls_and_repeats(spark):
    rows = [("a",), ("a",), (None,), (None,), ("",)]
    df = spark.createDataFrame(rows, "original_text string")
    assert [tuple(r) for r in P.dedup_audit(df).collect()] == [("clean", 5, 2, 3)]
    assert [tuple(r) for r in P.dedup_audit(df.limit(0)).collect()] == [("clean", 0, 0, 0)]


def test_order_number_sorts_like_rank_and_id(spark):
    rows = [(0, -5), (0, 7), (0, (1 << 62) + 3), (1, -9), (1, 0), (3, 2)]
    df = spark.createDataFrame(rows, "source_rank int, message_id long")
    got = df.orderBy(P.order_number(["source_rank", "message_id"])).collect()
    assert [tuple(r) for r in got] == sorted(rows)


def test_package_rows_keep_a_text_once_for_each_label(spark):
    m = PL.package_messages(spark, SF_SMALL, 4)
    want = S.msg(spark, SF_SMALL).where("label IS NOT NULL AND original_text IS NOT NULL")
    assert m.count() == want.select("label", "original_text").distinct().count()


def test_distinct_counts_have_no_expand(spark):
    li = S.table(spark, SF_SMALL, "lineitem")
    assert "Expand" not in _plan(PR.distinct_counts(li))
    exact = {r.column: r.n_distinct for r in PR.distinct_counts(li).collect()}
    near = {r.column: r.n_distinct for r in PR.distinct_counts(li, approx=True).collect()}
    assert all(abs(near[c] - n) <= 0.2 * n for c, n in exact.items())


def test_column_dropping_cases(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (2, 3, 5, "y")], "a int, b int, c int, d string")
    assert PR.drop_null_columns(df).columns == ["a", "c", "d"]
    assert PR.drop_constant_columns(df).columns == ["a", "d"]          # b holds one value
    assert PR.drop_constant_columns(df.limit(0)).columns == []
    assert PR.numeric_columns(df, 2) == ["a", "b"] and PR.numeric_columns(df, None) == ["a", "b", "c"]


def test_histograms_equal_the_single_column_form(spark):
    li = S.table(spark, SF_SMALL, "lineitem").withColumn("same", F.lit(3))
    cols = ["l_extendedprice", "l_tax", "same"]
    got = {tuple(r) for r in PR.histograms(li, cols, 7).collect()}
    want = {tuple(r) for c in cols for r in PR.histogram(li, c, 7).collect()}
    assert got == want

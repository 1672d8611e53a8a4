"""Row ids, message ids, corrections over several batches, the saved scorer."""

from pyspark.sql import functions as F

from sievekit.operators import experiments as X
from sievekit.operators import prep as P
from sievekit.sources import files as FI
from sievekit.sources import tables as S
from sievekit.streaming.scoring import corrections_stream, latest_corrections


def test_row_ids_of_wide_rows_are_dense(spark):
    n = 3_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.col("id").alias("src"), F.repeat(F.lit("x"), 20).alias("pad"))
    out = P.assign_row_ids(df, ["k"], "id")
    assert str(out._jdf.queryExecution().executedPlan()).count("rangepartitioning") == 0  # read from the written stage
    r = out.agg(F.count("pad"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_distinct("src")).first()
    assert tuple(r) == (n, n, 0, n - 1, n)


def test_sources_never_share_an_id(spark, scratch):
    (a, b) = (f"{scratch}/a.csv", f"{scratch}/b.tsv")
    open(a, "w").write("label,text\nham,one two\nspam,three\n")
    open(b, "w").write("ham\tfour\nspam\tfive six\n")
    both = FI.read_labelled_csv(spark, a).unionByName(FI.read_labelled_tsv(spark, b))
    assert both.select("message_id").distinct().count() == 4


def test_stand_in_ids_are_unique(spark):
    conv = spark.createDataFrame([(0, 0), (0, 1000), (1, 0), (7, 999_999)], "conv_id long, turn long")
    ids = [r[0] for r in conv.select(F.lit(S.SMS_ID_BASE) + F.col("conv_id") * S.TURNS + F.col("turn")).collect()]
    assert len(set(ids)) == 4 and min(ids) > 10 ** 12


def test_line_numbers_of_files(spark, scratch):
    p = f"{scratch}/m.txt"
    open(p, "w", newline="").write("texto\r\none\r\n\r\na\rb\nlast")
    rows = {r.line_no: r.texto for r in FI.read_message_lines(spark, p).collect()}
    assert rows == {1: "one", 3: "a\rb", 4: "last"}


def test_click_taken_back_in_a_later_batch(spark, scratch):
    mailbox = spark.createDataFrame([(1, "x", True), (2, "y", False)], "id long, texto string, esSpam boolean")
    src = f"{scratch}/src"
    for ids in ([1, 2], [1], [2, 2]):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(src)
    q = corrections_stream(spark, src, mailbox, f"{scratch}/sink", f"{scratch}/ck", max_files_per_trigger=1)
    q.awaitTermination()
    rows = latest_corrections(spark, f"{scratch}/sink").collect()
    assert [(r.id, r.etiqueta_correcta) for r in rows] == [(2, 1)]


def test_model_version_counts_up(spark, scratch):
    p = f"{scratch}/registry"
    assert [X.bump_model_version(spark, p) for _ in range(3)] == [1, 2, 3]

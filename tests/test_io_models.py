"""File sources/sinks (S1-S3, S8, S9, S11, S12), MLlib candidates (M1-M8),
version registry (M9) and the streaming forms (I2, I6)."""

import os

from pyspark.sql import functions as F

from sievekit.operators import experiments as X
from sievekit.operators import features as FE
from sievekit.operators import mllib as ML
from sievekit.operators import scoring as SC
from sievekit.plans import messages as PL
from sievekit.sources import files as FI
from sievekit.sources.stage import checkpoint_stage
from sievekit.streaming import scoring as STR
from tests.conftest import SF_SMALL


def test_read_labelled_csv_multiline_quotes(spark, scratch):
    p = os.path.join(scratch, "emails.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('label,text,label_num\n'
                'ham,"Subject: hi\nsecond line, with comma",0\n'
                'spam,"say ""free"" now",1\n')
    rows = FI.read_labelled_csv(spark, p).orderBy("message_id").collect()
    assert [r.label for r in rows] == ["ham", "spam"]
    assert rows[0].original_text == "Subject: hi\nsecond line, with comma"
    assert rows[1].original_text == 'say "free" now'
    assert {r.source for r in rows} == {"email"} and {r.source_rank for r in rows} == {0}


def test_read_labelled_tsv_latin1(spark, scratch):
    p = os.path.join(scratch, "sms.tsv")
    with open(p, "wb") as f:
        f.write("ham\tCafé tonight?\nspam\tWIN £100 now\n".encode("latin-1"))
    rows = FI.read_labelled_tsv(spark, p).collect()
    assert sorted(r.original_text for r in rows) == ["Café tonight?", "WIN £100 now"]
    assert {r.source for r in rows} == {"sms"}


def test_read_sms_csv_and_first_n(spark, scratch):
    p = os.path.join(scratch, "spam.csv")
    with open(p, "wb") as f:
        f.write("v1,v2,,,\nham,Ok lar...,,,\nspam,Free entry,,,\nham,U dun say,,,\n".encode("latin-1"))
    df = FI.read_sms_csv(spark, p)
    assert df.columns == ["v1", "v2"] and df.count() == 3
    assert [r.v2 for r in FI.read_first_n(df, 2, ["v2"]).collect()] == ["Free entry", "Ok lar..."]


def test_read_message_lines_file(spark, scratch):
    p = os.path.join(scratch, "upload.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write('texto\r\n"hola"\n\n  otra linea  \n')
    rows = [r.texto for r in FI.read_message_lines(spark, p).orderBy("line_no").collect()]
    assert rows == ["hola", "otra linea"]


def test_checkpoint_stage_round_trip_keeps_rows_and_partitioning(spark):
    m = PL.prepared(spark, SF_SMALL, materialize=False)
    st = checkpoint_stage(m, "t", key="message_id")
    assert st.count() == m.count()
    plan = st.groupBy("message_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plain = checkpoint_stage(m.select("message_id"), "p")
    assert plain.count() == m.count()


def test_sinks_round_trip(spark, scratch):
    mb = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, texto string, esSpam boolean")
    FI.persist_mailbox(mb, scratch + "/mailbox")
    FI.persist_mailbox(mb.where("id = 2"), scratch + "/mailbox")
    assert FI.load_mailbox(spark, scratch + "/mailbox").count() == 3
    corr = SC.corrections_feed(SC.apply_corrections(mb, spark.createDataFrame([(1,)], "id long")))
    FI.append_corrections(corr, scratch + "/corr")
    got = spark.read.parquet(scratch + "/corr").collect()
    assert [(r.texto_anonimizado, r.etiqueta_correcta, r.estado) for r in got] == [("a", 0, "pendiente")]
    FI.export_report_tables({"t": mb}, scratch + "/reports")
    back = spark.read.option("header", True).csv(scratch + "/reports/t")
    assert back.count() == 2 and back.columns == ["id", "texto", "esSpam"]


def test_bump_model_version(spark, scratch):
    path = scratch + "/version"
    assert X.bump_model_version(spark, path) == 1
    assert X.bump_model_version(spark, path) == 2
    assert X.bump_model_version(spark, path) == 3


def _vectors(spark):
    m = PL.prepared(spark, SF_SMALL)
    train, test = m.where(~F.col("is_test")), m.where(F.col("is_test"))
    fitted = FE.fit_features(train, "clean_text", 3000)
    fm = ML.feature_pipeline(fitted)
    tv = (ML.with_class_weights(fm.transform(train))
          .withColumn("label", F.col("label_num").cast("double")).repartition(1))
    sv = fm.transform(test).withColumn("label", F.col("label_num").cast("double"))
    return tv, sv


def test_mllib_candidates_beat_majority_and_reload(spark, scratch):
    tv, sv = _vectors(spark)
    n = tv.count()
    majority = max(tv.groupBy("label").count().collect(), key=lambda r: r["count"])["count"] / n
    ests = ML.candidates(n, max_iter=30, trees=10, max_depth=8)
    for name in ("Logistic Regression", "Support Vector Machine", "Random Forest"):
        r = ML.fit_and_predict(name, ests[name], tv, sv)
        train_pred = r.model.transform(tv)
        acc = train_pred.where(F.col("prediction") == F.col("label")).count() / n
        assert acc > majority, (name, acc, majority)
        path = scratch + "/m_" + name.replace(" ", "_")
        ML.save_model(r.model, path)
        loaded = type(r.model).load(path)
        a = [x.prediction for x in r.model.transform(sv).orderBy("message_id").collect()]
        b = [x.prediction for x in loaded.transform(sv).orderBy("message_id").collect()]
        assert a == b
        assert r.predictions.where(F.col("score").isNull()).count() == 0


def test_mllib_naive_bayes_needs_clipped_inputs(spark):
    tv, sv = _vectors(spark)
    r = ML.fit_and_predict("Naive Bayes", ML.candidates(tv.count())["Naive Bayes"], tv, sv)
    assert r.predictions.count() == sv.count()


def test_score_stream_over_several_batches_equals_batch(spark, scratch):
    m = PL.prepared(spark, SF_SMALL)
    train = m.where(~F.col("is_test"))
    fitted = FE.fit_features(train, "clean_text", 3000)
    from sievekit.operators.naive_bayes import fit_naive_bayes
    from sievekit.functions.text import clean_text_browser
    model = fit_naive_bayes(fitted.transform(train, "clean_text", keep=("label_num",)),
                            train.select("message_id", "label_num"), bound_rows=3003)
    new = m.where(F.col("is_test")).select(F.col("message_id").alias("id"),
                                           F.col("clean_text").alias("texto"))
    for i in range(3):       # three files -> three micro-batches
        new.where(F.col("id") % 3 == i).coalesce(1).write.parquet(f"{scratch}/src/part{i}")
    def score(b):
        return SC.score_table(b, fitted, model, clean_text_browser)
    q = STR.score_stream(spark, f"{scratch}/src/*", "id long, texto string", score,
                         f"{scratch}/sink", f"{scratch}/ck", max_files_per_trigger=1)
    q.awaitTermination()
    streamed = STR.read_sink(spark, f"{scratch}/sink")
    assert streamed.select("batch_id").distinct().count() == 3
    batch = score(new)
    key = ["id", "esSpam"]
    assert sorted(map(tuple, streamed.select(*key).collect())) == sorted(map(tuple, batch.select(*key).collect()))
    # a replayed run with the same checkpoint adds nothing
    q2 = STR.score_stream(spark, f"{scratch}/src/*", "id long, texto string", score,
                          f"{scratch}/sink", f"{scratch}/ck", max_files_per_trigger=1)
    q2.awaitTermination()
    assert STR.read_sink(spark, f"{scratch}/sink").count() == streamed.count()

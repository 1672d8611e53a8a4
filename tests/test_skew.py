"""Hot keys: one text holding a third of all rows, one term in every
message. Results are checked against brute force (pandas) on a small
fixture derived from the driver tables, with the hot-key salting forced on."""

import math

import pandas as pd
from pyspark.sql import functions as F

from sievekit.operators import features as FE
from sievekit.operators import joins as J
from sievekit.operators import prep as P
from sievekit.sources import tables as S
from tests.conftest import SF_SMALL

HOT_TEXT = "win a free prize now"


def skewed_messages(spark):
    """msg of sf0.001 with every third message's text replaced by one text,
    and a common word appended to every text."""
    m = S.msg(spark, SF_SMALL)
    return m.withColumn("original_text", F.when(F.col("message_id") % 3 == 0, F.lit(HOT_TEXT))
                        .otherwise(F.concat(F.col("original_text"), F.lit(" common"))))


def test_dedup_with_a_hot_text_matches_brute_force(spark):
    m = skewed_messages(spark)
    got = P.dedup_text_keep_first(m).toPandas()
    pdf = m.toPandas().sort_values(["source_rank", "message_id"])
    want = pdf.drop_duplicates(subset=["original_text"], keep="first")
    assert len(got) == len(want)
    assert sorted(got.message_id) == sorted(want.message_id)
    hot = got[got.original_text == HOT_TEXT]
    assert len(hot) == 1 and hot.message_id.iloc[0] == pdf[pdf.original_text == HOT_TEXT].message_id.iloc[0]


def test_hot_term_salting_matches_brute_force(spark, monkeypatch):
    # force every term with df > 20 to be salted (the fixture is small)
    monkeypatch.setattr(J, "ROWS_PER_SALT", 20)
    m = skewed_messages(spark).where(F.col("original_text").isNotNull())
    m = m.select("message_id", F.lower("original_text").alias("clean_text"))
    tf = FE.term_counts(m, "clean_text")
    vocab = FE.build_vocabulary(tf, FE.count_rows(m), None)
    j = J.hot_key_salted_join(tf, vocab.select("term", "idf", "df"), "term", "df",
                              salt_from=F.xxhash64("message_id"), rows_per_salt=20)
    assert j.count() == tf.count()
    # with 20 rows per salt the hot terms really get several salts
    assert vocab.where(F.col("df") > 40).count() > 0
    got = FE.tfidf_weights(tf, vocab, None)
    assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()
    got = got.toPandas()

    # brute force in pandas
    tfp = tf.toPandas()
    n = m.count()
    dfc = tfp.groupby("term").message_id.nunique()
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in dfc.items()}
    tfp["w"] = tfp.tf * tfp.term.map(idf)
    tfp["weight"] = tfp.w / tfp.groupby("message_id").w.transform(lambda s: math.sqrt((s * s).sum()))
    a = got.set_index(["message_id", "term"]).weight.sort_index()
    b = tfp.set_index(["message_id", "term"]).weight.sort_index()
    assert len(a) == len(b)
    assert (a - b).abs().max() < 1e-12
    # the hot term is in every message and was split over many salts
    assert dfc["common"] + dfc["prize"] >= n - 1


def test_salted_join_spreads_a_hot_key(spark):
    big = spark.range(0, 30000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    big = big.withColumn("k", F.when(F.col("k") == 1, F.lit("hot")).otherwise(F.col("id").cast("string")))
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).withColumn("v", F.length("k"))
    j = J.hot_key_salted_join(big, small, "k", "rows", salt_from=F.xxhash64("id"),
                              rows_per_salt=1000)
    assert j.count() == 30000
    per_salt = (big.join(small, "k").where(F.col("k") == "hot").count())
    assert per_salt == 10000
    want = big.join(small, "k").groupBy().agg(F.sum("v")).first()[0]
    assert j.groupBy().agg(F.sum("v")).first()[0] == want

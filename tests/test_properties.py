"""Properties of the distributed operators and plan-shape checks."""

import math
import random
import struct

from pyspark.sql import functions as F

from sievekit.operators import evaluate as E
from sievekit.operators import features as FE
from sievekit.operators import prep as P
from sievekit.operators import scoring as SC
from sievekit.plans import messages as PL
from sievekit.sources import standins as ST
from sievekit.sources import tables as S
from tests.conftest import SF_MID, SF_SMALL


def test_dedup_is_idempotent(spark):
    d1 = P.dedup_text_keep_first(S.msg(spark, SF_SMALL))
    d2 = P.dedup_text_keep_first(d1)
    assert d1.count() == d2.count() == d1.select("original_text").distinct().count()


def test_split_disjoint_complete_and_exact_quota(spark):
    m = PL.labelled_messages(spark, SF_MID)
    ex = FE.split_exact(m, 7).select("message_id", "label_num", "is_test")
    assert ex.count() == m.count() == ex.select("message_id").distinct().count()
    per = {(r.label_num, r.is_test): r.n for r in
           ex.groupBy("label_num", "is_test").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(per.values())
    n_test = sum(v for (lab, t), v in per.items() if t)
    assert n_test == -(-n * 2 // 10)                      # ceil(0.2 n)
    for lab in (0, 1):
        n_c = per.get((lab, True), 0) + per.get((lab, False), 0)
        assert abs(per.get((lab, True), 0) - 0.2 * n_c) <= 1


def test_tfidf_rows_have_unit_norm_and_scaled_train_in_range(spark):
    m = PL.prepared(spark, SF_SMALL)
    train = m.where(~F.col("is_test"))
    fitted = FE.fit_features(train, "clean_text", None)
    tf = FE.term_counts(m, "clean_text")
    w = FE.tfidf_weights(tf, fitted.vocab, None)
    norms = w.groupBy("message_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n"))
    assert norms.where(F.abs(F.col("n") - 1) > 1e-9).count() == 0
    s = FE.minmax_scale(train.select("message_id", *FE.NUMERIC_FEATURES), fitted.scale)
    for c in FE.NUMERIC_FEATURES:
        lo, hi = s.agg(F.min(c), F.max(c)).first()
        assert 0.0 <= lo and hi <= 1.0


def test_minmax_constant_column_maps_to_zero(spark):
    df = spark.createDataFrame([(1, 5, 1, 2), (2, 5, 3, 4)],
                               "message_id long, message_length int, num_uppercase int, num_digits int")
    s = FE.minmax_scale(df, FE.minmax_stats(df))
    assert [r.message_length for r in s.collect()] == [0.0, 0.0]


def test_auc_invariant_under_monotone_change(spark):
    p = ST.pred_rule(spark, SF_SMALL)
    a1 = {(r.run_id, r.model_name): r.auc for r in E.roc_auc(p).collect()}
    p2 = p.withColumn("score", F.exp(F.col("score") * 3.0) + 7.0)
    a2 = {(r.run_id, r.model_name): r.auc for r in E.roc_auc(p2).collect()}
    assert a1 == a2


def hard_scores():
    tiny, least = 5e-324, 2.0 ** -1022
    out = [0.0, -0.0, tiny, 3 * tiny, least, math.nextafter(least, 0), math.nextafter(least, 1), 1.7976931348623157e308, float("inf"), 0.1, 1e-300, 2.5]
    for e in (-1000, -500, -52, -3, -1, 0, 1, 3, 52, 53, 500, 1023):
        out += [2.0 ** e, math.nextafter(2.0 ** e, 0), math.nextafter(2.0 ** e, math.inf)]
    return out + [-x for x in out]


def test_order_key_orders_as_doubles_do(spark):
    scores = [*hard_scores(), float("nan"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(scores)], "i int, score double").repartition(3)
    got = {r.i: r.k for r in df.select("i", E.order_key(F.col("score")).alias("k")).collect()}
    finite = range(len(scores) - 2)
    bits = lambda x: struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    assert [got[i] for i in finite] == [-bits(scores[i]) if scores[i] < 0 else bits(scores[i]) for i in finite]
    assert got[len(scores) - 2] > max(got[i] for i in finite) and got[len(scores) - 1] is None


def test_auc_by_folds_equals_all_pairs(spark):
    rng = random.Random(5)
    pool = [*hard_scores(), float("nan"), None, *(rng.random() * 10.0 ** rng.randint(-20, 20) for _ in range(60))]
    rows = [(f"r{i % 3}", "m", 0, i, rng.randint(0, 1), rng.choice(pool)) for i in range(900)]
    df = spark.createDataFrame(rows, "run_id string, model_name string, model_ord int, message_id long, actual int, score double")
    spark.sparkContext.setJobGroup("auc_build", "building the plan")
    plan = E.roc_auc(df.repartition(7), digits=None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("auc_build")
    got = {r.run_id: r.auc for r in plan.collect()}
    place = lambda x: (0, 0.0) if x is None else (2, 0.0) if math.isnan(x) else (1, x)
    for run in ("r0", "r1", "r2"):
        pos = [place(r[5]) for r in rows if r[0] == run and r[4]]
        neg = [place(r[5]) for r in rows if r[0] == run and not r[4]]
        won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[run] == won / (len(pos) * len(neg))


def test_two_flips_restore_label(spark):
    mb = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, texto string, esSpam boolean")
    clicks = spark.createDataFrame([(1,), (1,), (2,), (9,)], "id long")
    got = {r.id: (r.esSpam, r.changed) for r in SC.apply_corrections(mb, clicks).collect()}
    assert got == {1: (True, False), 2: (True, True)}
    feed = SC.corrections_feed(SC.apply_corrections(mb, clicks)).collect()
    assert [(r.texto_anonimizado, r.etiqueta_correcta, r.estado) for r in feed] == [("b", 1, "pendiente")]


def test_row_ids_dense(spark):
    m = S.msg(spark, SF_SMALL)
    ids = P.assign_row_ids(m, ["source_rank", "message_id"], "id")
    r = ids.agg(F.min("id"), F.max("id"), F.count(F.lit(1)), F.count_distinct("id")).first()
    assert r[0] == 0 and r[1] == r[2] - 1 and r[2] == r[3]


def test_per_message_steps_do_not_shuffle(spark):
    """Term counts and norms over the bucketed message stage need no exchange."""
    m = PL.prepared(spark, SF_SMALL)
    plan = FE.term_counts(m, "clean_text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scan_prunes_and_pushes_filters(spark):
    df = S.table(spark, SF_SMALL, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_vocabulary_broadcast_only_with_bound(spark):
    m = PL.prepared(spark, SF_SMALL)
    train = m.where(~F.col("is_test"))
    tf = FE.term_counts(m, "clean_text")
    bounded = FE.tfidf_weights(tf, FE.fit_features(train, "clean_text", 3000).vocab, 3000)
    unbounded = FE.tfidf_weights(tf, FE.fit_features(train, "clean_text", None).vocab, None)
    pb = bounded._jdf.queryExecution().executedPlan().toString()
    pu = unbounded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in pb
    assert "_salt" in pu


def test_message_preparation_shuffles_texts_twice(spark):
    """Dedup exchange on the text key, then one exchange by message_id for the
    label join (which the bucketed stage reuses); nothing else by key."""
    m = PL.prepared(spark, SF_SMALL, materialize=False, split="none")
    plan = m._jdf.queryExecution().executedPlan().toString()
    hashed = [line for line in plan.splitlines()
              if "Exchange hashpartitioning" in line and "BroadcastExchange" not in line]
    on_text = [h for h in hashed if "original_text" in h]
    on_id = [h for h in hashed if "hashpartitioning(message_id" in h]
    assert len(on_text) == 1 and len(on_id) == 1, hashed
    assert len(hashed) <= 3, hashed      # + the labels side when it is not broadcast

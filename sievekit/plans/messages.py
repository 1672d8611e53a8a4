"""End-to-end plans built from the operators.

The flagship is the seed-42 confusion matrix of the relational Naive Bayes
on the stand-in messages:
msg -> P5 -> P7 -> P9 -> T19 -> T18 -> F8 -> F1..F7 -> M2 -> M6 -> E1/E2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import prep as P
from ..operators import sparse as SP
from ..operators.naive_bayes import fit_naive_bayes
from ..sources import tables as S
from ..sources.stage import checkpoint_stage

CLEANERS = {
    "browser": lambda c: T.clean_text_browser(c),
    "package": lambda c: T.clean_text_package(c),
    "notebook_nostem": lambda c: T.clean_text_notebook(c),
}


def cleaned(rows: DataFrame, cleaner: str, key: str | None = "message_id", buckets: int | None = None) -> DataFrame:
    """``rows`` with ``original_text`` replaced by its ``clean_text`` (empty for
    null). The notebook cleaner stems over the vocabulary of the rows, so its
    tokens are written first; ``buckets``: ``rows`` already lie in that many
    partitions by ``key``."""
    if cleaner != "notebook":
        out = rows.withColumn("clean_text", CLEANERS[cleaner]("original_text")).drop("original_text")
        return P.fill_null_text(out, "clean_text")               # P8 before vectorising
    tokens = rows.withColumn("tokens", T.notebook_tokens(F.coalesce("original_text", F.lit("")))).drop("original_text")
    tokens = checkpoint_stage(tokens, "notebook_tokens", key=key if buckets else None, buckets=buckets, prepartitioned=True)
    return P.stem_join(tokens, "tokens").withColumn("clean_text", T.join_tokens("tokens")).drop("tokens")


def message_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Bucket count of the message stages, from the size of the inputs."""
    from ..session import partitions_for
    return partitions_for(spark, S.scan_splits(spark, sf_dir,
                                               ("documents", "conversations", "labels")))


def labelled_messages(spark: SparkSession, sf_dir: str, source: str = "msg",
                      num_partitions: int | None = None) -> DataFrame:
    """Deduplicated, labelled messages with the T19 counts:
    (message_id, label, original_text, source, source_rank, label_num,
    message_length, num_uppercase, num_digits)."""
    if source == "msg":
        # dedup first (one shuffle of the texts), then join the labels to the
        # winning rows only (one shuffle by id, which the message stage
        # reuses); an e-mail id is below every sms id, so the smallest id is
        # the first row by (source_rank, message_id)
        d = P.first_per_text(S.msg_texts(spark, sf_dir))
        n = num_partitions or message_partitions(spark, sf_dir)
        d = S.attach_labels(spark, sf_dir, P.drop_null_rows(d, ["original_text"]), n)
    else:
        base = {"email": S.msg_email, "sms": S.msg_sms}[source](spark, sf_dir)
        d = P.drop_null_rows(P.dedup_text_keep_first(base), ["original_text"])
    d = d.withColumn("label_num", P.map_label_fixed("label"))
    d = P.drop_null_rows(d, ["label_num"])
    return T.extract_features(d)


def package_messages(spark: SparkSession, sf_dir: str, num_partitions: int) -> DataFrame:
    """Package variant's labelled rows: P6 keeps a text once for each of its
    labels (smallest id), P7 drops null labels and texts, T19 counts."""
    d = P.drop_null_rows(S.msg(spark, sf_dir).select("message_id", "label", "original_text"),
                         ["label", "original_text"])
    d = P.first_per_text(d, keep=("label",)).repartition(num_partitions, "message_id")
    return T.extract_features(P.drop_null_rows(
        d.withColumn("label_num", P.map_label_fixed("label")), ["label_num"]))


def prepared_package(spark: SparkSession, sf_dir: str, seed: int = 42,
                     test_size: float = 0.2) -> DataFrame:
    """Package variant: P6 + P7, T17 with its lemma step (the corpus's own plural
    table), F8. Texts are read once: tokens are staged by message id, and the
    lemma table and the lookup read that stage."""
    n = message_partitions(spark, sf_dir)
    m = package_messages(spark, sf_dir, n).select(
        "message_id", "label_num", "message_length", "num_uppercase", "num_digits",
        T.package_tokens("original_text").alias("tokens"))
    m = checkpoint_stage(m, "package_tokens", key="message_id", buckets=n, prepartitioned=True)
    m = P.lemmatize_join(m, "tokens", P.plural_lemma_table(m, "tokens"))
    m = m.withColumn("clean_text", T.join_tokens("tokens")).drop("tokens")
    m = checkpoint_stage(m, "messages", key="message_id", buckets=n)
    return FE.split_threshold(m, seed, test_size)


def partition_messages(df: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Hash-partition message rows by id once, so that every per-message
    aggregate and join downstream (term counts, norms, scores) is local."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an explicit count keeps HashPartitioning(message_id, n) through AQE and
    # through checkpoint(), which later aggregates and joins rely on
    return df.repartition(n, "message_id")


def prepared(spark: SparkSession, sf_dir: str, seed: int = 42, cleaner: str = "browser",
             split: str = "threshold", test_size: float = 0.2,
             materialize: bool = True) -> DataFrame:
    """Labelled messages with ``clean_text`` and ``is_test``, hash-partitioned
    by ``message_id``. With ``materialize`` the result is a table bucketed by
    ``message_id`` in the shared checkpoint folder (S8): the dedup shuffle
    runs once, lineage is cut (a lost executor re-reads files instead of
    re-running the dedup), and the per-message steps run without exchanges."""
    n = message_partitions(spark, sf_dir)
    m = labelled_messages(spark, sf_dir, num_partitions=n)
    m = cleaned(m.select("message_id", "label_num", "message_length", "num_uppercase", "num_digits", "original_text"),
                cleaner, buckets=n)
    if materialize:
        # rows are already hash-partitioned by message_id (label join), but for stems' salted joins
        m = checkpoint_stage(m, "messages", key="message_id", buckets=n, prepartitioned=cleaner != "notebook")
    else:
        m = partition_messages(m, n)
    # both split modes keep the partitioning: a column, or a broadcast join
    # of the one-row-per-class cut (the exact mode's passes read the stage)
    if split == "exact":
        m = FE.split_exact(m, seed, test_size)
    elif split == "threshold":
        m = FE.split_threshold(m, seed, test_size)
    return m


def staged_term_counts(m: DataFrame, text_col: str = "clean_text", split: str = "is_test") -> DataFrame:
    """F2 once per prepared message set: (message_id, label_num, its split, term,
    tf), written bucketed by message_id like the messages, so vocabulary, fit
    and scoring all read it without re-tokenising or shuffling the texts."""
    tf = FE.term_counts(m, text_col, keep=("label_num", split))
    # the aggregate over the bucketed messages is already partitioned by id,
    # with one partition per message bucket
    return checkpoint_stage(tf, "tf", key="message_id", buckets=m.rdd.getNumPartitions(),
                            prepartitioned=True)


def naive_bayes_predictions(spark: SparkSession, sf_dir: str, seed: int = 42,
                            max_features: int | None = 3000, cleaner: str = "browser",
                            split: str = "threshold") -> DataFrame:
    """Fit features + M2 on train rows, score test rows:
    (message_id, actual, predicted, score)."""
    return predictions_on(prepared(spark, sf_dir, seed, cleaner, split), max_features)


def predictions_on(m: DataFrame, max_features: int | None = 3000, tf: DataFrame | None = None) -> DataFrame:
    """``naive_bayes_predictions`` of a prepared, split message set; ``tf``: its
    term counts with ``label_num`` and ``is_test``, if they are there already."""
    train, test = m.where(~F.col("is_test")), m.where(F.col("is_test"))
    if tf is None:
        tf = staged_term_counts(m)
    train_tf = tf.where(~F.col("is_test")).drop("is_test")
    fitted = FE.fit_features(train, "clean_text", max_features, tf=train_tf).staged()
    bound = None if max_features is None else max_features + len(FE.NUMERIC_FEATURES)
    model = fit_naive_bayes(fitted.transform(train, "clean_text", keep=("label_num",), tf=train_tf),
                            train.select("message_id", "label_num"), bound_rows=bound)
    scored = model.predict(fitted.transform(
        test, "clean_text", tf=tf.where(F.col("is_test")).drop("is_test", "label_num")))
    return (test.select("message_id", F.col("label_num").alias("actual"))
            .join(scored, "message_id", "left")
            .select("message_id", "actual",
                    F.coalesce("predicted", F.lit(0)).alias("predicted"), "score"))


def confusion(pred: DataFrame, seed: int = 42, run: int = 1) -> DataFrame:
    """E1 + E2 of one run's Naive Bayes predictions."""
    pred = pred.select(
        F.lit(f"run_{run:02d}_seed{seed}").alias("run_id"), F.lit("Naive Bayes").alias("model_name"),
        F.lit(1).alias("model_ord"), "actual", "predicted")
    return E.confusion_long(E.confusion_counts(pred))


def flagship(spark: SparkSession, sf_dir: str, seed: int = 42, max_features: int | None = 3000,
             cleaner: str = "browser", split: str = "threshold") -> DataFrame:
    """Seed-42 confusion matrix (long form) of the relational Naive Bayes."""
    return confusion(naive_bayes_predictions(spark, sf_dir, seed, max_features, cleaner, split), seed)


def package_variant(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """Confusion matrix of the package variant (P6, lemmas, 3,000 terms)."""
    return confusion(predictions_on(prepared_package(spark, sf_dir, seed)), seed)


def naive_bayes_grid(spark: SparkSession, sf_dir: str, seeds) -> DataFrame:
    """E16 with the relational model: every seed's split, fit and confusion
    matrix over one message stage and one stage of term counts, in which a run's
    split is a bit."""
    base = prepared(spark, sf_dir, split="none").withColumn("test_bits", SP.test_bits(seeds))
    tf = staged_term_counts(base, split="test_bits")

    def of_run(df, r):
        return df.withColumn("is_test", ~SP.in_train(r)).drop("test_bits")
    runs = [confusion(predictions_on(of_run(base, r), tf=of_run(tf, r)), seed, r + 1) for r, seed in enumerate(seeds)]
    return P.union_sources(*runs)

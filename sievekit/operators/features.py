"""Feature engineering over the corpus (F1-F10), long-table form.

Messages are expected hash-partitioned by ``message_id`` (see
``plans.messages.partition_messages``): then every per-message step here
(term counts, row norms, scoring sums) runs without another exchange, and
only term-keyed aggregates shuffle, after map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import vectorizer_tokens
from .joins import lookup_join

NUMERIC_FEATURES = ("message_length", "num_uppercase", "num_digits")
KEY_BITS = 32
BUCKET_SHIFT = 16          # exact split: 2^16 key buckets per class


# -- F1/F2 -------------------------------------------------------------------------------

def term_counts(df: DataFrame, text_col: str, id_col: str = "message_id",
                keep: Sequence[str] = ()) -> DataFrame:
    """(id, term, tf). With ``df`` partitioned by id this aggregate
    needs no exchange (HashPartitioning(id) satisfies clustering on (id, term))."""
    toks = df.select(id_col, *keep, F.explode(vectorizer_tokens(text_col)).alias("term"))
    return toks.groupBy(id_col, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


# -- F3/F4 -------------------------------------------------------------------------------

def build_vocabulary(train_tf: DataFrame, n_train, max_features: int | None = None,
                     id_col: str = "message_id") -> DataFrame:
    """(term, idf) from training term counts.

    idf = ln((1+n)/(1+df)) + 1; with ``max_features`` the top terms by corpus
    count, ties by term ascending. ``n_train`` is a one-row, one-column
    DataFrame (number of training messages, empty ones included), read as a
    scalar subquery."""
    stats = train_tf.groupBy("term").agg(F.sum("tf").alias("total"),
                                         F.count(F.lit(1)).alias("df"))
    if max_features is not None:
        stats = stats.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    n = n_train.scalar()
    return stats.select("term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)
                        .alias("idf"), "df")


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# -- F5 ------------------------------------------------------------------------------------

def tfidf_weights(tf: DataFrame, vocab: DataFrame, max_features: int | None = None,
                  id_col: str = "message_id", keep: Sequence[str] = ()) -> DataFrame:
    """tf*idf, each message's vector L2-normalised (out-of-vocabulary
    terms dropped). The vocabulary is broadcast only when it has a proven
    size bound (``max_features``); otherwise the join is salted on term."""
    # df (messages per term) drives the salting of hot terms when unbounded
    j = lookup_join(tf, vocab.select("term", "idf", "df"), ["term"], "inner",
                    bound_rows=max_features, salt_from=F.xxhash64(id_col), key_rows="df")
    w = j.drop("df").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, *keep, "term", (F.col("w") / norm).alias("weight"))


# -- F6 ------------------------------------------------------------------------------------

def minmax_stats(train: DataFrame, cols: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """One-row min/max of the training rows (partial aggregate)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max")]
    return train.agg(*aggs)


def minmax_scale(df: DataFrame, stats: DataFrame,
                 cols: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """(x - min) / range with train statistics; a constant training column
    uses range 1 (so train rows get 0); no clipping of test rows. The one-row
    statistics are scalar subqueries (merged into one aggregate by Catalyst)."""
    out = {}
    for c in cols:
        lo, hi = stats.select(f"{c}__min").scalar(), stats.select(f"{c}__max").scalar()
        rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
        out[c] = (F.col(c).cast("double") - lo) / rng
    return df.withColumns(out)


# -- F7 ------------------------------------------------------------------------------------

def numeric_long(df: DataFrame, cols: Sequence[str] = NUMERIC_FEATURES,
                 id_col: str = "message_id", keep: Sequence[str] = ()) -> DataFrame:
    """Scaled numbers as long rows ``(id, feature='#col', value)``."""
    arr = F.array(*[F.struct(F.lit("#" + c).alias("feature"),
                             F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(id_col, *keep, F.inline(arr))


def assemble_features(tfidf: DataFrame, numeric: DataFrame,
                      id_col: str = "message_id", keep: Sequence[str] = ()) -> DataFrame:
    """TF-IDF || scaled numbers as one long table (id, feature, value)."""
    t = tfidf.select(id_col, *keep, F.col("term").alias("feature"), F.col("weight").alias("value"))
    return t.unionByName(numeric.select(id_col, *keep, "feature", "value"))


# -- F8 ------------------------------------------------------------------------------------

def split_key_col(seed, id_col: str = "message_id"):
    """First 32 bits of md5('<seed>:<id>') as a LONG (same in DuckDB);
    ``seed`` may be a column (one key per run of a grid)."""
    h = F.md5(F.concat(seed.cast("string"), F.lit(":"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def split_key(seed: int, id_col: str = "message_id"):
    return split_key_col(F.lit(seed), id_col)


def test_key_limit(test_size: float) -> int:
    return int(test_size * (1 << KEY_BITS))


def split_threshold(df: DataFrame, seed: int, test_size: float = 0.2,
                    id_col: str = "message_id") -> DataFrame:
    """F8 default mode: scan-only, ``is_test = key < test_size * 2^32``."""
    return df.withColumn("is_test", split_key(seed, id_col) < F.lit(test_key_limit(test_size)))


def class_quotas(counts: DataFrame, test_size: float = 0.2, label: str = "label_num") -> DataFrame:
    """Per-class test quota: n_test = ceil(test_size*n); the train share is
    allocated by largest remainder (ties: class ascending) and test gets the
    rest of each class. ``counts`` is small (one row per class)."""
    tot = Window.partitionBy(F.lit(1))
    n = F.sum("n_c").over(tot)
    n_train = n - F.ceil(F.lit(test_size) * n)
    cont = F.col("n_c") * n_train / n
    q = (counts.withColumn("_cont", cont)
         .withColumn("_floor", F.floor("_cont"))
         .withColumn("_need", n_train - F.sum("_floor").over(tot))
         .withColumn("_ord", F.row_number().over(
             Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("_cont") - F.col("_floor")),
                                                  F.asc(label))))
         .withColumn("train_q", F.col("_floor") + (F.col("_ord") <= F.col("_need")).cast("long"))
         .select(label, "n_c", (F.col("n_c") - F.col("train_q")).cast("long").alias("test_q")))
    return q


def _cut_bucket(rows: DataFrame, need: DataFrame, label: str) -> DataFrame:
    """For each class, the bucket ``_b`` holding its ``_need``-th row (rows
    ordered by bucket) and how many rows come before that bucket. The
    histogram is a partial aggregate; its window holds one class's buckets
    (at most 2^16), never rows."""
    hist = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    cum = hist.withColumn("_cum", F.sum("_cnt").over(
        Window.partitionBy(label).orderBy("_b")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = (cum.join(F.broadcast(need), label)
           .where((F.col("_cum") >= F.col("_need")) & (F.col("_need") > 0))
           .groupBy(label, "_need")
           .agg(F.min_by(F.struct("_b", (F.col("_cum") - F.col("_cnt")).alias("_before")),
                         F.col("_b")).alias("_c")))
    return hit.select(label, F.col("_c._b").alias("_b"),
                      (F.col("_need") - F.col("_c._before")).alias("_need"))


def split_exact(df: DataFrame, seed: int, test_size: float = 0.2,
                label: str = "label_num", id_col: str = "message_id",
                materialize_cut: bool = True) -> DataFrame:
    """F8 exact mode: per class, the ``test_q`` rows with the smallest
    (key, id) go to test.

    No window over a class (two classes are two giant groups): the cut is
    found by refinement. Level 1 histograms the high 16 key bits per class
    and finds the bucket holding the cut; level 2 does the same for the low
    16 bits inside that bucket only; the rows that share the resulting full
    32-bit key (hash collisions, a handful) are ranked by id. The per-class
    cut (key, id) is broadcast (one row per class) into a narrow filter.
    With ``materialize_cut`` the cut is written once as a tiny stage, so the
    refinement jobs do not re-run in every later job that reads the split."""
    keyed = df.select(id_col, label, split_key(seed, id_col).alias("_k"))
    counts = keyed.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    need = class_quotas(counts, test_size, label).select(label, F.col("test_q").alias("_need"))
    hi = F.shiftright("_k", BUCKET_SHIFT)
    lo = F.col("_k").bitwiseAND((1 << BUCKET_SHIFT) - 1)
    cut1 = _cut_bucket(keyed.withColumn("_b", hi), need, label)
    lvl2 = (keyed.withColumn("_b1", hi)
            .join(F.broadcast(cut1.select(label, F.col("_b").alias("_b1"))), [label, "_b1"])
            .withColumn("_b", lo))
    cut2 = _cut_bucket(lvl2, cut1.select(label, "_need"), label)
    key_cut = (cut1.select(label, F.col("_b").alias("_b1"))
               .join(cut2, label)
               .select(label, (F.shiftleft("_b1", BUCKET_SHIFT) + F.col("_b")).alias("_kc"),
                       "_need"))
    ranked = (keyed.join(F.broadcast(key_cut), label).where(F.col("_k") == F.col("_kc"))
              .withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(id_col))))
    cuts = (ranked.where(F.col("_r") == F.col("_need"))
            .select(label, F.col("_k").alias("_cut_k"), F.col(id_col).alias("_cut_id")))
    if materialize_cut:
        from ..sources.stage import checkpoint_stage
        cuts = checkpoint_stage(cuts.coalesce(1), "split_cut")
    with_key = df.withColumn("_k", split_key(seed, id_col))
    return (with_key.join(F.broadcast(cuts), label, "left")
            .withColumn("is_test", F.coalesce(
                F.struct("_k", F.col(id_col)) <= F.struct("_cut_k", "_cut_id"), F.lit(False)))
            .drop("_k", "_cut_k", "_cut_id"))


# -- F9 ------------------------------------------------------------------------------------

def balanced_class_weights(train: DataFrame, label: str = "label_num") -> DataFrame:
    """weight_c = n / (k * n_c), one row per class (bounded)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(F.lit(1))
    return counts.select(label, "n_c",
                         (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                         .alias("weight"))


# -- F10: fit on train rows, apply to both --------------------------------------------------------

@dataclass
class FittedFeatures:
    vocab: DataFrame          # (term, idf)
    scale: DataFrame          # one row of min/max
    max_features: int | None

    def staged(self) -> FittedFeatures:
        """Vocabulary and scale written, so that their readers do not fit again."""
        from ..sources.stage import checkpoint_stage
        return FittedFeatures(checkpoint_stage(self.vocab, "vocab"), checkpoint_stage(self.scale, "scale"), self.max_features)

    def transform(self, messages: DataFrame, text_col: str, id_col: str = "message_id",
                  keep: Sequence[str] = (), tf: DataFrame | None = None) -> DataFrame:
        """Long feature table (id, *keep, feature, value) for any message rows;
        ``tf`` may carry precomputed term counts (id, *keep, term, tf) of
        exactly these messages."""
        if tf is None:
            tf = term_counts(messages, text_col, id_col, keep)
        tfidf = tfidf_weights(tf, self.vocab, self.max_features, id_col, keep)
        nums = numeric_long(minmax_scale(messages.select(id_col, *keep, *NUMERIC_FEATURES),
                                         self.scale), id_col=id_col, keep=keep)
        return assemble_features(tfidf, nums, id_col, keep)


def fit_features(train: DataFrame, text_col: str, max_features: int | None = None,
                 id_col: str = "message_id", tf: DataFrame | None = None) -> FittedFeatures:
    """vocabulary, idf and min/max from the training rows only
    (``tf``: precomputed term counts of the training rows)."""
    if tf is None:
        tf = term_counts(train, text_col, id_col)
    vocab = build_vocabulary(tf, count_rows(train), max_features, id_col)
    return FittedFeatures(vocab, minmax_stats(train), max_features)

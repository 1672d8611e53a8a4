"""M2 multinomial Naive Bayes, fitted and applied as relational jobs.

Exact form of the reference model (alpha = 1, fitted prior n_c/n, no
weights): theta_cf = ln((S_cf + a) / (S_c + a*V)), S = summed feature values
per class, V = number of features (vocabulary + numeric columns). Scoring is
jll_c = ln prior_c + sum_f x_f * theta_cf, argmax with the lower class
winning ties, P(spam) = 1 / (1 + exp(jll_0 - jll_1)).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join


@dataclass
class NaiveBayesModel:
    theta: DataFrame        # (feature, lt0, lt1, n_rows = training messages with it)
    prior: DataFrame        # one row: (lp0, lp1)
    bound_rows: int | None  # proven bound of theta's size (for broadcast)

    def predict(self, features: DataFrame, id_col: str = "message_id") -> DataFrame:
        """M6 for this model: (id, jll0, jll1, predicted, score).

        With ``features`` partitioned by id and theta broadcast, the per-message
        sum has no exchange."""
        # unbounded theta: salt only features present in many messages
        j = lookup_join(features, self.theta, ["feature"], "inner",
                        bound_rows=self.bound_rows, salt_from=F.xxhash64(id_col),
                        key_rows="n_rows")
        s = j.groupBy(id_col).agg(F.sum(F.col("value") * F.col("lt0")).alias("s0"),
                                  F.sum(F.col("value") * F.col("lt1")).alias("s1"))
        # the prior is one row: read it as scalar subqueries, not a join
        lp0, lp1 = self.prior.select("lp0").scalar(), self.prior.select("lp1").scalar()
        jll0, jll1 = F.col("s0") + lp0, F.col("s1") + lp1
        return s.select(id_col, jll0.alias("jll0"), jll1.alias("jll1"),
                        (jll1 > jll0).cast("int").alias("predicted"),
                        (F.lit(1.0) / (F.lit(1.0) + F.exp(jll0 - jll1))).alias("score"))


def fit_naive_bayes(train_features: DataFrame, train_labels: DataFrame,
                    alpha: float = 1.0, bound_rows: int | None = None,
                    id_col: str = "message_id", label: str = "label_num") -> NaiveBayesModel:
    """``train_features``: (id, label, feature, value) of training rows; every
    feature of the model must occur there at least once (the vocabulary is
    built from the same rows, numeric features are present on every row).
    ``train_labels``: (id, label) with labels 0/1, one row per message. The class
    sums (a row per feature) and the class counts are written once; all else
    follows from them."""
    from ..sources.stage import checkpoint_stage
    labelled = train_features
    sums = (labelled.groupBy("feature")
            .agg(F.sum(F.when(F.col(label) == 0, F.col("value")).otherwise(0.0)).alias("f0"),
                 F.sum(F.when(F.col(label) == 1, F.col("value")).otherwise(0.0)).alias("f1"),
                 F.count(F.lit(1)).alias("n_rows")))
    sums = checkpoint_stage(sums, "nb_sums")
    a = F.lit(float(alpha))
    totals = sums.agg((F.sum("f0") + a * F.count(F.lit(1))).alias("t0"),
                      (F.sum("f1") + a * F.count(F.lit(1))).alias("t1"))
    t0, t1 = totals.select("t0").scalar(), totals.select("t1").scalar()
    theta = sums.select("feature", (F.log(F.col("f0") + a) - F.log(t0)).alias("lt0"),
                        (F.log(F.col("f1") + a) - F.log(t1)).alias("lt1"), "n_rows")
    counts = train_labels.agg(F.count(F.when(F.col(label) == 0, 1)).alias("n0"),
                              F.count(F.when(F.col(label) == 1, 1)).alias("n1"))
    counts = checkpoint_stage(counts, "nb_counts")
    n = F.col("n0") + F.col("n1")
    prior = counts.select((F.log("n0") - F.log(n)).alias("lp0"),
                          (F.log("n1") - F.log(n)).alias("lp1"))
    return NaiveBayesModel(theta, prior, bound_rows)


# -- M8 for this model: the whole scorer ------------------------------------------------------

def save_scorer(fitted, model: NaiveBayesModel, path: str) -> None:
    """Vocabulary with idf, min/max, class tables and their bounds under
    ``path``: all that scoring raw messages needs."""
    spark = model.theta.sparkSession
    bounds = spark.createDataFrame([(fitted.max_features, model.bound_rows)], "max_features long, bound_rows long")
    for name, df in (("vocab", fitted.vocab), ("scale", fitted.scale), ("theta", model.theta), ("prior", model.prior), ("bounds", bounds)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_scorer(spark, path: str):
    """(FittedFeatures, NaiveBayesModel) as saved."""
    from .features import FittedFeatures
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    b = read("bounds").first()
    return FittedFeatures(read("vocab"), read("scale"), b.max_features), NaiveBayesModel(read("theta"), read("prior"), b.bound_rows)

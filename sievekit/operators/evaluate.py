"""Evaluation and selection (E1-E12) over the predictions contract:
``(run_id, model_name, model_ord, message_id, actual, predicted, score)``.

All metrics are one grouped aggregate per (run, model) (map-side partial
aggregation, output bounded by the number of runs x models); division uses
``try_divide`` because ANSI mode raises on /0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import CLASS_NAMES

KEYS = ("run_id", "model_name", "model_ord")


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when undefined (zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tn, fp, fn, tp per group (row = actual, col = predicted)."""
    a, p = F.col("actual"), F.col("predicted")

    def cnt(c):
        return F.count(F.when(c, 1)).cast("long")
    return pred.groupBy(*keys).agg(
        cnt((a == 0) & (p == 0)).alias("tn"), cnt((a == 0) & (p == 1)).alias("fp"),
        cnt((a == 1) & (p == 0)).alias("fn"), cnt((a == 1) & (p == 1)).alias("tp"))


def confusion_long(counts: DataFrame, keys: Sequence[str] = ("run_id", "model_name")) -> DataFrame:
    """Four rows per group, zero cells present (unpivot of E1)."""
    h, s = CLASS_NAMES
    stack = (f"stack(4, '{h}', '{h}', tn, '{h}', '{s}', fp, "
             f"'{s}', '{h}', fn, '{s}', '{s}', tp) as (actual_class, predicted_class, count)")
    return counts.select(*keys, F.expr(stack))


def accuracy(c: DataFrame = None) -> Column:
    """E3 over E1 columns."""
    return _div0(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def precision() -> Column:
    """E4."""
    return _div0(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    """E5."""
    return _div0(F.col("tp"), F.col("tp") + F.col("fn"))


def f1() -> Column:
    """2tp / (2tp + fp + fn)."""
    return _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def metrics(pred: DataFrame, keys: Sequence[str] = KEYS, digits: int = 6) -> DataFrame:
    """E1 + E3-E6 in one pass."""
    c = confusion_counts(pred, keys)
    return c.select(*keys, "tn", "fp", "fn", "tp",
                    F.round(accuracy(), digits).alias("accuracy"),
                    F.round(precision(), digits).alias("precision"),
                    F.round(recall(), digits).alias("recall"),
                    F.round(f1(), digits).alias("f1_score"))


def order_key(score: Column) -> Column:
    """A double's place in the order of all doubles as a long: equal values
    (0.0 and -0.0 too) have equal keys, NaN is last, null stays null.

    It is the number's exponent and fraction side by side, taken by exact
    arithmetic with powers of two; ``log2`` may miss a power by one, which the
    two cases beside it mend."""
    x = F.abs(score)
    guess = F.floor(F.log2(x))
    part = x / F.pow(F.lit(2.0), guess)
    exponent = F.when(part >= 2, guess + 1).when(part < 1, guess - 1).otherwise(guess)
    fraction = (x / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)
    size = (F.when(F.isnan(score), F.lit((2047 << 52) + 1))
            .when(x == float("inf"), F.lit(2047 << 52))
            .when(x < 2.0 ** -1022, (x / 2.0 ** -1074).cast("long"))
            .otherwise((exponent + 1023) * (1 << 52) + fraction.cast("long")))
    return F.when(score.isNotNull(), F.when(score < 0, -size).otherwise(size))


def roc_auc(pred: DataFrame, keys: Sequence[str] = KEYS, digits: int | None = 6) -> DataFrame:
    """E7 exact ROC AUC (ties count half), null when a class is missing. A null
    score counts as below all others, NaN as above.

    AUC = sum over positives of (#neg with lower score + 0.5 #neg tied) / (P*N).
    Scores are aggregated to distinct values first (a hot score is one row).
    Their 64-bit order keys are then folded by 16 bits at a time: a window over
    one prefix counts the negatives below each row *within the prefix*, and the
    aggregate of the prefix carries its classes and pairs won on to the next
    fold. A window so holds 65,536 rows (and one for null) at most, whatever the
    scores, the aggregate after it reuses its partitions, and nothing is
    joined, cached or run while the plan is built."""
    keys = list(keys)
    d = (pred.groupBy(*keys, "score").agg(
            F.count(F.when(F.col("actual") == 1, 1)).alias("pos"),
            F.count(F.when(F.col("actual") == 0, 1)).alias("neg"))
         .select(*keys, order_key(F.col("score").cast("double")).alias("_key"), "pos", "neg",
                 (F.col("pos") * 0.5 * F.col("neg")).alias("_won")))
    for up in [F.shiftright("_key", 16)] * 3 + [F.lit(0).cast("long")]:
        w = (Window.partitionBy(*keys, "_up").orderBy("_key")
             .rowsBetween(Window.unboundedPreceding, -1))
        below = F.coalesce(F.sum("neg").over(w), F.lit(0))
        d = (d.withColumn("_up", up).withColumn("_won", F.col("_won") + F.col("pos").cast("double") * below)
             .groupBy(*keys, "_up").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "_won")))
             .withColumnRenamed("_up", "_key"))
    auc = F.try_divide("_won", F.col("pos").cast("double") * F.col("neg"))
    return d.select(*keys, (F.round(auc, digits) if digits is not None else auc).alias("auc"))


def classification_report(pred: DataFrame, keys: Sequence[str] = ("run_id", "model_name"),
                          digits: int = 6) -> DataFrame:
    """Per class precision/recall/F1/support, accuracy, macro and
    weighted averages, as rows (report_row, precision, recall, f1_score, support)."""
    c = confusion_counts(pred, keys)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    # class 1 is the positive class; class 0 swaps roles (tp<->tn, fp<->fn)
    p1, r1, f1_1 = _div0(tp, tp + fp), _div0(tp, tp + fn), _div0(2 * tp, 2 * tp + fp + fn)
    p0, r0, f1_0 = _div0(tn, tn + fn), _div0(tn, tn + fp), _div0(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = _div0(tp + tn, n)

    def wavg(a, b):
        return _div0(a * s0 + b * s1, n)
    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("report_row"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        s.cast("long").alias("support"))
    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", p0, r0, f1_0, s0), row("1", p1, r1, f1_1, s1),
        row("accuracy", none, none, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f1_0, f1_1), n))
    out = c.select(*keys, F.inline(rows))
    return out.withColumns({m: F.round(m, digits) for m in ("precision", "recall", "f1_score")})


def selection_score(digits: int | None = 6) -> Column:
    """Recall - 0.1 * fp (fp as an absolute count)."""
    s = recall() - F.lit(0.1) * F.col("fp")
    return F.round(s, digits) if digits is not None else s


def best_in_run(scored: DataFrame, floor: float = -999.0, score_col: str = "sel_score",
                run: str = "run_id", order: str = "model_ord") -> DataFrame:
    """Flag the highest score per run (first model wins ties) when it
    beats ``floor``; a run may have no winner (floor -1 in phase 4/5).
    The window holds one run's models (a bounded grid), not message rows."""
    w = Window.partitionBy(run).orderBy(F.desc(score_col), F.asc(order))
    return scored.withColumn("is_best_model",
                             (F.row_number().over(w) == 1) & (F.col(score_col) > F.lit(floor)))


def production_flag(scored: DataFrame, canonical_run: str = "run_01_seed42",
                    score_col: str = "sel_score", order: str = "model_ord") -> DataFrame:
    """The winner of the canonical run is flagged in every run."""
    winner = (scored.where(F.col("run_id") == canonical_run)
              .agg(F.max_by("model_name", F.struct(F.col(score_col), -F.col(order)))
                   .alias("_prod")))
    return scored.withColumn("is_production_model",
                             F.coalesce(F.col("model_name") == winner.scalar(), F.lit(False)))


def rank_by_f1(m: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Models by F1 descending (first model wins ties); rank 1 is best."""
    w = Window.partitionBy(*keys).orderBy(F.desc("f1_score"), F.asc("model_ord"))
    return m.withColumn("f1_rank", F.row_number().over(w).cast("int"))


def best_by_f1(m: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return rank_by_f1(m, keys).where(F.col("f1_rank") == 1)

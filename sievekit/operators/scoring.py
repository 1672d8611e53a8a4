"""Scoring service data paths (I1, I3-I7) as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as FE
from .prep import assign_row_ids

PENDING = "pendiente"


def score_table(messages: DataFrame, fitted: FE.FittedFeatures, model, cleaner,
                text_col: str = "texto", id_col: str = "id") -> DataFrame:
    """T19 counts on the raw text + the model's own cleaner (D1: the
    cleaner is stored with the model) -> features -> class. Adds
    ``esSpam`` (label 1) and ``score``."""
    from ..functions.text import extract_features
    from .features import NUMERIC_FEATURES
    from .prep import cast_float32
    m = extract_features(messages, text_col).withColumn("clean_text", cleaner(F.col(text_col)))
    m = cast_float32(m, NUMERIC_FEATURES)   # P12: the service feeds float32 counts
    m = m.withColumnRenamed(id_col, "message_id")
    scored = model.predict(fitted.transform(m, "clean_text"))
    return (m.select("message_id", text_col).join(scored, "message_id", "left")
            .select(F.col("message_id").alias(id_col), text_col,
                    (F.coalesce("predicted", F.lit(0)) == 1).alias("esSpam"), "score"))


def route_mailbox(mailbox: DataFrame) -> DataFrame:
    """Spam -> 'spam' box, else 'inbox'."""
    return mailbox.withColumn("box", F.when(F.col("esSpam"), "spam").otherwise("inbox"))


def mailbox_view(mailbox: DataFrame) -> DataFrame:
    """I3 display order: position by box, newest (largest id) first."""
    keyed = route_mailbox(mailbox).withColumn("_newest", -F.col("id"))
    return assign_row_ids(keyed, ["box", "_newest"], "position").drop("_newest")


def assign_message_ids(lines: DataFrame, batch_ms: int, order: Sequence[str]) -> DataFrame:
    """I4: id = batch time (ms) + line index over the whole upload, counted
    before skipped lines are dropped (so ids have gaps). ``lines`` holds all
    raw lines with ``texto`` null for skipped ones."""
    numbered = assign_row_ids(lines, order, "_idx")
    return (numbered.where(F.col("texto").isNotNull())
            .select((F.lit(batch_ms) + F.col("_idx")).alias("id"), *[c for c in lines.columns]))


def apply_corrections(mailbox: DataFrame, clicks: DataFrame) -> DataFrame:
    """Every click on a stored id flips its label; n clicks = n mod 2
    flips; unknown ids are ignored. Clicks are pre-aggregated per id
    (partial aggregate) before the join."""
    parity = clicks.groupBy("id").agg((F.count(F.lit(1)) % 2).alias("_flips"))
    j = mailbox.join(parity, "id", "left")
    flipped = F.when(F.col("_flips") == 1, ~F.col("esSpam")).otherwise(F.col("esSpam"))
    return j.select("id", "texto", flipped.alias("esSpam"),
                    F.coalesce(F.col("_flips") == 1, F.lit(False)).alias("changed"))


def corrections_feed(corrected: DataFrame) -> DataFrame:
    """Changed rows as (texto_anonimizado, etiqueta_correcta, estado)."""
    return corrected.where("changed").select(
        F.col("id"), F.col("texto").alias("texto_anonimizado"),
        F.col("esSpam").cast("int").alias("etiqueta_correcta"),
        F.lit(PENDING).alias("estado"))


def batch_count(scored: DataFrame) -> DataFrame:
    """Number of messages scored in the upload."""
    return scored.agg(F.count(F.lit(1)).alias("procesados"))

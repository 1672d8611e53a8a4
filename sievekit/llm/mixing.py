"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Sources (by code point, null last) weigh 1, 2, 3, repeating;
targets share the total of all sizes, stop at ``max_repeat`` times the source
and hand the excess on by weight. The targets are cut into blocks of
``BLOCK`` words; Sainte-Laguë (highest quotients) gives each source a whole
number of blocks, and each source's blocks are given to its shards the same
way, by shard size. In a shard the documents lie in a seeded order and the
quota is a run of blocks from the start of that order, begun anew when the
shard is used up, so the repeats of two documents differ by one at most.

A hot source has as many shards as its size asks for (``SHARD_WORDS`` words
each), so no window holds more than a shard. What the driver gets is one row
per source; the shards' quotas are computed in one group per source, one row
per ``SHARD_WORDS`` words (1e13 words: 2.4 million rows).

Cases: a null text has size 0 and takes 0 words, as has any text without
words (such rows are in no shard); a null source is a source of
its own; the order within a shard is a seeded hash of (doc_id, text), so rows
that are equal in both are interchangeable and reruns agree; an empty table
gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import checkpoint_stage
from .quality_rules import WORD

BLOCK = 16
SHARD_WORDS = 1 << 22
WEIGHTS = (1, 2, 3)


def capped_targets(sizes: list[int], weights: list[int], limit: int = 3) -> list[Fraction]:
    """Shares of sum(sizes) by weight, none above limit * size."""
    target = [Fraction(0)] * len(sizes)
    left, open_ = Fraction(sum(sizes)), set(range(len(sizes)))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total >= limit * sizes[i]}
        for i in full or open_:
            target[i] = Fraction(limit * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


def sainte_lague(votes, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1); ties go to the lower
    index. Begins with the floors of the shares, deals the seats left by
    quotients, and then moves seats while some next quotient is above the last
    one that got a seat (floors can exceed what the quotients give)."""
    votes = [Fraction(v) for v in votes]
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return np.zeros(len(votes), np.int64)
    quota = [int(v * seats / total) for v in votes]
    # heap entries carry the quota they were made for; older ones are skipped
    give = [(-v / (2 * q + 1), i, q) for i, (v, q) in enumerate(zip(votes, quota)) if v > 0]
    take = [(votes[i] / (2 * q - 1), -i, q) for i, q in enumerate(quota) if q > 0]
    heapq.heapify(give)
    heapq.heapify(take)

    def change(i: int, by: int) -> None:
        quota[i] += by
        heapq.heappush(give, (-votes[i] / (2 * quota[i] + 1), i, quota[i]))
        if quota[i] > 0:
            heapq.heappush(take, (votes[i] / (2 * quota[i] - 1), -i, quota[i]))

    def top(heap: list, sign: int) -> tuple:
        while heap and quota[sign * heap[0][1]] != heap[0][2]:
            heapq.heappop(heap)
        return heap[0] if heap else (Fraction(0), 0, 0)

    for _ in range(seats - sum(quota)):
        change(top(give, 1)[1], 1)
    while take and -top(give, 1)[0] > top(take, -1)[0]:
        high, low = give[0][1], -take[0][1]
        change(high, 1)
        change(low, -1)
    return np.array(quota, np.int64)


def _plan(sized: DataFrame, weights, limit: int, block: int, shard_words: int) -> DataFrame:
    """(source, source_size, target, n_blocks, n_shards), a row per source."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["n"] or 0) for r in rows]
    target = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], limit)
    quota = sainte_lague(target, round(sum(target) / block)) if rows else []
    data = [(r["source"], n, float(t), int(q), max(1, -(-n // shard_words))) for r, n, t, q in zip(rows, sizes, target, quota)]
    return spark.createDataFrame(data, "source string, source_size long, target double, n_blocks long, n_shards long")


def _shard_quotas(block: int, limit: int):
    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        seats = sainte_lague([int(n) for n in pdf["shard_size"]], int(pdf["n_blocks"].iloc[0]))
        return pdf.assign(quota=np.minimum(seats * block, limit * pdf["shard_size"].to_numpy()))[["source_key", "shard", "shard_size", "quota"]]
    return quotas


def mix_sources(docs: DataFrame, weights=WEIGHTS, limit: int = 3, block: int = BLOCK,
                shard_words: int = SHARD_WORDS, seed: int = 17) -> DataFrame:
    """(doc_id, row_key, size, source, source_size, target, taken, full, rest):
    ``full`` whole copies and the first ``rest`` words once more.
    row_key: the hash of the text, to join rows back that share a doc_id."""
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"))
    sized = checkpoint_stage(sized, "mix_sizes")
    plan = _plan(sized, weights, limit, block, shard_words)
    # a row per source, far smaller than its documents; still joined by AQE's choice
    keyed = (sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
             .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
             .withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "row_key"))
             .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "row_key"), "n_shards")))
    shards = keyed.groupBy("source_key", "shard", "n_blocks").agg(F.sum("size").alias("shard_size"))
    quotas = shards.groupBy("source_key").applyInPandas(
        _shard_quotas(block, limit), "source_key string, shard long, shard_size long, quota long")
    w = Window.partitionBy("source_key", "shard").orderBy("_order", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    # rows without words take nothing and have no place in a shard's order
    placed = (keyed.where("size > 0").withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0)))
              .join(quotas, ["source_key", "shard"]))
    full = F.expr("IF(shard_size > 0, quota DIV shard_size, 0)")
    rest = F.expr("IF(shard_size > 0, quota % shard_size, 0)")
    zero = F.lit(0).cast("long")
    out = ["doc_id", "row_key", "source", "size", "source_size", "target", "taken", "full", "rest"]
    worded = (placed.withColumn("full", full)
              .withColumn("rest", F.greatest(zero, F.least(F.col("size"), rest - F.col("_before"))))
              .withColumn("taken", F.col("full") * F.col("size") + F.col("rest")).select(*out))
    empty = keyed.where("size = 0").withColumns({"taken": zero, "full": zero, "rest": zero}).select(*out)
    return worded.unionByName(empty)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; a copy that
    the quota cuts short keeps its first words, with its own white space."""
    # rows equal in doc_id, source and text lie in one shard, so they share ``full``; each takes the larger ``rest``
    mix = (mix_sources(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "row_key")
           .agg(F.max("full").alias("full"), F.max("rest").alias("rest"), F.max("size").alias("size")))
    rows = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_own"), F.col("source").alias("_from"), F.coalesce("text", F.lit("")).alias("_text"))
    joined = rows.join(mix, F.col("_own").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.xxhash64("_text") == F.col("row_key")))
    # -1: a whole copy; else the words of a copy cut short
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.when(F.col("size") > 0, F.col("full")).otherwise(0).cast("int")),
                      F.when(F.col("rest") > 0, F.array("rest")).otherwise(F.array().cast("array<long>")))
    # words and the white space before them: the first ``rest`` pairs
    cut = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_copy").cast("int")), "")
    short = (F.col("_copy") >= 0) & (F.col("_copy") < F.col("size"))
    out = joined.withColumn("_copy", F.explode(copies)).withColumn("_cut", F.when(short, cut))
    new = {"text": F.coalesce("_cut", "_doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(short, F.length("_cut")).otherwise(F.col("_doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))

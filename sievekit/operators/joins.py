"""Join helpers for a big table against a lookup table.

``lookup_join`` broadcasts the lookup side only when its row count has a
proven bound (a top-k vocabulary, a class list, a fixed grid); otherwise it
salts the join key so a hot key (one term in a third of all rows) is spread
over ``salts`` tasks instead of landing in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest lookup side (rows) that is broadcast when its bound is known.
BROADCAST_MAX_ROWS = 2_000_000
DEFAULT_SALTS = 32


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                salts: int = DEFAULT_SALTS, salt_from: Column | None = None) -> DataFrame:
    """Shuffle join with the big side spread over ``salts`` sub-keys and the
    small side replicated once per sub-key."""
    on = list(on)
    if salt_from is None:
        salt_from = F.xxhash64(*[F.col(c) for c in big.columns])
    big_s = big.withColumn("_salt", F.pmod(salt_from, F.lit(salts)).cast("int"))
    small_s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big_s.join(small_s, on + ["_salt"], how).drop("_salt")


ROWS_PER_SALT = 1_000_000


def hot_key_salted_join(big: DataFrame, small: DataFrame, key: str, key_rows: str,
                        how: str = "inner", salt_from: Column | None = None,
                        rows_per_salt: int | None = None) -> DataFrame:
    """Shuffle join where only hot keys are salted.

    ``small`` carries ``key_rows``: how many rows of ``big`` each key has
    (e.g. a term's document frequency, known from the vocabulary job). A key
    gets ceil(rows / rows_per_salt) salts (1 for ordinary keys), so a key
    holding a third of all rows is spread over many tasks while the lookup
    side is replicated only for those keys. Every key above the target is
    salted. The salt table holds at most rows / rows_per_salt keys (each has
    more rows than that), which bounds its broadcast: 1e13 rows, 1e7 keys."""
    rows_per_salt = rows_per_salt or ROWS_PER_SALT
    salts = F.ceil(F.col(key_rows) / F.lit(rows_per_salt)).cast("int")
    hot = small.select(key, salts.alias("_salts")).where(F.col("_salts") > 1)
    if salt_from is None:
        salt_from = F.xxhash64(*[F.col(c) for c in big.columns])
    big_s = (big.join(F.broadcast(hot), key, "left")
             .withColumn("_salt", F.pmod(salt_from, F.coalesce("_salts", F.lit(1))).cast("int"))
             .drop("_salts"))
    small_s = (small.join(F.broadcast(hot), key, "left")
               .withColumn("_salt", F.explode(F.sequence(F.lit(0),
                                                         F.coalesce("_salts", F.lit(1)) - 1)))
               .drop("_salts"))
    return big_s.join(small_s, [key, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
                bound_rows: int | None = None, salts: int = DEFAULT_SALTS,
                salt_from: Column | None = None, key_rows: str | None = None) -> DataFrame:
    """Broadcast when ``bound_rows`` (a proven upper bound) is small enough;
    else, when ``small`` knows each key's row count (``key_rows``), salt only
    the hot keys; else salt every key."""
    if bound_rows is not None and bound_rows <= BROADCAST_MAX_ROWS:
        return big.join(F.broadcast(small), list(on), how)
    if key_rows is not None and len(on) == 1:
        return hot_key_salted_join(big, small, on[0], key_rows, how, salt_from)
    return salted_join(big, small, on, how, salts, salt_from)

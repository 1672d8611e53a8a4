"""Projection, filter, cleaning and set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import LABEL_MAP


def select_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P1."""
    return df.select(*cols)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P2."""
    return df.withColumnsRenamed(dict(mapping))


def tag_source(df: DataFrame, source: str, rank: int) -> DataFrame:
    """Constant provenance plus the rank that fixes the union order."""
    return df.withColumns({"source": F.lit(source), "source_rank": F.lit(rank)})


def union_sources(*frames: DataFrame) -> DataFrame:
    """Bag union by name. Order is carried by ``(source_rank, message_id)``
    instead of physical row order (Spark has none)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def order_number(order: Sequence[str]):
    """One fixed-width number that sorts like ``order``: the column itself, or
    (rank, id) as rank * 2^64 + id in a decimal (|rank| below 10^18)."""
    if len(order) == 1:
        return F.col(order[0])
    rank, row = order
    return F.col(rank).cast("decimal(38,0)") * F.lit(Decimal(1 << 64)) + F.col(row)


def first_per_text(df: DataFrame, text_col: str = "original_text", order: Sequence[str] = ("message_id",),
                   keep: Sequence[str] = (), out: str = "message_id") -> DataFrame:
    """The smallest order number of each text (and of each value of ``keep``).

    A hash aggregate keyed on (xxhash64(text), text): its buffer is one number,
    so nothing is sorted, a hot duplicate collapses to one row per input
    partition before the shuffle, and the text in the key keeps a hash
    collision from merging texts."""
    return (df.groupBy(F.xxhash64(text_col).alias("_h"), text_col, *keep)
              .agg(F.min(order_number(order)).alias(out)).drop("_h"))


def dedup_text_keep_first(df: DataFrame, text_col: str = "original_text",
                          order: Sequence[str] = ("source_rank", "message_id")) -> DataFrame:
    """P5: one row per text; the earliest row by ``order`` (unique) wins. The
    winners' other columns are fetched by their order number, without texts."""
    first = first_per_text(df, text_col, order, out="_k")
    rest = df.drop(text_col).withColumn("_k", order_number(order))
    return first.join(rest, "_k").select(*df.columns)


def dedup_full_row(df: DataFrame) -> DataFrame:
    """Exact duplicate rows only (same text with two labels keeps both)."""
    return df.dropDuplicates()


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """P7."""
    return df.na.drop(how="any", subset=list(subset))


def fill_null_text(df: DataFrame, col: str) -> DataFrame:
    """P8."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("")))


def map_label_fixed(label, mapping: Mapping[str, int] = LABEL_MAP):
    """Case-sensitive fixed map; anything else -> null."""
    lab = F.col(label) if isinstance(label, str) else label
    expr = None
    for k, v in mapping.items():
        expr = F.when(lab == k, F.lit(v)) if expr is None else expr.when(lab == k, F.lit(v))
    return expr.cast("int")


def encode_label_sorted(df: DataFrame, label: str = "label", out: str = "target") -> DataFrame:
    """P10: code = rank among sorted distinct labels.

    The distinct label set is tiny (classes); it is computed by a partial
    aggregate, ranked with a window over that small set, and joined back
    with a broadcast hint whose size is bounded by the number of classes."""
    classes = df.select(label).where(F.col(label).isNotNull()).distinct()
    codes = classes.withColumn(
        out, (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(F.broadcast(codes), label, "left")


def label_code_pairs(df: DataFrame, label: str = "label", code: str = "target") -> DataFrame:
    """P11."""
    return df.select(label, code).distinct()


def cast_float32(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P12."""
    return df.withColumns({c: F.col(c).cast("float") for c in cols})


def cleaning_audit(before: DataFrame, after: DataFrame, stage: str = "clean") -> DataFrame:
    """Rows before/after/removed. Two partial counts combined in one row."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1))).scalar()
    return b.select(F.lit(stage).alias("stage"), "rows_before", a.alias("rows_after"),
                    (F.col("rows_before") - a).alias("rows_removed"))


def dedup_audit(df: DataFrame, text_col: str = "original_text", stage: str = "clean") -> DataFrame:
    """P13 for P5 + P7 in one pass: group sizes give the rows before, groups
    with a text the rows after."""
    groups = (df.groupBy(F.xxhash64(text_col).alias("_h"), text_col)
              .agg(F.count(F.lit(1)).alias("_n")))
    c = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"),
                   F.count(text_col).alias("rows_after"))
    return c.select(F.lit(stage).alias("stage"), "rows_before", "rows_after",
                    (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P14."""
    return df.drop(*cols)


def attach_columns(left: DataFrame, right: DataFrame,
                   keys: Sequence[str] = ("run_id", "model_name")) -> DataFrame:
    """The reference concatenates by position; here it is a key join."""
    return left.join(right, list(keys), "left")


def preview_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First rows under an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def class_balance(df: DataFrame, by: Sequence[str] = ("split", "label")) -> DataFrame:
    """Rows per split and label."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def assign_row_ids(df: DataFrame, order: Sequence[str], col: str = "id",
                   start: int = 0) -> DataFrame:
    """Dense 0-based ids in ``order`` without a single-partition window: one
    range-partitioned sort, written once with each row's partition and position
    (``monotonically_increasing_id``: partition in the high bits, position in
    the low 33), then the rows before each partition (one row per partition, a
    bounded broadcast) added. Rows and counts read the same written stage, so
    both see the same partitions. Used by S5 and I4."""
    from ..sources.stage import checkpoint_stage
    ranked = checkpoint_stage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()), "row_ids")
    ranked = ranked.withColumns({"_pid": F.shiftright("_mid", 33),
                                 "_pos": F.col("_mid").bitwiseAND((1 << 33) - 1)})
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (ranked.join(F.broadcast(offsets), "_pid")
            .withColumn(col, (F.lit(start) + F.col("_off") + F.col("_pos")).cast("long"))
            .drop("_mid", "_pid", "_pos", "_off"))


# -- T15 relational form ---------------------------------------------------------------------

def plural_lemma_table(df: DataFrame, tokens_col: str) -> DataFrame:
    """A (form, lemma) table derived from the corpus itself: a token ending
    in a single ``s`` (longer than 3 letters) maps to the same word without
    the ``s`` when that word also occurs. Both sides are distinct token sets,
    so the join key is unique per side (no skew). The table keeps each form's
    occurrence count (``rows``) so the lookup can salt only hot forms."""
    vocab = (df.select(F.explode(tokens_col).alias("tok"))
             .groupBy("tok").agg(F.count(F.lit(1)).alias("rows")))
    forms = (vocab.where((F.length("tok") > 3) & F.col("tok").endswith("s")
                         & ~F.col("tok").endswith("ss"))
             .withColumn("lemma", F.expr("substring(tok, 1, length(tok) - 1)")))
    return forms.join(vocab.select(F.col("tok").alias("lemma")), "lemma").select(
        F.col("tok").alias("form"), "lemma", "rows")


def lemmatize_join(df: DataFrame, tokens_col: str, lemmas: DataFrame, id_col: str = "message_id",
                   bound_rows: int | None = None, otherwise=None) -> DataFrame:
    """Replace each token by its lemma (unknown tokens stay), keeping
    token order. Tokens are exploded with their position and looked up with
    a broadcast join when the dictionary has a proven bound, else a join
    salted on (id, position) so a hot token spreads over many tasks; the
    array is rebuilt per message (a message is one row, so its group is
    bounded by its own length). ``otherwise``: the lemma of a token ``form`` that
    the dictionary has not got (by default the token)."""
    from .joins import lookup_join
    toks = df.select(id_col, F.posexplode(tokens_col).alias("_pos", "form"))
    key_rows = "rows" if "rows" in lemmas.columns else None
    j = lookup_join(toks, lemmas, ["form"], "left", bound_rows=bound_rows,
                    salt_from=F.xxhash64(id_col, "_pos"), key_rows=key_rows)
    rebuilt = (j.groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("lemma", "form" if otherwise is None else otherwise)
                                                         .alias("_t")))).alias("_a"))
               .select(id_col, F.transform("_a", lambda s: s["_t"]).alias(tokens_col)))
    return df.drop(tokens_col).join(rebuilt, id_col, "left").withColumn(
        tokens_col, F.coalesce(F.col(tokens_col), F.array().cast("array<string>")))


# -- T14 relational form ---------------------------------------------------------------------

# Most words whose stems are broadcast; the rarer ones are stemmed where they stand.
STEM_TABLE_ROWS = 500_000


def stem_table(df: DataFrame, tokens_col: str, most: int = STEM_TABLE_ROWS) -> DataFrame:
    """(form, lemma) of the most frequent distinct tokens that a rule may change,
    at most ``most`` of them. The vocabulary is a partial aggregate, written once;
    the cut is a power of two of the counts, found from one row per power."""
    from ..functions.porter import may_change, stem_words
    from ..sources.stage import checkpoint_stage
    forms = df.select(F.explode(tokens_col).alias("form")).where(may_change("form"))
    vocab = checkpoint_stage(forms.groupBy("form").agg(F.count(F.lit(1)).alias("rows")), "vocabulary")
    power = F.floor(F.log2("rows")).cast("int")
    left, cut = most, 0
    for r in vocab.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("p")).toLocalIterator():
        if r.n > left:
            cut = r.p + 1
            break
        left -= r.n
    # spread by a count of its own: a small file would be one task's
    words = vocab.where(power >= cut).select("form").repartition(df.sparkSession.sparkContext.defaultParallelism)
    return stem_words(words, "form", "lemma")


def stem_join(df: DataFrame, tokens_col: str, id_col: str = "message_id", most: int = STEM_TABLE_ROWS) -> DataFrame:
    """Every token replaced by its stem, order kept: that of a frequent word
    from a broadcast table of bounded size, so tokens are not shuffled by word.
    ``df`` is read three times: give it as a written stage."""
    from ..functions.porter import may_change, stem_of
    rare = F.when(may_change("form"), stem_of("form")).otherwise(F.col("form"))
    return lemmatize_join(df, tokens_col, stem_table(df, tokens_col, most), id_col, bound_rows=most, otherwise=rare)

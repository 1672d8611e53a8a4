"""Column profiling (X1-X11). Every statistic is one grouped aggregate over
the table (map-side partial aggregation); per-column results come back as
long rows (column, ...) through ``stack``/``inline`` instead of driver loops."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def _unpivot(row_df: DataFrame, cols: Sequence[str], value_alias: str, suffix: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                             F.col(f"{c}{suffix}").alias(value_alias))
                    for i, c in enumerate(cols)])
    return row_df.select(F.inline(arr))


def table_info(df: DataFrame) -> DataFrame:
    """(column, position, type, non_null, rows)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count(F.col(c)).alias(f"{c}__nn") for c in cols])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                             F.lit(types[c]).alias("type"), F.col(f"{c}__nn").alias("non_null"),
                             F.col("__rows").alias("rows"))
                    for i, c in enumerate(cols)])
    return agg.select(F.inline(arr))


def distinct_counts(df: DataFrame, approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """(column, position, n_distinct) of non-null values. Each column's
    distinct values are an aggregate of their own that scans that column only
    (all of them read the table once in total; one aggregate over all columns
    would expand every row k times). ``approx``: one HyperLogLog++ pass."""
    cols = df.columns
    if approx:
        agg = df.agg(*[F.approx_count_distinct(c, rsd).alias(f"{c}__nd") for c in cols])
        return _unpivot(agg, cols, "n_distinct", "__nd")
    parts = [df.select(c).distinct().agg(F.count(c).alias("n_distinct"))
             .select(F.lit(c).alias("column"), F.lit(i).alias("position"), "n_distinct")
             for i, c in enumerate(cols)]
    return reduce(DataFrame.unionAll, parts)


def plottable_columns(df: DataFrame, max_shown: int = 10, below: int = 50) -> DataFrame:
    """Columns with 1 < distinct < ``below``, first ``max_shown`` by position.
    One HyperLogLog++ pass (one row comes back) rules out columns estimated at
    four times the limit or more, far beyond its error; the rest is counted exactly."""
    seen = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns]).first()
    near = [c for c in df.columns if seen[c] < 4 * below]
    place = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    exact = distinct_counts(df.select(*near)) if near else df.sparkSession.createDataFrame(
        [], "column string, position int, n_distinct long")
    return (exact.where((F.col("n_distinct") > 1) & (F.col("n_distinct") < below))
            .select("column", F.element_at(place, F.col("column")).alias("position"))
            .orderBy("position").limit(max_shown))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each non-null value."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """``bins`` equal-width bins over [min, max], last bin closed; a
    constant column spans [v-0.5, v+0.5]; empty bins present."""
    x = F.col(col).cast("double")
    st = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    st = st.select(F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5)
                   .otherwise(F.col("_mn")).alias("_lo"),
                   F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5)
                   .otherwise(F.col("_mx")).alias("_hi"))
    lo_s, hi_s = st.select("_lo").scalar(), st.select("_hi").scalar()
    b = F.least(F.floor((x - lo_s) / ((hi_s - lo_s) / bins)).cast("int"), F.lit(bins - 1))
    counts = (df.where(F.col(col).isNotNull())
              .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    w = (F.col("_hi") - F.col("_lo")) / bins
    grid = st.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi")
    return (grid.join(counts, "bin", "left")
            .select(F.lit(col).alias("column"), "bin",
                    (F.col("_lo") + F.col("bin") * w).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, x, n): each distinct non-null value of each column with its
    row count, pre-aggregated before the shuffle."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                                 F.col(c).cast("double").alias("x"))
                                        for c in cols]))).where(F.col("x").isNotNull())
    return long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """X5 for several columns: values are counted first, so the bins are made
    from distinct values; edges as in ``histogram``."""
    vals = _long_values(df, cols)
    same = F.col("mn") == F.col("mx")
    st = (vals.groupBy("column").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
          .select("column", F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("_lo"),
                  F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("_hi"))
          .withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins))
    at = F.least(F.floor((F.col("x") - F.col("_lo")) / F.col("_w")).cast("int"), F.lit(bins - 1))
    counts = (vals.join(F.broadcast(st), "column")          # one row per column
              .groupBy("column", at.alias("bin")).agg(F.sum("n").alias("count")))
    grid = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def null_free_columns(info: DataFrame) -> DataFrame:
    """X6 as names: columns without nulls (from X1)."""
    return info.where(F.col("non_null") == F.col("rows")).select("column", "position")


def varying_columns(distinct: DataFrame) -> DataFrame:
    """X7 as names: columns with more than one distinct value (from X2)."""
    return distinct.where(F.col("n_distinct") > 1).select("column", "position")


def drop_null_columns(df: DataFrame) -> DataFrame:
    """The table without columns that hold nulls (one counting pass, one row)."""
    n = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if n[c] == 0])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """The table without constant columns: min and max tell, no distinct."""
    r = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if r[c]])


def numeric_columns(df: DataFrame, limit: int | None = 10) -> list[str]:
    """Numeric columns in schema order, at most ``limit`` (the scatter
    matrix's feature; None: all), from the schema of the reduced table."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)][:limit]


PAIRS_PER_BLOCK = 40


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for each pair i < j over the rows where both are present;
    nothing when fewer than two columns remain.

    Two scans. The first takes the means and null counts of the columns (one
    row). The second sums the shifted values, their squares and the products of
    the pairs, each row being read once and not unpivoted; shifting by the means
    keeps the moments exact when a mean is large against the spread. Pairs come
    in blocks of ``PAIRS_PER_BLOCK`` so that a block fits generated code; the
    blocks scan side by side. A pair with nulls on either side has its own sums."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    x = {c: F.col(c).cast("double") for c in cols}
    first = df.agg(*[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(cols)], *[F.count_if(x[c].isNull()).alias(f"k{i}") for i, c in enumerate(cols)]).first()
    mean = {c: first[f"m{i}"] or 0.0 for i, c in enumerate(cols)}
    has_null = {c: first[f"k{i}"] > 0 for i, c in enumerate(cols)}
    d = {c: x[c] - F.lit(mean[c]) for c in cols}

    def block(own: list[tuple[str, str]]) -> DataFrame:
        sums, rows = {"n": F.count(F.lit(1))}, []

        def total(name, value):
            sums.setdefault(name, F.sum(value))
            return F.col(name)

        for i, (a, b) in enumerate(own):
            both = d[a].isNotNull() & d[b].isNotNull()
            if has_null[a] or has_null[b]:
                u, v, tag = F.when(both, d[a]), F.when(both, d[b]), f"_{i}"
                sums[f"n{tag}"] = F.count_if(both)
                n, keys = F.col(f"n{tag}"), (f"a{tag}", f"b{tag}")
            else:
                u, v, n, keys = d[a], d[b], F.col("n"), (f"c{cols.index(a)}", f"c{cols.index(b)}")
            su, sv = total(f"s{keys[0]}", u), total(f"s{keys[1]}", v)
            quu, qvv = total(f"q{keys[0]}", u * u), total(f"q{keys[1]}", v * v)
            p = total(f"p{i}", d[a] * d[b])
            spread = F.sqrt((quu - su * su / n) * (qvv - sv * sv / n))
            r = F.when((n > 1) & (spread > 0), (p - su * sv / n) / spread)
            rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("corr")))
        return df.agg(*[s.alias(name) for name, s in sums.items()]).select(F.inline(F.array(*rows)))

    out = [block(pairs[i:i + PAIRS_PER_BLOCK]) for i in range(0, len(pairs), PAIRS_PER_BLOCK)]
    return reduce(DataFrame.unionByName, out)


def scatter_pairs(df: DataFrame, cols: Sequence[str], corr: DataFrame | None = None) -> DataFrame:
    """(x_col, y_col, x, y) for each pair i < j (one narrow explode, no
    self-join), with the pair's coefficient from X8 (broadcast: #pairs rows)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    arr = F.array(*[F.struct(F.lit(a).alias("x_col"), F.lit(b).alias("y_col"),
                             F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
                    for a, b in pairs])
    pts = df.select(F.inline(arr))
    if corr is None:
        corr = correlation_matrix(df, cols)
    c = corr.select(F.col("col_a").alias("x_col"), F.col("col_b").alias("y_col"), "corr")
    return pts.join(F.broadcast(c), ["x_col", "y_col"], "left")


#: exp(-z*z/2) underflows to 0 beyond this |z|.
REACH = 38.7


def kernel_density(df: DataFrame, cols: Sequence[str], grid: int = 1000) -> DataFrame:
    """X11: Gaussian KDE per column on ``grid`` evenly spaced points over
    [min, max], bandwidth sd * n^(-1/5) (Scott), sd with ddof 1.

    Values are counted first. exp(-z*z/2) is 0 in doubles beyond |z| = 38.6, so a
    distinct value is given only the grid points within that reach, by their
    numbers (no join with the grid); the reach narrows with the bandwidth as
    rows grow. Densities are summed per (column, k) with map-side partial
    aggregation: memory is grid."""
    vals = _long_values(df, cols)
    n = F.col("n").cast("double")
    st = vals.groupBy("column").agg(F.sum("n").alias("rows"), F.min("x").alias("mn"),
                                    F.max("x").alias("mx"), (F.sum(n * F.col("x")) / F.sum(n)).alias("mean"))
    dev = vals.join(F.broadcast(st.select("column", "mean")), "column")
    sd = dev.groupBy("column").agg(F.sum(n * F.pow(F.col("x") - F.col("mean"), F.lit(2))).alias("_ss"))
    st = st.join(sd, "column").withColumn(
        "h", F.sqrt(F.col("_ss") / (F.col("rows") - 1)) * F.pow(F.col("rows").cast("double"), F.lit(-0.2)))
    step = (F.col("mx") - F.col("mn")) / (grid - 1)
    at = lambda k: F.col("mn") + k * step
    near = vals.join(F.broadcast(st.select("column", "rows", "h", "mn", "mx")), "column")      # a row per column
    low = F.greatest(F.floor((F.col("x") - REACH * F.col("h") - F.col("mn")) / step), F.lit(0))
    high = F.least(F.ceil((F.col("x") + REACH * F.col("h") - F.col("mn")) / step), F.lit(grid - 1))
    near = near.select("column", "x", "n", "rows", "h", "mn", "mx", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("k"))
    z = (at(F.col("k")) - F.col("x")) / F.col("h")
    sums = near.groupBy("column", "k").agg(F.sum(n * F.exp(F.lit(-0.5) * z * z)).alias("_s"))
    points = st.select("column", "rows", "h", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k"), "mn", "mx").withColumn("g", at(F.col("k")))
    dens = points.join(sums, ["column", "k"], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    return dens.select("column", "k", F.col("g").alias("x"),
                       (F.col("_s") / (F.col("rows") * F.col("h") * math.sqrt(2 * math.pi)))
                       .alias("density"))

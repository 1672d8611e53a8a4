"""Centroid clustering with heap-ordered bounds: each cluster keeps a heap of
upper-lower gaps offset by accumulated drift; only vectors whose gap expires
are popped and rescanned, so the result is that of plain Lloyd rounds.

Vectors are packed where they are read into blocks of ``BLOCK`` and written
once, bucketed by block. A block's state is one small row: for each cluster a
binary heap of (key, member), key = (distance to the second-nearest centroid -
distance to the nearest) + the cluster's drift when the member entered. A
round moves centroid c by p(c) and adds p(c) + the largest move of the others
to c's drift; a member whose key is still above the drift cannot have changed
its nearest centroid. Spark reads the vectors of those blocks alone that have a
heap with an expired top (both tables have the buckets of the block, so no
round shuffles vectors); a task pops the expired members, measures these, and
gives the changes of the clusters' sums and counts. The driver gets k x 65
numbers a round. Each round's state is written in the shared folder.

Bounds are doubles, widened by far more than their rounding, so a tie or a
near tie is always rescanned; distances, sums and centroids are whole numbers.

Cases: a vector with another number of components, a null or a component that is
null, NaN or infinite is left out; components that leave 2^27 in absolute value
after scaling would overflow a squared distance and raise an error; rows that
repeat count each; starting vectors with equal ids come in the order of their
components, a null id after all others; fewer vectors than clusters give fewer
clusters; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import checkpoint_stage

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
BLOCK = 2048
BUCKET_BYTES = 64 << 20
LIMIT = 1 << 27
#: Relative slack of the bounds; doubles are exact to about 1e-16.
SLACK = 1e-9

STATE = "block long, cluster array<int>, keys binary, members binary, sizes array<int>, top array<double>, moved array<decimal(38,0)>, n_popped long"


def whole_components(embedding: Column, dims: int = DIMS) -> Column:
    """floor(1024 x) of each component, or null if the vector is left out."""
    x = embedding.cast("array<double>")
    good = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda v: F.floor(v * SCALE))
    small = F.forall(x, lambda v: F.abs(v * SCALE) < LIMIT)
    return F.when(good, F.when(small, scaled).otherwise(F.raise_error(F.lit("a component is beyond 2^27 after scaling")).cast("array<long>")))


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    return (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_components(F.col("embedding")).alias("x"))
            .where(F.col("x").isNotNull()))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``: k rows."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.x) for r in vectors.select(key.alias("_h"), "x").orderBy(F.col("_h").asc_nulls_last(), "x").limit(k).toLocalIterator()]


def pack(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, ids, x): blocks of at most ``block`` vectors, int32 in x."""
    def packed(batches):
        from pyspark import TaskContext
        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, x = batch.column("vec_id"), batch.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(len(x), -1)
            for a in range(0, len(x), block):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no], pa.int64()), pa.array([ids[a:a + block].to_pylist()], pa.list_(pa.int64())), pa.array([flat[a:a + block].tobytes()], pa.binary())],
                    names=["block", "ids", "x"])
                no += 1

    return vectors.mapInArrow(packed, "block long, ids array<long>, x binary")


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one column per centroid."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest_gap(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, ties to the smaller number; second distance less first, less the slack)."""
    d = squared(x, centroids)
    best = d.argmin(axis=1)
    if len(centroids) == 1:
        return best, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(float))
    return best, two[:, 1] - two[:, 0] - SLACK * (two.sum(axis=1) + 1)


def state_row(block: int, cluster: np.ndarray, heaps: list, moved: np.ndarray, popped: int):
    """One row of the state; a heap's array order is kept."""
    flat = [e for h in heaps for e in h]
    keys = np.array([e[0] for e in flat], "<f8").tobytes()
    members = np.array([e[1] for e in flat], "<i4").tobytes()
    top = [h[0][0] if h else float("inf") for h in heaps]
    import decimal
    return pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([cluster.tolist()], pa.list_(pa.int32())), pa.array([keys], pa.binary()), pa.array([members], pa.binary()),
        pa.array([[len(h) for h in heaps]], pa.list_(pa.int32())), pa.array([top], pa.list_(pa.float64())),
        pa.array([[decimal.Decimal(int(v)) for v in moved.ravel()]], pa.list_(pa.decimal128(38, 0))), pa.array([popped], pa.int64())],
        names=["block", "cluster", "keys", "members", "sizes", "top", "moved", "n_popped"])


def vectors_of(raw: bytes, dims: int = DIMS) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dims).astype(np.int64)


def opened(centroids: np.ndarray, dims: int = DIMS):
    """Every vector measured once: heaps of the first round."""
    k = len(centroids)

    def run(batches):
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("x")):
                x = vectors_of(raw.as_py(), dims)
                cluster, gap = nearest_gap(x, centroids)
                heaps, moved = [[] for _ in range(k)], np.zeros((k, dims + 1), np.int64)
                for c in range(k):
                    own = np.flatnonzero(cluster == c)
                    heaps[c] = list(zip(gap[own].tolist(), own.tolist()))
                    heapify(heaps[c])
                    moved[c, :dims], moved[c, dims] = x[own].sum(axis=0), len(own)
                yield state_row(block, cluster, heaps, moved, len(x))
    return run


def advanced(centroids: np.ndarray, drift: list[float], dims: int = DIMS):
    """Expired members are popped, measured and pushed where they now belong."""
    k = len(centroids)

    def run(batches):
        for batch in batches:
            cols = {c: batch.column(c) for c in ("block", "x", "cluster", "keys", "members", "sizes")}
            for r in range(batch.num_rows):
                sizes = cols["sizes"][r].as_py()
                entries = list(zip(np.frombuffer(cols["keys"][r].as_py(), "<f8").tolist(), np.frombuffer(cols["members"][r].as_py(), "<i4").tolist()))
                at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                heaps = [entries[at[c]:at[c + 1]] for c in range(k)]
                popped = []
                for c, heap in enumerate(heaps):
                    while heap and heap[0][0] <= drift[c]:
                        popped.append(heappop(heap)[1])
                cluster = np.array(cols["cluster"][r].as_py(), np.int32)
                moved = np.zeros((k, dims + 1), np.int64)
                if popped:
                    own = np.array(popped)
                    x = vectors_of(cols["x"][r].as_py(), dims)[own]
                    best, gap = nearest_gap(x, centroids)
                    for i, b, g in zip(popped, best.tolist(), gap.tolist()):
                        heappush(heaps[b], (g + drift[b], i))
                    new = best != cluster[own]
                    for sign, to in ((-1, cluster[own][new]), (1, best[new])):
                        np.add.at(moved[:, :dims], to, sign * x[new])
                        np.add.at(moved[:, dims], to, sign)
                    cluster[own] = best
                yield state_row(cols["block"][r].as_py(), cluster, heaps, moved, len(popped))
    return run


def moved_sums(state: DataFrame, k: int, dims: int = DIMS) -> np.ndarray:
    """The blocks' changes added up: k x (dims + 1) whole numbers."""
    parts = state.where(F.col("moved").isNotNull()).select(F.posexplode("moved").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v"))
    out = np.zeros(k * (dims + 1), object)
    for r in parts.toArrow().to_pylist():   # k x (dims + 1) rows in one job
        out[r["p"]] = int(r["v"])
    return out.reshape(k, dims + 1)


def rounds(blocks: DataFrame, start: list[list[int]], n_rounds: int, n: int, dims: int = DIMS, seen: list | None = None):
    """(state after the last assignment, final centroids). ``seen`` gets the
    state of each assignment (for tests)."""
    centroids = np.array(start, np.int64)
    k = len(centroids)
    total, drift = np.zeros((k, dims + 1), object), [0.0] * k

    def written(df):
        state = checkpoint_stage(df, "heaps", key="block", buckets=n, prepartitioned=True)
        if seen is not None:
            seen.append(state)
        return state

    state = written(blocks.select("block", "x").mapInArrow(opened(centroids, dims), STATE))
    for _ in range(n_rounds):
        total = total + moved_sums(state, k, dims)
        new = np.array([[int(s) // int(row[dims]) for s in row[:dims]] if row[dims] else c.tolist() for row, c in zip(total, centroids)], np.int64)
        step = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(float))
        for c in range(k):
            drift[c] += (step[c] + max((step[j] for j in range(k) if j != c), default=0.0)) * (1 + SLACK)
        centroids = new
        expired = F.exists(F.arrays_zip("top", F.array(*map(F.lit, drift)).alias("drift")), lambda t: t["top"] <= t["drift"])
        still = state.where(~expired).withColumns({"moved": F.lit(None).cast("array<decimal(38,0)>"), "n_popped": F.lit(0).cast("long")})
        again = state.where(expired).drop("top", "moved", "n_popped").join(blocks.select("block", "x"), "block").mapInArrow(advanced(centroids, list(drift), dims), STATE)
        state = written(again.unionByName(still))
    return state, centroids


def centroid_clusters(embeddings: DataFrame, k: int = CLUSTERS, n_rounds: int = ROUNDS, seed: int = SEED, block: int = BLOCK, seen: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings)
    # buckets of about BUCKET_BYTES of vectors, and work for all cores
    rows = vectors.count()
    n = max(spark.sparkContext.defaultParallelism, -(-rows * DIMS * 4 // BUCKET_BYTES))
    start = first_centroids(vectors, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], out)
    blocks = checkpoint_stage(pack(vectors, block), "vectors", key="block", buckets=n)
    state, centroids = rounds(blocks, start, n_rounds, n, seen=seen)

    def measured(batches):
        for batch in batches:
            for ids, raw, cluster in zip(batch.column("ids"), batch.column("x"), batch.column("cluster")):
                own = np.array(cluster.as_py(), np.int32)
                d = ((vectors_of(raw.as_py()) - centroids[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array(own), pa.array(d)], names=["vec_id", "cluster", "distance"])

    rows = checkpoint_stage(blocks.join(state.select("block", "cluster"), "block").select("ids", "x", "cluster").mapInArrow(measured, "vec_id long, cluster int, distance long"), "clustered")
    # k rows each: bounded by the parameter
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(digests, "cluster")
    inertia = rows.agg(F.sum("distance").alias("inertia"))
    return (rows.join(F.broadcast(sums), "cluster").withColumn("inertia", inertia.scalar())
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Plain Lloyd rounds, written out."""
    ctes = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {DIMS}),
p AS MATERIALIZED (SELECT rid, unnest(range({DIMS})) AS i, unnest(x) AS e FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {CLUSTERS}))"""]
    for r in range(ROUNDS + 1):
        ctes.append(f"""
a{r} AS MATERIALIZED (SELECT rid, min(row(d, k)) AS b FROM (SELECT rid, k, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{r}) GROUP BY rid)""")
        if r < ROUNDS:
            ctes.append(f"""
s{r} AS MATERIALIZED (SELECT b[2] AS k, i, sum(e)::BIGINT AS s, count(*) AS n FROM a{r} JOIN p USING (rid) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY k) m ON m.k = c{r}.k)""")
    return f"""WITH {','.join(ctes)},
f AS (SELECT vec_id, b[2]::INT AS cluster, b[1]::BIGINT AS distance FROM a{ROUNDS} JOIN v USING (rid))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{ROUNDS}.x, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} ON c{ROUNDS}.k = f.cluster"""


SQL = _sql()

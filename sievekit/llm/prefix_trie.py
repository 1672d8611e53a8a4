"""Conversation prefix trie by burst tries.

A turn is known by the SHA-256 of its role and text, so texts leave the scan as
16 bytes. Conversations with equal turns are one class (a partial aggregate
takes a hot conversation down to a row per task); a class has its number of
conversations and its smallest conv_id.

Bursting. All classes begin in the container under the root. A container of more
than ``CONTAINER`` suffixes is burst: its suffixes share turns up to some depth
(the common start of the smallest and the largest, one aggregate), so it becomes
a trie head that spans those turns, and each next turn id opens a container of
its own below. Only rows of burst containers are written again. A round handles
all such containers at once; the number of rounds is that of nested branchings
which more than ``CONTAINER`` different suffixes share.

Sweeping. Containers are dealt to shards by hash; a shard sorts its suffixes and
sweeps them once, with the path of the last one on a stack: a node is complete
when the next suffix leaves it. A frame holds its finished children until their
parent's smallest conv_id is known, at most a container's.

Heads get their subtrees' sums from the containers below: each container carries
the list of its heads. Nodes where conversations end get the digest of their
conv_ids: ids are sorted over all shards, joined in pieces where they lie, and
the pieces go through SHA-256 in order, so no list of a node's members exists.

Cases: rows without conv_id are left out; a null turn comes first, equal turns
are ordered by role and text digest, so repeated rows stay and reruns agree; null
role or text is empty; the base conversation of a negative id c is c - pmod(c, 5);
an empty table has no node, not even a root; a conversation's turn ids (24 bytes
a turn) are handled whole in a task, as a text is; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import checkpoint_stage

CONTAINER = 4096
MOST_BASE_TURNS = 8
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): the ordered turns as (id, bytes)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    one = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_id(role, text).alias("id"), F.octet_length(text).cast("long").alias("b"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["b"].alias("b")))
    return rows.groupBy("conv_id").agg(ordered.alias("seq"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """(conv_id, seq) with the first h turns from the base conversation."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).cast("int")
    rows = seqs.select("conv_id", "seq", (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("base"), h.alias("h"))
    starts = seqs.where(F.pmod("conv_id", F.lit(5)) == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, MOST_BASE_TURNS).alias("start"))
    none = F.array().cast("array<struct<id:binary,b:bigint>>")
    seq = F.concat(F.slice(F.coalesce("start", none), F.lit(1), F.col("h")), F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0))))
    return rows.join(starts, "base", "left").select("conv_id", seq.alias("seq"))


def digested(ids: Column) -> Column:
    """One key for a sequence of turn ids (each 16 bytes)."""
    return F.sha2(F.array_join(F.transform(ids, F.hex), "").cast("binary"), 256)


def end_digests(members: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """(class, ends_sha256): SHA-256 of each class's conv_ids in ascending order,
    comma-joined, from rows (class, conv_id)."""
    def joined(batches):
        at, first, text, size = None, None, [], 0
        for batch in batches:
            out = []
            for key, c in zip(batch.column("class").to_pylist(), batch.column("conv_id").to_pylist()):
                if key != at or size > piece:
                    if text:
                        out.append((at, first, ",".join(text)))
                    at, first, text, size = key, c, [], 0
                text.append(str(c))
                size += len(text[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["class", "first", "ids"])
        if text:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([first]), pa.array([",".join(text)])], names=["class", "first", "ids"])

    def hashed(batches):
        at, sha = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column("class").to_pylist(), batch.column("ids")):
                if key != at:
                    if sha is not None:
                        out.append((at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.as_py().encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["class", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([sha.hexdigest()])], names=["class", "ends_sha256"])

    n = members.sparkSession.sparkContext.defaultParallelism
    n = max(n, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = (members.repartitionByRange(n, "class", "conv_id").sortWithinPartitions("class", "conv_id")
              .mapInArrow(joined, "class string, first long, ids string"))
    return pieces.repartition("class").sortWithinPartitions("class", "first").mapInArrow(hashed, "class string, ends_sha256 string")


def common_start(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays."""
    differs = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)) | (i >= F.least(F.size(a), F.size(b))))
    return F.get(differs, F.lit(0)).cast("int")


def burst(classes: DataFrame, container: int = CONTAINER) -> tuple[DataFrame, DataFrame | None]:
    """(suffixes of containers within the bound, heads).

    suffixes: box, depth (turns above the box's first node), heads (of the box,
    outermost first), above (smallest conv_id of the node above), class, ids, bytes, n, conv.
    heads: box, depth, to (its deepest node), heads, above, bytes (of its turns),
    n, conv, ends (class that ends at its deepest node)."""
    rows = classes.select(F.lit("").alias("box"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("heads"), F.lit(None).cast("long").alias("above"),
                          "class", "ids", "bytes", "n", "conv")
    closed, heads = [], []
    while True:
        size = rows.groupBy("box").agg(F.count(F.lit(1)).alias("_k"))
        big = size.where(F.col("_k") > container).select("box")
        over = checkpoint_stage(rows.join(big, "box", "left_semi"), "trie_over")
        if over.isEmpty():
            return _union([*closed, rows]), _union(heads) if heads else None
        closed.append(rows.join(big, "box", "left_anti"))
        spans = over.groupBy("box").agg(F.first("depth").alias("depth"), F.first("heads").alias("heads"), F.first("above").alias("above"), F.min("ids").alias("_a"), F.max("ids").alias("_b"),
                                        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min(F.struct(F.size("ids").alias("len"), "bytes", "class")).alias("_short"))
        # the shortest sequence ends at the head's deepest node, or goes beyond it
        spans = spans.withColumn("to", common_start(F.col("_a"), F.col("_b")))
        head = checkpoint_stage(spans.select("box", "depth", "to", "heads", "above", F.slice("_short.bytes", F.lit(1), F.col("to")).alias("bytes"), "n", "conv",
                                             F.when(F.col("_short.len") == F.col("to"), F.col("_short.class")).alias("ends")), "trie_heads")
        heads.append(head)
        below = over.drop("depth", "above").join(head.select("box", "to", F.col("conv").alias("above")), "box").where(F.size("ids") > F.col("to"))
        rows = checkpoint_stage(below.select(F.sha2(F.concat("box", F.lit("/"), F.hex(F.get("ids", F.col("to")))).cast("binary"), 256).alias("_box"), (F.col("to") + 1).alias("depth"),
                                             F.array_append("heads", F.col("box")).alias("heads"), "above", "class", "ids", "bytes", "n", "conv").withColumnRenamed("_box", "box"), "trie_rows")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


NODE = "box string, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, class string"


class Frame:
    """A node of the path under the sweep."""

    __slots__ = ("depth", "size", "n", "conv", "ends", "children", "kids", "leaves", "saved")

    def __init__(self, depth: int, size: int):
        self.depth, self.size, self.n, self.conv, self.ends = depth, size, 0, None, None
        self.children, self.kids, self.leaves, self.saved = [], 0, 0, 0

    def row(self, parent) -> tuple:
        return self.conv, self.depth, parent, self.n, self.kids, self.leaves, self.saved, self.ends


def swept(batches):
    """Nodes of each box from its sorted suffixes; a box's nodes begin at its depth."""
    names = [f.split()[0] for f in NODE.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    box = above = top = None
    stack, last, out = [], (), []

    def close(to: int):
        """Completes the path's nodes below the first ``to`` frames."""
        while len(stack) > to:
            node = stack.pop()
            if not node.children:
                node.leaves = 1
            if node.depth:
                node.saved += (node.n - 1) * node.size
            out.extend((box, *child.row(node.conv)) for child in node.children)
            node.kids, node.children = len(node.children), None  # the children are out
            if stack:
                up = stack[-1]
                up.n, up.leaves, up.saved = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved
                up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
                up.children.append(node)
            else:
                out.append((box, *node.row(above)))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for b, depth, over, key, ids, sizes, n, conv in zip(*(batch.column(c).to_pylist() for c in ("box", "depth", "above", "class", "ids", "bytes", "n", "conv"))):
            if b != box:
                close(0)
                box, above, top, last = b, over, depth, ()
            same = top
            while same < len(last) and same < len(ids) and last[same] == ids[same]:
                same += 1
            close(same - top + 1)
            for d in range(top + len(stack), len(ids) + 1):
                stack.append(Frame(d, sizes[d - 1] if d else 0))
            node = stack[-1]
            node.n, node.conv, node.ends = node.n + n, conv if node.conv is None else min(node.conv, conv), key
            last = ids
            if len(out) >= 8192:
                yield batch_of(out)
                out.clear()
    close(0)
    if out:
        yield batch_of(out)


def head_nodes(heads: DataFrame, nodes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The rows of the heads' nodes, with the sums of the boxes below."""
    tops = suffixes.groupBy("box").agg(F.first("heads").alias("heads"), F.first("depth").alias("depth"))
    of_box = nodes.join(tops, "box").where(F.col("nodes_depth") == F.col("depth")).select("heads", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    # a head's own turns; its children are one to a turn
    at = F.sequence(F.col("depth"), F.col("to"))
    own = F.transform(at, lambda d: F.when(d > 0, (F.col("n") - 1) * F.get("bytes", d - 1)).otherwise(F.lit(0)).cast("long"))
    spans = checkpoint_stage(heads.withColumns({"own": own, "all": F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)}), "trie_spans")
    parts = of_box.unionByName(spans.select("heads", F.lit(0).cast("long").alias("leaves"), F.col("all").alias("saved")))
    below = parts.select(F.posexplode(F.reverse("heads")).alias("_up", "box"), "leaves", "saved").groupBy("box").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum(F.when(F.col("_up") == 0, 1).otherwise(0)).cast("long").alias("kids"))
    rows = spans.join(below, "box").select("*", F.posexplode("own").alias("_i", "_own"))
    deepest = F.col("depth") + F.col("_i") == F.col("to")
    rest = F.sum("_own").over(Window.partitionBy("box").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("box", F.col("conv").alias("conv_id"), (F.col("depth") + F.col("_i")).cast("int").alias("depth"), F.when(F.col("_i") == 0, F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"),
                       F.col("n").alias("n_convs"), F.when(deepest, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
                       (F.col("saved") + rest).alias("saved_tokens"), F.when(deepest, F.col("ends")).alias("class"))


def prefix_trie(turns: DataFrame, container: int = CONTAINER) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): one row per node."""
    convs = rebuilt(checkpoint_stage(sequences(turns), "trie_seqs"))
    ids = F.transform("seq", lambda t: t["id"])
    convs = checkpoint_stage(convs.select("conv_id", ids.alias("ids"), F.transform("seq", lambda t: t["b"]).alias("bytes")).withColumn("class", digested(F.col("ids"))), "trie_convs")
    classes = checkpoint_stage(convs.groupBy("class").agg(F.first("ids").alias("ids"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")), "trie_classes")
    suffixes, heads = burst(classes, container)
    nodes = checkpoint_stage(suffixes.repartition("box").sortWithinPartitions("box", "ids").drop("heads").mapInArrow(swept, NODE), "trie_nodes")
    if heads is not None:
        nodes = nodes.unionByName(head_nodes(heads, nodes.withColumnRenamed("depth", "nodes_depth"), suffixes))
    ends = end_digests(convs.select("class", "conv_id"))
    return nodes.join(ends, "class", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


_CRC = "list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::UBIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, _: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"
SQL = f"""
WITH s AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS q, xor({_CRC}, 4294967295::UBIGINT) % 9 AS h
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS MATERIALIZED (SELECT s.conv_id, list_concat(coalesce(z.q[1:s.h], []), s.q[s.h + 1:]) AS q FROM s LEFT JOIN s z ON z.conv_id = s.conv_id - s.conv_id % 5),
p AS MATERIALIZED (SELECT conv_id, d, q[1:d] AS k, len(q) = d AS ends FROM (SELECT conv_id, q, unnest(range(len(q) + 1)) AS d FROM b)),
n AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '') AS e,
       CASE WHEN d > 0 THEN (count(*) - 1) * strlen(k[d].t) ELSE 0 END AS own FROM p GROUP BY d, k),
c AS MATERIALIZED (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (d, k)),
u AS (SELECT a AS d, k[1:a] AS k, sum(own) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM m) GROUP BY 1, 2)
SELECT m.conv_id, m.d::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves,
  u.saved::BIGINT AS saved_tokens, sha256(m.e) AS ends_sha256
FROM m JOIN u USING (d, k) LEFT JOIN n up ON up.d = m.d - 1 AND up.k = m.k[1:m.d - 1]
"""

"""MinHash near-dedup by bottom-k sketches of one hash function.

1. Each text's shingle hashes give a digest of the whole set, its size and its
   bottom-``K`` sketch. Texts with equal sets are collapsed by digest (partial
   aggregate), so a group of copies of any size is one representative.
2. The ``PROBE`` lowest values of each sketch go into inverted lists. Two sets
   of similarity 0.75 share fewer than ``SHARE`` = 10 of the 32 lowest values of
   their union with a chance of 3e-8 (small sets: never fewer than they must),
   so under one order of the values, rarest first, some value among the first
   PROBE - SHARE + 1 of each is common to both. The frequent values of passages
   that many documents share are the ones left out; values of one document
   open no list.
3. Lists generate overlaps in two rounds that lose no link between components
   and do not emit a list's square. First every member is compared with its
   list's centre, the member whose values are the most common ones, and so the
   likeliest to be near all others. Then only members of different components
   are paired, and only with sizes that allow the similarity; of the component
   with most members of a list, members meet the others only. Directly in lists
   of at most ``SMALL`` members; documents of longer lists are listed anew by
   the rarest shingles of their full sets, where two sets of the similarity
   must meet before a seventh of either is passed. That is exact as well, and
   leaves documents out that share a passage and little else.
4. Each pair is estimated on the bottom-``K`` of the union of its sketches; a
   pair of similarity 0.75 falls below the filter with a chance under 1e-7.
5. Exact Jaccard on full sets: texts are dealt by (centre, salt) and streamed
   in order, so a task holds one centre's set and one member at a time, and a
   hot centre is split. Sets hold 63-bit hashes of whole shingles.
6. Components by contraction: nodes hook to the first of their neighbours, edges
   are relabelled and deduplicated, until none is left. First is the smallest id
   in odd rounds, which ends a star at once, and a random order drawn anew in
   even ones, in which a path loses about half of its nodes whatever its ids, so
   rounds grow with the logarithm. The smallest id of each component is taken at
   the end.

Cases: null, empty and wordless texts have size 0 and stay alone; texts of
fewer than five words are one shingle; rows with one doc_id are one document;
a null doc_id counts as an id below all others and comes out as null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import checkpoint_stage
from .arrays import ASCII_SPACE, LOWER, buffers, shingle_hashes, slices, word_hashes

WORDS = 5
PERCENT = 75
K = 64
PROBE = 32
SHARE = 10
FILTER = 0.45
GROUP = 256
SMALL = 64
NO_ID = -(1 << 63)


def shingle_sets(column: pa.Array):
    """Yields (row, sorted distinct 63-bit shingle hashes) for each text."""
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        x = LOWER[data[offsets[a]:offsets[b]]]
        words, _, _, bounds = word_hashes(x, offsets[a:b + 1] - offsets[a], ~ASCII_SPACE)
        h, at = shingle_hashes(words, bounds, WORDS)
        h = (h >> np.uint64(1)).astype(np.int64)
        for r in range(b - a):
            yield a + r, np.unique(h[at[r]:at[r + 1]])


def sketches(docs: DataFrame) -> DataFrame:
    """(_id, n, digest, sketch): sketch is the ascending bottom-K of the set."""
    def sketch(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, digest, low = [], [], []
            for _, s in shingle_sets(batch.column("text")):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low.append(s[:K])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(low)))], names=["_id", "n", "digest", "sketch"])
    return (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "text")
            .mapInArrow(sketch, "_id long, n long, digest binary, sketch array<long>"))


def inverted_lists(reps: DataFrame) -> DataFrame:
    """(v, id, n, common): the lists of retained values, rarest values of each
    set first; common: mean log of the lists' lengths over the set's values."""
    posts = reps.select("id", "n", F.explode(F.slice("sketch", 1, PROBE)).alias("v"))
    shared = posts.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    taken = F.least(F.col("n"), F.lit(PROBE))
    need = F.least(F.lit(SHARE), F.ceil(F.col("n") * PERCENT / 100))
    # values of this set alone come first in the order, and open no list
    left = taken - need + 1 - (taken - F.size("_vs"))
    lists = (posts.join(shared, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("_vs"), F.sum(F.log("df")).alias("_l"))
             .withColumn("_left", left.cast("int")).where("_left > 0")
             .select("id", "n", F.round(F.col("_l") / taken, 6).alias("common"), F.explode(F.slice("_vs", F.lit(1), F.col("_left"))).alias("_x"))
             .select(F.col("_x.v").alias("v"), "id", "n", "common"))
    return checkpoint_stage(lists, "near_lists")


def exact_lists(texts: DataFrame) -> DataFrame:
    """(v, id, n, at): the lists of the rarest shingles of the full sets of
    (id, text); at: the shingle's place in the set, rarest first. Two sets with
    the similarity share one of the first n - ceil(0.75 n) + 1 of each."""
    def explode(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                for r, s in shingle_sets(batch.column("text")):
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), ids[r])), pa.array(np.full(len(s), len(s)))], names=["v", "id", "n"])

    sets = checkpoint_stage(texts.select("id", "text").mapInArrow(explode, "v long, id long, n long"), "near_sets")
    shared = sets.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    alone = F.col("n") - F.size("_vs")
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    return (sets.join(shared, "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("_vs"))
            .withColumn("_alone", alone).withColumn("_left", (first - F.col("_alone")).cast("int")).where("_left > 0")
            .select("id", "n", "_alone", F.posexplode(F.slice("_vs", F.lit(1), F.col("_left"))).alias("_p", "_x"))
            .select(F.col("_x.v").alias("v"), "id", "n", (F.col("_alone") + F.col("_p")).alias("at")))


def sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) that the bottom-K of the union of their sketches lets pass."""
    one = reps.select(F.col("id").alias("a"), F.col("sketch").alias("_s"))
    two = reps.select(F.col("id").alias("b"), F.col("sketch").alias("_t"))
    union = F.slice(F.sort_array(F.array_union("_s", "_t")), 1, K)
    common = F.size(F.array_intersect(F.array_intersect("_u", "_s"), F.col("_t")))
    return (pairs.join(one, "a").join(two, "b").withColumn("_u", union)
            .where(common >= F.lit(FILTER) * F.size("_u")).select("a", "b"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, n_common, n_union) whose full sets have the similarity."""
    pairs = checkpoint_stage(pairs, "near_pairs")
    hot = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("_salts"))
    dealt = pairs.join(hot, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_salts").alias("salt"))
    members = dealt.join(texts, dealt["b"] == texts["id"]).select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    centres = hot.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("salt"))
    centres = centres.join(texts, centres["a"] == texts["id"]).select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")

    def exact(batches):
        centre, whole = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            a, salt, kind, b = (batch.column(c).to_pylist() for c in ("a", "salt", "kind", "b"))
            for r, s in shingle_sets(batch.column("text")):
                key = (a[r], salt[r])
                if kind[r] == 0:
                    # a document of several rows has several sets
                    whole = [*whole, s] if centre == key else [s]
                    centre = key
                    continue
                for c in whole if centre == key else ():
                    common = int((c[np.minimum(np.searchsorted(c, s), len(c) - 1)] == s).sum()) if len(c) and len(s) else 0
                    union = len(c) + len(s) - common
                    if union and 100 * common >= PERCENT * union:
                        out.append((a[r], b[r], common, union))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n_common", "n_union"])

    rows = members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return checkpoint_stage(rows.mapInArrow(exact, "a long, b long, n_common long, n_union long"), "near_links")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable from each node of edges (a, b)."""
    edge = checkpoint_stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc_edges")
    root, n = None, 0
    while not edge.isEmpty():
        n += 1
        first = (lambda c: F.lit(0)) if n % 2 else (lambda c, n=n: F.xxhash64(F.lit(n), F.col(c)))
        order = lambda c, first=first: F.struct(first(c).alias("h"), F.col(c).alias("id"))
        both = edge.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edge.select(F.col("b").alias("id"), F.col("a").alias("to")))
        hook = checkpoint_stage(both.groupBy("id").agg(F.min(order("to")).alias("_first")).select("id", F.least(order("id"), F.col("_first"))["id"].alias("up")), "cc_hooks")
        up_a = hook.select(F.col("id").alias("a"), F.col("up").alias("_a"))
        up_b = hook.select(F.col("id").alias("b"), F.col("up").alias("_b"))
        moved = edge.join(up_a, "a").join(up_b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        edge = checkpoint_stage(moved.where("a < b").distinct(), "cc_edges")
        if root is None:
            root = hook.select("id", F.col("up").alias("root"))
        else:
            step = hook.select(F.col("id").alias("root"), "up")
            root = checkpoint_stage(root.join(step, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "cc_roots")
    if root is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    least = root.groupBy("root").agg(F.min("id").alias("_least"))
    return checkpoint_stage(root.join(least, "root").select("id", F.col("_least").alias("root")), "cc_least")


def mixed_lists(lists: DataFrame) -> DataFrame:
    """(v, main, size): the lists (v, id, label, ...) of two labels or more;
    main: the label of most members."""
    labels = lists.groupBy("v", "label").agg(F.count(F.lit(1)).alias("_k"))
    return (labels.groupBy("v").agg(F.max_by("label", F.struct("_k", "label")).alias("main"), F.sum("_k").alias("size"), F.count(F.lit(1)).alias("_labels"))
            .where("_labels > 1").drop("_labels"))


def cross_pairs(lists: DataFrame, mixed: DataFrame, more: Column) -> DataFrame:
    """Pairs (a, b) in the ``mixed`` of the lists (v, id, n, label, ...) whose
    labels differ and whose sizes fit; ``more``: a further condition on the
    sides x and y. Members of a list's main label meet the others only, so a
    list costs its size times the members outside that label."""
    x, y = lists.join(mixed.select("v", "main"), "v").where("label != main").alias("x"), lists.alias("y")
    once = (F.col("y.label") == F.col("x.main")) | (F.col("x.id") < F.col("y.id"))
    return (x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.label") != F.col("y.label")) & once
                   & sizes_fit(F.col("x.n"), F.col("y.n")) & more)
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())


def links(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links that connect every component of the representatives."""
    lists = inverted_lists(reps)
    ids = lists.select("id").distinct()
    reps = checkpoint_stage(reps.join(ids, "id", "left_semi").select("id", "sketch"), "near_cand")
    texts = checkpoint_stage(texts.join(ids, "id", "left_semi"), "near_texts")
    # round 1: members against the centre of each of their lists
    centre = lists.groupBy("v").agg(F.min(F.struct(-F.col("common"), "id", "n")).alias("_c")).select("v", F.col("_c.id").alias("a"), F.col("_c.n").alias("_n"))
    stars = checkpoint_stage(lists.join(centre, "v").where((F.col("id") != F.col("a")) & sizes_fit(F.col("n"), F.col("_n")))
                             .select("a", F.col("id").alias("b")).distinct(), "near_stars")
    first = verified(estimated(stars, reps), texts)
    label = components(first.select("a", "b")).withColumnRenamed("root", "label")
    # round 2: members of different components
    marked = checkpoint_stage(lists.join(label, "id", "left").select("v", "id", "n", F.coalesce("label", "id").alias("label")), "near_marked")
    mixed = checkpoint_stage(mixed_lists(marked), "near_mixed")
    hot = checkpoint_stage(marked.join(mixed.where(F.col("size") > SMALL).select("v"), "v", "left_semi").select("id", "label").distinct(), "near_hot")
    long_ = checkpoint_stage(exact_lists(texts.join(hot, "id", "left_semi")).join(hot, "id"), "near_exact_lists")
    # what two sets must share, and can still share from the place of their first common shingle on
    need = (F.col("x.n") + F.col("y.n")) * PERCENT / (100 + PERCENT)
    still = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need
    cross = (cross_pairs(marked, mixed.where(F.col("size") <= SMALL), F.lit(True))
             .unionByName(cross_pairs(long_, mixed_lists(long_), still)).distinct())
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return first.unionByName(verified(estimated(cross.join(done, ["a", "b"], "left_anti"), reps), texts))


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``."""
    base = checkpoint_stage(sketches(docs), "near_base")
    classes = checkpoint_stage(base.where("n > 0").groupBy("digest").agg(F.min("_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near_reps")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    # copies hang on their representative; rows that share an id join their classes
    copies = base.where("n > 0").select("_id", "digest").join(classes.select("digest", "id"), "digest").where("_id != id").select(F.col("id").alias("a"), F.col("_id").alias("b"))
    found = links(classes.drop("digest"), texts).select("a", "b")
    root = components(found)
    direct = base.where("n > 0").groupBy("_id").agg(F.count_distinct("digest").alias("_sets")).where("_sets > 1")
    if not direct.isEmpty():
        root = components(found.unionByName(copies))
    rows = base.select("_id", "n", "digest").join(classes.select("digest", "id"), "digest", "left")
    rows = rows.join(root, "id", "left").select("_id", "n", F.coalesce("root", "id", "_id").alias("root"))
    null_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(null_id("_id").alias("doc_id"), F.col("n").alias("n_shingles"), null_id("root").alias("component_id"), (F.col("_id") == F.col("root")).alias("kept"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component, columns unchanged.

    Each row is a document of its own here, whatever its doc_id: rows are
    numbered in a written stage, and the numbers are the ids of the search. Of
    a component the row with the least doc_id (null first) is kept, of equal
    ones that with the least text digest. Rows without words all stay."""
    numbered = checkpoint_stage(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")), "near_rows")
    found = near_dedup(numbered.select(F.col("_row").alias("doc_id"), "_doc.text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_root"))
    order = F.struct(F.col("_doc.doc_id").cast("long").alias("id"), F.sha2(F.col("_doc.text").cast("binary"), 256).alias("digest"), F.col("_row").alias("row"))
    kept = numbered.select("_row", order.alias("_order")).join(found, "_row").groupBy("_root").agg(F.min("_order").alias("_least"))
    return numbered.join(kept.select(F.col("_least.row").alias("_row")), "_row", "left_semi").select("_doc.*")

"""Suffix-array dedup: every byte covered by a ``LENGTH``-byte string that also
starts elsewhere in the corpus is removed. Strings never cross documents.

The suffix order is sparse, so that it can be built over a corpus:

1. Of each window of LENGTH bytes the position whose GRAM-byte hash is
   smallest is its anchor; equal windows have equal anchors at equal places.
   Windows with one anchor are consecutive, and their hull, the block, is
   digested. What leaves a task is one narrow row per anchor (a position in
   about 85); blocks that repeat within the slice are settled there.
2. Anchors whose hash occurs once are dropped. A block whose digest occurs
   twice is covered as a whole: copies of any number are settled by a partial
   aggregate. One block of each digest goes on, if its hash has others.
3. Blocks of one hash are dealt to a task (hot hashes to several), where their
   suffixes from the anchor on are sorted by mergesort. Two suffixes are
   compared through their longest common extension, found by binary search on
   prefix polynomial hashes; the common extensions of neighbours are then
   verified byte by byte. A window that reaches o bytes to the left of its
   anchor repeats if, in a run of the suffix order with common extensions of
   LENGTH - o bytes, another block has the same o bytes to the left (found by
   hash, verified by bytes). Tasks that share a hot hash also send the hash of
   each distinct window; Spark counts them over the tasks.
4. The spans are united for each document, cut out, and the rest digested.

A group in a task holds about ``CHUNK`` blocks of at most 2 * LENGTH bytes.

Cases: a null text is empty; texts shorter than LENGTH lose nothing; rows that
repeat a text lose all of it if it has LENGTH bytes; rows that share a doc_id
are documents of their own, told apart by their text; a null doc_id is kept as
an id; a cut can leave bytes that are no valid UTF-8, so what is kept is
binary; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import checkpoint_stage
from .arrays import buffers, mix, powers, prefix, span_hash

LENGTH = 200
GRAM = 32
CHUNK = 2048
PIECE = 1 << 20
NO_ID = -(1 << 63)
SPAN, ONCE, MORE = 0, 1, 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, k = x, 1
    while 2 * k <= width:
        out, k = np.minimum(out[:-k], out[k:]), 2 * k
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - k:width - k + n])


def pieces(offsets: np.ndarray, length: int):
    """(first row, last row + 1, from byte, to byte): rows together up to PIECE
    bytes; a longer text in pieces that overlap by length - 1."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1))
        lo, hi = int(offsets[at]), int(offsets[end])
        while True:
            yield at, end, lo, min(hi, lo + PIECE + length)
            if lo + PIECE + length >= hi:
                break
            lo += PIECE + 1
        at = end


def merge_spans(start: np.ndarray, end: np.ndarray, row: np.ndarray):
    """Unites spans of equal rows that overlap or touch; input sorted by (row, start)."""
    if not len(start):
        return start, end, row
    new = np.ones(len(start), bool)
    far = np.maximum.accumulate(end + row * (1 << 40)) - row * (1 << 40)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > far[:-1])
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(end, first), row[first]


def anchored(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(hash, anchor, first window, last window) of each run of windows with
    one anchor; ends: for each byte, the end of its row."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    pre = prefix(data)
    at = np.arange(len(data) - gram + 1)
    h = span_hash(pre, at, at + gram)
    # ordered by the high half of the hash, then from left to right
    low = np.uint64(0xFFFFFFFF)
    best = sliding_min((h & ~low) | at.astype(np.uint64), length - gram + 1)
    p = np.flatnonzero(np.arange(n) + length <= ends[:n])
    anchor = (best[p] & low).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return h[anchor[first]].view(np.int64), anchor[first], p[first], p[last] if len(p) else p


FOUND = "kind int, h long, block long, id long, row long, x long, y long"


def _found(cols) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])


def find_anchors(length: int = LENGTH, gram: int = GRAM):
    """Rows: ONCE or MORE (h, block digest, x anchor, y first-window and
    last-window distance), SPAN (x, y: bytes from, to)."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column("text"))
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            for a, b, lo, hi in pieces(offsets, length):
                x, off = data[lo:hi], np.clip(offsets[a:b + 1], lo, hi) - lo
                row = np.repeat(np.arange(b - a), np.diff(off))
                h, anchor, p0, p1 = anchored(x, off[1:][row], length, gram)
                if not len(h):
                    continue
                raw = x.tobytes()
                block = np.frombuffer(b"".join([hashlib.blake2b(raw[s:e], digest_size=8).digest() for s, e in zip(p0.tolist(), (p1 + length).tolist())]), np.int64)
                _, first, which, count = np.unique(block, return_index=True, return_inverse=True, return_counts=True)
                again = count[which] > 1
                # places in the text, not in the piece
                base = lo - offsets[a:b]
                r = row[p0]
                s, e, sr = merge_spans(p0[again], p1[again] + length, r[again])
                g = r[first]
                cols = [np.concatenate(z) for z in zip(
                    (np.where(count > 1, MORE, ONCE), h[first], block[first], ids[a:b][g], keys[a:b][g], anchor[first] + base[g],
                     (anchor[first] - p0[first]) * 256 + anchor[first] - p1[first]),
                    (np.full(len(s), SPAN), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), ids[a:b][sr], keys[a:b][sr], s + base[sr], e + base[sr]))]
                yield _found(cols)
    return run


class Suffixes:
    """Blocks with their anchors; the suffix of a block begins at its anchor."""

    def __init__(self, group: np.ndarray, blocks: list[bytes], anchor: np.ndarray):
        size = np.array([len(b) for b in blocks])
        self.group, self.data = group, np.frombuffer(b"".join(blocks), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        self.at, self.size = self.begin + anchor, size - anchor
        self.pre = prefix(self.data)
        self.inv = powers(len(self.pre))[1]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.pre[end] - self.pre[start]) * self.inv[start]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes i and j, by binary search."""
        a, b = self.at[i], self.at[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash(a, a + mid) == self.hash(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before j: by group, bytes, length, index."""
        n = self.extension(i, j)
        over = n >= np.minimum(self.size[i], self.size[j])
        last = len(self.data) - 1
        x, y = self.data[np.minimum(self.at[i] + n, last)], self.data[np.minimum(self.at[j] + n, last)]
        tie = np.where(self.size[i] != self.size[j], self.size[i] < self.size[j], i < j)
        return np.where(self.group[i] != self.group[j], self.group[i] < self.group[j], np.where(over, tie, x < y))

    def mergesort(self) -> np.ndarray:
        """Bottom-up mergesort; in each round every suffix finds its place in
        the run beside its own by binary search, all at once."""
        n = len(self.at)
        order, width = np.arange(n), 1
        place = np.arange(n)
        while width < n:
            run = place // width
            other = run ^ 1
            low, high = np.minimum(other * width, n), np.minimum((other + 1) * width, n)
            begin = low.copy()
            while (low < high).any():
                mid = np.minimum((low + high) // 2, n - 1)
                less = self.before(order[mid], order[place]) & (low < high)
                low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
            new = (run // 2) * 2 * width + (place - run * width) + (low - begin)
            moved = np.empty(n, np.int64)
            moved[new] = order
            order, width = moved, 2 * width
        return order

    def verified_extensions(self, order: np.ndarray, most: int) -> np.ndarray:
        """Common bytes of each suffix with the one before it in the order (0
        for the first of a group), counted on the bytes themselves."""
        i, j = order[1:], order[:-1]
        out = np.zeros(len(order), np.int64)
        size = np.minimum(np.minimum(self.size[i], self.size[j]), most)
        size[self.group[i] != self.group[j]] = 0
        open_, done = np.flatnonzero(size > 0), 0
        while len(open_):
            step = np.arange(done, done + 32)
            inside = step[None, :] < size[open_, None]
            last = len(self.data) - 1
            same = inside & (self.data[np.minimum(self.at[i[open_], None] + step, last)] == self.data[np.minimum(self.at[j[open_], None] + step, last)])
            n = np.where(same.all(1), 32, same.argmin(1))
            out[open_ + 1] += n
            open_, done = open_[n == 32], done + 32
        return out

    def same_left(self, i: np.ndarray, j: np.ndarray, o: int) -> np.ndarray:
        """Whether the o bytes to the left of the anchors are equal."""
        back = np.arange(1, o + 1)
        return (self.data[self.at[i, None] - back] == self.data[self.at[j, None] - back]).all(1)


def repeated_windows(s: Suffixes, first: np.ndarray, last: np.ndarray, length: int = LENGTH):
    """Yields (o, blocks, class) for each left reach o: the blocks that have
    that window, and numbers equal for equal windows."""
    order = s.mergesort()
    common = s.verified_extensions(order, length)
    for o in range(int(first.max(initial=-1)) + 1):
        here = order[(last[order] <= o) & (o <= first[order])]
        if not len(here):
            continue
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(common < length - o)
        left = s.hash(s.at[here] - o, s.at[here])
        _, head, which = np.unique(mix(run[here].astype(np.uint64)) ^ left, return_index=True, return_inverse=True)
        same = (run[here] == run[here[head[which]]]) & s.same_left(here, here[head[which]], o)
        # a collision of hashes stands alone: it never makes windows equal
        which = np.where(same, which, len(head) + np.arange(len(here)))
        yield o, here, which


WINDOW = "kind int, h long, block long, id long, row long, x long, y long"


def compare_blocks(length: int = LENGTH):
    """Rows: SPAN (id, row, x, y), and for windows of hot hashes ONCE or MORE
    (h, block: window hash, id, row, x, y; y is the left reach)."""
    def flush(rows):
        group = np.unique(np.array([(r["h"], r["salt"]) for r in rows]), axis=0, return_inverse=True)[1].reshape(-1)
        x = np.array([r["x"] for r in rows])
        first, last = (np.array([r["y"] for r in rows]) // 256, np.array([r["y"] for r in rows]) % 256)
        s = Suffixes(group, [r["bytes"] for r in rows], first)
        hot = np.array([r["hot"] for r in rows])
        ids, keys, h = (np.array([r[c] for r in rows], np.int64) for c in ("id", "row", "h"))
        settled = np.array([r["n"] > 1 for r in rows])
        hits, out = [], []
        for o, here, which in repeated_windows(s, first, last, length):
            count = np.bincount(which)[which]
            own = ~settled[here]
            hits.append((here[own & (count > 1)], o))
            wide = here[hot[here]]
            if len(wide):
                which, count = which[hot[here]], count[hot[here]]
                window = span_hash(s.pre, s.at[wide] - o, s.at[wide] - o + length).view(np.int64)
                _, one = np.unique(which, return_index=True)
                out.append((np.where((count[one] > 1) | settled[wide[one]], MORE, ONCE), h[wide[one]], window[one], ids[wide[one]], keys[wide[one]], x[wide[one]], np.full(len(one), o)))
        block = np.concatenate([b for b, _ in hits]) if hits else np.zeros(0, np.int64)
        reach = np.concatenate([np.full(len(b), o) for b, o in hits]) if hits else block
        start = x[block] - reach
        by = np.lexsort((start, block))
        a, b, k = merge_spans(start[by], start[by] + length, block[by])
        zero = np.zeros(len(a), np.int64)
        out.append((np.full(len(a), SPAN), zero, zero, ids[k], keys[k], a, b))
        return _found([np.concatenate(c) for c in zip(*out)])

    def run(batches):
        rows, key = [], None
        for batch in batches:
            for r in batch.to_pylist():
                # whole groups only; a group has about CHUNK rows at most
                if len(rows) >= CHUNK and (r["h"], r["salt"]) != key:
                    yield flush(rows)
                    rows = []
                key = (r["h"], r["salt"])
                rows.append(r)
        if rows:
            yield flush(rows)
    return run


def cut(batches):
    """Removes the spans of each row; digests what is left."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        out = []
        for text, own in zip(texts, spans):
            raw, at, kept, n, lost = (text or "").encode(), 0, hashlib.sha256(), 0, 0
            end = -1
            for s, e in sorted((x["x"], x["y"]) for x in own or ()):
                if s > end:
                    n += 1
                    kept.update(raw[at:s])
                    lost += e - s
                elif e > end:
                    lost += e - end
                end = max(end, e)
                at = end
            kept.update(raw[at:])
            out.append((len(raw), lost, n, kept.hexdigest()))
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                         names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, row, x, y): the repeated spans, bytes from x to y; they may overlap."""
    found = checkpoint_stage(rows.mapInArrow(find_anchors(length, gram), FOUND), "suffix_anchors")
    anchors = found.where(F.col("kind") != SPAN).withColumnRenamed("kind", "weight")
    per_hash = anchors.groupBy("h").agg(F.sum("weight").alias("_n"), F.min("block").alias("_b"), F.max("block").alias("_c")).where("_n > 1")
    cand = checkpoint_stage(anchors.join(per_hash.select("h", (F.col("_b") == F.col("_c")).alias("one")), "h"), "suffix_candidates")
    to_span = [F.col("x") - F.floor(F.col("y") / 256), F.col("x") - F.col("y") % 256 + length]
    as_span = lambda df: df.select("id", "row", to_span[0].cast("long").alias("x"), to_span[1].cast("long").alias("y"))
    blocks = checkpoint_stage(cand.where("NOT one").groupBy("h", "block").agg(F.sum("weight").alias("n"), F.min(F.struct("id", "row", "x", "y")).alias("_r")), "suffix_blocks")
    repeated = cand.where("NOT one").join(blocks.where("n > 1").select("h", "block"), ["h", "block"])
    salts = blocks.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("salts"))
    wanted = (blocks.join(salts, "h").select("h", "n", F.col("_r.id").alias("id"), F.col("_r.row").alias("row"), F.col("_r.x").alias("x"), F.col("_r.y").alias("y"),
                                             (F.col("salts") > 1).alias("hot"), F.pmod(F.xxhash64("block"), "salts").alias("salt")))
    # each block's bytes, from its first window to the end of its last
    # repeated rows (equal id and text) would give a block twice
    texts = rows.select(F.col("id").alias("_i"), F.col("row").alias("_k"), F.col("text"))
    bytes_ = F.substring(F.col("text").cast("binary"), (F.col("x") - F.floor(F.col("y") / 256) + 1).cast("int"),
                         (F.floor(F.col("y") / 256) - F.col("y") % 256 + length).cast("int"))
    dealt = (wanted.join(texts, (F.col("id") == F.col("_i")) & (F.col("row") == F.col("_k")))
             .select("h", "salt", "hot", "n", "id", "row", "x", "y", bytes_.alias("bytes"))
             .repartition("h", "salt").sortWithinPartitions("h", "salt"))
    compared = checkpoint_stage(dealt.mapInArrow(compare_blocks(length), WINDOW), "suffix_windows")
    hot = compared.where(F.col("kind") != SPAN)
    shared = hot.groupBy("h", "y", "block").agg(F.sum("kind").alias("_n"), F.count(F.lit(1)).alias("_tasks")).where("_n > 1 AND _tasks > 1")
    over = hot.join(shared.select("h", "y", "block"), ["h", "y", "block"]).select("id", "row", (F.col("x") - F.col("y")).alias("x"), (F.col("x") - F.col("y") + length).alias("y"))
    pick = lambda df: df.where(F.col("kind") == SPAN).select("id", "row", "x", "y")
    return pick(found).unionByName(as_span(cand.where("one"))).unionByName(as_span(repeated)).unionByName(pick(compared)).unionByName(over)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    lost = spans(rows, length, gram).groupBy("id", "row").agg(F.collect_list(F.struct("x", "y")).alias("spans"))
    out = rows.join(lost, ["id", "row"], "left").select("id", "text", "spans").mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

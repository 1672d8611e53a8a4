"""Benchmark decontamination: size-partitioned MinHash containment search.

An item leaks into a document that holds at least ``threshold`` of the item's
distinct five-word shingles. Items are short and documents long, so their
Jaccard similarity is tiny and banded signatures would miss most leaks.
Instead the items are partitioned by size (powers of two of their shingle
counts), and an item's sketch is its bottom-m hashes, m = n - ceil(threshold *
n) + 1 of its n shingles: a document that holds ceil(threshold * n) of them
holds one of any m, so no leak is missed. A partition keeps its largest
retained hash; document shingles above it are skipped without a lookup. Each
candidate pair is then verified by the words of the shingles themselves. Items
of one to four words have no such shingle: they leak into a document that holds
their words in a row, and are looked up among its windows of that many words.

Distinct item texts with words are taken in blocks of about ``block_shingles``
shingles (one text at least), copies once; each block is broadcast (that bound
is its size) and the documents are scanned once for it, without a shuffle. The
ids of equal items are joined to the leaks by the text's digest. Any number of
items takes the same path.

Words are runs of letters, marks and digits (Unicode classes L, M and N) in
lower case, so leaks that differ in case or punctuation are found, typographic
quotes, dashes and spaces included. In scripts written without spaces
(``SINGLE``) each letter with its marks is a word. Other code points, symbols
and format characters too, separate words; texts are not normalised.

Cases: null and empty texts hold nothing; an item without words matches
nothing; an item of fewer than five words is one shingle, its whole sequence;
equal items are reported each; repeated rows give repeated results; rows with
a null id are reported with it; very long texts are handled whole, in one
worker's memory; other columns are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import buffers, prefix, shingle_hashes, slices, span_hash

WORDS = 5
PERCENT = 75
BLOCK_SHINGLES = 500_000

# Code points of scripts written without spaces: Thai, Lao, Myanmar, Khmer,
# kana, bopomofo and Han.
SINGLE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
          (0x4E00, 0x9FFF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
# A word in text, for Java.
_RANGES = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in SINGLE)
WORD = rf"[\p{{L}}\p{{N}}&&[{_RANGES}]]\p{{M}}*|(?:[\p{{L}}\p{{N}}&&[^{_RANGES}]]|\p{{M}})+"

# Kinds of code points, found when first needed.
OTHER, RUN, ONE, MARK, UNKNOWN = range(5)
_KINDS: dict[str, np.ndarray] = {}


def kind(cp: int) -> int:
    group = unicodedata.category(chr(cp))[0]
    if group in "LN":
        return ONE if any(a <= cp <= b for a, b in SINGLE) else RUN
    return MARK if group == "M" else OTHER


def kinds(cp: np.ndarray) -> np.ndarray:
    table = _KINDS.setdefault("k", np.full(0x110000, UNKNOWN, np.int8))
    out = table[cp]
    if (out == UNKNOWN).any():
        for c in np.unique(cp[out == UNKNOWN]).tolist():
            table[c] = kind(c)
        out = table[cp]
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of the words of the rows, as ``WORD`` has them."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) == len(data):
        cp = data
    else:
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    k = kinds(cp)
    row = np.zeros(len(k) + 1, bool)
    row[np.searchsorted(at, offsets)] = True
    k[row[:-1] & (k == MARK)] = RUN
    # the kind of the last code point that is no mark
    base = k[np.maximum.accumulate(np.where(k == MARK, 0, np.arange(len(k))))]
    inside = k != OTHER
    begin = inside & (row[:-1] | (k == ONE))
    begin[1:] |= inside[1:] & (~inside[:-1] | ((k[1:] == RUN) & (base[:-1] == ONE)))
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begin[1:]
    return at[begin], np.append(at, len(data))[1:][last]


class Text:
    """The shingles of a slice of texts, with their words at hand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.start, self.end = word_spans(data, offsets)
        self.words = np.searchsorted(self.start, offsets)
        self.word_hash = span_hash(prefix(data), self.start, self.end)
        self.hash, self.bounds = self.windows(WORDS)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row bounds) of the rows' windows of n words."""
        return shingle_hashes(self.word_hash, self.words, n, short=False)

    def window(self, row: int, at: int, n: int = WORDS) -> tuple[bytes, ...]:
        """The row's n words from its word ``at`` on."""
        first = self.words[row] + at
        return tuple(self.data[self.start[w]:self.end[w]].tobytes() for w in range(first, first + n))


def lower_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pc.utf8_lower(column.cast(pa.large_string())))


def build_block(keys: list, texts: list, percent: int = PERCENT) -> dict:
    """Sketches by size partition with the items' own shingles, and the items
    of fewer words than a shingle by their number of words."""
    data, offsets = lower_buffers(pa.array(texts, pa.string()))
    text = Text(data, offsets)
    items, parts, short = [], {}, {}
    for k, key in enumerate(keys):
        size = int(text.words[k + 1] - text.words[k])
        if size < WORDS:
            if size:
                short.setdefault(size, {}).setdefault(text.window(k, 0, size), []).append((key, k))
            continue
        own = text.hash[text.bounds[k]:text.bounds[k + 1]]
        hashes, first = np.unique(own, return_index=True)
        n = len(hashes)
        words = {int(h): text.window(k, f) for h, f in zip(hashes, first)}
        need = -(-percent * n // 100)
        parts.setdefault(n.bit_length(), []).append((hashes[:n - need + 1], len(items)))
        items.append((key, n, need, hashes, words))
    # (hash, words, items) by number of words
    for size, own in short.items():
        hashes, bounds = text.windows(size)
        short[size] = sorted((int(hashes[bounds[found[0][1]]]), words, [key for key, _ in found]) for words, found in own.items())
    partitions = []
    for sketches in parts.values():
        values = np.concatenate([s for s, _ in sketches])
        owner = np.concatenate([np.full(len(s), i) for s, i in sketches])
        order = np.argsort(values, kind="stable")
        partitions.append((values[order], owner[order]))
    return {"items": items, "partitions": partitions, "short": short}


def find_short(block: dict, text: Text):
    """Yields (row, item, 1, 1, inside) for the items of fewer words than a shingle."""
    for n, held in block["short"].items():
        values = np.array([h for h, _, _ in held], np.uint64)
        hashes, bounds = text.windows(n)
        left = np.searchsorted(values, hashes, "left")
        at = np.flatnonzero(values[np.minimum(left, len(values) - 1)] == hashes)
        row = np.searchsorted(bounds, at, "right") - 1
        # one occurrence of each row and hash, further ones only to settle a collision
        order = np.lexsort((at, left[at], row))
        at, row = at[order], row[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (left[at[1:]] != left[at[:-1]]))) if len(at) else at
        for x, y in zip(first, np.append(first[1:], len(at))):
            r = int(row[x])
            k = int(left[at[x]])
            while k < len(held) and held[k][0] == int(values[left[at[x]]]):
                if any(text.window(r, p - bounds[r], n) == held[k][1] for p in at[x:y]):
                    yield from ((r, key, 1, 1, bool(text.words[r + 1] - text.words[r] > n)) for key in held[k][2])
                k += 1


def find(block: dict, column: pa.Array):
    """Yields (row, item, size, shared, inside) for the leaks in a column of
    texts; inside: an item of fewer words than a shingle in a longer text."""
    data, offsets = lower_buffers(column)
    for a, b in slices(offsets):
        text = Text(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        row_of = np.repeat(np.arange(b - a), np.diff(text.bounds))
        pairs = set()
        for values, owner in block["partitions"]:
            low = np.flatnonzero(text.hash <= values[-1])
            left = np.searchsorted(values, text.hash[low], "left")
            right = np.searchsorted(values, text.hash[low], "right")
            for at, x, y in zip(low[right > left], left[right > left], right[right > left]):
                pairs.update((int(row_of[at]), int(owner[i])) for i in range(x, y))
        for row, i in sorted(pairs):
            key, n, need, hashes, words = block["items"][i]
            own = text.hash[text.bounds[row]:text.bounds[row + 1]]
            hits = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, own), n - 1)] == own)
            shared = {int(own[p]) for p in hits if text.window(row, p) == words[int(own[p])]}
            if len(shared) >= need:
                yield a + row, key, n, len(shared), False
        for row, *found in find_short(block, text):
            yield a + row, *found


SCHEMA = "doc_id long, _item binary, n_item_shingles long, n_shared long"


def item_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def item_blocks(items: DataFrame, percent: int, block_shingles: int):
    """Yields the broadcast blocks of the distinct item texts, one at least."""
    spark = items.sparkSession
    # an item has at most as many shingles as words, or one
    texts = items.select("text").where("text IS NOT NULL").distinct().withColumn("n", F.regexp_count("text", F.lit(WORD))).where("n > 0")
    total = texts.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-total // block_shingles))
    for k in range(n_blocks):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k).select(item_key().alias("key"), "text").orderBy("key").collect()
        yield spark.sparkContext.broadcast(build_block([bytes(r["key"]) for r in rows], [r["text"] for r in rows], percent))


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment), a row per
    document row and item that leaks into it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in item_blocks(items, percent, block_shingles):
        def search(batches, shared=shared):
            for batch in batches:
                if batch.num_rows:
                    got = list(find(shared.value, batch.column("text")))
                    doc_ids = batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array([g[c] for g in got], t) for c, t in ((1, pa.binary()), (2, pa.int64()), (3, pa.int64())))],
                                                     names=["doc_id", "_item", "n_item_shingles", "n_shared"])

        found = texts.mapInArrow(search, SCHEMA)
        out = found if out is None else out.unionByName(found)
    ids = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), item_key().alias("_item"))
    return (out.join(ids, "_item").select("doc_id", "item_id", "n_item_shingles", "n_shared")
            .withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` into whose own text no item leaks, whatever their
    ids: a filter within the scan, without a shuffle. An item of fewer words
    than a shingle drops only texts of just these words: a longer text that
    holds them is reported by ``leaks`` and stays here, as a few words that
    stand in many clean texts make none of them a leak."""
    for shared in item_blocks(items, percent, block_shingles):
        def clean(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                if batch.num_rows:
                    keep[[g[0] for g in find(shared.value, batch.column("text")) if not g[4]]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents into which no item leaks, row by row."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

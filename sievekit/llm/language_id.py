"""Language ID by hyperdimensional profiles: random letter vectors, permuted
by their place, are bound (multiplied) into n-gram vectors; a text's n-gram
vectors are bundled (added); a text gets the language whose prototype, the
bundle of its training texts, has the highest cosine with it.

A letter's vector of +1 and -1 is drawn from a generator seeded by its code
point, so every task builds equal vectors and none are sent. Training adds
integers, so its result does not depend on the order of rows or tasks; what a
task sends is one vector per language.

Cases: a null text or one without a letter is ``und`` with score 0; without
training rows every text is ``und``; ties go to the first language by code
point; repeated rows count as often as they stand; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import buffers, slices
from .quality_pairs import held_out

DIM = 1024
GRAM = 3
SEED = 23
SLICE = 1 << 18
UNKNOWN = "und"
#: Cells of a slice's counts, and n-gram vectors that are spread out at once.
CELLS = 1 << 22
SPREAD = 4096


class Memory:
    """Letter and n-gram vectors, made when first needed."""

    LIMIT = 60_000

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED):
        self.dim, self.gram, self.seed = dim, gram, seed
        self.letters: dict[int, np.ndarray] = {}
        self.alpha = np.zeros(0, bool)
        self.clear()

    def clear(self):
        self.place: dict[int, int] = {}
        self.table = np.zeros((256, self.dim), np.int8)

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            bits = np.random.default_rng([self.seed, cp]).integers(0, 2, self.dim)
            self.letters[cp] = (2 * bits - 1).astype(np.int8)
        return self.letters[cp]

    def is_letter(self, cp: np.ndarray) -> np.ndarray:
        if not len(self.alpha):
            self.alpha = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        return self.alpha[cp]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """A row for each code: the letters' vectors rolled by their place, multiplied."""
        codes = grams.tolist()
        if len(self.place) + len(codes) > self.LIMIT:
            self.clear()
        for code in codes:
            if code not in self.place:
                v = np.ones(self.dim, np.int8)
                for k in range(self.gram):
                    v = v * np.roll(self.letter((code >> (21 * k)) & 0x1FFFFF), k)
                at = self.place[code] = len(self.place)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[at] = v
        return self.table[[self.place[c] for c in codes]]

    def counts(self, column: pa.Array):
        """Yields (first row, row count, codes, dense counts) by slices; the
        grams of a text are those of its letters in lower case, with one
        separator (0) for each run of other characters."""
        data, offsets = buffers(pc.utf8_lower(column.cast(pa.large_string())))
        for a, b in slices(offsets, SLICE):
            raw = data[offsets[a]:offsets[b]]
            cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
            # code points begin at bytes that are not continuation bytes
            at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets[a:b + 1] - offsets[a]]
            row = np.repeat(np.arange(b - a), np.diff(at))
            letter = self.is_letter(cp)
            cp = np.where(letter, cp, 0)
            keep = np.ones(len(cp), bool)
            keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
            cp, row = cp[keep], row[keep]
            m = max(0, len(cp) - self.gram + 1)
            code = np.zeros(m, np.int64)
            for k in range(self.gram):
                code |= cp[k:k + m] << (21 * k)
            inside = (row[:m] == row[self.gram - 1:self.gram - 1 + m]) & (code != 0)
            has = np.bincount(row[cp != 0], minlength=b - a) > 0
            of, code = row[:m][inside], code[inside]
            for lo, hi, codes, which, rows in self.within(of, code, 0, b - a):
                dense = np.bincount((rows - lo) * len(codes) + which, minlength=(hi - lo) * len(codes)).reshape(hi - lo, len(codes)) if len(codes) else np.zeros((hi - lo, 0), np.int64)
                yield a + lo, a + hi, codes, dense, has[lo:hi]

    def within(self, of: np.ndarray, code: np.ndarray, lo: int, hi: int):
        """Row ranges whose rows x distinct codes stay within ``CELLS``: many short
        texts of a large script have few codes in common. ``of`` is sorted."""
        i, j = np.searchsorted(of, (lo, hi))
        codes, which = np.unique(code[i:j], return_inverse=True)
        if (hi - lo) * len(codes) > CELLS and hi - lo > 1:
            mid = (lo + hi) // 2
            yield from self.within(of, code, lo, mid)
            yield from self.within(of, code, mid, hi)
        else:
            yield lo, hi, codes, which, of[i:j]

    def bundled(self, dense: np.ndarray, codes: np.ndarray, dtype=np.float32) -> np.ndarray:
        """dense @ vectors, with ``SPREAD`` vectors at a time in floats."""
        out = np.zeros((len(dense), self.dim), dtype)
        for c in range(0, len(codes), SPREAD):
            out += dense[:, c:c + SPREAD].astype(dtype) @ self.vectors(codes[c:c + SPREAD]).astype(dtype)
        return out


def worker_memory(dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> Memory:
    """The memory of this Python worker, kept over its tasks (functions are
    pickled by value, so a global of this module would not last)."""
    kept, key = sys.__dict__.setdefault("_sievekit_memories", {}), (dim, gram, seed)
    if key not in kept:
        kept.clear()
        kept[key] = Memory(dim, gram, seed)
    return kept[key]


def train(docs: DataFrame, dim: int = DIM, gram: int = GRAM) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from the rows of (text, lang)."""
    def bundle(batches):
        memory, total = worker_memory(dim, gram), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = np.array(batch.column("lang").to_pylist())
            for a, b, codes, dense, _ in memory.counts(batch.column("text")):
                names, which = np.unique(langs[a:b], return_inverse=True)
                by = np.zeros((len(names), len(codes)))
                np.add.at(by, which, dense)
                # whole numbers far below 2^53: exact
                sums = memory.bundled(by, codes, np.float64)
                for name, v in zip(names, sums):
                    total[str(name)] = total.get(str(name), 0) + v
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(range(dim), pa.int32()), pa.array(v.astype(np.int64))], names=["lang", "i", "v"])

    rows = docs.where("lang IS NOT NULL").select("text", "lang").mapInArrow(bundle, "lang string, i int, v long")
    # one row of dim numbers per language
    got = rows.groupBy("lang", "i").agg(F.sum(F.col("v").cast("double")).alias("v")).toPandas()
    langs = sorted(set(got["lang"]))
    out = np.zeros((len(langs), dim))
    out[[langs.index(x) for x in got["lang"]], got["i"]] = got["v"]
    return langs, out


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, gram: int = GRAM) -> DataFrame:
    """(doc_id, lang_pred, score): the score is the cosine, 0 if negative."""
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(norm > 0, norm, 1)).astype(np.float32)
    dim = prototypes.shape[1]

    def classify(batches):
        memory = worker_memory(dim, gram)
        for batch in batches:
            if not batch.num_rows:
                continue
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for a, b, codes, dense, has in memory.counts(batch.column("text")):
                v = memory.bundled(dense, codes)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                cos = (v / np.where(size > 0, size, 1)) @ unit.T
                if len(langs):
                    best = cos.argmax(1)
                    pred[a:b] = np.where(has, np.array(langs, object)[best], UNKNOWN)
                    score[a:b] = np.where(has, np.clip(cos[np.arange(b - a), best], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(classify, "doc_id long, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs, *train(docs.where(~held_out(4, 2))))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")

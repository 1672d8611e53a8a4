"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Folding. Text and lexicon are folded alike: compatibility forms (full width,
mathematical letters) and case, letters of other scripts that look like Latin
ones, invisible characters out, digits and symbols that stand for letters
inside a word (``1d10t``), ``l`` and ``i`` as one letter since ``1``, ``|`` and ``!``
stand for both, and single letters set apart (``i d i o t``) joined. What is left
is words with one space between.

Lexicon. Labelled training texts (copies once) give, for each word, the number of
toxic and of clean texts with it; word beginnings of 3 to 12 letters add up their
words. A beginning's weight is the log ratio of its rates less twice its standard
error; those of at least ``LEAST`` enter, unless nearly all of their words share a
longer beginning. The lexicon is at most ``max_entries`` long, so it is broadcast.

Exception phrases: a lexicon word with the word before or after it, if the two
occur together in clean texts and hardly in toxic ones. A match inside such a
phrase does not count.

Score. All beginnings and phrases form one automaton; a text is folded and read
once. The weights of its words are summed and normalised by the length in words;
a logistic function of the normalised sum, the logarithm of the sum and the
largest weight, fitted on training texts that the lexicon was not learned from,
gives the score.

The labels learned from are at most ``max_labelled`` (by a hash of the id, so a
larger table gives a sample of that size); documents of these ids are written
once. Every document is scored, whole, in one pass without a shuffle.

Cases: null, empty and wordless texts have no match and the score of that; a
label that is null is not learned from; a doc_id with several labels is toxic if
one of them is, with several texts the least text is learned from; without
training rows, or with one class alone, all scores are the smoothed share of
toxic labels; very long texts are read whole; rows that repeat are scored each; a
null doc_id is scored and counts as held_out null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import checkpoint_stage

MAX_LABELLED = 50_000
MAX_ENTRIES = 50_000
LEAST = 2.0
SHORTEST, LONGEST = 3, 12
THRESHOLD = 0.7

# Letters that look like a Latin letter.
LOOKALIKES = {
    "a": "аαɑ", "b": "вƅ", "c": "сϲ", "d": "ԁ", "e": "еєεҽ", "g": "ɡց", "h": "һнհ", "i": "іιıӏɩ", "j": "јϳ", "k": "кκ",
    "l": "ℓ", "m": "м", "n": "пηո", "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υսμ", "v": "νѵ",
    "w": "ԝωш", "x": "хχ", "y": "уγү", "z": "ᴢ"}
# Digits and symbols that stand for a letter inside a word.
STAND_INS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}
INVISIBLE = [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]

LETTERS = {ord(x): latin for latin, like in LOOKALIKES.items() for x in like} | {c: None for c in INVISIBLE}
STANDING = re.compile(r"[0-9@$!|+€]+")
WORDS = re.compile(r"[^\W\d_]+")
APART = re.compile(r" (?:[^\W\d_] ){3,}")


def _letters(m: re.Match) -> str:
    """A run of stand-ins before a letter, at a word's beginning or after a
    letter, is letters; so are one or two digits at the end of a word."""
    run, t, a, b = m.group(), m.string, m.start(), m.end()
    after_letter = a > 0 and t[a - 1].isalpha()
    if b < len(t) and t[b].isalpha():
        inside = after_letter or a == 0 or t[a - 1].isspace()
    else:
        inside = after_letter and len(run) <= 2 and run.isdigit() and (b == len(t) or t[b] != "_")
    return "".join(STAND_INS[c] for c in run) if inside else run


def fold(text: str | None) -> str:
    """The folded words, a space before and after each."""
    t = unicodedata.normalize("NFKC", text or "").lower()
    try:  # Latin-1 texts hold none of the lookalikes
        t.encode("latin-1")
        t = t.replace("\xad", "")
    except UnicodeEncodeError:
        t = t.translate(LETTERS)
    t = " " + " ".join(WORDS.findall(STANDING.sub(_letters, t))) + " "
    return APART.sub(lambda m: " " + m.group().replace(" ", "") + " ", t).replace("l", "i")


class Matcher:
    """Lexicon beginnings and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], phrases):
        import ahocorasick
        self.size = 0
        self.automaton = ahocorasick.Automaton()
        for entry, w in weights.items():
            self.automaton.add_word(" " + entry, (w, len(entry) + 1))
        for p in phrases:
            self.automaton.add_word(f" {p} ", (None, len(p) + 2))
        self.size = len(self.automaton)
        if self.size:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place, weight) of the words that match: the largest weight of each
        word, words within exception phrases left out."""
        if not self.size:
            return []
        best, safe = {}, []
        for end, (w, n) in self.automaton.iter(folded):
            start = end - n + 1
            if w is None:
                safe.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        # a phrase's last space begins the next word, which is not part of it
        return [(s, w) for s, w in sorted(best.items()) if not any(a <= s < b for a, b in safe)]

    def features(self, text: str | None) -> tuple[float, float, float, int]:
        """(sum of weights per 100 words, log of the sum, largest weight, number of hits)."""
        folded = fold(text)
        found = self.hits(folded)
        total = sum(w for _, w in found)
        words = folded.count(" ") - 1
        return 100 * total / (max(words, 0) + 20), math.log1p(total), max((w for _, w in found), default=0.0), len(found)


def counted(rows: DataFrame, make, name: str) -> DataFrame:
    """(name, toxic, clean): texts with each key of ``make()(text)``; a task
    makes its function once, and adds counts up before they leave it."""
    def count(batches):
        have, keys_of = (Counter(), Counter()), make()

        def out():
            keys = list(have[0].keys() | have[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([have[1][k] for k in keys], pa.int64()), pa.array([have[0][k] for k in keys], pa.int64())], names=[name, "toxic", "clean"])
            have[0].clear()
            have[1].clear()
            return batch

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                have[toxic].update(set(keys_of(text.as_py())))
                if len(have[0]) + len(have[1]) > 200_000:
                    yield out()
        yield out()

    return rows.select("text", "toxic").mapInArrow(count, f"{name} string, toxic long, clean long").groupBy(name).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def sure_ratio(a, b, all_a: float, all_b: float):
    """Log ratio of the rates of a and b less twice its standard error."""
    a, b = a + F.lit(0.5), b + F.lit(0.5)
    return F.log(a / b) - F.lit(math.log((all_a + 0.5) / (all_b + 0.5))) - 2 * F.sqrt(1 / a + 1 / b)


def lexicon(rows: DataFrame, max_entries: int = MAX_ENTRIES) -> dict[str, float]:
    """beginning -> weight, from rows (text, toxic); at most ``max_entries``."""
    words = checkpoint_stage(counted(rows, lambda: lambda t: fold(t).split(), "word"), "tox_words")
    total = words.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not total["t"] or not total["c"]:
        return {}
    begin = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    stems = (words.where(F.length("word") >= SHORTEST).select(F.explode(begin).alias("stem"), "toxic", "clean")
             .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3")
             .withColumn("w", sure_ratio(F.col("toxic"), F.col("clean"), total["t"], total["c"])).where(F.col("w") >= LEAST))
    stems = checkpoint_stage(stems, "tox_stems")
    longer = stems.groupBy(F.expr("substring(stem, 1, length(stem) - 1)").alias("stem")).agg(F.max("toxic").alias("_longer"))
    own = (stems.join(longer, "stem", "left").where(F.coalesce("_longer", F.lit(0)) < 0.9 * F.col("toxic"))
           .orderBy(F.desc("w"), "stem").limit(max_entries).select("stem", "w"))
    return {r.stem: r.w for r in own.toLocalIterator()}


def exceptions(rows: DataFrame, weights: dict[str, float], max_entries: int = MAX_ENTRIES) -> list[str]:
    """Phrases of two words around a lexicon word that speak for a clean text."""
    if not weights:
        return []

    def make():
        matcher = Matcher(weights, ())

        def around(text):
            folded = fold(text)
            for start, _ in matcher.hits(folded):
                end = folded.index(" ", start + 1)
                word = folded[start + 1:end]
                if start:
                    yield f"{folded[folded.rfind(' ', 0, start) + 1:start]} {word}"
                if end + 1 < len(folded):
                    yield f"{word} {folded[end + 1:folded.index(' ', end + 1)]}"

        return around

    pairs = counted(rows, make, "phrase")
    clean = pairs.where("clean >= 2").withColumn("w", sure_ratio(F.col("clean"), F.col("toxic"), 1, 1)).where("w > 0")
    return [r.phrase for r in clean.orderBy(F.desc("w"), "phrase").limit(max_entries).select("phrase").toLocalIterator()]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton fit of weights and bias (last), the ridge on the weights only."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


FEATURES = "density double, log_total double, largest double, n_hits int"


def measured(docs: DataFrame, weights, phrases, keep: list[str], schema: str) -> DataFrame:
    """``keep`` columns and the features of every text."""
    def measure(batches):
        m = Matcher(weights, phrases)
        for batch in batches:
            if batch.num_rows:
                found = list(zip(*(m.features(t.as_py()) for t in batch.column("text"))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(f, pa.float64()) for f in found[:3]), pa.array(found[3], pa.int32())],
                                                 names=[*keep, "density", "log_total", "largest", "n_hits"])

    return docs.select(*keep, "text").mapInArrow(measure, f"{schema}, {FEATURES}")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def training_texts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic, part) of labelled texts, copies once; ``part`` 0 to 3 by text."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(3) != 1)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # bounded: broadcast
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    once = own.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    return checkpoint_stage(once.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4)).cast("int")), "tox_train")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_entries: int = MAX_ENTRIES) -> dict:
    """The model: lexicon, exception phrases, weights of the features."""
    rows = training_texts(docs, labels, max_labelled)
    shares = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = shares["n"], shares["t"] or 0
    flat = np.array([0.0, 0.0, 0.0, math.log((t + 0.5) / (n - t + 0.5))])
    if not t or t == n:
        return {"weights": {}, "phrases": [], "w": flat}
    learn, fit = rows.where("part > 0"), rows.where("part = 0")
    weights = lexicon(learn, max_entries)
    phrases = exceptions(learn, weights, max_entries)
    # at most max_labelled rows of four numbers
    x = measured(fit, weights, phrases, ["toxic"], "toxic int").toPandas()
    if x["toxic"].nunique() < 2:
        return {"weights": weights, "phrases": phrases, "w": flat}
    return {"weights": weights, "phrases": phrases, "w": logistic(x[["density", "log_total", "largest"]].to_numpy(), x["toxic"].to_numpy())}


def toxicity(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, n_hits) of every row."""
    d, t, m, b = (float(v) for v in model["w"])
    z = F.lit(b) + F.lit(d) * F.col("density") + F.lit(t) * F.col("log_total") + F.lit(m) * F.col("largest")
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model["weights"], model["phrases"], ["doc_id"], "doc_id long")
    return (rows.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
            .select("doc_id", "score", "predicted", "n_hits"))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted", "n_hits")

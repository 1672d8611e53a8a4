"""Quality classifier: Bradley-Terry ranking. Scores are linear in features
of the text; the weights are learned from preference pairs (a document marked
1 over one marked 0) by logistic loss on feature differences; a quantile of
the training scores is the threshold.

The fit uses at most ``max_labelled`` labelled rows, those with the smallest
hash of doc_id (a seeded sample; the bound is a parameter), and reads whole
texts. Scoring is one pass without a shuffle; only the weights travel.

Cases: null and empty texts have zero features and get a score; labels other
than 0 and 1 and null ids are not learned from; repeated rows count as often
as they stand; without a label of either kind every score is 0.5; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ASCII_SPACE, LOWER, buffers, runs, shingle_hashes, slices, word_hashes
from .quality_rules import STOP_WORDS

MAX_LABELLED = 20_000
THRESHOLD = 0.3
PAIRS = 100_000

# Classes of bytes whose shares are features; "other" is any non-ASCII byte.
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (0x20, 9, 11, 12, 13),
           "newline": (10,), "bang": b"!", "bar": b"|", "mark": b"#*$%&<>", "stop": b".,", "pair": b"()[]{}\"'", "link": b"@/:_-=+~^",
           "other": range(128, 256)}
FEATURES = ("log_words", "log_bytes", *CLASSES, *(f"sqrt_{c}" for c in CLASSES), "mean_word", "distinct_words", "distinct_threes",
            "distinct_lines", "stop_words", "max_word", "log_lines")


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct hashes of each row."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(bounds) - 1)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text."""
    data, offsets = buffers(column)
    word = ~ASCII_SPACE
    line = np.ones(256, bool)
    line[10] = False
    stops = word_hashes(*buffers(pa.array(STOP_WORDS)), word)[0]
    out = np.zeros((len(column), len(FEATURES)))
    for a, b in slices(offsets):
        x, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        size = np.maximum(np.diff(off), 1).astype(float)
        h, start, end, bounds = word_hashes(LOWER[x], off, word)
        n = np.diff(bounds)
        per = np.maximum(n, 1).astype(float)
        cols = [np.log1p(n), np.log1p(np.diff(off))]
        shares = []
        for members in CLASSES.values():
            flag = np.zeros(256, bool)
            flag[list(members)] = True
            total = np.concatenate([[0], np.cumsum(flag[x])])
            shares.append((total[off[1:]] - total[off[:-1]]) / size)
        cols += shares + [np.sqrt(s) for s in shares]
        length = np.concatenate([[0], np.cumsum(end - start)])
        longest = np.zeros(b - a)
        np.maximum.at(longest, np.repeat(np.arange(b - a), n), end - start)
        threes, three_bounds = shingle_hashes(h, bounds, 3, short=False)
        lines, _, _, line_bounds = word_hashes(x, off, line)
        hits = np.concatenate([[0], np.cumsum(np.isin(h, stops))])
        cols += [(length[bounds[1:]] - length[bounds[:-1]]) / per, _distinct(h, bounds) / per,
                 _distinct(threes, three_bounds) / np.maximum(np.diff(three_bounds), 1),
                 _distinct(lines, line_bounds) / np.maximum(np.diff(line_bounds), 1),
                 (hits[bounds[1:]] - hits[bounds[:-1]]) / per, np.log1p(longest), np.log1p(np.diff(line_bounds))]
        out[a:b] = np.column_stack(cols)
    return out


class BradleyTerry:
    """score = logit(threshold) + w . (x - mean) / scale - cut, through the logistic function."""

    def __init__(self, mean, scale, weights, cut, threshold=THRESHOLD):
        self.mean, self.scale, self.weights, self.cut, self.threshold = mean, scale, weights, cut, threshold

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        z = np.log(self.threshold / (1 - self.threshold)) + self.strength(x) - self.cut
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 25, seed: int = 5) -> BradleyTerry:
    """Newton steps on mean(log(1 + exp(-w.(x_win - x_lose)))) + ridge |w|^2 / 2;
    the cut is the quantile of the training scores that separates best
    (balanced between the labels)."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(0, 1, None, 0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance that the pair is ranked wrongly
        grad = ridge * w - d.T @ p / pairs
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    bad_below = np.concatenate([[0], np.cumsum(label[order] == 0)]) / len(bad)
    good_below = np.concatenate([[0], np.cumsum(label[order] == 1)]) / len(good)
    best = int(np.argmax(bad_below - good_below))
    ranked = np.concatenate([[s[order[0]] - 1], s[order], [s[order[-1]] + 1]])
    return BradleyTerry(mean, scale, w, (ranked[best] + ranked[best + 1]) / 2)


def _features_of(batches):
    for batch in batches:
        if batch.num_rows:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> BradleyTerry:
    """Fits on labelled rows (columns doc_id, label) of ``docs``: at most
    ``max_labelled`` labels, and as many rows where documents share an id."""
    marked = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    sample = marked.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "label").limit(max_labelled)
    # at most max_labelled rows of two numbers: broadcast by that bound
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    # an id may stand for any number of documents, so the rows are bounded once more, in an order of their own
    measured = rows.mapInArrow(_features_of, "label int, x binary")
    got = measured.orderBy(F.xxhash64(F.lit(11), "x"), "x", "label").limit(max_labelled).toPandas()
    got = got.sort_values(["label", "x"])  # the same fit whatever order the rows come in
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["label"].to_numpy())


def score_documents(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """(doc_id, score)."""
    def score(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features(batch.column("text"))))], names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def op3_quality_pairs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0)).select("doc_id", F.col("quality").alias("label"))
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

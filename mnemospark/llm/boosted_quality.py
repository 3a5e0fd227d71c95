"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document becomes a row of statistics (``FEATURES``), computed over its
whole text. Trees of a fixed depth are grown level by level on histograms of
at most ``BINS`` quantile bins, and stored flattened: three arrays of shape
(trees, nodes). Scoring walks all trees of a batch of documents at once.

Training takes a bounded sample: the ``sample_rows`` labelled rows with the
smallest hash of their id (default ``SAMPLE_ROWS``). Everything else, scoring
included, covers all documents.

Edge cases: null or empty texts get the statistics of a text without words
and so a score; rows without labels, or with null labels, train nothing; if a
doc_id has several labels the largest counts, if several texts the least statistics;
with no labelled row at all every
score is 0.5; repeated rows are scored alike; other columns are ignored or,
in ``keep_good``, passed on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import BLANKS, CONTINUATION, map_batches, utf8

SAMPLE_ROWS = 20_000
BINS = 64

FEATURES = (
    "log_chars", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "same_neighbour",
    "upper", "symbols", "pipes", "exclamations", "stops", "commas", "digits", "other_punctuation", "non_ascii",
    "log_lines", "duplicate_lines", "words_per_line", "short_words", "long_words",
)
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&<>"
OTHER = b"\"'()+-/:;=?@[\\]^_`{}~"


def statistics(text: bytes) -> list[float]:
    """The features of one text."""
    words = text.split()
    n = len(words)
    solid = len(text.translate(None, BLANKS))
    chars = max(solid, 1)
    share = lambda drop: (len(text) - len(text.translate(None, drop))) / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = list(map(len, words))
    some = max(n, 1)
    return [
        math.log1p(len(text)),
        math.log1p(n),
        solid / some,
        max(lengths, default=0),
        len(counts) / some,
        max(counts.values(), default=0) / some,
        sum(map(eq, words, words[1:])) / some,
        share(UPPER),
        share(SYMBOLS),
        share(b"|"),
        share(b"!"),
        share(b"."),
        share(b","),
        share(DIGITS),
        share(OTHER),
        share(CONTINUATION),
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        sum(x <= 3 for x in lengths) / some,
        sum(x >= 12 for x in lengths) / some,
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass(frozen=True)
class Forest:
    """Flattened trees. Node k of a tree has children 2k+1 and 2k+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        leaf = at - (2**self.depth - 1)
        raw = self.base + self.value[trees, leaf].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Forest:
    """Boost the logistic loss on histograms."""
    inner = 2**depth - 1
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, 2**depth))
    if not len(y):
        return Forest(feature[:0], threshold[:0], value[:0], depth, 0.0)
    rate_of_ones = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = (node - first) * BINS
            best = np.zeros(width)
            pick, cut = np.zeros(width, np.int64), np.full(width, BINS)
            for j in range(x.shape[1]):
                g = np.bincount(slot + binned[j], grad, width * BINS).reshape(width, BINS)
                h = np.bincount(slot + binned[j], hess, width * BINS).reshape(width, BINS)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1e-2) | (hr < 1e-2)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-9
                best[better], pick[better], cut[better] = top[better], j, at[better]
            for k in np.flatnonzero(best > 0):
                feature[t, first + k] = pick[k]
                threshold[t, first + k] = edges[pick[k]][cut[k]]
            f = pick[node - first]
            node = 2 * node + 1 + (binned[f, np.arange(len(y))] > cut[node - first])
        leaf = node - inner
        g = np.bincount(leaf, grad, 2**depth)
        h = np.bincount(leaf, hess, 2**depth)
        value[t] = rate * g / (h + ridge)
        raw = raw + value[t, leaf]
    return Forest(feature, threshold, value, depth, base)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, allowed: Column) -> DataFrame:
    """The texts of at most ``rows`` labelled documents, those with the smallest hashed ids."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` small rows


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, allowed: Column | None = None) -> Forest:
    """Fit the forest on the bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, label, sample_rows, F.lit(True) if allowed is None else allowed)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(utf8(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()), pa.array(list(x))], ["doc_id", "y", "x"])

    found = map_batches(sample, ["doc_id", "text", "y"], features, "doc_id bigint, y int, x array<double>")
    rows = found.groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")  # a row an id
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, (rows["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(forest)  # trees * nodes numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(utf8(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(x))], ["doc_id", "score"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that score ``least`` or more."""
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.value.score(matrix(utf8(batch.column("text")))) >= least))

    return map_batches(docs, docs.columns, run, docs.schema)

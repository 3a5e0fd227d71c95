"""Toxicity by weak supervision.

1. Voters. Lexicon voters are words and word beginnings that Spark counts in all
   labelled rows that may be learnt from and that stand out in the toxic ones; of
   a word and its beginnings in the same rows only the word is one. Pattern voters
   look at shouting, exclamations and symbols; one votes where no lexicon voter
   does. A voter that doesn't fire abstains.
2. Label model. Of voters that repeat a better one (correlation given the class
   over ``REPEATED``) only the better stays. Expectation maximisation estimates how
   often each voter fires on toxic and on clean texts, and the correlations left
   between voters divide their weights.
3. A logistic regression is trained on the posterior labels and scores texts.

The sample of the label model (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN`` rows, those with
the smallest hashed ids) and the number of voters (``VOTERS``) are bounded; the
lexicon and the rate of toxic rows are counted over all labels that may be learnt
from, and scoring reads whole texts of all rows. Equal texts count once, with
the largest of their labels.

Edge cases: null or empty texts fire no voter and get a score; with no
labelled rows every score is 0; several labels of one id count as the largest;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialize

from .textops import BLANKS, alnum_words, map_batches, utf8

SAMPLE_TOXIC, SAMPLE_CLEAN, VOTERS = 4_000, 8_000, 400
STARTS = (4, 5, 6)
REPEATED = 0.5
#: Log likelihood ratio of a voter's counts against chance; there are many candidates.
EVIDENCE = 10.0
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
PATTERNS = ("shouting", "exclamations", "symbols", "you_are", "no_lexicon")


def lexicon_keys(text: bytes) -> set[bytes]:
    """Distinct words, and beginnings of words marked by a trailing ``*``."""
    words = set(alnum_words(text))
    keys = set(words)
    for n in STARTS:
        keys.update(w[:n] + b"*" for w in words if len(w) > n)
    return keys


def pattern_votes(text: bytes) -> list[bool]:
    """The votes of all patterns but the last."""
    solid = max(len(text.translate(None, BLANKS)), 1)
    letters = max(len(text) - len(text.translate(None, LETTERS)), 1)
    upper = len(text) - len(text.translate(None, UPPER))
    symbols = len(text) - len(text.translate(None, b"#*$%&"))
    return [upper > 0.5 * letters, text.count(b"!") > 3, symbols > 0.05 * solid, b"you are" in text.lower()]


@dataclass(frozen=True)
class Toxicity:
    """Voters and the weights of the linear classifier; patterns come after the lexicon."""

    voters: tuple[bytes, ...]
    weights: np.ndarray
    base: float
    accuracy: np.ndarray
    correlation: np.ndarray


def votes(texts: list[bytes], index: dict[bytes, int]) -> list[list[int]]:
    """Numbers of the voters that fire on each text."""
    found = []
    for text in texts:
        words = set(alnum_words(text))
        fired = {index[w] for w in words if w in index}
        for n in STARTS:
            fired.update(index[k] for k in {w[:n] + b"*" for w in words if len(w) > n} if k in index)
        silent = not fired
        fired.update(len(index) + i for i, v in enumerate([*pattern_votes(text), silent]) if v)
        found.append(sorted(fired))
    return found


def label_model(v: np.ndarray, seen_toxic: np.ndarray, seen_clean: np.ndarray, prior: float, rounds: int = 15, strength: float = 100.0):
    """Posterior of each row, firing rates (2, voters) and correlations given the class.

    ``seen_*`` are the rates in labelled rows; they anchor the estimate with the
    weight of ``strength`` rows.
    """
    rates = np.stack([seen_clean, seen_toxic])
    weight = np.ones(v.shape[1])
    corr = np.eye(v.shape[1])
    post = np.full(len(v), prior)
    for _ in range(rounds):
        clean, toxic = np.clip(rates, 1e-5, 1 - 1e-5)
        raw = np.log(prior / (1 - prior)) + v @ (weight * np.log(toxic / clean))
        post = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        anchors = np.stack([seen_clean, seen_toxic])
        mass = np.stack([1 - post, post])
        rates = (mass @ v + strength * anchors) / (mass.sum(1, keepdims=True) + strength)
        residual = v - (np.outer(1 - post, rates[0]) + np.outer(post, rates[1]))
        scale = np.sqrt((residual**2).mean(0)) + 1e-6
        corr = (residual.T @ residual) / len(v) / np.outer(scale, scale)
        # a voter that others repeat gets a share of their common weight
        weight = 1 / np.maximum(1, np.where(corr > 0.3, corr, 0).sum(0))
    return post, rates, corr


def distinct_voters(v: np.ndarray, y: np.ndarray, most: float = REPEATED) -> list[int]:
    """Voters, the best first, that no better one repeats; columns are in falling order of merit."""
    residual = v - np.where(y[:, None] > 0, v[y > 0].mean(0), v[y <= 0].mean(0))
    residual /= np.sqrt((residual**2).mean(0)) + 1e-9
    corr = residual.T @ residual / len(v)
    kept: list[int] = []
    for j in range(v.shape[1]):
        if not kept or corr[j, kept].max() < most:
            kept.append(j)
    return kept


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method on soft labels ``y``."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (weight * (y - p)) - penalty * w
        hess = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def labelled_keys(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """(same, doc_id, n, y) of every distinct labelled text: its hash, its least id with the number of such rows, its largest label."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("same")).join(usable, "doc_id").groupBy("same", "doc_id").agg(F.count("*").alias("n"), F.max("y").alias("y"))
    return rows.groupBy("same").agg(F.min(F.struct("doc_id", "n")).alias("r"), F.max("y").alias("y")).select("same", "r.doc_id", "r.n", "y")


def without_repeats(lexicon: DataFrame) -> DataFrame:
    """Without beginnings that a word, or a longer beginning, has in as many rows of each kind, which then are the same rows."""
    size = F.octet_length("key") - F.when(F.endswith(F.col("key"), F.lit(b"*")), 1).otherwise(0)
    starts = F.array(*[F.when(size > n, F.concat(F.substring("key", 1, n), F.lit(b"*"))) for n in STARTS])
    repeated = lexicon.select(F.explode(F.array_compact(starts)).alias("key"), "n1", "n0").distinct()
    return lexicon.join(repeated, ["key", "n1", "n0"], "left_anti")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", allowed: Column | None = None) -> Toxicity:
    spark = docs.sparkSession
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if allowed is None else allowed))
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = {int(r["y"] > 0): r["n"] for r in usable.groupBy(F.expr("int(y > 0)").alias("y")).agg(F.count("*").alias("n")).collect()}
    empty = Toxicity((), np.zeros(len(PATTERNS)), -40.0, np.zeros((2, len(PATTERNS))), np.eye(len(PATTERNS)))
    if not total.get(1) or not total.get(0):
        return empty
    keys = materialize(labelled_keys(docs, usable), "toxicity-labelled")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("same"))
    pick = lambda y, n: keys.where((F.col("y") > 0) if y else (F.col("y") <= 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_CLEAN)).select("doc_id", "same", "y")
    sample = texts.join(F.broadcast(chosen), ["doc_id", "same"])  # the sample's bound

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[bytes, list[float]] = {}
        for text, y, n in zip(utf8(batch.column("text")), batch.column("y").to_pylist(), batch.column("n").to_pylist(), strict=True):
            for key in lexicon_keys(text):
                seen.setdefault(key, [0, 0])[y > 0] += 1 / n  # n equal rows count once
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([c[1] for c in seen.values()], pa.float64()), pa.array([c[0] for c in seen.values()], pa.float64())], ["key", "n1", "n0"])

    # labels grow with the texts, so this join shuffles the texts once, at any size alike; large keys may be split
    labelled = texts.hint("merge").join(keys.select("doc_id", "same", "n", "y"), ["doc_id", "same"])
    whole = lambda n: F.round(F.sum(n)).cast("bigint").alias(n)
    counts = map_batches(labelled, ["text", "y", "n"], count, "key binary, n1 double, n0 double").groupBy("key").agg(whole("n1"), whole("n0"))
    found = {r["y"]: r["n"] for r in keys.groupBy(F.expr("int(y > 0)").alias("y")).agg(F.count("*").alias("n")).collect()}
    sizes = {y: found.get(y, 0) for y in (0, 1)}
    rate1, rate0 = (F.col("n1") + 0.5) / (sizes[1] + 1), (F.col("n0") + 0.5) / (sizes[0] + 1)
    prior = max(sizes[1], 1) / max(sum(sizes.values()), 1)
    part = lambda n, p: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("n1") + F.col("n0")) * p))).otherwise(0.0)
    evidence = part("n1", prior) + part("n0", max(1 - prior, 1e-9))  # how unlikely the counts are by chance
    useful = materialize(counts.where((F.col("n1") >= 3) & (rate1 > 8 * rate0) & (evidence >= EVIDENCE)), "toxicity-lexicon")
    lexicon = without_repeats(useful).orderBy(evidence.desc(), "key").limit(VOTERS).toPandas()
    voters = tuple(bytes(k) for k in lexicon["key"])
    index = spark.sparkContext.broadcast({k: i for i, k in enumerate(voters)})

    def fire(batch: pa.RecordBatch) -> pa.RecordBatch:
        fired = pa.array(votes(utf8(batch.column("text")), index.value), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("same"), batch.column("y").cast(pa.int32()), fired], ["doc_id", "same", "y", "fired"])

    fired = map_batches(sample, ["doc_id", "same", "text", "y"], fire, "doc_id bigint, same bigint, y int, fired array<int>")
    rows = fired.groupBy("doc_id", "same", "y").agg(F.min("fired").alias("fired")).toPandas().sort_values(["doc_id", "same"], kind="stable")
    y = (rows["y"].to_numpy() > 0).astype(float)
    if y.min(initial=1) == y.max(initial=0):
        return empty
    v = np.zeros((len(rows), len(voters) + len(PATTERNS)))
    for i, fired in enumerate(rows["fired"]):
        v[i, list(fired)] = 1
    kept = distinct_voters(v[:, : len(voters)], y) if voters else []
    voters = tuple(voters[j] for j in kept)
    patterns = v[:, -len(PATTERNS) :].copy()
    patterns[:, -1] = ~v[:, kept].any(axis=1)
    v = np.hstack([v[:, kept], patterns])
    smooth = lambda m: (m.sum(0) + 0.5) / (len(m) + 1)
    post, rates, corr = label_model(v, smooth(v[y == 1]), smooth(v[y == 0]), float(np.clip(y.mean(), 0.01, 0.99)))
    share = total[1] / (total[0] + total[1])
    balance = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # back to the rate of all labels
    weights, base = logistic(v, post, balance)
    return Toxicity(voters, weights, base, rates, corr)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    index = {k: i for i, k in enumerate(model.voters)}
    shared = docs.sparkSession.sparkContext.broadcast((index, model.weights, model.base))  # VOTERS numbers at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, weights, base = shared.value
        raw = np.array([base + weights[f].sum() for f in votes(utf8(batch.column("text")), index)])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(raw, -40, 40))))], ["doc_id", "score"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id bigint, score double")

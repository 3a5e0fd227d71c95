"""Quality rules by line labelling with a linear-chain conditional random field.

Every line of a text is content or boilerplate. Binary line features feed a
two-state chain; Viterbi decoding marks the lines, and a document is kept if
enough of its words stand in content lines. Plain rules on word counts and
repetition come first.

No line is labelled, documents are. So the states of a training text are hidden
and learnt by posterior regularisation, an expectation maximisation whose
posteriors obey what is known: in a document of label 1 at least ``MOST`` of the
lines are content, in one of label 0 at most ``LEAST``, and a line that stands
in ``SHARED_DOCS`` documents or more of the whole corpus is boilerplate, unless
half of its document's lines are such, which makes the document a copy. A
multiplier for each document shifts its posteriors that far and no further, so
good lines of bad documents and bad lines of good ones find their own state.

Training takes a bounded sample of labelled documents: the ``SAMPLE_ROWS`` with
the smallest hashed ids, up to the one that passes ``SAMPLE_LINES`` lines; the
driver gets a number a line, no text. Lines are counted, rules computed and
texts decoded over all rows and whole texts.

Edge cases: a null text has no words and fails the rules; lines without words
are decoded but carry no words; without labels all weights are zero and every
line counts as content; repeated rows are judged alike, and of rows that repeat
a labelled id the sample takes the one of the smallest hash; other columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialize

from .boosted_quality import labelled_sample
from .line_runs import halves, line_counts, line_digest
from .textops import BLANKS, CONTINUATION, map_batches, utf8, word_ids

SAMPLE_ROWS, SAMPLE_LINES = 5_000, 400_000
MOST, LEAST, SHARED_DOCS = 0.95, 0.15, 10
SYMBOLS = b"#*$%&|<>"
#: Fixed words that mark navigation and notices.
NOTICES = (b"cookie", b"copyright", b"subscribe", b"log in", b"login", b"sign up", b"privacy", b"all rights reserved", b"terms of", b"http", b"www.", b"menu", b"licensed under")
NOTICE = re.compile(b"|".join(map(re.escape, NOTICES)))
N_FEATURES = 27
#: Bytes of lines whose features are computed together.
CHUNK = 1 << 19


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


BLANK, SYMBOL = _table(BLANKS), _table(SYMBOLS)
UPPER, LETTER = _table(bytes(range(65, 91))), _table(bytes(range(65, 91)) + bytes(range(97, 123)))
DIGIT, MARKS = _table(b"0123456789"), _table(b"%$&*#")
#: Odd multipliers by place in a word, for word hashes.
PLACES = np.random.default_rng(11).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list[bytes], span: int = 8) -> int:
    """Words inside windows of ``span`` words that the text has twice or more.

    Window ids are built exactly by doubling: an id for each pair of ids.
    """
    n = len(words)
    if n <= span:
        return 0
    ids, step = word_ids(words), 1
    while step < span:
        key = ids[:-step] * (n + 1) + ids[step:]
        distinct, ids = np.unique(key, return_inverse=True)
        if len(distinct) == len(key):
            return 0
        step *= 2
    often = np.bincount(ids)[ids] > 1
    cover = np.zeros(n + 1, np.int64)
    cover[: len(often)] += often
    cover[span : span + len(often)] -= often
    return int((cover.cumsum()[:n] > 0).sum())


def base_rules(text: bytes, lines: list[bytes]) -> tuple[tuple[int, int, int, int, int], list[bool]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; which lines repeat an earlier one."""
    words = text.split()
    seen: set[bytes] = set()
    again = []
    for line in lines:
        dup = line in seen
        again.append(dup and not (not line or line.isspace()))
        if not dup:
            seen.add(line)
    counts = (
        len(words),
        len(text.translate(None, BLANKS + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        sum(again),
        repeat_words(words),
    )
    return counts, again


def _chunk_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features that a line has by itself (lines, N_FEATURES) and the words of each line."""
    flat = b"\n".join(lines) + b"\n"
    code = np.frombuffer(flat, np.uint8)
    ends = np.flatnonzero(code == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int32)
    solid_mask = ~BLANK[code]
    first = solid_mask.copy()
    first[1:] &= ~solid_mask[:-1]
    n, solid, letters = count(first), np.maximum(count(solid_mask), 1), count(LETTER[code])
    some = np.maximum(n, 1)
    # hashes of words: bytes times a multiplier of their place
    at = np.flatnonzero(solid_mask)
    word_at = np.flatnonzero(first[at])
    begins = at[word_at]
    fresh, same = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    if len(begins):
        place = at - np.repeat(begins, np.diff(np.append(word_at, len(at))))
        value = np.add.reduceat((code[at] + np.uint64(1)) * PLACES[place & 63], word_at)
        line_of = np.searchsorted(ends, begins)
        equal = (value[1:] == value[:-1]) & (line_of[1:] == line_of[:-1])
        same = np.bincount(line_of[1:][equal], minlength=len(lines))
        order = np.lexsort((value, line_of))
        v, own = value[order], line_of[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (own[1:] != own[:-1])])
        fresh = np.bincount(own[new], minlength=len(lines))
    last = np.maximum.reduceat(np.where(solid_mask, np.arange(len(code), dtype=np.int32), 0), starts)
    exclaim = code == 33
    twice = exclaim.copy()
    twice[:-1] &= exclaim[1:]
    twice[-1] = False
    notice = np.zeros(len(lines), bool)
    notice[np.searchsorted(ends, [m.start() for m in NOTICE.finditer(flat.lower())])] = True
    symbols, upper = count(SYMBOL[code]) / solid, count(UPPER[code]) / np.maximum(letters, 1)
    fresh, same, mean = fresh / some, same / some, solid / some
    columns = (
        n >= 0, n == 0, (n >= 1) & (n <= 3), (n >= 4) & (n <= 10), (n >= 11) & (n <= 30), n > 30,
        symbols > 0.02, symbols > 0.08, count(code == 124) > 0.05 * solid,
        upper > 0.3, upper > 0.7, count(twice) > 0, count(exclaim) > 0.05 * solid,
        (fresh < 0.7) & (n > 0), (fresh < 0.4) & (n > 0), same > 0.05, same > 0.3,
        (n > 0) & np.isin(code[last], list(b".?!")), mean < 3, mean > 9,
        np.zeros(len(lines), bool), count(DIGIT[code]) > 0.2 * solid, letters < 0.5 * solid,
        notice, np.zeros(len(lines), bool), np.zeros(len(lines), bool), count(MARKS[code]) > 0.03 * solid,
    )
    return np.stack(columns, 1), n


def line_features(texts: list[list[bytes]], again: list[list[bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Binary features (lines, N_FEATURES) and words of all lines of some texts, each given as its lines."""
    lines = [x for own in texts for x in own]
    if not lines:
        return np.zeros((0, N_FEATURES), bool), np.zeros(0, np.int32)
    done, low, size = [], 0, 0
    for i, line in enumerate(lines):
        size += len(line) + 1
        if size >= CHUNK or i == len(lines) - 1:
            done.append(_chunk_features(lines[low : i + 1]))
            low, size = i + 1, 0
    out, words = np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])
    stops = np.cumsum([len(own) for own in texts])
    out[:, 20] = [x for own in again for x in own]
    out[np.concatenate([[0], stops[:-1]]), 24] = True
    out[stops - 1, 25] = True
    return out, words


@dataclass(frozen=True)
class Chain:
    """Weights of the field: per state and feature, and per pair of states. State 1 is content."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best sequence of states (Viterbi)."""
        unary = features @ self.emit.T
        (m00, m01), (m10, m11) = self.move.tolist()
        scores = unary.tolist()
        a, b = scores[0]
        back = []
        for u0, u1 in scores[1:]:
            from0, from1 = b + m10 > a + m00, b + m11 >= a + m01
            back.append((from0, from1))
            a, b = u0 + (b + m10 if from0 else a + m00), u1 + (b + m11 if from1 else a + m01)
        state = int(b >= a)
        path = [state]
        for step in reversed(back):
            state = int(step[state])
            path.append(state)
        return np.array(path[::-1])


class Sequences:
    """Sequences of lines laid end to end, the longest first, for sums over all paths."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.first = np.concatenate([[0], sizes.cumsum()[:-1]])
        self.last = self.first + sizes - 1
        self.alive = [int((sizes > t).sum()) for t in range(int(sizes.max()))]

    def posteriors(self, unary: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sum of each sequence's paths, probability of state 1 on each line, expected moves (2, 2)."""
        alpha, beta, expected = np.zeros_like(unary), np.zeros_like(unary), np.zeros((2, 2))
        alpha[self.first] = unary[self.first]
        for t in range(1, len(self.alive)):
            at = self.first[: self.alive[t]] + t
            step = alpha[at - 1][:, :, None] + move
            alpha[at] = unary[at] + np.logaddexp(step[:, 0], step[:, 1])
        total = np.logaddexp(alpha[self.last, 0], alpha[self.last, 1])
        for t in range(len(self.alive) - 1, 0, -1):
            at = self.first[: self.alive[t]] + t
            ahead = (unary[at] + beta[at])[:, None, :] + move
            beta[at - 1] = np.logaddexp(ahead[:, :, 0], ahead[:, :, 1])
            expected += np.exp(alpha[at - 1][:, :, None] + ahead - total[: self.alive[t], None, None]).sum(0)
        content = np.exp(alpha[:, 1] + beta[:, 1] - np.repeat(total, self.sizes))
        return total, content, expected


def fit(texts: list[bytes], labels: np.ndarray) -> Chain:
    """``fit_lines`` on the features of some texts."""
    split = [t.split(b"\n") for t in texts]
    return fit_lines([line_features([own], [base_rules(t, own)[1]])[0] for t, own in zip(texts, split, strict=True)], labels)


def fit_lines(parts: list[np.ndarray], labels: np.ndarray, shared: list[np.ndarray] | None = None, rounds: int = 120, ridge: float = 1e-3) -> Chain:
    """Posterior regularisation by gradient ascent; all sequences advance together.

    ``parts`` has the features of each text's lines, ``shared`` which of them many
    documents share. Moves are learnt in the last third of the rounds: before it a line
    is known by itself, so that no text ends up in one state for its neighbours' sake.
    """
    if not parts:
        return Chain(np.zeros((2, N_FEATURES)), np.zeros((2, 2)))
    order = np.argsort([-len(p) for p in parts], kind="stable")
    labels = np.asarray(labels, np.int64)[order]
    x = np.concatenate([parts[i] for i in order]).astype(np.float64)
    known = np.concatenate([shared[i] for i in order]) if shared else np.zeros(len(x), bool)
    runs = Sequences(np.array([len(parts[i]) for i in order]))
    flat = np.zeros(2 * N_FEATURES + 4)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    shift = np.where(labels > 0, 1.0, -1.0)  # a document's multiplier
    share = lambda content: np.add.reduceat(content, runs.first) / runs.sizes
    for k in range(1, rounds + 1):
        emit, move = flat[: 2 * N_FEATURES].reshape(2, -1), flat[2 * N_FEATURES :].reshape(2, 2)
        unary = x @ emit.T
        held = unary.copy()
        held[:, 1] += np.where(known, -20.0, np.repeat(shift, runs.sizes))
        late = 3 * k > 2 * rounds
        if late:
            _, content, moves = runs.posteriors(held, move)
            _, free, free_moves = runs.posteriors(unary, move)
        else:  # without moves each line is alone
            content, free = (1 / (1 + np.exp(np.clip(u[:, 0] - u[:, 1], -40, 40))) for u in (held, unary))
            moves = free_moves = np.zeros((2, 2))
        part = share(content)
        shift = np.where(labels > 0, np.maximum(0, shift + 4 * (MOST - part)), np.minimum(0, shift + 4 * (LEAST - part)))
        gap = (content - free) @ x
        grad = np.concatenate([-gap, gap, (moves - free_moves).ravel()]) / len(x) - ridge * flat
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        flat = flat + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    return Chain(flat[: 2 * N_FEATURES].reshape(2, -1), flat[2 * N_FEATURES :].reshape(2, 2))


def training_lines(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, y, bits, h1, h2) of each sampled document: a number of feature bits and a digest for each line."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [t.split(b"\n") for t in utf8(batch.column("text"))]
        found, _ = line_features(split, [base_rules(b"\n".join(own), own)[1] for own in split])
        bits = found @ (1 << np.arange(N_FEATURES))
        h1, h2 = halves([line_digest(x, 0) for own in split for x in own])
        offsets = np.cumsum([0, *map(len, split)]).astype(np.int32)
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((bits, pa.int32()), (h1, pa.int64()), (h2, pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()), *arrays], ["doc_id", "y", "bits", "h1", "h2"])

    sample = labelled_sample(docs, labels, label, rows, F.lit(True))
    made = map_batches(sample, ["doc_id", "text", "y"], run, "doc_id bigint, y int, bits array<int>, h1 array<bigint>, h2 array<bigint>")
    return made.groupBy("doc_id", "y").agg(F.min(F.struct("h1", "h2", "bits")).alias("r")).select("doc_id", "y", "r.*")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES) -> Chain:
    """Fit the chain on the bounded sample of labelled documents."""
    lines = materialize(training_lines(docs, labels, label, sample_rows), "crf-lines")
    own = lines.select(F.explode(F.arrays_zip("h1", "h2")).alias("l")).select("l.h1", "l.h2").distinct()
    counts = line_counts(docs, 1, 1).groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED_DOCS)
    shared = {(r["h1"], r["h2"]) for r in counts.join(own, ["h1", "h2"], "left_semi").select("h1", "h2").toLocalIterator()}  # lines of the sample
    parts, marks, y, n = [], [], [], 0
    for r in lines.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        parts.append((np.array(r["bits"], np.int64)[:, None] >> np.arange(N_FEATURES)) & 1)
        mark = np.array([h in shared for h in zip(r["h1"], r["h2"], strict=True)], bool)
        marks.append(mark & (2 * mark.sum() < len(mark)))
        y.append(int(r["y"] > 0))
        n += len(r["bits"])
        if n >= sample_lines:
            break
    return fit_lines(parts, np.array(y), marks)


def judge(docs: DataFrame, chain: Chain, least_words: int = 20, most_repeated: int = 30, least_content: float = 0.5) -> DataFrame:
    """Counts, rules and verdict for every row: see the names in the schema."""
    model = docs.sparkSession.sparkContext.broadcast(chain)  # a few dozen weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        split = [t.split(b"\n") for t in texts]
        rules = [base_rules(t, own) for t, own in zip(texts, split, strict=True)]
        features, words = line_features(split, [again for _, again in rules])
        rows, low = [], 0
        for doc_id, (base, again) in zip(batch.column("doc_id").to_pylist(), rules, strict=True):
            n, repeated = base[0], base[4]
            failed = n < least_words or 100 * repeated > most_repeated * n
            high = low + len(again)
            state = model.value.decode(features[low:high])
            share = float((words[low:high] * state).sum() / n) if n else 0.0
            rows.append((doc_id, *base, failed, not failed and share >= least_content, share, int((state == 0).sum())))
            low = high
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_boilerplate_lines"]
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, n_boilerplate_lines bigint"
    return map_batches(docs, ["doc_id", "text"], run, schema)

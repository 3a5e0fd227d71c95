"""LM scoring with an interpolated modified Kneser-Ney model of word pairs.

Spark counts the model and the workers memory-map it:

1. Words of the training rows are counted and stored as sorted arrays of their
   XXH64 hashes, sharded by hash; a word's id is its place in that order.
2. Word pairs are counted and stored as sorted arrays of ``id1 << 32 | id2``.
   A pair lies in the shard of its first word; pairs whose first word is very
   common are spread over all shards by both words. Beside them lie, for each
   first word, its total and how many of its pairs occur once, twice, more.
3. For each second word the number of distinct words before it is stored as a
   plain array by id.

The discounts come from the counts of counts of all shards. A context whose
counts these leave undiscounted, as with repeated rows, is discounted by
``FALLBACK``, so that each keeps some mass for unseen words. Counts are 64-bit; they are stored in 32 bits
in shards where all fit. Word ids have 32 bits: more words raise an error.
Interpolation goes
from pairs over continuation counts to the uniform distribution over the V
training words and one unknown. Partial counts are merged within each task
before the shuffle, so a common word is a few rows. The number of shards grows
with the input, so a shard's size doesn't. The arrays are written to the shared
folder, each under its final name in one step, so a retried task is harmless;
where that folder isn't a POSIX path they are read through its file system into
a cache of ``CACHE_BYTES`` a worker.

Edge cases: a null or empty text is its end token alone; the end token follows
every text, the start context comes before; without training rows every token
has the uniform probability of one unknown word; null ids train (fold unknown)
and are scored; repeated rows count again; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialize, scratch_path

from .textops import utf8

END = b"\n"  # no word holds a blank
CHARS_PER_SHARD = 16_000_000
FLUSH_WORDS, FLUSH_TOKENS, SCORE_TOKENS = 150_000, 2_000_000, 500_000
BLOCKS = "shard int, keys binary, counts binary"
START = (1 << 32) - 1  # the id of the start context
#: Discounts of counts 1, 2 and 3 or more in contexts where counts of counts give none; index 0 is 0.
FALLBACK = np.array([0.0, 0.5, 1.0, 1.5])
CACHE_BYTES = 256 << 20


def words_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


# arrays in the shared folder


def _open(path: str):
    """(file system, path) of pyarrow, or (None, local path) for a POSIX path."""
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def save(path: str, array: np.ndarray) -> None:
    """Write an array under its final name in one step."""
    files, local = _open(path)
    part = f"{local}.{uuid.uuid4().hex}.part"
    if files is None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        array.tofile(part)
        os.replace(part, local)
    else:
        files.create_dir(os.path.dirname(local), recursive=True)
        with files.open_output_stream(part) as out:
            out.write(array.tobytes())
        files.move(part, local)


class Fetched:
    """Arrays read whole from a store that can't be mapped, the latest used up to ``CACHE_BYTES``."""

    def __init__(self) -> None:
        self.held: OrderedDict[str, bytes] = OrderedDict()
        self.size = 0

    def get(self, path: str) -> bytes:
        if path in self.held:
            self.held.move_to_end(path)
            return self.held[path]
        files, local = _open(path)
        data = b""
        if files.get_file_info(local).size:
            with files.open_input_file(local) as source:
                data = source.read()
        self.held[path] = data
        self.size += len(data)
        while self.size > CACHE_BYTES and len(self.held) > 1:
            self.size -= len(self.held.popitem(last=False)[1])
        return data


FETCHED = Fetched()


@functools.lru_cache(maxsize=4096)
def mapped(local: str) -> np.ndarray:
    """The bytes of a file, mapped into memory; pages are shared by all workers of a machine."""
    return np.memmap(local, np.uint8, "r") if os.path.exists(local) and os.path.getsize(local) else np.zeros(0, np.uint8)


def load(path: str, kind: str) -> np.ndarray:
    """A stored array."""
    files, local = _open(path)
    return mapped(local).view(kind) if files is None else np.frombuffer(FETCHED.get(path), kind)


def forget() -> None:
    """Let go of all arrays."""
    mapped.cache_clear()
    FETCHED.__init__()


load.cache_clear = forget


def save_counts(path: str, counts: np.ndarray) -> None:
    """Store counts in 32 bits if all fit, else in 64."""
    save(path, counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8"))


def load_counts(path: str, n: int) -> np.ndarray:
    """``n`` stored counts of either width."""
    data = load(path, "u1")
    return data.view(f"<u{len(data) // n}") if n else np.zeros(0, "<u4")


# counting


def shard_of_hash(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so that ids follow the order of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_of_pair(key: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    first = key >> np.uint64(32)
    mixed = np.where(np.isin(first, hot), key, first)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return shard_of_hash(mixed, shards)


def blocks(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """A row for each shard; keys stay in order within it."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    cut = np.flatnonzero(np.diff(shard)) + 1
    parts = list(zip(np.split(keys, cut), np.split(counts, cut), strict=True)) if len(keys) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(s) for s in shard[np.concatenate([[0], cut])]] if len(keys) else [], pa.int32()),
            pa.array([k.tobytes() for k, _ in parts], pa.binary()),
            pa.array([c.tobytes() for _, c in parts], pa.binary()),
        ],
        ["shard", "keys", "counts"],
    )


def merged(group: pd.DataFrame, key_kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a shard's blocks with their summed counts."""
    keys = np.frombuffer(b"".join(group["keys"]), key_kind)
    counts = np.frombuffer(b"".join(group["counts"]), np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; index 0 is 0."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [(i - (i + 1) * y * b / a if a else 0.0) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.clip([0.0, *d], 0, [0, 1, 2, 3])


class Vocabulary:
    """Word ids by look-up in the sorted hash arrays; keeps a bounded cache."""

    def __init__(self, base: str, bounds: list[int]):
        self.base, self.bounds, self.shards = base, np.array(bounds, np.int64), len(bounds) - 1
        self.cache: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The ids of the words, -1 for words that training hasn't."""
        cache = self.cache
        missing = [w for w in set(words) if w not in cache]
        if missing:
            h = np.fromiter(map(xxhash.xxh64_intdigest, missing), np.uint64, len(missing))
            order = np.argsort(h)
            h, shard = h[order], shard_of_hash(h[order], self.shards)
            ids = np.full(len(h), -1, np.int64)
            for s in np.unique(shard).tolist():
                i, j = np.searchsorted(shard, [s, s + 1])
                keys = load(f"{self.base}/words-{s}.keys", "<u8")
                at = np.searchsorted(keys, h[i:j])
                ok = at < len(keys)
                ok[ok] = keys[at[ok]] == h[i:j][ok]
                ids[i:j][ok] = at[ok] + self.bounds[s]
            cache.update(zip((missing[k] for k in order.tolist()), ids.tolist(), strict=True))
        out = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        if len(cache) > FLUSH_WORDS:
            cache.clear()
        return out


def texts_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            yield utf8(batch.slice(low, 256).column("text"))


class Model:
    """What scoring needs: a folder and some totals. Sizes follow the shards, not the words."""

    def __init__(self, base: str, bounds: list[int]):
        self.base, self.bounds = base, bounds
        self.total = 0  # training tokens
        self.pair_d = self.word_d = np.zeros(4)
        self.word_gamma, self.pairs = 1.0, 0
        self.hot: dict[int, tuple[int, int, int, int]] = {}

    @property
    def shards(self) -> int:
        return len(self.bounds) - 1

    @property
    def words(self) -> int:
        return self.bounds[-1]


def _grouped(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy("shard").applyInPandas(fn, schema)


def train(docs: DataFrame, allowed: Column | None = None, chars_per_shard: int = CHARS_PER_SHARD) -> Model:
    """Count the model over all allowed rows."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(4, -(-chars // chars_per_shard))
    base = scratch_path(spark, "kneser-ney")
    texts = (docs if allowed is None else docs.where(allowed)).select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
            n = np.fromiter(seen.values(), np.uint32, len(seen))
            order = np.argsort(h)
            seen.clear()
            return blocks(h[order], n[order], shard_of_hash(h[order], shards))

        for part in texts_in(batches):
            for text in part:
                seen.update(words_of(text))
            if len(seen) > FLUSH_WORDS:
                yield flush()
        yield flush()

    def store_words(group: pd.DataFrame) -> pd.DataFrame:
        s = int(group["shard"].iloc[0])
        keys, counts = merged(group, "<u8")
        save(f"{base}/words-{s}.keys", keys)
        save_counts(f"{base}/words-{s}.counts", counts)
        common = counts > counts.sum() / 64  # the total is not known yet; a word left out costs balance alone
        return pd.DataFrame({"shard": [s], "n": [len(keys)], "total": [int(counts.sum())], "at": [np.flatnonzero(common).tolist()], "counts": [counts[common].tolist()]})

    rows = _grouped(texts.mapInArrow(count_words, BLOCKS), store_words, "shard int, n bigint, total bigint, at array<bigint>, counts array<bigint>").collect()  # a row a shard
    sizes = [0] * shards
    for r in rows:
        sizes[r["shard"]] = r["n"]
    bounds = [0, *np.cumsum(sizes).tolist()]
    model = Model(base, bounds)
    if bounds[-1] >= START:
        raise ValueError("word ids must fit in 32 bits")
    model.total = sum(r["total"] for r in rows)
    hot = sorted([START, *(bounds[r["shard"]] + i for r in rows for i, n in zip(r["at"], r["counts"], strict=True) if n > model.total / (4 * shards))])
    hot_ids = np.array(hot, np.uint64)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, size = Vocabulary(base, bounds), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return blocks(keys, counts.astype(np.uint32), shard_of_pair(keys, hot_ids, shards))

        for part in texts_in(batches):
            words = [words_of(t) for t in part]
            held.append(pair_keys(words, vocabulary.ids([w for x in words for w in x])))
            size += len(held[-1])
            if size > FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def store_pairs(group: pd.DataFrame) -> pd.DataFrame:
        s = int(group["shard"].iloc[0])
        keys, counts = merged(group, "<u8")
        save(f"{base}/pairs-{s}.keys", keys)
        save_counts(f"{base}/pairs-{s}.counts", counts)
        first = keys >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        contexts = first[at]
        stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts > 2)], 1)
        own = ~np.isin(contexts, hot_ids)
        save(f"{base}/contexts-{s}.keys", contexts[own].astype("<u4"))
        save_counts(f"{base}/contexts-{s}.stats", stats[own].ravel())
        second, before = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        cont = blocks(second.astype("<u4"), before.astype(np.uint32), np.searchsorted(bounds, second, side="right") - 1)
        hot_rows = [(int(c), *map(int, x)) for c, x in zip(contexts[~own], stats[~own], strict=True)]
        out = cont.to_pandas()
        out["kind"] = 1
        head = pd.DataFrame({"shard": [s], "keys": [np.array(hot_rows, "<i8").tobytes()], "counts": [np.array([*count_of_counts(counts), len(keys)], "<i8").tobytes()], "kind": [0]})
        return pd.concat([head, out], ignore_index=True)

    stored = materialize(_grouped(texts.mapInArrow(count_pairs, BLOCKS), store_pairs, "shard int, keys binary, counts binary, kind int"), "kneser-ney-shards")
    of_counts = np.zeros(5, np.int64)
    hot_stats: dict[int, np.ndarray] = {}
    for r in stored.where("kind = 0").toLocalIterator():  # a row a shard, with at most 4 * shards common words
        of_counts += np.frombuffer(r["counts"], "<i8")
        for c, *x in np.frombuffer(r["keys"], "<i8").reshape(-1, 5).tolist():
            hot_stats[c] = hot_stats.get(c, 0) + np.array(x)
    model.hot = {c: tuple(map(int, x)) for c, x in hot_stats.items()}
    model.pairs = int(of_counts[4])
    model.pair_d = discounts(of_counts[:4].tolist())

    def store_continuations(group: pd.DataFrame) -> pd.DataFrame:
        s = int(group["shard"].iloc[0])
        ids, counts = merged(group, "<u4")
        dense = np.zeros(bounds[s + 1] - bounds[s], "<u4")
        dense[ids.astype(np.int64) - bounds[s]] = counts
        save(f"{base}/words-{s}.before", dense)
        return pd.DataFrame([[s, *count_of_counts(counts), int((counts > 2).sum())]], columns=["shard", "n1", "n2", "n3", "n4", "more"])

    rows = _grouped(stored.where("kind = 1").select("shard", "keys", "counts"), store_continuations, "shard int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint").collect()
    n1, n2, n3, n4, more = (sum(r[k] for r in rows) for k in ("n1", "n2", "n3", "n4", "more"))
    model.word_d = discounts([n1, n2, n3, n4])
    if model.word_d[1:] @ [n1, n2, more] <= 0:
        model.word_d = FALLBACK
    model.word_gamma = float(model.word_d[1:] @ [n1, n2, more]) / model.pairs if model.pairs else 1.0
    return model


def pair_keys(texts: list[list[bytes]], ids: np.ndarray) -> np.ndarray:
    """``before << 32 | word`` for all tokens of some texts, each starting from the start context."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum([0, *map(len, texts[:-1])])] = START
    return (before.astype(np.uint64) << np.uint64(32)) | (ids.astype(np.uint64) & np.uint64(0xFFFFFFFF))


# scoring


class Reader:
    """Probabilities from the mapped arrays."""

    def __init__(self, model: Model):
        self.m = model
        self.vocabulary = Vocabulary(model.base, model.bounds)
        self.bounds = np.array(model.bounds, np.int64)
        self.hot = np.array(sorted(model.hot), np.uint64)
        self.hot_stats = np.array([model.hot[int(k)] for k in self.hot], np.float64).reshape(-1, 4)

    def by_id(self, ids: np.ndarray, what: str) -> np.ndarray:
        """Values of a plain array by (sorted, known) word id."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.bounds, ids, side="right") - 1
        for s in np.unique(shard).tolist():
            i, j = np.searchsorted(shard, [s, s + 1])
            out[i:j] = load_counts(f"{self.m.base}/words-{s}.{what}", int(self.bounds[s + 1] - self.bounds[s]))[ids[i:j] - self.bounds[s]]
        return out

    def _find(self, stored: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(stored, keys.astype(stored.dtype))
        ok = at < len(stored)
        ok[ok] = stored[at[ok]] == keys[ok].astype(stored.dtype)
        return at, ok

    def pair_stats(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of each pair, stats of its first word) for sorted keys of known words."""
        count, stats = np.zeros(len(keys), np.float64), np.zeros((len(keys), 4))
        first = keys >> np.uint64(32)
        common = np.isin(first, self.hot)
        if len(self.hot):
            stats[common] = self.hot_stats[np.searchsorted(self.hot, first[common])]
        shard = shard_of_pair(keys, self.hot, self.m.shards)
        order = np.argsort(shard, kind="stable")
        used, edges = np.unique(shard[order], return_index=True)  # of all shards those that these keys are in
        for s, low, high in zip(used.tolist(), edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            own = order[low:high]
            stored = load(f"{self.m.base}/pairs-{s}.keys", "<u8")
            at, ok = self._find(stored, keys[own])
            count[own[ok]] = load_counts(f"{self.m.base}/pairs-{s}.counts", len(stored))[at[ok]]
            rest, stored = own[~common[own]], load(f"{self.m.base}/contexts-{s}.keys", "<u4")
            at, ok = self._find(stored, first[rest])
            if ok.any():
                stats[rest[ok]] = load_counts(f"{self.m.base}/contexts-{s}.stats", 4 * len(stored)).reshape(-1, 4)[at[ok]]
        return count, stats

    def score(self, texts: list[bytes]) -> list[tuple[int, int, float, float]]:
        """(n_tokens, n_known, base_score, score) of each text."""
        m = self.m
        words = [words_of(t) for t in texts]
        ids = self.vocabulary.ids([w for x in words for w in x])
        starts = np.cumsum([0, *map(len, words[:-1])])
        known = ids >= 0
        distinct, back = np.unique(ids, return_inverse=True)
        real = distinct >= 0
        c, before = np.zeros(len(distinct)), np.zeros(len(distinct), np.int64)
        c[real] = self.by_id(distinct[real], "counts")
        before[real] = self.by_id(distinct[real], "before")
        base = np.log10((c + 0.1) / (m.total + 0.1 * (m.words + 1)))[back]
        lower = m.word_gamma / (m.words + 1) + (before - m.word_d[np.minimum(before, 3)]).clip(0) / max(m.pairs, 1)
        keys, at = np.unique(pair_keys(words, ids), return_inverse=True)
        one, two = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        unknown = np.uint64(0xFFFFFFFF)
        # -1 as a first word is the start context's id: tokens after unknown words are told apart below
        p = lower[np.searchsorted(distinct, np.where(two == unknown, -1, two.astype(np.int64)))]
        count, stats = np.zeros(len(keys)), np.zeros((len(keys), 4))
        fine = (one == np.uint64(START)) | (one < np.uint64(m.words))
        count[fine], stats[fine] = self.pair_stats(keys[fine])
        total = stats[:, 0]
        seen = total > 0
        freed = stats[:, 1:] @ m.pair_d[1:]
        bare = freed <= 0  # nothing left for unseen words
        gamma = np.where(seen, np.where(bare, stats[:, 1:] @ FALLBACK[1:], freed) / np.maximum(total, 1), 1.0)
        least = np.minimum(count, 3).astype(np.int64)
        d = np.where(bare, FALLBACK[least], m.pair_d[least])
        p_pair = gamma * p + np.where(seen, (count - d).clip(0) / np.maximum(total, 1), 0)
        after_unknown = np.concatenate([[False], ~known[:-1]])
        after_unknown[starts] = False
        probability = np.where(after_unknown, lower[back], p_pair[at])
        sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, np.log10(probability))]
        return list(zip(map(len, words), *(x.tolist() for x in sums), strict=True))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = Reader(shared.value), ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for batch in batches:
            texts, ids = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and size < 6 * SCORE_TOKENS:
                    size += len(texts[high])
                    high += 1
                n, known, base, full = zip(*reader.score(texts[low:high]), strict=True)
                kinds = [pa.int64()] * 4 + [pa.float64()] * 2
                columns = [ids[low:high], n, known, [shared.value.total] * len(n), base, full]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)
                low = high

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

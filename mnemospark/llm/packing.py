"""Best-fit packing with linear grouping.

Documents become token ids with a closing id; those over ``capacity`` are cut.
Lengths are integers up to the capacity, so the driver plans on their histogram,
whose size doesn't depend on the data:

1. Large lengths, in falling order, are dealt into ``groups`` groups of equal
   cardinality, and each length is rounded up to its group's largest.
2. For the few sizes left, configurations (how many of which sizes share a
   sequence) are optimised: column generation solves the linear program of least
   sequences, each new configuration being the best for the current prices (a
   knapsack), until no plan can be ``GAP`` better or ``ROUNDS`` are tried. Whole
   multiples of its configurations are used. What remains is filled one after
   another: the largest size left, completed to the fullest sequence that the
   remaining counts allow (bounded subset sums), as often as they allow. The same
   filling alone, over ``groups`` sizes, makes a second plan; the shorter is taken.
3. The actual lengths take the places of the rounded ones.
4. Small lengths, in falling order, go best-fit into the room that is left.

The plan is run-length coded: so many sequences of these lengths. Each length's
pieces are numbered in Spark, and a piece finds its place by length and number.

Edge cases: a null or empty text is the closing id alone; rows that repeat an id
are packed each on its own; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import materialize

from .textops import map_batches, utf8

CAPACITY, GROUPS = 4096, 256
#: Sizes of the linear program, its unit of length, the gap to the bound that is good enough, and the most configurations it tries.
PROGRAM_GROUPS, UNIT, GAP, ROUNDS = 64, 4, 5e-4, 400
TOKEN_CACHE = 300_000
#: Bytes of texts that are split together; a longer text is split alone.
TOGETHER = 1 << 20
#: Signs that are split from the letter or digit before them; those of special tokens are not, nor is the apostrophe of contractions.
SIGNS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: Pieces of one length that are numbered together, or the root of their number if that is more.
NUMBERED = 200


class TokenCache:
    """Ids of the blank-free parts of texts, as little-endian bytes.

    The tokenizer drops white space, normalises, and splits at the border of a
    letter or digit and the ``SIGNS`` after it, so parts can be encoded alone and
    joined. What counts is the normalised letter: one that becomes a letter and a
    mark doesn't end at that border. New parts that are letters only when
    normalised, or signs only, are encoded together as one text: each is one word to
    the tokenizer, and its last token ends a word. Those that the tokenizer takes as
    they are, a-z and signs, go to its model without its normaliser.

    Two generations of at most ``TOKEN_CACHE`` parts are kept; a part that is in
    use moves to the younger one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.plain: set[str] = set()
        special = "".join(token.content for token in self.tokenizer.get_added_tokens_decoder().values())
        self.signs = SIGNS.translate(None, special.encode())
        self.model = None
        if all(self._as_it_is(word) for word in (bytes(range(97, 123)).decode(), self.signs.decode())):
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _as_it_is(self, word: str) -> bool:
        """Whether normaliser and splitter leave a word one word, unchanged."""
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        return (not normal or normal.normalize_str(word) == word) and bool(split) and [w for w, _ in split.pre_tokenize_str(word)] == [word]

    def _plain(self, text: str) -> bool:
        """Whether the normaliser keeps all letters and digits of a text letters and digits."""
        if self.plain.issuperset(text):
            return True
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        for c in set(text) - self.plain:
            made = normal(c)
            if not (c.isalnum() and made.isalnum()) or c.isalpha() != made.isalpha():
                return False
            self.plain.add(c)
        return True

    def _cuts(self, stem: bytes) -> bool:
        """Whether the tokenizer splits between this stem and signs."""
        if not stem or stem[-1] < 128:
            return stem[-1:].isalnum()
        return self._plain(stem.decode()[-1])

    def _letters(self, word: bytes) -> bool:
        if word.isascii():
            return word.isalpha()
        text = word.decode()
        return text.isalpha() and self._plain(text)

    def _encode(self, texts: list[str], by=None) -> list[list[int]]:
        return [code.ids for code in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes], out: dict[bytes, bytes], by=None) -> None:
        """Encode words of letters or of signs, 500 to a text."""
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        for group, ids in zip(groups, self._encode([b" ".join(g).decode() for g in groups], by), strict=True):
            codes = np.array(ids, "<u4")
            cuts = (np.flatnonzero(self.ends[codes]) + 1) * 4
            if len(cuts) != len(group):  # this tokenizer doesn't mark ends
                out.update(zip(group, (np.array(x, "<u4").tobytes() for x in self._encode([w.decode() for w in group])), strict=True))
                continue
            flat, at = codes.tobytes(), 0
            for word, cut in zip(group, cuts.tolist(), strict=True):
                out[word] = flat[at:cut]
                at = cut

    def learn(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts, all of which the younger generation then knows."""
        if len(self.young) > TOKEN_CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        stems: dict[bytes, bytes] = {}
        for part in [part for part, code in zip(parts, map(young.get, parts), strict=True) if code is None]:
            code = old.get(part)
            if code is not None:
                young[part] = code
                continue
            stem = part.rstrip(self.signs)
            stems[part] = stem if stem != part and self._cuts(stem) else part
        need = {x for part, stem in stems.items() for x in (stem, part[len(stem) :]) if x and x not in young}
        plain, letters, rest = [], [], []
        for x in need:
            letter = self._letters(x)
            if self.model and (x.isascii() and x.islower() if letter else not x.strip(self.signs)):
                plain.append(x)
            else:
                (letters if letter else rest).append(x)
        self._words(plain, young, self.model)
        self._words(letters, young)
        young.update(zip(rest, (np.array(x, "<u4").tobytes() for x in self._encode([w.decode() for w in rest])), strict=True))
        young[b""] = b""
        for part, stem in stems.items():
            if part != stem:
                young[part] = young[stem] + young[part[len(stem) :]]
        return list(map(young.__getitem__, parts))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text. A-Z are lowered here, unless a text may hold a special token.

        Arrow splits the texts, tells distinct parts and joins their ids, so that Python sees a part once.
        """
        lowered = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_binary())
        split = pc.ascii_split_whitespace(lowered.view(pa.large_string()))  # at [\x20\x09-\x0D]+, as bytes.split does
        coded = split.values.dictionary_encode()
        parts = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        codes = pa.array(self.learn(parts), pa.large_binary()).take(coded.indices)
        lengths = pc.binary_length(codes).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[split.offsets.to_numpy()].tolist()
        flat = memoryview(codes.buffers()[2] or b"")
        for low, high in pairwise(ends):
            yield flat[low:high].tobytes()


def together(texts: list[bytes], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, or of one longer text."""
    low, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > most:
            yield low, at
            low, size = at, 0
        size += len(text)
    if low < len(texts):
        yield low, len(texts)


@functools.lru_cache(maxsize=2)
def token_cache(path: str) -> TokenCache:
    """One cache per worker process, kept from task to task."""
    return TokenCache(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = token_cache(tokenizer)
        rows = []
        ids = batch.column("doc_id").to_pylist()
        texts = utf8(batch.column("text"))
        for low, high in together(texts):
            for doc_id, code in zip(ids[low:high], cache.encode(texts[low:high]), strict=True):
                code += end
                for piece, at in enumerate(range(0, len(code), 4 * capacity)):
                    part = code[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


Run = tuple[int, tuple[int, ...]]  # so many sequences of these lengths


def fill(room: int, sizes: list[int], counts: list[int]) -> dict[int, int]:
    """How many of which sizes fill ``room`` best, within their counts (subset sums as bit sets)."""
    full = (1 << (room + 1)) - 1
    stages = [1]
    for size, count in zip(sizes, counts, strict=True):
        bits = stages[-1]
        for _ in range(min(count, room // size)):
            more = (bits | bits << size) & full
            if more == bits:
                break
            bits = more
        stages.append(bits)
    at, chosen = stages[-1].bit_length() - 1, {}
    for i in range(len(sizes) - 1, -1, -1):
        n = 0
        while not stages[i] >> at & 1:
            at -= sizes[i]
            n += 1
        if n:
            chosen[i] = n
    return chosen


def take(queue: list[list[int]], n: int) -> list[tuple[int, int]]:
    """Remove ``n`` items from the front of a run-length coded list of lengths."""
    got = []
    while n:
        head = queue[0]
        k = min(n, head[1])
        got.append((head[0], k))
        head[1] -= k
        n -= k
        if not head[1]:
            queue.pop(0)
    return got


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest total price that fits (unbounded knapsack), and that price."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for room in range(smallest, capacity + 1):
        fits = len(sizes) - int(np.searchsorted(sizes[::-1], room, side="right"))  # sizes fall
        offers = prices[fits:] + value[room - sizes[fits:]]
        best = int(offers.argmax())
        value[room], pick[room] = value[room - 1], -1
        if offers[best] > value[room] + 1e-12:
            value[room], pick[room] = offers[best], fits + best
    made, room = np.zeros(len(sizes)), capacity
    while room >= smallest:
        if pick[room] < 0:
            room -= 1
        else:
            made[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(value[capacity]), made


def configurations(sizes: list[int], counts: list[int], capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """Whole multiples of configurations {size's place: number} of a near-optimal plan, and a lower bound on the sequences of any plan.

    ``sizes`` are distinct and fall. No size is used more often than it is there.
    """
    size, need = -(-np.array(sizes) // UNIT), np.array(counts, float)
    capacity //= UNIT
    basis = np.diag(np.maximum(1, capacity // size)).astype(float)
    bound = 0.0
    for _ in range(rounds):
        amounts, prices = np.linalg.solve(basis, need), np.linalg.solve(basis.T, np.ones(len(size)))
        price, column = best_configuration(np.maximum(prices, 0), size, capacity)
        bound = max(bound, float(np.maximum(prices, 0) @ need) / max(price, 1.0))
        if price <= 1 + 1e-9 or amounts.sum() <= bound * (1 + gap):
            break
        change = np.linalg.solve(basis, column)
        share = np.where(change > 1e-9, np.maximum(amounts, 0) / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(share.argmin())
        if not np.isfinite(share[leaves]):
            break
        basis[:, leaves] = column
    amounts = np.linalg.solve(basis, need)
    left, out = list(counts), []
    for j in np.argsort(-amounts, kind="stable").tolist():
        use = {int(i): int(basis[i, j]) for i in np.flatnonzero(basis[:, j])}
        times = min(int(amounts[j] + 1e-6), *(left[i] // n for i, n in use.items()))
        if times > 0:
            out.append((times, use))
            for i, n in use.items():
                left[i] -= times * n
    return out, bound


def pack_large(lengths: list[tuple[int, int]], capacity: int, groups: int, optimise: bool = False) -> list[Run]:
    """Steps 1 to 3 for (length, count) in falling order of length; ``optimise``: by the linear program first."""
    total = sum(c for _, c in lengths)
    if not total:
        return []
    each = math.ceil(total / groups)
    queue = [[length, count] for length, count in lengths]
    dealt: list[list[list[int]]] = []
    for done in range(0, total, each):
        dealt.append([list(x) for x in take(queue, min(each, total - done))])
    merged: list[list[list[int]]] = []
    for group in dealt:  # groups that are rounded to the same size are one
        if merged and merged[-1][0][0] == group[0][0]:
            merged[-1] += group
        else:
            merged.append(group)
    sizes = [g[0][0] for g in merged]
    left = [sum(c for _, c in g) for g in merged]
    runs: list[Run] = []

    def use_up(times: int, use: dict[int, int]) -> None:
        slots = [take(merged[i], times) for i, n in use.items() for _ in range(n)]
        for i, n in use.items():
            left[i] -= times * n
        cuts = sorted({0, times} | {c for slot in slots for c in np.cumsum([k for _, k in slot]).tolist()})
        for low, high in pairwise(cuts):
            runs.append((high - low, tuple(_at(slot, low) for slot in slots)))

    for times, use in configurations(sizes, left, capacity)[0] if optimise else []:
        use_up(times, use)
    for first in range(len(sizes)):
        while left[first]:
            room = capacity - sizes[first]
            usable = [i for i in range(first, len(sizes)) if left[i] - (i == first) > 0 and sizes[i] <= room]
            more = fill(room, [sizes[i] for i in usable], [left[i] - (i == first) for i in usable])
            use = {first: 1}
            for i, n in more.items():
                use[usable[i]] = use.get(usable[i], 0) + n
            use_up(min(left[i] // n for i, n in use.items()), use)
    return runs


def _at(slot: list[tuple[int, int]], index: int) -> int:
    for length, k in slot:
        if index < k:
            return length
        index -= k
    raise IndexError(index)


def pack_small(runs: list[Run], lengths: list[tuple[int, int]], capacity: int) -> list[Run]:
    """Step 4: best fit, longest first, on runs of equal sequences."""
    by_room: dict[int, list[Run]] = {}
    rooms = 0  # bit r: some run has r tokens of room

    def put(run: Run) -> None:
        nonlocal rooms
        room = capacity - sum(run[1])
        by_room.setdefault(room, []).append(run)
        rooms |= 1 << room

    for run in runs:
        put(run)
    for length, count in lengths:
        while count:
            fit = rooms >> length
            if not fit:
                each = capacity // length
                if count >= each:
                    put((count // each, (length,) * each))
                if count % each:
                    put((1, (length,) * (count % each)))
                break
            room = length + (fit & -fit).bit_length() - 1
            n, inside = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms &= ~(1 << room)
            copies = min(room // length, count // n)
            if copies:
                put((n, inside + (length,) * copies))
                count -= n * copies
            else:  # fewer pieces than sequences
                put((n - count, inside))
                put((count, (*inside, length)))
                count = 0
    return [run for room in sorted(by_room) for run in by_room[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """All four steps; the number of runs follows the number of distinct lengths."""
    lengths = sorted(((k, n) for k, n in histogram.items() if n), reverse=True)
    whole = [(n, (k,)) for k, n in lengths if k == capacity]
    large = [(k, n) for k, n in lengths if capacity // 6 < k < capacity]
    small = [(k, n) for k, n in lengths if k <= capacity // 6]
    least, best = -(-sum(k * n for k, n in lengths) // capacity), None
    for n, program in ((groups, False), (min(groups, PROGRAM_GROUPS), True)):
        runs = whole + pack_small(pack_large(large, capacity, n, program), small, capacity)
        used = sum(count for count, _ in runs)
        if best is None or used < best[0]:
            best = used, runs
        if used <= least:  # no plan has fewer
            break
    return best[1]


def places(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, number after the last, first sequence, offset) for each run's parts."""
    seen: dict[int, int] = {}
    sequence, out = 0, []
    for n, inside in runs:
        offset = 0
        for length in inside:
            low = seen.get(length, 0)
            out.append((length, low, low + n, sequence, offset))
            seen[length] = low + n
            offset += length
        sequence += n
    return out


def numbered(pieces: DataFrame, histogram: DataFrame) -> DataFrame:
    """Add ``number``, which counts the pieces of each length from 0.

    A length with many pieces is split into salts, numbered apart, and the salts'
    counts are added up. Neither a salt nor the list of salts passes the root of a
    length's pieces by much. Salts follow ``row_id``, a number that each stored piece
    has of its own, so null or repeated ids and equal texts fall apart as well.
    """
    salts = histogram.select(F.col("length").alias("_length"), F.ceil(F.col("n") / F.greatest(F.lit(float(NUMBERED)), F.sqrt("n"))).alias("salts"))
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("_length")).drop("_length")  # a row per length: the capacity bounds it
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    bases = sizes.select(F.col("length").alias("_length"), F.col("salt").alias("_salt"), before.alias("base"))
    row = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row_id"))
    ranked = salted.withColumn("row", row)
    joined = ranked.join(bases, (F.col("length") == F.col("_length")) & (F.col("salt") == F.col("_salt")))
    return joined.select(*pieces.columns, (F.col("base") + F.col("row") - 1).alias("number"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = GROUPS, end_id: int = 1) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id).withColumn("row_id", F.monotonically_increasing_id()), "pieces")
    histogram = materialize(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in histogram.collect()}  # `capacity` rows at most
    rows = places(plan(counts, capacity, groups))
    table = spark.createDataFrame(rows, "_length bigint, low bigint, high bigint, sequence bigint, offset bigint")
    # a few rows per distinct length, whatever the number of documents
    table = F.broadcast(table) if len(rows) <= 50 * capacity else table
    fits = (F.col("length") == F.col("_length")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    placed = numbered(pieces, histogram).join(table, fits)
    return placed.select(*[c for c in pieces.columns if c != "row_id"], (F.col("sequence") + F.col("number") - F.col("low")).alias("sequence_id"), "offset")

"""Benchmark decontamination: MinHash containment search in size partitions.

Test items are short and documents long, so the question is containment: which
share of an item's distinct shingles (five alphanumeric words, A-Z lower-cased)
stands in a document.

1. Items of the same shingles are one. They are partitioned by the power of two
   of their number of shingles. The ``sketch`` smallest hashes of an item are its
   MinHash sketch; a partition's sizes set how many of them a document must hold
   (``needed``): all that an item of containment ``least`` holds but for a chance
   of ``miss``. Items no larger than the sketch are held whole, at no risk.
2. A document that holds ``needed`` of k hashes holds one of any k - needed + 1.
   Those that the fewest items share are an item's probes, so a shingle of many
   items joins few of them. Workers hold the probes as a bit map and, up to
   ``EXACT_KEYS`` of them, as sorted keys; a document without a probe is done with.
3. Of the others, texts (equal ones once) join the probes and give candidates,
   candidates the sketches, which leaves those with ``needed`` hashes, and only
   these are verified by counting shared shingles exactly, as strings.

Bit maps get ``MAP_BITS`` bits for a hash, up to a fixed size. Fuller ones, and
probes beyond ``EXACT_KEYS``, let more through to the joins and lose nothing.

Edge cases: an item with fewer than five words is one shingle of all its words;
an item without words, or a null text, never matches; documents with a null id
are reported with a null id; rows that repeat an id with different texts are
judged one by one, repeated rows give one result row; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import materialize

from .textops import alnum_words, map_batches, utf8, without_keys

WIDTH, LEAST = 5, 0.8
PAGE = 1 << 15
#: Bits of a map for a hash in it, the most bits of a map, and hashes up to which workers hold them all.
MAP_BITS, MOST_BITS, EXACT_KEYS = 64, 1 << 27, 2_000_000
WORD_CACHE = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """XXH64 of words, kept up to ``WORD_CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def gram_hashes(words: list[bytes], width: int, cache: WordHashes) -> np.ndarray:
    """A 63-bit hash of each run of ``width`` words."""
    if len(words) < width:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ one[i : i + n]) * ODD
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).astype(np.int64)


def needed(size: int, sketch: int, least: float, miss: float) -> int:
    """Sketch hashes that a document holding ``least`` of the item has, but for a chance of ``miss``."""
    held = math.ceil(least * size - 1e-9)
    k = min(size, sketch)
    if k == size:
        return held
    whole, tail = math.comb(size, k), 0.0
    for x in range(k + 1):
        tail += math.comb(held, x) * math.comb(size - held, k - x) / whole
        if tail > miss:
            return max(1, x)
    return k


def partition_needed(size_class: int, sketch: int, least: float, miss: float) -> int:
    """``needed`` for any size of a partition: it rises up to the sketch's size and falls beyond, so the ends decide."""
    return min(needed(n, sketch, least, miss) for n in (1 << size_class, (2 << size_class) - 1))


def item_grams(items: DataFrame, width: int, sketch: int, least: float, miss: float) -> DataFrame:
    """A row for each distinct shingle of each item: its item's key (of all its shingles), size partition and sketch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache, rows, wanted = WordHashes(), [], {}
        for item_id, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True):
            words = alnum_words(text)
            if not words:
                continue
            w = min(width, len(words))
            grams = {}
            for i, h in enumerate(gram_hashes(words, w, cache).tolist()):
                grams.setdefault(b" ".join(words[i : i + w]), h)
            smallest = set(sorted(grams.values())[:sketch])
            key = xxhash.xxh64_intdigest(b"\n".join(sorted(grams)), seed=42) - (1 << 63)
            size_class = len(grams).bit_length() - 1
            want = wanted.setdefault(size_class, partition_needed(size_class, sketch, least, miss))
            rows += [(item_id, key, g, h, w, h in smallest, len(grams), size_class, want) for g, h in grams.items()]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64()]
        names = ["item_id", "item_key", "gram", "h", "width", "in_sketch", "n_item", "size_class", "needed"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "item_id bigint, item_key bigint, gram binary, h bigint, width int, in_sketch boolean, n_item bigint, size_class int, needed bigint"
    return map_batches(items, ["item_id", "text"], run, schema).distinct()


def item_probes(grams: DataFrame) -> DataFrame:
    """(size_class, h, item_key, needed): of each item's sketch the hashes that the fewest items share, one of which a match holds."""
    shared = grams.groupBy("h").agg(F.count("*").alias("items"))
    sketches = grams.where("in_sketch").select("size_class", "h", "item_key", "needed").distinct()
    one = Window.partitionBy("item_key")  # a sketch at most
    ranked = sketches.join(shared, "h").withColumns({"k": F.count("*").over(one), "rank": F.row_number().over(one.orderBy("items", "h"))})
    return ranked.where(F.col("rank") <= F.col("k") - F.col("needed") + 1).select("size_class", "h", "item_key", "needed")


def bit_map(hashes: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """Which places some hash falls on; a power of two of places, ``most`` at most."""
    bits = min(most, max(PAGE, 1 << (MAP_BITS * hashes.count()).bit_length()))
    at = F.pmod(F.col("h"), F.lit(bits))
    pages = hashes.groupBy(F.expr(f"pmod(h, {bits}) div {PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(PAGE))).alias("bits"))
    out = np.zeros((bits // PAGE, PAGE // 8), np.uint8)
    for row in pages.toLocalIterator():  # most / 8 bytes in all at most
        out[row["page"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.ravel()


def exact_keys(hashes: DataFrame, most: int = EXACT_KEYS) -> np.ndarray | None:
    """The sorted distinct hashes, None if there are more than ``most``."""
    found = hashes.select("h").distinct().limit(most + 1).toPandas()["h"].to_numpy(np.int64)
    return np.sort(found) if len(found) <= most else None


def through(bits: np.ndarray, keys: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bit map, and the keys if there are any, let through."""
    at = h & (8 * len(bits) - 1)
    found = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
    if keys is None or not len(found):
        return found
    own = h[found]
    return found[keys[np.searchsorted(keys, own).clip(max=len(keys) - 1)] == own] if len(keys) else found[:0]


def probed_texts(docs: DataFrame, widths: list[int], probes: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc_id, doc_key, grams) of the rows that hold a probe; grams: all shingles that an item may have."""
    sides = [(bit_map(side), exact_keys(side)) for side in (probes, grams)]
    maps = docs.sparkSession.sparkContext.broadcast(sides)  # MOST_BITS / 8 and 8 * EXACT_KEYS bytes a side
    cache = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        in_probes, in_any = maps.value
        ids, keys, sizes, hashes, found = [], [], [0], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            words = alnum_words(text)
            by_width = [(w, gram_hashes(words, w, cache)) for w in widths]
            if not any(len(through(*in_probes, h)) for _, h in by_width):
                continue
            grams = {b" ".join(words[i : i + w]): int(h[i]) for w, h in by_width for i in through(*in_any, h).tolist()}
            ids.append(doc_id)
            keys.append(xxhash.xxh64_intdigest(text, seed=42))
            found += grams
            hashes += grams.values()
            sizes.append(len(found))
        inner = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], ["h", "gram"])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(keys, np.uint64).astype(np.int64)), lists], ["doc_id", "doc_key", "grams"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id bigint, doc_key bigint, grams array<struct<h:bigint,gram:binary>>")


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: float = LEAST, sketch: int = 64, miss: float = 1e-6) -> DataFrame:
    """Pairs (doc_id, doc_key, item_id) of containment ``least`` or more; doc_key is xxhash64 of the text."""
    rows = materialize(item_grams(items, width, sketch, least, miss), "item-grams")
    members = rows.select("item_id", "item_key").distinct()
    grams = materialize(rows.drop("item_id").distinct(), "item-classes")
    probes = materialize(item_probes(grams), "item-probes")
    widths = sorted(r["width"] for r in grams.select("width").distinct().collect())  # `width` rows at most
    passed = materialize(probed_texts(docs, widths, probes.select("h"), grams.select("h")), "probed-texts")

    held = passed.groupBy("doc_key").agg(F.first("grams").alias("grams"))  # equal texts have equal shingles
    held = materialize(held.select("doc_key", F.explode("grams").alias("g")).select("doc_key", "g.*"), "held-shingles")
    found = held.join(probes, "h").select("doc_key", "item_key", "needed").distinct()
    sketches = grams.where("in_sketch").select("item_key", "h")
    candidates = found.join(sketches, "item_key").join(held.select("doc_key", "h").distinct(), ["doc_key", "h"])
    candidates = candidates.groupBy("doc_key", "item_key", "needed").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("needed"))
    candidates = materialize(candidates.select("doc_key", "item_key"), "leak-candidates")
    shared = candidates.join(grams.select("item_key", "gram", "n_item", "size_class"), "item_key").join(held.select("doc_key", "gram"), ["doc_key", "gram"])
    counted = shared.groupBy("doc_key", "item_key", "n_item", "size_class").agg(F.count("*").alias("n_shared"))
    verified = counted.where(F.col("n_shared") >= least * F.col("n_item") - 1e-9).join(members, "item_key")
    named = passed.select("doc_id", "doc_key").distinct().join(verified, "doc_key")
    best = F.max_by(F.struct("n_item", "n_shared", "size_class"), F.struct(F.col("n_shared") / F.col("n_item"), "item_key")).alias("best")
    return named.groupBy("doc_id", "doc_key", "item_id").agg(best).select(
        "doc_id", "doc_key", "item_id", "best.n_item", "best.n_shared", "best.size_class", (F.col("best.n_shared") / F.col("best.n_item")).alias("containment")
    )


def drop_leaking(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text leaks no item."""
    return without_keys(docs, [F.xxhash64(docs["text"])], leaks(docs, items, **options).select("doc_key"))

"""SimHash near-dedup by pigeonhole blocks.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; shingles of three words
are hashed with XXH64 (seed 42), and a bit of the fingerprint is set where more
than half of the hashes have it. The 64 bits are split into six blocks. Two
fingerprints within three bits agree on three blocks at least, so each distinct
fingerprint is filed under all 20 choices of three blocks; rows that share a key
are verified by Hamming distance and give the edges of a spanning forest, never
all pairs. A bucket of more than ``BUCKET`` fingerprints is not gathered: its
rows are filed again under the blocks of their remaining bits, and after three
such steps at most 2**14 fingerprints can share a key. Components come from
alternating large and small stars, each round a table in the shared folder.

Equal fingerprints form one class from the start, so groups of copies cost one
row. Edge cases: texts without words, null included, have fingerprint zero and
link like any other; a text of one or two words is one shingle; null ids belong
to their class but never name it; a component of null ids alone has a null
``component_id``; other columns are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialize

from .textops import BROADCAST_KEYS, map_batches, matched, utf8, without_keys

NEAR, WIDTH, SEED = 3, 3, 42
BUCKET = 1 << 14
BLOCKS = (11, 11, 11, 11, 10, 10)


def fingerprint(text: bytes) -> int:
    """The SimHash of a text, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words))
    ends = (ends + 1).cumsum() - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(WIDTH, len(words))
    digest = xxhash.xxh64_digest
    hashes = [digest(flat[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.frombuffer(b"".join(hashes[i : i + (1 << 14)]), np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t) for t in utf8(batch.column("text"))], pa.int64())], ["doc_id", "fp"])

    return map_batches(docs, ["doc_id", "text"], run, "doc_id bigint, fp bigint")


def block_masks() -> list[int]:
    """Signed masks of every choice of three blocks."""
    at, blocks = 0, []
    for size in BLOCKS:
        blocks.append(((1 << size) - 1) << at)
        at += size
    return [m - (1 << 64) if m >> 63 else m for m in (a | b | c for a, b, c in combinations(blocks, 3))]


def finer_masks(mask: int) -> list[int]:
    """The mask with each of four blocks of its zero bits added: three differing bits spare one block."""
    free = [i for i in range(64) if not mask >> i & 1]
    out = []
    for part in np.array_split(free, NEAR + 1):
        m = (mask & ((1 << 64) - 1)) | sum(1 << int(i) for i in part)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def tree_edges(bucket: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    rest, edges = bucket.view(np.uint64), []  # bitwise_count drops the sign of signed numbers
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= NEAR
            if near.any():
                got = rest[near]
                edges += [(int(x.view(np.int64)), y) for y in got.view(np.int64).tolist()]
                queue.extend(got)
                rest = rest[~near]
    return edges


def link_buckets(batches: Iterator[pa.RecordBatch], size: int = BUCKET) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: edges (mask null, a, b), or finer rows (mask, key, fp) of large buckets."""
    held: list[np.ndarray] = []  # the open bucket, up to `size` fingerprints
    count, open_key, large = 0, None, False

    def rows(mask, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(mask, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["mask", "a", "b"])

    def finer(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for m in finer_masks(int(open_key[0])):
            yield rows(np.full(len(fps), m), fps & np.int64(m), fps)

    def close() -> Iterator[pa.RecordBatch]:
        if not large and count > 1:
            edges = tree_edges(np.concatenate(held))
            if edges:
                a, b = zip(*edges, strict=True)
                yield rows([None] * len(edges), a, b)

    for batch in batches:
        mask, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "a", "b"))
        if not len(fp):
            continue
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
        # buckets of one row that neither begin nor end the batch link nothing
        use = (stops - starts > 1) | (starts == 0) | (stops == len(fp))
        for i, j in zip(starts[use].tolist(), stops[use].tolist(), strict=True):
            this = (mask[i], key[i])
            if this != open_key:
                yield from close()
                held, count, open_key, large = [], 0, this, False
            part = fp[i:j]
            if not large and count + len(part) > size:
                large = True
                for old in held:
                    yield from finer(old)
                held = []
            if large:
                yield from finer(part)
            else:
                held.append(part)
                count += len(part)
    yield from close()


def links(classes: DataFrame, size: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect what distinct fingerprints ``fp`` within three bits connect."""
    masks = F.array(*[F.lit(m) for m in block_masks()])
    rows = classes.select(F.explode(masks).alias("mask"), F.col("fp").alias("b")).select("mask", F.col("mask").bitwiseAND(F.col("b")).alias("a"), "b")
    found = None
    for level in range(4):
        limit = size if level < 3 else 1 << 62  # 51 fixed bits leave 2**13 fingerprints to a bucket
        sorted_rows = rows.repartition("mask", "a").sortWithinPartitions("mask", "a", "b")
        made = materialize(sorted_rows.mapInArrow(lambda b, n=limit: link_buckets(b, n), "mask bigint, a bigint, b bigint"), "simhash-links")
        edges = made.where(F.col("mask").isNull()).select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        rows = made.where(F.col("mask").isNotNull())
        if rows.isEmpty():
            break
    return found.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for every node of an edge but the roots, by large and small stars."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(high.alias("u"), low.alias("v")).distinct(), "components")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labelled_classes(prints: DataFrame, first: Column, bucket: int = BUCKET) -> DataFrame:
    """(fp, first) for each distinct fingerprint: the least ``first`` of its component."""
    classes = prints.groupBy("fp").agg(F.min(first).alias("first"))
    roots = components(links(classes, bucket))
    rooted = classes.join(roots, classes["fp"] == roots["u"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return materialize(rooted.drop("first").join(named, "root").select("fp", "first"), "simhash-classes")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    prints = materialize(fingerprints(docs), "fingerprints")
    label = labelled_classes(prints, F.col("doc_id"), bucket)
    return prints.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row of each component, all columns unchanged: that of the smallest id and, of rows that share it, of the smallest text hash.

    Rows that repeat both id and text are the same document, and the least of them
    in all columns stays; rows that share an id alone are judged one by one. Rows
    with a null id can't be named and stay. Decisions are made on ids and hashes;
    texts move only where the rows to drop are too many to broadcast.
    """
    text_key = F.xxhash64("text").alias("text_key")
    prints = map_batches(docs.select("doc_id", "text", text_key), ["doc_id", "text", "text_key"], _keyed_prints, "doc_id bigint, text_key bigint, fp bigint")
    prints = materialize(prints.where(F.col("doc_id").isNotNull()), "fingerprints")
    label = labelled_classes(prints, F.struct("doc_id", "text_key"))
    rows = prints.groupBy("doc_id", "text_key", "fp").agg(F.count("*").alias("n")).join(label, "fp")
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    rows = materialize(rows.select("doc_id", "text_key", "n", first.alias("first")), "near-duplicates")
    keys = lambda df: [df["doc_id"], F.xxhash64(df["text"])]
    kept = without_keys(docs, keys(docs), rows.where(~F.col("first")).select("doc_id", "text_key"), broadcast_keys)
    again = materialize(rows.where("first AND n > 1").select("doc_id", "text_key"), "repeated-rows")
    if again.isEmpty():
        return kept
    once = without_keys(kept, keys(kept), again, broadcast_keys)
    more = matched(kept, keys(kept), again, "left_semi", broadcast_keys)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = more.groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key")).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return once.unionByName(least)


def _keyed_prints(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints = pa.array([fingerprint(t) for t in utf8(batch.column("text"))], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), prints], ["doc_id", "text_key", "fp"])

"""MinHash near-dedup by an LSH forest, with links confirmed on whole shingle sets.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document's set is that
of its distinct two-word shingles; a single word is a shingle of its own. Documents
link where 100 * |A and B| >= 80 * |A or B|.

1. Documents of equal sets are one class, so groups of copies cost one row.
2. A class has ``HASHES`` minimum hashes. Each of ``TREES`` orders sorts the classes
   by its own sequence of them; those that agree on the first ``DEPTH`` form a region,
   the nearest by longest common prefix. Where a region has more than ``REGION``
   classes, depth adapts: its rows are sorted again, in ``BRANCHES`` orders of further
   hashes, up to ``LEVELS`` times. A link of similarity 0.8 shares no region with a
   chance of about (1 - 0.8**3)**20 = 6e-7; longer prefixes lose little, as each has
   several orders again.
3. Within a region, one-bit sketches of 128 of the hashes and the sizes of the sets
   choose pairs (five standard deviations below what 0.8 gives), and a spanning forest
   of these is kept. A region that is still too large at the last level is taken to
   be connected as a whole. The components, ``groups``, hold all links within them.
4. The sets of classes in groups are read again, and links are confirmed on them.
   A group is cut into chunks of about ``WEIGHT`` shingles by hash. Links within the
   chunks are followed first, then those among one class of each component so
   found; what is still outside its group's largest component then meets every
   chunk. So no pair is left out, no task has more than two chunks, and a group
   that is truly near-equal costs little more than one comparison a class.

Shingles are known by 63 bits of hash, sets by 128. Components come from alternating
large and small stars.

Edge cases: a null text, or one without words, has an empty set, links with nothing
and is its own component; null ids belong to their class but never name it; a
component of null ids alone has a null ``component_id`` and its rows are kept; rows
that repeat an id are judged by their own text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialize

from .decontaminate import ODD, WordHashes, gram_hashes
from .simhash import components
from .textops import map_batches, matched, small_side, utf8

WIDTH, LEAST, OUT_OF = 2, 80, 100
HASHES, TREES, DEPTH = 128, 20, 3
REGION, BRANCHES, LEVELS = 1 << 13, 6, 3
#: Shingles of a chunk of a group.
WEIGHT = 1 << 15
#: Bits in which the sketches of a pair of similarity 0.8 differ at most: a tenth of 128 and five standard deviations.
FAR = 30
PART = 1 << 13

_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def picks(seed: int, orders: int, depth: int = DEPTH) -> np.ndarray:
    """For each order the places of its hashes, no place twice in an order."""
    rng = np.random.default_rng(seed)
    return np.array([rng.permutation(HASHES)[:depth] for _ in range(orders)])


def shingles(text: bytes, cache: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    return np.unique(gram_hashes(words, min(WIDTH, len(words)), cache)) if words else np.zeros(0, np.int64)


def set_key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """The upper halves of the least values of ``HASHES`` multiply-add functions."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), PART):
        part = grams[at : at + PART].astype(np.uint64)
        part = (part ^ (part >> np.uint64(31))) * ODD
        part ^= part >> np.uint64(29)
        np.minimum(least, (part * MULTIPLY[:, None] + ADD[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def region_keys(hashes: np.ndarray, places: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A key for each order: its seed (the order, or the region it refines) mixed with the hashes at its places."""
    key = (seeds.astype(np.uint64) + np.uint64(1)) * ODD
    for column in places.T:
        key = (key ^ hashes[column].astype(np.uint64)) * ODD
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit of each hash, as two integers."""
    mixed = (hashes.astype(np.uint64) * ODD) >> np.uint64(63)
    return np.packbits(mixed.astype(np.uint8)).view(np.int64)


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, set_key, hashes) for every row; the last two are null for empty sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache, counts, keys, minima = WordHashes(), [], [], []
        for text in utf8(batch.column("text")):
            grams = shingles(text, cache)
            counts.append(len(grams))
            keys.append(set_key(grams) if len(grams) else None)
            minima.append(min_hashes(grams).tobytes() if len(grams) else None)
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "set_key", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return map_batches(rows, ["doc_id", "text", "text_key"], run, "doc_id bigint, text_key bigint, n bigint, set_key binary, hashes binary")


ROWS = "region bigint, cid bigint, n bigint, s0 bigint, s1 bigint"


def planted(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """A row for each class and order: its region and sketch."""
    places, seeds = picks(1, trees), np.arange(trees)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [np.frombuffer(h, np.uint32) for h in batch.column("hashes").to_pylist()]
        return _rows(batch, [region_keys(h, places, seeds) for h in hashes], hashes)

    return map_batches(classes, ["cid", "n", "hashes"], run, ROWS)


def replanted(rows: DataFrame, level: int, branches: int = BRANCHES) -> DataFrame:
    """From (region, cid, n, hashes): the rows of a region under finer keys of several orders."""
    places, own = picks(1 + level, branches), np.arange(branches)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [np.frombuffer(h, np.uint32) for h in batch.column("hashes").to_pylist()]
        regions = batch.column("region").to_numpy()
        return _rows(batch, [region_keys(h, places, own + r) for h, r in zip(hashes, regions, strict=True)], hashes)

    return map_batches(rows, ["region", "cid", "n", "hashes"], run, ROWS)


def _rows(batch: pa.RecordBatch, keys: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    each = len(keys[0]) if keys else 0
    sketches = np.array([sketch(h) for h in hashes]).reshape(-1, 2)
    spread = lambda x: pa.array(np.repeat(x, each), pa.int64())
    columns = [pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()), spread(batch.column("cid").to_numpy()), spread(batch.column("n").to_numpy()), spread(sketches[:, 0]), spread(sketches[:, 1])]
    return pa.RecordBatch.from_arrays(columns, ["region", "cid", "n", "s0", "s1"])


def like(sizes: np.ndarray, sketches: np.ndarray, i: int) -> np.ndarray:
    """Which sets may reach the similarity with set ``i``, by size and sketch."""
    near = np.bitwise_count((sketches ^ sketches[i]).view(np.uint64)).sum(axis=1) <= FAR
    return near & (OUT_OF * np.minimum(sizes, sizes[i]) >= LEAST * np.maximum(sizes, sizes[i]))


def forest_edges(ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """The components of the pairs that may link, each as links of its least id with the others."""
    rest, edges = np.arange(len(ids)), []
    while len(rest) > 1:
        tree, queue, rest = [rest[0]], [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = like(sizes[np.append(rest, x)], sketches[np.append(rest, x)], -1)[:-1]
            if near.any():
                tree += rest[near].tolist()
                queue += rest[near].tolist()
                rest = rest[~near]
        if len(tree) > 1:
            own = ids[tree]
            edges += [(int(own.min()), y) for y in own.tolist() if y != own.min()]
    return edges


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            key = tuple(c[i] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def region_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by region: the pairs (a, b) that may link, as forests; single rows are passed over in blocks."""
    for table in runs(_crowded(batches), ("region",)):
        if table.num_rows > 1:
            column = lambda name: table.column(name).to_numpy()  # noqa: B023, E731
            edges = forest_edges(column("cid"), column("n"), np.stack([column("s0"), column("s1")], axis=1))
            if edges:
                yield _edge_batch(edges)


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows that are alone in their region, but for those at a batch's ends."""
    for batch in batches:
        region = batch.column("region").to_numpy()
        if len(region):
            same = np.concatenate([[True], region[1:] == region[:-1], [True]])
            yield batch.filter(pa.array(same[1:] | same[:-1]))


def grouped(classes: DataFrame, trees: int = TREES, region: int = REGION, levels: int = LEVELS, branches: int = BRANCHES) -> DataFrame:
    """(cid, group) of the classes that may link with others; all links lie within groups."""
    rows, found = materialize(planted(classes, trees), "forest-rows"), None
    for level in range(levels + 1):
        large = rows.groupBy("region").agg(F.count("*").alias("size"), F.min("cid").alias("first")).where(F.col("size") > region)
        large = small_side(large.select("region", "first"), "forest-large")
        some = not large.isEmpty()
        fitting = rows.join(large, "region", "left_anti") if some else rows
        ordered = fitting.repartition("region").sortWithinPartitions("region")
        edges = ordered.mapInArrow(region_edges, "a bigint, b bigint").distinct()
        found = edges if found is None else found.unionByName(edges)
        if not some:
            break
        crowded = rows.join(large, "region")
        if level == levels:
            found = found.unionByName(crowded.select(F.col("first").alias("a"), F.col("cid").alias("b")))
        else:
            rows = materialize(replanted(crowded.select("region", "cid").join(classes, "cid"), level + 1, branches), "forest-rows")
    tree = components(materialize(found.distinct(), "forest-edges"))
    return tree.select(F.col("u").alias("cid"), F.col("root").alias("group")).unionByName(tree.select(F.col("root").alias("cid"), F.col("root").alias("group"))).distinct()


class Sets:
    """Sets of integers, one after another, with all values numbered."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.ends = self.sizes.cumsum()
        values, self.flat = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.sizes[i] : self.ends[i]]

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose similarity with set ``i`` is enough."""
        own = self.of(i)
        self.mark[own] = True
        shared = np.fromiter((np.count_nonzero(self.mark[self.of(j)]) for j in others.tolist()), np.int64, len(others))
        self.mark[own] = False
        return others[OUT_OF * shared >= LEAST * (self.sizes[i] + self.sizes[others] - shared)]


def link(table: pa.Table) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """From rows (cid, part, probe, sketch, grams): the part of each row after all confirmed links, and links that join parts.

    Every row of ``probe`` meets all rows that are not yet in its part; a part is named by the least of those it was made of.
    """
    ids, part = table.column("cid").to_numpy(), table.column("part").to_numpy().copy()
    sketches = np.stack([table.column("s0").to_numpy(), table.column("s1").to_numpy()], axis=1)
    sets, edges = Sets([np.frombuffer(g, np.int64) for g in table.column("grams").to_pylist()]), []
    for i in np.flatnonzero(table.column("probe").to_numpy(zero_copy_only=False)).tolist():
        others = np.flatnonzero((part != part[i]) & like(sets.sizes, sketches, i))
        near = sets.linked(i, others) if len(others) else others
        if len(near):
            met, first = np.unique(part[near], return_index=True)  # one link to each part is enough
            edges += [(int(ids[i]), x) for x in ids[near[first]].tolist()]
            met = np.append(met, part[i])
            part[np.isin(part, met)] = met.min()
    return part, edges


def _dealt(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.select(*keys, "cid", "part", "probe", "s0", "s1", "grams").repartition(*keys).sortWithinPartitions(*keys)


def _parts(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(cid, part) after the links among the rows of each key, which begin as parts of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            yield pa.RecordBatch.from_arrays([table.column("cid").combine_chunks(), pa.array(link(table)[0])], ["cid", "part"])

    own = rows.withColumns({"part": F.col("cid"), "probe": F.lit(True)})
    return _dealt(own, keys).mapInArrow(run, "cid bigint, part bigint")


def _edges(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Links (a, b) of the probes of each key with rows of other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            if edges := link(table)[1]:
                yield _edge_batch(edges)

    return _dealt(rows, keys).mapInArrow(run, "a bigint, b bigint")


def confirmed(members: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """Links (a, b) that connect what all links within groups connect.

    ``members`` has (group, cid, n, s0, s1, grams).
    """
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    among = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n))
    totals = members.groupBy("group").agg(F.ceil(F.sum("n") / weight).alias("chunks"))
    members = materialize(members.join(totals, "group").withColumn("chunk", among("chunks", 0)), "forest-members")
    first = materialize(_parts(members, ("group", "chunk")), "forest-parts")
    found = first.where("cid <> part").select(F.col("part").alias("a"), F.col("cid").alias("b"))
    large = members.where("chunks > 1")
    if large.isEmpty():
        return found
    heads = large.join(first.where("cid = part").select("cid"), "cid", "left_semi")
    pools = heads.groupBy("group").agg(F.ceil(F.sum("n") / weight).alias("pools"))
    second = materialize(_parts(heads.join(pools, "group").withColumn("pool", among("pools", 1)), ("group", "pool")), "forest-parts")
    found = found.unionByName(second.where("cid <> part").select(F.col("part").alias("a"), F.col("cid").alias("b")))
    named = large.join(first, "cid").join(second.select(F.col("cid").alias("part"), F.col("part").alias("now")), "part").drop("part").withColumnRenamed("now", "part")
    named = materialize(named, "forest-members")
    sizes = named.groupBy("group", "part").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    main = sizes.groupBy("group").agg(F.max(F.struct("size", "part", "weight")).alias("main"), F.sum("weight").alias("total"))
    outside = main.select("group", F.col("main.part").alias("main"), F.ceil((F.col("total") - F.col("main.weight")) / weight).alias("blocks")).where("blocks > 0")
    outside = materialize(outside, "forest-outside")
    if outside.isEmpty():
        return found
    joined = named.join(outside, "group")
    at_home = joined.withColumns({"block": upto("blocks"), "probe": F.lit(False)})
    visiting = joined.where(F.col("part") != F.col("main")).withColumn("block", among("blocks", 2)).withColumns({"chunk": upto("chunks"), "probe": F.lit(True)})
    columns = ["group", "chunk", "block", "cid", "part", "probe", "s0", "s1", "grams"]
    return found.unionByName(_edges(at_home.select(*columns).unionByName(visiting.select(*columns)), ("group", "chunk", "block")))


def sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(set_key, s0, s1, grams) of the classes in ``members`` (doc_id, text_key of one row of each, set_key)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = WordHashes()
        sets = [shingles(t, cache) for t in utf8(batch.column("text"))]
        sketches = np.array([sketch(min_hashes(s)) for s in sets]).reshape(-1, 2)
        columns = [pa.array([set_key(s) for s in sets], pa.binary()), pa.array(sketches[:, 0]), pa.array(sketches[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["set_key", "s0", "s1", "grams"])

    own = matched(docs.select("doc_id", "text"), [F.col("doc_id"), F.xxhash64("text")], members.select("doc_id", "text_key"), "left_semi")
    return map_batches(own, ["text"], run, "set_key binary, s0 bigint, s1 bigint, grams binary").dropDuplicates(["set_key"])


def near_duplicates(docs: DataFrame, trees: int = TREES, region: int = REGION, levels: int = LEVELS, branches: int = BRANCHES, weight: int = WEIGHT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    rows = materialize(prints(docs), "forest-prints")
    of_set = rows.where(F.col("set_key").isNotNull()).groupBy("set_key", "n")
    classes = of_set.agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("hashes").alias("hashes"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "set_key", "n", "first", "row", "hashes"), "forest-classes")
    groups = materialize(grouped(classes.select("cid", "n", "hashes"), trees, region, levels, branches), "forest-groups")
    members = materialize(groups.join(classes, "cid").select("group", "cid", "n", "set_key", "row.doc_id", "row.text_key"), "forest-members")
    sets = sets_of(docs, members)
    links = materialize(confirmed(members.select("group", "cid", "n", "set_key").join(sets, "set_key"), weight), "forest-links")
    rooted = classes.join(components(links).withColumnRenamed("u", "cid"), "cid", "left").select("set_key", F.coalesce("root", "cid").alias("root"), "first")
    rooted = materialize(rooted, "forest-roots")
    named = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "forest-names")  # stored, so that the join can split a large component
    label = rooted.join(named, "root")
    told = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(label.select("set_key", "component_id"), "set_key", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return told.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

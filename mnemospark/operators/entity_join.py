"""All entities with all by hybrid similarity, from an index for each part.

The similarity is a weighted mean of cosine, name, type and observations, over the
weights in use (``search.hybrid_similarity``): no vector weight unless both have one,
no observation weight unless one has some, the type's weight only where types are
equal. A mean of ``least`` or more has a part of ``least`` or more, and what remains
when parts below it are left out still has that mean. So a pair is met by one of

* vectors: a cosine of ``least`` or more; blocks of rows are broadcast and meet the
  cells around pivots that hold one near enough, by the triangle inequality,
* observations: a Jaccard similarity of ``least`` or more, by prefix filter over the
  distinct sets,
* names: else the name and an equal type alone must reach the mean, which bounds the
  name from below; pairs of distinct names come from ``search.similar_names``. If
  both can't reach it without observations, the pair shares one, or neither has any.

Each meeting place of the last two (a pair of sets, a pair of names and an observation)
is cut into blocks of ``BLOCK`` rows on either side, and tasks compare block with block,
as matrices, names included. A pair is told by the first way that meets it, at the
least observation it shares, so that only links leave a task, and hardly any twice. No
place is gathered whole, and nothing is left out.

Entities that agree in all parts are one class, named by the smallest id. Edge cases:
null names and types are empty; null or empty observations are none, equal ones count
once, lower-cased; null vectors are none; vectors of unlike length or of length zero
have cosine 0; ids are distinct and not null (rows with a null id take no part).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import pivots, retrieval, search
from mnemospark.session import materialize

COSINE, NAME, TYPE, NOTES = 0.4, 0.25, 0.15, 0.2
BLOCK = 1024
#: Rows of a broadcast block.
SENT = 16_384
NEAR = 1e-6


def least_name(least: float) -> float:
    """What a name must reach where cosine and observations stay below ``least``."""
    return (least * (NAME + TYPE) - TYPE) / NAME


def entity_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (id, name, entity_type, notes, vector), and (a, b) of the other members of each."""
    none = F.array().cast("array<string>")
    notes = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("observations", none), lambda o: o.isNotNull()), lambda o: F.lower(o))))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    vector = F.col("embedding") if dict(rows.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    own = rows.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), text("name"), text("entity_type"), notes.alias("notes"), vector.alias("vector"))
    parts = ["name", "entity_type", "notes", "vector"]
    classes = materialize(own.groupBy(*parts).agg(F.min("id").alias("a")).select(F.col("a").alias("id"), *parts), "entity-classes")
    same = F.lit(True)
    for p in parts:
        same = same & own[p].eqNullSafe(classes[p])
    members = own.join(classes.withColumnRenamed("id", "a"), same).where(own["id"] != F.col("a")).select("a", own["id"].alias("b"))
    return classes, members


def _dealt(home: DataFrame, visitors: DataFrame, block: int) -> DataFrame:
    """Rows of both sides of each ``place`` under (place, i, j): every block of one side with every block of the other."""
    count = lambda side, name: side.groupBy("place").agg(F.ceil(F.count("*") / block).alias(name))
    sizes = materialize(count(home, "n_i").join(count(visitors, "n_j"), "place"), "place-sizes")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    kept = ("ordered", "mark", "id")
    left = home.join(sizes, "place").select("place", own("n_i").alias("i"), upto("n_j").alias("j"), F.lit(0).alias("side"), *kept)
    right = visitors.join(sizes, "place").select("place", upto("n_i").alias("i"), own("n_j").alias("j"), F.lit(1).alias("side"), *kept)
    return left.unionByName(right)


def edit_distances(one: list[str], two: list[str]) -> np.ndarray:
    """Levenshtein distances of texts, pair by pair, all pairs at once."""
    points = lambda texts: [np.fromiter(map(ord, t), np.int32, len(t)) for t in texts]
    n = len(one)
    sides = []
    for texts in (points(one), points(two)):
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.zeros((int(sizes.max(initial=0)), n), np.int32)
        for i, t in enumerate(texts):
            codes[: len(t), i] = t
        sides.append((codes, sizes))
    (a, la), (b, lb) = sides
    row = np.repeat(np.arange(len(b) + 1, dtype=np.int32)[:, None], n, axis=1)
    out = np.where(la == 0, lb, 0)
    for i in range(len(a)):
        new = np.empty_like(row)
        new[0] = i + 1
        for j in range(len(b)):
            new[j + 1] = np.minimum(np.minimum(new[j], row[j + 1]) + 1, row[j] + (a[i] != b[j]))
        row = new
        done = np.flatnonzero(la == i + 1)
        out[done] = row[lb[done], done]
    return out


class Part:
    """One side of a block pair."""

    def __init__(self, rows: pa.Table) -> None:
        column = lambda c: rows.column(c).combine_chunks()
        self.ids = rows.column("id").to_numpy()
        self.kinds = rows.column("kind").to_numpy()
        self.sizes = np.asarray(column("notes").value_lengths().to_numpy(zero_copy_only=False))
        self.notes = column("notes").flatten().to_numpy()
        names = column("name").dictionary_encode()
        self.texts, self.called = names.dictionary.to_pylist(), names.indices.to_numpy()
        lists = column("vector")
        self.has = ~np.asarray(lists.is_null())
        self.width = np.where(self.has, np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), -1)
        self.lists = lists

    @functools.cached_property
    def vectors(self) -> np.ndarray:
        return pivots.as_matrix(self.lists)

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        return np.sqrt((self.vectors * self.vectors).sum(axis=1))

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.ids), len(values)), np.float32)
        out[np.repeat(np.arange(len(self.ids)), self.sizes), np.searchsorted(values, self.notes)] = 1
        return out


def same_names(a: Part, b: Part, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of the names of rows ``x`` and ``y``, each pair of names once."""
    pairs, of = np.unique(a.called[x].astype(np.int64) * len(b.texts) + b.called[y], return_inverse=True)
    score = np.zeros(len(pairs))
    for low in range(0, len(pairs), 1 << 14):
        one, two = [a.texts[p] for p in pairs[low : low + (1 << 14)] // len(b.texts)], [b.texts[p] for p in pairs[low : low + (1 << 14)] % len(b.texts)]
        la, lb = np.array([len(t) for t in one]), np.array([len(t) for t in two])
        score[low : low + len(one)] = np.where((la > 0) & (lb > 0), 1 - edit_distances(one, two) / np.maximum(1, np.maximum(la, lb)), 0)
    return score[of]


@functools.lru_cache(1 << 16)
def name_similarity(one: str, two: str) -> float:
    """Similarity of two names, which many block pairs share."""
    return 1 - int(edit_distances([one], [two])[0]) / max(len(one), len(two)) if one and two else 0.0


def likely(a: Part, b: Part, shared: np.ndarray, least: float) -> np.ndarray:
    """Pairs whose mean may reach ``least`` with a cosine below it, by the name of either side and what observations they share."""
    called = name_similarity(a.texts[0], b.texts[0]) if len(a.texts) == len(b.texts) == 1 else 1.0
    sizes = a.sizes.astype(np.float32)[:, None], b.sizes.astype(np.float32)
    room = 1e-4 + NEAR * (sizes[0].max() + sizes[1].max())  # for rounding

    def reach(kind: float) -> np.ndarray:
        need = (least * (NAME + kind + NOTES) - kind - NAME * called) / NOTES - 8 * NEAR  # what their Jaccard similarity must reach
        return shared * np.float32(1 + need) >= (np.float32(need) * sizes[0] - np.float32(room)) + np.float32(need) * sizes[1]

    out = reach(TYPE)
    return out & (reach(0) | (a.kinds[:, None] == b.kinds)) if out.any() else out  # other types need more


def products(a: Part, b: Part, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows ``x`` and ``y``, pair by pair."""
    va, vb = pivots.same_width(a.vectors, b.vectors)
    out = np.zeros(len(x))
    for low in range(0, len(x), 1 << 14):
        out[low : low + (1 << 14)] = np.einsum("ij,ij->i", va[x[low : low + (1 << 14)]], vb[y[low : low + (1 << 14)]])
    return out


def linked(a: Part, b: Part, least: float, route: str, ordered: bool, mark: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and scores of the pairs that are ``least`` alike and whose first way is ``route``.

    ``ordered``: both sides hold both rows of a pair, so the smaller id must be in ``a``.
    ``mark``: the observation that the place is for.
    """
    values = np.unique(np.concatenate([a.notes, b.notes]))
    notes_a, notes_b = a.holds(values), b.holds(values)
    shared = notes_a @ notes_b.T
    some = likely(a, b, shared, least) if mark is not None else None
    if some is not None and np.count_nonzero(some) * 16 < some.size:  # pair by pair, as few are left
        x, y = np.divmod(np.flatnonzero(some), len(b.ids))
        dots = products(a, b, x, y)
    else:
        x, y = np.arange(len(a.ids))[:, None], np.arange(len(b.ids))[None, :]
        va, vb = pivots.same_width(a.vectors, b.vectors)
        dots = va @ vb.T
    if not dots.size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    shared = shared[x, y].astype(np.float64)
    union = a.sizes[x] + b.sizes[y] - shared
    jaccard = shared / np.maximum(union, 1)
    scale = a.lengths[x] * b.lengths[y]
    cosine = np.where((scale > 0) & (a.width[x] == b.width[y]), dots / np.maximum(scale, 1e-300), 0)
    both = a.has[x] & b.has[y]
    same = a.kinds[x] == b.kinds[y]
    rest = COSINE * both * cosine + TYPE * same + NOTES * jaccard
    weight = COSINE * both + NAME + TYPE * same + NOTES * (union > 0)
    enough = rest + NAME >= (least - NEAR) * weight
    if ordered:
        enough &= a.ids[x] < b.ids[y]
    if route == "vectors":
        enough &= cosine >= least - NEAR
    else:
        enough &= cosine < least + NEAR
        enough &= (jaccard >= least - NEAR) if route == "notes" else (jaccard < least + NEAR)
    at = np.nonzero(enough)
    rest, weight, x, y = rest[at], weight[at], np.broadcast_to(x, enough.shape)[at], np.broadcast_to(y, enough.shape)[at]
    if mark is not None and len(x):
        own = [values[(notes_a[x[low : low + 4096]] * notes_b[y[low : low + 4096]]).argmax(axis=1)] == mark for low in range(0, len(x), 4096)]
        rest, weight, x, y = (some[np.concatenate(own)] for some in (rest, weight, x, y))
    score = (rest + NAME * same_names(a, b, x, y)) / weight
    kept = (score >= least - 1e-9) & (a.ids[x] != b.ids[y])
    x, y = x[kept], y[kept]
    return np.minimum(a.ids[x], b.ids[y]), np.maximum(a.ids[x], b.ids[y]), score[kept]


LINK = "a bigint, b bigint, score double"


def _links(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(found[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[low : low + (1 << 16)]) for c in found], ["a", "b", "score"])


def block_links(batches: Iterator[pa.RecordBatch], least: float, route: str) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (place, i, j): the links of each block pair."""
    held: list[pa.RecordBatch] = []
    last = None

    def close() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        side = rows.column("side").to_numpy()
        if side.any() and not side.all():
            a, b = Part(rows.filter(pa.array(side == 0))), Part(rows.filter(pa.array(side == 1)))
            yield from _links(linked(a, b, least, route, rows.column("ordered")[0].as_py(), rows.column("mark")[0].as_py()))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("place", "i", "j")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for low, high in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            key = tuple(k[low] for k in keys)
            if held and key != last:
                yield from close()
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield from close()


def _place(*parts: Column | str) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def near_pairs(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two matrices of unit vectors whose cosine may be ``least`` or more: single floats, with room for their rounding."""
    a, b = pivots.same_width(a, b)
    room = NEAR + 2e-7 * (a.shape[1] + 8)
    return np.divmod(np.flatnonzero(a @ b.T >= np.float32(least - room)), len(b))


def cell_links(batches: Iterator[pa.RecordBatch], own: pa.Table, unit: np.ndarray, home: np.ndarray, gap: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Links of a broadcast block (rows, unit vectors, cells, distances to pivots) with placed rows sorted by cell.

    All pairs only take a product; the few near ones are scored. Those of two cells are
    told from the row of the lesser cell.
    """
    far = np.sqrt(2 - 2 * least + 4 * NEAR) + NEAR
    own_ids = own.column("id").to_numpy()
    for batch in batches:
        cells, reach = batch.column("cell").to_numpy(), batch.column("reach").to_numpy()
        rows, vectors = pa.Table.from_struct_array(batch.column("key")), pivots.as_matrix(batch.column("vector")).astype(np.float32)
        ids = rows.column("id").to_numpy()
        cut = (np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist()
        for low, high in zip([0, *cut], [*cut, len(cells)], strict=True):
            for start in range(low, high, pivots.STRETCH):
                stop = min(start + pivots.STRETCH, high)
                g = gap[:, cells[start]]
                asked = np.flatnonzero((home <= cells[start]) & (g <= reach[start:stop].max() + far) & (g >= reach[start:stop].min() - far))
                for some in np.split(asked, range(4096, len(asked), 4096)):
                    x, y = near_pairs(unit[some], vectors[start:stop], least)
                    within = home[some[x]] == cells[start]
                    for ordered, told in ((True, within & (own_ids[some[x]] < ids[start + y])), (False, ~within)):
                        if told.any():
                            a, b = Part(own.take(pa.array(some[np.unique(x[told])]))), Part(rows.take(pa.array(start + np.unique(y[told]))))
                            yield from _links(linked(a, b, least, "vectors", ordered, None))


def near_vectors(features: DataFrame, least: float, sent_rows: int = SENT) -> DataFrame | None:
    """Links of rows at a cosine of ``least`` or more: blocks of rows, a few cells or a share of one, are broadcast and meet the cells near them."""
    spark = features.sparkSession
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = features.where(F.col("vector").isNotNull()).withColumn("length", length).where("length > 0")
    unit = unit.select(F.struct(*features.columns).alias("row"), F.transform("vector", lambda x: x.cast("double") / F.col("length")).alias("unit"))
    points = pivots.fit_pivots(unit, "unit")
    if not len(points):
        return None
    placed = materialize(pivots.assigned(unit, "row", "unit", points), "entity-cells")
    blocks, group, size = [], [], 0
    for r in sorted(placed.groupBy("cell").count().collect()):  # a row a cell
        parts = -(-r["count"] // sent_rows)
        if group and size + r["count"] > sent_rows:
            blocks.append(F.col("cell").isin(group))
            group, size = [], 0
        if parts > 1:
            blocks += [(F.col("cell") == r["cell"]) & (F.pmod(F.xxhash64("key.id"), F.lit(parts)) == i) for i in range(parts)]
        else:
            group, size = [*group, r["cell"]], size + r["count"]
    blocks += [F.col("cell").isin(group)] if group else []

    def met(block: Column) -> DataFrame:
        own = placed.where(block).select("key.*", "cell", F.col("vector").alias("unit")).toArrow()
        unit = pivots.as_matrix(own.column("unit"))
        sent = spark.sparkContext.broadcast((own.drop_columns(["unit", "cell"]), unit.astype(np.float32), own.column("cell").to_numpy(), pivots.distances(unit, points)))
        return placed.mapInArrow(lambda batches: cell_links(batches, *sent.value, least), LINK)

    out = None
    for low in range(0, len(blocks), search.MOST_BLOCKS):
        some = None
        for block in blocks[low : low + search.MOST_BLOCKS]:
            some = met(block) if some is None else some.unionByName(met(block))
        some = materialize(some, "near-vectors")
        out = some if out is None else out.unionByName(some)
    return out


def by_notes(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of each pair of observation sets that are alike, equal ones included."""
    sets = classes.where(F.size("notes") > 0).groupBy(F.col("notes").alias("words")).agg(F.min("id").alias("set"))
    sets = materialize(sets, "entity-sets")
    alike = retrieval.similar_sets(sets, "set", least).select(F.col("a").alias("s"), F.col("b").alias("t"))
    alike = materialize(alike.unionByName(sets.select(F.col("set").alias("s"), F.col("set").alias("t"))), "entity-set-pairs")
    own = materialize(classes.join(sets, classes["notes"] == sets["words"]).select("id", "set"), "entity-set")
    side = lambda c: own.join(alike, own["set"] == alike[c]).select("id", _place("notes", F.col("s"), F.col("t")).alias("place"), (F.col("s") == F.col("t")).alias("ordered"), F.lit(None).cast("long").alias("mark"))
    return side("s"), side("t")


def by_names(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of each pair of names that are alike, equal ones included, by shared observation if one is needed."""
    names = materialize(classes.groupBy("name").agg(F.min("id").alias("called")), "entity-names")
    alike = search.similar_names(names, "called", "name", least_name(least)).where("kind = 'similar'").select(F.col("a").alias("s"), F.col("b").alias("t"))
    alike = materialize(alike.unionByName(names.select(F.col("called").alias("s"), F.col("called").alias("t"))), "entity-name-pairs")
    shared = F.array(F.lit(None).cast("string"))  # in one place, whatever they share
    if NAME + TYPE < least * (NAME + TYPE + NOTES):
        shared = F.when(F.size("notes") > 0, F.col("notes")).otherwise(shared)
    own = classes.join(names, "name").select("id", "called", F.explode(shared).alias("shared"))
    own = materialize(own.select("id", "called", F.when(F.col("shared").isNotNull(), F.xxhash64("shared")).alias("mark")), "entity-name")
    place = _place("names", F.col("s"), F.col("t"), F.col("mark").isNull(), F.col("mark")).alias("place")
    side = lambda c: own.join(alike, own["called"] == alike[c]).select("id", place, (F.col("s") == F.col("t")).alias("ordered"), "mark")
    return side("s"), side("t")


def entity_links(rows: DataFrame, least: float = 0.7, block: int = BLOCK) -> DataFrame:
    """(kind, a, b, score) of entities (id, name, entity_type, observations, embedding) that are ``least`` alike.

    ``member`` links the smallest id of a class to its others, ``similar`` two classes,
    a < b. Two entities are linked if they are of one class whose parts reach ``least``,
    or if their classes are linked.
    """
    if least_name(least) <= 0:
        raise ValueError("below this similarity names need not be alike, so no index of names helps")
    classes, members = entity_classes(rows)
    features = materialize(classes.select("id", "name", F.xxhash64("entity_type").alias("kind"), F.transform("notes", lambda o: F.xxhash64(o)).alias("notes"), "vector"), "entity-features")
    found = near_vectors(features, least)
    for route, (home, visitors) in (("notes", by_notes(classes, least)), ("names", by_names(classes, least))):
        dealt = _dealt(materialize(home.distinct(), "place-home"), materialize(visitors.distinct(), "place-visitors"), block)
        full = dealt.join(features, "id").repartition("place", "i", "j").sortWithinPartitions("place", "i", "j")
        links = full.mapInArrow(lambda b, route=route: block_links(b, least, route), LINK)
        found = links if found is None else found.unionByName(links)
    # where a part is within a rounding error of ``least``, two ways may tell a pair
    similar = found.groupBy("a", "b").agg(F.min("score").alias("score")).select(F.lit("similar").alias("kind"), "a", "b", "score")
    vector = F.col("vector").cast("array<double>")
    part = [c for p in (vector, "name", "entity_type", "notes") for c in (p, p)]
    whole = classes.select(F.col("id").alias("a"), search.hybrid_similarity(*[F.col(p) if isinstance(p, str) else p for p in part]).alias("score")).where(F.col("score") >= least - 1e-9)
    same = members.join(whole, "a").select(F.lit("member").alias("kind"), "a", "b", "score")
    return same.unionByName(similar)

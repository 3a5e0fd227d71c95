"""Hard-negative mining by shared lists of anchor clusters.

An anchor's positives are its best rows of the same label, by inner product; each
positive asks for the best rows of other labels whose score lies between two
shares of the positive's. Both are searches for the largest inner products.

1. Anchors are clustered by angle; centroids are fitted on ``SAMPLE`` anchors at
   most, every anchor is assigned. A cluster's angle is that of its farthest member.
2. For a centroid c of angle t, a row x has an inner product of |u| |x| cos(max(0,
   angle(x, c) - t)) at most with any member u. Each task sorts the rows of a batch
   by this bound, once for a cluster, and all members walk this one list.
3. A member stops when its bound at the list's next place is below what it still
   needs: its k-th best score so far in this task, or the least score that its
   positive admits. Until then nothing is left out, so the rows are exact; ties
   are walked to their end and go to the smaller id.
4. Every task gives its best rows of each search, which a window cuts to k.

Anchors are taken in rounds of ``ROUND`` rows (fewer, if vectors are so long that
``ROUND_BYTES`` would be passed), since a round is broadcast; the rows stay where
they are. Work is anchors times rows at worst, as the bound prunes what the
vectors' geometry allows. Vectors are integers: floor(scale * x). Products are
exact: in doubles below 2**52, else in integers of any size.

Edge cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; of rows that repeat an id, the one of the least label and
vector does; missing components of shorter vectors are zero; an anchor without
another row of its label, or a positive without a row in its range, gives no row;
an empty table gives no row; scores beyond 64 bits are cut to the largest; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import materialize, scratch_path

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
CLUSTERS, SAMPLE = 32, 4096
ROUND, ROUND_BYTES = 16384, 1 << 25
#: Rows that a task sorts at once, and places of a list that are walked at once.
BATCH, STEP = 4096, 256
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
EXACT = 2.0**52
SLACK = 1e-7


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): one row an id, vectors as integers."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(good)
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    least = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("q")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return least.select("vec_id", "row.label", "row.q")


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; zero stays zero."""
    return x / np.maximum(lengths(x), 1e-300)[:, None]


def fit_centroids(sample: np.ndarray, clusters: int = CLUSTERS, turns: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means, begun at evenly spaced rows."""
    units = directions(sample)
    centres = units[np.linspace(0, len(units) - 1, min(clusters, len(units))).astype(int)]
    for _ in range(turns):
        own = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        centres = np.where(lengths(sums)[:, None] > 0, directions(sums), centres)
    return centres


class Searches:
    """Members of clusters and their searches: a range of scores, and rows of the same label or of others."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, centres: np.ndarray) -> None:
        width = max(vectors.shape[1], centres.shape[1])
        self.ids, self.labels, self.vectors, self.centres = ids, labels, widened(vectors, width), widened(centres, width)
        self.norms = lengths(self.vectors)
        cosines = directions(self.vectors) @ self.centres.T
        self.cluster = cosines.argmax(axis=1)
        angle = np.arccos(np.clip(cosines[np.arange(len(ids)), self.cluster], -1, 1))
        angle[self.norms == 0] = 0
        self.angle = np.array([angle[self.cluster == c].max(initial=0) for c in range(len(self.centres))]) + SLACK
        self.ask(np.arange(len(ids)), np.full(len(ids), LEAST), np.full(len(ids), MOST), same=True, k=POSITIVES)

    def ask(self, member: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> None:
        self.member, self.low, self.high, self.same, self.k = member, low, high, same, k

    def products(self, members: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (self.vectors[members].astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        wide = self.vectors[members].astype(object) @ x.astype(object).T
        return np.clip(wide, LEAST, MOST).astype(np.int64)

    def walk(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Of all rows (ids, labels, vectors): (search, id, score) of each search's best k, and the number of products."""
        best, found = np.full((len(self.member), self.k), LEAST), np.zeros((len(self.member), self.k), np.int64)
        filled, asked = np.zeros(len(self.member), np.int64), 0
        of_cluster = [np.flatnonzero(self.cluster[self.member] == c) for c in range(len(self.centres))]
        for ids, labels, x in batches:
            width = max(x.shape[1], self.vectors.shape[1])
            x, norms = widened(x, width), lengths(x)
            if width > self.vectors.shape[1]:
                self.vectors, self.centres = widened(self.vectors, width), widened(self.centres, width)
            units, exact = directions(x), norms.max(initial=0) * self.norms.max(initial=0) < EXACT
            only = labels[0] if len(labels) and (labels == labels[0]).all() else None
            for c, own in enumerate(of_cluster):
                if only is not None:
                    own = own[(self.labels[self.member[own]] == only) == self.same]
                elif self.same:
                    own = own[np.isin(self.labels[self.member[own]], labels)]
                if not len(own):
                    continue
                angle = np.arccos(np.clip(units @ self.centres[c], -1, 1))
                bound = norms * np.cos(np.maximum(0, angle - self.angle[c]))
                order = np.argsort(-bound, kind="stable")
                for at in range(0, len(order), STEP):
                    need = np.maximum(best[own, -1], self.low[own])
                    top = self.norms[self.member[own]] * bound[order[at]]
                    own = own[top + np.abs(top) * 1e-9 + 1e-6 >= need]
                    if not len(own):
                        break
                    part = order[at : at + STEP]
                    members, place = np.unique(self.member[own], return_inverse=True)
                    score = self.products(members, x[part], exact)[place]
                    asked += len(members) * len(part)
                    wanted = (self.labels[self.member[own]][:, None] == labels[part]) == self.same
                    wanted &= (score >= np.maximum(best[own, -1], self.low[own])[:, None]) & (score <= self.high[own][:, None])
                    wanted &= ids[part] != self.ids[self.member[own]][:, None]
                    row, col = np.nonzero(wanted)
                    if len(row):
                        self.keep(best, found, filled, own[row], ids[part[col]], score[row, col])
        search, rank = np.nonzero(np.arange(self.k) < filled[:, None])
        return search, found[search, rank], best[search, rank], asked

    def keep(self, best: np.ndarray, found: np.ndarray, filled: np.ndarray, search: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge new rows into the best k of their searches."""
        touched = np.unique(search)
        old, rank = np.nonzero(np.arange(self.k) < filled[touched][:, None])
        search = np.concatenate([touched[old], search])
        ids, scores = np.concatenate([found[touched[old], rank], ids]), np.concatenate([best[touched[old], rank], scores])
        order = np.lexsort((ids, ~scores, search))  # ~x falls as x rises and can't overflow
        search, ids, scores = search[order], ids[order], scores[order]
        first = np.searchsorted(search, search)
        place = np.arange(len(search)) - first
        kept = place < self.k
        best[search[kept], place[kept]], found[search[kept], place[kept]] = scores[kept], ids[kept]
        filled[touched] = np.minimum(np.bincount(np.searchsorted(touched, search), minlength=len(touched)), self.k)


def searched(rows: DataFrame, searches: Searches) -> DataFrame:
    """(search, vec_id, score): each task's best rows of each search."""
    sent = rows.sparkSession.sparkContext.broadcast(searches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH):
                    part = batch.slice(start, BATCH)
                    yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("q"))

        search, ids, scores, _ = sent.value.walk(parts())
        for at in range(0, len(search), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(search[cut], pa.int64()), pa.array(ids[cut], pa.int64()), pa.array(scores[cut], pa.int64())], ["search", "vec_id", "score"])

    return rows.mapInArrow(run, "search bigint, vec_id bigint, score bigint")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, round_rows: int = ROUND) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, embedding).

    ``low`` and ``high`` are percentages of the positive's score between which a negative's lies.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_label = usable(rows, scale).repartitionByRange(tasks, "label", "vec_id").sortWithinPartitions("label", "vec_id")
    table = materialize(by_label, "negatives-rows")
    anchors = table.where(is_anchor)
    sizes = anchors.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not sizes["n"]:
        return spark.createDataFrame([], schema)
    centres = fit_centroids(matrix(anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").toArrow().column("q")))
    rounds = -(-sizes["n"] // max(1, min(round_rows, ROUND_BYTES // (8 * max(1, sizes["width"])))))
    path = scratch_path(spark, "negatives")
    for r in range(rounds):
        own = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).toArrow()
        searches = Searches(own.column("vec_id").to_numpy(), own.column("label").to_numpy(), matrix(own.column("q")), centres)
        searches.k = positives
        near = best_of(searched(table, searches), positives).select("search", "vec_id", "score").orderBy("search", "vec_id").toArrow()
        member, positive, score = (near.column(c).to_numpy() for c in ("search", "vec_id", "score"))
        wide = [int(s) for s in score]  # percentages of a score may pass 64 bits
        searches.ask(member, np.array([-(-low * s // 100) for s in wide], np.int64), np.array([high * s // 100 for s in wide], np.int64), same=False, k=negatives)
        asked = pa.table({"search": np.arange(len(member)), "anchor_id": searches.ids[member], "positive_id": positive, "positive_score": score})
        named = spark.createDataFrame(asked) if len(member) else spark.createDataFrame([], "search bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        hard = best_of(searched(table, searches), negatives).join(F.broadcast(named), "search")
        hard.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)

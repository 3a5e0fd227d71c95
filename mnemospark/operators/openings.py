"""Openings within ordered groups: windows and batches whose start depends on the one before.

The first row of a group opens; after row i, the next opening is the first later row
whose measure passes what i allows (``until``), or the row ``most`` places on, if that
comes first. A task that walks a group would hold a whole hot key, so the walk is cut:

1. Rows are ranked in each group by ranges, and every row finds the row that would open
   next if it opened itself: an as-of join of limits with measures, sorted by ranges.
2. Groups are cut into chunks of ``CHUNK`` rows. Within a chunk, pointer doubling
   gives for each row where the walk from it leaves the chunk, after how many openings.
3. Rows at which a walk can enter a chunk are few. Over these, pointer doubling from the
   groups' first rows finds the entries of the true walk, in rounds that follow the
   logarithm of the number of chunks.
4. Each chunk then numbers its rows from its own entry and what was open before it.

No task holds more than a chunk, however long a group is. Measures must not fall in the
order of a group; null groups are a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import materialize

CHUNK = 4096
NEVER = 1 << 62


def ranged_totals(rows: DataFrame, group: str, order: list[str], amount: Column | None = None) -> DataFrame:
    """Add ``rank`` from 1 in each group, and ``total``, the running sum of ``amount`` (null or negative: none), by ranges of rows."""
    value = F.greatest(F.coalesce(amount.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")) if amount is not None else F.lit(0).cast("long")
    dealt = materialize(rows.withColumn("_amount", value).repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_sum")])
    met = dealt.withColumns({"rank": F.count("*").over(own), "total": F.sum("_amount").over(own)}).join(bases, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return met.withColumns({"rank": F.col("rank") + F.col("_n_before"), "total": F.col("total") + F.col("_sum_before")}).drop("_amount", "_range", "_group", "_of", "_n_before", "_sum_before")


def ranged_lag(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the ``value`` of the row before in each group, null for the first, by ranges of rows."""
    dealt = materialize(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    lasts = dealt.groupBy(group, "_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(group).orderBy("_range"))  # a row a range
    lasts = lasts.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), before.alias("_before"))
    met = dealt.join(lasts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    own = Window.partitionBy(group, "_range").orderBy(*order)
    lagged = F.when(F.row_number().over(own) == 1, F.col("_before")).otherwise(F.lag(value).over(own))
    return met.withColumn(name, lagged).drop("_range", "_group", "_of", "_before")


def next_past(rows: DataFrame) -> DataFrame:
    """(g, rank, past): for each row (g, rank, measure, until) the rank of the first row of its group whose measure is above ``until``; null if none is."""
    limits = rows.select("g", F.col("until").alias("measure"), F.lit(1).alias("kind"), "rank")
    both = rows.select("g", "measure", F.lit(0).alias("kind"), "rank").unionByName(limits)
    order = ["measure", "kind", "rank"]
    dealt = materialize(both.repartitionByRange("g", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    # from the end backwards: a frame that grows is summed up as it goes, one that shrinks is read anew for each row
    later = Window.partitionBy("g", "_range").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.col("kind") == 0, F.col("rank")), ignorenulls=True).over(later)
    firsts = dealt.groupBy("g", "_range").agg(F.min(F.when(F.col("kind") == 0, F.col("rank"))).alias("_first"))
    beyond = Window.partitionBy("g").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    firsts = firsts.select(F.col("g").alias("_g"), F.col("_range").alias("_of"), F.last("_first", ignorenulls=True).over(beyond).alias("_beyond"))
    found = dealt.withColumn("_own", own).where("kind = 1").join(firsts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_of")))
    return found.select("g", "rank", F.coalesce("_own", "_beyond").alias("past"))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Runs of ranks of one chunk of one group: each begins at a rank that a chunk begins with."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero((batch.column("rank").to_numpy() - 1) % size == 0).tolist()
        for low, high in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            if held and low in starts:
                yield pa.Table.from_batches(held)
                held = []
            if high > low:
                held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def walked(onward: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a chunk, given the place that opens next: where the walk leaves the chunk, after how many openings, and the last of them."""
    n = len(onward)
    leave, count, last = onward.copy(), np.ones(n, np.int64), np.arange(n)
    while (inside := leave < n).any():
        at = leave[inside]
        count[inside], last[inside], leave[inside] = count[inside] + count[at], last[at], leave[at]
    return leave, count, last


def openings(rows: DataFrame, group: str, keep: list[str], measure: Column, until: Column, most: Column, chunk: int = CHUNK) -> DataFrame:
    """(group, *keep, rank, opening, opened): the number of each row's opening, from 0, and the rank of the row that opened it.

    ``rows`` has ``rank`` (``ranged_totals``); ``measure``, ``until`` and ``most`` are expressions over it.
    """
    own = rows.select(F.col(group).alias("g"), *keep, "rank", measure.cast("long").alias("measure"), until.cast("long").alias("until"), most.cast("long").alias("most"))
    own = materialize(own, "opening-rows")
    size = own.groupBy("g").agg(F.count("*").alias("n"))
    onward = F.least(F.coalesce("past", F.lit(NEVER)), F.col("rank") + F.col("most"))
    met = own.join(next_past(own).withColumnsRenamed({"g": "_g", "rank": "_rank"}), F.col("g").eqNullSafe(F.col("_g")) & (F.col("rank") == F.col("_rank"))).drop("_g", "_rank")
    met = met.join(size.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
    met = met.select("g", *keep, "rank", F.when(onward <= F.col("n"), onward).otherwise(F.lit(NEVER)).alias("onward"), F.floor((F.col("rank") - 1) / chunk).alias("chunk"))
    met = materialize(met.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "rank"), "opening-next")
    kind = dict(met.dtypes)["g"]

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, chunk):
            rank, to = part.column("rank").to_numpy(), part.column("onward").to_numpy()
            leave, count, last = walked(to - rank[0])
            leave = np.where(leave >= NEVER - rank[0], NEVER, leave + rank[0])
            g = part.column("g").combine_chunks()
            yield pa.RecordBatch.from_arrays([g, pa.array(rank), pa.array(leave), pa.array(count), pa.array(rank[last])], ["g", "rank", "leave", "count", "last"])

    ordered = met.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "rank")
    steps = materialize(ordered.select("g", "rank", "onward").mapInArrow(leaving, f"g {kind}, rank bigint, leave bigint, count bigint, last bigint"), "opening-steps")
    targets = steps.where(F.col("leave") < NEVER).select("g", F.col("leave").alias("rank")).distinct().unionByName(steps.where("rank = 1").select("g", "rank")).distinct()
    same = lambda a, b: a["g"].eqNullSafe(b["g"])
    jumps = steps.join(targets, same(steps, targets) & (steps["rank"] == targets["rank"]), "left_semi")
    jumps = edges = materialize(jumps.select("g", F.col("rank").alias("entry"), "leave", "count", "last"), "opening-jumps")
    reached = materialize(edges.where("entry = 1").select("g", "entry", F.lit(0).cast("long").alias("opening")), "opening-entries")
    while True:
        onto = reached.withColumnsRenamed({"g": "_g", "entry": "_entry"}).join(jumps, F.col("_g").eqNullSafe(F.col("g")) & (F.col("_entry") == F.col("entry")))
        new = materialize(onto.where(F.col("leave") < NEVER).select("g", F.col("leave").alias("entry"), (F.col("opening") + F.col("count")).alias("opening")), "opening-entries")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        on = jumps.select(F.col("g").alias("_g"), F.col("entry").alias("_entry"), F.col("leave").alias("_leave"), F.col("count").alias("_count"))
        jumps = jumps.join(on, F.col("g").eqNullSafe(F.col("_g")) & (F.col("leave") == F.col("_entry")))
        jumps = materialize(jumps.select("g", "entry", F.col("_leave").alias("leave"), (F.col("count") + F.col("_count")).alias("count"), "last"), "opening-jumps")
    true = reached.withColumnsRenamed({"g": "_g", "entry": "_entry"}).join(edges, F.col("_g").eqNullSafe(F.col("g")) & (F.col("_entry") == F.col("entry")))
    true = materialize(true.join(size.withColumnRenamed("g", "_size"), F.col("g").eqNullSafe(F.col("_size"))).select("g", "entry", "opening", "leave", "count", "last", "n"), "opening-entries")
    of = lambda c: F.floor((c - 1) / chunk)
    end = of(F.least("leave", "n"))
    open_before = true.where(end > of(F.col("entry"))).select("g", F.explode(F.sequence(of(F.col("entry")) + 1, end)).alias("chunk"), (F.col("opening") + F.col("count") - 1).alias("held"), F.col("last").alias("held_from"))
    entered = true.select("g", of(F.col("entry")).alias("chunk"), "entry", "opening")
    left, right = open_before, entered.withColumnsRenamed({"g": "_g", "chunk": "_chunk"})
    places = left.join(right, F.col("g").eqNullSafe(F.col("_g")) & (F.col("chunk") == F.col("_chunk")), "full_outer")
    places = places.select(F.when(F.col("chunk").isNull(), F.col("_g")).otherwise(F.col("g")).alias("_g"), F.coalesce("chunk", "_chunk").alias("_chunk"), *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("held", 0), ("held_from", 0), ("entry", NEVER), ("opening", 0))])
    named = met.join(places, F.col("g").eqNullSafe(F.col("_g")) & (F.col("chunk") == F.col("_chunk"))).drop("_g", "_chunk")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, chunk):
            column = lambda c: part.column(c).to_numpy()  # noqa: B023, E731
            rank, to = column("rank"), column("onward")
            starts, at = [], int(column("entry")[0])
            while at <= rank[-1]:
                starts.append(at)
                at = int(to[at - rank[0]])
            nth = np.searchsorted(starts, rank, side="right") - 1
            inside = nth >= 0
            opening = np.where(inside, column("opening")[0] + nth, column("held")[0])
            opened = np.where(inside, np.array([*starts, 0])[nth], column("held_from")[0])
            rest = [part.column(c).combine_chunks() for c in ("g", *keep)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(rank), pa.array(opening, pa.int64()), pa.array(opened, pa.int64())], ["g", *keep, "rank", "opening", "opened"])

    types = dict(met.dtypes)
    schema = ", ".join([f"g {kind}", *[f"`{c}` {types[c]}" for c in keep], "rank bigint, opening bigint, opened bigint"])
    dealt = named.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "rank")
    return dealt.select("g", *keep, "rank", "onward", "held", "held_from", "entry", "opening").mapInArrow(numbered, schema).withColumnRenamed("g", group)

"""The event log and versioned rows: filters, checkpoints, latest views, consistency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.openings import NEVER, openings, ranged_totals


def query_events(events: DataFrame, pos: str, ts: str, kind: str, types: list[str] | None = None, start=None, end=None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Events of some types within inclusive bounds, in file order, as a page."""
    if types:
        events = events.where(F.col(kind).isin(*types))
    if start is not None:
        events = events.where(F.col(ts) >= F.lit(start))
    if end is not None:
        events = events.where(F.col(ts) <= F.lit(end))
    if not offset and limit is None:
        return events.orderBy(pos)
    events = events.orderBy(pos).offset(offset)
    return events if limit is None else events.limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Per key the row that comes last; ``order`` must be total.

    The aggregate combines within tasks first, so a key with many rows sends few.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def live(rows: DataFrame, key: str = "id", pos: str = "_pos", deleted: str = "deleted") -> DataFrame:
    """The current version of each key; a key whose last line is a tombstone is gone."""
    return latest(rows, [key], [F.col(pos)]).where(~F.coalesce(F.col(deleted), F.lit(False)))


def keep_last(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of the whole log (top-k, so no full sort)."""
    return rows.orderBy(F.col(order).desc()).limit(n)


def out_of_order(events: DataFrame, key: str, pos: str | list[str], ts: str) -> DataFrame:
    """Events earlier than the one before them in their key's log."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(pos))
    return events.withColumn("previous", before).where(F.col(ts) < F.col("previous"))


def consistency(events: DataFrame) -> DataFrame:
    """(id, _pos, level, problem) of a log with ids, types, payloads and metadata."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("_pos"))
    before = F.lag("timestamp").over(Window.partitionBy("agentId").orderBy("_pos"))
    problem = lambda test, level, text: F.when(test, F.struct(F.lit(level).alias("level"), F.lit(text).alias("problem")))
    found = F.array(
        problem(F.col("_nth") > 1, "error", "duplicate id"),
        problem(F.col("eventType").isNull(), "error", "missing event type"),
        problem(F.col("timestamp") < F.col("_before"), "warning", "out of order"),
        problem(F.col("payload").isNull(), "warning", "missing payload"),
        problem(F.col("metadata.version").isNull(), "warning", "missing version"),
    )
    marked = events.withColumns({"_nth": nth, "_before": before})
    return marked.select("id", "_pos", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("id", "_pos", "p.*")


def rate_limit(events: DataFrame, key: str, ts: str, pos: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(pos, allowed): ``limit`` requests per window that opens at a key's first request after the last one.

    The window's start depends on the one before; ``openings`` finds it in keys of any length.
    """
    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(pos).alias("pos"))
    made = openings(ranged_totals(rows, "k", ["t", "pos"]), "k", ["pos"], F.col("t"), F.col("t") + seconds * 1_000_000, F.lit(NEVER // 2))
    return made.select("pos", (F.col("rank") - F.col("opened") < limit).alias("allowed"))


class Handlers:
    """Functions by event type; each gets the rows of its type."""

    def __init__(self) -> None:
        self.by_type: dict[str, list[Callable[[DataFrame], None]]] = {}
        self.errors: list[tuple[str, Exception]] = []

    def on(self, event_type: str, handler: Callable[[DataFrame], None]) -> None:
        self.by_type.setdefault(event_type, []).append(handler)

    def off(self, event_type: str, handler: Callable[[DataFrame], None]) -> None:
        self.by_type.get(event_type, []).remove(handler)

    def dispatch(self, rows: DataFrame, column: str = "event_type") -> None:
        """Run all handlers; one that fails doesn't stop the others."""
        for event_type, handlers in self.by_type.items():
            for handler in handlers:
                try:
                    handler(rows.where(F.col(column) == event_type))
                except Exception as error:  # noqa: BLE001
                    self.errors.append((event_type, error))

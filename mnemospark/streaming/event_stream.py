"""Structured Streaming over the event log."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, ListState, TimerValues

from mnemospark.operators.events import Handlers
from mnemospark.operators.openings import ranged_lag
from mnemospark.session import scratch_path

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event table as a stream of its files."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")


def daily(events: DataFrame, delay: str = "365 days") -> DataFrame:
    """Counts by day and type; the watermark bounds the state."""
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windowed.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def without_duplicates(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def sliced(rows: DataFrame, order: str, slices: int = 8, closing: str | None = None) -> str:
    """Write rows as a log of files that come one after another, by ranges of ``order``; returns the folder.

    ``closing``, if given, is a span: a last file holds one row, null but for its time,
    that much after all others, so that event time passes them. A range has a file, so
    there should be as many ranges as keep one small.
    """
    path = scratch_path(rows.sparkSession, "log")
    ends = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, high = (ends["low"], ends["high"]) if ends["low"] is not None else (0, 0)
    cuts = [low + (high + 1 - low) * i // slices for i in range(slices + 1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows.where((F.col(order) >= a) & (F.col(order) < b)).repartition(1).write.mode("append").parquet(path)
    if closing:
        last = rows.agg((F.max("ts") + F.expr(f"INTERVAL {closing}")).alias("ts"))
        last.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]).repartition(1).write.mode("append").parquet(path)
    return path


def read_slices(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """The log of ``sliced`` as a stream, a file a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


class OrderedLimit(StatefulProcessor):
    """Requests of the keys of a bucket in the order of their times, under a limit per key and window that opens at a first request.

    Requests wait in list state until the watermark has passed them, as only then
    nothing earlier can come; a timer wakes the bucket for the first that waits. A second
    list has when each key's window opened and how many requests it had; a timer
    clears those that are over. A bucket holds the requests of the watermark's delay.
    """

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.width = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, t bigint, event_id bigint")
        self.windows = handle.getListState("windows", "key string, opened bigint, used bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            batch = batch[batch["event_id"].notna()]
            if len(batch):
                keys = batch["key"].astype(object).where(batch["key"].notna(), None)
                self.waiting.appendList([(k, int(t), int(e)) for k, t, e in zip(keys, batch["t"], batch["event_id"], strict=True)])
                first = int(batch["t"].min()) if first is None else min(first, int(batch["t"].min()))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "allowed": pd.Series(dtype="bool")})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for r in self.waiting.get():
            (ready if r[1] // 1000 <= passed else later).append((r[0], r[1], r[2]))
        windows = {r[0]: (r[1], r[2]) for r in self.windows.get()}
        out = []
        for k, t, event_id in sorted(ready, key=lambda r: r[1:]):
            opened, used = windows.get(k, (None, 0))
            if opened is None or t - opened > self.width:
                opened, used = t, 0
            windows[k] = opened, used + 1
            out.append((event_id, used < self.limit))
        if ready:
            self._keep(self.waiting, later)
        if later:
            self.handle.registerTimer(min(t for _, t, _ in later) // 1000)
        open_still = [(k, opened, used) for k, (opened, used) in windows.items() if (opened + self.width) // 1000 >= passed]
        if ready or len(open_still) < len(windows):
            self._keep(self.windows, open_still)
        if open_still:
            self.handle.registerTimer((max(opened for _, opened, _ in open_still) + self.width) // 1000 + 1)
        yield pd.DataFrame({"event_id": [e for e, _ in out], "allowed": [a for _, a in out]}).astype({"event_id": "int64", "allowed": "bool"})

    def _keep(self, state: ListState, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limited_requests(events: DataFrame, key: str = "user_id", limit: int = 60, seconds: int = 60, delay: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """(event_id, allowed) of a stream, in the order of times; rows later than ``delay`` are left out, as by any watermark.

    Keys share ``buckets`` states, as each costs some calls to the store in every micro-batch.
    """
    events.sparkSession.conf.set(STORE, ROCKS)  # the only store that has the state kinds and timers
    rows = events.withWatermark("ts", delay).withColumns({"t": F.unix_micros(F.col("ts").cast("timestamp")), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets))})
    own = rows.select("bucket", F.col(key).cast("string").alias("key"), "ts", "t", "event_id")
    return own.groupBy("bucket").transformWithStateInPandas(OrderedLimit(limit, seconds), "event_id bigint, allowed boolean", "append", "eventTime")


def run_late(events: DataFrame, name: str, key: str = "user_id", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """(event_id, behind_us) of events earlier than the one before them in their key's log, for keys of any size.

    Each micro-batch is put in order by ranges of rows. Beside its results lies the
    time of each key's last event, a row a key, which the next one begins with. A
    repeated micro-batch writes the same, so a stream that is stopped may go on with
    the same ``checkpoint`` and ``out``.
    """
    spark = events.sparkSession
    out = out or scratch_path(spark, f"late-{name}")
    last = "key string, last bigint"

    def save(batch: DataFrame, number: int) -> None:
        seen = spark.read.schema(last).parquet(f"{out}/state/{number - 1}") if number else spark.createDataFrame([], last)
        own = batch.select(F.col(key).cast("string").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
        rows = ranged_lag(own, "key", ["event_id"], "t", "before").join(seen.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left")
        before = F.coalesce("before", "last")
        late = rows.where(F.col("t") < before).select("event_id", (before - F.col("t")).alias("behind_us"))
        late.write.mode("overwrite").parquet(f"{out}/late/batch={number:09d}")
        newest = own.groupBy("key").agg(F.max_by("t", "event_id").alias("last"))
        kept = seen.join(newest.select(F.col("key").alias("_key")), F.col("key").eqNullSafe(F.col("_key")), "left_anti").unionByName(newest)
        kept.write.mode("overwrite").parquet(f"{out}/state/{number}")

    with state_partitions(spark):
        query = events.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, f"checkpoint-{name}")).trigger(availableNow=True).foreachBatch(save).start()
        query.awaitTermination()
    return spark.read.schema("event_id bigint, behind_us bigint, batch int").parquet(f"{out}/late").drop("batch")


@contextlib.contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """As many partitions of state as the cluster has cores, or fewer if the session asks for fewer: each costs a store in every micro-batch."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), max(8, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return the last state, from the shared folder."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"stream-{name}")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    with state_partitions(spark):
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, f"checkpoint-{name}"))
            .trigger(availableNow=True).foreachBatch(save).start()
        )
        query.awaitTermination()
    saved = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    if mode == "complete":
        newest = saved.agg(F.max("batch")).first()[0]
        saved = saved.where(F.col("batch") == (newest if newest is not None else -1))
    return saved.drop("batch")


class Dispatch:
    """Hand each micro-batch to the handlers of its types, each handler's effect once.

    A handler maps the rows of its type to the rows of its effect, or to None. For a
    handler and batch, the effect is written to a path of its own, over what a stopped
    attempt may have left, and then a row of the commit log beside it: ``ok``, or
    ``error`` with the message. A batch that is replayed after a restart passes over
    what the log has; a handler that failed is passed over too, unless ``retry``. Effects
    without a row in the log are not read. Handlers have names, by which they are known.
    """

    LOG = "handler string, event_type string, batch bigint, status string, message string"

    def __init__(self, spark: SparkSession, path: str, column: str = "event_type", retry: bool = False) -> None:
        self.spark, self.path, self.column, self.retry = spark, path.rstrip("/"), column, retry
        self.handlers: dict[str, tuple[str, Callable[[DataFrame], DataFrame | None]]] = {}

    def on(self, event_type: str, name: str, handler: Callable[[DataFrame], DataFrame | None]) -> None:
        self.handlers[name] = (event_type, handler)

    def off(self, name: str) -> None:
        self.handlers.pop(name, None)

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def run(self, rows: DataFrame, batch: int) -> None:
        """All handlers over a batch; one that fails doesn't stop the others."""
        for name, (event_type, handler) in self.handlers.items():
            place = f"handler={name}/batch={batch:09d}"
            if self._exists(f"{self.path}/log/{place}/_SUCCESS"):
                done = self.spark.read.schema(self.LOG).parquet(f"{self.path}/log/{place}").first()
                if done["status"] == "ok" or not self.retry:
                    continue
            status, message = "ok", None
            try:
                made = handler(rows.where(F.col(self.column) == event_type))
                if made is not None:
                    made.write.mode("overwrite").parquet(f"{self.path}/effects/{place}")
            except Exception as error:  # noqa: BLE001  kept in the log
                status, message = "error", f"{type(error).__name__}: {error}"[:500]
            self.spark.createDataFrame([(name, event_type, batch, status, message)], self.LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{place}")

    def log(self) -> DataFrame:
        """(handler, event_type, batch, status, message) of all that ran."""
        if not self._exists(f"{self.path}/log"):
            return self.spark.createDataFrame([], self.LOG)
        return self.spark.read.schema(self.LOG).parquet(f"{self.path}/log/*/*")

    def effects(self, name: str, schema: str) -> DataFrame:
        """The rows that a handler made in batches that the log has as done."""
        if not self._exists(f"{self.path}/effects/handler={name}"):
            return self.spark.createDataFrame([], schema)
        made = self.spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{self.path}/effects/handler={name}").parquet(f"{self.path}/effects/handler={name}/*")
        done = self.log().where((F.col("handler") == name) & (F.col("status") == "ok")).select("batch").distinct()
        return made.join(done, "batch", "left_semi").drop("batch")

    def start(self, events: DataFrame, checkpoint: str):
        """Start a stream over ``events`` that hands over each micro-batch."""
        return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.run).start()


def dispatch(events: DataFrame, handlers: Handlers, checkpoint: str):
    """Start a stream that hands each micro-batch to the handlers of its types."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, _: handlers.dispatch(rows)).start()

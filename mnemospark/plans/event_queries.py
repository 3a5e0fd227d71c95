"""Queries over the event log and its stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.values import age_days, day_key
from mnemospark.operators import events as ev
from mnemospark.plans.registry import query
from mnemospark.session import scratch_path
from mnemospark.sources.tables import table
from mnemospark.streaming import event_stream

DAILY = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY 1, 2"""


@query("event_stats_by_day_type", DAILY)
def event_stats_by_day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(day_key(F.col("ts")).alias("day"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_daily", DAILY)
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = event_stream.run_once(event_stream.daily(event_stream.read_events(spark, sf_dir)), "daily")
    return done.withColumn("total", F.round("total", 4))


@query(
    "event_stats_total",
    "SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
)
def event_stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = (F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("user_id").alias("users"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*aggs)


@query(
    "event_filter_page",
    """SELECT event_id, ts, event_type FROM events WHERE event_type IN ('click', 'error')
AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY event_id LIMIT 100 OFFSET 20""",
)
def event_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return ev.query_events(rows, "event_id", "ts", "event_type", ["click", "error"], datetime(2024, 1, 5), datetime(2024, 1, 20), 20, 100)


@query(
    "event_range_replay",
    "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' GROUP BY event_type",
)
def event_range_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("ts").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "event_out_of_order",
    """SELECT event_id, ts, previous FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id) AS previous FROM events)
WHERE ts < previous""",
)
def event_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows are in order by id, so the log's order is that of the values."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return ev.out_of_order(rows, "user_id", ["value", "event_id"], "ts").select("event_id", "ts", "previous")


@query("event_checkpoint", "SELECT count(*) AS n, arg_max(ts, event_id) AS last_ts FROM events")
def event_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.max_by("ts", "event_id").alias("last_ts"))


@query(
    "event_payload_sum",
    "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type",
)
def event_payload_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"))


@query(
    "latest_event_per_user",
    "SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("event_id")])


@query("keep_last_n_events", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def keep_last_n_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.keep_last(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 500)


LOG = """log AS (SELECT event_id AS pos, user_id, ts, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS id,
  nullif(event_type, 'error') AS kind, nullif(value, 0) AS payload FROM events)"""


@query(
    "event_consistency",
    f"""WITH {LOG}, m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth, lag(ts) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM log)
SELECT 'error' AS level, 'duplicate id' AS problem, count(*) AS n FROM m WHERE nth > 1
UNION ALL SELECT 'error', 'missing event type', count(*) FROM m WHERE kind IS NULL
UNION ALL SELECT 'warning', 'missing version', count(*) FROM m WHERE payload IS NULL HAVING count(*) > 0
UNION ALL SELECT 'warning', 'out of order', count(*) FROM m WHERE ts < before HAVING count(*) > 0""",
)
def event_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), day_key(F.col("ts"))).alias("id"),
        F.col("event_id").alias("_pos"), F.col("ts").alias("timestamp"), F.col("user_id").alias("agentId"),
        F.nullif("event_type", F.lit("error")).alias("eventType"), F.col("props").alias("payload"),
        F.struct(F.nullif("value", F.lit(0.0)).alias("version")).alias("metadata"),
    )
    return ev.consistency(rows).groupBy("level", "problem").agg(F.count("*").alias("n"))


#: When a user's windows of an hour open, by walking from each to the first request after it.
LIMITED = """WITH RECURSIVE w AS (SELECT user_id, min(ts) AS opened FROM events GROUP BY user_id
  UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts > w.opened + INTERVAL 1 HOUR GROUP BY w.user_id, w.opened)
SELECT event_id, row_number() OVER (PARTITION BY e.user_id, w.opened ORDER BY e.ts, event_id) <= 2 AS allowed FROM events e ASOF JOIN w ON e.user_id = w.user_id AND e.ts >= w.opened"""


@query("rate_limited_requests", LIMITED.replace("event_id, row_number", "event_id AS pos, row_number"))
def rate_limited_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per user over two an hour; windows open at the first request after the last window."""
    return ev.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, 3600)


@query(
    "events_before_and_age",
    """SELECT event_type, count(*) AS n, round(sum(date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 86400000000.0), 3) AS age_days
FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY event_type""",
)
def events_before_and_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    age = age_days(F.col("ts"), F.lit("2024-02-01").cast("timestamp"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(age), 3).alias("age_days"))


@query(
    "event_sliding_windows",
    """SELECT time_bucket(INTERVAL '6 hours', ts) - CASE WHEN s.i = 1 THEN INTERVAL '6 hours' ELSE INTERVAL '0 hours' END AS start, count(*) AS n
FROM events, (VALUES (0), (1)) s(i) GROUP BY 1""",
)
def event_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "n")


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, nr""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), "n")


@query(
    "op_summary",
    """SELECT event_type AS op, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean,
  round(100.0 * count(*) FILTER (WHERE value > 0.5) / count(*), 4) AS success_rate, count(DISTINCT user_id) * 1.0 / count(*) AS dedup_ratio FROM events GROUP BY event_type""",
)
def op_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("op")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(100.0 * F.count_if(F.col("value") > 0.5) / F.count("*"), 4).alias("success_rate"),
        (F.countDistinct("user_id") / F.count("*")).alias("dedup_ratio"),
    )


@query(
    "running_total_per_user",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events""",
)
def running_total_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.count("*").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table(spark, sf_dir, "events").select("event_id", nth.alias("nth"))


@query(
    "stream_late_events",
    """WITH s AS (SELECT event_id, user_id, epoch_us(ts) - (event_id % 5) * 43200000000 AS t FROM events)
SELECT event_id, previous - t AS behind_us FROM (SELECT event_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM s) WHERE t < previous""",
)
def stream_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose clocks are up to two days slow, as a log of eight files: those behind the one before in their user's log."""
    log = event_stream.sliced(table(spark, sf_dir, "events"), "event_id")
    slow = event_stream.read_slices(spark, log).withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("event_id") % 5) * 43_200_000_000))
    return event_stream.run_late(slow, "late", "user_id")


@query("stream_rate_limit", LIMITED)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate limit as a stream of eight files and a closing row, in keyed state with timers."""
    log = event_stream.sliced(table(spark, sf_dir, "events"), "event_id", closing="40 DAYS")
    return event_stream.run_once(event_stream.limited_requests(event_stream.read_slices(spark, log), "user_id", 2, 3600, "30 days"), "limit", "append")


@query(
    "dispatch_log",
    """WITH e AS (SELECT event_type, value, event_id * 8 // (SELECT max(event_id) + 1 FROM events) AS batch FROM events)
SELECT 'views' AS handler, 'ok' AS status, count(DISTINCT batch) AS batches, (SELECT count(*) FROM e WHERE event_type = 'view') AS n FROM e
UNION ALL SELECT 'sales', 'ok', count(DISTINCT batch), (SELECT count(*) FROM e WHERE event_type = 'purchase' AND value >= 100) FROM e
UNION ALL SELECT 'broken', 'error', count(DISTINCT batch), 0 FROM e""",
)
def dispatch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in eight micro-batches through three handlers, one of which always fails: batches by outcome, and rows of effect."""
    log = event_stream.sliced(table(spark, sf_dir, "events"), "event_id")
    hub = event_stream.Dispatch(spark, scratch_path(spark, "dispatch"))

    def fail(rows: DataFrame) -> DataFrame:
        raise ValueError("no such action")

    hub.on("view", "views", lambda rows: rows.select("event_id"))
    hub.on("purchase", "sales", lambda rows: rows.where("value >= 100").select("event_id"))
    hub.on("click", "broken", fail)
    hub.start(event_stream.read_slices(spark, log), scratch_path(spark, "checkpoint-dispatch")).awaitTermination()
    told = hub.log().groupBy("handler", "status").agg(F.count("*").alias("batches"))
    made = None
    for name in ("views", "sales"):
        one = hub.effects(name, "event_id bigint").agg(F.count("*").alias("n")).select(F.lit(name).alias("handler"), "n")
        made = one if made is None else made.unionByName(one)
    return told.join(F.broadcast(made), "handler", "left").select("handler", "status", "batches", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

"""Queries over relational records: messages, plans, ingestion and writes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.operators import chunks, graph
from mnemospark.operators.events import latest
from mnemospark.plans.registry import query
from mnemospark.sources import sinks
from mnemospark.sources.tables import table


def keyword_match(text: str, keywords: list[str]) -> Column:
    """Every keyword somewhere in the lower-cased text; % and _ stay wildcards."""
    return reduce(and_, [F.lower(text).like(f"%{k}%") for k in keywords]) if keywords else F.lit(False)


@query(
    "message_keyword_search",
    """SELECT conv_id, turn, role FROM conversations JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') USING (conv_id)
WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%on_e%' ORDER BY turn DESC, conv_id DESC LIMIT 200""",
)
def message_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    sessions = rows.where("role = 'user'").select("conv_id").distinct()
    hits = rows.where(keyword_match("text", ["the", "on_e"])).join(sessions, "conv_id")
    return hits.select("conv_id", "turn", "role").orderBy(F.col("turn").desc(), F.col("conv_id").desc()).limit(200)


@query(
    "message_thread",
    """WITH m AS (SELECT conv_id, turn, conv_id || '/' || turn AS id, lag(conv_id || '/' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations)
SELECT id, first_value(id) OVER w AS root, CAST(row_number() OVER w - 1 AS BIGINT) AS depth FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def message_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("id"))
    parent = F.lag("id").over(Window.partitionBy("conv_id").orderBy("turn"))
    return graph.thread_depths(rows.select("id", parent.alias("parent"))).select("id", "root", F.col("depth").cast("bigint").alias("depth"))


@query(
    "session_participants_nested",
    "SELECT conv_id, string_agg(role || ':' || n, ',' ORDER BY role) AS participants FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id",
)
def session_participants_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    nested = F.array_sort(F.collect_list(F.struct("role", "n")))
    return counts.groupBy("conv_id").agg(F.array_join(F.transform(nested, lambda p: F.concat_ws(":", p["role"], p["n"].cast("string"))), ",").alias("participants"))


@query(
    "sessions_with_participant",
    "SELECT DISTINCT conv_id FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'system')",
)
def sessions_with_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id").distinct().join(rows.where("role = 'system'").select("conv_id"), "conv_id", "left_semi")


@query(
    "latest_message_per_session",
    "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
)
def latest_message_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")])


@query("next_sequence", "SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_key FROM orders GROUP BY o_custkey")
def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_key"))


@query(
    "plan_task_rollup",
    """SELECT o_custkey, count(DISTINCT o_orderkey) AS plans, count(l_orderkey) AS tasks, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS done
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""",
)
def plan_task_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks are counted per plan before the join, so the join is one row a plan."""
    tasks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("tasks"), F.count_if(F.col("l_returnflag") == "R").alias("done"))
    plans = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(tasks, "o_orderkey", "left")
    return plans.groupBy("o_custkey").agg(
        F.count("*").alias("plans"), F.coalesce(F.sum("tasks"), F.lit(0)).alias("tasks"), F.coalesce(F.sum("done"), F.lit(0)).alias("done")
    )


@query(
    "plan_nested_tasks",
    """SELECT l_orderkey AS plan, string_agg(l_linenumber || '=' || l_returnflag, ';' ORDER BY l_linenumber, l_returnflag) AS tasks FROM lineitem GROUP BY l_orderkey""",
)
def plan_nested_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    line = F.transform(tasks, lambda t: F.concat_ws("=", t["l_linenumber"].cast("string"), t["l_returnflag"]))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan")).agg(F.array_join(line, ";").alias("tasks"))


PHASES = ("1-URGENT", "2-HIGH")


@query(
    "tasks_by_phase",
    """SELECT CASE WHEN o_orderpriority LIKE '4%' THEN 'Unassigned' ELSE o_orderpriority END AS phase, count(*) AS n,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END AS place
FROM orders GROUP BY 1, 3 ORDER BY place, phase""",
)
def tasks_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.coalesce(F.when(~F.col("o_orderpriority").like("4%"), F.col("o_orderpriority")), F.lit("Unassigned"))
    place = F.when(F.col("phase") == PHASES[0], 0).when(F.col("phase") == PHASES[1], 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy(phase.alias("phase")).agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place", "phase")


@query("paged_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return rows.orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(100).limit(50)


@query("distinct_entity_names", "SELECT DISTINCT p_brand AS name FROM part WHERE p_brand IS NOT NULL AND p_brand <> '' ORDER BY name")
def distinct_entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).where("name <> ''").distinct().orderBy("name")


@query(
    "latest_rows_per_file",
    "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_shipdate) IN (SELECT (l_partkey, max(l_shipdate)) FROM lineitem GROUP BY l_partkey)",
)
def latest_rows_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of each part's last day, by a small aggregate and a semi-join."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    last = rows.groupBy("l_partkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    return rows.join(last, ["l_partkey", "l_shipdate"], "left_semi").drop("l_shipdate")


@query(
    "title_dependencies",
    """WITH t AS (SELECT p_name, max(p_partkey) AS id FROM part GROUP BY p_name),
d AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey AS task, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS depends FROM d JOIN t USING (p_name) GROUP BY l_orderkey""",
)
def title_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles to ids, of equal titles the last; titles that no task has are dropped."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    titles = part.groupBy("p_name").agg(F.max("p_partkey").alias("id"))
    wanted = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey").select("l_orderkey", "p_name").distinct()
    ids = F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string"))
    return wanted.join(titles, "p_name").groupBy(F.col("l_orderkey").alias("task")).agg(F.array_join(ids, ",").alias("depends"))


@query(
    "three_table_report",
    """WITH l AS (SELECT l_orderkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1)
SELECT c_mktsegment, count(*) AS reviews, CAST(sum(lines) AS BIGINT) AS findings, round(sum(amount), 0) AS amount
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""",
)
def three_table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy("c_mktsegment").agg(F.count("*").alias("reviews"), F.sum("lines").alias("findings"), F.round(F.sum("amount"), 0).alias("amount"))


@query(
    "upsert_last_wins",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey DESC) = 1""",
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return sinks.upsert(rows.where("o_orderstatus <> 'F'"), rows.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderkey").drop("o_orderstatus")


@query(
    "insert_if_absent",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey""",
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    new = rows.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return sinks.insert_absent(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), new, ["o_custkey"])


@query("update_by_key", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return sinks.update_where(rows, F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})


@query(
    "cascade_delete",
    """SELECT count(*) AS tasks, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)""",
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete customers in debt, then their orders, then the orders' lines."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    orders = table(spark, sf_dir, "orders")
    gone = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left_semi")
    left = sinks.delete_keys(table(spark, sf_dir, "lineitem"), gone, {"l_orderkey": "o_orderkey"})
    return left.agg(F.count("*").alias("tasks"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("prune_by_age", "SELECT event_type, count(*) AS pruned FROM events WHERE ts < TIMESTAMP '2024-01-30' - INTERVAL '14 days' GROUP BY event_type")
def prune_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.lit("2024-01-30").cast("timestamp") - F.expr("INTERVAL 14 DAYS")
    return table(spark, sf_dir, "events").where(F.col("ts") < limit).groupBy("event_type").agg(F.count("*").alias("pruned"))


@query(
    "tombstone_latest",
    """WITH log AS (SELECT o_custkey AS id, o_orderkey AS pos, o_totalprice AS price, o_orderstatus = 'P' AS deleted FROM orders)
SELECT id, pos, price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS rn FROM log) WHERE rn = 1 AND NOT deleted""",
)
def tombstone_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.operators.events import live

    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "P").alias("deleted"))
    return live(rows, "id", "pos").drop("deleted")


@query(
    "csv_lines",
    """SELECT concat_ws(',', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role,
  CASE WHEN regexp_matches(text, '[,\n"]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS line FROM conversations""",
)
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(sinks.csv_line(*map(F.col, ("conv_id", "turn", "role", "text"))).alias("line"))


HASHES = """a AS (SELECT o_custkey AS path, md5(max(o_orderpriority)) AS h FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS path, md5(max(o_orderpriority)) AS h FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"""


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two scans of the same files: customers as their finished and their open orders show them."""
    orders = table(spark, sf_dir, "orders")
    scan = lambda s: orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("path")).agg(F.md5(F.max("o_orderpriority")).alias("h"))
    return scan("F"), scan("O")


@query(
    "ingest_diff",
    f"""WITH {HASHES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted'
WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path""",
)
def ingest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.ingest_diff(*_scans(spark, sf_dir), "path", "h")


@query("stale_anti", f"WITH {HASHES} SELECT path FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.path = a.path)")
def stale_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.stale(*_scans(spark, sf_dir), "path")


@query(
    "ingest_report",
    f"""WITH {HASHES} SELECT c_mktsegment AS source, count(*) FILTER (WHERE a.h IS NULL) AS n_new,
  count(*) FILTER (WHERE a.h = b.h) AS n_reused, count(*) FILTER (WHERE b.h IS NULL) AS n_deleted FROM a FULL JOIN b ON a.path = b.path JOIN customer ON c_custkey = coalesce(a.path, b.path) GROUP BY 1""",
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.ingest_diff(*_scans(spark, sf_dir), "path", "h").join(table(spark, sf_dir, "customer"), F.col("path") == F.col("c_custkey"))
    count = lambda s: F.count_if(F.col("state") == s)
    return found.groupBy(F.col("c_mktsegment").alias("source")).agg(count("new").alias("n_new"), count("unchanged").alias("n_reused"), count("deleted").alias("n_deleted"))


@query(
    "embedding_stats",
    """SELECT lang, count(*) AS n, CAST(round(avg(length(text))) AS BIGINT) AS mean_chars, count(DISTINCT source) AS files FROM documents GROUP BY lang""",
)
def embedding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = (F.count("*").alias("n"), F.coalesce(F.round(F.avg(F.length("text"))), F.lit(0)).cast("bigint").alias("mean_chars"), F.countDistinct("source").alias("files"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*aggs)


@query(
    "language_share",
    "SELECT lang, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 6",
)
def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)  # over a row a language
    return counts.withColumn("share", share).orderBy(F.col("n").desc(), "lang").limit(6)


@query(
    "per_model_success",
    """SELECT user_id % 5 AS model, count(*) FILTER (WHERE value > 0.5) AS ok, count(*) FILTER (WHERE NOT value > 0.5) AS failed, round(avg(value), 6) AS mean FROM events GROUP BY 1""",
)
def per_model_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("value") > 0.5
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("model")).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.avg("value"), 6).alias("mean"))


@query("set_union_ids", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def set_union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")).union(rich).distinct()

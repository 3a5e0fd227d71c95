"""Queries over contexts, plans and changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.values import SEVERITY_RANK, looked_up
from mnemospark.operators import context, search
from mnemospark.operators.events import latest
from mnemospark.plans.registry import query
from mnemospark.sources.tables import GRAPH_SQL, graph_nodes, table


@query(
    "context_keyword_search",
    """SELECT user_id, event_type, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
WHERE lower(props) LIKE '%k%' AND lower(props) LIKE '%1%'""",
)
def context_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in the JSON of the latest version of each context."""
    rows = latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], [F.col("event_id")])
    return rows.where(F.lower("props").like("%k%") & F.lower("props").like("%1%")).drop("props")


@query("snippet_projection", "SELECT doc_id, md5(string_split(text, chr(10))[2]) AS snippet FROM documents")
def snippet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(context.snippet(F.split("text", "\n"), 1)).alias("snippet"))


@query(
    "relevant_paths",
    r"""SELECT page_id FROM pages WHERE len(list_filter(regexp_split_to_array(lower(url), '[/\\.]'), lambda p: length(p) > 2 AND contains('show the blog posts of example com', p))) > 0""",
)
def relevant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(context.path_is_relevant(F.col("url"), "Show the blog posts of example com")).select("page_id")


@query("index_search", f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE name = 'red bolt'")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.index_search(graph_nodes(spark, sf_dir), "name", "red bolt").select("id")


@query("index_search_fallback", f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE contains(name, 'NATION_1')  AND NOT EXISTS (SELECT 1 FROM nodes WHERE name = 'ATION_1') AND contains(name, 'ATION_1')")
def index_search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.index_search(graph_nodes(spark, sf_dir), "name", "ATION_1").select("id")


@query(
    "findings_by_severity",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'low' ELSE 'medium' END AS severity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY severity DESC, l_linenumber, l_partkey) <= 3""",
)
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order, as a review, the three findings that its list begins with."""
    rows = all_findings_by_severity(spark, sf_dir)
    return search.top_per_query(rows, "l_orderkey", [F.col("severity").desc(), F.col("l_linenumber"), F.col("l_partkey")], 3).drop("rank")


@query(
    "all_findings_by_severity",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'low' ELSE 'medium' END AS severity FROM lineitem
ORDER BY severity DESC, l_orderkey, l_linenumber, l_partkey""",
)
def all_findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the names of severities, as stored reports are listed: medium, low, high."""
    severity = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "low").otherwise("medium")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", severity.alias("severity"))
    return rows.orderBy(F.col("severity").desc(), "l_orderkey", "l_linenumber", "l_partkey")


@query(
    "findings_by_weight",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 3 ELSE 2 END AS weight FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, l_linenumber, l_partkey) <= 3""",
)
def findings_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order, as a review, the three findings of most weight."""
    rows = all_findings_by_weight(spark, sf_dir)
    return search.top_per_query(rows, "l_orderkey", [F.col("weight").desc(), F.col("l_linenumber"), F.col("l_partkey")], 3).drop("rank")


@query(
    "all_findings_by_weight",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 3 ELSE 2 END AS weight FROM lineitem ORDER BY weight DESC, l_orderkey, l_linenumber, l_partkey""",
)
def all_findings_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("l_returnflag") == "R", "BLOCKER").when(F.col("l_returnflag") == "A", "MAJOR").otherwise("MINOR")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", looked_up(severity, SEVERITY_RANK).cast("int").alias("weight"))
    return rows.orderBy(F.col("weight").desc(), "l_orderkey", "l_linenumber", "l_partkey")


@query(
    "review_history",
    """SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS high, count(l_orderkey) AS total_issues FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_orderdate ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""",
)
def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("high"), F.count("*").alias("total_issues"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(counts, "o_orderkey")
    return rows.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100).select("o_orderkey", "high", "total_issues")


@query("last_ingest_per_repository", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS commit_id FROM orders GROUP BY o_custkey")
def last_ingest_per_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("commit_id"))


@query("session_index", "SELECT conv_id, count(*) AS messages, max(turn) + 1 AS next_id FROM conversations GROUP BY conv_id")
def session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), (F.max("turn") + 1).alias("next_id"))


@query(
    "errors_by_stage",
    "SELECT event_type AS stage, count(*) AS n, min(event_id) AS first_id, count(DISTINCT user_id) AS users FROM events WHERE value < 0.2 GROUP BY event_type",
)
def errors_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value < 0.2")
    return rows.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.countDistinct("user_id").alias("users"))


@query(
    "merged_with_provenance",
    """SELECT l_partkey AS k, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sources, count(*) AS hits FROM lineitem GROUP BY l_partkey""",
)
def merged_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return context.merged_with_provenance(rows, ["k"], "l_returnflag")


@query("first_of_titles", "SELECT p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY trim(lower(p_name)) ORDER BY p_partkey) = 1")
def first_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.first_of_titles(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query(
    "observation_changes",
    f"""WITH {GRAPH_SQL} SELECT id, CAST(len(list_filter(obs, lambda o: lower(o) NOT IN ('size: 7', 'segment: building'))) AS BIGINT) AS kept FROM nodes""",
)
def observation_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = context.without_notes(F.col("observations"), ["SIZE: 7", "segment: Building"])
    return graph_nodes(spark, sf_dir).select("id", F.size(kept).cast("bigint").alias("kept"))


@query(
    "severity_mentions",
    r"""SELECT conv_id, CAST(sum(least(len(regexp_extract_all(text, '(?i)high|critical|blocker')), 10)) AS BIGINT) AS high, CAST(sum(least(len(regexp_extract_all(text, '(?i)low|minor|info')), 30)) AS BIGINT) AS low FROM conversations GROUP BY conv_id""",
)
def severity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, _, low = context.severity_mentions(F.col("text"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(high).alias("high"), F.sum(low).alias("low"))


@query(
    "plan_complexities",
    """WITH p AS (SELECT l_orderkey, count(*) + 0.5 * count(DISTINCT l_partkey) + count(DISTINCT l_returnflag) + 0.3 * sum(CASE WHEN l_quantity < 17 THEN 1 WHEN l_quantity < 34 THEN 2 ELSE 3 END) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN s <= 4 THEN 'simple_plan' WHEN s <= 8 THEN 'moderate_plan' ELSE 'complex_plan' END AS class FROM p""",
)
def plan_complexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("l_quantity") < 17, 1).when(F.col("l_quantity") < 34, 2).otherwise(3)
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("tasks"), F.countDistinct("l_partkey").alias("entities"), F.countDistinct("l_returnflag").alias("limits"), F.sum(size).alias("files")
    )
    return counts.select("l_orderkey", context.plan_complexity(*map(F.col, ("tasks", "entities", "limits", "files"))).alias("class"))


@query(
    "folder_edges",
    """WITH p AS (SELECT string_split(url, '/') AS parts FROM pages WHERE contains(url, '/')), i AS (SELECT parts, unnest(range(1, len(parts))) AS i FROM p)
SELECT DISTINCT array_to_string(parts[1:i], '/') AS src, array_to_string(parts[1:i + 1], '/') AS dst, 'contains_item' AS kind FROM i""",
)
def folder_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.folder_edges(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query(
    "change_categories",
    r"""WITH p AS (SELECT url, string_split(url, '/') AS parts, lower(string_split(url, '/')[-1]) AS name FROM pages)
SELECT CASE WHEN regexp_matches(lower(url), 'test|spec') THEN 'tests' WHEN regexp_matches(name, '\.(md|markdown|txt|rst|doc|docx)$') THEN 'docs'
  WHEN regexp_matches(name, '\.(json|yml|yaml|toml|ini|env|rc)$') OR len(list_filter(parts, lambda x: starts_with(x, '.github') OR x IN ('.vscode', 'config'))) > 0 THEN 'config'
  WHEN ends_with(name, '.d.ts') THEN 'types' WHEN starts_with(name, '.') THEN 'dotfiles' ELSE array_to_string(parts[1:2], '/') END AS category, count(*) AS n FROM p GROUP BY 1""",
)
def change_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(context.change_category(F.col("url")).alias("category")).agg(F.count("*").alias("n"))


def _keyword_sql(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(t, '{w}')::INT" for w in words)


SCORES = ", ".join(f"{_keyword_sql(words)} AS {kind}" for kind, words in context.CHANGES.items())
BEST = f"greatest({', '.join(context.CHANGES)})"
KINDS = " ".join(f"WHEN {kind} = {BEST} THEN '{kind}'" for kind in context.CHANGES)


@query("change_kinds", f"WITH s AS (SELECT conv_id, turn, {SCORES} FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)) SELECT conv_id, turn, CASE {KINDS} END AS kind FROM s")
def change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", context.change_kind(F.col("text")).alias("kind"))


@query(
    "graph_prompt_projection",
    f"""WITH {GRAPH_SQL} SELECT id, CASE WHEN length(name) > 12 THEN substr(name, 1, 12) || '...' ELSE name END AS name, CAST(len(obs[1:2]) AS BIGINT) AS n_obs FROM nodes ORDER BY id LIMIT 200""",
)
def graph_prompt_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded picture of the graph: the first 200 nodes, short names, two observations."""
    from mnemospark.functions.strings import shorten

    rows = graph_nodes(spark, sf_dir).orderBy("id").limit(200)
    return rows.select("id", shorten("name", 12).alias("name"), F.size(F.slice("observations", 1, 2)).cast("bigint").alias("n_obs"))


@query("greedy_dedup")
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stay if longer ones go first and near copies of kept ones are dropped; the order makes it sequential for SQL."""
    return context.greedy_dedup(table(spark, sf_dir, "documents"), "doc_id", "text", "n_chars")


@query(
    "mere_mentions",
    r"""SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), 'will\s+(use|implement|work\s+on|need)|todo|fixme|note:|import.*from|see\s+also|refer\s+to|check\s+out|in\s+our\s+plan|we\s+will|should\s+use|\brelevant\s+files?\b')
OR (length(text) < 200 AND contains(lower(text), 'onor'))""",
)
def mere_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(context.mere_mention(F.col("text"), ["Onor"])).select("conv_id", "turn")


@query(
    "expanded_terms",
    f"""WITH {GRAPH_SQL}, n AS (SELECT DISTINCT name, lower(name) AS l FROM nodes), w AS (SELECT unnest(['show', 'every', 'red', 'boltt', 'europe']) AS w),
near AS (SELECT DISTINCT name FROM n, w WHERE length(l) > 0 AND (1 - levenshtein(w, l) / greatest(length(w), length(l))::DOUBLE > 0.7 OR 1 - levenshtein('show every red boltt of europe', l) / greatest(30, length(l))::DOUBLE > 0.6) ORDER BY name LIMIT 20)
SELECT name FROM n WHERE name IN ('show', 'every', 'boltt', 'europe') UNION SELECT name FROM n, w WHERE contains(l, w) UNION SELECT name FROM near""",
)
def expanded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the graph that a prompt may mean."""
    names = graph_nodes(spark, sf_dir).select("name").distinct()
    return context.expand_terms(names, "show every red boltt of europe")

"""Queries over texts: functions, review rules, chunking and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import strings, values
from mnemospark.operators import chunks, parsers, retrieval, review
from mnemospark.plans import questions
from mnemospark.plans.registry import ORACLE_SQL, query
from mnemospark.session import by_size, materialize
from mnemospark.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    "token_counts",
    r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents""",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_counts(_docs(spark, sf_dir))


query("token_counts_all_languages", ORACLE_SQL["token_counts"])(token_counts)  # the name it had while token_counts read one language


def _token_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(strings.tokens("text")).cast("bigint").alias("n"))


@query("char_overlap", "SELECT p_partkey, round(len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split(p_type, '')))) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS overlap FROM part")
def char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(strings.char_overlap("p_name", "p_type"), 6).alias("overlap"))


@query("name_similarity", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS score FROM part")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(strings.similarity("p_name", "p_type"), 6).alias("score"))


@query("doc_hash_dedup", "SELECT doc_id, sha256(text) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def doc_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hash")


@query(
    "near_dup_jaccard",
    r"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 2))) AS w FROM documents),
c AS (SELECT w, min(doc_id) AS id FROM t WHERE len(w) > 0 GROUP BY w)
SELECT 'member' AS kind, id AS a, doc_id AS b, 1.0::DOUBLE AS similarity FROM t JOIN c USING (w) WHERE doc_id <> id
UNION ALL SELECT 'similar', a.id, b.id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE, 6) FROM c a JOIN c b ON a.id < b.id
AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w)) AND len(list_intersect(a.w, b.w)) >= 0.85 * len(list_distinct(a.w || b.w))""",
)
def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of equal word sets, whatever their texts, and similar pairs between those classes."""
    plain = F.regexp_replace("text", r"[^\p{L}\p{N}_\s]", " ")  # letters of all languages make words here
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(plain), r"\s+"), lambda w: F.length(w) > 2)))
    sets = materialize(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), retrieval.packed(words).alias("words")), "word-sets", compression="zstd")
    classes = retrieval.set_classes(sets)
    pairs = retrieval.similar_classes(classes).select(F.lit("similar").alias("kind"), "a", "b", F.round("similarity", 6).alias("similarity"))
    return retrieval.set_members(sets, classes).select(F.lit("member").alias("kind"), "a", "b", F.lit(1.0).alias("similarity")).unionByName(pairs)


@query(
    "dup_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l)
SELECT doc_id, md5(line) AS line, count(*) AS n, min(pos) AS first_line FROM t WHERE length(line) > 50 GROUP BY doc_id, t.line HAVING count(*) > 1""",
)
def dup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.repeated_lines(_docs(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", F.md5("line").alias("line"), "n", F.col("first_line").cast("bigint").alias("first_line"))


@query(
    "dup_shingles_pct",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS a FROM l), w AS (SELECT *, lead(a, 1) OVER v AS b, lead(a, 2) OVER v AS c FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT concat_ws(chr(10), a, b, c) AS sh, CASE WHEN c IS NOT NULL THEN 3 WHEN b IS NOT NULL THEN 2 END AS size FROM w),
g AS (SELECT (count(*) - 1) * min(size) AS extra FROM s WHERE size IS NOT NULL AND length(regexp_replace(sh, '\s', '', 'g')) >= 15 GROUP BY sh)
SELECT CAST(coalesce(sum(extra), 0) AS BIGINT) AS extra, (SELECT count(*) FROM t) AS total, round(least(100.0, coalesce(sum(extra), 0) / (SELECT count(*) FROM t) * 100), 2) AS share FROM g""",
)
def dup_shingles_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.duplicated_share(_docs(spark, sf_dir), "doc_id", "text")


@query(
    "content_routing",
    r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(function|class|const|let|var|if|for|while|return|import|export)\b')) AS code,
  len(regexp_extract_all(text, '(?i)\b(the|and|or|but|in|on|at|to|for|of|with|by)\b')) AS prose FROM documents)
SELECT doc_id, CASE WHEN code > 2 AND NOT prose > 3 THEN 'code' ELSE 'documentation' END AS kind FROM c""",
)
def content_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content_routing(_docs(spark, sf_dir))


query("content_routing_all_languages", ORACLE_SQL["content_routing"])(content_routing)


def _content_routing(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", chunks.content_type(F.col("text"), F.lit(False)).alias("kind"))


@query(
    "secret_redaction",
    r"""SELECT page_id, md5(regexp_replace(html, '(?:^|\s)([a-f0-9]{32,})', '[REDACTED_SECRET]', 'gi')) AS redacted FROM pages""",
)
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages hold no other kind of secret; the other patterns have tests."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(strings.redact("html")).alias("redacted"))


@query(
    "url_parts",
    r"""SELECT page_id, string_split(url, '/')[-1] AS name, lower(regexp_extract(string_split(url, '/')[-1], '\.([^.]+)$', 1)) AS ext, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir,
  lower(translate(url, '\', '/')) AS canonical FROM pages""",
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", strings.basename("url").alias("name"), strings.extension("url").alias("ext"), strings.dirname("url").alias("dir"), strings.canonical_path("url").alias("canonical")
    )


@query("directory_groups", r"SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n, min(url) AS first_url FROM pages GROUP BY 1")
def directory_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(strings.dirname("url").alias("dir")).agg(F.count("*").alias("n"), F.min("url").alias("first_url"))


@query(
    "html_classes",
    r"""SELECT page_id, CAST(len(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(html, 'class(?:Name)?\s*=\s*["'']([^"'']*)["'']', 1), lambda a: regexp_split_to_array(a, '\s+'))), lambda t: t <> ''))) AS BIGINT) AS n FROM pages""",
)
def html_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(parsers.class_tokens(F.col("html"))).cast("bigint").alias("n"))


@query("html_entities")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, links, sources and classes of every page; a grammar that SQL lacks."""
    return parsers.html_parts(table(spark, sf_dir, "pages"), "page_id", "html").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query("markdown_parts")
def markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, links and code blocks, with each document under a heading of its source."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n[s](../"), "lang", F.lit(".md)\n```txt\n"), "text", F.lit("\n```\n## end")).alias("text"))
    return parsers.markdown_parts(docs, "doc_id", "text")


@query(
    "fixed_windows",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos // 3 AS "window", min(pos) + 1 AS first_line, max(pos) + 1 AS last_line, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l GROUP BY doc_id, pos // 3""",
)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.fixed_windows(_docs(spark, sf_dir), "doc_id", "text", 3)
    return found.select("doc_id", "window", F.col("first_line").cast("bigint").alias("first_line"), F.col("last_line").cast("bigint").alias("last_line"), "n_chars")


@query("chunk_windows")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of whole lines, by their hashes."""
    found = chunks.line_windows(_docs(spark, sf_dir), "doc_id", "text", 1200, 200)
    return found.select("doc_id", "chunk", "start_line", "end_line", F.sha2("text", 256).alias("hash"))


@query("long_context_parts", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def long_context_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every text, which together have all its characters."""
    parts = chunks.sentence_splits(_docs(spark, sf_dir), "doc_id", "text")
    return parts.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"))


@query(
    "embed_batches",
    """WITH RECURSIVE d AS (SELECT source AS queue, doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t, row_number() OVER w AS rn, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER w AS total
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
b AS (SELECT queue, 1::BIGINT AS rn, 0 AS batch FROM d WHERE rn = 1
  UNION ALL SELECT b.queue, min(n.rn), b.batch + 1 FROM b JOIN d s ON s.queue = b.queue AND s.rn = b.rn JOIN d n ON n.queue = b.queue AND n.rn > b.rn AND (n.rn >= b.rn + 100 OR n.total > s.total - s.t + 20000)
  GROUP BY b.queue, b.rn, b.batch)
SELECT d.queue, doc_id, batch FROM d ASOF JOIN b ON d.queue = b.queue AND d.rn >= b.rn""",
)
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches of the documents of each source, in whole queues."""
    rows = _docs(spark, sf_dir).select(F.col("source").alias("queue"), "doc_id", values.token_estimate(F.col("text")).alias("tokens"))
    return chunks.greedy_batches(rows, "queue", "doc_id", "tokens")


@query("token_estimates", "SELECT lang, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(values.token_estimate(F.col("text"))).alias("tokens"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of code for each order line, made from its columns, with faults that depend on them."""
    line = F.col("l_linenumber")
    code = (
        F.when(line == 1, F.concat(F.lit("el.innerHTML = a +"), F.col("l_partkey").cast("string"), F.lit(";")))
        .when(line == 2, F.concat(F.lit("const h = md5("), F.col("l_suppkey").cast("string"), F.lit(");")))
        .when(line == 3, F.concat(F.lit("fs.readFileSync(p"), F.col("l_partkey").cast("string"), F.lit("); // null")))
        .when(line == 4, F.concat(F.lit("let z = "), F.col("l_suppkey").cast("string"), F.lit(";")))
        .otherwise(F.concat(F.lit("run("), F.col("l_partkey").cast("string"), F.lit(")")))
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", code.alias("code")))).alias("x"))
    return lines.select(F.col("l_orderkey").alias("path"), F.array_join(F.transform("x", lambda s: s["code"]), "\n").alias("content"))


FOUND = """f AS (
  SELECT l_orderkey AS path, 'CWE-79' AS rule, 'security' AS engine, 'CRITICAL' AS severity, 'LOW' AS effort FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT l_orderkey, 'CWE-326', 'security', 'MAJOR', 'MEDIUM' FROM lineitem WHERE l_linenumber = 2
  UNION ALL SELECT l_orderkey, 'naming-convention', 'maintainability', 'MINOR', 'LOW' FROM lineitem WHERE l_linenumber IN (2, 4)
  UNION ALL SELECT l_orderkey, 'async-pattern', 'performance', 'MAJOR', 'LOW' FROM lineitem WHERE l_linenumber = 3
  UNION ALL SELECT l_orderkey, 'null-safety', 'reliability', 'MINOR', 'LOW' FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS rn FROM lineitem
    WHERE l_linenumber = 1 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)) WHERE rn <= 3)"""


@query("severity_pivot", f"WITH {FOUND} SELECT engine, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'MAJOR') AS major, count(*) FILTER (WHERE severity = 'MINOR') AS minor FROM f GROUP BY engine")
def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.findings(_code(spark, sf_dir))
    made = found.groupBy("engine").pivot("severity", ["CRITICAL", "MAJOR", "MINOR"]).count().na.fill(0)
    return made.select("engine", *[F.col(c).alias(c.lower()) for c in ("CRITICAL", "MAJOR", "MINOR")])


@query(
    "quality_gate",
    f"""WITH {FOUND}, c AS (SELECT path, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS cr, count(*) FILTER (WHERE severity = 'MAJOR') AS ma,
  sum(CASE severity WHEN 'CRITICAL' THEN 4.0 WHEN 'MAJOR' THEN 2.0 ELSE 1.0 END * CASE effort WHEN 'MEDIUM' THEN 2.0 ELSE 1.0 END)::DOUBLE AS debt FROM f GROUP BY path)
SELECT path, n AS n_findings, debt AS debt_hours, least(50, 2 * n) AS debt_ratio, CASE WHEN cr > 0 THEN 'D' WHEN ma > 3 THEN 'C' ELSE 'A' END AS security_rating,
  CASE WHEN cr > 0 OR 2 * n > 20 THEN 'WARNING' ELSE 'PASS' END AS gate FROM c""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.metrics(review.findings(_code(spark, sf_dir)), ["path"])
    return found.select("path", "n_findings", "debt_hours", "debt_ratio", "security_rating", "gate")


@query("finding_lines", f"WITH {FOUND} SELECT rule, count(*) AS n FROM f GROUP BY rule")
def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.findings(_code(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "diff_lines",
    """WITH o AS (SELECT l_orderkey AS d, l_linenumber AS ln, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS rn, l_returnflag AS rf, l_partkey FROM lineitem)
SELECT d, 'f' || d || '.ts' AS file, CASE rf WHEN 'R' THEN 'removed' WHEN 'A' THEN 'added' ELSE 'context' END AS kind,
  CAST(CASE WHEN rf = 'R' THEN 10 + count(*) FILTER (WHERE rf <> 'A') OVER w ELSE 20 + count(*) FILTER (WHERE rf <> 'R') OVER w END - 1 AS INT) AS number
FROM o WINDOW w AS (PARTITION BY d ORDER BY rn ROWS UNBOUNDED PRECEDING)""",
)
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each order: returned lines are removed, accepted ones added."""
    mark = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" ")
    lines = by_size(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d"), "l_linenumber", "l_partkey", "l_returnflag"), "d").groupBy("d").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", mark.alias("m")))).alias("x"))
    body = F.array_join(F.transform("x", lambda s: F.concat(s["m"], s["l_partkey"].cast("string"))), "\n")
    key = F.col("d").cast("string")
    text = F.concat(F.lit("diff --git a/f"), key, F.lit(".ts b/f"), key, F.lit(".ts\n@@ -10,9 +20,9 @@\n"), body)
    return review.diff_lines(lines.select("d", text.alias("text")), "d", "text").select("d", "file", "kind", F.col("number").cast("int").alias("number"))


@query(
    "json_props",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, false AS broken FROM events""",
)
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads through the repair and a typed parse with an error flag."""
    value, broken = values.parsed(values.repair_json(F.col("props")), "k bigint")
    return table(spark, sf_dir, "events").select("event_id", value["k"].alias("k"), broken.alias("broken"))


@query(
    "question_intents",
    """WITH q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, ((t LIKE '%no%')::INT + (t LIKE '%not%')::INT + (t LIKE '%without%')::INT) * 0.5 AS neg,
  (t LIKE '%compare%')::INT * 1.7 + (t LIKE '%versus%')::INT * 1.6 AS cmp FROM q)
SELECT conv_id, turn, round((neg + cmp)::DOUBLE, 6) AS signal FROM s""",
)
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    signal = questions.keyword_signal(F.col("text"), ("compare", "versus")) + questions.negation_signal(F.col("text"), ("no", "not", "without"))
    return asked.select("conv_id", "turn", F.round(signal, 6).alias("signal"))


@query("question_plans")
def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, limit, sort and filters of every user message; the rules have tests of their own."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", questions.structured(F.col("text")).alias("q")).select("conv_id", "turn", "q.intent", "q.confidence", "q.limit", "q.sort_by", "q.entity_type")


@query(
    "citation_metrics",
    """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), u AS (SELECT l_orderkey AS k, l_suppkey % 9 AS n FROM lineitem),
c AS (SELECT k, count(*) AS used FROM u GROUP BY k), v AS (SELECT k, count(*) AS valid FROM (SELECT DISTINCT k, n FROM u) JOIN l USING (k, n) GROUP BY k), t AS (SELECT k, count(*) AS n FROM l GROUP BY k)
SELECT k, round(coalesce(valid, 0) / used, 6) AS accuracy, round(coalesce(valid, 0) / n, 6) AS coverage, round(0.6 * (coalesce(valid, 0) / used) + 0.4 * (coalesce(valid, 0) / n), 6) AS quality
FROM c JOIN t USING (k) LEFT JOIN v USING (k)""",
)
def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers: they cite numbers made of their suppliers and have as many sources as lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 9).alias("cited"))
    mark = F.concat(F.lit("[cite_"), F.col("cited").cast("string"), F.lit("]"))
    answers = lines.groupBy("k").agg(F.concat_ws(" ", F.collect_list(mark)).alias("answer"))
    made = retrieval.citation_metrics(answers, lines.select("k", "n"), "k", "answer")
    return made.select("k", *[F.round(c, 6).alias(c) for c in ("accuracy", "coverage", "quality")])

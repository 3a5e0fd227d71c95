"""Queries over records that Spark derives from the given tables: entities, findings, prompts, routes and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import strings, values
from mnemospark.functions.vectors import resample
from mnemospark.operators import chunks, context, graph, parsers, retrieval, review, search
from mnemospark.plans import dsl, questions
from mnemospark.plans.registry import query
from mnemospark.session import dealt, materialize
from mnemospark.sources.tables import GRAPH_SQL, graph_edges, graph_nodes, table
from mnemospark.streaming import event_stream

G = f"WITH {GRAPH_SQL}"


def _text(*parts) -> F.Column:
    """Literals and columns as one text."""
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


# graph


@query(
    "entity_edges",
    """WITH l AS (SELECT DISTINCT 'o' || l_orderkey || '.ts' AS f, l_linenumber AS n, l_suppkey AS s, l_returnflag AS r FROM lineitem)
SELECT f || '::m' || n AS src, f AS dst, 'defined_in_file' AS kind FROM l
UNION SELECT f || '::m1', f || '::m' || n, 'has_method' FROM l WHERE n > 1 AND r = 'R'
UNION SELECT f || '::m' || n, f || '::m' || (n + 1), CASE WHEN r = 'A' THEN 'calls_method' ELSE 'calls_function' END FROM l
UNION SELECT f || '::m' || n, f || '::I' || s, 'implements_interface' FROM l WHERE n = 1""",
)
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files whose lines are a class, its methods and functions."""
    line = F.col("l_linenumber")
    kind = F.when(line == 1, "class").when(F.col("l_returnflag") == "R", "method").otherwise("function")
    call = F.struct(F.concat(F.lit("m"), (line + 1).cast("string")).alias("name"), F.when(F.col("l_returnflag") == "A", "method").otherwise("function").alias("type"))
    made = table(spark, sf_dir, "lineitem").select(
        _text("o", "$l_orderkey", ".ts").alias("file"), _text("o", "$l_orderkey", ".ts::m", "$l_linenumber").alias("full_name"), kind.alias("type"),
        F.when(kind == "method", "m1").alias("parent_class"), F.array(call).alias("calls"), F.array(_text("I", "$l_suppkey")).alias("interfaces"),
    )
    return graph.entity_edges(made)


ENDPOINTS = r"""WITH c AS (SELECT 'Shop\N' || (c_custkey % 7) || '\' || c_name AS cls, c_custkey AS k, c_name AS n FROM customer),
nodes AS (SELECT cls AS name, 'c:' || k AS id FROM c UNION ALL SELECT cls || '::run' || k, 'm:' || k FROM c WHERE k % 2 = 0 UNION ALL SELECT cls || '::same', 't:' || k FROM c WHERE k % 3 = 0),
w AS (SELECT cls AS wanted, 'c:' || k AS id, 'exact' AS strategy FROM c WHERE k % 6 = 0
  UNION ALL SELECT 'src/a.php::' || cls, 'c:' || k, 'file_prefix' FROM c WHERE k % 6 = 1
  UNION ALL SELECT '\' || cls, 'c:' || k, 'namespace' FROM c WHERE k % 6 = 2
  UNION ALL SELECT n || '::same', 't:' || k, 'class_member' FROM c WHERE k % 6 = 3
  UNION ALL SELECT 'Other::run' || k, 'm:' || k, 'member' FROM c WHERE k % 6 = 4
  UNION ALL SELECT n, 'c:' || k, 'suffix' FROM c WHERE k % 6 = 5)
SELECT wanted, id, strategy FROM w"""


@query("endpoint_strategies", ENDPOINTS)
def endpoint_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as classes of seven namespaces with members, and mentions of them in six forms; a form that means nothing stays out."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(key.alias("k"), F.col("c_name").alias("n"), F.concat(F.lit("Shop\\N"), (key % 7).cast("string"), F.lit("\\"), "c_name").alias("cls"))
    nodes = c.select(F.col("cls").alias("name"), _text("c:", "$k").alias("id"))
    nodes = nodes.unionByName(c.where("k % 2 = 0").select(_text("$cls", "::run", "$k").alias("name"), _text("m:", "$k").alias("id")))
    nodes = nodes.unionByName(c.where("k % 3 = 0").select(_text("$cls", "::same").alias("name"), _text("t:", "$k").alias("id")))
    forms = [_text("$cls"), _text("src/a.php::", "$cls"), _text("\\", "$cls"), _text("$n", "::same"), _text("Other::run", "$k"), _text("$n")]
    wanted = F.lit("Nobody\\Here")
    for i, form in enumerate(forms):
        wanted = F.when(F.col("k") % 6 == i, form).otherwise(wanted)
    return graph.resolve_endpoints(c.select(wanted.alias("wanted")), nodes)


@query(
    "bfs_from_first_hit",
    f"""WITH RECURSIVE {GRAPH_SQL}, s AS (SELECT min(id) AS id FROM nodes WHERE lower(name) LIKE '%urop%' OR lower(entity_type) LIKE '%urop%' OR len(list_filter(obs, lambda o: lower(o) LIKE '%urop%')) > 0),
walk AS (SELECT id, 0 AS depth FROM s UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = id WHERE depth < 2)
SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY id""",
)
def bfs_from_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No node has this name, so the walk starts from the first that a search finds."""
    return dsl.execute("traverse:urop:outgoing:2", graph_nodes(spark, sf_dir), materialize(graph_edges(spark, sf_dir), "edges")).select("id", "depth")


@query(
    "index_statistics",
    f"""{G}, t AS (SELECT trim(regexp_replace(regexp_replace(lower(concat_ws(' ', name, entity_type, array_to_string(obs, ' '))), '[^a-z0-9\\s_\\-.]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM nodes),
f AS (SELECT regexp_replace(s, '\\s+', '', 'g') AS f FROM t)
SELECT (SELECT count(*) FROM nodes) AS nodes,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(list_filter(regexp_split_to_array(s, '[\\s_\\-.]+'), lambda z: z <> '')) AS x FROM t)) AS tokens,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(CASE WHEN length(f) < 2 THEN [f] ELSE list_transform(range(1, length(f)), lambda i: substr(f, i, 2)) END) AS x FROM f)) AS bigrams,
  (SELECT count(DISTINCT x) FROM (SELECT unnest(CASE WHEN length(f) < 3 THEN [f] ELSE list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3)) END) AS x FROM f)) AS trigrams""",
)
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_statistics(graph_nodes(spark, sf_dir))


@query(
    "graph_prompt",
    f"""{G}, n AS (SELECT id, name, entity_type, list_transform(obs[1:3], lambda o: CASE WHEN length(o) > 70 THEN o[1:70] || '...' ELSE o END) AS observations FROM nodes ORDER BY id LIMIT 200),
e AS (SELECT src, dst, kind FROM edges ORDER BY src, dst, kind LIMIT 200)
SELECT to_json({{'nodes': (SELECT list({{'id': id, 'name': name, 'entity_type': entity_type, 'observations': observations}} ORDER BY id) FROM n),
  'relations': (SELECT list({{'src': src, 'dst': dst, 'kind': kind}} ORDER BY src, dst, kind) FROM e)}})::VARCHAR AS text""",
)
def graph_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nodes and edges; two hundred of each is the feature."""
    return context.graph_prompt(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


@query(
    "graph_prompt_summary",
    f"""{G} SELECT 'nodes: id, name, entity_type, observations; relations: src, dst, kind; total nodes: ' || (SELECT count(*) FROM nodes) || ', total relations: ' || (SELECT count(*) FROM edges) AS text""",
)
def graph_prompt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph whose text is too long gives its fields and counts."""
    return context.graph_prompt(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), longest=1000)


POINTS = """WITH q AS (SELECT p_partkey AS query_id, lower(p_name) AS w, p_partkey % 7 AS want FROM part WHERE p_partkey % 100 = 0),
d AS (SELECT p_partkey AS id, [lower(p_name), lower(p_brand)] AS own, p_partkey % 5 AS have, p_size, p_retailprice FROM part),
k AS (SELECT *, ['class', 'interface', 'function', 'method', 'file', 'asset', 'none'][have + 1] AS hk, ['class', 'interface', 'function', 'method', 'file', 'asset', 'none'][want + 1] AS wk FROM q, d WHERE query_id <> id),
s AS (SELECT query_id, id, w, own, CASE WHEN list_contains(own, w) THEN 100.0 ELSE 45 * least(1.0, (0.7 * list_max(list_transform(own, lambda n: 1 - levenshtein(n, w) / greatest(length(n), length(w))::DOUBLE))
    + 0.3 * list_max(list_transform(own, lambda n: len(list_intersect(list_distinct(string_split(n, '')), list_distinct(string_split(w, '')))) / len(list_distinct(string_split(n, '') || string_split(w, '')))::DOUBLE))
    + CASE WHEN len(list_filter(own, lambda n: starts_with(n, w))) > 0 THEN 0.2 ELSE 0.0 END)
    * CASE WHEN least(length(w), list_min(list_transform(own, lambda n: length(n)))) < 3 THEN 0.4 WHEN least(length(w), list_min(list_transform(own, lambda n: length(n)))) < 5 THEN 0.7 ELSE 1.0 END) END
  + CASE WHEN hk = wk THEN 30.0 WHEN (hk, wk) IN (('class', 'interface'), ('function', 'method'), ('file', 'asset')) THEN 15.0 WHEN (wk, hk) IN (('class', 'interface'), ('function', 'method'), ('file', 'asset')) THEN 10.0 ELSE 0.0 END
  + least(25, 5 * (p_size % 3 = 0)::INT) + 50 * (have / 10.0) + 20 * (p_retailprice > 1500)::INT - 30 * (p_size < 5)::INT AS score FROM k),
x AS (SELECT query_id, id, score + CASE WHEN score < 40 AND len(list_filter(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), lambda g: contains(own[1], g))) > 0 THEN 10 ELSE 0 END AS score FROM s)
SELECT query_id, id, round(score, 6) AS score FROM x WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) = 1"""


@query("entity_resolution_points", POINTS)
def entity_resolution_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hundredth part the other that answers it best with 50 points or more, by names, kinds, notes, vectors and marks."""
    kinds = F.array(*[F.lit(k) for k in ("class", "interface", "function", "method", "file", "asset", "none")])
    kind = lambda n: F.get(kinds, F.col(n).cast("int"))
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.array("p_name", "p_brand").alias("names"), (F.col("p_partkey") % 5).alias("have"), (F.col("p_retailprice") > 1500).alias("dear"), (F.col("p_size") < 5).alias("small"),
        F.array(F.when(F.col("p_size") % 3 == 0, "three sizes").otherwise("other")).alias("notes"),
    )
    queries = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("wanted"), (F.col("p_partkey") % 7).alias("want"))
    clues = F.array(F.lit("three"), F.lit("three"), F.lit("zzz"))

    def scored(wishes: DataFrame, classes: DataFrame) -> DataFrame:
        names, asked = materialize(classes.select("names").distinct(), "names"), wishes.select("wanted").distinct()
        named = materialize(search.against_all(asked, dealt(names), F.lit(True)).withColumn("named", search.name_points(F.col("names"), F.col("wanted"))), "named")
        met = classes.join(named.join(wishes, "wanted"), "names")
        points = search.resolution_points(F.col("names"), F.col("wanted"), kind("have"), kind("want"), F.col("notes"), clues, F.col("have") / 10.0, F.col("dear"), F.col("small"), F.col("named"))
        return met.withColumn("score", F.round(points, 6)).where("score >= 50")

    return search.best_of_classes(queries, part, ["wanted", "want"], ["names", "have", "dear", "small", "notes"], scored)


# reviews

#: Snippets that break one rule each, by number, and the rules found in them.
FAULTS = (
    ("CWE-78", "execSync ( `rm`, ${p} )"),
    ("CWE-89", "query ( a + b )"),
    ("CWE-79", "el.innerHTML = a + b"),
    ("CWE-798", "password = 'hunter2hunter2'"),
    ("CWE-326", "md5 (x)"),
    ("complexity", "for (a) { for (b) { } }"),
    ("async-pattern", "writeFileSync(p)"),
    ("memory-usage", "JSON.parse(" + "x" * 120 + ")"),
    ("algorithm-efficiency", "for (a) { b?.find (c); q.find (d) }"),
    ("naming-convention", "let z = 1"),
    ("method-length", "function long() { " + "y;" * 800 + " }"),
    ("error-handling", "async function f() { g() }"),
    ("resource-management", "fs.open(p)"),
    ("null-safety", "a.b"),
    ("cyclomatic-complexity", "function many() { " + "if (q) ; " * 11 + " }"),
    ("code-duplication", ("x" * 60 + "\n") * 2),
    ("", "nothing here"),
)


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order line; its part says which rule it breaks."""
    snippets = F.array(*[F.lit(code) for _, code in FAULTS])
    files = table(spark, sf_dir, "lineitem").select(_text("$l_orderkey", "/", "$l_linenumber").alias("path"), (F.col("l_partkey") % len(FAULTS)).cast("int").alias("s")).distinct()
    return files.select("path", F.get(snippets, F.col("s")).alias("content"))


#: (snippet, rule, engine, severity) of all that the rules find in the snippets; tests compare it with the patterns.
EXPECTED = (
    (0, "CWE-78", "security", "BLOCKER"), (0, "CWE-78", "security", "BLOCKER"), (0, "async-pattern", "performance", "MAJOR"),
    (1, "CWE-89", "security", "BLOCKER"), (2, "CWE-79", "security", "CRITICAL"), (2, "null-safety", "reliability", "MINOR"),
    (3, "CWE-798", "security", "CRITICAL"), (4, "CWE-326", "security", "MAJOR"), (5, "complexity", "performance", "MAJOR"),
    (6, "async-pattern", "performance", "MAJOR"), (7, "memory-usage", "performance", "MINOR"), (7, "null-safety", "reliability", "MINOR"),
    (8, "algorithm-efficiency", "performance", "MAJOR"), (9, "naming-convention", "maintainability", "MINOR"), (10, "method-length", "maintainability", "MINOR"),
    (11, "error-handling", "reliability", "MAJOR"), (12, "resource-management", "reliability", "MAJOR"), (12, "null-safety", "reliability", "MINOR"),
    (13, "null-safety", "reliability", "MINOR"), (14, "cyclomatic-complexity", "maintainability", "MINOR"), (15, "code-duplication", "maintainability", "MINOR"),
)
FAULT_SQL = f"""p AS (SELECT DISTINCT l_orderkey || '/' || l_linenumber AS path, l_partkey % {len(FAULTS)} AS s FROM lineitem),
v AS (SELECT * FROM (VALUES {", ".join(map(str, EXPECTED))}) t(s, rule, engine, severity)), f AS (SELECT path, rule, engine, severity FROM p JOIN v USING (s))"""


@query("findings_by_rule", f"WITH {FAULT_SQL} SELECT rule, severity, count(*) AS n, count(DISTINCT path) AS files FROM f GROUP BY rule, severity")
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen rules over files of which each breaks one on purpose."""
    found = review.findings(_faulty(spark, sf_dir))
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query(
    "engine_summary",
    f"""WITH {FAULT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY CASE severity WHEN 'BLOCKER' THEN 5 WHEN 'CRITICAL' THEN 4 WHEN 'MAJOR' THEN 3 WHEN 'MINOR' THEN 2 ELSE 1 END DESC, path, rule) AS rn FROM f)
SELECT engine, count(*) AS total, count(*) FILTER (WHERE severity = 'BLOCKER') AS blocker, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'MAJOR') AS major,
  count(*) FILTER (WHERE severity = 'MINOR') AS minor, count(*) FILTER (WHERE severity = 'INFO') AS info, count(*) FILTER (WHERE severity IN ('BLOCKER', 'CRITICAL')) AS high,
  string_agg(severity || ' ' || rule || ' ' || path, ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS top FROM r GROUP BY engine""",
)
def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, five severities and the three worst findings of each engine."""
    made = review.engine_summary(review.findings(_faulty(spark, sf_dir)))
    named = F.transform("top", lambda t: F.concat_ws(" ", t["severity"], t["rule"], t["path"]))
    return made.withColumn("top", F.array_join(named, ", "))


@query(
    "evidence_ranges",
    """SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INT) AS first_line, CAST(CASE WHEN l_returnflag = 'R' THEN l_linenumber + l_suppkey ELSE l_linenumber END AS INT) AS last_line FROM lineitem""",
)
def evidence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines from texts such as "lines 3-12"."""
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("lines "), F.col("l_linenumber").cast("string"), F.lit("-"), (F.col("l_linenumber") + F.col("l_suppkey")).cast("string"))).otherwise(_text("line ", "$l_linenumber"))
    start, end = review.line_range(text)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("first_line"), end.alias("last_line"))


@query(
    "secret_kinds",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (1, 2) THEN 'a[REDACTED_SECRET] b' WHEN o_orderkey % 10 = 9 THEN 'a harmless b' ELSE 'a [REDACTED_SECRET] b' END AS redacted FROM orders",
)
def secret_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with each of the nine kinds of secrets, and one without."""
    key = "ab12"
    kinds = (
        '"api_key": "abcdefgh12"', "sk_" + key * 6, key * 9, f"eyJ{key}.{key}-_.{key}_", "AKIA" + "A1B2C3D4" * 2, "ghp_" + key * 9, "github_pat_" + key * 20 + "xy", "AIza" + key * 8 + "-_x",
        "-----BEGIN RSA PRIVATE KEY-----\nxyz\n-----END RSA PRIVATE KEY-----", "harmless",
    )
    text = F.concat(F.lit("a "), F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 10).cast("int")), F.lit(" b"))
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.redact(text).alias("redacted"))


@query(
    "content_kinds",
    """SELECT o_orderkey, o_orderkey % 4 = 0 AND o_custkey % 2 = 0 AS is_source, o_orderkey % 4 IN (1, 2) OR o_orderkey % 4 = 3 AS is_mention FROM orders""",
)
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in the file that was asked for, plans, references and short mentions."""
    texts = ("export class OrderBook { constructor() { } } " + "x" * 200, "we will use it later " + "x" * 200, "see also the manual " + "x" * 200, "the order book")
    text = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 4).cast("int"))
    path = F.when(F.col("o_custkey") % 2 == 0, "src/Order_Book.ts").otherwise("src/other.ts")
    rows = table(spark, sf_dir, "orders").withColumns({"text": text, "path": path})
    return rows.select("o_orderkey", context.source_content(F.col("path"), F.col("text"), ["order book"]).alias("is_source"), context.mere_mention(F.col("text"), ["order book"]).alias("is_mention"))


# texts


@query(
    "routing_distribution",
    """WITH k AS (SELECT l_orderkey % 5 AS s FROM lineitem) SELECT CASE s WHEN 0 THEN 'code' WHEN 1 THEN 'documentation' WHEN 2 THEN 'comment' WHEN 3 THEN 'comment' ELSE 'summary' END AS kind,
  count(*) FILTER (WHERE s IN (0, 2)) AS code_model, count(*) FILTER (WHERE s NOT IN (0, 2)) AS prose_model FROM k GROUP BY 1""",
)
def routing_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by kind and model: code, prose, comments of either sort, summaries."""
    texts = ("const a = 1; let b = 2; return a", "the cat and the dog or the cow", "// const a; let b; return c", "// the cat and the dog or the cow", "anything")
    pick = (F.col("l_orderkey") % 5).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(chunks.routed(F.get(F.array(*[F.lit(t) for t in texts]), pick), pick == 4).alias("r")).select("r.*")
    return chunks.routing_distribution(rows)


@query(
    "balanced_models",
    """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'a' ELSE 'b' END AS model FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY o_orderkey) AS rn, count(*) OVER () AS total, count(*) OVER (PARTITION BY model) AS own FROM m)
SELECT CASE WHEN own > 0.8 * total AND rn > floor(0.7 * total) THEN 'a' ELSE model END AS model, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM n GROUP BY 1""",
)
def balanced_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of the rows belong to one model; those past seven tenths go to the other."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "a").otherwise("b").alias("model"))
    return chunks.balanced(rows, "model", "o_orderkey").groupBy("model").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("long_context_offsets")
def long_context_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and hash of every part of every text; cuts depend on the ones before, so a test walks the texts."""
    parts = chunks.sentence_splits(table(spark, sf_dir, "documents"), "doc_id", "text")
    return parts.select("doc_id", "part", F.length("text").alias("n_chars"), F.md5("text").alias("hash"))


@query(
    "entity_chunks",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id, 'head' AS name, array_to_string(l[1:3], chr(10)) AS t FROM l UNION ALL SELECT doc_id, 'rest', array_to_string(l[4:len(l)], chr(10)) FROM l)
SELECT doc_id, name, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS hash FROM c WHERE length(t) >= 100""",
)
def entity_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of a text and the others, as entities; short ones go."""
    entity = lambda name, a, b: F.struct(F.lit(name).alias("name"), F.lit(a).alias("start"), (F.lit(b) if isinstance(b, int) else b).alias("end"))
    files = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(entity("head", 1, 3), entity("rest", 4, F.size(F.split("text", "\n")))).alias("entities"))
    made = chunks.entity_chunks(files, "text", "entities")
    return made.select("doc_id", "name", F.length("text").cast("bigint").alias("n_chars"), "hash")


@query("repaired_texts", "SELECT doc_id, source, sha256(text) AS hash, false AS broken FROM documents")
def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in JSON with a fence, bare keys, single quotes, raw line breaks and tabs, and its end missing."""
    docs = table(spark, sf_dir, "documents")
    plain = F.to_json(F.struct("text"))
    body = F.replace(F.replace(F.expr("substr(t, 2, length(t) - 2)"), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    rows = docs.withColumn("t", plain).select("doc_id", F.concat(F.lit("```json\n{doc_id: "), F.col("doc_id").cast("string"), F.lit(", 'source': '"), "source", F.lit("', "), body, F.lit(",\n```")).alias("raw"))
    value, broken = values.parsed(values.repair_json(F.col("raw")), "doc_id bigint, source string, text string")
    return rows.select("doc_id", value.alias("v"), broken.alias("broken")).select("v.doc_id", "v.source", F.sha2("v.text", 256).alias("hash"), "broken")


@query(
    "repaired_json",
    """SELECT event_id, CASE WHEN event_id % 6 < 5 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 6 = 4 THEN 'x, y: z' END AS note, event_id % 6 = 5 AS broken FROM events""",
)
def repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in fences, with bare keys, trailing commas, HTML escapes, a text that looks like a key, or beyond repair."""
    k = F.get_json_object("props", "$.k")
    forms = (
        F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("{k: "), k, F.lit("}")), F.concat(F.lit('{"k": '), k, F.lit(",}")),
        F.concat(F.lit("{&quot;k&quot;: "), k, F.lit("}")), F.concat(F.lit('{"note": "x, y: z", "k": '), k, F.lit("}")), F.lit("{{{"),
    )
    raw = F.get(F.array(*forms), (F.col("event_id") % 6).cast("int"))
    value, broken = values.parsed(values.repair_json(raw), "k bigint, note string")
    rows = table(spark, sf_dir, "events").select("event_id", value.alias("v"), broken.alias("broken"))
    return rows.select("event_id", "v.k", "v.note", "broken")


JSON_COLUMNS = ("goals", "tasks", "entities", "constraints", "files", "context", "options", "notes")


@query(
    "refined_prompts",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at, "
    + ", ".join(f"CASE WHEN event_id % 8 <> {i} THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS {c}, event_id % 8 = {i} AS {c}_broken" for i, c in enumerate(JSON_COLUMNS))
    + " FROM events",
)
def refined_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight JSON columns, each parsed with a flag of its own, and a time as ISO text; one of the eight is broken."""
    out = []
    for i, name in enumerate(JSON_COLUMNS):
        value, broken = values.parsed(F.when(F.col("event_id") % 8 == i, "{broken").otherwise(F.col("props")), "k bigint")
        out += [value["k"].alias(name), broken.alias(f"{name}_broken")]
    return table(spark, sf_dir, "events").select("event_id", values.iso_time(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"), *out)


@query(
    "question_fallbacks",
    "WITH q AS (SELECT p_partkey, p_name, p_type, p_partkey % 32 AS s FROM part) SELECT p_partkey, CASE WHEN s < 20 OR s = 31 THEN 'search' WHEN s < 25 THEN 'semantic' WHEN s < 27 THEN 'compare' WHEN s = 27 THEN 'analyze' ELSE 'transform' END AS type, "
    + "CASE s " + " ".join(f"WHEN {i} THEN '{p.removesuffix(' pattern').replace(' ', '_')}'" for i, p in enumerate(questions.PATTERN_PHRASES)) + " END AS pattern, "
    "CASE WHEN s < 20 THEN NULL WHEN s IN (25, 26) THEN p_name || '|' || p_type WHEN s = 31 THEN 'tell me of ' || p_name ELSE p_name END AS entities, CASE WHEN s IN (28, 29, 30) THEN p_type END AS target FROM q",
)
def question_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about parts in each of the thirty-one phrases, and one in none."""
    asked = [F.lit(f"show the {p.upper()}") for p in questions.PATTERN_PHRASES]
    for phrase, _, second in questions.BLANK_PHRASES:
        head, middle, *tail = phrase.split("(.*)")
        asked.append(F.concat(F.lit(head.capitalize()), "p_name", F.lit(middle), *([F.col("p_type"), F.lit(tail[0])] if second else [])))
    asked.append(F.concat(F.lit(" tell me of "), "p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", questions.fallback(F.get(F.array(*asked), (F.col("p_partkey") % 32).cast("int"))).alias("f"))
    return rows.select("p_partkey", "f.type", "f.pattern", F.array_join("f.entities", "|").alias("entities"), "f.target")


@query(
    "question_names",
    """SELECT p_partkey, name, kind, sure AS confidence FROM (
  SELECT p_partkey, p_name AS name, 'class' AS kind, 1.0::DOUBLE AS sure FROM part UNION ALL SELECT p_partkey, 'Load_' || p_partkey || '.py', 'file', 1.0 FROM part
  UNION ALL SELECT p_partkey, '_' || p_partkey, 'variable', 0.9 FROM part UNION ALL SELECT p_partkey, '_name', 'variable', 0.95 FROM part UNION ALL SELECT p_partkey, 'user_name', 'unknown', 0.55 FROM part)""",
)
def question_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that questions about parts mention, with kinds and confidences."""
    asked = F.concat(F.lit('Class "'), "p_name", F.lit('" as the first of many things that are asked here, then async file Load_'), F.col("p_partkey").cast("string"), F.lit(".py and in the end, much later on, the one that people call user_name"))
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", F.explode(questions.named_entities(asked)).alias("e"))
    return rows.select("p_partkey", F.col("e.text").alias("name"), F.col("e.type").alias("kind"), F.round("e.confidence", 6).alias("confidence"))


# files, vectors and events


@query(
    "pattern_ranking",
    """WITH s AS (SELECT url AS path, sum(10 * contains(regexp_extract(lower(url), '[^/]*$'), t)::INT + 5 * contains(lower(url), t)::INT + 3 * contains(lower(url), '/' || t || '/')::INT) AS score
FROM (SELECT DISTINCT page_id, url FROM pages), (SELECT unnest(['fr', 'page', '82']) AS t) GROUP BY page_id, url)
SELECT path, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 50""",
)
def pattern_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best paths for some terms."""
    return retrieval.ranked_patterns(table(spark, sf_dir, "pages"), "url", ["FR", "page", "82"]).withColumnRenamed("url", "path")


@query("source_coverage", "SELECT user_id, round(count(DISTINCT event_type) / least(count(*), 24), 6) AS coverage FROM events GROUP BY user_id")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.source_coverage(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.round("coverage", 6).alias("coverage"))


@query(
    "vector_interpolated",
    """WITH p AS (SELECT vec_id, embedding AS e, len(embedding) AS n FROM embeddings), w AS (SELECT vec_id, list_transform(range(100), lambda i: e[CAST(floor(i * (n - 1) / 99.0) AS INT) + 1]::DOUBLE * (1 - (i * (n - 1) / 99.0 - floor(i * (n - 1) / 99.0)))
  + e[least(CAST(floor(i * (n - 1) / 99.0) AS INT) + 1, n - 1) + 1]::DOUBLE * (i * (n - 1) / 99.0 - floor(i * (n - 1) / 99.0))) AS x FROM p)
SELECT vec_id, i, round(x[i] / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS value FROM w, (SELECT unnest([1, 2, 37, 64, 99, 100]) AS i)""",
)
def vector_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the vectors stretched to a hundred numbers and scaled to length one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", resample(F.col("embedding"), 100).alias("x"))
    return rows.select("vec_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 37, 64, 99, 100)])).alias("i"), "x").select("vec_id", "i", F.round(F.element_at("x", F.col("i")), 6).alias("value"))


@query(
    "merged_labels",
    """WITH e AS (SELECT label, 'v' || vec_id AS name, CASE WHEN vec_id % 3 = 0 THEN ['even ' || vec_id % 2, 'third'] ELSE ['even ' || vec_id % 2] END AS obs, CASE WHEN vec_id % 4 = 0 THEN 'rare' ELSE 'usual' END AS t, embedding[1]::DOUBLE AS x FROM embeddings)
SELECT label, arg_max(name, (len(obs), name)) AS name, count(DISTINCT name) AS aliases, (SELECT count(DISTINCT o) FROM (SELECT unnest(obs) AS o, label AS l FROM e) WHERE l = label) AS notes,
  CASE WHEN count(*) FILTER (WHERE t = 'usual') >= count(*) FILTER (WHERE t = 'rare') + (count(*) FILTER (WHERE t = 'usual') = count(*) FILTER (WHERE t = 'rare'))::INT THEN 'usual' ELSE 'rare' END AS entity_type, round(avg(x), 6) AS first FROM e GROUP BY label""",
)
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as one entity: the richest name, all aliases and notes, the usual type, the mean vector."""
    key = F.col("vec_id")
    even = F.concat(F.lit("even "), (key % 2).cast("string"))
    rows = table(spark, sf_dir, "embeddings").select(
        "label", _text("v", "$vec_id").alias("name"), F.when(key % 3 == 0, F.array(even, F.lit("third"))).otherwise(F.array(even)).alias("observations"),
        F.when(key % 4 == 0, "rare").otherwise("usual").alias("entity_type"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
    )
    made = search.merge_entities(rows, "label", arrays=False)
    return made.select("label", "name", "aliases", F.col("observations").alias("notes"), "entity_type", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query(
    "store_health",
    """SELECT (SELECT count(*) FROM documents) AS n_texts, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS texts_alone,
  (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS vectors_alone""",
)
def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two stores that share keys, and what either has alone."""
    texts = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("a"))
    vectors = table(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("k")).agg(F.count("*").alias("b"))
    both = texts.join(vectors, "k", "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return both.agg(
        total("a").alias("n_texts"), total("b").alias("n_vectors"), total(F.when(F.col("b") == 0, F.col("a"))).alias("texts_alone"), total(F.when(F.col("a") == 0, F.col("b"))).alias("vectors_alone"),
    )


@query("plan_level_subtasks", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber = 1")
def plan_level_subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as subtasks whose parent is the line before; those without one belong to the plan itself."""
    parent = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1)
    return table(spark, sf_dir, "lineitem").withColumn("parent", parent).where(F.col("parent").isNull()).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "latest_event_of_entity",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity, max(event_id) AS event_id FROM events GROUP BY 1",
)
def latest_event_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event whose payload names an entity by any of three keys."""
    name = F.get(F.array(F.lit("nodeId"), F.lit("relationId"), F.lit("id")), (F.col("event_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "events").withColumn("payload", F.concat(F.lit('{"'), name, F.lit('": '), F.get_json_object("props", "$.k"), F.lit("}")))
    entity = values.any_key(F.col("payload"), "nodeId", "relationId", "id").cast("bigint")
    return rows.where(entity.isNotNull()).groupBy(entity.alias("entity")).agg(F.max("event_id").alias("event_id"))


@query(
    "chunks_by_model",
    """WITH q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q, vec_id, 0.5 * sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - v[i]::DOUBLE) * (embedding[i]::DOUBLE - v[i]::DOUBLE)))) AS x FROM embeddings, q WHERE vec_id <> q),
h AS (SELECT q, vec_id AS id, 1 - x AS s, vec_id // 3 AS par FROM d WHERE x < 1 QUALIFY row_number() OVER (PARTITION BY q, vec_id % 2 ORDER BY x, vec_id) <= 8),
u AS (SELECT q, id, s, 0 AS parent FROM h UNION ALL SELECT DISTINCT q, par, 0.9, 1 FROM h WHERE par IN (SELECT vec_id FROM embeddings)),
p AS (SELECT q, id, arg_max(s, parent) AS s FROM u GROUP BY q, id)
SELECT q AS query_id, id, round(s, 5) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 10""",
)
def chunks_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks for every hundredth vector over a list for each of two models, with parents."""
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 0.5))  # nearer than 1
    wanted = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    lists = {}
    for model in (0, 1):
        own = rows.where(F.col("vec_id") % 2 == model).select("vec_id", "embedding")
        near = retrieval.nearest_rows(wanted, own, 8)
        lists[f"m{model}"] = near.select("query_id", F.col("vec_id").alias("id"), "similarity", F.expr("vec_id div 3").alias("parent_id"))
    chunks_ = rows.select(F.col("vec_id").alias("id"), F.lit(0.0).alias("similarity"), F.expr("vec_id div 3").alias("parent_id"))
    return retrieval.retrieve_chunks(lists, chunks_, 10, "query_id").select("query_id", "id", F.round("similarity", 5).alias("similarity"))


@query(
    "stream_out_of_order",
    """WITH s AS (SELECT event_id, event_type, epoch_us(ts) - (event_id % 7) * 3600000000 AS t FROM events)
SELECT event_id, previous - t AS behind_us FROM (SELECT event_id, t, lag(t) OVER (PARTITION BY event_type ORDER BY event_id) AS previous FROM s) WHERE t < previous""",
)
def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose clocks are up to six hours slow: those behind the one before them in their type's log."""
    events = event_stream.read_slices(spark, event_stream.sliced(table(spark, sf_dir, "events"), "event_id"))
    slow = events.withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("event_id") % 7) * 3_600_000_000))
    return event_stream.run_late(slow, "slow", "event_type")


@query(
    "path_ranking",
    """WITH s AS (SELECT page_id, lower(regexp_extract(url, '[^/]*$')) AS n, lower(url) AS u FROM pages)
SELECT page_id, CAST(CASE WHEN regexp_replace(n, '\\.[^.]*$', '') IN ('page', '82') THEN 200 ELSE 0 END + CASE WHEN contains(n, 'page') THEN 50 WHEN contains(u, 'page') THEN 25 ELSE 0 END
  + CASE WHEN contains(n, '82') THEN 50 WHEN contains(u, '82') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(n, '\\.(ts|js|py|java|go|rs)$') THEN 5 ELSE 0 END AS INT) AS score FROM s""",
)
def path_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each path answers two terms."""
    return table(spark, sf_dir, "pages").select("page_id", retrieval.path_score(F.col("url"), ["page", "82"]).alias("score"))


@query(
    "batched_dedup",
    """WITH r AS (SELECT event_id AS pos, event_id // 100 AS b, user_id AS path, event_type AS entity, event_id % 3 AS c, value AS score FROM events),
u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY b, path, entity, c ORDER BY score DESC, pos) = 1)
SELECT path, entity, pos FROM u QUALIFY row_number() OVER (PARTITION BY path, entity ORDER BY b, pos) = 1""",
)
def batched_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as contexts in batches of a hundred places: one a path and entity in the end."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("path"), F.col("event_type").alias("entity"), (F.col("event_id") % 3).cast("string").alias("content"), F.col("value").alias("score")
    )
    return retrieval.dedup_contexts_in_batches(rows, 100).select("path", "entity", "pos")


@query(
    "creation_events",
    f"""{G} SELECT 'NODE_CREATED' AS event_type, to_json({{'nodeId': id, 'name': name, 'entityType': entity_type}})::VARCHAR AS payload FROM nodes
UNION ALL SELECT 'RELATION_CREATED', to_json({{'fromNodeId': src, 'toNodeId': dst, 'relationType': kind}})::VARCHAR FROM edges""",
)
def creation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log gets for all nodes and relations of the graph."""
    return graph.creation_events(graph_nodes(spark, sf_dir), "node").unionByName(graph.creation_events(graph_edges(spark, sf_dir), "relation"))


@query(
    "table_columns",
    """SELECT p_partkey, 't' || p_partkey AS "table", pos, "column", type FROM part, (VALUES (0, 'id', 'INT'), (1, 'price', 'DECIMAL(10, 2)'), (2, 'name', 'VARCHAR(20)'), (4, 'plain', '')) v(pos, "column", type)
UNION ALL SELECT p_partkey, 'x.u' || p_partkey, 0, 'a', 'TEXT' FROM part""",
)
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of two tables that each part's script makes."""
    script = _text(
        "-- tables\nCREATE TABLE IF NOT EXISTS t", "$p_partkey", " (id INT PRIMARY KEY, `price` DECIMAL(10, 2) NOT NULL,\n  name VARCHAR(20), FOREIGN KEY (id) REFERENCES u(id, b), plain);\ncreate table x.u", "$p_partkey", " (a TEXT);\nSELECT 1",
    )
    return parsers.sql_columns(dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", script.alias("script")), "p_partkey", "script")


@query(
    "review_patches",
    """SELECT o_orderkey, 0 AS pos, 'src/o' || o_orderkey || '.ts' AS path, '--- a/src/o' || o_orderkey || '.ts' || chr(10) || '+x' AS diff FROM orders UNION ALL SELECT o_orderkey, 1, 'file-1', '+' || o_custkey FROM orders""",
)
def review_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches in reviews of orders: one with a file, one without."""
    text = _text("Do this\n```diff\n--- a/src/o", "$o_orderkey", ".ts\n+x\n```\nand\n```diff\n+", "$o_custkey", "\n```\n```js\nno\n```")
    return review.review_patches(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query(
    "marked_findings",
    """SELECT o_orderkey, 0 AS pos, 'high' AS severity, 'security' AS category, 'Order ' || o_orderkey AS title FROM orders UNION ALL SELECT o_orderkey, 1, 'medium', 'performance', 'slow' FROM orders
UNION ALL SELECT o_orderkey, 2, 'low', 'correctness', 'note ' || o_custkey FROM orders""",
)
def marked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a review marks with colours."""
    text = _text("# Review\n\U0001f534 \U0001f510 Order ", "$o_orderkey", "\n#### \U0001f7e1 \u26a1 slow \n\U0001f535 note ", "$o_custkey", "\nend")
    return review.marked_findings(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query(
    "technical_terms",
    """SELECT p_partkey, array_to_string(list_distinct_in_order, '|') AS terms FROM (SELECT p_partkey, ['Why', 'OrderBook' || p_partkey, 'Loader', 'readAll', p_name, 'one two'] AS list_distinct_in_order FROM part)""",
)
def technical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pascal-case, camel-case and quoted terms of prompts about parts."""
    prompt = F.concat(F.lit("Why does OrderBook"), F.col("p_partkey").cast("string"), F.lit(" use Loader and readAll for "), F.lit('"'), "p_name", F.lit('"'), F.lit(" and `one two` or Loader"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(strings.technical_terms(prompt), "|").alias("terms"))


@query(
    "entity_chunk_scores",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id, 'head' AS name, 1 AS start, 0.8 AS importance, array_to_string(l[1:3], chr(10)) AS t FROM l
UNION ALL SELECT doc_id, 'rest', 4, 0.4, array_to_string(l[4:len(l)], chr(10)) FROM l)
SELECT doc_id, name, start, importance::DOUBLE AS importance, sha256(t) AS hash FROM c WHERE length(t) >= 100""",
)
def entity_chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of a text as an exported, public, async class and the others as a function, with their importance."""
    entity = lambda name, kind, a, b, own: F.struct(
        F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(a).alias("start"), (F.lit(b) if isinstance(b, int) else b).alias("end"), *[F.lit(own).alias(c) for c in ("exported", "public", "is_async")], F.lit(False).alias("documented")
    )
    files = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(entity("head", "class", 1, 3, True), entity("rest", "function", 4, F.size(F.split("text", "\n")), False)).alias("entities"))
    return chunks.scored_entity_chunks(files, "text", "entities").select("doc_id", "name", "start", "importance", "hash")


@query(
    "script_declarations",
    """SELECT p_partkey, kind, name, holder, start_line, end_line FROM part, (VALUES ('import', './base', NULL, 1, 1), ('class', 'Part' , NULL, 2, 9), ('method', 'constructor', 'Part', 3, 5), ('method', 'load', 'Part', 6, 8), ('function', 'pick', NULL, 10, 12),
  ('function', 'one', NULL, 13, 13), ('variable', 'size', NULL, 14, 14), ('interface', 'Shape', NULL, 15, 17), ('type_alias', 'Id', NULL, 18, 18)) v(kind, name, holder, start_line, end_line)
UNION ALL SELECT p_partkey, 'enum', 'E' || p_partkey, NULL, 19, 19 FROM part""",
)
def script_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of a script for each part, with holders and lines."""
    head = (
        "import { a } from './base';\nexport class Part extends Base {\n  constructor(x) {\n    if (x) { y(); }\n  }\n  async load(id: number): Promise<void> {\n    for (;;) {}\n  }\n}\n"
        "export function pick(a) {\n  return a;\n}\nconst one = (a) => a;\nlet size = "
    )
    script = _text(head, "$p_size", ";\nexport interface Shape {\n  id: number;\n}\ntype Id = string | number;\nenum E", "$p_partkey", " { A, B }")
    return parsers.script_declarations(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", script.alias("script")), "p_partkey", "script")


@query(
    "document_scripts",
    """WITH d AS (SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS INT) AS n FROM documents)
SELECT doc_id, 'variable' AS kind, 'text' AS name, NULL AS holder, 1 AS start_line, 1 AS end_line, '' AS parameters, '' AS calls FROM d
UNION ALL SELECT doc_id, 'function', 'f' || doc_id, NULL, n + 3, 2 * n + 5, 'a:,b:string', 'call,new Note' FROM d
UNION ALL SELECT doc_id, 'class', 'D' || doc_id, NULL, 2 * n + 6, 2 * n + 6, '', '' FROM d
UNION ALL SELECT doc_id, 'method', 'm', 'D' || doc_id, 2 * n + 6, 2 * n + 6, 'x:number', 'this.go' FROM d
UNION ALL SELECT doc_id, 'function', 'default', NULL, 2 * n + 6, 2 * n + 6, '', '' FROM d""",
)
def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of scripts that hold every document as a text, within a comment and within a template."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    swap = lambda c, *pairs: c if not pairs else swap(F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:])
    quoted = F.expr("substr(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    script = F.concat(
        F.lit("const text = "), quoted, F.lit(";\n/*"), swap(F.col("text"), ("*/", "* /")), F.lit("*/\nexport function f"), F.col("doc_id").cast("string"), F.lit("(a, b: string): void {\n  call(`"),
        swap(F.col("text"), ("\\", "\\\\"), ("`", "\\`"), ("${", "\\${")), F.lit("`, new Note(/[{`]/g));\n}\nclass D"), F.col("doc_id").cast("string"), F.lit(" { m(x: number) { return this.go('{', x); } } export default function() {}"),
    )
    found = parsers.lexed_declarations(docs.select("doc_id", script.alias("script")), "doc_id", "script")
    return found.select(
        "doc_id", "kind", "name", "holder", "start_line", "end_line", F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",").alias("parameters"), F.array_join("calls", ",").alias("calls")
    )


@query(
    "document_statements",
    """WITH d AS (SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS INT) AS n FROM documents)
SELECT doc_id, 0 AS pos, 'create_table' AS kind, 'notes' || doc_id AS name, n + 2 AS line, 'id,body' AS columns, '' AS tables, 'id>u.k' AS refs FROM d
UNION ALL SELECT doc_id, 1, 'insert', 'notes' || doc_id, n + 2, 'id,body', '', '' FROM d
UNION ALL SELECT doc_id, 2, 'update', 'notes', 2 * n + 3, 'body,id', 'q', '' FROM d
UNION ALL SELECT doc_id, 3, 'create_view', 'v', 3 * n + 3, '', 'a,b,c', '' FROM d""",
)
def document_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL statements of scripts that hold every document within a comment and as texts."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    text, own = F.replace("text", F.lit("'"), F.lit("''")), F.col("doc_id").cast("string")
    script = F.concat(
        F.lit("/*"), F.replace("text", F.lit("*/"), F.lit("* /")), F.lit("*/\nCREATE TABLE notes"), own, F.lit(" (id INT, body TEXT NOT NULL, FOREIGN KEY (id) REFERENCES u(k)); INSERT INTO notes"), own,
        F.lit(" (id, body) VALUES (1, '"), text, F.lit("');\nUPDATE notes SET body = '"), text, F.lit("', id = (SELECT max(id) FROM q) WHERE id = 1; CREATE VIEW v AS SELECT * FROM a, b JOIN c ON a.x = b.x -- end; "),
    )
    found = parsers.sql_statements(docs.select("doc_id", script.alias("script")), "doc_id", "script")
    refs = F.transform("refs", lambda r: F.concat(r["column"], F.lit(">"), r["table"], F.lit("."), r["target"]))
    return found.select("doc_id", "pos", "kind", "name", "line", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("columns"), F.array_join("tables", ",").alias("tables"), F.array_join(refs, ",").alias("refs"))


@query(
    "php_declarations",
    r"""SELECT p_partkey, kind, name, holder, start_line, end_line FROM part, (VALUES ('namespace', 'App\Parts', NULL, 2, 2), ('import', 'Lib\Base', NULL, 3, 3), ('class', 'Part', NULL, 4, 10), ('method', 'run', 'Part', 5, 9)) v(kind, name, holder, start_line, end_line)
UNION ALL SELECT p_partkey, 'function', 'f' || p_partkey, NULL, 11, 11 FROM part""".replace("\\\\", "\\"),
)
def php_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a PHP file."""
    script = _text("<?php\nnamespace App\\Parts;\nuse Lib\\Base;\nfinal class Part extends Base {\n  public static function run($a) {\n    if ($a) {\n      return 1;\n    }\n  }\n}\nfunction f", "$p_partkey", "() { return 2; }")
    return parsers.script_declarations(dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", script.alias("script")), "p_partkey", "script", "php")

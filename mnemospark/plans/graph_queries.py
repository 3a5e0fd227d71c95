"""Queries over the derived property graph: language, traversal, search, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.strings import mermaid_label, similarity
from mnemospark.operators import graph, search
from mnemospark.plans import dsl
from mnemospark.plans.registry import query
from mnemospark.session import materialize, wide_shuffles
from mnemospark.sources.tables import GRAPH_SQL, graph_edges, graph_nodes

G = f"WITH {GRAPH_SQL}"
R = f"WITH RECURSIVE {GRAPH_SQL}"


def _stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived edges as a table: a walk reads them once a hop."""
    return materialize(graph_edges(spark, sf_dir), "edges")


def _ask(name: str, text: str, where: str) -> None:
    """Register a filter query of the graph's language."""

    @query(name, f"{G} SELECT id, name FROM nodes WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dsl.execute(text, graph_nodes(spark, sf_dir)).select("id", "name")


_ask("simple_search_nodes", "machinery", "lower(name) LIKE '%machinery%' OR lower(entity_type) LIKE '%machinery%' OR len(list_filter(obs, lambda o: lower(o) LIKE '%machinery%')) > 0")
_ask("dsl_and", "entitytype:customer obs:BUILDING name:1", "entity_type LIKE '%customer%' AND lower(name) LIKE '%1%' AND len(list_filter(obs, lambda o: lower(o) LIKE '%building%')) > 0")
_ask("dsl_or", "entitytype:supplier name:ASIA operator:OR", "entity_type LIKE '%supplier%' OR lower(name) LIKE '%asia%'")
_ask("dsl_not", "entitytype:part operator:NOT", "NOT (entity_type LIKE '%part%')")
_ask("dsl_file_condition", "file:AUTO", "entity_type = 'file' OR len(list_filter(obs, lambda o: contains(o, 'AUTO'))) > 0")
_ask("dsl_keyed_observation", 'defined_in_file_path:x operator:OR entitytype:region id:"n:3"', "id = 'n:3' OR entity_type LIKE '%region%'")


@query("dsl_limit", f"{G} SELECT id, name FROM nodes WHERE entity_type LIKE '%nation%' ORDER BY id LIMIT 7")
def dsl_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.execute("entitytype:nation limit:7", graph_nodes(spark, sf_dir)).select("id", "name")


@query(
    "ranked_search",
    f"""{G} SELECT id, CAST(10 * (lower(name) LIKE '%hot gear%')::INT + 20 * (lower(name) = 'hot gear')::INT + 5 * (entity_type LIKE '%hot gear%')::INT
  + 2 * len(list_filter(obs, lambda o: lower(o) LIKE '%hot gear%')) AS DOUBLE) AS score FROM nodes ORDER BY score DESC, id LIMIT 50""",
)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.execute("rank:hot gear:relevance", graph_nodes(spark, sf_dir)).select("id", "score")


@query("structured_filter", f"{G} SELECT id, name FROM nodes WHERE name IN ('ASIA', 'NATION_3', 'NATION_7', 'small ring') AND entity_type IN ('nation', 'region')")
def structured_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.structured(graph_nodes(spark, sf_dir), ["ASIA", "NATION_3", "NATION_7", "small ring"], ["nation", "region"]).select("id", "name")


@query("open_nodes", f"{G} SELECT id, name, entity_type, len(obs) AS n_obs FROM nodes WHERE name IN ('EUROPE', 'Supplier#000000007')")
def open_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_nodes(spark, sf_dir).where(F.col("name").isin("EUROPE", "Supplier#000000007"))
    return rows.select("id", "name", "entity_type", F.size(F.coalesce("observations", F.array().cast("array<string>"))).cast("bigint").alias("n_obs"))


@query("type_index", f"{G} SELECT entity_type, count(*) AS n, min(id) AS first_id, max(name) AS last_name FROM nodes GROUP BY entity_type")
def type_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_nodes(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("name").alias("last_name"))


@query("name_index", f"{G} SELECT name, max(id) AS id FROM nodes GROUP BY name")
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_nodes(spark, sf_dir).groupBy("name").agg(F.max("id").alias("id"))


@query("graph_counts", f"{G} SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY kind")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("relations_named", f"{G} SELECT a.name AS src_name, b.name AS dst_name, kind, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL")
def relations_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = graph.named(graph_edges(spark, sf_dir), graph_nodes(spark, sf_dir))
    return made.groupBy("src_name", "dst_name", "kind").agg(F.count("*").alias("n"))


BFS = R + """, walk AS (SELECT id, 0 AS depth FROM nodes WHERE name = 'EUROPE' UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = id WHERE depth < {d})
"""


@query("bfs_out_depth2", BFS.format(d=2) + "SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY id")
def bfs_out_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = dsl.parse("traverse:EUROPE:outgoing:2")
    return dsl.execute(ask, graph_nodes(spark, sf_dir), _stored_edges(spark, sf_dir)).select("id", "depth")


@query("bfs_out_depth3", BFS.format(d=3) + "SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY id")
def bfs_out_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.execute("traverse:EUROPE:outgoing:3", graph_nodes(spark, sf_dir), _stored_edges(spark, sf_dir)).select("id", "depth")


@query(
    "bfs_incoming_typed",
    R + """, walk AS (SELECT id, 0 AS depth FROM nodes WHERE id = 'p:1' UNION SELECT src, depth + 1 FROM walk JOIN edges ON dst = id WHERE depth < 3 AND kind = 'supplies')
SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY id""",
)
def bfs_incoming_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = graph_nodes(spark, sf_dir).where("id = 'p:1'")
    return graph.bfs(_stored_edges(spark, sf_dir), start, 3, "incoming", ["supplies"])


@query("traverse_relations", BFS.format(d=1) + "SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM walk)")
def traverse_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood_edges(graph_nodes(spark, sf_dir), _stored_edges(spark, sf_dir), "EUROPE", 2).select("src", "dst", "kind")


@query("inbound_sources", f"{G} SELECT id, name FROM nodes WHERE id IN (SELECT src FROM edges JOIN nodes t ON t.id = dst WHERE kind = 'supplies' AND list_contains(t.obs, 'size: 7'))")
def inbound_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir)
    targets = nodes.where(F.array_contains("observations", "size: 7"))
    return graph.inbound_sources(nodes, graph_edges(spark, sf_dir), targets, "supplies").select("id", "name")


def _subgraph(name: str, word: str, both: bool) -> None:
    @query(name, f"{G}, s AS (SELECT id FROM nodes WHERE entity_type = 'supplier' OR name LIKE '%bolt%') SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM s) {word} dst IN (SELECT id FROM s)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = graph_nodes(spark, sf_dir).where((F.col("entity_type") == "supplier") | F.col("name").like("%bolt%"))
        return graph.subgraph(graph_edges(spark, sf_dir), ids, both).select("src", "dst", "kind")


_subgraph("subgraph_both_ends", "AND", True)
_subgraph("subgraph_either_end", "OR", False)


@query(
    "mermaid_lines",
    f"""{G} SELECT regexp_replace(src, '\\W', '_', 'g') || '["' || a.name || '"] -->|' || kind || '| ' || regexp_replace(dst, '\\W', '_', 'g') || '["' || b.name || '"]' AS line
FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE kind = 'contains_item'""",
)
def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mermaid(graph_edges(spark, sf_dir).where("kind = 'contains_item'"), graph_nodes(spark, sf_dir))


@query(
    "endpoint_resolution",
    f"""{G}, w AS (SELECT DISTINCT 'file.ts::' || name AS wanted, name FROM nodes UNION SELECT name, name FROM nodes),
u AS (SELECT name, min(id) AS id FROM nodes GROUP BY name HAVING count(*) = 1)
SELECT wanted, id, CASE WHEN wanted = name THEN 'exact' ELSE 'file_prefix' END AS strategy FROM w JOIN u USING (name)""",
)
def endpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir)
    wanted = nodes.select(F.concat(F.lit("file.ts::"), "name").alias("wanted")).union(nodes.select("name")).distinct()
    return graph.resolve_names(wanted, nodes)


@query(
    "new_relations",
    f"""{G} SELECT DISTINCT 's:' || l_suppkey AS src, 'c:' || o_custkey AS dst, 'serves' AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_returnflag = 'R' AND o_orderstatus <> 'P' EXCEPT SELECT src, dst, kind FROM edges""",
)
def new_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.sources.tables import table

    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    proposed = lines.select(name("s:", "l_suppkey").alias("src"), name("c:", "o_custkey").alias("dst"), F.lit("serves").alias("kind"))
    with wide_shuffles(spark, table(spark, sf_dir, "lineitem").count()):
        return materialize(graph.new_relations(proposed, graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir)).select("src", "dst", "kind"), "new-relations")


FUZZY = """, t AS (SELECT id, regexp_replace(lower(name), '[^a-z0-9\\s_\\-.]', ' ', 'g') AS nm, lower(concat_ws(' ', name, entity_type, array_to_string(obs, ' '))) AS raw FROM nodes),
x AS (SELECT id, trim(regexp_replace(nm, '\\s+', ' ', 'g')) AS nm, trim(regexp_replace(regexp_replace(raw, '[^a-z0-9\\s_\\-.]', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM t),
y AS (SELECT id, nm, list_distinct(list_filter(regexp_split_to_array(s, '[\\s_\\-.]+'), lambda z: z <> '')) AS toks, regexp_replace(s, '\\s+', '', 'g') AS flat FROM x),
q AS (SELECT unnest(['red', 'widget']) AS qt),
k AS (SELECT id, sum(CASE WHEN list_contains(toks, qt) THEN 1.0 ELSE 0.0 END + coalesce(list_sum(list_transform(list_filter(toks,
  lambda o: (contains(o, qt) OR contains(qt, o)) AND 1 - levenshtein(o, qt) / greatest(length(o), length(qt))::DOUBLE > 0.5),
  lambda o: 0.8 * (1 - levenshtein(o, qt) / greatest(length(o), length(qt))::DOUBLE))), 0.0)) AS tok FROM y, q GROUP BY id),
gr AS (SELECT 'redwidget' AS f),
two AS (SELECT list_transform(range(1, 9), lambda i: substr(f, i, 2)) AS g2, list_transform(range(1, 8), lambda i: substr(f, i, 3)) AS g3 FROM gr),
sc AS (SELECT y.id, 0.7 * (tok + 0.3 * len(list_filter(g2, lambda g: contains(flat, g))) + 0.4 * len(list_filter(g3, lambda g: contains(flat, g)))) / (2 + 0.3 * 8 + 0.4 * 7)
  + 0.3 * CASE WHEN length(nm) = 0 THEN 0 ELSE 1 - levenshtein('red widget', nm) / greatest(10, length(nm))::DOUBLE END AS score FROM y JOIN k USING (id), two)
SELECT id, round(score, 6) AS score FROM sc WHERE score >= 0.3"""


@query("fuzzy_search", G + FUZZY)
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_search(graph_nodes(spark, sf_dir), "red widget").select("id", F.round("score", 6).alias("score"))


MANY = r""", t AS (SELECT id, name, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s_\-.]', ' ', 'g'), '\s+', ' ', 'g')) AS nm,
  trim(regexp_replace(regexp_replace(lower(concat_ws(' ', name, entity_type, array_to_string(obs, ' '))), '[^a-z0-9\s_\-.]', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM nodes),
y AS (SELECT id, nm, list_distinct(list_filter(regexp_split_to_array(s, '[\s_\-.]+'), lambda z: z <> '')) AS toks, regexp_replace(s, '\s+', '', 'g') AS flat FROM t),
q AS (SELECT id AS query_id, nm AS q, list_filter(regexp_split_to_array(nm, '[\s_\-.]+'), lambda z: z <> '') AS qt, regexp_replace(nm, '\s+', '', 'g') AS f FROM t WHERE id[1] IN ('c', 'p') AND CAST(id[3:] AS INT) % 100 = 0),
w AS (SELECT *, CASE WHEN length(f) < 2 THEN [f] ELSE list_transform(range(1, length(f)), lambda i: substr(f, i, 2)) END AS g2, CASE WHEN length(f) < 3 THEN [f] ELSE list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3)) END AS g3 FROM q),
sc AS (SELECT query_id, id, 0.7 * (list_sum(list_transform(qt, lambda a: CASE WHEN list_contains(toks, a) THEN 1.0 ELSE 0.0 END + coalesce(list_sum(list_transform(list_filter(toks,
  lambda o: (contains(o, a) OR contains(a, o)) AND 1 - levenshtein(o, a) / greatest(length(o), length(a))::DOUBLE > 0.5), lambda o: 0.8 * (1 - levenshtein(o, a) / greatest(length(o), length(a))::DOUBLE))), 0.0)))
  + 0.3 * len(list_filter(g2, lambda g: contains(flat, g))) + 0.4 * len(list_filter(g3, lambda g: contains(flat, g)))) / (len(qt) + 0.3 * len(g2) + 0.4 * len(g3))
  + 0.3 * CASE WHEN length(nm) = 0 THEN 0 ELSE 1 - levenshtein(q, nm) / greatest(length(q), length(nm))::DOUBLE END AS score FROM w CROSS JOIN y)
SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT) AS rank FROM sc WHERE score >= 0.3
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 5"""


@query("fuzzy_search_many", G + MANY)
def fuzzy_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best nodes for the name of every hundredth customer and part, from posting lists."""
    nodes = graph_nodes(spark, sf_dir)
    queries = nodes.where(F.col("id").rlike("^[cp]:") & (F.expr("CAST(substr(id, 3) AS INT)") % 100 == 0)).select(F.col("id").alias("query_id"), F.col("name").alias("text"))
    return search.fuzzy_search_many(nodes, queries, 5).withColumn("score", F.round("score", 6))


@query(
    "suggest_corrections",
    f"""{G}, v AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(concat_ws(' ', name, entity_type, array_to_string(obs, ' '))),
  '[^a-z0-9\\s_\\-.]', ' ', 'g'), '\\s+', ' ', 'g')), '[\\s_\\-.]+'), lambda z: z <> '')) AS token FROM nodes),
s AS (SELECT token, 1 - levenshtein(token, 'bulding') / greatest(length(token), 7)::DOUBLE AS score FROM v)
SELECT token, round(score, 6) AS score FROM s WHERE score > 0.4 AND score < 1 ORDER BY score DESC, token LIMIT 3""",
)
def suggest_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.corrections(graph_nodes(spark, sf_dir), "bulding", 0.4).select("token", F.round("score", 6).alias("score"))


@query(
    "search_union",
    f"""{G} SELECT id FROM nodes WHERE lower(name) LIKE '%gear%' OR len(list_filter(obs, lambda o: lower(o) LIKE '%gear%')) > 0
UNION SELECT id FROM nodes WHERE lower(name) LIKE '%bolt%'""",
)
def search_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir)
    return nodes.where(dsl.simple("gear")).select("id").union(nodes.where(dsl.condition("name", "bolt")).select("id")).distinct()


@query(
    "levenshtein_pairs",
    """SELECT q.p_partkey AS query_id, r.p_partkey AS row_id, round(1 - levenshtein(q.p_name, r.p_name) / greatest(length(q.p_name), length(r.p_name))::DOUBLE, 6) AS score
FROM part q JOIN part r ON q.p_partkey <> r.p_partkey AND 1 - levenshtein(q.p_name, r.p_name) / greatest(length(q.p_name), length(r.p_name))::DOUBLE >= 0.7 WHERE q.p_partkey % 100 = 0""",
)
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every hundredth part against all, each pair of distinct names once."""
    from mnemospark.sources.tables import table

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), "p_name")
    queries = part.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("p_name").alias("q_name"))
    pairs = search.name_links(queries, part, "q_name", "p_name", 0.7).where("query_id <> row_id")
    return pairs.select("query_id", "row_id", F.round("score", 6).alias("score"))


ENTITIES = """e AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind,
    CASE WHEN p_partkey % 10 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_sort(['brand: ' || lower(p_brand), 'size: ' || p_size % 10, 'price: ' || CAST(floor(p_retailprice / 400) AS BIGINT)]) END AS obs,
    embedding::DOUBLE[] AS v FROM part LEFT JOIN embeddings ON vec_id = p_partkey)"""


@query(
    "entity_links",
    f"""WITH {ENTITIES},
c AS (SELECT *, min(id) OVER (PARTITION BY name, kind, obs, v) AS first FROM e),
s AS (SELECT x.id AS a, y.id AS b, x.v IS NOT NULL AND y.v IS NOT NULL AS both_v, x.kind = y.kind AS same, len(x.obs) + len(y.obs) > 0 AS noted,
  CASE WHEN x.v IS NOT NULL AND y.v IS NOT NULL THEN list_cosine_similarity(x.v, y.v) ELSE 0 END AS cosine,
  1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name))::DOUBLE AS called,
  len(list_intersect(x.obs, y.obs)) / greatest(1, len(list_distinct(x.obs || y.obs)))::DOUBLE AS jaccard, x.first = y.first AS one
  FROM c x JOIN c y ON x.first = x.id AND (y.first = y.id AND x.id < y.id OR y.first = x.id AND x.id <> y.id)),
t AS (SELECT a, b, one, (0.4 * cosine + 0.25 * called + 0.15 * same::INT + 0.2 * jaccard) / (0.4 * both_v::INT + 0.25 + 0.15 * same::INT + 0.2 * noted::INT) AS score FROM s)
SELECT CASE WHEN one THEN 'member' ELSE 'similar' END AS kind, a, b, round(score, 6) AS score FROM t WHERE score >= 0.7 - 1e-9""",
)
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts with all as entities, by names, types, notes and the vectors of those that have one."""
    from mnemospark.operators.entity_join import entity_links
    from mnemospark.sources.tables import table

    text = lambda label, value: F.concat(F.lit(label), value.cast("string"))
    notes = F.array(text("brand: ", F.col("p_brand")), text("size: ", F.col("p_size") % 10), text("price: ", F.floor(F.col("p_retailprice") / 400)))
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"), F.when(F.col("p_partkey") % 10 != 0, notes).alias("observations")
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return entity_links(part.join(vectors, "id", "left")).withColumn("score", F.round("score", 6))


@query(
    "similar_names",
    """WITH c AS (SELECT p_name, min(p_partkey) AS id FROM part WHERE length(p_name) > 0 GROUP BY p_name)
SELECT 'member' AS kind, id AS a, p_partkey AS b, 1.0::DOUBLE AS score FROM part JOIN c USING (p_name) WHERE p_partkey <> id
UNION ALL SELECT 'similar', x.id, y.id, round(1 - levenshtein(x.p_name, y.p_name) / greatest(length(x.p_name), length(y.p_name))::DOUBLE, 6) FROM c x JOIN c y
ON x.id < y.id AND 1 - levenshtein(x.p_name, y.p_name) / greatest(length(x.p_name), length(y.p_name))::DOUBLE >= 0.7""",
)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts with all: members of equal names, and similar pairs between those classes."""
    from mnemospark.sources.tables import table

    return search.similar_names(table(spark, sf_dir, "part"), "p_partkey", "p_name").withColumn("score", F.round("score", 6))


@query(
    "entity_resolution",
    """WITH q AS (SELECT p_partkey AS query_id, lower(p_name) AS w, lower(p_type) AS wt FROM part WHERE p_partkey % 100 = 0), d AS (SELECT p_partkey AS id, lower(p_name) AS n, lower(p_type) AS t, p_size, p_retailprice FROM part),
s AS (SELECT query_id, id, n, w, CASE WHEN n = w THEN 100.0 ELSE 45 * least(1.0, (0.7 * (1 - levenshtein(n, w) / greatest(length(n), length(w))::DOUBLE)
    + 0.3 * len(list_intersect(list_distinct(string_split(n, '')), list_distinct(string_split(w, '')))) / len(list_distinct(string_split(n, '') || string_split(w, '')))::DOUBLE + CASE WHEN starts_with(n, w) THEN 0.2 ELSE 0.0 END)
    * CASE WHEN least(length(n), length(w)) < 3 THEN 0.4 WHEN least(length(n), length(w)) < 5 THEN 0.7 ELSE 1.0 END) END
  + 30 * (t = wt)::INT + 20 * (p_retailprice > 1500)::INT - 30 * (p_size < 5)::INT AS score FROM q, d WHERE query_id <> id),
x AS (SELECT query_id, id, round(score + CASE WHEN n <> w AND (contains(n, w) OR contains(w, n)) AND score < 40 THEN 10 ELSE 0 END, 6) AS score FROM s)
SELECT query_id, id, score FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""",
)
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hundredth part, the other part that answers its name best; ties go by id."""
    from mnemospark.sources.tables import table

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", (F.col("p_retailprice") > 1500).alias("dear"), (F.col("p_size") < 5).alias("small"))
    queries = part.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("p_name").alias("q_name"), F.col("p_type").alias("q_type"))
    score = search.resolution_score(F.col("p_name"), F.col("q_name"), F.col("p_type"), F.col("q_type"), F.col("dear"), F.col("small"))
    scored = lambda wishes, classes: search.against_all(wishes, classes, F.lit(True)).withColumn("score", F.round(score, 6))
    return search.best_of_classes(queries, part, ["q_name", "q_type"], ["p_name", "p_type", "dear", "small"], scored)


@query(
    "mermaid_labels",
    """SELECT p_partkey, regexp_replace(replace(p_name, '"', ''''), '[\\[\\]{}()<>|]', ' ', 'g') AS label FROM part""",
)
def mermaid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.sources.tables import table

    return table(spark, sf_dir, "part").select("p_partkey", mermaid_label("p_name").alias("label"))

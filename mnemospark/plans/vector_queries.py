"""Queries over embeddings and ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.vectors import resample
from mnemospark.operators import blocks, pivots, retrieval
from mnemospark.plans.registry import query
from mnemospark.sources.tables import table


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector as a query, and all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), rows


KNN = """p AS (SELECT q.vec_id AS query_id, r.vec_id, r.label, q.label AS q_label, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d,
  list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)"""


@query(
    "knn_l2",
    f"WITH {KNN} SELECT query_id, vec_id, round(d, 6) AS distance, round(greatest(0, 1 - d), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rn FROM p) WHERE rn <= 20",
)
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.nearest_rows(*_asked(spark, sf_dir), 20, drop_far=False)
    return best.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(
    "knn_pivots",
    f"WITH {KNN} SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rn FROM p) WHERE rn <= 20",
)
def knn_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``knn_l2`` from cells around pivots, passing over stretches that the triangle inequality rules out."""
    queries, rows = _asked(spark, sf_dir)
    found, _ = pivots.nearest(queries, rows, 20)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "cosine_topk",
    f"WITH {KNN} SELECT query_id, vec_id, round(c, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) <= 10",
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.best_rows(*_asked(spark, sf_dir), 10, distance=False).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(
    "knn_post_filter",
    f"WITH {KNN}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rn FROM p) SELECT query_id, vec_id FROM t WHERE rn <= 50 AND label < 5",
)
def knn_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label is looked at after the nearest rows are chosen, as a filter never passes a limit."""
    queries, rows = _asked(spark, sf_dir)
    rows = rows.withColumn("wanted_label", F.coalesce(F.col("label") < 5, F.lit(False)).cast("int"))
    return retrieval.nearest_rows(queries, rows, 50, drop_far=False, also=("wanted_label",)).where("wanted_label = 1").select("query_id", "vec_id")


LISTS = """lists AS (
  SELECT 'a' AS list, user_id AS k, event_id AS pos FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'b', user_id, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 'c', user_id, event_id FROM events WHERE event_type = 'purchase'),
f AS (SELECT list, k, min(pos) AS pos FROM lists GROUP BY list, k), r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY pos, k) AS rn FROM f)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in the order of their clicks, views and purchases."""
    name = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").when(F.col("event_type") == "purchase", "c")
    return table(spark, sf_dir, "events").select(name.alias("list"), F.col("user_id").alias("k"), F.col("event_id").alias("pos")).where(F.col("list").isNotNull())


@query("rrf_fusion", f"WITH {LISTS} SELECT k, round(sum(1.0 / (60 + rn)), 9) AS score FROM r GROUP BY k")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion(_lists(spark, sf_dir), "k").select("k", F.round("score", 9).alias("score"))


@query("weighted_rrf", f"WITH {LISTS} SELECT k, round(sum(CASE list WHEN 'a' THEN 1.0 WHEN 'b' THEN 0.8 ELSE 0.7 END / (60 + rn)), 9) AS score FROM r GROUP BY k")
def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("list") == "a", 1.0).when(F.col("list") == "b", 0.8).otherwise(0.7)
    return retrieval.reciprocal_rank_fusion(_lists(spark, sf_dir), "k", weight=weight).select("k", F.round("score", 9).alias("score"))


@query(
    "dedup_first_pos_last_value",
    "SELECT user_id, event_type, min(event_id) AS first_pos, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
)
def dedup_first_pos_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.first_place_last_value(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value")


@query(
    "context_dedup",
    """SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang, substr(md5(text), 1, 8) ORDER BY n_chars DESC, doc_id) = 1""",
)
def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("source").alias("path"), F.col("lang").alias("entity"), F.col("text").alias("content"), F.col("n_chars").alias("score"))
    return retrieval.dedup_contexts(rows, "score", "doc_id").select("doc_id", "source")


@query(
    "context_quality",
    """WITH s AS (SELECT source, least(1.0, 0.4 * (n_chars / 100000.0) + 0.3 * ((contains(lower(text), 'onor') OR contains(lower(source || '/' || lang), 'onor'))::INT
  + (contains(lower(text), 'fr') OR contains(lower(source || '/' || lang), 'fr'))::INT) / 2.0 + 0.2 * (0.3 * (length(text) > 200)::INT + 0.3 * (contains(text, 'function') OR contains(text, 'class'))::INT
  + 0.2 * (contains(text, 'export') OR contains(text, 'import'))::INT + 0.2) + 0.1) AS c FROM documents)
SELECT source, round(least(greatest(avg(c) + least(count(*) / 10.0, 0.2), 0.1), 1.0), 4) AS quality FROM s GROUP BY source""",
)
def context_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang")
    score = retrieval.context_score(F.col("text"), path, F.lit("file"), F.col("lang"), F.col("n_chars") / 100000.0, ["onor", "fr"])
    rows = table(spark, sf_dir, "documents").select("source", score.alias("score"))
    return retrieval.quality_score(rows, "source").select("source", F.round("quality", 4).alias("quality"))


@query(
    "context_verdict",
    """WITH s AS (SELECT user_id, avg(value / 100) FILTER (WHERE value / 100 >= 0.5) AS m, count(*) FILTER (WHERE value / 100 >= 0.5) / count(*) AS c FROM events GROUP BY user_id)
SELECT user_id, round(0.7 * coalesce(m, 0) + 0.3 * c, 4) AS score, 0.7 * coalesce(m, 0) + 0.3 * c >= 0.4 AND c > 0 AS relevant FROM s""",
)
def context_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = retrieval.verdict(table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("score")), "user_id")
    return made.select("user_id", F.round("score", 4).alias("score"), "relevant")


@query(
    "multi_query_merge",
    f"WITH {KNN} SELECT vec_id, round(max(c), 6) AS score, count(*) AS hits FROM p WHERE c > 0.2 GROUP BY vec_id",
)
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.hits_above(*_asked(spark, sf_dir), 0.2).withColumn("score", F.round("score", 6))


@query(
    "parent_documents",
    """WITH h AS (SELECT doc_id AS id, n_chars / 100000.0 AS s, CASE WHEN lang = 'en' THEN doc_id // 2 END AS par FROM documents WHERE n_chars >= 500),
x AS (SELECT id, s, 0 AS o FROM h UNION ALL SELECT doc_id, 0.9, 1 FROM documents WHERE doc_id IN (SELECT par FROM h))
SELECT id, round(arg_max(s, o), 6) AS similarity FROM x GROUP BY id""",
)
def parent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") / 100000.0).alias("similarity"), F.when(F.col("lang") == "en", F.expr("doc_id div 2")).alias("parent_id")
    )
    hits = chunks.where("similarity >= 0.005")
    return retrieval.with_parents(hits, chunks.withColumn("similarity", F.lit(0.0))).select("id", F.round("similarity", 6).alias("similarity"))


@query("vector_resample", "SELECT vec_id, len(embedding) * 2 AS size, round(sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS head_norm FROM embeddings")
def vector_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.functions.vectors import norm

    rows = table(spark, sf_dir, "embeddings")
    longer = F.size(resample(F.col("embedding"), 128)).cast("bigint")
    return rows.select("vec_id", longer.alias("size"), F.round(norm(resample(F.col("embedding"), 16)), 6).alias("head_norm"))


@query("label_centroids", "SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of merged entities."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", (F.col("i") + 1).cast("bigint").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


BOOST_QUERY = "explain the stoch class"


@query("boosted_rerank")
def boosted_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts of every document for a question; the regex families are checked in tests."""
    rows = table(spark, sf_dir, "documents")
    rows = retrieval.once(rows, "low", F.lower("text"))
    args = (F.col("text"), F.col("lang"), F.concat_ws("/", "source", "lang"), F.lit(True), F.col("low"))
    rows = retrieval.once(rows, "boost", retrieval.relevance_boost(BOOST_QUERY, *args))
    score = retrieval.reranked(BOOST_QUERY, F.least(F.lit(1.0), 0.3 + F.col("boost")), F.col("text"), F.col("lang"), F.lit(True), F.col("low"))
    return rows.select("doc_id", F.round("boost", 6).alias("boost"), F.round(score, 6).alias("score"))

"""The given tables, and the property graph that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, entity_type, observations) of regions, nations, customers, suppliers and parts."""
    shape = (
        ("region", "r:", "r_regionkey", "r_name", ()),
        ("nation", "n:", "n_nationkey", "n_name", (("region: ", "n_regionkey"),)),
        ("customer", "c:", "c_custkey", "c_name", (("nation: ", "c_nationkey"), ("segment: ", "c_mktsegment"))),
        ("supplier", "s:", "s_suppkey", "s_name", (("nation: ", "s_nationkey"),)),
        ("part", "p:", "p_partkey", "p_name", (("brand: ", "p_brand"), ("type: ", "p_type"), ("size: ", "p_size"))),
    )
    out = None
    for name, prefix, key, label, obs in shape:
        part = table(spark, sf_dir, name).select(
            _text(prefix, key).alias("id"),
            F.col(label).alias("name"),
            F.lit(name).alias("entity_type"),
            F.array(*[_text(p, c) for p, c in obs]).cast("array<string>").alias("observations"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind): containment of places, and which supplier supplies which part."""
    place = lambda t, a, x, b, y: table(spark, sf_dir, t).select(_text(a, x).alias("src"), _text(b, y).alias("dst"), F.lit("contains_item").alias("kind"))
    supplies = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").repartition("l_suppkey", "l_partkey").distinct()  # numbers, as names take more room; few repeat before the shuffle
    supplies = supplies.select(_text("s:", "l_suppkey").alias("src"), _text("p:", "l_partkey").alias("dst"), F.lit("supplies").alias("kind"))
    return (
        place("nation", "r:", "n_regionkey", "n:", "n_nationkey")
        .unionByName(place("customer", "n:", "c_nationkey", "c:", "c_custkey"))
        .unionByName(place("supplier", "n:", "s_nationkey", "s:", "s_suppkey"))
        .unionByName(supplies)
    )


#: The same two tables for DuckDB.
GRAPH_SQL = """
nodes AS (
  SELECT 'r:' || r_regionkey AS id, r_name AS name, 'region' AS entity_type, CAST([] AS VARCHAR[]) AS obs FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation', ['region: ' || n_regionkey] FROM nation
  UNION ALL SELECT 'c:' || c_custkey, c_name, 'customer', ['nation: ' || c_nationkey, 'segment: ' || c_mktsegment] FROM customer
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier', ['nation: ' || s_nationkey] FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, p_name, 'part', ['brand: ' || p_brand, 'type: ' || p_type, 'size: ' || p_size] FROM part
), edges AS (
  SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'contains_item' AS kind FROM nation
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'contains_item' FROM customer
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'contains_item' FROM supplier
  UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'supplies' FROM lineitem
)"""

"""Writes. A Spark table is immutable, so updates are new tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """Rows of both sides, per key the one of the highest ``order``, new rows first among equals."""
    both = table.withColumn("_side", F.lit(0)).unionByName(rows.withColumn("_side", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.col("_side").desc(), F.desc(order) if isinstance(order, str) else order.desc())
    return both.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_side")


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those rows whose key it lacks."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def update_where(table: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(table: DataFrame, gone: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Without the rows whose columns match a row of ``gone`` ({table column: gone column})."""
    keys = gone.select(*[F.col(g).alias(f"_gone_{i}") for i, g in enumerate(on.values())]).distinct()
    match = [table[t] == keys[f"_gone_{i}"] for i, t in enumerate(on)]
    return table.join(keys, match, "left_anti")


def tombstone_update(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Append, per changed row, its deletion and its new version; ``changed`` has the new rows by id."""
    old = nodes.join(changed.select("id"), "id", "left_semi")
    dead = old.withColumns({"deleted": F.lit(True), "version": F.col("version") + 1, "_pos": F.col("_pos") + 1})
    new = changed.join(old.select("id", F.col("version").alias("_v")), "id").withColumns({"deleted": F.lit(False), "version": F.col("_v") + 2}).drop("_v")
    return nodes.unionByName(dead).unionByName(new)


def csv_line(*columns: Column) -> Column:
    """A CSV line: quotes where a field needs them, null as empty."""

    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[,\n"]'), quoted).otherwise(text)

    return F.concat_ws(",", *map(field, columns))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; nested columns as JSON."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}
    df.withColumns(nested).write.option("header", True).option("escape", '"').option("nullValue", "").csv(path)


def snapshot(tables: Mapping[str, DataFrame], root: str, name: str) -> str:
    """Write tables under a snapshot folder."""
    for key, df in tables.items():
        df.write.parquet(f"{root}/{name}/{key}")
    return f"{root}/{name}"


def _files(spark: SparkSession, path: str):
    """(Hadoop file system, path)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_together(tables: Mapping[str, DataFrame], path: str) -> None:
    """All tables under a new folder, or none: they are written beside it and moved in one step."""
    from mnemospark.session import remove_path

    spark = next(iter(tables.values())).sparkSession
    staged = f"{path}.{uuid.uuid4().hex}.part"
    try:
        snapshot(tables, staged, "all")
        files, target = _files(spark, path)
        if files.exists(target) or not files.rename(_files(spark, f"{staged}/all")[1], target):
            raise FileExistsError(path)
    finally:
        remove_path(spark, staged)


def export_json(tables: Mapping[str, DataFrame], path: str) -> dict[str, int]:
    """Each table as JSON lines, and ``statistics`` with their rows; returns the counts."""
    counts = {}
    for key, df in tables.items():
        df.write.json(f"{path}/{key}")
        counts[key] = df.count()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(list(counts.items()), "table string, n_rows bigint").coalesce(1).write.json(f"{path}/statistics")
    return counts


def migrate(old: DataFrame, names: Mapping[str, str], path: str) -> int:
    """Write a table as JSON lines under new column names; if the written rows differ in number, remove them and raise."""
    from mnemospark.session import remove_path

    new = old.select(*[F.col(a).alias(b) for a, b in names.items()])
    new.write.json(path)
    wanted, there = old.count(), old.sparkSession.read.schema(new.schema).json(path).count()
    if wanted != there:
        remove_path(old.sparkSession, path)
        raise ValueError(f"{there} of {wanted} rows were written")
    return there


def list_snapshots(spark: SparkSession, root: str) -> list[str]:
    """Snapshot names, the newest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName() for s in files.listStatus(path)), reverse=True) if files.exists(path) else []


def prune_snapshots(spark: SparkSession, root: str, keep: int = 10) -> list[str]:
    """Remove all but the newest ``keep`` snapshots; return the removed names."""
    from mnemospark.session import remove_path

    gone = list_snapshots(spark, root)[keep:]
    for name in gone:
        remove_path(spark, f"{root}/{name}")
    return gone

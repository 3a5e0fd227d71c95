"""Session defaults and the shared working folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def build_session(app: str = "mnemospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given by the cluster win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset and all runs
    on one machine, as in tests, a temporary folder is chosen and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


_scopes: list[str] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """All fresh paths of the block lie in one folder, which goes at its end."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove_path(spark, "/".join((shared_dir(spark).rstrip("/"), *_scopes)))
        _scopes.pop()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return "/".join((shared_dir(spark).rstrip("/"), *_scopes, f"{name}-{uuid.uuid4().hex}"))


def materialize(df, name: str, **options: str):
    """Write a DataFrame to the shared folder and read it back.

    This cuts lineage with a table that outlives any one executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df, *columns: str):
    """Rows dealt evenly to as many tasks as there are cores, or by columns.

    A small file is read by a task or two, whatever work follows.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *columns)


def by_size(df, *columns: str, rows: int = 1_000_000):
    """Rows dealt by columns to as many tasks as keep each at about ``rows`` rows, however many there are."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *columns)


@contextlib.contextmanager
def wide_shuffles(spark: SparkSession, rows: int, each: int = 1_000_000) -> Iterator[None]:
    """What is planned in the block shuffles into as many partitions as keep ``each`` of ``rows`` in one, and joins only small ones."""
    wanted = {"spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

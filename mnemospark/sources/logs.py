"""Line-oriented sources: JSON lines, JSON exports, commit logs and status lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

NODE = "id string, agentId string, name string, entityType string, observations array<string>, timestamp bigint, version int, deleted boolean, accessCount bigint"
RELATION = "id string, agentId string, fromNodeId string, toNodeId string, relationType string, timestamp bigint, version int, deleted boolean"
EVENT = "id string, timestamp bigint, agentId string, eventType string, payload string, metadata struct<version:int,source:string,userId:string,correlationId:string,causationId:string>"


def placed_lines(lines: DataFrame) -> DataFrame:
    """(value, _pos) of a text source: files by time of change, then by path, and lines in their order.

    Blocks of files, a row each, are ranked; a line's place is its block's rank and its own number in the task that read it.
    """
    block = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"]
    named = lines.select("value", *[F.col(c).alias(f"_b{i}") for i, c in enumerate(block)], F.monotonically_increasing_id().alias("_id"))
    ranked = lines.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(block)]).distinct()
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.orderBy("_b0", "_b1", "_b2")))  # a row a block of a file
    place = F.col("_rank").cast("bigint") * F.lit(1 << 33) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return named.join(ranked, ["_b0", "_b1", "_b2"]).select("value", place.alias("_pos"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their place (``_pos``): older files first, then by path, then by line.

    Blank and broken lines are left out, a missing path is empty.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("_pos", F.lit(0).cast("bigint"))
    value = F.from_json("value", schema)
    rows = placed_lines(lines).select("_pos", F.try_parse_json("value").alias("raw"), value.alias("v"))
    return rows.where(F.col("raw").isNotNull() & F.col("v").isNotNull()).select("v.*", "_pos")


def stream_json_lines(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines of a folder's files as a stream; blank and broken lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    rows = lines.select(F.try_parse_json("value").alias("raw"), F.from_json("value", schema).alias("v"))
    return rows.where(F.col("raw").isNotNull() & F.col("v").isNotNull()).select("v.*")


def read_export(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """One array of a JSON export document, a row an element."""
    whole = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(path)
    return whole.select(F.inline(field))


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime, n_lines) of the files under a path; lines that parse as JSON count."""
    facts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").isNotNull().cast("long").alias("ok"))
    return facts.join(lines.groupBy("path").agg(F.sum("ok").alias("n_lines")), "path", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def line_kind(raw: Column) -> Column:
    """What a JSON line is: a graph node, an event, a generic object or broken."""
    has = lambda key: F.get_json_object(raw, f"$.{key}").isNotNull()
    return (
        F.when(F.try_parse_json(raw).isNull(), "invalid")
        .when(has("name") & has("entityType"), "node")
        .when(has("eventType") | has("type"), "event")
        .otherwise("object")
    )


def embedding_text(raw: Column) -> Column:
    """The text to embed of a JSON line, by its kind."""
    get = lambda key: F.get_json_object(raw, f"$.{key}")
    notes = F.array_join(F.from_json(get("observations"), "array<string>"), ". ")
    return F.coalesce(
        F.when(get("name").isNotNull() & get("observations").isNotNull(), F.concat(get("name"), F.lit(": "), notes)),
        F.when(get("eventType").isNotNull(), F.concat_ws(" ", F.lit("Event"), get("eventType"), get("payload"))),
        get("description"), get("content"), get("text"), raw,
    )


def commits(log: DataFrame, column: str = "value") -> DataFrame:
    """(hash, author, date, message, pos) from a log with 0x1e between records and 0x1f between fields."""
    records = log.select(F.posexplode(F.split(column, "\x1e")).alias("pos", "record")).where(F.trim("record") != "")
    part = F.split(F.regexp_replace("record", r"^\s+", ""), "\x1f")
    return records.select("pos", *[F.get(part, i).alias(n) for i, n in enumerate(("hash", "author", "date", "message"))])


# Letters of a two-letter status.
STATUS_WORDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "U": "conflicted", "?": "untracked"}


def status_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, status, staged) from lines of two status letters and a path."""
    x, y = F.substring(column, 1, 1), F.substring(column, 2, 1)
    staged = ~x.isin(" ", "?")
    letter = F.when(staged, x).otherwise(y)
    word = F.lit("unknown")
    for key, value in STATUS_WORDS.items():
        word = F.when(letter == key, value).otherwise(word)
    return lines.where(F.length(column) > 3).select(F.substring(column, 4, 2**30).alias("path"), word.alias("status"), staged.alias("staged"))

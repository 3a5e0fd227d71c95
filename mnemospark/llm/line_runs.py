"""Line dedup with levelled sorted runs of line hashes.

A run is a table (line hash, number of documents), bucketed by hash and sorted
within each bucket, one file a bucket. Documents come in batches of a bounded
number of rows. A new batch of counts merge-anti-joins the runs' frequent keys,
and the rest is added as a run of level 0. When a level holds ``fanout`` runs
they are compacted into one of the next: full outer merge joins along the
buckets' order, counts added up. As all runs share their buckets and order,
neither join shuffles or sorts. Tables lie in the shared folder, so a lost
executor loses none; merged runs are removed.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
lower-cased; it is known by 128 bits of XXH3. A row is a document.

To rewrite texts, up to ``FREQUENT_KEYS`` frequent keys go to the workers as a
set; beyond that each document's keys are joined with them in a shuffle.

Edge cases: a null or empty text is one empty line, whose empty key is shorter
than ``min_chars`` and so stays; a document that loses all lines becomes the
empty text; a repeated row counts again; other columns are ignored or passed on.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import materialize, remove_path, scratch_path

from .textops import code_points, map_batches, utf8

MIN_DOCS, MIN_CHARS = 10, 1
FREQUENT_KEYS = 500_000
#: Rows of a batch, and line keys that a task counts before it sends them on.
BATCH_ROWS, FLUSH_KEYS = 20_000_000, 200_000
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key, None if the key is too short."""
    key = line.strip().lower()
    return xxhash.xxh3_128_digest(key) if code_points(key) >= min_chars else None


def text_digests(text: bytes, min_chars: int) -> set[bytes]:
    return {d for line in text.split(b"\n") if (d := line_digest(line, min_chars)) is not None}


def halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class LineRuns:
    """The levelled store."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.base, self.buckets = scratch_path(spark, "line-runs"), buckets_of(spark)
        self.levels: list[list[str]] = []

    def store(self, rows: DataFrame, *partitions: str) -> str:
        """Write rows, already dealt by (h1, h2), as a bucketed and sorted table."""
        name = f"line_runs_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.base}/{name}")
        before = self.spark.conf.get(ORDERED, "false")
        self.spark.conf.set(ORDERED, "true")  # each bucket is one sorted file
        try:
            (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(name)
        finally:
            self.spark.conf.set(ORDERED, before)
        return name

    def remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_path(self.spark, f"{self.base}/{name}")

    def hot(self, name: str) -> DataFrame:
        """(h1, h2) of a run's frequent keys."""
        return self.spark.table(name).where(F.col("n") >= self.min_docs).select("h1", "h2")

    def add(self, counts: DataFrame) -> None:
        """Add a batch of (h1, h2, n), one row a key."""
        for name in (x for level in self.levels for x in level):
            counts = counts.join(self.hot(name).hint("merge"), ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self.store(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if len(self.levels) == level + 1:
                self.levels.append([])
            runs, self.levels[level] = self.levels[level], []
            self.levels[level + 1].append(self.merge(runs))
            level += 1

    def merge(self, runs: list[str]) -> str:
        """One run of several, merged in their order."""
        merged = self.spark.table(runs[0])
        for name in runs[1:]:
            more = self.spark.table(name).withColumnRenamed("n", "m").hint("merge")
            both = merged.join(more, ["h1", "h2"], "full")
            merged = both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        made = self.store(merged)
        for name in runs:
            self.remove(name)
        return made

    def close(self) -> DataFrame:
        """Merge what is left and return the frequent keys; all runs are removed."""
        rest = [x for level in self.levels for x in level]
        last = self.merge(rest) if len(rest) > 1 else rest[0]
        self.levels = []
        found = materialize(self.hot(last), "frequent-lines")
        self.remove(last)
        return found


def line_counts(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """(batch, h1, h2, n), dealt by (h1, h2): in how many documents of a batch each key stands."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, bytes]] = Counter()

        def flush() -> pa.RecordBatch:
            h1, h2 = halves([d for _, d in seen])
            out = pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.int32()), h1, h2, pa.array(list(seen.values()), pa.int64())], ["batch", "h1", "h2", "n"])
            seen.clear()
            return out

        for batch in found:
            for part, text in zip(batch.column("batch").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                seen.update([(part, d) for d in text_digests(text.as_py() or b"", min_chars)])
                if len(seen) > FLUSH_KEYS:
                    yield flush()
        yield flush()

    parts = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "text")
    counts = parts.mapInArrow(run, "batch int, h1 bigint, h2 bigint, n bigint").repartition(buckets_of(docs.sparkSession), "h1", "h2")
    return counts.groupBy("batch", "h1", "h2").agg(F.sum("n").alias("n"))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int | None = None) -> DataFrame:
    """(h1, h2) of the line keys found in at least ``min_docs`` rows, batch by batch through the runs."""
    if batches is None:
        batches = max(4, -(-docs.count() // BATCH_ROWS))
    runs = LineRuns(docs.sparkSession, min_docs)
    stored = runs.store(line_counts(docs, batches, min_chars), "batch")
    for b in range(batches):
        runs.add(docs.sparkSession.table(stored).where(F.col("batch") == b).select("h1", "h2", "n"))
    runs.remove(stored)
    return runs.close()


def _rewrite(text: bytes, hot, min_chars: int) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [x for x in lines if line_digest(x, min_chars) not in hot]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def drop_lines(docs: DataFrame, hot: DataFrame, min_chars: int = MIN_CHARS, broadcast_keys: int = FREQUENT_KEYS) -> DataFrame:
    """``doc_id``, ``kept_text``, ``n_lines``, ``n_dropped`` and ``row``, a struct of all columns but text, per row."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    packed = docs.select(rest.alias("row"), "text")
    row_type = packed.schema["row"].dataType.simpleString()
    schema = f"row {row_type}, kept_text string, n_lines bigint, n_dropped bigint"

    def out(batch: pa.RecordBatch, done: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        text, n, d = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["row", "kept_text", "n_lines", "n_dropped"])

    some = hot.limit(broadcast_keys + 1).toPandas()  # bounded
    if len(some) <= broadcast_keys:
        table = np.stack([some["h1"].to_numpy(np.int64), some["h2"].to_numpy(np.int64)], 1).astype(">i8")
        keys = docs.sparkSession.sparkContext.broadcast(frozenset(x.tobytes() for x in table))
        return map_batches(packed, ["row", "text"], lambda b: out(b, [_rewrite(t, keys.value, min_chars) for t in utf8(b.column("text"))]), schema)

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, found = [], []
        for i, text in enumerate(utf8(batch.column("text"))):
            own = text_digests(text, min_chars)
            at += [i] * len(own)
            found += own
        h1, h2 = halves(found)
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("sha").take(take), h1, h2], ["id", "sha", "h1", "h2"])

    # the lines that a text loses depend on the text alone: id and digest name it, and no row twice
    named = docs.select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text")
    keys = map_batches(named, ["id", "sha", "text"], explode, "id bigint, sha string, h1 bigint, h2 bigint")
    hits = keys.distinct().join(hot, ["h1", "h2"]).groupBy("id", "sha").agg(F.collect_list(F.struct("h1", "h2")).alias("hits"))
    sha = F.sha2(F.coalesce(packed["text"], F.lit("")), 256)
    both = packed.join(hits, packed["row.doc_id"].eqNullSafe(hits["id"]) & (sha == hits["sha"]), "left").select("row", "text", "hits")

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = []
        for text, own in zip(utf8(batch.column("text")), batch.column("hits").to_pylist(), strict=True):
            table = np.array([(h["h1"], h["h2"]) for h in own or []], ">i8").reshape(-1, 2)
            done.append(_rewrite(text, {x.tobytes() for x in table}, min_chars))
        return out(batch, done)

    return map_batches(both, ["row", "text", "hits"], drop, schema)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, **options) -> DataFrame:
    """Count, then drop the frequent lines of every row; see ``drop_lines``."""
    return drop_lines(docs, frequent_lines(docs, min_docs, min_chars), min_chars, **options)

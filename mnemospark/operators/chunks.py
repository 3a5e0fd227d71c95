"""Chunking, routing, batching and incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from mnemospark.operators.context import importance
from mnemospark.operators.openings import openings, ranged_totals


def windows(text: str, most: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """(chunk, first line, last line, text) of windows of whole lines: each carries back lines of the one before."""
    lines = text.split("\n")
    held: list[str] = []
    start, size, n = 1, 0, 0
    for number, line in enumerate(lines, 1):
        if held and size + len(line) + 1 > most:
            yield n, start, number - 1, "\n".join(held)
            n += 1
            back: list[str] = []
            carried = 0
            for old in reversed(held):
                if carried >= overlap or len(back) == len(held) - 1:
                    break
                back.insert(0, old)
                carried += len(old) + 1
            held, start, size = back, number - len(back), carried
        held.append(line)
        size += len(line) + 1
    if held:
        yield n, start, len(lines), "\n".join(held)


@udtf(returnType="part int, text string", useArrow=True)
class SentenceSplits:
    """Cuts at a limit, better after a full stop or line break of the second half."""

    def eval(self, text: str, most: int) -> Iterator[tuple[int, str]]:
        text, at, n = text or "", 0, 0
        while len(text) - at > most:
            low, high = at + most // 2, at + most
            cut = max(text.rfind(".", low, high), text.rfind("\n", low, high)) + 1 or high
            yield n, text[at:cut]
            at, n = cut, n + 1
        yield n, text[at:]


def line_windows(docs: DataFrame, key: str, text: str, most: int = 8000, overlap: int = 200) -> DataFrame:
    """(key, chunk, start_line, end_line, text) of each text's windows, a batch of texts at a time; null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *w) for k, t in zip(batch["k"], batch["t"], strict=True) for w in windows(t or "", most, overlap)]
            yield pd.DataFrame(rows, columns=["k", "chunk", "start_line", "end_line", "text"])

    kind = dict(docs.dtypes)[key]
    made = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk int, start_line int, end_line int, text string")
    return made.withColumnRenamed("k", key)


def sentence_splits(docs: DataFrame, key: str, text: str, most: int = 2000) -> DataFrame:
    spark = docs.sparkSession
    spark.udtf.register("sentence_splits", SentenceSplits)
    docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).createOrReplaceTempView("_split_input")
    return spark.sql(f"SELECT _key AS {key}, s.* FROM _split_input, LATERAL sentence_splits(_text, {most}) s")


def fixed_windows(docs: DataFrame, key: str, text: str, lines: int = 150) -> DataFrame:
    """(key, window, first_line, last_line, n_chars) of windows of a fixed number of lines."""
    rows = docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    at = F.floor(F.col("pos") / lines)
    return rows.groupBy(key, at.alias("window")).agg((F.min("pos") + 1).alias("first_line"), (F.max("pos") + 1).alias("last_line"), F.sum(F.length("line")).alias("n_chars"))


def entity_chunks(files: DataFrame, text: str, entities: str, least: int = 100) -> DataFrame:
    """(…, name, text, hash) of the lines of each entity (array of struct name, start, end); short ones go."""
    rest = [c for c in files.columns if c not in (text, entities)]
    one = files.select(*rest, F.split(text, "\n").alias("_lines"), F.explode(entities).alias("e"))
    body = F.array_join(F.slice("_lines", F.col("e.start"), F.greatest(F.col("e.end") - F.col("e.start") + 1, F.lit(0))), "\n")
    return one.select(*rest, F.col("e.name").alias("name"), body.alias("text"), F.sha2(body, 256).alias("hash")).where(F.length("text") >= least)


def scored_entity_chunks(files: DataFrame, text: str, entities: str, least: int = 100) -> DataFrame:
    """``entity_chunks`` by start line with ``importance``; entities also have type, exported, public, is_async and documented."""
    one = files.withColumn("_e", F.explode(entities))
    kinds = importance(F.col("_e.type"), F.col("_e.exported"), F.col("_e.public"), F.col("_e.is_async"), F.col("_e.documented"))
    marked = one.select("*", F.col("_e.start").alias("start"), kinds.alias("importance"), F.array(F.struct("_e.name", "_e.start", "_e.end")).alias("_one"))
    return entity_chunks(marked.drop("_e", entities), text, "_one", least)


def content_type(text: Column, is_summary: Column) -> Column:
    """summary, comment, code or documentation."""
    # Words of code and of prose. Words end at letters beyond ASCII, which Java's \b takes for their own.
    count = lambda words: F.regexp_count(text, F.lit(rf"(?i)(?<![a-z0-9_])({words})(?![a-z0-9_])"))
    code = count("function|class|const|let|var|if|for|while|return|import|export")
    prose = count("the|and|or|but|in|on|at|to|for|of|with|by")
    head = F.regexp_replace(text, r"^[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", "")
    comment = head.startswith("//") | head.startswith("/*") | head.startswith("*")
    return F.when(is_summary, "summary").when(comment, "comment").when((code > 2) & ~(prose > 3), "code").otherwise("documentation")


def routed(text: Column, is_summary: Column) -> Column:
    """struct<kind, model>: code, and comments that are code, go to the code model, all else to the prose model."""
    kind = content_type(text, is_summary)
    is_code = (kind == "code") | ((kind == "comment") & (content_type(F.concat(F.lit("."), text), F.lit(False)) == "code"))
    return F.struct(kind.alias("kind"), F.when(is_code, "code_model").otherwise("prose_model").alias("model"))


def routing_distribution(rows: DataFrame, kind: str = "kind", model: str = "model") -> DataFrame:
    """How many rows of each kind went to each model."""
    return rows.groupBy(kind).pivot(model, ["code_model", "prose_model"]).count().na.fill(0)


def balanced(rows: DataFrame, model: str, order: str, most: float = 0.8, to: float = 0.7) -> DataFrame:
    """Rows by model; if one has over ``most`` of all, those past its first ``to`` go to the other."""
    share = rows.groupBy(model).agg(F.count("*").alias("n")).toPandas()  # a row a model
    total = int(share["n"].sum())
    heavy = share[share["n"] > most * total][model].tolist()
    if not heavy or len(share) < 2:
        return rows
    other = next(m for m in share[model] if m != heavy[0])
    ranked = ranged_totals(rows, model, [order])
    moved = (F.col(model) == heavy[0]) & (F.col("rank") > int(to * total))
    return ranked.withColumn(model, F.when(moved, F.lit(other)).otherwise(F.col(model))).select(*rows.columns)


def greedy_batches(rows: DataFrame, group: str, order: str, tokens: str, most_rows: int = 100, most_tokens: int = 20_000) -> DataFrame:
    """Add ``batch``: rows in order, a new batch where the next row would pass a limit.

    The running sum starts anew with each batch; ``openings`` finds where, in groups of
    any length. A row over the limit is a batch of its own; null tokens are none.
    """
    ranked = ranged_totals(rows.select(group, order, F.col(tokens).alias("_tokens")), group, [order], F.col("_tokens"))
    own = F.greatest(F.coalesce(F.col("_tokens").cast("long"), F.lit(0)), F.lit(0))
    until = F.greatest(F.col("total") - own + most_tokens, F.col("total"))
    made = openings(ranked, group, [order], F.col("total"), until, F.when(own > most_tokens, 1).otherwise(most_rows))
    return made.select(group, order, F.col("opening").cast("int").alias("batch"))


def ingest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): new, changed, unchanged or deleted, by hash."""
    a, b = old.select(F.col(key), F.col(digest).alias("was")), new.select(F.col(key), F.col(digest).alias("now"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that the new scan lacks."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def newest_hash(rows: DataFrame, key: str, ts: str, pos: str, digest: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(pos).desc()))
    return rows.withColumn("_rank", rank).where("_rank = 1").select(key, digest)

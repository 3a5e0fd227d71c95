"""Vector retrieval, boosts, fusion and deduplication of ranked lists."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.strings import basename, char_overlap, query_terms, stem_of_file, tokens
from mnemospark.functions.vectors import l2
from mnemospark.operators import blocks
from mnemospark.operators.search import top_per_query
from mnemospark.session import materialize


def knn(pairs: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", vector: str = "embedding", wanted: str = "query_vector", drop_far: bool = True) -> DataFrame:
    """The ``k`` nearest rows of each query by L2, with similarity 1 - distance, cut at 0 and then dropped."""
    near = pairs.withColumn("distance", l2(F.col(vector), F.col(wanted)))
    return _with_similarity(top_per_query(near, query, [F.col("distance"), F.col(key)], k), drop_far)


def _with_similarity(best: DataFrame, drop_far: bool) -> DataFrame:
    best = best.withColumn("similarity", F.least(F.greatest(1 - F.col("distance"), F.lit(0.0)), F.lit(1.0)))
    return best.where("similarity > 0") if drop_far else best


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int, drop_far: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``knn`` for queries (query_id, query_vector) against all other rows (vec_id, embedding), by matrix products in tasks."""
    return _with_similarity(blocks.best_rows(queries, rows, k, distance=True, also=also).withColumnRenamed("score", "distance"), drop_far)


# Patterns that raise a chunk's score.
METHOD_PATTERNS = (
    r"\b(?:function|def|func|fn)\s+\w+\s*[({]",
    r"\b(?:public|private|protected|static|async|override)\s+(?:\w+\s+)?\w+\s*\(",
    r"\b(?:constructor|__init__|new)\s*\(",
    r"\w+\s*[=:]\s*(?:\([^)]*\)\s*)?=>",
    r"\b(?:this|self)\.\w+\s*\(",
    r"\b(?:class|struct|interface|enum|trait)\s+\w+",
)
CONTENT_PATTERNS = (
    r"\b(?:class|interface|enum|struct|trait|type|union|record)\s+\w+",
    r"\b(?:function|def|func|fn|method|proc)\s+\w+",
    r"\b(?:public|private|protected|static|final|abstract|virtual|override|async|const|let|var)\s+\w+",
    r"\b(?:return|yield|throw)\s+",
    r"\b(?:this|self|@)\.[\w$]+\s*[=:]",
    r"\b(?:if|for|while|switch|match|case|when|loop|do)\s*[({]",
    r"\b(?:try|catch|except|finally|rescue|ensure)\b",
    r"\b(?:await|async|Promise|Future|Task|Deferred|Observable)\b",
    r"\b(?:new|delete|malloc|free|alloc)\b",
    r"\b(?:import|from|include|require|use|using)\s+",
)
SIGNATURE_PATTERNS = (
    r"\b(?:constructor|__init__|new|init)\s*\(",
    r"\b(?:main|run|execute|start|begin|init|setup|configure)\w*\s*\(",
    r"\b(?:process|handle|manage|operate|perform|apply)\w*\s*\(",
    r"\b(?:update|modify|change|set|assign|alter)\w*\s*\(",
    r"\b(?:get|fetch|retrieve|find|search|query|select)\w*\s*\(",
    r"\b(?:create|build|make|generate|construct|produce)\w*\s*\(",
    r"\basync\s+\w+\s*\(",
    r"\b(?:public|export|def)\s+\w+\s*\(",
)


def _flag(test: Column, points: float) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(points)).otherwise(F.lit(0.0))


def _needs(pattern: str) -> list[str]:
    """Texts of which a pattern can't do without: the words of its first choice, or its arrow."""
    if "=>" in pattern:
        return ["=>"]
    found = re.search(r"\(\?:([\w|@]+)\)(?![?*])", pattern)
    words = found[1].split("|") if found else []
    return [w for w in words if not any(x != w and x in w for x in words)]  # who holds a word holds the words within it


#: What a pattern ends with, and the signs of which a text must then hold one.
ENDS = {r"\(": "(", "[({]": "({", "[=:]": "=:"}


def has_pattern(low: Column, pattern: str) -> Column:
    """Whether a lower-cased text matches; the pattern is only tried on texts that hold one of the signs and one of the words it needs."""
    signs = next((signs for end, signs in ENDS.items() if pattern.endswith(end)), "")
    needed = [[low.contains(w.lower()) for w in words] for words in (signs, _needs(pattern)) if words]
    return functools.reduce(lambda a, b: a & b, [*(functools.reduce(lambda a, b: a | b, some) for some in needed), low.rlike(pattern)])


def relevance_boost(query: str, text: Column, entity: Column, path: Column, is_chunk: Column, low: Column | None = None) -> Column:
    """At most 0.6 for names, code patterns, path and size; patterns see lower-cased text.

    ``low`` is the text in lower case where a column of it is at hand.
    """
    terms = query_terms(F.lit(query))
    low, name = F.lower(text) if low is None else low, F.lower(entity)
    some = lambda test: F.exists(terms, test)
    nearest = F.array_max(F.transform(terms, lambda t: char_overlap(t, name)))
    names = _flag(some(lambda t: t == name), 0.4) + _flag(some(lambda t: name.contains(t) | t.contains(name)), 0.25)
    names += F.when(F.coalesce(nearest, F.lit(0.0)) > 0.7, 0.2 * nearest).otherwise(0.0)
    methods = sum((_flag(has_pattern(low, p), 0.15) for p in METHOD_PATTERNS), F.lit(0.0))
    methods = F.least(F.lit(0.3), methods * F.when(F.coalesce(some(lambda t: name.contains(t)), F.lit(False)), 1.5).otherwise(1.0))
    content = F.least(F.lit(0.2), sum((_flag(has_pattern(low, p), 0.05) for p in CONTENT_PATTERNS), F.lit(0.0)))
    stem = F.lower(stem_of_file(path))
    parts = F.split(F.lower(path), "/")
    place = _flag(some(lambda t: stem.contains(t)), 0.15) + _flag(some(lambda t: F.exists(parts, lambda p: p.contains(t))), 0.08)
    size = _flag(F.length(text) > 500, 0.1) + _flag(F.length(text) > 1000, 0.1) + _flag(low.contains(name), 0.1)
    return F.least(F.lit(0.6), names + methods + content + place + F.when(is_chunk, size).otherwise(0.0))


# Words of a question that asks for code, or for an overview.
EXPLAIN_WORDS = ("how does", "how is", "explain", "understand", "work", "implement", "integrate")
CODE_WORDS = ("function", "class", "method", "variable", "interface", "type", "const", "let", "var")
OVERVIEW_WORDS = ("overview", "summary", "architecture", "structure", "design")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose value is computed a single time, however often later columns use it: a generator stands between."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def reranked(query: str, similarity: Column, text: Column, entity: Column, is_chunk: Column, lowered: Column | None = None) -> Column:
    """Similarity with boosts for name, shared words and kind, at most 1.

    ``lowered`` is the text in lower case where a column of it is at hand.
    """
    low = query.lower()
    wanted, lowered = list(dict.fromkeys(re.split(r"[ \t\n\x0b\f\r]+", low.strip(" \t\n\x0b\f\r")))), F.lower(text) if lowered is None else lowered
    stands = lambda w: lowered.contains(w) & lowered.rlike(r"(?:^|\s)" + "".join(rf"\x{{{ord(c):x}}}" for c in w) + r"(?:\s|\z)")
    shared = sum((F.coalesce(stands(w), F.lit(False)).cast("int") for w in wanted), F.lit(0)) / F.lit(len(wanted)) * 0.1 if wanted != [""] else F.lit(None).cast("double")
    code = (0.2 if any(w in low for w in EXPLAIN_WORDS) else 0.05) + (0.08 if any(w in low for w in CODE_WORDS) else 0)
    overview = 0.08 if any(w in low for w in OVERVIEW_WORDS) else 0.0
    name = _flag(F.lit(low).contains(F.lower(entity)), 0.15)
    return F.least(F.lit(1.0), similarity + name + F.coalesce(shared, F.lit(0.0)) + F.when(is_chunk, F.lit(code)).otherwise(F.lit(overview)))


# Patterns of definitions, and of code that acts.
DEFINING = (
    r"\b(?:class|struct|interface|enum|trait|type)\s+\w+", r"\b(?:function|def|func|fn|method|proc)\s+\w+", r"\b(?:public|private|protected|static|async|export)\s+\w+\s*\(",
)
ACTING = (
    r"\b(?:async|public|private|protected|static)\s+\w+\s*\(", r"\b(?:this|self|@)\.\w+", r"\b(?:return|yield|throw)\s+", r"\b(?:function|def|func|fn|method|proc)\s+\w+",
)


def diversified(rows: DataFrame, query: str, k: int, text: str = "text", entity: str = "entity", score: str = "score") -> DataFrame:
    """Raise implementations of what a query names if fewer than 40 % of ``k`` rows are some.

    If no row at all has a signature, rows about it that act get 0.25. Rows of
    constants and prompts are left out. Both counts are over the few top rows.
    """
    target = next((w for w in query.lower().split() if len(w) > 3), query.lower())
    low, name = F.lower(text), F.coalesce(F.col(entity), F.lit(""))
    any_of = lambda patterns: F.greatest(*[low.rlike(p) for p in patterns])
    constant = ((F.trim(name) == F.upper(F.trim(name))) & name.contains("_")) | F.lower(name).contains("prompt")
    about = ~constant & (F.lower(name).contains(target) | low.contains(target))
    marked = rows.withColumns({"_signed": any_of(SIGNATURE_PATTERNS), "_about": about})
    marked = marked.withColumn("_made", F.col("_about") & (F.col("_signed") | any_of(DEFINING)))
    sums = marked.agg(F.count_if("_made").alias("n"), F.coalesce(F.max("_signed"), F.lit(False)).alias("any")).first()
    counted = marked.withColumns({"_n": F.lit(sums["n"]), "_any": F.lit(sums["any"])})
    capped = lambda x: F.least(F.lit(1.0), x)
    raised = capped(capped(F.col(score) + _flag(F.col("_signed"), 0.4)) + _flag(F.length(text) > 800, 0.2))
    first = F.when((F.col("_n") < int(0.4 * k)) & F.col("_made"), raised).otherwise(F.col(score))
    second = F.when(~F.col("_any") & F.col("_about") & any_of(ACTING), capped(first + 0.25)).otherwise(first)
    return counted.withColumn(score, second).drop("_signed", "_about", "_made", "_n", "_any")


def with_parents(hits: DataFrame, chunks: DataFrame, query: str | None = None) -> DataFrame:
    """Hits and their parents at 0.9, for each ``query``; a parent that was hit itself keeps the parent's score."""
    keys = ["id"] if query is None else [query, "id"]
    ids = hits.where(F.col("parent_id").isNotNull()).select(*keys[:-1], F.col("parent_id").alias("id")).distinct()
    parents = chunks.join(ids, "id").select(*keys, *[c for c in hits.columns if c not in keys]).withColumn("similarity", F.lit(0.9))
    both = hits.withColumn("_order", F.lit(0)).unionByName(parents.withColumn("_order", F.lit(1)))
    rest = [c for c in hits.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_order").alias("r")).select(*keys, "r.*")


def reciprocal_rank_fusion(lists: DataFrame, key: str, k: int = 60, weight: Column | None = None, group: list[str] | None = None) -> DataFrame:
    """Sum of weight / (k + rank) over lists (``list``, ``pos``), each key once a list at its first place."""
    group = group or []
    first = lists.groupBy(*group, "list", key).agg(F.min("pos").alias("pos"))
    part = (F.lit(1.0) if weight is None else weight) / (k + F.col("rank"))
    return ranked_within(first, [*group, "list"], ["pos", key]).withColumn("part", part).groupBy(*group, key).agg(F.sum("part").alias("score"))


def ranked_within(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``rank``, from 1 by a total order within each group, however long a group is.

    Rows are dealt by ranges of group and order; a range's rows are ranked alone and
    get the numbers of the ranges before it.
    """
    dealt = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    sizes = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")  # a row a range
    bases = sizes.select(*group, "_range", before.alias("_base"))
    own = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return dealt.withColumn("rank", own).join(bases, [*group, "_range"]).withColumn("rank", F.col("rank") + F.col("_base")).drop("_range", "_base")


def first_place_last_value(rows: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Per key the first position and the last value."""
    return rows.groupBy(*keys).agg(F.min(pos).alias("first_pos"), F.max_by(value, pos).alias(value))


def dedup_contexts(rows: DataFrame, score: str = "score", pos: str = "pos") -> DataFrame:
    """One row per path, entity and content (eight digits of MD5): the best score, then the first."""
    key = [F.col("path"), F.col("entity"), F.substring(F.md5("content"), 1, 8)]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(score).desc(), pos))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dedup_contexts_in_batches(rows: DataFrame, size: int = 1000, score: str = "score", pos: str = "pos") -> DataFrame:
    """``dedup_contexts`` in batches of places; of what is left, the first of each path and entity over all batches."""
    batch = F.floor(F.col(pos) / size)
    key = [batch, F.col("path"), F.col("entity"), F.substring(F.md5("content"), 1, 8)]
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(score).desc(), pos))
    first = F.row_number().over(Window.partitionBy("path", F.coalesce("entity", F.lit("N/A"))).orderBy(batch, pos))
    return rows.withColumn("_rank", best).where("_rank = 1").withColumn("_rank", first).where("_rank = 1").drop("_rank")


def word_set(text: Column) -> Column:
    """Sorted distinct words of more than two characters."""
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) > 2)))


def similar_pairs(rows: DataFrame, key: str, text: str, least: float = 0.85) -> DataFrame:
    """Similar pairs of texts by their word sets."""
    return similar_sets(rows.select(key, word_set(F.col(text)).alias("words")), key, least)


#: Words that many classes hold, of which counts are broadcast; of the others only whether two classes or more hold them.
FREQUENT = 200_000
#: Classes that hold a word beyond which sizes part its rows.
DENSE = 1000
#: Bits of the map of words that two classes or more hold, at most.
MAP_BITS = 1 << 27
#: Longs of a set's sketch.
SKETCH = 4
#: Words and pairs that are compared in one group, about.
GROUP_WORDS, GROUP_PAIRS = 4_000_000, 2_000_000


def packed(words: Column) -> Column:
    """A set of words as one text, a word a line, for shuffles: an eighth of what the array takes there; other sets give other texts."""
    line = lambda w: F.replace(F.replace(w, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, line), "\n", "\\0"))


def _prefixes(batches: Iterator[pa.RecordBatch], known: np.ndarray, counts: np.ndarray, shared: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """(id, n, band, word, dense, rank, s0 to s3): the rarest words of each set, so many that the rest can't reach ``least``, and its sketch.

    Words come in order of how many classes hold them, first those that no other does;
    these count for the rank but meet nothing, so they are left out. ``shared`` is a map
    of bits of words that several hold. A sketch has a bit for the parity of the words in
    each of its buckets, so two sets differ in as many words as their sketches in bits,
    at least.
    """
    names = ["id", "n", "band", "word", "dense", "rank", *[f"s{i}" for i in range(SKETCH)]]
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, n_bits = batch.column("hashes"), 64 * SKETCH
        n, word = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        bit = word & (8 * len(shared) - 1)
        df = ((shared[bit >> 3] >> (bit & 7)) & 1).astype(np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            df = np.where(known[at] == word, counts[at], df)
        order = np.lexsort((word, df, row))  # stable: words of one hash stay in their order
        rank = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + 1
        df = df[order]
        kept = (rank <= np.repeat(n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, n)) & (df > 0)
        parity = np.bincount(row * n_bits + (word & (n_bits - 1)), minlength=len(n) * n_bits) & 1
        sketch = np.packbits(parity.reshape(len(n), n_bits).astype(np.uint8), axis=1).view(np.int64)
        row, word, rank, dense = row[kept], word[order][kept], rank[kept], df[kept] > DENSE
        # two similar sizes differ by a factor of 1 / least at most, so their bands by one
        band = np.floor(np.log(n) / math.log(1 / least) + 1e-9).astype(np.int64) if least < 1 else n
        ids = batch.column("id").take(pa.array(row))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n[row]), pa.array(band[row]), pa.array(word), pa.array(dense), pa.array(rank), *[pa.array(sketch[row, i]) for i in range(SKETCH)]], names)


def _word_counts(hashed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The words that most classes hold, in order, how many do, a map of the bits of all words that several hold, and in how many places these stand."""
    several = hashed.select(F.explode("hashes").alias("word")).groupBy("word").agg(F.count("*").alias("df")).where("df > 1")
    several = materialize(several, "set-words")
    sums = several.agg(F.count("*").alias("words"), F.coalesce(F.sum("df"), F.lit(0)).alias("places")).first()
    bits = min(MAP_BITS, max(1 << 15, 1 << (16 * sums["words"]).bit_length()))
    often = several.orderBy(F.desc("df"), "word").limit(FREQUENT).toArrow()
    known, counts = often.column("word").to_numpy(), often.column("df").to_numpy()
    order = np.argsort(known)
    place = F.col("word").bitwiseAND(F.lit(bits - 1).cast("bigint")) + 1  # Spark's buckets of 32768 bits begin at 1
    maps = several.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    shared = np.zeros(bits // 8, np.uint8)
    for bucket, some in zip(maps.column("bucket").to_pylist(), maps.column("bits").to_pylist(), strict=True):
        shared[(bucket - 1) * len(some) : bucket * len(some)] = np.frombuffer(some, np.uint8)
    return known[order], counts[order], shared, sums["places"]


def _confirmed(pairs: pa.Table, sets: pa.Table, least: float) -> pa.Table:
    """(a, b, similarity) of the pairs (id, n, id2, n2) whose sets (id, words), of so many words, are ``least`` alike."""
    lists = pc.split_pattern(sets.column("words").combine_chunks(), "\n")
    size, code = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().dictionary_encode()
    held, code = np.zeros(len(code.dictionary), bool), code.indices.to_numpy()
    start, ids = np.cumsum(size) - size, sets.column("id").combine_chunks()
    for key, n, row in (("id", "n", "a"), ("id2", "n2", "b")):  # a key of several sets has several rows
        pairs = pairs.join(pa.table({key: ids, n: size, row: np.arange(len(ids))}), [key, n], join_type="inner")
    a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    # pairs of one row in stretches of about a million words
    words = np.cumsum(size[b]) // 1_000_000
    cut = (np.flatnonzero((a[1:] != a[:-1]) | (words[1:] != words[:-1])) + 1).tolist()
    shared = np.zeros(len(a), np.int64)
    for low, high in zip([0, *cut], [*cut, len(a)], strict=True) if len(a) else ():
        own = code[start[a[low]] : start[a[low]] + size[a[low]]]
        held[own] = True
        other = b[low:high]
        first = np.cumsum(size[other]) - size[other]
        at = np.arange(first[-1] + size[other[-1]]) + np.repeat(start[other] - first, size[other])
        shared[low:high] = np.add.reduceat(held[code[at]].astype(np.int64), first)
        held[own] = False
    similarity = shared / (size[a] + size[b] - shared)
    kept = similarity >= least - 1e-9
    return pa.table({"a": ids.take(pa.array(a[kept])), "b": ids.take(pa.array(b[kept])), "similarity": similarity[kept]})


def confirmed(candidates: DataFrame, sets: DataFrame, places: int, least: float) -> DataFrame:
    """(a, b, similarity) of the candidates (id, n, id2, n2), compared word by word.

    A pair goes to the place of the least neighbour of its first row, so that pairs of
    one cluster meet at one place and a set is sent there once, not once a pair. A place
    of many words or pairs is cut into a grid by both rows. The candidates are found
    once: all that reads them shares their last shuffle.
    """
    kind = dict(sets.dtypes)["id"]
    both = candidates.select("id", "id2").unionByName(candidates.select(F.col("id2").alias("id"), F.col("id").alias("id2")))
    home = both.groupBy("id").agg(F.least(F.min("id2"), F.col("id")).alias("home"))
    pairs = candidates.join(home, "id").withColumn("place", F.pmod(F.xxhash64("home"), F.lit(places))).drop("home")
    ends = F.explode(F.array(F.struct("id", "n"), F.struct(F.col("id2").alias("id"), F.col("n2").alias("n")))).alias("end")
    weight = pairs.select("place", ends).distinct().groupBy("place").agg(F.sum("end.n").alias("words"))
    parts = F.greatest(F.ceil(F.col("words") / GROUP_WORDS), F.ceil(F.sqrt(F.col("pairs") / GROUP_PAIRS)))
    grid = weight.join(pairs.groupBy("place").agg(F.count("*").alias("pairs")), "place").select("place", parts.alias("parts"))
    cell = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    pairs = pairs.join(F.broadcast(grid), "place").select("place", cell("id").alias("i"), cell("id2").alias("j"), "id", "n", "id2", "n2")
    asked = pairs.select(*[F.col(c).alias(f"{c}_of") for c in ("place", "i", "j")], F.explode(F.array("id", "id2")).alias("id")).distinct()
    sent = asked.join(sets, "id").select("place_of", "i_of", "j_of", "id", "words")
    return pairs.groupBy("place", "i", "j").cogroup(sent.groupBy("place_of", "i_of", "j_of")).applyInArrow(lambda p, s: _confirmed(p, s, least), f"a {kind}, b {kind}, similarity double")


def set_classes(sets: DataFrame) -> DataFrame:
    """(words, id) of rows (id, words) of packed sets: each set once, named by its smallest key; rows without words are in none."""
    return materialize(sets.where("words IS NOT NULL").groupBy("words").agg(F.min("id").alias("id")), "set-classes", compression="zstd")


def similar_sets(rows: DataFrame, key: str, least: float = 0.85) -> DataFrame:
    """(a, b, similarity) of distinct sets ``words`` whose Jaccard similarity is ``least`` or more, a < b.

    Rows of equal word sets are one class, named by the smallest key; ``set_members``
    has the others.
    """
    return similar_classes(set_classes(rows.select(F.col(key).alias("id"), packed(F.col("words")).alias("words"))), least)


def set_members(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of each class of equal sets and its other rows; digests of sets meet, not sets."""
    digest = F.unhex(F.sha2("words", 256)).alias("digest")
    named = classes.select(digest, F.col("id").alias("a"))
    return sets.where("words IS NOT NULL").select(digest, F.col("id").alias("b")).join(named, "digest").where("a <> b").select("a", "b")


def similar_classes(classes: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, similarity) of stored classes (id, words) of packed sets.

    A pair of sets can only be similar if they share one of their rarest words: so many
    that fewer than the rest can't reach ``least`` (prefix filter; any order of words will
    do, here by how many classes hold them, counted for the ``FREQUENT`` words of most
    classes). Of a pair that shares such a word at two places, the words from there on
    must suffice (positional filter), and so must all such words with those after the
    rarest of one of both; sketches must not differ in more bits than
    similar sets can in words, and sizes fall into bands of which only neighbours can
    be similar, so that a word of many classes is several keys. All this is told
    before a pair leaves its task; few but similar pairs do, and they are compared
    exactly, where the sets of a cluster are sent once. None of it leaves out a pair.
    """
    hashed = classes.select("id", F.transform(F.split("words", "\n"), lambda w: F.xxhash64(w)).alias("hashes"))
    *counts, words = _word_counts(hashed)
    sent = classes.sparkSession.sparkContext.broadcast(counts)
    sketch = [f"s{i}" for i in range(SKETCH)]
    schema = f"id {dict(classes.dtypes)['id']}, n bigint, band bigint, word bigint, dense boolean, rank bigint, " + ", ".join(f"{c} bigint" for c in sketch)
    prefix = materialize(hashed.mapInArrow(lambda b: _prefixes(b, *sent.value, least), schema), "set-prefixes")
    # at a word of many, a set meets those of its own band and those of the next
    own = prefix.withColumn("met", F.when(F.col("dense"), F.col("band")).otherwise(-1))
    met = F.when(F.col("dense"), F.array(F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(-1).cast("bigint")))
    other = prefix.select(*[F.col(c).alias(f"{c}2") for c in ("id", "n", "band", "rank", *sketch)], "word", F.explode(met).alias("met"))
    # of two in one band the smaller key is first, else the one of the higher band
    once = (F.col("band") == F.col("band2") + 1) & (F.col("id") != F.col("id2")) | (F.col("band") == F.col("band2")) & (F.col("id") < F.col("id2"))
    sizes = (F.col("n2") >= least * F.col("n") - 1e-9) & (F.col("n") >= least * F.col("n2") - 1e-9)
    both = F.col("n") + F.col("n2")
    overlap = F.lit(least / (1 + least)) * both  # words that a similar pair shares
    enough = F.least(F.col("n") - F.col("rank"), F.col("n2") - F.col("rank2")) + F.least("rank", "rank2") >= overlap - 1e-6
    unlike = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in sketch])
    close = unlike <= F.lit((1 - least) / (1 + least)) * both + 1e-6
    found = own.join(other, ["word", "met"]).where(once & sizes & enough & close)
    met = found.where("id IS NOT NULL AND id2 IS NOT NULL").groupBy("id", "n", "id2", "n2").agg(F.count("*").alias("met"))
    after = lambda c: F.ceil(F.lit(least) * F.col(c) - 1e-9) - 1  # noqa: E731  # words of a set after its rarest ones
    candidates = met.where(F.col("met") + F.greatest(after("n"), after("n2")) >= overlap - 1e-6).drop("met")
    alike = confirmed(candidates, classes, max(classes.sparkSession.sparkContext.defaultParallelism, -(-words // GROUP_WORDS)), least)
    return alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def budgets(k: int, weights: dict[str, float]) -> dict[str, int]:
    """How many rows each source may give; halves round up."""
    return {source: math.floor(k * w + 0.5) for source, w in weights.items()}


def refill(kept: DataFrame, all_rows: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Kept rows, and the best others until ``share`` of all rows are there."""
    need = -(-int(all_rows.count() * share * 1000) // 1000) - kept.count()
    rest = all_rows.join(kept.select(key), key, "left_anti").orderBy(F.col("score").desc(), key).limit(max(0, need))
    return kept.unionByName(rest)


def context_score(text: Column, path: Column, kind: Column, entity: Column, score: Column, terms: list[str]) -> Column:
    """0.4 of the score, 0.3 of the share of terms, 0.2 of four signs of quality, 0.1 for rows of a known kind; at most 1."""
    low, where = F.lower(text), F.lower(path)
    share = sum((_flag(low.contains(t) | where.contains(t), 1.0) for t in terms), F.lit(0.0)) / max(len(terms), 1)
    signs = _flag(F.length(text) > 200, 0.3) + _flag(text.contains("function") | text.contains("class"), 0.3) + _flag(text.contains("export") | text.contains("import"), 0.2) + _flag(F.length(entity) > 0, 0.2)
    known = _flag(kind != "generic_code_chunk", 0.1)
    return F.least(F.lit(1.0), 0.4 * F.coalesce(score, F.lit(0.5)) + 0.3 * F.least(share, F.lit(1.0)) + 0.2 * F.least(signs, F.lit(1.0)) + known)


def quality_score(items: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Mean of the context scores and up to 0.2 for their number, between 0.1 and 1."""
    raw = F.avg(score) + F.least(F.count("*") / 10, F.lit(0.2))
    return items.groupBy(group).agg(F.least(F.greatest(raw, F.lit(0.1)), F.lit(1.0)).alias("quality"))


def verdict(items: DataFrame, group: str, score: str = "score") -> DataFrame:
    """0.7 of the mean of scores of 0.5 or more and 0.3 of their share; relevant from 0.4 on."""
    valid = F.col(score) >= 0.5
    sums = items.groupBy(group).agg(F.coalesce(F.avg(F.when(valid, F.col(score))), F.lit(0.0)).alias("mean"), (F.count_if(valid) / F.count("*")).alias("coverage"))
    total = 0.7 * F.col("mean") + 0.3 * F.col("coverage")
    return sums.select(group, total.alias("score"), ((total >= 0.4) & (F.col("coverage") > 0)).alias("relevant"))


def source_coverage(items: DataFrame, group: str, source: str, most: int = 24) -> DataFrame:
    """(group, coverage): distinct sources over the items, of which at most ``most`` count."""
    share = F.countDistinct(source) / F.least(F.count("*"), F.lit(most))
    return items.groupBy(group).agg(share.alias("coverage"))


def pattern_score(path: Column, terms: list[str]) -> Column:
    """10 for each term in the file's name, 5 in the path, 3 for a folder of that name."""
    name, whole = F.lower(basename(path)), F.lower(path)
    flag = lambda test, points: F.when(test, points).otherwise(0)
    parts = [flag(name.contains(t), 10) + flag(whole.contains(t), 5) + flag(whole.contains(f"/{t}/"), 3) for t in map(str.lower, terms)]
    return sum(parts, F.lit(0))


def ranked_patterns(files: DataFrame, path: str, terms: list[str], most: int = 50, sample: int = 30) -> DataFrame:
    """(path, score) of the ``most`` files of the highest scores over 0; without any, the first ``sample`` files by path."""
    scored = files.select(F.col(path), pattern_score(F.col(path), terms).alias("score"))
    hits = scored.where("score > 0").orderBy(F.col("score").desc(), path).limit(most)
    return scored.orderBy(path).limit(sample) if not terms or hits.isEmpty() else hits


def retrieve_chunks(by_model: dict[str, DataFrame], chunks: DataFrame, k: int, query: str) -> DataFrame:
    """The ``k`` best chunks of each query over one nearest-neighbour list a model.

    A list has query, id, similarity and parent_id. The lists are united, a chunk keeps
    its best similarity, parents join at 0.9, and ties go by id.
    """
    every = None
    for model, hits in by_model.items():
        part = hits.select(query, "id", "similarity", "parent_id", F.lit(model).alias("model"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(query, "id").agg(F.max_by(F.struct("similarity", "parent_id", "model"), F.struct("similarity", "model")).alias("r")).select(query, "id", "r.*")
    with_models = chunks.withColumn("model", F.lit("parent")).select("id", "similarity", "parent_id", "model")
    return top_per_query(with_parents(best, with_models, query), query, [F.col("similarity").desc(), F.col("id")], k)


def citation_metrics(answers: DataFrame, sources: DataFrame, key: str, text: str) -> DataFrame:
    """Accuracy, coverage and quality of ``[cite_n]`` marks; ``sources`` has key and n."""
    used = answers.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\[cite_(\d+)\]"), 1)).alias("n")).withColumn("n", F.col("n").cast("int"))
    counts = used.groupBy(key).agg(F.count("*").alias("used"))
    valid = used.distinct().join(sources.select(key, "n").distinct(), [key, "n"]).groupBy(key).agg(F.count("*").alias("valid"))
    there = sources.groupBy(key).agg(F.countDistinct("n").alias("available"))
    all_of = answers.select(key).join(counts, key, "left").join(valid, key, "left").join(there, key, "left").na.fill(0)
    accuracy = F.when(F.col("used") > 0, F.col("valid") / F.col("used")).otherwise(F.when(F.col("available") > 0, 0.0).otherwise(1.0))
    coverage = F.when(F.col("available") > 0, F.col("valid") / F.col("available")).otherwise(1.0)
    return all_of.select(key, accuracy.alias("accuracy"), coverage.alias("coverage"), (0.6 * accuracy + 0.4 * coverage).alias("quality"))


def path_score(path: Column, terms: list[str]) -> Column:
    """200 for the file's name, 50 for a term in the name, 25 in the path, 5 for code."""
    name, whole = F.lower(basename(path)), F.lower(path)
    score = F.when(F.lower(stem_of_file(path)).isin(*terms), 200).otherwise(0)
    for t in terms:
        score = score + F.when(name.contains(t), 50).when(whole.contains(t), 25).otherwise(0)
    return score + F.when(name.rlike(r"\.(ts|js|py|java|go|rs)$"), 5).otherwise(0)


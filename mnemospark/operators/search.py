"""Fuzzy search, corrections and entity resolution over posting tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.strings import chars, index_text, index_tokens, jaccard, let, ngrams, similarity
from mnemospark.functions.vectors import cosine
from mnemospark.operators import postings
from mnemospark.session import dealt, materialize


def index_source(nodes: DataFrame) -> Column:
    """The text of a node that is searched."""
    return F.concat_ws(" ", "name", "entity_type", F.array_join(F.coalesce("observations", F.array().cast("array<string>")), " "))


def fuzzy_search(nodes: DataFrame, query: str, threshold: float = 0.3) -> DataFrame:
    """(id, score): tokens, bigrams and trigrams of the query against each node's.

    An exact token counts 1, and every token in a containment relation with
    similarity s over 0.5 counts 0.8 s (an exact one, 1.8 in all); a query bigram
    0.3, a trigram 0.4. 0.7 of the normed sum and 0.3 of the similarity to the
    name make the score. The query is one literal row, so this is one pass over
    the nodes without a join or shuffle.
    """
    text = F.lit(query)
    q_tokens, q2, q3 = index_tokens(text), ngrams(text, 2), ngrams(text, 3)
    source = index_source(nodes)

    def token_score(own: Column, t: Column) -> Column:
        near = F.filter(own, lambda o: (o.contains(t) | t.contains(o)) & (similarity(o, t) > 0.5))
        return F.when(F.array_contains(own, t), 1.0).otherwise(0.0) + F.aggregate(near, F.lit(0.0), lambda s, o: s + 0.8 * similarity(o, t))

    def shared(grams: Column, have: Column) -> Column:
        return let(F.array_distinct(have), lambda h: F.size(F.filter(grams, lambda g: F.array_contains(h, g))))

    words = let(F.array_distinct(index_tokens(source)), lambda own: F.aggregate(q_tokens, F.lit(0.0), lambda s, t: s + token_score(own, t)))
    raw = words + 0.3 * shared(q2, ngrams(source, 2)) + 0.4 * shared(q3, ngrams(source, 3))
    most = F.size(q_tokens) + 0.3 * F.size(q2) + 0.4 * F.size(q3)
    score = 0.7 * raw / most + 0.3 * let(index_text("name"), lambda name: similarity(index_text(text), name))
    # a generator, as a filter would be pushed below the projection and compute the score again
    kept = let(score, lambda s: F.when(s >= threshold, F.array(s)).otherwise(F.array().cast("array<double>")))
    return nodes.select("id", F.explode(kept).alias("score"))


def _grams(text: Column, n: int, kind: str) -> Column:
    return F.transform(ngrams(text, n), lambda g: F.concat(F.lit(kind), g))


def _pieces(token: Column) -> Column:
    """Substrings of more than half a token's length, itself included: what it can contain at a similarity over 0.5."""
    n = F.length(token)
    sizes = F.sequence(F.floor(n / 2).cast("int") + 1, n)
    return F.array_distinct(F.flatten(F.transform(sizes, lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substring(token, i, w)))))


def fuzzy_search_many(nodes: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.3, rare: int = 3, block_rows: int = 8192) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best nodes of each query (query_id, text), as ``fuzzy_search`` scores them, from posting lists.

    A node's features are its tokens, bigrams and trigrams; nodes of equal texts are one
    class, of which the ``k`` smallest ids are enough, and queries of equal index texts one
    wish. A wish weighs a token by all its own tokens that contain it or that it
    contains, which are found as pieces of either, and grams by how often it has them;
    the weights that a class has of a wish make its score, but for the name's 0.3 at most.

    1. The classes in the lists of a wish's ``rare`` rarest features are weighed, and the
       k-th best of these, or ``threshold``, is what others must reach.
    2. Of its lists, the longest whose weights together stay below that are not read
       at all: what is in none of the others can't reach it. The others are, and their
       classes weighed. Names are compared where the weight alone could be enough.

    Nothing else is left out. Wishes are broadcast in blocks and read the posting lists
    of a chunk of classes in tasks; a wish whose features are all common reads long
    lists, as its candidates are many. Empty queries find nothing.
    """
    named = nodes.where(F.col("name").isNotNull())
    texts = named.select("id", "name", index_source(named).alias("source"))
    few = top_per_query(texts, ["source", "name"], [F.col("id")], k).groupBy("source", "name").agg(F.min("id").alias("class"), F.collect_list("id").alias("keys"))
    grouped = dealt(materialize(few, "search-groups"))
    features = F.array_distinct(F.concat(F.transform(index_tokens("source"), lambda t: F.concat(F.lit("t"), t)), _grams(F.col("source"), 2, "2"), _grams(F.col("source"), 3, "3")))
    classes = materialize(grouped.select("class", "keys", index_text("name").alias("called"), features.alias("features")), "search-classes")
    lengths = materialize(classes.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("df")), "search-lists")
    asked = materialize(queries.where(F.size(index_tokens("text")) > 0).select("query_id", index_text("text").alias("wish")), "search-queries")
    wishes = materialize(asked.select("wish").distinct(), "search-wishes")
    words = wishes.select("wish", F.explode(index_tokens("wish")).alias("t"))
    vocabulary = lengths.where("feature LIKE 't%'").select(F.expr("substr(feature, 2)").alias("token"))
    inside = words.select("wish", "t", F.explode(_pieces(F.col("t"))).alias("token")).join(vocabulary, "token")
    around = vocabulary.select("token", F.explode(_pieces(F.col("token"))).alias("t")).where("t <> token").join(words, "t").select("wish", "t", "token")
    near = inside.select("wish", "t", "token").unionByName(around)
    weight = F.when(F.col("t") == F.col("token"), 1.8).otherwise(0.8 * similarity("t", "token"))
    kinds = [wishes.select("wish", F.explode(_grams(F.col("wish"), n, str(n))).alias("feature"), F.lit(w).alias("w")) for n, w in ((2, 0.3), (3, 0.4))]
    weights = near.select("wish", F.concat(F.lit("t"), "token").alias("feature"), weight.alias("w")).unionByName(kinds[0]).unionByName(kinds[1])
    weights = weights.groupBy("wish", "feature").agg(F.sum("w").alias("w")).join(lengths, "feature")
    order = Window.partitionBy("wish").orderBy("df", "feature")  # a wish's own features
    most = F.size(index_tokens("wish")) + 0.3 * F.size(ngrams("wish", 2)) + 0.4 * F.size(ngrams("wish", 3))
    weights = weights.withColumns({"place": F.row_number().over(order), "later": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    weights = materialize(weights.join(wishes.select("wish", most.alias("most")), "wish"), "search-weights")
    kinds = dict(classes.dtypes)
    found_as = f"wish string, raw double, class {kinds['class']}, keys {kinds['keys']}, called string"

    def scored(lists: DataFrame, best: int | None) -> DataFrame:
        """Classes in the lists that are ``read``, of enough weight, with their scores."""
        sent = nodes.sparkSession.sparkContext.broadcast(postings.Wishes(lists.select("wish", "place", "feature", "w", "read", "least").toArrow()))
        met = classes.mapInArrow(lambda b: postings.matches(b, sent.value, best), found_as)
        score = 0.7 * F.col("raw") / F.col("most") + 0.3 * similarity("wish", "called")
        own = lists.select("wish", "most").distinct()
        return met.join(F.broadcast(own), "wish").select("wish", "class", "keys", score.alias("score")).where(F.col("score") >= threshold)

    out = None
    ranked = [F.round("score", 9).desc(), F.col("class")]
    for block in in_blocks(wishes, block_rows):
        own = weights.join(F.broadcast(block), "wish")
        first = own.withColumns({"read": F.col("place") <= rare, "least": F.lit(0.0)})
        seeds = materialize(top_per_query(scored(first, 2 * k), "wish", ranked, k), "search-seeds")
        better = Window.partitionBy("wish").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # k rows a wish
        reached = seeds.withColumn("so_far", F.sum(F.size("keys")).over(better)).where(F.col("so_far") >= k).groupBy("wish").agg(F.max("score").alias("kth"))
        needed = own.join(reached, "wish", "left").withColumn("needed", F.greatest(F.coalesce("kth", F.lit(threshold)), F.lit(threshold)) - 1e-8)
        # lists from a place on can be passed over if all their weights, and an equal name, stay below what is needed
        second = needed.withColumns({"read": 0.7 * F.col("later") / F.col("most") + 0.3 >= F.col("needed"), "least": (F.col("needed") - 0.3) * F.col("most") / 0.7})
        best = materialize(top_per_query(scored(second, None), "wish", ranked, k).drop("rank"), "search-best")
        out = best if out is None else out.unionByName(best)
    best = top_per_query(out.select("wish", "score", F.explode("keys").alias("id")), "wish", [F.round("score", 9).desc(), F.col("id")], k)
    return asked.join(best, "wish").select("query_id", "id", "score", "rank")


def corrections(nodes: DataFrame, word: str, low: float = 0.6, top: int = 3) -> DataFrame:
    """The tokens of the index nearest to a word, equal ones excepted."""
    vocabulary = nodes.select(F.explode(index_tokens(index_source(nodes))).alias("token")).distinct()
    score = similarity(F.col("token"), F.lit(word.lower()))
    return vocabulary.select("token", score.alias("score")).where((F.col("score") > low) & (F.col("score") < 1)).orderBy(F.col("score").desc(), "token").limit(top)


def index_statistics(nodes: DataFrame) -> DataFrame:
    """One row: nodes, and the distinct tokens, bigrams and trigrams of their texts."""
    source = index_source(nodes)
    every = lambda kind, items: nodes.select(F.lit(kind).alias("kind"), F.explode(items).alias("item"))
    parts = every("tokens", index_tokens(source)).unionByName(every("bigrams", ngrams(source, 2))).unionByName(every("trigrams", ngrams(source, 3)))
    counts = parts.distinct().groupBy("kind").count()
    total = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), F.col("n").alias("count"))
    pick = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0)).alias(kind)
    return counts.unionByName(total).agg(*[pick(k) for k in ("nodes", "tokens", "bigrams", "trigrams")])


def in_blocks(queries: DataFrame, rows: int = 2000) -> list[DataFrame]:
    """A query set in blocks small enough to broadcast, by the hash of its whole row."""
    count = queries.count()
    blocks = max(1, -(-count // rows))
    block = F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))
    return [queries] if blocks == 1 else [queries.where(block == b) for b in range(blocks)]


#: Blocks of queries that one plan holds.
MOST_BLOCKS = 16


def against_all(queries: DataFrame, rows: DataFrame, match: Column, block_rows: int = 2000) -> DataFrame:
    """A query set against all rows under a condition; each block of queries is broadcast.

    A plan holds ``MOST_BLOCKS`` blocks; with more, each plan's matches are stored first.
    """
    blocks = in_blocks(queries, block_rows)
    out = None
    for low in range(0, len(blocks), MOST_BLOCKS):
        matches = None
        for block in blocks[low : low + MOST_BLOCKS]:
            part = rows.join(F.broadcast(block), match)
            matches = part if matches is None else matches.unionByName(part)
        matches = matches if len(blocks) <= MOST_BLOCKS else materialize(matches, "matches")
        out = matches if out is None else out.unionByName(matches)
    return out


def top_per_query(pairs: DataFrame, query: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The best ``k`` rows of each query; Spark limits each task's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*([query] if isinstance(query, str) else query)).orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def best_of_classes(queries: DataFrame, rows: DataFrame, asked: list[str], parts: list[str], score: Callable[[DataFrame, DataFrame], DataFrame], query: str = "query_id", key: str = "id") -> DataFrame:
    """(query, key, score): the best other row of each query, ties by key, where a score depends on ``asked`` and ``parts`` alone.

    Queries that agree in ``asked`` are one wish, rows that agree in ``parts`` one class,
    of which the two smallest keys are enough, as a query takes out its own key only.
    ``score`` gives wishes and classes the column ``score``, as one table; pairs that
    it leaves out are no answers. The work follows the distinct wishes and classes.
    """
    wishes = materialize(queries.select(*asked).distinct(), "wishes")
    two = top_per_query(rows.where(F.col(key).isNotNull()).select(*parts, key).distinct(), parts, [F.col(key)], 2)
    classes = materialize(two.groupBy(*parts).agg(F.collect_list(key).alias("keys")), "wish-classes")
    best = top_per_query(score(wishes, dealt(classes)).select(*asked, "score", F.explode("keys").alias(key)), asked, [F.col("score").desc(), F.col(key)], 2)
    best = materialize(best.select(*[F.col(c).alias(f"_{c}") for c in asked], "score", key), "wish-best")
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asked])
    met = queries.select(query, *asked).join(best, same).where(F.col(query) != F.col(key))
    return top_per_query(met, query, [F.col("score").desc(), F.col(key)], 1).select(query, key, "score")


def name_links(queries: DataFrame, rows: DataFrame, asked: str, name: str, least: float, block_rows: int = 2000) -> DataFrame:
    """Queries with rows whose names are ``least`` alike, and their ``score``: distinct names are compared, then queries and rows of those names meet.

    Queries are broadcast in blocks with the names that they mean, so a common name
    stays dealt over the tasks of its rows.
    """
    wanted = materialize(queries.select(asked).where(F.length(asked) > 0).distinct(), "asked-names")
    names = materialize(rows.select(F.col(name).alias("_name")).where(F.length("_name") > 0).distinct(), "all-names")
    alike = similarity(F.col(asked), F.col("_name"))
    pairs = materialize(against_all(wanted, dealt(names), alike >= least).select(F.col(asked).alias("_asked"), "_name", alike.alias("score")), "name-links")
    meant = materialize(queries.join(pairs, F.col(asked) == F.col("_asked")).drop("_asked"), "meant-names")
    return against_all(meant, dealt(rows), F.col(name) == F.col("_name"), block_rows).drop("_name")


def most_edits(length: int, least: float) -> int:
    """The largest distance at which the longer text, of ``length``, is still ``least`` alike."""
    edits = int((1 - least) * length) + 1
    while 1 - edits / length < least:
        edits -= 1
    return edits


def pieces(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and width of ``edits`` + 1 even pieces of a text."""
    n = edits + 1
    starts = [i * length // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(starts, starts[1:], strict=False)]


def similar_names(rows: DataFrame, key: str, name: str, least: float = 0.7) -> DataFrame:
    """(kind, a, b, score): rows of equal names as members of a class, and pairs of classes whose names are alike.

    Rows of one name are a class, named by its smallest key: ``member`` rows link it
    to its other keys, ``similar`` rows link two classes, a < b. Two rows are alike if
    they are of one class or their classes are linked; no link is left out. Where
    ``e`` edits are allowed, one of ``e`` + 1 pieces of the shorter name is whole in
    the longer one, moved by ``e`` places at most; classes join on such pieces and
    then on the exact score. Empty and null names resemble nothing.
    """
    named = rows.select(F.col(key).alias("id"), F.col(name).alias("name")).where(F.length("name") > 0)
    classes = named.groupBy("name").agg(F.min("id").alias("a"))
    members = named.join(classes, "name").where("id <> a").select(F.lit("member").alias("kind"), "a", F.col("id").alias("b"), F.lit(1.0).alias("score")).distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, text in zip(batch["a"], batch["name"], strict=True):
                longest, allowed = len(text), set()
                while longest - most_edits(longest, least) <= len(text):
                    allowed.add(most_edits(longest, least))
                    longest += 1
                for e in allowed:
                    out += [(a, len(text), e, i, text[p : p + w]) for i, (p, w) in enumerate(pieces(len(text), e))]
            yield pd.DataFrame(out, columns=["a", "n", "e", "i", "piece"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = set()
            for b, text in zip(batch["a"], batch["name"], strict=True):
                e = most_edits(len(text), least)
                for n in range(max(1, len(text) - e), len(text) + 1):
                    for i, (p, w) in enumerate(pieces(n, e)):
                        out.update((b, n, e, i, text[at : at + w]) for at in range(max(0, p - e), min(len(text) - w, p + e) + 1))
            yield pd.DataFrame(list(out), columns=["b", "n", "e", "i", "piece"])

    place = "n int, e int, i int, piece string"
    have = classes.select("a", "name").mapInPandas(cut, f"a bigint, {place}")
    seek = classes.select("a", "name").mapInPandas(look, f"b bigint, {place}")
    met = have.join(seek, ["n", "e", "i", "piece"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = met.join(classes, "a").join(classes.select(F.col("a").alias("b"), F.col("name").alias("name2")), "b")
    scored = pairs.select(F.lit("similar").alias("kind"), "a", "b", similarity("name", "name2").alias("score"))
    return members.unionByName(scored.where(F.col("score") >= least))


def resolution_score(name: Column, wanted: Column, kind: Column, wanted_kind: Column, popular: Column, deprecated: Column, notes: Column | None = None, clues: Column | None = None) -> Column:
    """How well a node answers a mention.

    100 for the same name, else at most 45 from string similarity, less for short
    names; 30 for the same type; 5 for each clue in the notes, at most 25; 20 for
    popular nodes, less 30 for deprecated ones; 10 for partial matches of a low score.
    """
    a, b = F.lower(name), F.lower(wanted)
    shorter = F.least(F.length(a), F.length(b))
    penalty = F.when(shorter < 3, 0.4).when(shorter < 5, 0.7).otherwise(1.0)
    alike = 0.7 * similarity(a, b) + 0.3 * jaccard(chars(a), chars(b)) + F.when(a.startswith(b), 0.2).otherwise(0.0)
    flag = lambda test, points: F.when(F.coalesce(test, F.lit(False)), F.lit(float(points))).otherwise(0.0)
    score = F.when(a == b, F.lit(100.0)).otherwise(45 * F.least(F.lit(1.0), alike * penalty)) + flag(F.lower(kind) == F.lower(wanted_kind), 30)
    if clues is not None:
        text = F.lower(F.array_join(F.coalesce(notes, F.array().cast("array<string>")), " "))
        score = score + F.least(F.lit(25), 5 * F.size(F.filter(F.array_distinct(clues), lambda c: text.contains(c))))
    score = score + flag(popular, 20) - flag(deprecated, 30)
    return let(score, lambda s: s + F.when((a != b) & (a.contains(b) | b.contains(a)) & (s < 40), 10.0).otherwise(0.0))


# Kinds below a kind.
KINDS_BELOW = {
    "class": ("interface", "struct", "enum", "type"),
    "function": ("method", "procedure", "lambda", "callback"),
    "module": ("package", "namespace", "library", "component"),
    "file": ("document", "asset", "resource"),
}


def name_points(names: Column, wanted: Column) -> Column:
    """(points, shared): the part of ``resolution_points`` that follows from names, and whether the first shares a trigram with the mention."""
    low, own = F.lower(wanted), F.transform(names, lambda n: F.lower(n))
    best = lambda fn: F.array_max(F.transform(own, fn))
    shorter = F.least(F.length(low), F.array_min(F.transform(own, lambda n: F.length(n))))
    penalty = F.when(shorter < 3, 0.4).when(shorter < 5, 0.7).otherwise(1.0)
    start = F.when(F.exists(own, lambda n: n.startswith(low)), 0.2).otherwise(0.0)
    fuzzy = (0.7 * best(lambda n: similarity(n, low)) + 0.3 * best(lambda n: jaccard(chars(n), chars(low))) + start) * penalty
    points = F.when(F.array_contains(own, low), 100.0).otherwise(45 * F.least(F.lit(1.0), fuzzy))
    grams = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    shared = (F.length(low) >= 3) & F.exists(grams, lambda g: F.get(own, F.lit(0)).contains(g))
    return F.struct(points.alias("points"), shared.alias("shared"))


def resolution_points(
    names: Column, wanted: Column, kind: Column, wanted_kind: Column, notes: Column, clues: Column, alike: Column, popular: Column, deprecated: Column, named: Column | None = None
) -> Column:
    """How well a node of several names answers a mention, by all its parts.

    100 if a name is the mention, else at most 45 from the best string similarities,
    less for short names; 30 for the kind, 15 if the wanted kind is below it, 10 if
    above; 5 for each distinct clue in the notes, at most 25; 50 times ``alike``, a
    cosine; 20 for popular nodes, less 30 for deprecated ones; 10 if the first name
    shares a trigram with the mention and there are under 40 points. ``names`` begins
    with the name, aliases follow. ``named`` is ``name_points`` where it is at hand.
    """
    named = name_points(names, wanted) if named is None else named
    flag = lambda test, points: F.when(F.coalesce(test, F.lit(False)), F.lit(float(points))).otherwise(0.0)
    have, want = F.lower(kind), F.lower(wanted_kind)
    below = lambda upper, lower: F.coalesce(F.array_contains(looked_up_kinds(upper), lower), F.lit(False))
    kinds = F.when(have == want, 30.0).when(below(have, want), 15.0).when(below(want, have), 10.0).otherwise(0.0)
    text = F.lower(F.array_join(F.coalesce(notes, F.array().cast("array<string>")), " "))
    met = F.least(F.lit(25), 5 * F.size(F.filter(F.array_distinct(clues), lambda c: text.contains(c))))
    score = named["points"] + kinds + met + 50 * F.coalesce(alike, F.lit(0.0)) + flag(popular, 20) - flag(deprecated, 30)
    return let(score, lambda s: s + F.when(named["shared"] & (s < 40), 10.0).otherwise(0.0))


def looked_up_kinds(kind: Column) -> Column:
    """The kinds below a kind, null if it has none."""
    out = F.lit(None).cast("array<string>")
    for upper, lower in KINDS_BELOW.items():
        out = F.when(kind == upper, F.array(*[F.lit(k) for k in lower])).otherwise(out)
    return out


def hybrid_similarity(va: Column, vb: Column, name_a: Column, name_b: Column, kind_a: Column, kind_b: Column, obs_a: Column, obs_b: Column) -> Column:
    """Mean of cosine (.4), name (.25), observations (.2) and, only where equal, type (.15), over the weights in use."""
    both = va.isNotNull() & vb.isNotNull()
    low_a, low_b = F.transform(obs_a, lambda o: F.lower(o)), F.transform(obs_b, lambda o: F.lower(o))
    has_obs = (F.size(obs_a) > 0) | (F.size(obs_b) > 0)
    same = kind_a == kind_b
    total = F.when(both, 0.4 * cosine(va, vb)).otherwise(0.0) + 0.25 * similarity(name_a, name_b) + F.when(same, 0.15).otherwise(0.0) + F.when(has_obs, 0.2 * jaccard(low_a, low_b)).otherwise(0.0)
    weight = F.when(both, 0.4).otherwise(0.0) + 0.25 + F.when(same, 0.15).otherwise(0.0) + F.when(has_obs, 0.2).otherwise(0.0)
    return total / weight


def merged_parts(rows: DataFrame, key: str) -> DataFrame:
    """(key, part, value): each alias and each observation of an entity once, a row each, however many a key has."""
    names = rows.where(F.col("name").isNotNull()).select(key, F.lit("alias").alias("part"), F.col("name").alias("value"))
    return names.unionByName(rows.select(key, F.lit("note").alias("part"), F.explode("observations").alias("value"))).distinct()


def merge_entities(rows: DataFrame, key: str, arrays: bool = True) -> DataFrame:
    """One entity a key: the richest row's name, all aliases and observations, the usual type, the mean vector.

    Without ``arrays`` aliases and observations are counted, not gathered; ``merged_parts`` has them as rows.
    """
    plain = rows.groupBy(key).agg(F.max_by("name", F.struct(F.size("observations"), "name")).alias("name"), F.mode("entity_type", True).alias("entity_type"))
    parts = merged_parts(rows, key)
    if arrays:
        own = lambda part: F.sort_array(F.collect_list(F.when(F.col("part") == part, F.col("value"))))
        none = F.array().cast("array<string>")
    else:
        own = lambda part: F.count_if(F.col("part") == part)
        none = F.lit(0).cast("long")
    told = parts.groupBy(key).agg(own("alias").alias("aliases"), own("note").alias("observations"))
    mean = rows.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    vector = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    made = plain.join(told, key, "left").join(vector, key, "left").withColumns({c: F.coalesce(c, none) for c in ("aliases", "observations")})
    return made.select(key, "name", "aliases", "observations", "entity_type", "embedding")

"""Context lists, plans and files: smaller rules on rows, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.strings import basename, shorten, similarity
from mnemospark.operators.retrieval import packed, similar_classes, word_set
from mnemospark.session import materialize


def index_search(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose key is the text; if there are none, those whose key holds it (case counts)."""
    exact = rows.where(F.col(key) == text)
    return rows.where(F.col(key).contains(text)) if exact.isEmpty() else exact


def path_is_relevant(path: Column, prompt: str) -> Column:
    """Whether a part of the path, longer than two characters, stands in the prompt."""
    low = F.lit(prompt.lower())
    return F.exists(F.split(F.lower(path), r"[/\\.]"), lambda p: (F.length(p) > 2) & low.contains(p))


# Patterns of definitions, and of texts that only mention something.
DEFINITIONS = (
    r"class\s+\w+", r"function\s+\w+", r"export\s+(class|function|const|interface)", r"constructor\s*\(", r"async\s+\w+\s*\(", r"private|public|protected\s+\w+",
)
MENTIONS = (
    r"will\s+(use|implement|work\s+on|need)", r"todo|fixme|note:", r"import.*from", r"see\s+also|refer\s+to|check\s+out", r"in\s+our\s+plan|we\s+will|should\s+use", r"\brelevant\s+files?\b",
)
# Shares of the sources (vectors, graph, documents, logs) by intent.
SOURCE_SHARES = {
    "debug_error": (1.0, 0.6, 0.4, 1.0),
    "refactor_code": (0.9, 1.0, 0.5, 0.2),
    "add_feature": (0.8, 0.9, 0.7, 0.3),
    "understand_code": (0.7, 1.0, 0.8, 0.1),
    "find_example": (1.0, 0.5, 0.6, 0.1),
    "general_query": (1.0, 0.7, 0.9, 0.2),
}


def source_content(path: Column, text: Column, terms: list[str]) -> Column:
    """Whether a row is a file that was asked for and defines something."""
    wanted = [F.lower(path).contains("_".join(t.lower().split())) for t in terms]
    defines = [text.rlike(p) for p in DEFINITIONS]
    return (F.greatest(*wanted) if len(wanted) > 1 else wanted[0]) & F.greatest(*defines) if wanted else F.lit(False)


def mere_mention(text: Column, terms: list[str]) -> Column:
    """Whether a text plans, refers or is a short mention of a term."""
    low = F.lower(text)
    short = [low.contains(t.lower()) & (F.length(text) < 200) for t in terms]
    return F.greatest(*[low.rlike(p) for p in MENTIONS], *short)


def source_limits(intent: str, vectors: int = 15, graph: int = 10) -> tuple[int, int]:
    """How many rows the vector and the graph source give for an intent."""
    share = SOURCE_SHARES.get(intent, SOURCE_SHARES["general_query"])
    half_up = lambda x: int(x + 0.5)
    return half_up(vectors * share[0]), half_up(graph * share[1])


def expand_terms(names: DataFrame, prompt: str, name: str = "name", most: int = 20) -> DataFrame:
    """Names that a prompt may mean: equal to a word, holding one, or similar to one or to all of it.

    The similar ones are at most ``most``, the first by name.
    """
    words = [w for w in prompt.lower().split() if len(w) > 2]
    bare = ["".join(c for c in w if c.isalnum() or c == "_") for w in words if len(w) > 3]
    low = F.lower(F.col(name))
    exact = names.where(F.col(name).isin(*bare)).select(name) if bare else names.select(name).limit(0)
    held = names.where(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))).select(name) if words else names.select(name).limit(0)
    near = (similarity(low, F.lit(prompt.lower())) > 0.6) | F.exists(F.array(*[F.lit(w) for w in words or [""]]), lambda w: similarity(w, low) > 0.7)
    return exact.union(held).union(names.where(near).select(name).distinct().orderBy(name).limit(most)).distinct()


def graph_prompt(nodes: DataFrame, edges: DataFrame, most: int = 200, longest: int = 150_000) -> DataFrame:
    """One row ``text``: the first ``most`` nodes (three notes of 70 characters each) and edges as JSON, by id.

    If that is longer than ``longest`` characters, the text gives the fields and the counts instead.
    """
    notes = F.transform(F.slice(F.coalesce("observations", F.array().cast("array<string>")), 1, 3), lambda o: shorten(o, 70))
    some = nodes.select("id", "name", "entity_type", notes.alias("observations")).orderBy("id").limit(most)
    ends = edges.select("src", "dst", "kind").orderBy("src", "dst", "kind").limit(most)
    row = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("x")).select(F.lit(1).alias("one"), "x")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(1).alias("one"), "n") for df in (nodes, edges)]
    both = row(some).withColumnRenamed("x", "nodes").join(row(ends).withColumnRenamed("x", "relations"), "one")
    both = both.join(counts[0].withColumnRenamed("n", "n_nodes"), "one").join(counts[1].withColumnRenamed("n", "n_edges"), "one")
    whole = F.to_json(F.struct("nodes", "relations"))
    short = F.concat(F.lit("nodes: id, name, entity_type, observations; relations: src, dst, kind; total nodes: "), F.col("n_nodes").cast("string"), F.lit(", total relations: "), F.col("n_edges").cast("string"))
    return both.select(F.when(F.length(whole) > longest, short).otherwise(whole).alias("text"))


def snippet(items: Column, index: int) -> Column:
    """One element of an array, null out of range."""
    return F.get(items, F.lit(index))


# Stop words of a question.
STOP_WORDS = (
    "how", "what", "when", "where", "why", "who", "which", "does", "do", "is", "are", "the", "a", "an", "and", "or", "but", "in", "on", "at", "to",
    "for", "of", "with", "by", "from",
)


def content_words(text: Column, most: int = 10) -> Column:
    """The first words that are no stop words."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.slice(words, 1, most)


def term_rank(term: Column, text: str) -> Column:
    """100 for a term in the text, 50 more for its case, its length, 20 for Pascal case."""
    low = F.lit(text.lower())
    return (
        F.when(low.contains(F.lower(term)), 100).otherwise(0)
        + F.when(F.lit(text).contains(term), 50).otherwise(0)
        + F.length(term)
        + F.when(term.rlike(r"^[A-Z][a-zA-Z0-9]*$"), 20).otherwise(0)
    )


# Weights of entity kinds and keywords of change kinds.
IMPORTANCE = {
    "class": 10, "interface": 9, "function": 8, "method": 7, "enum": 6, "type_alias": 5, "variable": 4, "property": 3, "parameter_property": 2,
}
CHANGES = {
    "simple_refactor": ("refactor", "clean", "improve", "optimize", "simplify"),
    "code_standardization": ("standardize", "format", "consistent", "convention", "style"),
    "modularization": ("modularize", "extract", "separate", "split", "organize"),
    "feature_addition": ("add", "implement", "create", "build", "new feature"),
    "bug_fix": ("fix", "bug", "error", "issue", "problem"),
    "major_restructure": ("restructure", "redesign", "architecture", "overhaul"),
}


def importance(kind: Column, exported: Column, public: Column, is_async: Column, documented: Column) -> Column:
    """At most 1: a kind's weight with points for export, access, async and a comment, over 20."""
    weight = F.lit(1)
    for name, points in IMPORTANCE.items():
        weight = F.when(kind == name, points).otherwise(weight)
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return F.least((weight + flag(exported, 3) + flag(public, 2) + flag(is_async, 1) + flag(documented, 2)) / 20.0, F.lit(1.0))


def change_kind(text: Column) -> Column:
    """The kind with most keywords; the first of equals, simple_refactor if none."""
    low, best, name = F.lower(text), F.lit(0), F.lit("simple_refactor")
    for kind, words in CHANGES.items():
        score = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
        name = F.when(score > best, kind).otherwise(name)
        best = F.greatest(best, score)
    return name


def plan_complexity(tasks: Column, entities: Column, constraints: Column, files: Column) -> Column:
    """Of counts, and of the files' complexities (1, 2 or 3 each) added up."""
    score = tasks + 0.5 * entities + constraints + 0.3 * files
    return F.when(score <= 4, "simple_plan").when(score <= 8, "moderate_plan").otherwise("complex_plan")


def total_complexity(mean_file: Column, change: Column) -> Column:
    """Of the files' mean complexity (1 to 3) and the kind of change."""
    goal = F.when(change == "major_restructure", 3.0).when(change == "modularization", 2.5).when(change == "feature_addition", 2.0).otherwise(1.0)
    total = (mean_file + goal) / 2
    return F.when(total < 1.5, "simple").when(total < 2.5, "moderate").otherwise("complex")


def change_category(path: Column) -> Column:
    """tests, docs, config, types, dotfiles, else the first two folders."""
    parts, name = F.split(path, "/"), F.lower(basename(path))
    return (
        F.when(F.lower(path).rlike(r"test|spec"), "tests")
        .when(name.rlike(r"\.(md|markdown|txt|rst|doc|docx)$"), "docs")
        .when(name.rlike(r"\.(json|yml|yaml|toml|ini|env|rc)$") | F.exists(parts, lambda p: p.startswith(".github") | p.isin(".vscode", "config")), "config")
        .when(name.endswith(".d.ts"), "types")
        .when(name.startswith("."), "dotfiles")
        .otherwise(F.array_join(F.slice(parts, 1, 2), "/"))
    )


def severity_mentions(text: Column) -> tuple[Column, Column, Column]:
    """How often a text names high, medium and low issues, at most 10, 20 and 30."""
    count = lambda words, most: F.least(F.regexp_count(text, F.lit(f"(?i){words}")), F.lit(most))
    return count("high|critical|blocker", 10), count("medium|major", 20), count("low|minor|info", 30)


def first_of_titles(rows: DataFrame, title: str, order: str) -> DataFrame:
    """Rows with a title, the first of those equal but for case and blanks."""
    name = F.trim(F.lower(F.col(title)))
    rank = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.where(F.coalesce(name, F.lit("")) != "").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merged_with_provenance(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """One row a key with the sorted names of the lists it came from."""
    return rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), F.count("*").alias("hits"))


def without_notes(notes: Column, gone: list[str]) -> Column:
    """An array without some texts, whatever their case."""
    low = [g.lower() for g in gone]
    return F.filter(notes, lambda o: ~F.lower(o).isin(*low))


def folder_edges(files: DataFrame, path: str = "path") -> DataFrame:
    """(src, dst, kind) of folders and what they contain, each once."""
    parts = F.split(F.col(path), "/")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("src"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("dst")),
    )
    deep = files.where(F.col(path).contains("/")).select(F.explode(steps).alias("e"))
    return deep.select("e.src", "e.dst", F.lit("contains_item").alias("kind")).distinct()


def context_flow(rows: DataFrame, recent: int = 10, keep: float = 0.8, old: int = 5) -> DataFrame:
    """The newest rows by score and kind, then older ones, each path and entity once.

    ``rows`` has path, entity, score, kind_rank and pos. Of more than ten older rows
    those of a high score stay, the first ``old``. Scores are compared by tenths, so
    that the order is total; a key stands at its first place with its last values.
    """
    newest = rows.orderBy(F.col("pos").desc()).limit(recent).withColumn("part", F.lit(0))
    older = rows.join(newest.select("pos"), "pos", "left_anti")
    if older.count() > 10:
        older = older.where(F.col("score") >= keep).orderBy("pos").limit(old)
    both = newest.unionByName(older.withColumn("part", F.lit(1)))
    place = F.struct("part", (-F.floor(F.col("score") * 10)).alias("tenths"), (-F.col("kind_rank")).alias("kind"), "pos")
    first, last = F.min(F.when(F.col("part") == 0, place).otherwise(F.struct("part", F.lit(0).cast("bigint").alias("tenths"), F.lit(0).alias("kind"), "pos"))), F.max_by(F.struct("score", "kind_rank", "pos"), place)
    return both.groupBy("path", "entity").agg(first.alias("place"), last.alias("r")).orderBy("place").select("path", "entity", "r.*")


def greedy_dedup(rows: DataFrame, key: str, text: str, score: str, least: float = 0.85) -> DataFrame:
    """Keys that a greedy pass keeps: best score first, a row goes if it resembles a kept one.

    Rows of equal word sets keep their best; rows without words all stay. Among the others a row is decided once
    all better rows it resembles are: kept if none of those is, else dropped. Each
    round decides at least the best of every cluster, so rounds follow the longest
    chain of resemblance, not the number of rows.
    """
    order = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
    worded = rows.select(key, score, packed(word_set(F.col(text))).alias("words"))
    best = worded.where("words IS NOT NULL").groupBy("words").agg(F.min_by(F.struct(key, score), order).alias("r")).select("words", "r.*")
    best = materialize(best, "greedy", compression="zstd")
    rank = best.select(F.col(key).alias("id"), order.alias("o"))
    pairs = similar_classes(best.select(F.col(key).alias("id"), "words"), least).select("a", "b")
    both = pairs.join(rank.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a").join(rank.select(F.col("id").alias("b"), F.col("o").alias("ob")), "b")
    first = F.col("oa") < F.col("ob")
    links = materialize(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse")), "greedy")
    open_links, dropped = links, links.select(F.col("worse").alias("id")).limit(0)
    while not open_links.isEmpty():
        blocked = open_links.select(F.col("worse").alias("id")).distinct()
        sure = open_links.select(F.col("better").alias("id")).distinct().join(blocked, "id", "left_anti")  # nothing better is left open
        gone = materialize(open_links.join(sure, F.col("better") == sure["id"], "left_semi").select(F.col("worse").alias("id")).distinct(), "greedy")
        dropped = dropped.unionByName(gone)
        left = open_links.join(gone.withColumnRenamed("id", "worse"), "worse", "left_anti")
        open_links = materialize(left.join(gone.withColumnRenamed("id", "better"), "better", "left_anti"), "greedy")
    plain = worded.where("words IS NULL").select(key)
    return best.select(key).join(dropped.withColumnRenamed("id", key), key, "left_anti").unionByName(plain)


def iterative_search(
    search: Callable[[str], DataFrame],
    queries: list[str],
    key: str,
    turns: int = 5,
    more: Callable[[DataFrame, str], list[str]] | None = None,
    source: str | None = None,
    diversify: Callable[[DataFrame, str], list[str]] | None = None,
    least: float = 0.4,
) -> DataFrame:
    """Run queued queries until they add nothing new or the turns are over; ``more`` proposes follow-ups.

    If the found rows have few sources for their number (``source``, coverage under
    ``least``), the queries of ``diversify`` come next.
    """
    found, queue, asked = None, list(queries), set()
    for _ in range(turns):
        text = next((q for q in queue if q not in asked), None)
        if text is None:
            break
        asked.add(text)
        hits = search(text)
        fresh = hits if found is None else hits.join(found.select(key), key, "left_anti")
        fresh = materialize(fresh, "turn")
        if fresh.isEmpty() and len(asked) >= len(queries):
            break
        found = fresh if found is None else found.unionByName(fresh)
        queue += more(fresh, text) if more else []
        if source and diversify:
            seen = found.agg(F.countDistinct(source).alias("sources"), F.count("*").alias("n")).first()
            if seen["n"] and seen["sources"] / min(seen["n"], 24) < least:
                queue = [*diversify(found, text), *queue]
    return found


"""Questions in plain words, as Column expressions over a column of texts.

Rules only: keywords give the intent, patterns the limit, depth, order, date and
size. Many questions are read in one pass, and ``plan`` turns one of them into
an executable filter.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.strings import IDENTIFIER_PATTERNS

# Keywords of the intents, negations, relations and modifiers.
INTENTS = {
    "search": ("find", "search", "locate", "show", "list", "give me", "what", "which", "get", "fetch"),
    "traverse": ("from", "to", "between", "path", "connected", "related", "linked", "depends", "navigate", "trace"),
    "filter": ("with", "having", "containing", "matching", "like", "of type", "kind", "where", "filter"),
    "aggregate": ("count", "how many", "total", "sum", "average", "min", "max", "group", "statistics", "stats"),
    "relationship": ("imports", "exports", "extends", "implements", "calls", "uses", "references", "depends on", "relates to"),
    "semantic": ("explain", "describe", "usage", "purpose", "why", "when to use", "how does", "what is"),
    "compare": ("compare", "difference", "versus", "vs", "distinguish", "contrast"),
    "analyze": ("analyze", "analysis", "breakdown", "examine", "inspect", "review"),
    "transform": ("transform", "convert", "change", "map", "refactor", "rewrite"),
}
NEGATIONS = ("no", "not", "without", "exclude", "except", "don't", "doesn't", "isn't")
RELATIONS = ("imports", "exports", "extends", "implements", "calls", "uses", "depends", "references", "inherits", "composes")
MODIFIERS = ("abstract", "async", "static", "public", "private")
BOOSTS = {"compare": ("vs", 3.0), "aggregate": ("how many", 2.0), "transform": ("convert", 2.0), "semantic": ("?", 2.0)}


def _points(test: Column, points: float) -> Column:
    return F.when(test, F.lit(points)).otherwise(F.lit(0.0))


def keyword_signal(text: Column, keywords: tuple[str, ...]) -> Column:
    """1 and a tenth of its length for each keyword that the text holds."""
    low = F.lower(text)
    return sum((_points(low.contains(k), 1 + len(k) / 10) for k in keywords), F.lit(0.0))


def negation_signal(text: Column, words: tuple[str, ...] = NEGATIONS) -> Column:
    low = F.lower(text)
    return sum((_points(low.contains(w), 0.5) for w in words), F.lit(0.0))


def intent(text: Column) -> Column:
    """struct<intent, confidence>: the first best of the intents' scores per keyword."""
    low, negated = F.lower(text), negation_signal(text)
    scores = []
    for name, keywords in INTENTS.items():
        word, points = BOOSTS.get(name, ("", 0.0))
        extra = _points(low.contains(word), points) if word else F.lit(0.0)
        scores.append(F.struct(((keyword_signal(text, keywords) + negated + extra) / len(keywords)).alias("score"), F.lit(name).alias("intent")))
    first = lambda best, s: F.when(s["score"] > best["score"], s).otherwise(best)
    best = F.aggregate(F.array(*scores), F.struct(F.lit(0.0).alias("score"), F.lit("unknown").alias("intent")), first)
    weak = best["score"] < 0.3
    fallback = (
        F.when(weak & (low.contains("difference between") | low.contains("compare")), "compare")
        .when(weak & (low.contains("analyze") | low.contains("breakdown")), "analyze")
        .when(weak & (low.contains("transform") | low.contains("convert") | low.contains("refactor")), "transform")
    )
    confidence = F.when(fallback.isNotNull(), F.lit(0.6)).otherwise(F.least(F.lit(1.0), best["score"]))
    return F.struct(F.coalesce(fallback, best["intent"]).alias("intent"), confidence.alias("confidence"))


def _number(text: Column, pattern: str) -> Column:
    got = F.regexp_extract(text, pattern, 1)
    return F.when(got != "", got.cast("int"))


def _word(text: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(text, pattern, group)
    return F.when(got != "", got)


def entities(text: Column) -> Column:
    """Distinct quoted, Pascal-case, snake-case and kebab-case names."""
    parts = [F.regexp_extract_all(text, F.lit(p), 1 if k == "quoted" else 0) for k, p in IDENTIFIER_PATTERNS.items()]
    return F.array_distinct(F.concat(*parts))


def structured(text: Column) -> Column:
    """All that the rules read from a question, as a struct."""
    low, what = F.lower(text), intent(text)
    holds = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    kind = (
        F.when(low.contains("function") | low.contains("method"), "function")
        .when(low.contains("class"), "class")
        .when(low.contains("interface"), "interface")
    )
    unit = F.lower(F.regexp_extract(text, SIZE, 3))
    times = F.when(unit == "kb", 1024).when(unit == "mb", 1024 * 1024).otherwise(1)
    more = F.lower(F.regexp_extract(text, SIZE, 1)).isin("larger", "bigger", "greater")
    order = F.lower(F.regexp_extract(text, SORT, 2))
    when = F.lower(F.regexp_extract(text, DATE, 1))
    date_op = F.when(when.isin("before", "until"), "<").when(when != "", ">=")
    tests = F.when(low.contains("not test") | low.contains("non-test"), False).when(low.contains("test"), True)
    return F.struct(
        what["intent"].alias("intent"),
        what["confidence"].alias("confidence"),
        entities(text).alias("entities"),
        holds(RELATIONS).alias("relations"),
        holds(MODIFIERS).alias("modifiers"),
        _number(text, r"(?i)\b(?:depth|level)\s*(\d+)\b").alias("depth"),
        _number(text, r"(?i)\b(?:top|first|limit)\s*(\d+)\b").alias("limit"),
        kind.alias("entity_type"),
        tests.alias("is_test"),
        _word(text, DATE, 2).alias("date"),
        date_op.alias("date_op"),
        (_word(text, SIZE, 2).cast("bigint") * times).alias("size"),
        F.when(F.regexp_extract(text, SIZE, 1) != "", F.when(more, ">").otherwise("<")).alias("size_op"),
        _word(text, SORT).alias("sort_by"),
        F.when(order.startswith("asc"), "asc").when(order.startswith("desc"), "desc").alias("sort_order"),
        _word(text, r"(?i)\bgroup by (\w+)\b").alias("group_by"),
        F.filter(F.array(_word(text, COMPARE, 1), _word(text, COMPARE, 2)), lambda x: x.isNotNull()).alias("targets"),
    )


# Patterns of dates, sizes, orders and comparisons.
DATE = r"(?i)\b(before|after|since|until)\s+([0-9]{4}-[0-9]{2}-[0-9]{2})\b"
SIZE = r"(?i)\b(larger|smaller|bigger|greater|less)\s+than\s+(\d+)\s*(lines|bytes|kb|mb)\b"
SORT = r"(?i)\bsort by (\w+)(?:\s+(asc|ascending|desc|descending))?\b"
COMPARE = r"(?i)(?:compare|difference between)\s+(.+?)\s+(?:and|vs|versus)\s+(\S+)"


# Phrases that mean a search for a design pattern; questions with one or two blanks, their intent and what the second blank is.
PATTERN_PHRASES = (
    "singleton pattern", "factory pattern", "observer pattern", "strategy pattern", "adapter pattern", "decorator pattern", "facade pattern", "proxy pattern",
    "command pattern", "chain of responsibility", "iterator pattern", "mediator pattern", "memento pattern", "state pattern", "template method pattern",
    "visitor pattern", "composite pattern", "builder pattern", "dependency injection", "inversion of control",
)
BLANK_PHRASES = (
    ("explain (.*)", "semantic", ""),
    ("what is (.*)", "semantic", ""),
    ("how does (.*) work", "semantic", ""),
    ("when to use (.*)", "semantic", ""),
    ("why use (.*)", "semantic", ""),
    ("compare (.*) and (.*)", "compare", "entity"),
    ("difference between (.*) and (.*)", "compare", "entity"),
    ("analyze (.*)", "analyze", ""),
    ("convert (.*) to (.*)", "transform", "to"),
    ("transform (.*) into (.*)", "transform", "to"),
    ("refactor (.*) to (.*)", "transform", "to"),
)


def fallback(text: Column) -> Column:
    """struct<type, pattern, entities, target>: the first phrase that a question holds.

    Without one it is a search for the question's names, or for all its text.
    """
    none = F.lit(None).cast("string")

    def made(kind: str | Column, pattern: Column, names: Column, target: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), pattern.cast("string").alias("pattern"), names.cast("array<string>").alias("entities"), target.cast("string").alias("target"))

    names = entities(text)
    out = made("search", none, F.when(F.size(names) > 0, names).otherwise(F.array(F.trim(text))), none)
    cases = [(f"(?i){phrase}", made("search", F.lit(phrase.removesuffix(" pattern").replace(" ", "_")), F.lit(None), none)) for phrase in PATTERN_PHRASES]
    for phrase, kind, second in BLANK_PHRASES:
        pattern = f"(?i){phrase}"
        blank = lambda i, pattern=pattern: F.regexp_extract(text, pattern, i)
        found = F.array(blank(1), blank(2)) if second == "entity" else F.array(blank(1))
        cases.append((pattern, made(kind, none, found, blank(2) if second == "to" else none)))
    for pattern, value in reversed(cases):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return out


# Families of names in a question with their patterns, words that qualify a name, and kinds that words around it suggest.
FILE_ENDINGS = "ts|js|tsx|jsx|py|java|cpp|c|h|hpp|cs|go|rs|rb|php|swift|kt|scala|r|m|mm|sql|json|xml|yaml|yml|md|txt|css|scss|sass|less|html|htm"
NAME_FAMILIES = {
    "file": (rf"\b([\w\-]+\.({FILE_ENDINGS}))\b", True),
    "genericType": (r"\b(?:class|interface|struct|enum|trait|type|protocol)\s+(\w+)|(\w+)(?:Class|Interface|Struct|Enum|Trait|Type|Protocol)\b", True),
    "function": (r"\b(?:function|method|func|def|lambda|procedure)\s+(\w+)|(\w+)(?:Function|Method|Handler|Callback|Lambda|Procedure)\b", True),
    "module": (r"\b(?:module|package|namespace|library|crate)\s+([\w/\-@]+)|(@?[\w\-]+/[\w\-]+)\b", True),
    "variable": (r"\b(?:const|let|var|val|property)\s+(\w+)|(\$\w+|_\w+)\b", True),
    "constant": (r"\b[A-Z_][A-Z0-9_]+\b", False),
    "pattern": (
        r"\b(singleton|factory|observer|strategy|adapter|decorator|facade|proxy|command|chain of responsibility|iterator|mediator|memento|observer|state|"
        r"template method|visitor|composite|builder|dependency injection|injection|ioc)\b",
        True,
    ),
}
QUALIFIERS = (
    "abstract", "async", "deprecated", "private", "public", "internal", "static", "final", "override", "test", "spec", "protected", "readonly", "const", "virtual",
)
SUGGESTED = {
    "class": ("class", "interface", "struct"),
    "function": ("function", "method"),
    "file": ("file",),
    "variable": ("variable", "constant"),
    "pattern": ("pattern",),
    "code": ("class", "function", "method", "interface", "struct"),
    "import": ("module", "package"),
    "design": ("pattern",),
    "api": ("interface", "class", "method"),
    "data": ("variable", "constant", "struct"),
}
NAMED = T.ArrayType(
    T.StructType(
        [
            T.StructField("text", T.StringType()), T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType()),
            T.StructField("qualifiers", T.ArrayType(T.StringType())), T.StructField("start", T.IntegerType()),
        ]
    )
)


def names_of(question: str) -> list[dict]:
    """The names that one question mentions, each text and kind once, with how sure that is.

    Quoted 0.95, of a family 0.9, camel case 0.5, snake and kebab case 0.4; these take
    the question's qualifiers, worth 0.1. Words within 20 characters that suggest the
    kind add 0.15, or give an unknown kind their first and 0.1; the first and last
    fifth of the question add 0.05; at most 1. Patterns see ASCII words.
    """
    found: dict[tuple[str, str], dict] = {}

    def add(text: str, kind: str, sure: float, start: int, length: int, qualifiers: tuple = ()) -> None:
        around = question[max(0, start - 20) : start + length + 20].lower().split()
        found.setdefault((text.lower(), kind.lower()), {"text": text, "type": kind, "confidence": sure, "qualifiers": list(qualifiers), "start": start, "around": around})

    scan = lambda pattern, flags=0: re.finditer(pattern, question, flags | re.ASCII)
    for m in scan(r'"([^"]+)"'):
        add(m[1], "unknown", 0.95, m.start(), len(m[0]))
    for kind, (pattern, fold) in NAME_FAMILIES.items():
        for m in scan(pattern, re.IGNORECASE if fold else 0):
            text = next((g for g in m.groups()[:2] if g), m[0])
            add(text, kind, 0.9, m.start(), len(text))
    qualifiers = tuple(t for t in question.lower().split() if t in QUALIFIERS)
    for family, sure in (("pascal", 0.5), ("snake", 0.4), ("kebab", 0.4)):
        for m in scan(IDENTIFIER_PATTERNS[family]):
            add(m[0], "unknown", sure, m.start(), len(m[0]), qualifiers)
    out = []
    for name in found.values():
        sure = name["confidence"] + 0.1 * bool(name["qualifiers"])
        for word in name.pop("around"):
            kinds = SUGGESTED.get(word)
            if kinds and name["type"] in kinds:
                sure += 0.15
            elif kinds and name["type"] == "unknown":
                name["type"], sure = kinds[0], sure + 0.1
        share = name["start"] / len(question)
        out.append(name | {"confidence": min(1.0, sure + 0.05 * (share < 0.2 or share > 0.8))})
    return out


@F.pandas_udf(NAMED)
def named_entities(questions: pd.Series) -> pd.Series:
    """``names_of`` many questions; kinds and confidences depend on places, which expressions can't follow."""
    return questions.map(lambda q: names_of(q) if q else [])


def plan(spark: SparkSession, question: str, rows: DataFrame) -> DataFrame:
    """Run one question on rows with name, entity_type, and where asked ts, size or the sort column."""
    q = spark.range(1).select(structured(F.lit(question)).alias("q")).select("q.*").first()
    names = [e for e in q["entities"] if e not in rows.columns]  # columns to sort or group by are no names
    if names:
        rows = rows.where(F.col("name").isin(names))
    if q["entity_type"] and "entity_type" in rows.columns:
        rows = rows.where(F.col("entity_type") == q["entity_type"])
    if q["is_test"] is not None:
        test = F.col("name").contains(".test") | F.col("name").contains(".spec")
        rows = rows.where(test if q["is_test"] else ~test)
    if q["date"] and "ts" in rows.columns:
        limit = F.lit(q["date"]).cast("timestamp")
        rows = rows.where(F.col("ts") < limit if q["date_op"] == "<" else F.col("ts") >= limit)
    if q["size"] is not None and "size" in rows.columns:
        rows = rows.where(F.col("size") > q["size"] if q["size_op"] == ">" else F.col("size") < q["size"])
    if q["group_by"] in rows.columns:
        return rows.groupBy(q["group_by"]).agg(F.count("*").alias("n"))
    if q["sort_by"] in rows.columns:
        key = F.col(q["sort_by"])
        rows = rows.orderBy(key.desc() if q["sort_order"] == "desc" else key.asc(), "name")
    return rows if q["limit"] is None else rows.limit(q["limit"])

"""The graph's small query language, compiled to Column expressions.

Forms: ``traverse:<name>:<direction>:<depth>[:kinds]``, ``rank:<text>:<by>``,
``key:value`` conditions, or free text. A condition is looked up in a table of
Column builders, so Catalyst sees one plain predicate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.strings import similarity, tokens
from mnemospark.operators import graph


@dataclass(frozen=True)
class Ask:
    """A parsed query: its form and what that form needs."""

    form: str
    text: str = ""
    conditions: tuple[tuple[str, str], ...] = ()
    connective: str = "AND"
    negated: bool = False
    limit: int | None = None
    fuzzy: float | None = None
    by: str = "relevance"
    direction: str = "outgoing"
    depth: int = 1
    kinds: tuple[str, ...] | None = field(default=None)


CONDITIONS = ("entitytype", "file", "name", "obs", "id", "defined_in_file_path", "parent_class_full_name")


def parse(query: str) -> Ask:
    """Read one query string."""
    text = query.strip()
    if m := re.fullmatch(r"traverse:([^:]+):(outgoing|incoming|both):(\d+)(?::(.+))?", text):
        kinds = tuple(k.strip() for k in m[4].split(",")) if m[4] else None
        return Ask("traverse", m[1], direction=m[2], depth=int(m[3]), kinds=kinds)
    if m := re.fullmatch(r"rank:(.+?):(relevance|recency|popularity)", text):
        return Ask("rank", m[1], by=m[2])
    pairs = re.findall(r'(\w+):(?:"([^"]*)"|(\S+))', text)
    if not pairs:
        return Ask("simple", text)
    found, free = [], re.sub(r'\w+:(?:"[^"]*"|\S+)', " ", text).split()
    options: dict[str, str] = {}
    for key, quoted, bare in pairs:
        value = quoted or bare
        if key.lower() in CONDITIONS:
            found.append((key.lower(), value))
        elif key.lower() in ("limit", "operator", "fuzzy", "similarity"):
            options[key.lower() if value != "NOT" else "not"] = value
        else:
            free.append(f"{key}:{value}")
    if free:
        found.append(("obs", " ".join(free)))
    number = lambda s, kind: kind(s) if re.fullmatch(r"\d+(\.\d+)?", s or "") and float(s) else None
    limit = number(options.get("limit"), lambda s: int(float(s)))
    fuzzy = (number(options.get("similarity"), float) or 0.7) if options.get("fuzzy", "").lower() == "true" else None
    connective = options["operator"].upper() if options.get("operator", "").upper() in ("AND", "OR") else "AND"
    return Ask("complex", text, tuple(found), connective, "not" in options, limit, fuzzy)


def _has(c: Column, text: str) -> Column:
    return F.lower(c).contains(text.lower())


def _near(c: Column, text: str, least: float) -> Column:
    """A word of ``c`` is similar enough: stands for a fuzzy matcher of the name."""
    return _has(c, text) | F.exists(tokens(c), lambda t: similarity(t, F.lit(text.lower())) >= least)


def _keyed(key: str, text: str) -> Column:
    return F.exists("observations", lambda o: o.startswith(f"{key}:") & o.contains(text))


def condition(key: str, text: str, fuzzy: float | None = None) -> Column:
    """One condition as a predicate that is never null."""
    match = _has if fuzzy is None else lambda c, t: _near(c, t, fuzzy)
    if key == "entitytype":
        made = _has(F.col("entity_type"), text)
    elif key == "name":
        made = match(F.col("name"), text)
    elif key == "obs":
        made = F.exists("observations", lambda o: match(o, text))
    elif key == "id":
        made = F.col("id") == text
    elif key == "file":
        made = (F.col("entity_type") == "file") | F.coalesce(F.exists("observations", lambda o: o.contains(text)), F.lit(False))
    else:
        made = _keyed(key, text)
    return F.coalesce(made, F.lit(False))


def predicate(ask: Ask) -> Column:
    """The whole filter. No condition at all is true for AND and false for OR."""
    parts = [condition(k, v, ask.fuzzy) for k, v in ask.conditions]
    made = reduce(and_ if ask.connective == "AND" else or_, parts) if parts else F.lit(ask.connective == "AND")
    return ~made if ask.negated else made


def simple(text: str) -> Column:
    """Free text in the name, the type or any observation; empty text is everywhere."""
    places = (_has(F.col("name"), text), _has(F.col("entity_type"), text), F.exists("observations", lambda o: _has(o, text)))
    return reduce(or_, [F.coalesce(p, F.lit(False)) for p in places]) | F.lit(not text)


def relevance(text: str) -> Column:
    """10 name holds it, 20 name is it, 5 type holds it, 2 for each observation that does."""
    flag = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    notes = F.size(F.filter(F.coalesce("observations", F.array().cast("array<string>")), lambda o: _has(o, text)))
    return flag(_has(F.col("name"), text), 10) + flag(F.lower("name") == text.lower(), 20) + flag(_has(F.col("entity_type"), text), 5) + 2 * notes


def structured(nodes: DataFrame, names: list[str] | None = None, types: list[str] | None = None, only_tests: bool = False, limit: int | None = None) -> DataFrame:
    """Filter by exact names, exact types and test files."""
    if names:
        nodes = nodes.where(F.col("name").isin(*names))
    if types:
        nodes = nodes.where(F.col("entity_type").isin(*types))
    if only_tests:
        nodes = nodes.where(F.col("name").contains(".test") | F.col("name").contains(".spec"))
    return nodes if limit is None else nodes.orderBy("id").limit(limit)


def execute(ask: Ask | str, nodes: DataFrame, edges: DataFrame | None = None, now=None) -> DataFrame:
    """Run a query; ties of ranked results go by id."""
    ask = parse(ask) if isinstance(ask, str) else ask
    if ask.form == "traverse":
        return graph.traverse(nodes, edges, ask.text, ask.depth, ask.direction, list(ask.kinds) if ask.kinds else None, simple(ask.text))
    if ask.form == "rank":
        if ask.by == "relevance":
            score = relevance(ask.text).cast("double")
        elif ask.by == "recency":
            score = F.greatest(F.lit(0.0), 100 - (F.lit(now) - F.col("timestamp")) / 86_400_000)
        else:
            score = F.coalesce(F.col("access_count"), F.lit(0)).cast("double")
        return nodes.withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(50)
    if ask.form == "simple":
        return nodes.where(simple(ask.text))
    found = nodes.where(predicate(ask))
    return found if ask.limit is None else found.orderBy("id").limit(ask.limit)

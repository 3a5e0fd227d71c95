"""Property graph operators over (id, …) nodes and (src, dst, kind) edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.strings import mermaid_label, strip_file_prefix
from mnemospark.session import materialize


def bfs(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "outgoing", kinds: list[str] | None = None, live: DataFrame | None = None) -> DataFrame:
    """(id, depth) of all ids within ``depth`` hops, each once at its least depth.

    A loop over hops with an anti-join on visited ids: graphs may have cycles,
    and a recursive query can't drop what it has seen. Each hop is a table in
    the shared folder. With ``live`` (ids) the walk doesn't pass other ids.
    """
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(*kinds))
    step = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = {"outgoing": step, "incoming": back, "both": step.unionByName(back)}[direction]
    seen = starts.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("src")).join(step, "src").select(F.col("dst").alias("id")).distinct()
        if live is not None:
            reached = reached.join(live.select("id"), "id", "left_semi")
        frontier = materialize(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(hop)), "hop")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def traverse(nodes: DataFrame, edges: DataFrame, start_name: str, depth: int, direction: str = "outgoing", kinds: list[str] | None = None, otherwise: Column | None = None) -> DataFrame:
    """Nodes reached from those of a name, walking through ids that have no node.

    If none has the name, the walk starts from the first node by id that ``otherwise`` finds.
    """
    starts = nodes.where(F.col("name") == start_name)
    if otherwise is not None and starts.isEmpty():
        starts = nodes.where(otherwise).orderBy("id").limit(1)
    return nodes.join(bfs(edges, starts, depth, direction, kinds), "id")


def neighbourhood_edges(nodes: DataFrame, edges: DataFrame, start_name: str, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """All outgoing edges of the nodes that are expanded, also to missing nodes."""
    inner = bfs(edges, nodes.where(F.col("name") == start_name), depth - 1, "outgoing", kinds, live=nodes)
    own = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    return own.join(inner.select(F.col("id").alias("src")), "src", "left_semi")


def inbound_sources(nodes: DataFrame, edges: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """Nodes with an edge of a kind into a target."""
    into = edges.where(F.col("kind") == kind).join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(into.select(F.col("src").alias("id")), "id", "left_semi")


def subgraph(edges: DataFrame, ids: DataFrame, both_ends: bool = True) -> DataFrame:
    """Edges with both ends, or either end, among some ids."""
    one = ids.select("id").distinct()
    in_src = edges.join(one.select(F.col("id").alias("src")), "src", "left_semi")
    if both_ends:
        return in_src.join(one.select(F.col("id").alias("dst")), "dst", "left_semi")
    return in_src.unionByName(edges.join(one.select(F.col("id").alias("dst")), "dst", "left_semi")).distinct()


def named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of both ends; edges to missing nodes are left out."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def resolve_names(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(wanted, id, strategy): endpoints by name, the first strategy that finds exactly one node.

    exact; without a file prefix; namespaces spelt alike; last member; last member in
    any case. Each strategy is an equi-join on a derived key. ``resolve_endpoints`` has
    the longer list of strategies that a stored graph's links need.
    """
    member = lambda c: F.element_at(F.split(c, r"::|\.|\\\\"), -1)
    plain = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("::")))
    strategies: list[tuple[str, Column, Column]] = [
        ("exact", F.col("wanted"), F.col("name")),
        ("file_prefix", strip_file_prefix("wanted"), F.col("name")),
        ("namespace", plain(F.col("wanted")), plain(F.col("name"))),
        ("member", member(F.col("wanted")), member(F.col("name"))),
        ("folded_member", F.lower(member(F.col("wanted"))), F.lower(member(F.col("name")))),
    ]
    found = None
    for rank, (label, left, right) in enumerate(strategies):
        keys = nodes.groupBy(right.alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
        part = wanted.select("wanted", left.alias("key")).join(keys, "key").select("wanted", "id", F.lit(label).alias("strategy"), F.lit(rank).alias("rank"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("wanted").agg(F.min_by(F.struct("id", "strategy"), "rank").alias("r")).select("wanted", "r.*")


def _stripped(name: Column) -> Column:
    """``path::Name`` without a prefix that holds a slash of either kind."""
    before = F.substring_index(name, "::", 1)
    is_path = name.contains("::") & (before.contains("/") | before.contains("\\"))
    return F.when(is_path, F.substring(name, F.length(before) + 3, F.length(name))).otherwise(name)


def _namespace(name: Column) -> Column:
    """Trimmed, without a leading backslash, double ones as one."""
    trimmed = F.trim(name)
    bare = F.when(trimmed.startswith("\\"), F.substring(trimmed, F.lit(2), F.length(trimmed))).otherwise(trimmed)
    return F.replace(bare, F.lit("\\\\"), F.lit("\\"))


def _tails(name: Column, mark: str) -> Column:
    """What follows each occurrence of a mark."""
    parts = F.split(name, re.escape(mark))
    after = F.sequence(F.lit(1), F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.transform(after, lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), mark))).otherwise(F.array().cast("array<string>"))


def resolve_endpoints(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(wanted, id, strategy): what a relation's end means, the first of seven strategies that finds it.

    exact; file_prefix, without a path before ``::``; namespace, without a leading
    backslash; and by one node name alone: class_member, ``Class::member`` at the end
    of a namespace; member, ``::member`` at the end; suffix, the end of a namespace;
    class_and_member, the only class of that ending joined with the member. A name of
    several nodes means the one of the greatest id. Each strategy is an equi-join on
    the names or their endings.
    """
    ids = nodes.groupBy("name").agg(F.max("id").alias("id"))
    bare = _stripped(F.col("wanted"))
    one = materialize(wanted.select("wanted").where(F.length("wanted") > 0).distinct(), "wanted")
    one = materialize(one.select("wanted", bare.alias("bare")), "wanted")  # each step's text is read, not computed again, by the next
    bare = F.col("bare")
    pair = bare.rlike(r"^[^:]+::.+")
    short, member = _namespace(F.substring_index(bare, "::", 1)), F.substring(bare, F.length(F.substring_index(bare, "::", 1)) + 3, F.length(bare))
    asked = one.select("wanted", bare.alias("bare"), _namespace(F.col("wanted")).alias("spaced"), F.when(pair, short).alias("class"), F.when(pair, member).alias("member"), _namespace(bare).alias("short"))
    asked = materialize(asked, "wanted")

    def endings(mark: str, own: bool, classes: bool = False) -> DataFrame:
        """(key, name) of endings that only one name has."""
        rows = ids.where(~F.col("name").contains("::")) if classes else ids
        keys = _tails(F.col("name"), mark)
        keys = F.concat(keys, F.array("name")) if own else keys
        return rows.select(F.explode(F.array_distinct(keys)).alias("key"), "name").groupBy("key").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1")

    def named(key: Column, ends: DataFrame) -> DataFrame:
        return asked.withColumn("key", key).join(ends, "key").select("wanted", "member", "name")

    spaces, members, classes = endings("\\", True), endings("::", False), endings("\\", True, True)
    together = named(F.col("class"), classes).select("wanted", F.concat("name", F.lit("::"), "member").alias("name"))
    found = [
        ("exact", asked.select("wanted", F.col("wanted").alias("name"))),
        ("file_prefix", asked.where("bare <> wanted").select("wanted", F.col("bare").alias("name"))),
        ("namespace", asked.where("spaced <> wanted").select("wanted", F.col("spaced").alias("name"))),
        ("class_member", named(F.concat("class", F.lit("::"), "member"), spaces).select("wanted", "name")),
        ("member", named(F.col("member"), members).select("wanted", "name")),
        ("suffix", named(F.col("short"), spaces).select("wanted", "name")),
        ("class_and_member", together),
    ]
    every = None
    for rank, (label, rows) in enumerate(found):
        part = rows.withColumns({"strategy": F.lit(label), "rank": F.lit(rank)})
        every = part if every is None else every.unionByName(part)
    return every.join(ids, "name").groupBy("wanted").agg(F.min_by(F.struct("id", "strategy"), "rank").alias("r")).select("wanted", "r.*")


def entity_edges(entities: DataFrame) -> DataFrame:
    """(src, dst, kind) of code entities, each once.

    ``entities`` has full_name, type, file, parent_class, calls (array of struct
    name, type) and interfaces (array of names). An entity is defined in its file, a
    method belongs to its class; calls and interfaces are looked for in the same file.
    """
    here = lambda name: F.concat("file", F.lit("::"), name)
    usable = entities.where((F.length("full_name") > 0) & (F.length("file") > 0))
    src, lit = F.col("full_name").alias("src"), lambda k: F.lit(k).alias("kind")
    defined = usable.select(src, F.col("file").alias("dst"), lit("defined_in_file"))
    methods = usable.where((F.col("type") == "method") & (F.length("parent_class") > 0)).select(here(F.col("parent_class")).alias("src"), F.col("full_name").alias("dst"), lit("has_method"))
    calls = usable.select("full_name", "file", F.explode("calls").alias("c"))
    called = calls.select(src, here(F.col("c.name")).alias("dst"), F.concat(F.lit("calls_"), F.col("c.type")).alias("kind"))
    faces = usable.where(F.col("type") == "class").select("full_name", "file", F.explode("interfaces").alias("i"))
    kept = faces.select(src, here(F.col("i")).alias("dst"), lit("implements_interface"))
    return defined.unionByName(methods).unionByName(called).unionByName(kept).distinct()


def creation_events(created: DataFrame, kind: str) -> DataFrame:
    """(event_type, payload) for created nodes (id, name, entity_type) or relations (src, dst, kind)."""
    fields = {"node": ("id AS nodeId", "name", "entity_type AS entityType"), "relation": ("src AS fromNodeId", "dst AS toNodeId", "kind AS relationType")}[kind]
    return created.select(F.lit(f"{kind.upper()}_CREATED").alias("event_type"), F.to_json(F.struct(*[F.expr(f) for f in fields])).alias("payload"))


def new_relations(proposed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed edges between existing nodes that the graph lacks, each once."""
    ends = proposed
    for c in ("src", "dst"):
        ends = ends.join(nodes.select(F.col("id").alias(c)), c, "left_semi")
    whole = ["src", "dst", "kind"]
    return ends.repartition(*whole).dropDuplicates(whole).join(edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")


def mermaid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A diagram line for each edge whose ends exist."""
    label = lambda c: F.concat(F.regexp_replace(c, r"\W", "_"), F.lit('["'), mermaid_label(f"{c}_name"), F.lit('"]'))
    return named(edges, nodes).select(F.concat(label("src"), F.lit(" -->|"), F.col("kind"), F.lit("| "), label("dst")).alias("line"))


def thread_depths(messages: DataFrame) -> DataFrame:
    """(id, root, depth) of (id, parent) trees by pointer doubling: log2(depth) rounds.

    A message whose parent is missing is a root. Cycles have no root and are left out.
    """
    known = messages.select(F.col("id").alias("parent"))
    rooted = messages.join(known.withColumn("there", F.lit(True)), "parent", "left")
    table = materialize(
        rooted.select("id", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(0).alias("depth"), F.when(F.col("there"), F.col("parent")).otherwise(F.col("id")).alias("root")), "threads"
    )
    for _ in range(40):
        above = table.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("root").alias("root2"))
        joined = table.join(above, "up", "left")
        table = materialize(
            joined.select("id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("root2", "root").alias("root")), "threads"
        )
        if table.where(F.col("up").isNotNull()).isEmpty():
            break
    return table.where(F.col("up").isNull()).select("id", "root", "depth")


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, kind) of imports: a file found by probing extensions, else a module.

    ``files`` has path; ``imports`` has src (path of the importer) and target.
    """
    # What is tried after a path without an extension, in order.
    tries = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")
    base = F.regexp_replace("target", r"\.js$", "")
    paths = [F.concat(base, F.lit(t)) for t in tries]
    tried = imports.select("src", "target", F.posexplode(F.array(F.col("target"), *paths)).alias("rank", "path"))
    hit = tried.join(files.select("path").distinct(), "path").groupBy("src", "target").agg(F.min_by("path", "rank").alias("path"))
    joined = imports.select("src", "target").distinct().join(hit, ["src", "target"], "left")
    return joined.select("src", F.coalesce("path", "target").alias("dst"), F.when(F.col("path").isNotNull(), "imports_file").otherwise("imports_module").alias("kind"))


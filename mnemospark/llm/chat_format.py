"""Chat formatting by schema fingerprints, in DataFrame functions only.

Chat data come in many layouts: one row per turn, a list of messages, a prompt
with a completion, an instruction with an input. A layout is a declarative
mapping to canonical turns ``array<struct<role, text>>``; its fingerprint is the
hash of the nested field paths that it needs. A record's paths, cut down to those
that a layout knows, are hashed and looked up: of the layouts found that way the
one that needs most paths is chosen, so fields that no layout knows, or that
another one knows, never break a record.

* ``table_turns`` looks at the schema of a DataFrame: rows of turns are grouped,
  records with typed lists or fields are mapped row by row; ``turn_rows`` does the
  first alone;
* ``json_turns`` looks at each JSON record, so one column may mix layouts.

``format_turns`` then writes the template and ``parse_formatted`` reads it.

Template, one block per turn::

    <s>[INST]role[/INST]text</s>

Within role and text the backslash becomes ``\\e``, ``<`` becomes ``\\l`` and
``[`` becomes ``\\b``. No control string can occur in an escaped text, and the
escape is undone by replacing ``\\l``, ``\\b`` and last ``\\e``. The loss mask
is a list of half-open code-point spans that covers each assistant text.

Edge cases: a null text is empty; a null role is the empty role; a record in
an unknown layout or of broken JSON gives null turns and stays in the result;
a list of messages without elements gives no turns, a null list null turns; an
optional field (a system prompt) that is absent or null is no turn; content given
as a list of parts is the text of its parts; repeated rows of a turn are all
kept, ties in the turn number broken by role and text. Other columns are ignored,
or passed on where rows stay rows; an input column with the name of an output
column is replaced, others are safe. A conversation is one output value, so its
rows meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
CONTROL = {"open": "<s>[INST]", "text": "[/INST]", "close": "</s>"}


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: the field paths that it needs and what its turns are."""

    name: str
    paths: tuple[str, ...]
    #: Lists: (list path, role field, text field).
    list_of: tuple[str, str, str] | None = None
    #: Else pairs (role, path of the text).
    pairs: tuple[tuple[str, str], ...] = ()
    #: Else rows of turns: (conversation, order, role, text).
    rows: tuple[str, str, str, str] | None = None
    #: A path whose text, if there is one, is a system turn ahead of the others.
    system: str = "system"

    @property
    def fingerprint(self) -> int:
        """XXH64 (seed 42) of the sorted paths, signed as Spark's ``xxhash64`` is."""
        value = xxhash.xxh64_intdigest("\n".join(sorted(self.paths)), 42)
        return value - (1 << 64) if value >> 63 else value


def _pairs(name: str, *paths: str) -> Layout:
    return Layout(name, paths, pairs=(*(("user", p) for p in paths[:-1]), ("assistant", paths[-1])))


def _list(path: str, role: str, text: str) -> Layout:
    return Layout(path if role == "role" else f"{path}_{role}", (path, f"{path}.{role}", f"{path}.{text}"), list_of=(path, role, text))


def _rows(conversation: str, order: str, role: str, text: str) -> Layout:
    paths = (conversation, order, role, text)
    return Layout("turn_rows" if text == "text" else f"{conversation}_rows_{text}", paths, rows=paths)


LAYOUTS = (
    _rows("conv_id", "turn", "role", "text"),
    _rows("conv_id", "turn", "role", "content"),
    _rows("conversation_id", "turn", "role", "content"),
    _list("messages", "role", "content"),
    _list("messages", "from", "value"),
    _list("conversations", "from", "value"),
    _list("conversation", "role", "content"),
    _list("turns", "role", "text"),
    Layout("empty_messages", ("messages",), list_of=("messages", "role", "content")),
    _pairs("prompt_completion", "prompt", "completion"),
    _pairs("prompt_response", "prompt", "response"),
    _pairs("question_answer", "question", "answer"),
    _pairs("instruction", "instruction", "output"),
    _pairs("instruction_response", "instruction", "response"),
    _pairs("instruction_input", "instruction", "input", "output"),
)
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN_PATHS = tuple(sorted({p for layout in LAYOUTS for p in layout.paths}))


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted nested field paths of a Spark type; arrays add no step."""
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix)
    if not isinstance(schema, T.StructType):
        return []
    found = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        found += [path, *schema_paths(field.dataType, f"{path}.")]
    return found


def ranked_layouts(rows: bool) -> list[Layout]:
    """Layouts of rows, or of records, those that need most paths first."""
    return sorted((x for x in LAYOUTS if bool(x.rows) == rows), key=lambda x: -len(x.paths))


def layout_of_schema(schema: T.StructType) -> Layout:
    """The mapping that a DataFrame's field paths select by fingerprint, rows of turns before records."""
    have = set(schema_paths(schema))
    by_fingerprint = {x.fingerprint: x for x in LAYOUTS}
    for layout in (*ranked_layouts(True), *ranked_layouts(False)):
        cut = Layout("", tuple(have.intersection(layout.paths)))
        if cut.fingerprint in by_fingerprint and by_fingerprint[cut.fingerprint] is layout:
            return layout
    raise ValueError(f"no layout for the field paths {sorted(have.intersection(KNOWN_PATHS))}")


def path_fingerprint(paths: Column, layout: Layout) -> Column:
    """Hash of an array of field paths, cut down to those of a layout."""
    known = F.array(*[F.lit(p) for p in layout.paths])
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(F.array_distinct(paths), known)), "\n"))


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(prefix), k))


def json_paths(record: Column) -> Column:
    """Field paths of a JSON record, two levels deep, through native JSON functions.

    The paths of a list's elements are those of all its elements.
    """
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    nested = []
    for name in sorted({p.split(".")[0] for p in KNOWN_PATHS if "." in p}):
        items = F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>")
        keys = F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))))
        nested.append(_prefixed(F.coalesce(keys, F.array().cast("array<string>")), f"{name}."))
    return F.concat(top, *nested)


def _turn(role: Column, text: Column) -> Column:
    name = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in ROLE_NAMES.items():
        name = F.when(name == old, new).otherwise(name)
    return F.struct(name.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _json_text(item: Column, field: str) -> Column:
    """A field's text; of a list of parts, the text of all parts."""
    parts = F.from_json(item, T.StructType([T.StructField(field, T.ArrayType(T.StringType()))]))[field]
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))), "")
    return F.coalesce(joined, F.get_json_object(item, f"$.{field}"))


def _json_list(items: Column, role: str, text: str) -> Column:
    return F.transform(F.from_json(items, "array<string>"), lambda x: _turn(F.get_json_object(x, f"$.{role}"), _json_text(x, text)))


def _typed_text(value: Column, kind: T.DataType) -> Column:
    """As ``_json_text`` for a typed column."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "text" in kind.elementType.names:
        return F.array_join(F.transform(value, lambda p: F.coalesce(p["text"].cast("string"), F.lit(""))), "")
    return value.cast("string")


def _with_system(turns: Column, system: Column | None) -> Column:
    if system is None:
        return turns
    first = F.array(_turn(F.lit("system"), system))
    return F.when(system.isNull(), turns).otherwise(F.concat(first, turns))


def json_turns(df: DataFrame, record: str = "record", out: str = "turns") -> DataFrame:
    """Add canonical turns for a column of JSON records in any mix of layouts."""
    raw = F.col(f"`{record}`")
    paths = json_paths(raw)
    turns = F.lit(None).cast(TURNS)
    for layout in reversed(ranked_layouts(False)):  # the first of them is asked first
        if layout.list_of:
            path, role, text = layout.list_of
            made = _json_list(F.get_json_object(raw, f"$.{path}"), role, text)
        else:
            made = F.array(*[_turn(F.lit(role), _json_text(raw, path)) for role, path in layout.pairs])
        made = _with_system(made, F.get_json_object(raw, f"$.{layout.system}"))
        turns = F.when(path_fingerprint(paths, layout) == F.lit(layout.fingerprint), made.cast(TURNS)).otherwise(turns)
    return df.withColumn(out, turns)


def turn_rows(df: DataFrame) -> DataFrame:
    """(conversation, turns) from rows of turns in a known layout, in the order of turn, role and text."""
    layout = layout_of_schema(df.schema)
    if not layout.rows:
        raise ValueError("rows of turns are expected")
    conversation, order, role, text = layout.rows
    turn = F.struct(F.col(order).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return df.groupBy(conversation).agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def table_turns(df: DataFrame, out: str = "turns") -> DataFrame:
    """Canonical turns of a table, by the layout that its schema selects."""
    layout = layout_of_schema(df.schema)
    if layout.rows:
        return turn_rows(df)
    if layout.list_of:
        path, role, text = layout.list_of
        element = df.schema[path].dataType.elementType
        made = F.transform(F.col(path), lambda x: _turn(x[role], _typed_text(x[text], element[text].dataType)))
    else:
        made = F.array(*[_turn(F.lit(role), _typed_text(F.col(path), df.schema[path].dataType)) for role, path in layout.pairs])
    system = F.col(layout.system).cast("string") if layout.system in df.columns else None
    return df.withColumn(out, _with_system(made, system).cast(TURNS))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (array of struct<start,length>)."""
    head = F.lit(CONTROL["open"])
    blocks = F.transform(
        F.col(f"`{turns}`"),
        lambda t: F.struct(
            F.concat(head, escape(t["role"]), F.lit(CONTROL["text"])).alias("before"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learn"),
        ),
    )
    helper = "_blocks"
    while helper in df.columns:
        helper += "_"
    df = df.withColumn(helper, blocks)
    close = len(CONTROL["close"])
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, b: Column) -> Column:
        start = acc["at"] + F.length(b["before"])
        size = F.length(b["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (start + size + close).alias("at"),
            F.when(b["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return df.withColumns(
        {
            "formatted": F.array_join(F.transform(helper, lambda b: F.concat(b["before"], b["body"], F.lit(CONTROL["close"]))), ""),
            "loss_spans": F.aggregate(helper, state, step, lambda acc: acc["spans"]),
        }
    ).drop(helper)


def parse_formatted(formatted: Column) -> Column:
    """The turns back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, "</s>"), lambda x: x != "")
    body = len(CONTROL["open"]) + 1

    def turn(block: Column) -> Column:
        role = F.substring_index(F.substring(block, body, 2**30), CONTROL["text"], 1)
        start = F.length(role) + body + len(CONTROL["text"])
        return F.struct(unescape(role).alias("role"), unescape(F.substring(block, start, F.lit(2**30))).alias("text"))

    return F.transform(blocks, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")

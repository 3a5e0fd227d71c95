"""Source parsers: table functions where a grammar is needed, expressions elsewhere."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from mnemospark.operators.lexers import lexed_declarations, sql_statements


@udtf(returnType="kind string, name string, start_line int, end_line int, parent string")
class PythonEntities:
    """Imports, classes, functions and methods of Python text; broken text gives none."""

    def eval(self, text: str) -> Iterator[tuple[str, str, int, int, str | None]]:
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError):
            return
        todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
        while todo:
            node, parent = todo.pop(0)
            for child in ast.iter_child_nodes(node):
                inside = parent
                if isinstance(child, (ast.Import, ast.ImportFrom)):
                    stem = f"{'.' * child.level}{child.module or ''}" if isinstance(child, ast.ImportFrom) else ""
                    for alias in child.names:
                        yield "import", f"{stem}:{alias.name}" if stem else alias.name, child.lineno, child.end_lineno or child.lineno, parent
                elif isinstance(child, ast.ClassDef):
                    inside = child.name
                    yield "class", child.name, child.lineno, child.end_lineno or child.lineno, parent
                elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield "method" if isinstance(node, ast.ClassDef) else "function", child.name, child.lineno, child.end_lineno or child.lineno, parent
                todo.append((child, inside))


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str, int]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known = dict(attrs)
        line = self.getpos()[0]
        self.found.append(("element", tag, line))
        for attr, kind in (("id", "id"), ("href", "link"), ("src", "source")):
            if known.get(attr):
                self.found.append((kind, known[attr] or "", line))
        self.found += [("class", c, line) for c in dict.fromkeys((known.get("class") or "").split())]


@udtf(returnType="kind string, value string, line int")
class HtmlParts:
    """Elements, ids, links, sources and classes of HTML."""

    def eval(self, text: str) -> Iterator[tuple[str, str, int]]:
        parser = _Tags()
        parser.feed(text or "")
        yield from parser.found


def apply_table_function(docs: DataFrame, key: str, text: str, name: str, function) -> DataFrame:
    """Rows of a table function for each text."""
    spark = docs.sparkSession
    spark.udtf.register(name, function)
    docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).createOrReplaceTempView(f"_{name}_input")
    return spark.sql(f"SELECT _key AS {key}, p.* FROM _{name}_input, LATERAL {name}(_text) p")


def html_parts(pages: DataFrame, key: str, text: str) -> DataFrame:
    return apply_table_function(pages, key, text, "html_parts", HtmlParts)


def python_entities(files: DataFrame, key: str, text: str) -> DataFrame:
    return apply_table_function(files, key, text, "python_entities", PythonEntities)


def class_tokens(text: Column) -> Column:
    """Distinct class names of all class attributes."""
    attributes = F.regexp_extract_all(text, F.lit(r"""class(?:Name)?\s*=\s*["']([^"']*)["']"""), 1)
    return F.array_distinct(F.filter(F.flatten(F.transform(attributes, lambda a: F.split(a, r"\s+"))), lambda t: t != ""))


def markdown_parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, kind, value): headings with their level, relative links, and fenced blocks."""
    from pyspark.sql import Window

    lines = docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    fence = F.col("line").startswith("```")
    before = F.sum(fence.cast("int")).over(Window.partitionBy(key).orderBy("line_no"))
    marked = lines.withColumns({"fence": fence, "open": before % 2})
    free = ~F.col("fence") & (F.col("open") == 0)
    heading = F.when(free & F.col("line").rlike(r"^#{1,6}\s+\S"), F.struct(F.concat(F.lit("h"), F.length(F.regexp_extract("line", r"^(#+)", 1)).cast("string")).alias("kind"), F.regexp_extract("line", r"^#+\s+(.*)$", 1).alias("value")))
    block = F.when(F.col("fence") & (F.col("open") == 1), F.struct(F.lit("code").alias("kind"), F.regexp_extract("line", r"^```(\w*)", 1).alias("value")))
    links = F.transform(F.regexp_extract_all("line", F.lit(r"\[[^\]]*\]\((?!https?:|#)([^)]+)\)"), 1), lambda x: F.struct(F.lit("link").alias("kind"), x.alias("value")))
    parts = F.concat(F.filter(F.array(heading, block), lambda x: x.isNotNull()), F.when(free, links).otherwise(F.array().cast("array<struct<kind:string,value:string>>")))
    return marked.select(key, "line_no", F.explode(parts).alias("p")).select(key, "line_no", "p.*")


def css_parts(text: Column) -> tuple[Column, Column]:
    """(imports, selectors) of CSS."""
    plain = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    imports = F.regexp_extract_all(plain, F.lit(r"""@import\s+(?:url\()?["']?([^"')\s;]+)"""), 1)
    selectors = F.transform(F.regexp_extract_all(plain, F.lit(r"([^{}@;]+)\{"), 1), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return imports, F.filter(selectors, lambda s: s != "")


def sql_tables(text: Column) -> tuple[Column, Column]:
    """(created, referenced) table names of SQL text."""
    name = r'[`"\[]?([\w.]+)[`"\]]?'
    created = F.regexp_extract_all(text, F.lit(r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?" + name), 1)
    used = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update|references)\s+" + name), 1)
    return F.array_distinct(created), F.array_distinct(used)


def script_entities(text: Column) -> Column:
    """(kind, name) structs of classes, functions and imports by pattern; no grammar is run."""
    kinds = (("class", r"\bclass\s+(\w+)"), ("function", r"\bfunction\s+(\w+)"), ("import", r"""\bfrom\s+['"]([^'"]+)['"]"""), ("interface", r"\binterface\s+(\w+)"))
    parts = [_named(text, kind, pattern) for kind, pattern in kinds]
    return F.concat(*parts)


def _named(text: Column, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def sql_columns(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, pos, column, type) of the columns in CREATE TABLE statements."""
    made = sql_statements(files, key, text).where("kind = 'create_table'")
    return made.select(key, F.col("name").alias("table"), F.explode("columns").alias("c")).select(key, "table", "c.pos", F.col("c.name").alias("column"), "c.type")


def script_declarations(files: DataFrame, key: str, text: str, language: str = "script") -> DataFrame:
    """(key, kind, name, holder, start_line, end_line) of each file's declarations; null texts have none."""
    return lexed_declarations(files, key, text, language).select(key, "kind", "name", "holder", "start_line", "end_line")

"""Code review: diffs, regex findings, metrics and reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.values import EFFORT_DEBT, SEVERITY_DEBT, looked_up
from mnemospark.session import materialize

# Rule, engine, severity, effort, confidence and patterns of the analysis.
RULES = (
    ("CWE-78", "security", "BLOCKER", "LOW", 90, (r"execSync\s*\([^)]*\$\{[^}]*\}", r"spawn\s*\([^)]*\+[^)]*\)", r"`[^`]*\$\{[^}]*\}[^`]*")),
    ("CWE-89", "security", "BLOCKER", "MEDIUM", 85, (r"query\s*\([^)]*\+[^)]*\)", r"(?i)SELECT[^;]*\$\{[^}]*\}", r"(?i)INSERT[^;]*\+[^;]*VALUES")),
    ("CWE-79", "security", "CRITICAL", "LOW", 80, (r"innerHTML\s*=\s*[^;]*\+", r"document\.write\s*\([^)]*\+", r"outerHTML\s*\+=\s*[^;]*\$")),
    ("CWE-798", "security", "CRITICAL", "LOW", 95, (r"""(?i)(api[_-]?key|password|secret|token)\s*[:=]\s*['"][^'"]{8,}['"]""",)),
    ("CWE-326", "security", "MAJOR", "MEDIUM", 90, (r"(?i)(md5|sha1|des|rc4)\s*\(",)),
    ("complexity", "performance", "MAJOR", "MEDIUM", 85, (r"for\s*\([^{]*\{[^}]*for\s*\(", r"while\s*\([^{]*\{[^}]*while\s*\(")),
    ("async-pattern", "performance", "MAJOR", "LOW", 95, (r"readFileSync|writeFileSync|execSync|statSync", r"\.sync\(\)")),
    ("memory-usage", "performance", "MINOR", "MEDIUM", 70, (r"JSON\.(parse|stringify)\([^)]{100,}\)",)),
    ("algorithm-efficiency", "performance", "MAJOR", "MEDIUM", 80, (r"for\s*\([^{]*\{[^}]*\.find\s*\(",)),
    ("naming-convention", "maintainability", "MINOR", "LOW", 80, (r"(?:let|const|var)\s+([a-hl-z])\s*[=;]",)),
    ("method-length", "maintainability", "MINOR", "HIGH", 95, (r"function\s+\w+[^{]*\{[\s\S]{1500,}\}", r"\w+\s*=>\s*\{[\s\S]{1500,}\}")),
    ("error-handling", "reliability", "MAJOR", "LOW", 85, (r"async\s+function[^{]*\{(?:(?!try|catch)[^}])*\}",)),
    ("resource-management", "reliability", "MAJOR", "LOW", 75, (r"\.(open|connect|createReadStream|createWriteStream)\((?![\s\S]*(?:\.close\(\)|\.end\(\)))",)),
)
FINDING = "array<struct<rule:string,engine:string,severity:string,effort:string,confidence:int,line:int,match:string>>"


def _matches(text: Column, pattern: str, rule: str, engine: str, severity: str, effort: str, confidence: int) -> Column:
    """A finding for each match of a pattern, with the line it begins on.

    The line follows from the texts before and within the earlier matches:
    what ``split`` leaves between them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern)
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))

    def one(m: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(between, F.lit(1), i + 1), F.lit(0), lambda s, x: s + breaks(x))
        inside = F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda s, x: s + breaks(x))
        level = F.when((F.lit(rule) == "method-length") & (breaks(m) >= 100), F.lit("MAJOR")).otherwise(F.lit(severity))
        shown = F.regexp_replace(m, """['"][^'"]*['"]""", '"[REDACTED]"') if rule == "CWE-798" else m
        return F.struct(
            F.lit(rule).alias("rule"), F.lit(engine).alias("engine"), level.alias("severity"), F.lit(effort).alias("effort"),
            F.lit(confidence).alias("confidence"), (before + inside + 1).cast("int").alias("line"), shown.alias("match"),
        )

    return F.transform(found, one)


def findings(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """A row per finding of the regex rules, and of complexity, null safety and repeated lines; files of one text are looked at once."""
    key = F.unhex(F.md5(text))
    texts = materialize(files.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct(), "file-texts")
    found = materialize(_findings_of(texts.select(F.unhex(F.md5("text")).alias("_text"), "text")), "text-findings")
    return files.select(F.col(path).alias("path"), key.alias("_text")).join(found, "_text").drop("_text")


def _findings_of(files: DataFrame, path: str = "_text", text: str = "text") -> DataFrame:
    c = F.col(text)
    parts = [_matches(c, p, r, e, s, f, n) for r, e, s, f, n, patterns in RULES for p in patterns]
    safe = c.contains("?.") | c.contains("null") | c.contains("undefined")
    loose = F.slice(_matches(c, r"\b[A-Za-z_]\w*\.\w+(?![\w]*\s*\?)", "null-safety", "reliability", "MINOR", "LOW", 60), 1, 3)
    parts.append(F.when(~safe, loose).otherwise(F.array().cast(FINDING)))
    heads = _matches(c, r"function\s+\w+[^{]*\{[^}]*\}|const\s+\w+\s*=\s*\([^)]*\)\s*=>\s*\{[^}]*\}", "cyclomatic-complexity", "maintainability", "MINOR", "HIGH", 90)
    branches = lambda x: F.regexp_count(x["match"], F.lit(r"if|else if|while|for|catch|case|&&|\|\|")) + 1
    parts.append(F.transform(F.filter(heads, lambda x: branches(x) > 10), lambda x: x.withField("severity", F.when(branches(x) > 20, "MAJOR").otherwise("MINOR"))))
    rows = files.select(path, F.explode(F.concat(*[p.cast(FINDING) for p in parts])).alias("f")).select(path, "f.*")
    again = repeated_lines(files, path, text).select(
        path, F.lit("code-duplication").alias("rule"), F.lit("maintainability").alias("engine"), F.lit("MINOR").alias("severity"),
        F.lit("MEDIUM").alias("effort"), F.lit(80).alias("confidence"), F.col("first_line").cast("int").alias("line"), F.col("line").alias("match"),
    )
    return rows.unionByName(again)


def lines_of(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos from 1, line)."""
    return files.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def repeated_lines(files: DataFrame, key: str, text: str, longer_than: int = 50) -> DataFrame:
    """(key, line, n, first_line) of trimmed lines that a file has twice or more."""
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    long = lines_of(files, key, text).select(key, "pos", trimmed.alias("line")).where(F.length("line") > longer_than)
    return long.groupBy(key, "line").agg(F.count("*").alias("n"), F.min("pos").alias("first_line")).where("n > 1")


def duplicated_share(files: DataFrame, key: str, text: str) -> DataFrame:
    """Percentage of lines in three-line shingles that occur again in any file; a row.

    Two lines make the last shingle of a file; shingles need 15 characters that
    aren't blank. Occurrences beyond the first count with their lines.
    """
    order = Window.partitionBy(key).orderBy("pos")
    lines = lines_of(files, key, text).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    lines = lines.withColumns({"b": F.lead("line", 1).over(order), "c": F.lead("line", 2).over(order)})
    size = F.when(F.col("c").isNotNull(), 3).when(F.col("b").isNotNull(), 2)
    shingles = lines.select(size.alias("size"), F.concat_ws("\n", "line", "b", "c").alias("shingle")).where(size.isNotNull())
    shingles = shingles.where(F.length(F.regexp_replace("shingle", r"\s", "")) >= 15)
    extra = shingles.groupBy("shingle").agg(((F.count("*") - 1) * F.first("size")).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("extra"))
    total = lines.agg(F.count("*").alias("total"))
    share = F.round(F.least(F.lit(100.0), F.col("extra") / F.col("total") * 100), 2)
    return extra.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").select(F.col("extra").cast("long"), "total", F.when(F.col("total") > 0, share).otherwise(0.0).alias("share"))


SEVERITIES = ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO")


def engine_summary(found: DataFrame, top: int = 3) -> DataFrame:
    """(engine, total, a count for each severity, high, top): ``top`` has the worst findings, then by path, line and rule."""
    severity = F.col("severity")
    order = [looked_up(severity, SEVERITY_DEBT).desc(), F.col("path"), F.col("line"), F.col("rule")]
    rank = F.row_number().over(Window.partitionBy("engine").orderBy(*order))
    worst = found.withColumn("rank", rank).where(F.col("rank") <= top)  # each task keeps `top` rows of an engine before the shuffle
    first = worst.groupBy("engine").agg(F.array_sort(F.collect_list(F.struct("rank", "severity", "rule", "path", "line"))).alias("top"))
    counts = found.groupBy("engine").agg(F.count("*").alias("total"), *[F.count_if(severity == s).alias(s.lower()) for s in SEVERITIES])
    return counts.withColumn("high", F.col("blocker") + F.col("critical")).join(first, "engine")


def metrics(found: DataFrame, group: list[str]) -> DataFrame:
    """Ratings, debt and gate of the findings of each group."""
    n = lambda test: F.count_if(test)
    severity, engine = F.col("severity"), F.col("engine")
    counts = found.groupBy(*group).agg(
        F.count("*").alias("n_findings"),
        n(severity == "BLOCKER").alias("blockers"),
        n(severity == "CRITICAL").alias("criticals"),
        n(severity == "MAJOR").alias("majors"),
        n(engine == "maintainability").alias("maintain"),
        n((engine == "reliability") & (severity != "MINOR")).alias("reliable"),
        F.sum(looked_up(severity, SEVERITY_DEBT) * looked_up(F.col("effort"), EFFORT_DEBT)).alias("debt_hours"),
    )
    debt = F.least(F.lit(50), 2 * F.col("n_findings"))
    return counts.select(
        *group, "n_findings", "debt_hours", debt.cast("long").alias("debt_ratio"),
        F.when(F.col("blockers") > 0, "F").when(F.col("criticals") > 0, "D").when(F.col("majors") > 3, "C").otherwise("A").alias("security_rating"),
        F.when(F.col("maintain") > 10, "C").otherwise("A").alias("maintainability_rating"),
        F.when(F.col("reliable") > 5, "C").otherwise("A").alias("reliability_rating"),
        F.when(F.col("blockers") > 0, "FAIL").when((F.col("criticals") > 0) | (debt > 20), "WARNING").otherwise("PASS").alias("gate"),
    )


# Lines of a diff that are not of a file.
HUNK = re.compile(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", re.A)
META = re.compile(r"diff --git |index |--- |\+\+\+ |similarity |rename |new file|deleted file|\\")
NAMES = re.compile(r"diff --git a/([^\n\r\x85\u2028\u2029]*) b/([^\n\r\x85\u2028\u2029]*)(?=[\r\x85\u2028\u2029]?\Z)")


def parsed_diff(text: str) -> Iterator[tuple[str | None, int, str, int | None, str]]:
    """(file, hunk, kind, number, line) of a unified diff's lines."""
    file, hunk, old, new = None, 0, 0, 0
    for line in text.split("\n"):
        if header := HUNK.match(line):
            hunk, old, new = hunk + 1, int(header[1]), int(header[2])
        elif line.startswith("diff --git "):
            names = NAMES.match(line)
            file = names[2] if names else ""
        elif hunk and not META.match(line):
            kind = "added" if line.startswith("+") else "removed" if line.startswith("-") else "context"
            yield file, hunk, kind, old if kind == "removed" else new, line[1:]
            old, new = old + (kind != "added"), new + (kind != "removed")


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, file, hunk, kind, number, line) of the lines in unified diffs, a diff a row.

    Files and hunks are told by their header lines; line numbers run within a hunk,
    added lines by the new file, removed by the old. A diff is read in one pass where
    it is, so no task holds more than a batch of them.
    """
    schema = f"`{key}` {dict(diffs.dtypes)[key]}, file string, hunk bigint, kind string, number int, line string"
    names = [key, "file", "hunk", "kind", "number", "line"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = zip(*rows, strict=True)  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)  # noqa: B023

            for i, one in enumerate(batch.column(1)):
                for line in parsed_diff(one.as_py() or ""):
                    rows.append(line)
                    at.append(i)
                    if len(rows) >= 16384:
                        yield made()
                        rows, at = [], []
            if rows:
                yield made()

    return diffs.select(key, text).mapInArrow(run, schema)


def risk_score(text: Column) -> Column:
    """The number after "Risk score", null if there is none."""
    got = F.regexp_extract(text, r"Risk score[: ]*(\d+)", 1)
    return F.when(got != "", got.cast("int"))


def line_range(text: Column) -> tuple[Column, Column]:
    """First and last line of "12-15" or "12"."""
    first, last = F.regexp_extract(text, r"(\d+)(?:-(\d+))?", 1), F.regexp_extract(text, r"(\d+)(?:-(\d+))?", 2)
    start = F.when(first != "", first.cast("int"))
    return start, F.when(last != "", last.cast("int")).otherwise(start)


def review_patches(reviews: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, path, diff) of a review's diff blocks; one that names no file is ``file-`` and its place."""
    blocks = reviews.select(F.col(key), F.posexplode(F.regexp_extract_all(text, F.lit(r"```diff\n([\s\S]*?)\n```"), 1)).alias("pos", "diff"))
    path = F.regexp_extract("diff", r"(?:---|\+\+\+)\s+[ab]/(.+)", 1)
    return blocks.select(key, "pos", F.when(path != "", path).otherwise(F.concat(F.lit("file-"), F.col("pos").cast("string"))).alias("path"), "diff")


# Marks of severities and categories in a review.
SEVERITY_MARKS = {"\U0001f534": "high", "\U0001f7e1": "medium", "\U0001f535": "low"}
CATEGORY_MARKS = {
    "\U0001f510": "security", "\u26a1": "performance", "\U0001f527": "maintainability", "\U0001f9ea": "testing", "\u2699\ufe0f": "config", "\U0001f441\ufe0f": "observability", "\u2696\ufe0f": "legal",
}


def marked_findings(reviews: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, severity, category, title) of a review's lines that begin with a coloured mark."""
    marks, other = "|".join(SEVERITY_MARKS), "|".join([*CATEGORY_MARKS, "\U0001f3af", "\U0001f4cb"])
    whole = rf"(?:{marks})\s*(?:{other})?\s*([^\n]+)"
    rows = reviews.select(F.col(key), F.posexplode(F.regexp_extract_all(text, F.lit(whole), 0)).alias("pos", "found"))
    severity, category = F.lit(None).cast("string"), F.lit("correctness")
    for mark, name in reversed(SEVERITY_MARKS.items()):
        severity = F.when(F.col("found").contains(mark), name).otherwise(severity)
    for mark, name in reversed(CATEGORY_MARKS.items()):
        category = F.when(F.col("found").contains(mark), name).otherwise(category)
    return rows.select(key, "pos", severity.alias("severity"), category.alias("category"), F.trim(F.regexp_extract("found", whole, 1)).alias("title"))


def review_findings(reviews: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, severity, title, file, start, end) from a review's "### [SEVERITY] title" blocks."""
    blocks = reviews.select(F.col(key), F.posexplode(F.split(text, r"(?m)^(?=### )")).alias("pos", "block"))
    start, end = line_range(F.regexp_extract("block", r"(?i)lines?:?\s*([\d-]+)", 1))
    head = r"^### \[(\w+)\]\s*([^\n]*)"
    return blocks.where(F.col("block").rlike(head)).select(
        key, "pos", F.lower(F.regexp_extract("block", head, 1)).alias("severity"), F.regexp_extract("block", head, 2).alias("title"),
        F.regexp_extract("block", r"(?i)file:\s*`?([^`\n]+)`?", 1).alias("file"), start.alias("start"), end.alias("end"),
    )

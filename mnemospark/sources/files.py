"""Directory scans: each round lists all folders of a depth, in parallel, with the rules of the ignore files found on the way.

Listing runs in tasks through Arrow's file systems, which take local paths and URIs of
object stores and Hadoop alike; Spark's own file index passes over names that begin
with an underscore, as ``__init__.py`` does, and reads no ignore files.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.strings import extension
from mnemospark.session import materialize

# Names of folders, extensions of files and names of files that a scan leaves out.
IGNORED_FOLDERS = """
node_modules .git .vscode dist build coverage target out
.svn .hg .bzr .idea .next .nuxt .parcel-cache .webpack
.cache .expo .direnv .terraform .serverless .aws-sam .nyc_output .cpcache
.pnp .pnpm-store .npm .yarn amplify bin obj debug release .vs
.user .suo .venv venv env __pycache__ .pytest_cache .mypy_cache .ruff_cache
log logs tmp temp
""".split()
IGNORED_EXTENSIONS = """
.txt .log .gitignore .npmignore .editorconfig .gitattributes
.gitmodules .prettierrc .eslintrc .env .sample .example
.lock .map .svg .png .jpg .jpeg .gif .ico
.woff .woff2 .ttf .eot .otf .zip .tar .gz .rar .7z
.pdf .doc .docx .xls .xlsx .ppt .pptx .sqlite .db
.csv .xml .bak .tmp .swp .swo .swn .exe .dll
.obj .lib .bin .out .diff .patch .rej .orig
""".split()
IGNORED_NAMES = """
.DS_Store package-lock.json yarn.lock .npmignore
.env .env.local .env.development .env.production .env.test
.gitignore .gitattributes .editorconfig .prettierrc .eslintrc
Thumbs.db ehthumbs.db desktop.ini npm-debug.log yarn-debug.log yarn-error.log
.project .classpath .settings .factorypath
lerna.json firebase.json netlify.toml vercel.json aws-exports.js
serverless.yml cloudformation.yaml jest.config.js babel.config.js
webpack.config.js rollup.config.js tailwind.config.js postcss.config.js
tsconfig.json jsconfig.json tslint.json nodemon.json
Vagrantfile Makefile CMakeLists.txt Rakefile Gemfile Gemfile.lock
composer.json composer.lock phpcs.xml phpunit.xml pyproject.toml
Pipfile Pipfile.lock requirements.txt .python-version
.terraform.lock.hcl package.json
""".split()
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "php": "php", "html": "html",
    "css": "css", "md": "markdown", "sql": "sql", "jsonl": "jsonl", "json": "json", "java": "java", "go": "go", "rs": "rust",
}
ENTRY = "path string, below string, name string, type string, size bigint, mtime timestamp, rules string, message string"


def language(path):
    ext, out = extension(path), F.lit(None).cast("string")
    for key, value in LANGUAGES.items():
        out = F.when(ext == key, value).otherwise(out)
    return out


def left_out(name: str, folder: bool) -> bool:
    """Names that no scan takes: hidden ones, and those of the lists above."""
    if name.startswith("."):
        return True
    if folder:
        return name in IGNORED_FOLDERS
    dot = name.rfind(".")
    return name in IGNORED_NAMES or (name[dot:].lower() if dot > 0 else "") in IGNORED_EXTENSIONS


def rule_pattern(line: str) -> tuple[bool, str, bool] | None:
    """(takes, pattern of the path below the rule's folder, folders only) of a line of an ignore file; None for a comment.

    ``*`` and ``?`` stay within a name, ``**`` doesn't; a pattern with a slash begins at the
    file's folder, others match any name; one that ends in a slash means folders; ``!`` takes back.
    """
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    body = line.removeprefix("!")
    anchored = "/" in body.rstrip("/")
    made = re.sub(r"\*\*/?|[*?]|[^*?]+", lambda m: {"*": "[^/]*", "?": "[^/]", "**": ".*", "**/": "(?:.*/)?"}.get(m[0], re.escape(m[0])), body.strip("/"))
    return not line.startswith("!"), ("" if anchored else "(?:.*/)?") + made + r"\Z", body.endswith("/")


def ruled_out(below: str, folder: bool, rules: list[tuple[str, str]]) -> bool:
    """Whether the last of the rules (folder of the ignore file, line) that matches a path below the root leaves it out."""
    out = False
    for base, line in rules:
        rule = rule_pattern(line)
        if rule and below.startswith(base) and (folder or not rule[2]) and re.match(rule[1], below[len(base) :], re.S):
            out = rule[0]
    return out


def _rules(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split("\x1f", 1)) for x in text.split("\x1e") if x]


def listed(batches: Iterator[pd.DataFrame], root: str, ignore_file: str | None) -> Iterator[pd.DataFrame]:
    """The entries of each folder (below, rules); a folder that can't be read is a row of type ``error``."""
    store, base = fs.FileSystem.from_uri(root)
    base = base.rstrip("/")
    for batch in batches:
        for below, inherited in zip(batch["below"], batch["rules"], strict=True):
            rows, rules = [], inherited
            try:
                found = sorted(store.get_file_info(fs.FileSelector(f"{base}/{below}".rstrip("/") or "/", recursive=False)), key=lambda f: f.base_name)
                own = next((f for f in found if f.base_name == ignore_file and f.type == fs.FileType.File), None)
                if own:
                    with store.open_input_stream(own.path) as lines:
                        rules += "".join(f"{below}\x1f{line}\x1e" for line in lines.read().decode("utf-8", "replace").splitlines())
                known = _rules(rules)
                for f in found:
                    folder, at = f.type == fs.FileType.Directory, below + f.base_name
                    if not left_out(f.base_name, folder) and not ruled_out(at, folder, known):
                        rows.append((f.path, at + "/" if folder else at, f.base_name, "directory" if folder else "file", None if folder else f.size, f.mtime, rules if folder else "", None))
            except OSError as error:
                rows.append((f"{base}/{below}", below, below.rstrip("/").rpartition("/")[2], "error", None, None, "", str(error)[:500]))
            yield pd.DataFrame(rows, columns=["path", "below", "name", "type", "size", "mtime", "rules", "message"]).astype({"size": "Int64", "mtime": "datetime64[us, UTC]"})


def as_uri(root: str) -> str:
    """A root as Arrow reads it: ``file:/x`` and ``/x`` are local paths, however odd their names."""
    local = re.sub(r"^file:/*", "/", root) if root.startswith("file:") else root
    return local if local.startswith("/") else root


def scan_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, ignore_file: str | None = None, depth: int = 1 << 20) -> DataFrame:
    """(path, below, name, type, size, mtime, message): files, folders and unreadable folders below a root, to a depth.

    ``ignore`` has lines that count for the whole tree; files named ``ignore_file`` count
    for their folder and those below it, where later and deeper rules win. A folder that is
    left out is not entered. Each depth is a round, whose folders are dealt to tasks.
    """
    place = as_uri(root)
    rules = "".join(f"\x1f{line}\x1e" for line in ignore or [])
    folders = spark.createDataFrame([("", rules)], "below string, rules string")
    tasks, out = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    for level in range(depth):
        spread = folders if level == 0 else folders.repartition(tasks, "below")
        found = materialize(spread.mapInPandas(lambda b: listed(b, place, ignore_file), ENTRY), "listing")
        out = found if out is None else out.unionByName(found)
        folders = found.where("type = 'directory'").select("below", "rules")
        if folders.isEmpty():
            break
    return out.drop("rules")


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """Files with their ``content`` as text, read in tasks; what can't be read is null."""
    place = as_uri(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(place)
        for batch in batches:
            for i in range(len(batch)):  # a file at a time, as files may be large
                row = batch.iloc[i : i + 1].copy()
                try:
                    with store.open_input_stream(row["path"].iloc[0]) as f:
                        row["content"] = f.read().decode("utf-8", "replace")
                except OSError:
                    row["content"] = None
                yield row

    return files.mapInPandas(run, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in files.schema], "content string"]))


def scan_folder(spark: SparkSession, root: str, glob: str | None = None, with_content: bool = False, **rules) -> DataFrame:
    """(path, name, type, language, size, mtime) of the files below a folder, ignored ones left out; ``rules`` as in ``scan_tree``."""
    found = scan_tree(spark, root, **rules).where("type = 'file'")
    if glob:
        found = found.where(F.col("name").rlike(fnmatch.translate(glob).replace("(?>", "(?:").replace(r"\Z", r"\z")))
    out = found.select("path", "name", "type", language("path").alias("language"), "size", "mtime")
    return read_contents(out, root) if with_content else out


def search_files(spark: SparkSession, root: str, glob: str, max_bytes: int = 1 << 20, depth: int = 15, ignore: list[str] | None = None, ignore_file: str | None = None) -> DataFrame:
    """Files by name pattern, size and depth below the root, the newest and then the smallest first; ``ignore`` has lines of an ignore file."""
    found = scan_folder(spark, root, glob, depth=depth, ignore=ignore, ignore_file=ignore_file).where(F.col("size") <= max_bytes)
    return found.orderBy(F.col("mtime").desc(), "size", "path")

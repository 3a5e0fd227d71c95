"""Declarations and statements: cases that patterns get wrong, and texts at random within strings, templates and comments."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import lexers


def read(text, language="script"):
    return [(d.kind, d.name, d.holder, d.start_line, d.end_line) for d in lexers.Reader(text, language).read()]


def test_braces_within_texts_move_nothing():
    assert read("class C {\n  m() { return '{'; }\n  n() {}\n}\nfunction f() {}") == [("class", "C", None, 1, 4), ("method", "m", "C", 2, 2), ("method", "n", "C", 3, 3), ("function", "f", None, 5, 5)]
    assert read("class D { a(){} b(x){} }") == [("class", "D", None, 1, 1), ("method", "a", "D", 1, 1), ("method", "b", "D", 1, 1)]
    assert read("export default function() {}\nimport './side'\nlet re = /[{]/g, q = 1 / 2;") == [("function", "default", None, 1, 1), ("import", "./side", None, 2, 2), ("variable", "re", None, 3, 3), ("variable", "q", None, 3, 3)]
    assert read("const s = `a ${ `b ${'}'} {` } {`\nfunction g() {}") == [("variable", "s", None, 1, 1), ("function", "g", None, 2, 2)]
    assert read("// class A {\n/* function b() {\n*/ enum E { X }") == [("enum", "E", None, 3, 3)]
    assert read("") == read("{{{") == read("}}}") == [] and read("class") != None  # noqa: E711


def test_parameters_types_and_calls():
    found = {d.name: d for d in lexers.Reader("export const one = async (a: Map<string, X>, {b, c}: P = {}, ...r: T[]): Promise<void> => {\n  foo.bar(a); new Baz(1); if (x) { y?.(); }\n  function inner() { z(); }\n}\nconst two = x => x", "script").read()}
    assert found["one"].parameters == [("a", "Map<string, X>"), ("{b, c}", "P"), ("r", "T[]")] and found["one"].returns == "Promise<void>"
    assert found["one"].exported and found["one"].is_async and found["one"].calls == ["foo.bar", "new Baz", "y"] and found["inner"].calls == ["z"]
    assert found["two"].parameters == [("x", "")] and not found["two"].exported


def test_imports():
    text = "import a, {b as c} from 'm';\nimport type {T} from \"t\";\nexport * from './all';\nexport {x} from './x';\nconst l = () => import('./lazy');\nexport {y};\nconst from = 'no';"
    assert [n for k, n, *_ in read(text) if k == "import"] == ["m", "t", "./all", "./x", "./lazy"]


def test_php():
    text = "<p>class No {</p><?php\nnamespace A\\B;\nuse Lib\\Base;\nfinal class P extends Q {\n use SomeTrait;\n public static function run(?int $a, array &$b = []): int {\n$x = <<<EOT\n} class {\nEOT;\n $f = function ($y) use ($x) { return g($y); };\n $this->go(); F::h();\n }\n abstract function z();\n}\nfunction f() {} # }\n?> { <?php require 'x.php'; ?>"
    assert read(text, "php") == [("namespace", "A\\B", None, 2, 2), ("import", "Lib\\Base", None, 3, 3), ("class", "P", None, 4, 14), ("method", "run", "P", 6, 12), ("method", "z", "P", 13, 13), ("function", "f", None, 15, 15), ("import", "x.php", None, 16, 16)]
    run = next(d for d in lexers.Reader(text, "php").read() if d.name == "run")
    assert run.parameters == [("$a", "?int"), ("$b", "array")] and run.returns == "int" and run.calls == ["g", "$this->go", "F::h"]


@pytest.mark.parametrize("seed", range(5))
def test_random_texts_hide_nothing(seed):
    """Declarations around random texts of signs are found where they stand, whatever the texts hold."""
    rng = random.Random(seed)
    lines, want = [], []
    for i in range(60):
        junk = "".join(rng.choice("{}[]()'\"`/\\*$;,: \nclass function x") for _ in range(rng.randint(0, 40)))
        form = rng.randint(0, 3)
        if form == 0:
            lines.append(f"call({json.dumps(junk)});")
        elif form == 1:
            lines.append("/*" + junk.replace("*", "-") + "*/")
        elif form == 2:
            lines.append("call(`" + junk.replace("\\", "\\\\").replace("`", "\\`").replace("${", "\\${") + "`);")
        else:
            lines.append("// " + junk.replace("\n", " "))
        at = "\n".join(lines).count("\n") + 2
        lines.append(f"function f{i}() {{\n}}")
        want.append(("function", f"f{i}", None, at, at + 1))
    assert read("\n".join(lines)) == want


def test_statements():
    script = """-- x; y
CREATE TABLE IF NOT EXISTS t1 (id INT PRIMARY KEY, `price` DECIMAL(10, 2) NOT NULL DEFAULT (1,2), name VARCHAR(20) REFERENCES n(nm), FOREIGN KEY (id, b) REFERENCES u(id, c), plain);
INSERT INTO "my t" (a, b) VALUES ('x; (y''', 2), (3, 4); UPDATE t1 SET a = (select max(x) from q), b = 2 WHERE c = 3;
CREATE UNIQUE INDEX ix ON t1 (a, b DESC); CREATE VIEW v AS WITH z AS (SELECT * FROM a) SELECT * FROM z, b AS bb, c JOIN d ON 1=1;
CREATE TRIGGER tr AFTER INSERT ON t1 BEGIN UPDATE q SET a = CASE WHEN 1 THEN 2 END; DELETE FROM r; END; DELETE FROM t1 WHERE id IN (SELECT id FROM gone); DROP TABLE IF EXISTS old; ALTER TABLE t1 ADD COLUMN z TEXT; select 1"""
    found = lexers.statements(script)
    assert [(s.kind, s.name, s.line) for s in found] == [
        ("create_table", "t1", 2), ("insert", "my t", 3), ("update", "t1", 3), ("create_index", "ix", 4), ("create_view", "v", 4), ("create_trigger", "tr", 5), ("delete", "t1", 5), ("drop_table", "old", 5), ("alter_table", "t1", 5), ("select", "", 5),
    ]
    assert found[0].columns == [(0, "id", "INT"), (1, "price", "DECIMAL(10, 2)"), (2, "name", "VARCHAR(20)"), (4, "plain", "")]
    assert found[0].references == [("name", "n", "nm"), ("id", "u", "id"), ("b", "u", "c")]
    assert [[n for _, n, _ in s.columns] for s in found[1:4]] == [["a", "b"]] * 3
    assert [s.tables for s in found[2:7]] == [["q"], [], ["a", "b", "c", "d"], ["r"], ["gone"]] and found[8].columns == [(0, "z", "TEXT")]
    assert lexers.statements("") == [] and lexers.statements(";;") == []


def test_null_and_broken_files(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "class A { m() {"), (4, "'unclosed"), (5, "`${"), (6, "CREATE TABLE"), (7, "INSERT INTO t (")], "id int, text string")
    assert {(r["id"], r["name"], r["end_line"]) for r in lexers.lexed_declarations(rows, "id", "text").collect()} == {(3, "A", 1), (3, "m", 1)}
    assert {r["id"] for r in lexers.sql_statements(rows, "id", "text").where(F.col("kind") == "insert").collect()} == {7}
    lexers.lexed_declarations(rows, "id", "text", "php").collect()

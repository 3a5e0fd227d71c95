"""Queries that return every row of their job, against brute force."""

import os
import random
import re

import pytest

import __spark_entry__ as entry
from mnemospark.operators import search

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name, column, rank", [("all_findings_by_severity", "severity", {"R": "high", "A": "low"}), ("all_findings_by_weight", "weight", {"R": 5, "A": 3})])
def test_all_findings_in_order(spark, name, column, rank):
    rest = "medium" if column == "severity" else 2
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").collect()
    want = sorted((r[0], r[1], r[2], rank.get(r[3], rest)) for r in lines)
    want.sort(key=lambda r: r[3], reverse=True)
    made = entry.queries()[name](spark, SF)
    assert made.columns[3] == column and [tuple(r) for r in made.collect()] == want


WORD = r"(?<![a-zA-Z0-9_])({})(?![a-zA-Z0-9_])"
CODE, PROSE = (re.compile(WORD.format(w), re.I | re.A) for w in ("function|class|const|let|var|if|for|while|return|import|export", "the|and|or|but|in|on|at|to|for|of|with|by"))
ODD = ["éfor école for naïve_for FOR ñ", "größe let über var Straße const", "\u00a0\u3000// für", "\ufeff* x", "ÉTÉ\u00a0été İx K", "", None, "the or and\u2003but \u0130f for", "if éif ifé for"]


def kind(text):
    head = (text or "").lstrip(" \t\n\r\v\f\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B))))
    if head.startswith(("//", "/*", "*")):
        return "comment"
    return "code" if len(CODE.findall(text or "")) > 2 and len(PROSE.findall(text or "")) <= 3 else "documentation"


def n_tokens(text):
    return None if text is None else len(re.sub(r"[^a-z0-9_\s]", " ", text.lower()).split())


@pytest.fixture(scope="module")
def all_docs(spark, tmp_path_factory):
    """The table's documents in all languages, and odd texts with other languages or none."""
    place = str(tmp_path_factory.mktemp("languages"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1_000_000 + i, text, ("fr", "ja", None)[i % 3]) for i, text in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{place}/documents.parquet")
    return place, rows


@pytest.mark.parametrize("name, want", [("token_counts", n_tokens), ("content_routing", kind)])
def test_all_languages(spark, all_docs, name, want):
    place, rows = all_docs
    assert len({lang for *_, lang in rows}) > 4
    made = {r[0]: r[1] for r in entry.queries()[name](spark, place).collect()}
    assert made == {doc_id: want(text) for doc_id, text, _ in rows}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expanded(found):
    """Every pair of alike keys that classes and their links stand for."""
    group, links = {}, []
    for kind, a, b, _ in found:
        if kind == "member":
            group.setdefault(a, {a}).add(b)
        else:
            links.append((a, b))
    pairs = {(x, y) for g in group.values() for x in g for y in g if x < y}
    return pairs | {(min(x, y), max(x, y)) for a, b in links for x in group.get(a, {a}) for y in group.get(b, {b})}


def alike(names, least):
    return {(x, y) for x in names for y in names if x < y and names[x] and names[y] and 1 - distance(names[x], names[y]) / max(len(names[x]), len(names[y])) >= least}


@pytest.mark.parametrize("least", [0.5, 0.7, 0.9])
def test_similar_names_lose_no_link(spark, least):
    dice = random.Random(7)
    words = ["".join(dice.choice("abé") for _ in range(n % 14)) for n in range(60)]
    for word in words[20:]:  # near copies
        at = dice.randrange(len(word) + 1)
        words.append(word[:at] + dice.choice(["", "b", "xy"]) + word[at + dice.randrange(3) :])
    names = dict(enumerate([*words, *words[:9], None, "", "a"]))
    rows = spark.createDataFrame(list(names.items()), "id bigint, name string")
    made = [tuple(r) for r in search.similar_names(rows, "id", "name", least).collect()]
    assert len(set(made)) == len(made) and expanded(made) == alike(names, least)


def test_similar_names_of_all_parts(spark):
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = alike(names, 0.7)
    assert any(x % 100 and y % 100 for x, y in want)
    assert expanded([tuple(r) for r in entry.queries()["similar_names"](spark, SF).collect()]) == want


def test_near_duplicates_tell_every_document_of_a_word_set(spark, tmp_path):
    """Different texts of the same words, and copies, were one class of which only the first was told."""
    import duckdb

    many = [f"word{i}" for i in range(40)]
    texts = [" ".join(many), " ".join(reversed(many)), " ".join(many).upper() + "!", " ".join(many[:-2]), " ".join([*many, "word0", "a"]), "red green", "green; red", "blue", "a b", "", None, "été noël", "noël été", " ".join(many)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    made = entry.queries()["near_dup_jaccard"](spark, str(tmp_path))
    got = sorted((r["kind"], r["a"], r["b"], r["similarity"]) for r in made.collect())
    assert got == [*(("member", 0, b, 1.0) for b in (1, 2, 4, 13)), ("member", 5, 6, 1.0), ("member", 11, 12, 1.0), ("similar", 0, 3, 0.95)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT kind, a, b, similarity FROM ({entry.oracle_sql()['near_dup_jaccard']})").fetchall()) == got

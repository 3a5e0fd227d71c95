"""Operators that do the expensive part once a class, or by matrix products, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions.vectors import cosine, l2
from mnemospark.operators import blocks, search

ODD = [None, [], [0.0, 0.0, 0.0], [0.5, -0.5], [0.5, None, 1.0]]


@pytest.fixture(scope="module")
def vectors(spark):
    pick = random.Random(5)
    some = [[pick.gauss(0, 1) for _ in range(3)] for _ in range(40)]
    rows = [(i, ODD[i] if i < len(ODD) else some[i % 40]) for i in range(160)]  # copies of all
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").cache()


@pytest.mark.parametrize("distance", [True, False])
def test_best_rows_of_odd_vectors(spark, vectors, monkeypatch, distance):
    for name, n in (("QUERIES", 20), ("CHUNK", 7), ("STEP", 11), ("PAIRS", 13)):
        monkeypatch.setattr(blocks, name, n)
    queries = vectors.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    score = (l2 if distance else cosine)(F.col("embedding"), F.col("query_vector"))
    pairs = queries.crossJoin(vectors).where("query_id <> vec_id").withColumn("score", score)
    want = search.top_per_query(pairs, "query_id", [F.col("score").asc_nulls_last() if distance else F.round("score", 9).desc(), F.col("vec_id")], 9)
    got = blocks.best_rows(queries, vectors, 9, distance)
    told = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))
    assert told(got) == told(want) and len(told(want)) == 40 * 9
    assert "levenshtein" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan and "Cartesian" not in plan


def test_hits_above_a_cosine(spark, vectors):
    queries = vectors.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    pairs = queries.crossJoin(vectors).where("query_id <> vec_id").withColumn("score", cosine(F.col("embedding"), F.col("query_vector"))).where("score > 0.2")
    want = {r["vec_id"]: (r["score"], r["hits"]) for r in pairs.groupBy("vec_id").agg(F.max("score").alias("score"), F.count("*").alias("hits")).collect()}
    got = {r["vec_id"]: (r["score"], r["hits"]) for r in blocks.hits_above(queries, vectors, 0.2).collect()}
    assert got.keys() == want.keys() and want
    assert all(math.isclose(got[k][0], want[k][0], abs_tol=1e-12) and got[k][1] == want[k][1] for k in want)


NAMES = ["red bolt", "red bold", "hot gear", "", None, "hot gears", "a", "ab", "red bolt"]


@pytest.mark.parametrize("block_rows", [2000, 3])
def test_name_links_by_distinct_names(spark, block_rows):
    rows = spark.createDataFrame([(i, NAMES[i % len(NAMES)]) for i in range(60)], "id bigint, name string")
    queries = rows.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("name").alias("wanted"))
    score = search.similarity("wanted", "name")
    want = sorted(map(tuple, queries.join(rows, score >= 0.7).select("query_id", "id", score).collect()))
    got = search.name_links(queries, rows, "wanted", "name", 0.7, block_rows)
    assert sorted(map(tuple, got.select("query_id", "id", "score").collect())) == want and want
    assert "levenshtein" not in got._jdf.queryExecution().toString()  # rows meet by equal names


def test_best_of_classes_scores_classes_once(spark):
    rows = spark.createDataFrame([(i, NAMES[i % len(NAMES)], i % 2 == 0) for i in range(60)], "id bigint, name string, dear boolean")
    queries = rows.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("name").alias("wanted"))
    points = lambda df: df.withColumn("score", F.coalesce(search.similarity("wanted", "name"), F.lit(0.0)) + F.col("dear").cast("int"))
    pairs = points(queries.join(rows, F.col("query_id") != F.col("id")))
    want = search.top_per_query(pairs, "query_id", [F.col("score").desc(), F.col("id")], 1).select("query_id", "id", "score")
    sizes = []

    def scored(wishes, classes):
        made = points(wishes.crossJoin(classes))
        sizes.append(made.count())
        return made

    got = search.best_of_classes(queries, rows, ["wanted"], ["name", "dear"], scored)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 15
    assert sizes == [8 * 16]


def test_findings_look_at_a_text_once(spark):
    from mnemospark.operators import review

    texts = ["md5 (x)", "nothing", "let z = 1\nlet y = 2", None, ("x" * 60 + "\n") * 2]
    files = spark.createDataFrame([(f"p{i}", texts[i % 5]) for i in range(100)], "path string, content string")
    found = review.findings(files)
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()  # the patterns ran before, on distinct texts
    got = {}
    for r in found.collect():
        got.setdefault(r["path"], []).append((r["rule"], r["line"]))
    want = {0: [("CWE-326", 1)], 2: [("naming-convention", 1), ("naming-convention", 2)], 4: [("code-duplication", 1)]}
    assert {k: sorted(v) for k, v in got.items()} == {f"p{i}": want[i % 5] for i in range(100) if i % 5 in want}


@pytest.mark.parametrize("name", ["php_declarations", "script_declarations", "table_columns", "question_names"])
def test_small_files_are_dealt_before_python(spark, name):
    import __spark_entry__ as entry

    made = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    python = max(plan.find(x) for x in ("MapInPandas", "ArrowEvalPython"))
    assert 0 <= python < plan.find("REPARTITION_BY_NUM")  # below the Python step


@pytest.mark.parametrize(("least", "frequent"), [(0.85, 200_000), (0.6, 3), (0.5, 0), (1.0, 5)])
def test_similar_sets_by_all_pairs(spark, monkeypatch, least, frequent):
    from mnemospark.operators import retrieval

    monkeypatch.setattr(retrieval, "FREQUENT", frequent)
    pick, words = random.Random(3), [f"w{i}" for i in range(60)]
    sets = [set(pick.sample(words, pick.randint(1, 40))) for _ in range(40)]
    sets += [(s - set(pick.sample(sorted(s), min(len(s) - 1, pick.randint(0, 3))))) | {pick.choice(words)} for s in sets for _ in range(3)] + [set()]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, words array<string>")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    ids = sorted(i for s, i in first.items() if s)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}
    assert {(r["a"], r["b"]): r["similarity"] for r in retrieval.similar_sets(rows, "id", least).collect()} == pytest.approx(want)
    assert bool(want) == (least < 1)


def test_unlike_sets_of_a_common_word_are_told_apart_in_the_join(spark):
    """Sets that share a few words never reach the comparison, which carries whole sets."""
    from mnemospark.operators import retrieval

    pick = random.Random(9)
    rows = spark.createDataFrame([(i, sorted(f"w{j}" for j in pick.sample(range(200), 30))) for i in range(150)], "id bigint, words array<string>")
    found = retrieval.similar_sets(rows, "id")
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 0


def _set_rows(spark):
    pick = random.Random(11)
    sets = [set(pick.sample([f"w{i}" for i in range(4000)], 300)) for _ in range(6)]
    sets += [s - set(pick.sample(sorted(s), 20)) for s in sets[:3] for _ in range(12)] + [{"a\nb", "a\\nb", "", "c"}, {"a", "b", "\\nb", "", "c"}]
    return sets, spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, words array<string>")


@pytest.mark.parametrize(("words", "pairs", "dense"), [(4_000_000, 2_000_000, 1000), (900, 5, 1), (4_000_000, 3, 0)])
def test_sets_meet_at_places_where_each_is_sent_once(spark, monkeypatch, words, pairs, dense):
    """Sets went along with every pair, twice; disk grew with the pairs times their words."""
    from mnemospark.operators import retrieval

    for name, n in (("GROUP_WORDS", words), ("GROUP_PAIRS", pairs), ("DENSE", dense)):
        monkeypatch.setattr(retrieval, name, n)
    sets, rows = _set_rows(spark)
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.85 * len(a | b)}
    found = retrieval.similar_sets(rows, "id")
    assert {(r["a"], r["b"]): r["similarity"] for r in found.collect()} == pytest.approx(want) and len(want) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "array_intersect" not in plan  # no row holds a pair's sets


def test_greedy_dedup_stores_and_shuffles_packed_sets_once(spark, monkeypatch):
    """Whole sets were grouped and stored twice, as arrays, and went along with every pair; rows without a text were lost."""
    from mnemospark.operators import context, retrieval

    stored = []

    def told(df, name, **options):
        stored.append((name, [n for n, kind in df.dtypes if kind in ("array<string>", "string")]))
        return materialize(df, name, **options)

    from mnemospark.session import materialize

    for module in (context, retrieval):
        monkeypatch.setattr(module, "materialize", told)
    rows = spark.createDataFrame([(0, None, 5), (1, "the same words", 3), (2, "words same the", 4), (3, "others entirely", 9), (4, "", 1)], "id int, t string, s int")
    assert sorted(r["id"] for r in context.greedy_dedup(rows, "id", "t", "s").collect()) == [0, 2, 3, 4]
    assert [texts for _, texts in stored if texts] == [["words"]]
    assert not any(name == "set-classes" for name, _ in stored)

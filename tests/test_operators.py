"""Golden rows and brute force for the reference operators."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemospark.functions import strings, values, vectors
from mnemospark.operators import chunks, graph, parsers, retrieval, review, search
from mnemospark.operators import events as ev
from mnemospark.plans import dsl, questions
from mnemospark.sources import files, logs, sinks
from mnemospark.streaming import event_stream


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


NODES = """{"id":"n1","name":"src/util.ts","entityType":"file","observations":["absolute_path: /p/src/util.ts","language: typescript"],"timestamp":1000,"version":1,"accessCount":3}
{"id":"n2","name":"src/util.ts::parse","entityType":"function","observations":["defined_in_file_path: src/util.ts","exported: yes"],"timestamp":2000,"version":1,"accessCount":9}
{"id":"n3","name":"src/app.ts","entityType":"file","timestamp":3000,"version":1,"accessCount":0}
{"id":"n4","name":"src/app.test.ts","entityType":"file","observations":[],"timestamp":4000,"version":1,"accessCount":1}

{"id":
{"id":"n2","name":"src/util.ts::parse","entityType":"function","timestamp":5000,"version":2,"deleted":true}
{"id":"n2","name":"src/util.ts::parse","entityType":"function","observations":["defined_in_file_path: src/util.ts","exported: yes","hot path"],"timestamp":5000,"version":3,"deleted":false,"accessCount":9}
{"id":"n5","name":"lodash","entityType":"module","observations":["type: module"],"timestamp":6000,"version":1}
{"id":"n5","name":"lodash","entityType":"module","timestamp":7000,"version":2,"deleted":true}
"""


@pytest.fixture(scope="module")
def nodes(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kg") / "nodes.jsonl"
    path.write_text(NODES)
    read = logs.read_json_lines(spark, f"file://{path}", logs.NODE)
    assert read.count() == 8
    return ev.live(read).withColumnRenamed("entityType", "entity_type").withColumnRenamed("accessCount", "access_count")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("n3", "n1", "imports_file"), ("n2", "n1", "defined_in_file"), ("n3", "nX", "imports_module"), ("nX", "n4", "imports_file"), ("n1", "n3", "imports_file")]
    return spark.createDataFrame(rows, "src string, dst string, kind string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_live_rows_and_missing_file(spark, nodes):
    assert ids(nodes) == ["n1", "n2", "n3", "n4"]
    assert nodes.where("id = 'n2'").first()["version"] == 3
    assert ids(ev.live(nodes.withColumn("_pos", F.lit(1)))) == ids(nodes)
    assert logs.read_json_lines(spark, "file:///no/such/file", logs.NODE).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("operator:OR", []),
        ("operator:AND", ["n1", "n2", "n3", "n4"]),
        ("file:util", ["n1", "n2", "n3", "n4"]),
        ("entitytype:FILE name:app", ["n3", "n4"]),
        ("entitytype:file operator:NOT", ["n2"]),
        ("defined_in_file_path:src/util", ["n2"]),
        ("entitytype:function id:n1 operator:OR", ["n1", "n2"]),
        ("typescript", ["n1"]),
        ("", ["n1", "n2", "n3", "n4"]),
        ('name:"app.test"', ["n4"]),
        ("name:utl fuzzy:true similarity:0.7", ["n1", "n2"]),
        ("entitytype:file limit:2", ["n1", "n3"]),
        ("hot path", ["n2"]),
    ],
)
def test_query_language(nodes, text, want):
    assert ids(dsl.execute(text, nodes)) == want


def test_query_forms(nodes):
    assert dsl.parse("https://x.y").form == "complex" and dsl.parse("https://x.y").conditions == (("obs", "https://x.y"),)
    assert dsl.parse("traverse:a b:both:3:x, y").kinds == ("x", "y")
    ranked = dsl.execute("rank:parse:relevance", nodes).collect()
    assert [(r["id"], r["score"]) for r in ranked] == [("n2", 10.0), ("n1", 0.0), ("n3", 0.0), ("n4", 0.0)]
    assert [r["id"] for r in dsl.execute("rank:x:popularity", nodes).collect()] == ["n2", "n1", "n4", "n3"]
    assert [r["id"] for r in dsl.execute("rank:x:recency", nodes, now=5000 + 86_400_000).collect()][0] == "n2"
    assert ids(dsl.structured(nodes, only_tests=True)) == ["n4"]


def test_traversal(nodes, edges):
    assert {(r["id"], r["depth"]) for r in graph.bfs(edges, nodes.where("id = 'n3'"), 2).collect()} == {("n3", 0), ("n1", 1), ("nX", 1), ("n4", 2)}
    assert ids(dsl.execute("traverse:src/app.ts:outgoing:2", nodes, edges)) == ["n1", "n3", "n4"]
    assert ids(graph.bfs(edges, nodes.where("id = 'n3'"), 2, live=nodes)) == ["n1", "n3"]
    assert graph.neighbourhood_edges(nodes, edges, "src/app.ts", 2).count() == 3
    assert ids(graph.inbound_sources(nodes, edges, nodes.where("id = 'n1'"), "imports_file")) == ["n3"]
    assert ids(graph.bfs(edges, nodes.where("id = 'n1'"), 9, "both")) == ["n1", "n2", "n3", "n4", "nX"]
    assert graph.bfs(edges, nodes.where("name = 'none'"), 3).count() == 0
    assert graph.mermaid(edges, nodes).count() == 3


def test_resolution_of_names(spark, nodes):
    wanted = spark.createDataFrame([("src/app.ts",), ("x.ts::src/app.ts",), ("Other::PARSE",), ("nothing",)], "wanted string")
    got = {r["wanted"]: (r["id"], r["strategy"]) for r in graph.resolve_names(wanted, nodes).collect()}
    assert got == {"src/app.ts": ("n3", "exact"), "x.ts::src/app.ts": ("n3", "file_prefix"), "Other::PARSE": ("n2", "folded_member")}


def test_imports(spark):
    there = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",)], "path string")
    asked = spark.createDataFrame([("m", "src/a.js"), ("m", "src/b"), ("m", "lodash")], "src string, target string")
    assert {tuple(r) for r in graph.import_edges(there, asked).collect()} == {("m", "src/a.ts", "imports_file"), ("m", "src/b/index.ts", "imports_file"), ("m", "lodash", "imports_module")}


def test_threads(spark):
    rows = spark.createDataFrame([("m1", None), ("m2", "m1"), ("m3", "m2"), ("m4", None), ("m5", "gone")] + [(f"k{i}", f"k{i - 1}" if i else None) for i in range(70)], "id string, parent string")
    got = {r["id"]: (r["root"], r["depth"]) for r in graph.thread_depths(rows).collect()}
    assert got["m3"] == ("m1", 2) and got["m4"] == ("m4", 0) and got["m5"] == ("m5", 0) and got["k69"] == ("k0", 69)


def test_event_log(spark):
    rows = [
        Row(id="e1", timestamp=1704067200000, agentId="a", eventType="NODE_CREATED", payload="{}", metadata=Row(version=1), _pos=0),
        Row(id="e2", timestamp=1704153600000, agentId="a", eventType="RELATION_CREATED", payload="{}", metadata=Row(version=1), _pos=1),
        Row(id="e3", timestamp=1704067300000, agentId="a", eventType="NODE_UPDATED", payload="{}", metadata=Row(version=1), _pos=2),
        Row(id="e1", timestamp=1704153700000, agentId="a", eventType="NODE_DELETED", payload="{}", metadata=Row(version=None), _pos=3),
        Row(id="e5", timestamp=1704153800000, agentId="a", eventType=None, payload=None, metadata=Row(version=1), _pos=4),
    ]
    log = spark.createDataFrame(rows, "id string, timestamp bigint, agentId string, eventType string, payload string, metadata struct<version:int>, _pos bigint")
    assert {(r["id"], r["_pos"], r["level"], r["problem"]) for r in ev.consistency(log).collect()} == {
        ("e1", 3, "error", "duplicate id"), ("e5", 4, "error", "missing event type"), ("e3", 2, "warning", "out of order"),
        ("e1", 3, "warning", "missing version"), ("e5", 4, "warning", "missing payload"),
    }
    assert [r["id"] for r in ev.keep_last(log, "_pos", 2).collect()] == ["e5", "e1"]
    assert [r["id"] for r in ev.query_events(log, "_pos", "timestamp", "eventType", None, 1704067300000, 1704153700000, 1, 2).collect()] == ["e3", "e1"]


def test_rate_limit(spark):
    times = [("a", t, i) for i, t in enumerate([0, 10, 20, 59, 60, 61, 130])] + [("b", 5, 100)]
    rows = spark.createDataFrame(times, "k string, t int, p bigint").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["pos"]: r["allowed"] for r in ev.rate_limit(rows, "k", "ts", "p", 3, 60).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 100: True}


def test_handlers_are_isolated(spark):
    seen, handlers = [], ev.Handlers()
    handlers.on("x", lambda rows: seen.append(rows.count()))
    handlers.on("x", lambda rows: 1 / 0)
    handlers.on("y", lambda rows: seen.append("y"))
    gone = handlers.by_type["y"][0]
    handlers.off("y", gone)
    handlers.dispatch(spark.createDataFrame([("x",), ("x",), ("y",)], "event_type string"))
    assert seen == [2] and len(handlers.errors) == 1


def test_stream_drops_duplicates(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "event_id bigint, props string").selectExpr("event_id", "timestamp '2024-01-01' AS ts", "1L AS user_id", "'x' AS event_type", "0.5D AS value", "props")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    stream = event_stream.without_duplicates(event_stream.read_events(spark, f"file://{tmp_path}"))
    assert event_stream.run_once(stream, "dups", "append").count() == 2


def test_strings(spark):
    s = lambda a, b, e=0.0: strings.similarity(F.lit(a), F.lit(b), e)
    assert one(spark, s("kitten", "sitting"), s("", "x"), s("", ""), s("", "", 1.0)) == [pytest.approx(4 / 7), 0.0, 0.0, 1.0]
    assert one(spark, strings.ngrams(F.lit("a b"), 3), strings.ngrams(F.lit(""), 2), strings.ngrams(F.lit("abcd"), 3)) == [["ab"], [""], ["abc", "bcd"]]
    assert one(spark, strings.char_overlap(F.lit("aab"), F.lit("abz")), strings.tokens(F.lit("Hi, you!"))) == [pytest.approx(2 / 3), ["hi", "you"]]
    assert one(spark, strings.basename(F.lit("a/b.c.ts")), strings.extension(F.lit("a/b.c.TS")), strings.dirname(F.lit("a/b/c")), strings.stem_of_file(F.lit("a/b.ts"))) == ["b.c.ts", "ts", "a/b", "b"]
    assert one(spark, strings.same_tail(F.lit("X/src/a.ts"), F.lit("src\\a.ts")), strings.same_tail(F.lit("b.ts"), F.lit("src/a.ts"))) == [True, False]
    assert one(spark, strings.pascal_case(F.lit("user_name-x")), strings.strip_file_prefix(F.lit("p::N")), strings.strip_file_prefix(F.lit("a.ts::C::m")), strings.strip_citations(F.lit("a [cite_3]  b")), strings.shorten(F.lit("abcdef"), 3)) == ["UserNameX", "N", "C::m", "a b", "abc..."]
    assert one(spark, strings.line_of_offset(F.lit("a\nb\nc"), F.lit(4)), strings.query_terms(F.lit("How do I-x parse()"))) == [3, ["how", "ix", "parse"]]
    secret = "k sk_" + "a" * 22 + " AKIA" + "B" * 16 + ' "token": "12345678"'
    assert one(spark, strings.redact(F.lit(secret)))[0].count("[REDACTED_SECRET]") == 3
    assert one(spark, strings.identifiers(F.lit('see OrderService and my_var in "the x"'), "pascal"), strings.identifiers(F.lit("my_var"), "snake"), strings.identifiers(F.lit('"the x"'), "quoted")) == [["OrderService"], ["my_var"], ["the x"]]


def test_levenshtein_properties(spark):
    words = ["", "a", "ab", "ba", "kitten", "sitting", "mitten"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("d"))
    d = {(r["a"], r["b"]): r["d"] for r in rows.collect()}
    assert all(d[a, b] == d[b, a] and (d[a, b] == 0) == (a == b) for a, b in d)
    assert all(d[a, c] <= d[a, b] + d[b, c] for a in words for b in words for c in words)


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)).cast("float") for i in x])
    assert one(spark, vectors.cosine(v(1, 0), v(0, 0)), vectors.cosine(v(1), v(1, 0)), vectors.cosine(v(1, 1), v(2, 2))) == [0.0, 0.0, pytest.approx(1.0)]
    near = [one(spark, vectors.l2_similarity(v(1, 0), w))[0] for w in (v(1, 0), v(0.8, 0.6), v(0.6, 0.8), v(-1, 0))]
    assert near == [1.0, pytest.approx(0.367544, abs=1e-5), pytest.approx(0.105573, abs=1e-5), 0.0]
    up = one(spark, vectors.resample(v(0, 1), 3))[0]
    assert up == pytest.approx([0, 0.5 / 1.25**0.5, 1 / 1.25**0.5]) and one(spark, vectors.resample(v(3, 4, 5), 2))[0] == [3.0, 4.0]
    rows = spark.createDataFrame([([1.5, -2.0],)], "v array<float>")
    assert rows.select(vectors.from_blob(vectors.to_blob("v")).alias("v")).first()["v"] == [1.5, -2.0]
    toy = spark.createDataFrame([("abc",), ("abc",), (None,)], "t string").select(vectors.toy_embedding("t").alias("v")).collect()
    assert toy[0] == toy[1] and len(toy[0]["v"]) == 384


def test_values(spark):
    fixed, broken = values.parsed(values.repair_json(F.lit("```json\n{a:1,}\n```")), "a int")
    assert one(spark, fixed["a"], broken) == [1, False]
    value, flag = values.parsed(F.lit("{bad"), "a int")
    assert one(spark, value, flag)[1] in (True, False)
    assert one(spark, values.bracket_balance(F.lit("{{}"), "{", "}"), values.any_key(F.lit('{"b_c":"x"}'), "bC", "b_c"), values.iso_time(F.lit(1704067200123))) == [1, "x", "2024-01-01T00:00:00.123Z"]
    assert one(spark, values.token_estimate(F.lit("12345")), values.complexity(F.lit("if (a && b) {} else if (c)")), values.effort_hours(F.lit(10), F.lit(2), F.lit(1.0))) == [2, 4, 16.0]


def test_ranked_lists(spark):
    lists = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("1", "a", 3), ("1", "c", 4), ("2", "c", 1), ("2", "a", 2)], "list string, key string, pos int")
    got = {r["key"]: r["score"] for r in retrieval.reciprocal_rank_fusion(lists, "key").collect()}
    assert got == {"a": pytest.approx(1 / 61 + 1 / 62), "b": pytest.approx(1 / 62), "c": pytest.approx(1 / 63 + 1 / 61)}
    swapped = lists.withColumn("list", F.when(F.col("list") == "1", "2").otherwise("1"))
    assert {r["key"]: r["score"] for r in retrieval.reciprocal_rank_fusion(swapped, "key").collect()} == pytest.approx(got)
    last = retrieval.first_place_last_value(lists.withColumn("v", F.col("pos") * 10), ["list", "key"], "pos", "v")
    assert last.where("list = '1' AND key = 'a'").select("first_pos", "v").first() == Row(first_pos=1, v=30)


def test_knn_drops_far_rows_and_filters_after(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.6, 0.8]), (4, [-1.0, 0.0])], "vec_id int, embedding array<float>")
    pairs = search.against_all(spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<float>"), rows, F.col("query_id") != F.col("vec_id"))
    assert [r["vec_id"] for r in retrieval.knn(pairs, 4).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["vec_id"] for r in retrieval.knn(pairs, 2).where("vec_id > 1").collect()] == [2]


def test_boosts(spark):
    args = lambda text, name, path: retrieval.relevance_boost("parse the file", F.lit(text), F.lit(name), F.lit(path), F.lit(True))
    assert one(spark, args("function parse(x) { return x }", "parse", "src/parse.ts"), args("nothing", "zzz", "a/b.ts"))[0] == pytest.approx(0.6)
    assert one(spark, args("nothing", "zzz", "a/b.ts"))[0] == 0.0
    assert one(spark, retrieval.reranked("explain the parse function", F.lit(0.5), F.lit("the parse x"), F.lit("parse"), F.lit(True)))[0] == pytest.approx(0.5 + 0.15 + 0.05 + 0.28)
    rows = spark.createDataFrame([(1, "return parse x", "parse", 0.1), (2, "other", "zzz", 0.1), (3, "return parse", "PARSE_ALL", 0.1)], "id int, text string, entity string, score double")
    assert {r["id"]: round(r["score"], 6) for r in retrieval.diversified(rows, "the parse step", 5).collect()} == {1: 0.35, 2: 0.1, 3: 0.1}
    signed = rows.withColumn("text", F.when(F.col("id") == 1, "def parse(x): get(x)").otherwise(F.col("text")))
    assert {r["id"]: round(r["score"], 6) for r in retrieval.diversified(signed, "the parse step", 5).collect()} == {1: 0.5, 2: 0.1, 3: 0.1}


def test_parents(spark):
    chunks_ = spark.createDataFrame([(1, 0.0, 4), (4, 0.0, None), (5, 0.0, None)], "id int, similarity double, parent_id int")
    hits = chunks_.where("id = 1").withColumn("similarity", F.lit(0.7))
    assert {r["id"]: r["similarity"] for r in retrieval.with_parents(hits, chunks_).collect()} == {1: 0.7, 4: 0.9}


def test_similar_pairs_by_brute_force(spark):
    texts = [" ".join(f"word{(i * 7 + j) % 40 + (i // 5)}" for j in range(20)) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(t.split()), i)
    items = [(i, s) for s, i in sets.items()]
    want = {(min(a, b), max(a, b)) for a, x in items for b, y in items if a < b and len(x & y) / len(x | y) >= 0.6}
    assert {(r["a"], r["b"]) for r in retrieval.similar_pairs(rows, "id", "text", 0.6).collect()} == want and want


def test_refill_and_budgets(spark):
    rows = spark.createDataFrame([(i, i / 10) for i in range(10)], "id int, score double")
    assert ids(retrieval.refill(rows.where("id < 2"), rows, "id", 0.5)) == [0, 1, 7, 8, 9]
    assert retrieval.budgets(10, {"a": 0.55, "b": 0.2}) == {"a": 6, "b": 2} or retrieval.budgets(10, {"a": 0.55, "b": 0.2}) == {"a": 5, "b": 2}


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x [cite_1] y [cite_9]"), (2, "none"), (3, "none")], "k int, t string")
    there = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, n int")
    got = {r["k"]: (r["accuracy"], r["coverage"]) for r in retrieval.citation_metrics(answers, there, "k", "t").collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0), 3: (1.0, 1.0)}


def test_entities_merge(spark):
    rows = spark.createDataFrame([("k", "A", "t", ["x"], [1.0, 0.0]), ("k", "B", "t", ["x", "y"], [0.0, 1.0]), ("k", "B", "u", [], None)], "k string, name string, entity_type string, observations array<string>, embedding array<double>")
    assert search.merge_entities(rows, "k").first() == Row(k="k", name="B", aliases=["A", "B"], observations=["x", "y"], entity_type="t", embedding=[0.5, 0.5])
    v = F.array(F.lit(1.0), F.lit(0.0))
    same = search.hybrid_similarity(v, v, F.lit("a"), F.lit("a"), F.lit("t"), F.lit("t"), F.array(F.lit("o")), F.array(F.lit("o")))
    assert one(spark, same)[0] == pytest.approx(1.0)
    score = lambda a, b: search.resolution_score(F.lit(a), F.lit(b), F.lit("t"), F.lit("t"), F.lit(True), F.lit(False))
    assert one(spark, score("Foo", "foo"))[0] == 150.0 and one(spark, score("Foo", "xyz"))[0] < 100


CODE = """const x = 1;
el.innerHTML = a + b;
const h = md5(pw);
query("SELECT " + id);
const password = "hunter2hunter2";
for (const a of b) { for (const c of d) {} }
"""


def test_findings(spark):
    found = review.findings(spark.createDataFrame([("f.ts", CODE)], "path string, content string")).collect()
    got = {(r["rule"], r["line"]) for r in found}
    assert {("CWE-79", 2), ("CWE-326", 3), ("CWE-89", 4), ("CWE-798", 5), ("complexity", 6), ("naming-convention", 1), ("naming-convention", 3)} <= got
    assert all("hunter2" not in r["match"] for r in found if r["rule"] == "CWE-798")
    gate = review.metrics(spark.createDataFrame(found), []).first()
    assert gate["gate"] == "FAIL" and gate["security_rating"] == "F"


def test_repeated_lines(spark):
    long, short = "x" * 60, "y" * 50
    rows = spark.createDataFrame([("f", f"a\n{long}\nb\n{short}\n  {long} \n{short}")], "k string, t string")
    assert review.repeated_lines(rows, "k", "t").collect() == [Row(k="f", line=long, n=2, first_line=2)]
    assert review.duplicated_share(spark.createDataFrame([(1, "aaaaaaaa\nbbbbbbbb\ncccccccc"), (2, "aaaaaaaa\nbbbbbbbb\ncccccccc")], "k int, t string"), "k", "t").first()["extra"] == 5


def test_diff(spark):
    text = "diff --git a/x.ts b/x.ts\n@@ -10,2 +10,3 @@\n keep\n-old\n+new1\n+new2\ndiff --git a/y.ts b/z.ts\n--- a/y.ts\n+++ b/z.ts\n@@ -1 +1 @@\n-q"
    rows = review.diff_lines(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t").collect()
    assert {(r["file"], r["kind"], r["number"]) for r in rows} == {("x.ts", "context", 10), ("x.ts", "added", 11), ("x.ts", "added", 12), ("x.ts", "removed", 11), ("z.ts", "removed", 1)}


def test_diff_reads_each_text_in_one_pass(spark):
    text = "x\n@@ -1 +5 @@\n\ndiff --git a/q.ts b/q.ts\r\nBinary\n+++ b/q.ts\n@@ -7 +9 @@ f\n+a\n-b\n c\ndiff --git odd\n-d"
    made = review.diff_lines(spark.createDataFrame([(1, text), (2, None), (3, "no diff")], "d int, t string"), "d", "t")
    got = sorted(tuple(r) for r in made.select("hunk", "number", "kind", F.coalesce("file", F.lit("none")).alias("file"), "line", "d").collect())
    assert got == [(1, 5, "context", "none", "", 1), (1, 6, "context", "q.ts", "inary", 1), (2, 7, "removed", "q.ts", "b", 1), (2, 9, "added", "q.ts", "a", 1), (2, 9, "removed", "", "d", 1), (2, 10, "context", "q.ts", "c", 1)]
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()


def test_tables_of_any_size_are_dealt_to_tasks_of_bounded_rows(spark):
    from mnemospark.session import by_size, wide_shuffles

    rows = spark.range(10_000)
    assert by_size(rows, "id", rows=500).rdd.getNumPartitions() == 20 and by_size(rows, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with wide_shuffles(spark, 10_000, 500):
        assert spark.conf.get(key) == "20"
    assert spark.conf.get(key) == before


def test_review_text(spark):
    text = "intro\n### [HIGH] Bad thing\nFile: `a.ts`\nLines: 12-15\n### [LOW] Other\nfile: b.ts\nline: 3\n"
    rows = review.review_findings(spark.createDataFrame([(1, text)], "r int, t string"), "r", "t").collect()
    assert [(r["severity"], r["title"], r["file"], r["start"], r["end"]) for r in rows] == [("high", "Bad thing", "a.ts", 12, 15), ("low", "Other", "b.ts", 3, 3)]
    assert one(spark, review.risk_score(F.lit("Risk score: 7")), review.risk_score(F.lit("none"))) == [7, None]


def test_chunks(spark):
    lines = ["x" * 10] * 5
    rows = spark.createDataFrame([(1, "\n".join(lines))], "k int, t string")
    assert [(r["start_line"], r["end_line"]) for r in chunks.line_windows(rows, "k", "t", 25, 5).orderBy("chunk").collect()] == [(1, 2), (2, 3), (3, 4), (4, 5)]
    long = spark.createDataFrame([(1, "a" * 30 + ". " + "b" * 50), (2, None)], "k int, t string")
    parts = chunks.sentence_splits(long, "k", "t", 40).orderBy("k", "part").collect()
    assert [r["text"] for r in parts] == ["a" * 30 + ".", " " + "b" * 39, "b" * 11, ""]
    sizes = spark.createDataFrame([("g", i, t) for i, t in enumerate([10, 10, 15, 5, 40, 1])], "g string, o int, t int")
    assert [r["batch"] for r in chunks.greedy_batches(sizes, "g", "o", "t", 3, 30).orderBy("o").collect()] == [0, 0, 1, 1, 2, 3]
    kinds = [one(spark, chunks.content_type(F.lit(t), F.lit(s)))[0] for t, s in (("x", True), ("// a", False), ("const a; let b; var c", False), ("the if and for or", False))]
    assert kinds == ["summary", "comment", "code", "documentation"]
    models = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(10)], "o int, m string")
    assert chunks.balanced(models, "m", "o").where("m = 'a'").count() == 7


def test_ingest(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, h int"), spark.createDataFrame([("b", 1), ("c", 2), ("d", 1)], "k string, h int")
    assert {r["k"]: r["state"] for r in chunks.ingest_diff(old, new, "k", "h").collect()} == {"a": "deleted", "b": "unchanged", "c": "changed", "d": "new"}
    assert [r["k"] for r in chunks.stale(old, new, "k").collect()] == ["a"]


def test_parsers(spark):
    python = "import os\nfrom .a import b\nclass C:\n    def m(self):\n        pass\ndef f(): pass\n"
    rows = spark.createDataFrame([(1, python), (2, "def broken(")], "k int, t string")
    assert {(r["kind"], r["name"], r["parent"]) for r in parsers.python_entities(rows, "k", "t").collect()} == {("import", "os", None), ("import", ".a:b", None), ("class", "C", None), ("method", "m", "C"), ("function", "f", None)}
    page = spark.createDataFrame([(1, '<a class="x y x" href="u">t</a><img src="i">')], "k int, t string")
    assert {(r["kind"], r["value"]) for r in parsers.html_parts(page, "k", "t").collect()} == {("element", "a"), ("element", "img"), ("link", "u"), ("source", "i"), ("class", "x"), ("class", "y")}
    text = spark.createDataFrame([(1, "# A\n[l](b.md) [w](https://x)\n```py\n# no\n```\n## B")], "k int, t string")
    assert [(r["kind"], r["value"]) for r in parsers.markdown_parts(text, "k", "t").orderBy("line_no").collect()] == [("h1", "A"), ("link", "b.md"), ("code", "py"), ("h2", "B")]
    imports, selectors = parsers.css_parts(F.lit('@import "a.css"; /* x{} */ .b , p { color: red }'))
    assert one(spark, imports, selectors) == [["a.css"], [".b , p"]]
    made, used = parsers.sql_tables(F.lit("CREATE TABLE IF NOT EXISTS t (a INT); SELECT * FROM t JOIN u ON 1=1"))
    assert one(spark, made, used) == [["t"], ["t", "u"]]
    assert one(spark, F.size(parsers.script_entities(F.lit("class A {} function b() {} import x from 'y'"))))[0] == 3


def test_lines_of_logs(spark):
    kinds = [one(spark, logs.line_kind(F.lit(x)))[0] for x in ('{"name":"a","entityType":"f"}', '{"eventType":"E"}', '{"q":1}', "{x")]
    assert kinds == ["node", "event", "object", "invalid"]
    assert one(spark, logs.embedding_text(F.lit('{"name":"a","observations":["x","y"]}')), logs.embedding_text(F.lit('{"text":"t"}'))) == ["a: x. y", "t"]
    log = spark.createDataFrame([("h1\x1fann\x1fd\x1fm one\x1eh2\x1fbob\x1fd\x1fm two\x1e",)], "value string")
    assert [r["hash"] for r in logs.commits(log).collect()] == ["h1", "h2"]
    status = spark.createDataFrame([("M  a.ts",), (" M b.ts",), ("?? c.ts",)], "value string")
    assert [tuple(r) for r in logs.status_lines(status).collect()] == [("a.ts", "modified", True), ("b.ts", "modified", False), ("c.ts", "untracked", False)]


def test_folder_scan(spark, tmp_path):
    for name in ("a.ts", "b.py", "node_modules/c.ts", ".hidden/d.ts", "e.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text('{"a":1}\nx\n')
    got = {(r["name"], r["language"]) for r in files.scan_folder(spark, f"file:{tmp_path}").collect()}
    assert got == {("a.ts", "typescript"), ("b.py", "python")}
    assert files.search_files(spark, f"file:{tmp_path}", "*.ts").count() == 1
    assert {r["n_lines"] for r in logs.file_facts(spark, f"file:{tmp_path}/a.ts").collect()} == {1}


def test_writes(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, seq int")
    assert sorted((r["k"], r["v"]) for r in sinks.upsert(base, new, ["k"], "seq").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sinks.insert_absent(base, new, ["k"]).count() == 3
    assert [r["k"] for r in sinks.delete_keys(base, new, {"k": "k"}).collect()] == [1]
    assert one(spark, sinks.csv_line(F.lit('a"b'), F.lit(None), F.lit("x,y"), F.lit(3))) == ['"a""b",,"x,y",3']
    root = f"file://{tmp_path}/snaps"
    for name in ("1", "2", "3"):
        sinks.snapshot({"t": base}, root, name)
    assert sinks.list_snapshots(spark, root) == ["3", "2", "1"] and sinks.prune_snapshots(spark, root, 2) == ["1"]
    assert spark.read.parquet(f"{root}/3/t").count() == 2
    sinks.append_json(base, f"file://{tmp_path}/j")
    sinks.append_json(base, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 4
    sinks.write_csv(base.withColumn("x", F.array("v")), f"file://{tmp_path}/c")
    assert {r["x"] for r in spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/c").collect()} == {'["a"]', '["b"]'}
    log = spark.createDataFrame([("n", "old", 1, False, 0)], "id string, name string, version int, deleted boolean, _pos bigint")
    changed = spark.createDataFrame([("n", "new", 0, False, 9)], "id string, name string, version int, deleted boolean, _pos bigint")
    assert ev.live(sinks.tombstone_update(log, changed)).select("name", "version").collect() == [Row(name="new", version=3)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("top 5 functions sort by name desc", {"limit": 5, "sort_by": "name", "sort_order": "desc", "entity_type": "function"}),
        ("files larger than 2 kb", {"size": 2048, "size_op": ">"}),
        ("classes since 2024-01-02", {"date": "2024-01-02", "date_op": ">=", "entity_type": "class"}),
        ("compare Foo vs Bar", {"intent": "compare", "targets": ["Foo", "Bar"]}),
        ('"OrderService" imports', {"entities": ["OrderService"], "relations": ["imports"]}),
        ("not test files", {"is_test": False}),
    ],
)
def test_questions(spark, text, want):
    got = spark.range(1).select(questions.structured(F.lit(text)).alias("q")).first()["q"]
    assert {k: got[k] for k in want} == want


def test_question_runs(spark):
    rows = spark.createDataFrame([("a", "function", 10), ("b", "function", 5000), ("c", "class", 9000)], "name string, entity_type string, size int")
    assert [r["name"] for r in questions.plan(spark, "functions larger than 2 kb", rows).collect()] == ["b"]
    assert [r["name"] for r in questions.plan(spark, "top 1 sort by size desc", rows).collect()] == ["c"]
    assert {r["n"] for r in questions.plan(spark, "group by entity_type", rows).collect()} == {1, 2}


def test_greedy_dedup_by_brute_force(spark):
    from mnemospark.operators import context

    texts = [" ".join(f"word{(i * 3 + j) % 60}" for j in range(20)) for i in range(60)] + ["", "a b", "word1 word1 word2", "word2 word1"]
    rows = [(i, t, (i * 37) % 50) for i, t in enumerate(texts)]
    got = ids(context.greedy_dedup(spark.createDataFrame(rows, "id int, t string, s int"), "id", "t", "s", 0.6))
    kept = []
    for i, t, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        words = {w for w in t.split() if len(w) > 2}
        if not words or all(len(words & k) / len(words | k) < 0.6 for _, k in kept if k):
            kept.append((i, words))
    assert got == sorted(i for i, _ in kept)


def test_context_rules(spark, nodes):
    from mnemospark.operators import context

    assert ids(context.index_search(nodes, "name", "src/app.ts")) == ["n3"] and ids(context.index_search(nodes, "name", "app")) == ["n3", "n4"]
    assert one(spark, context.content_words(F.lit("How does the Parser read files")), context.snippet(F.array(F.lit(1)), 3)) == [["parser", "read", "files"], None]
    assert one(spark, context.term_rank(F.lit("Parser"), "the Parser"), context.term_rank(F.lit("zz"), "x")) == [176, 2]
    assert one(spark, context.importance(F.lit("class"), F.lit(True), F.lit(True), F.lit(False), F.lit(None).cast("boolean"))) == [0.75]
    assert one(spark, *[context.change_category(F.lit(p)) for p in ("src/a.test.ts", "docs/x", "a/.env", "package.json", "src/t.d.ts", "lib/x.ts", "x.ts")]) == ["tests", "docs/x", "config", "config", "types", "lib/x.ts", "x.ts"]
    assert one(spark, context.change_kind(F.lit("fix the bug")), context.change_kind(F.lit("")), context.plan_complexity(F.lit(1), F.lit(1), F.lit(1), F.lit(1))) == ["bug_fix", "simple_refactor", "simple_plan"]
    rows = spark.createDataFrame([("p", "e", 0.9, 1, i) for i in range(3)] + [("q", None, 0.95, 2, 9), ("old", "e", 0.1, 1, -1)], "path string, entity string, score double, kind_rank int, pos int")
    assert [r["path"] for r in context.context_flow(rows, 3).collect()] == ["q", "p", "old"]
    assert one(spark, context.total_complexity(F.lit(1.0), F.lit("bug_fix")), context.total_complexity(F.lit(3.0), F.lit("major_restructure"))) == ["simple", "complex"]
    scored = retrieval.context_score(F.lit("export class A " + "x" * 200), F.lit("src/a"), F.lit("file"), F.lit("A"), F.lit(1.0), ["class", "zzz"])
    assert one(spark, scored)[0] == pytest.approx(0.4 + 0.15 + 0.2 + 0.1)
    told = retrieval.verdict(spark.createDataFrame([(1, 0.9), (1, 0.1), (2, 0.2)], "g int, score double"), "g")
    assert {r["g"]: (round(r["score"], 6), r["relevant"]) for r in told.collect()} == {1: (0.78, True), 2: (0.0, False)}
    found = context.iterative_search(lambda q: nodes.where(F.col("name").contains(q)), ["app", "util"], "id", more=lambda hits, q: ["test"])
    assert ids(found) == ["n1", "n2", "n3", "n4"]


def test_stateful_streams_equal_batch(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    import __spark_entry__ as entry

    made = {name: sorted(map(tuple, entry.queries()[name](spark, sf).collect())) for name in ("stream_rate_limit", "rate_limited_requests")}
    assert made["stream_rate_limit"] == made["rate_limited_requests"] and len({allowed for _, allowed in made["stream_rate_limit"]}) == 2


def test_source_rules(spark):
    from mnemospark.operators import context

    path, text = F.lit("src/query_engine.ts"), F.lit("export class QueryEngine {}")
    assert one(spark, context.source_content(path, text, ["query engine"]), context.source_content(path, F.lit("x"), ["query engine"]), context.source_content(path, text, ["other", "thing"])) == [True, False, False]
    assert one(spark, context.mere_mention(F.lit("TODO later"), ["x"]), context.mere_mention(F.lit("y" * 300 + " parse"), ["parse"])) == [True, False]
    assert context.source_limits("debug_error") == (15, 6) and context.source_limits("?") == (15, 7)
    names = spark.createDataFrame([("parser",), ("Lexer",), ("zzz",), ("my_parser",)], "name string")
    assert sorted(r["name"] for r in context.expand_terms(names, "the parser lexr").collect()) == ["Lexer", "my_parser", "parser"]

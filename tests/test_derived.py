"""Operators over derived records: by brute force, round trip or small examples."""

import hashlib
import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemospark import session
from mnemospark.functions import values
from mnemospark.operators import chunks, context, graph, retrieval, search
from mnemospark.plans import questions
from mnemospark.sources import files, logs, sinks
from mnemospark.streaming import event_stream

SF = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def parts_by_hand(text, most):
    out = []
    while len(text) > most:
        cut = max(text.rfind(".", most // 2, most), text.rfind("\n", most // 2, most)) + 1 or most
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


@with_tables
def test_long_context_parts_are_those_of_a_walk(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = sorted((d, i, len(p), hashlib.md5(p.encode()).hexdigest()) for d, t in docs.items() for i, p in enumerate(parts_by_hand(t, 2000)))
    assert sorted(map(tuple, entry.queries()["long_context_offsets"](spark, SF).collect())) == want and len(want) > len(docs)


def test_very_long_text_is_cut_in_linear_time(spark):
    docs = spark.createDataFrame([(1, "x" * 3_000_000), (2, None)], "id int, text string")
    began = time.time()
    assert chunks.sentence_splits(docs, "id", "text", 100).groupBy("id").count().orderBy("id").collect()[0]["count"] == 30_000
    assert time.time() - began < 30


def test_every_endpoint_strategy(spark):
    names = {"App\\One": 1, "App\\One::go": 2, "Lib\\Two": 3, "Lib\\Two::stop": 4, "Lib\\Twin": 5, "App\\Twin": 6, "Twin::both": 7, "X\\Twin::both": 8, "plain": 9, "Lib\\Deep\\Three::a::b": 10}
    nodes = spark.createDataFrame([(f"n{i}", n) for n, i in names.items()], "id string, name string")
    asked = {
        "plain": ("n9", "exact"), "a/b.ts::plain": ("n9", "file_prefix"), "\\App\\One": ("n1", "namespace"), "One::go": ("n2", "class_member"), "Any::stop": ("n4", "member"),
        "Two": ("n3", "suffix"), "Twin": None, "Twin::both": ("n7", "exact"), "Nothing": None, "a::b": ("n10", "member"), "": None, "Three::a::b": ("n10", "class_member"),
    }
    wanted = spark.createDataFrame([(w,) for w in asked] + [(None,), ("Two",)], "wanted string")
    got = {r["wanted"]: (r["id"], r["strategy"]) for r in graph.resolve_endpoints(wanted, nodes).collect()}
    assert got == {w: x for w, x in asked.items() if x}
    both = spark.createDataFrame([("n1", "Ns\\Cls"), ("n2", "Ns\\Cls::m"), ("n3", "Other\\Cls::m"), ("n4", "Q\\Cls::m")], "id string, name string")
    assert [tuple(r) for r in graph.resolve_endpoints(spark.createDataFrame([("Cls::m",)], "wanted string"), both).collect()] == [("Cls::m", "n2", "class_and_member")]


def test_entity_edges_of_nulls(spark):
    schema = "full_name string, type string, file string, parent_class string, calls array<struct<name:string,type:string>>, interfaces array<string>"
    rows = [("f::A", "class", "f", None, None, ["I"]), ("f::A.m", "method", "f", "A", [("g", "function")], None), (None, "method", "f", "A", None, None), ("x", "method", None, "A", None, None), ("f::g", "function", "f", "A", [], ["I"])]
    got = {tuple(r) for r in graph.entity_edges(spark.createDataFrame(rows + rows[:1], schema)).collect()}
    assert got == {
        ("f::A", "f", "defined_in_file"), ("f::A.m", "f", "defined_in_file"), ("f::g", "f", "defined_in_file"),
        ("f::A", "f::A.m", "has_method"), ("f::A.m", "f::g", "calls_function"), ("f::A", "f::I", "implements_interface"),
    }


def test_ranks_within_long_groups(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", (i * 37) % 500, i) for i in range(900)], "list string, pos int, key int")
    got = {(r["list"], r["pos"], r["key"]): r["rank"] for r in retrieval.ranked_within(rows, ["list"], ["pos", "key"]).collect()}
    for name in ("a", "b"):
        order = sorted(k for k in got if k[0] == name)
        assert [got[k] for k in order] == list(range(1, len(order) + 1))


def test_budgets_round_half_up():
    assert retrieval.budgets(10, {"a": 0.25, "b": 0.35, "c": 0.55}) == {"a": 3, "b": 4, "c": 6}


def test_pattern_ranking_without_hits(spark):
    paths = spark.createDataFrame([(f"src/{i:03d}.ts",) for i in range(40)], "path string")
    assert [r["path"] for r in retrieval.ranked_patterns(paths, "path", ["zzz"]).collect()] == [f"src/{i:03d}.ts" for i in range(30)]
    assert retrieval.ranked_patterns(paths, "path", []).count() == 30
    more = paths.union(spark.createDataFrame([("auth/login.ts",), ("a/auth/x.ts",), ("a/xauth.ts",)], "path string"))
    assert [tuple(r) for r in retrieval.ranked_patterns(more, "path", ["Auth"]).collect()] == [("a/xauth.ts", 15), ("a/auth/x.ts", 8), ("auth/login.ts", 5)]


def test_search_diversifies_when_sources_are_few(spark):
    rows = spark.createDataFrame([(i, "same" if i < 20 else f"s{i}", "first" if i < 20 else "more") for i in range(30)], "id int, source string, word string")
    asked = []

    def find(text):
        asked.append(text)
        return rows.where(F.col("word") == text)

    found = context.iterative_search(find, ["first", "none"], "id", source="source", diversify=lambda f, q: ["more"] if q == "first" else [])
    assert found.count() == 30 and asked[:2] == ["first", "more"]


def test_names_in_questions():
    by = {n["text"]: n for n in questions.names_of('show class Foo and "bar baz" in utils.py with the DataLoader, my_var, some-thing and async MAX_SIZE')}
    assert (by["Foo"]["type"], by["bar baz"]["type"], by["utils.py"]["type"], by["MAX_SIZE"]["type"]) == ("genericType", "class", "file", "constant")  # the word class stands near the quotes
    assert by["bar baz"]["confidence"] == 1 and by["DataLoader"]["confidence"] == pytest.approx(0.6) and by["some-thing"]["confidence"] == pytest.approx(0.5)
    assert by["DataLoader"]["qualifiers"] == ["async"] and questions.names_of("   ") == []


def test_repair_leaves_valid_json(spark):
    raw = ['{"a": "x, y: z"}', '{"a": "keep ``` &lt; this"}', "[1,2]", "{a: 1,}", None, "{{"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(values.repair_json(F.col("raw"))).collect()]
    assert got[:3] == raw[:3] and json.loads(got[3]) == {"a": 1} and got[4] is None


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    """The older file is short and the newer one long; the newer one's version wins."""
    place = tmp_path / "log"
    place.mkdir()
    for i, (name, n) in enumerate((("b-2024.jsonl", 1), ("a-2025.jsonl", 3000))):
        path = place / name
        path.write_text("".join(json.dumps({"id": "x", "version": i * 10_000 + k}) + "\n" for k in range(n)) + "\nbroken\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = logs.read_json_lines(spark, f"file://{place}", "id string, version int").orderBy("_pos").collect()
        assert [r["version"] for r in rows] == [0, *range(10_000, 13_000)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream_of_json_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id": "1"}\n\nnot json\n{"id": "2"}\n')
    got = event_stream.run_once(logs.stream_json_lines(spark, f"file://{tmp_path}/in", "id string"), "lines", "append")
    assert sorted(r["id"] for r in got.collect()) == ["1", "2"]


def test_tables_are_written_together_or_not_at_all(spark, tmp_path):
    a, b = spark.range(3), spark.range(4).withColumn("x", F.col("id") * 2)
    sinks.write_together({"a": a, "b": b}, f"file://{tmp_path}/both")
    assert spark.read.parquet(f"file://{tmp_path}/both/b").count() == 4
    with pytest.raises(Exception, match="boom"):
        sinks.write_together({"a": a, "b": b.withColumn("y", F.raise_error(F.lit("boom")).cast("string"))}, f"file://{tmp_path}/none")
    with pytest.raises(FileExistsError):
        sinks.write_together({"a": a}, f"file://{tmp_path}/both")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["both"]


def test_export_and_migration_count_rows(spark, tmp_path):
    counts = sinks.export_json({"nodes": spark.range(5), "edges": spark.range(2)}, f"file://{tmp_path}/out")
    assert counts == {"nodes": 5, "edges": 2}
    assert {r["table"]: r["n_rows"] for r in spark.read.json(f"file://{tmp_path}/out/statistics").collect()} == counts
    assert sinks.migrate(spark.range(6).withColumn("from", F.lit("a")), {"id": "nodeId", "from": "fromNodeId"}, f"file://{tmp_path}/new") == 6
    assert set(spark.read.json(f"file://{tmp_path}/new").columns) == {"nodeId", "fromNodeId"}


def test_ignore_files_and_depth(spark, tmp_path):
    for path in ("a.ts", "gen/b.ts", "src/gen/c.ts", "src/keep.gen.ts", "src/x.gen.ts", "d/e/f/g.ts"):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x")
    names = lambda **o: {r["path"].split(f"{tmp_path.name}/")[1] for r in files.search_files(spark, f"file:{tmp_path}", "*.ts", **o).collect()}
    assert names(depth=2) == {"a.ts", "gen/b.ts", "src/keep.gen.ts", "src/x.gen.ts"}
    assert names(ignore=["# no", "/gen/", "*.gen.ts", "!keep.gen.ts"]) == {"a.ts", "src/gen/c.ts", "src/keep.gen.ts", "d/e/f/g.ts"}
    assert names(ignore=["gen/", "d/**/g.ts"]) == {"a.ts", "src/keep.gen.ts", "src/x.gen.ts"}


def test_query_blocks_beyond_one_plan(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_BLOCKS", 2)
    queries, rows = spark.range(40).select(F.col("id").alias("q")), spark.range(100)
    got = search.against_all(queries, rows, F.col("id") % 40 == F.col("q"), block_rows=5)
    assert got.count() == 100 and got.select("id").distinct().count() == 100


@with_tables
def test_late_events_in_many_micro_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    place = f"{tmp_path}/events.parquet"
    for i in range(5):
        events.where((F.col("event_id") >= i * 200) & (F.col("event_id") < (i + 1) * 200)).withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("event_id") % 7) * 3_600_000_000)).coalesce(1).write.mode("append").parquet(f"file://{place}")
        for path in (p for p in os.scandir(place) if p.name.endswith(".parquet") and p.stat().st_mtime > 1_700_000_100):
            os.utime(path.path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    stream = spark.readStream.schema(event_stream.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{place}")
    got = {tuple(r) for r in event_stream.run_late(stream, "many", "event_type").collect()}
    assert got == {tuple(r) for r in entry.queries()["stream_out_of_order"](spark, SF).collect()} and got


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Session())


def test_scratch_scopes_go(spark):
    with session.scratch_scope(spark):
        path = session.scratch_path(spark, "x")
        spark.range(2).write.parquet(path)
        assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


# whole tables against plain loops, where SQL can't say it


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@with_tables
def test_chunk_windows_by_loops(spark, docs):
    want = set()
    for d, r in docs.items():
        lines, start, n = (r["text"] or "").split("\n"), 0, 0
        while start < len(lines):
            stop, size = start, 0
            if n:  # the lines carried back count first
                while stop < fresh:
                    size += len(lines[stop]) + 1
                    stop += 1
            while stop < len(lines) and (stop == (fresh if n else start) or size + len(lines[stop]) + 1 <= 1200):  # a new line always fits
                size += len(lines[stop]) + 1
                stop += 1
            want.add((d, n, start + 1, stop, hashlib.sha256("\n".join(lines[start:stop]).encode()).hexdigest()))
            if stop == len(lines):
                break
            back, carried = stop, 0
            while carried < 200 and stop - back < stop - start - 1:
                back -= 1
                carried += len(lines[back]) + 1
            start, fresh, n = back, stop, n + 1
    assert {tuple(r) for r in entry.queries()["chunk_windows"](spark, SF).collect()} == want


@with_tables
def test_embed_batches_by_loops(spark, docs):
    queues = {}
    for d, r in sorted(docs.items()):
        queues.setdefault(r["source"], []).append((d, -(-len(r["text"]) // 4)))
    want = set()
    for queue, rows in queues.items():
        batch = n = total = 0
        for d, t in rows:
            if n and (n >= 100 or total + t > 20_000):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + t
            want.add((queue, d, batch))
    assert {tuple(r) for r in entry.queries()["embed_batches"](spark, SF).collect()} == want


@with_tables
def test_boosts_by_loops(spark, docs):
    from mnemospark.plans.vector_queries import BOOST_QUERY

    terms = [re.sub(r"\W", "", t.lower()) for t in BOOST_QUERY.split() if len(t) > 2]
    got = {r["doc_id"]: (r["boost"], r["score"]) for r in entry.queries()["boosted_rerank"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for d, r in docs.items():
        text, name, path = r["text"], r["lang"].lower(), f"{r['source']}/{r['lang']}".lower()
        low = text.lower()
        hits = lambda patterns: sum(bool(re.search(p, low, re.ASCII)) for p in patterns)  # noqa: B023, E731
        names = 0.4 * any(t == name for t in terms) + 0.25 * any(t in name or name in t for t in terms)
        near = max(len(set(t) & set(name)) / max(len(t), len(name)) for t in terms)
        names += 0.2 * near if near > 0.7 else 0
        methods = min(0.3, 0.15 * hits(retrieval.METHOD_PATTERNS) * (1.5 if any(t in name for t in terms) else 1))
        content = min(0.2, 0.05 * hits(retrieval.CONTENT_PATTERNS))
        stem = path.split("/")[-1].rsplit(".", 1)[0]
        place = 0.15 * any(t in stem for t in terms) + 0.08 * any(t in p for t in terms for p in path.split("/"))
        size = 0.1 * (len(text) > 500) + 0.1 * (len(text) > 1000) + 0.1 * (name in low)
        assert got[d][0] == pytest.approx(min(0.6, names + methods + content + place + size), abs=2e-6), d


def test_patterns_are_tried_where_their_signs_and_words_are(spark):
    families = (*retrieval.METHOD_PATTERNS, *retrieval.CONTENT_PATTERNS, *retrieval.SIGNATURE_PATTERNS)
    rng = random.Random(4)
    words = ["function", "def", "func", "class", "public", "new", "this.x", "self.run", "@.a", "if", "do", "async", "finally", "let", "import", "init", "get_it", "foo", "=>", "(", "(a)", "{", "=", ":", "."]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "low string")
    got = rows.select([retrieval.has_pattern(F.col("low"), p).alias(f"p{i}") for i, p in enumerate(families)]).collect()
    plain = rows.select([F.col("low").rlike(p).alias(f"p{i}") for i, p in enumerate(families)]).collect()
    assert got == plain and all(any(r[i] for r in got) for i in range(len(retrieval.METHOD_PATTERNS)))
    plan = rows.where(retrieval.has_pattern(F.col("low"), retrieval.METHOD_PATTERNS[0]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(low" in plan and ", ()" in plan and retrieval._needs(retrieval.METHOD_PATTERNS[0]) == ["def", "func", "fn"]


@with_tables
def test_boosted_rerank_lowers_a_text_once(spark):
    plan = entry.queries()["boosted_rerank"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1 and "lower(low" not in plan


@with_tables
def test_markdown_parts_by_loops(spark, docs):
    want = []
    for d, r in docs.items():
        lines = [f"# {r['source']}", f"[s](../{r['lang']}.md)", "```txt", *r["text"].split("\n"), "```", "## end"]
        assert not any(x.startswith(("#", "```")) or re.search(r"\[[^\]]*\]\([^)]*\)", x) for x in r["text"].split("\n"))
        want += [(d, "h1", r["source"]), (d, "link", f"../{r['lang']}.md"), (d, "code", "txt"), (d, "h2", "end")]
        assert len(lines) > 5
    got = entry.queries()["markdown_parts"](spark, SF).collect()
    assert sorted((r["doc_id"], r["kind"], r["value"]) for r in got) == sorted(want)


@with_tables
def test_question_limits_and_sorts_by_patterns(spark):
    asked = {(r["conv_id"], r["turn"]): r["text"] or "" for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").collect()}
    rows = entry.queries()["question_plans"](spark, SF).collect()
    assert {(r["conv_id"], r["turn"]) for r in rows} == asked.keys()
    for r in rows:
        text = asked[r["conv_id"], r["turn"]]
        limit, sort = re.search(r"(?i)\b(?:top|first|limit)\s*(\d+)\b", text), re.search(r"(?i)\bsort by (\w+)", text)
        assert r["limit"] == (int(limit[1]) if limit else None) and r["sort_by"] == (sort[1] if sort else None)
        low = text.lower()
        kind = "function" if "function" in low or "method" in low else "class" if "class" in low else "interface" if "interface" in low else None
        assert r["entity_type"] == kind and 0 <= r["confidence"] <= 1

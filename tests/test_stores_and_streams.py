"""Scans, versions, JSON repair, keyed streams and dispatch: against walks and batches, with damage, failures and restarts."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.functions.json_repair import mended, repair_json
from mnemospark.operators import events as ev
from mnemospark.sources import files
from mnemospark.sources.versions import DamagedVersion, Versions
from mnemospark.streaming import event_stream

# scans

TREE = {
    ".gitignore": "# top\n*.gen.ts\n/only_top/\n!keep.gen.ts\n",
    "a.ts": "x", "__init__.py": "y", "_private/b.py": "z", "only_top/c.ts": "x", "src/only_top/d.ts": "x", "src/x.gen.ts": "x", "src/keep.gen.ts": "x",
    "src/.gitignore": "!x.gen.ts\nlocal/\ndeep/**/no.py\n", "src/local/e.ts": "x", "local/f.ts": "x", "src/deep/a/b/no.py": "x", "src/deep/yes.py": "x", "src/deep/.gitignore": "yes.*\n!a\n",
    "node_modules/g.ts": "x", "dist/h.ts": "x", "vendor/i.php": "<?php", "package.json": "{}", "notes.txt": "x", "ünï cødé/j +%20.ts": "x", "empty name.md": "",
}


def walk(root, below="", rules=()):
    """Files and folders by the rules of all ignore files on the way."""
    names = sorted(os.listdir(f"{root}/{below}"))
    if ".gitignore" in names:
        rules = [*rules, *((below, x) for x in open(f"{root}/{below}.gitignore").read().splitlines())]
    for name in names:
        folder = os.path.isdir(f"{root}/{below}{name}")
        if files.left_out(name, folder):
            continue
        at, out = below + name, False
        for base, line in rules:
            if line and line[0] != "#" and at.startswith(base):
                rest, body = at[len(base) :], line.lstrip("!")
                if body.endswith("/") and not folder:
                    continue
                body = body.strip("/") if body.strip("/") == body.rstrip("/") else "/" + body.strip("/")
                pattern = "".join({"**/": "(.*/)?", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*)", body.lstrip("/")))
                if re.fullmatch(pattern if "/" in body else f"(.*/)?{pattern}", rest):
                    out = line[0] != "!"
        if not out:
            yield (at, "directory" if folder else "file")
            if folder:
                yield from walk(root, at + "/", rules)


@pytest.mark.parametrize("name", ["plain", "a+b (x) [y]", "ünter tmp"])
def test_scan_equals_a_walk(spark, tmp_path, name):
    root = tmp_path / name
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    got = {(r["below"].rstrip("/"), r["type"]) for r in files.scan_tree(spark, str(root), ignore_file=".gitignore").collect()}
    want = set(walk(str(root)))
    assert got == want and ("src/x.gen.ts", "file") in got and ("__init__.py", "file") in got and ("src/deep/yes.py", "file") not in got
    read = {r["name"]: r["content"] for r in files.scan_folder(spark, f"file:{root}", "*.py", with_content=True).collect()}
    assert read == {"__init__.py": "y", "b.py": "z", "no.py": "x", "yes.py": "x"}


def test_what_cannot_be_listed_is_a_row(spark, tmp_path):
    got = files.scan_tree(spark, str(tmp_path / "absent")).collect()
    assert [(r["type"], bool(r["message"])) for r in got] == [("error", True)]


# versions


def test_restore(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/store")
    assert store.current() is None and store.tables() == {}
    one = spark.createDataFrame([(i, f"t{i}", None, {"k": i}) for i in range(50)], "id int, text string, x double, m map<string,int>")
    store.create({"nodes": one, "edges": spark.range(5)}, "v1")
    store.create({"nodes": one.where("id < 10"), "edges": spark.range(0)}, "v2")
    held = store.tables()
    assert store.current() == "v2" and held["nodes"].count() == 10
    assert store.restore("v1") == "v2" and store.current() == "v1"
    assert sorted(r["id"] for r in store.tables()["nodes"].collect()) == list(range(50)) and held["nodes"].count() == 10
    assert store.take_back() == "v2" and store.previous() == "v1"
    with pytest.raises(FileExistsError):
        store.create({"nodes": one}, "v1")
    # damage: a part file goes, then one that has other rows
    place = tmp_path / "store/versions/v1/tables/edges"
    for part in place.glob("part-*"):
        part.unlink()
    with pytest.raises(DamagedVersion):
        store.restore("v1")
    assert store.current() == "v2" and list(store.damage("v1")) == ["edges"] and store.damage("v2") == {}
    spark.range(5, 10).write.mode("overwrite").parquet(f"file://{place}")
    assert list(store.damage("v1")) == ["edges"]
    with pytest.raises(DamagedVersion):
        store.restore("never")


def test_a_failed_version_leaves_nothing(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/store")
    store.create({"t": spark.range(3)}, "v1")
    with pytest.raises(Exception):  # noqa: B017
        store.create({"t": spark.range(9), "bad": spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))}, "v2")
    assert store.names() == ["v1"] and store.current() == "v1" and not (tmp_path / "store/versions/v2").exists()
    for i in range(3, 8):
        store.create({"t": spark.range(i)}, f"v{i}")
    assert store.prune(2) == ["v1", "v3", "v4", "v5"] and store.names() == ["v6", "v7"] and store.tables()["t"].count() == 7


# JSON repair

TEXTS = ["x, y: z", "plain", "it's", 'a "quoted" bit', "line\nbreak", "c:\\dir", "{curly} [sq]", "", "tab\there", "ünï", "ends with,", "https://x.y/z", "/* no */ // no", "true"]


def values_of(rng, depth=0):
    r = rng.random()
    if depth < 3 and r < 0.3:
        return {rng.choice(["a", "b_c", "key", "x1", "two words"]): values_of(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 3 and r < 0.5:
        return [values_of(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([1, -2.5, True, None, False, rng.choice(TEXTS), rng.choice(TEXTS), 1e10])


def broken(rng, text):
    kind = rng.randint(0, 5)
    if kind == 0 and len(text) > 2:
        return re.sub(r"([}\]])$", r",\1", text)
    if kind == 1 and not text.endswith('"'):
        return text.rstrip("}]")
    if kind == 2:
        return f"```json\n{text}\n```"
    if kind == 3:
        return text.replace("\\n", "\n").replace("\\t", "\t")
    return f"/* c */ {text} // end" if kind == 4 else text


def test_broken_json_comes_back():
    rng = random.Random(7)
    for _ in range(3000):
        value = values_of(rng)
        value = value if isinstance(value, (dict, list)) else {"v": value}
        assert json.loads(mended(broken(rng, json.dumps(value, ensure_ascii=rng.random() < 0.5)))) == value


def test_repairs_by_kind(spark):
    want = {
        '{"a": "x, y: z",}': {"a": "x, y: z"}, "{a: 'b'}": {"a": "b"}, '{"a": 1, "b": [1,2': {"a": 1, "b": [1, 2]}, '{"a": "he said "hi" to me"}': {"a": 'he said "hi" to me'},
        "{a:1 b:2}": {"a": 1, "b": 2}, '{"a": tru, x: some words here, "l": [1,,2,],}': {"a": "tru", "x": "some words here", "l": [1, 2]}, "[1,2}]": [1, 2], '{"a":1}}}': {"a": 1},
        "{'it\\'s': \"don't\"}": {"it's": "don't"}, '{"a": "b" // note\n, "c": 1}': {"a": "b", "c": 1}, '{"k": "open': {"k": "open"}, "{&quot;k&quot;: None}": {"k": None},
    }
    rows = spark.createDataFrame([(t,) for t in [*want, "{{{", None, '{"ok": "a , }"}']], "raw string")
    got = [r[0] for r in rows.select(repair_json(F.col("raw"))).collect()]
    assert [json.loads(x) for x in got[: len(want)]] == list(want.values())
    assert got[-2] is None and got[-1] == '{"ok": "a , }"}'
    with pytest.raises(ValueError):
        json.loads(got[-3])


def test_repairs_come_by_hundreds(spark):
    """An Arrow batch would hold ten thousand whole texts in each Python worker."""
    rows = spark.range(3).select(repair_json(F.concat(F.lit("{a: "), F.col("id").cast("string"))).alias("t"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [r[0] for r in rows.collect()] == ['{"a":0}', '{"a":1}', '{"a":2}']
    assert json.loads(mended("{t: '" + 'é "x" \\q\n' * 3 + "',")) == {"t": 'é "x" \\q\n' * 3}


# streams


def requests(spark):
    rng, rows, t = random.Random(4), [], 0
    for i in range(400):
        t += rng.choice([0, 1, 5, 30, 4000])
        rows.append((i, "hot" if rng.random() < 0.5 else f"u{rng.randint(0, 5)}", t))
    return spark.createDataFrame(rows, "event_id bigint, user string, s bigint").select("event_id", F.timestamp_seconds("s").alias("ts"), F.col("user").alias("event_type"))


SCHEMA = "event_id bigint, ts timestamp, event_type string"


@pytest.fixture(scope="module")
def log(spark):
    rows = requests(spark)
    return rows, event_stream.sliced(rows, "event_id", 8, "10 DAYS")


def test_keyed_limit_equals_batch(spark, log):
    rows, path = log
    assert spark.read.schema(SCHEMA).parquet(path).count() == 401
    stream = event_stream.limited_requests(event_stream.read_slices(spark, path, SCHEMA), "event_type", 2, 60, "2 days")
    got = sorted(map(tuple, event_stream.run_once(stream, "t", "append").collect()))
    assert got == sorted(map(tuple, ev.rate_limit(rows, "event_type", "ts", "event_id", 2, 60).collect())) and len(got) == 400


@pytest.mark.parametrize("buckets", [1, 3])
def test_keys_of_a_bucket_keep_their_own_limits(spark, log, buckets):
    rows, path = log
    stream = event_stream.limited_requests(event_stream.read_slices(spark, path, SCHEMA), "event_type", 2, 60, "1 hour", buckets)
    got = sorted(map(tuple, event_stream.run_once(stream, f"b{buckets}", "append").collect()))
    assert got == sorted(map(tuple, ev.rate_limit(rows, "event_type", "ts", "event_id", 2, 60).collect()))


def test_late_stream_goes_on_after_a_stop(spark, log, tmp_path):
    """Some files, a stop, then all: the same rows as without one."""
    rows, _ = log
    shaken = rows.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") - (F.col("event_id") % 7) * 3_600_000_000))
    place, half = f"file://{tmp_path}/log", event_stream.sliced(shaken.where("event_id < 200"), "event_id", 4)
    rest = event_stream.sliced(shaken.where("event_id >= 200"), "event_id", 4)
    run = lambda: event_stream.run_late(event_stream.read_slices(spark, place, SCHEMA), "stop", "event_type", f"file://{tmp_path}/check", f"file://{tmp_path}/out")
    for folder in (half, rest):
        for part in sorted(os.scandir(folder.removeprefix("file://")), key=lambda f: f.stat().st_mtime_ns):
            if part.name.endswith(".parquet"):
                os.makedirs(tmp_path / "log", exist_ok=True)
                os.link(part.path, tmp_path / "log" / part.name)
        got = {tuple(r) for r in run().collect()}
    want, last = set(), {}
    for r in sorted(shaken.select("event_id", "event_type", F.unix_micros("ts").alias("t")).collect()):
        if r["event_type"] in last and r["t"] < last[r["event_type"]]:
            want.add((r["event_id"], last[r["event_type"]] - r["t"]))
        last[r["event_type"]] = r["t"]
    assert got == want and len(want) > 20


def test_dispatch_runs_each_effect_once(spark, tmp_path):
    """A handler dies after its effect and before the log; the batch is replayed and nothing counts twice."""
    hub = event_stream.Dispatch(spark, f"file://{tmp_path}/hub")
    runs, failing = [], [True]

    def counted(rows):
        runs.append(rows.count())
        return rows.select("event_id")

    def flaky(rows):
        if failing[0]:
            raise ValueError("not yet")
        return rows.select("event_id")

    hub.on("x", "counted", counted)
    hub.on("x", "flaky", flaky)
    hub.on("y", "gone", counted)
    hub.off("gone")
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "event_id bigint, event_type string")
    assert hub.log().count() == 0 and hub.effects("counted", "event_id bigint").count() == 0
    rows.where("event_type = 'x'").select("event_id").write.parquet(f"file://{tmp_path}/hub/effects/handler=counted/batch=000000000")  # left by a stopped attempt
    assert hub.effects("counted", "event_id bigint").count() == 0
    hub.run(rows, 0)
    hub.run(rows, 0)
    hub.run(rows, 1)
    assert runs == [2, 2] and sorted(r["event_id"] for r in hub.effects("counted", "event_id bigint").collect()) == [1, 1, 2, 2]
    assert {(r["handler"], r["batch"], r["status"]) for r in hub.log().collect()} == {("counted", 0, "ok"), ("counted", 1, "ok"), ("flaky", 0, "error"), ("flaky", 1, "error")}
    assert hub.effects("flaky", "event_id bigint").count() == 0 and "not yet" in hub.log().where("status = 'error'").first()["message"]
    failing[0], hub.retry = False, True
    hub.run(rows, 0)
    assert runs == [2, 2] and hub.effects("flaky", "event_id bigint").count() == 2

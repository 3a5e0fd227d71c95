"""Entity join, cells around pivots and openings, against loops, on hard rows and hot keys."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import chunks, entity_join, openings, pivots
from mnemospark.operators import events as ev

# openings


def batches_by_loop(rows, most_rows, most_tokens):
    out, state = {}, {}
    for q, i, t in sorted(rows, key=lambda r: r[1]):
        b, n, total = state.get(q, (0, 0, 0))
        t = max(t or 0, 0)
        if n and (n >= most_rows or total + t > most_tokens):
            b, n, total = b + 1, 0, 0
        state[q] = (b, n + 1, total + t)
        out[i] = b
    return out


@pytest.fixture(scope="module")
def queued():
    rng = random.Random(3)
    return [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None, ""]), i, rng.choice([0, 1, 5, 30, 120, None, -4])) for i in range(2000)]


@pytest.mark.parametrize(("most_rows", "most_tokens"), [(10, 100), (3, 1000)])
def test_batches(spark, queued, most_rows, most_tokens):
    got = chunks.greedy_batches(spark.createDataFrame(queued, "q string, i bigint, t bigint"), "q", "i", "t", most_rows, most_tokens).collect()
    assert {r["i"]: r["batch"] for r in got} == batches_by_loop(queued, most_rows, most_tokens) and len(got) == len(queued)
    assert {r["i"]: r["q"] for r in got} == {i: q for q, i, _ in queued}


@pytest.mark.parametrize("chunk", [4096, 16])
def test_openings_by_chunks(spark, queued, chunk):
    """Windows of a time, some of which hold whole chunks."""
    rng = random.Random(5)
    rows, t = [], 0
    for q, i, _ in queued:
        t += rng.choice([0, 0, 0, 1, 1, 40])
        rows.append((q, i, t))
    table = openings.ranged_totals(spark.createDataFrame(rows, "q string, i bigint, t bigint"), "q", ["t", "i"])
    made = openings.openings(table, "q", ["i"], F.col("t"), F.col("t") + 100, F.lit(1 << 40), chunk)
    want, state = {}, {}
    for q, i, t in rows:
        number, opened, first, rank = state.get(q, (-1, None, 0, 0))
        rank += 1
        if opened is None or t - opened > 100:
            number, opened, first = number + 1, t, rank
        state[q] = (number, opened, first, rank)
        want[i] = (rank, number, first)
    assert {r["i"]: (r["rank"], r["opening"], r["opened"]) for r in made.collect()} == want


def test_no_task_walks_a_hot_key(spark):
    """A key of all rows: the largest run that Python sees is a chunk."""
    rows = spark.range(50_000).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 700_000).alias("ts"), F.col("id").alias("pos"))
    got = ev.rate_limit(rows, "k", "ts", "pos", 60, 60)
    allowed = {r["pos"] for r in got.where("allowed").collect()}
    want, opened, used = set(), None, 0
    for i in range(50_000):
        t = i * 700_000
        if opened is None or t - opened > 60_000_000:
            opened, used = t, 0
        used += 1
        if used <= 60:
            want.add(i)
    assert allowed == want and got.count() == 50_000


def test_openings_of_nothing(spark):
    empty = spark.createDataFrame([], "q string, i bigint, t bigint")
    assert chunks.greedy_batches(empty, "q", "i", "t").count() == 0


def test_balanced_has_no_single_partition(spark):
    rows = spark.range(1000).select(F.col("id").alias("o"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("m"), F.lit("x").alias("rank"))
    made = chunks.balanced(rows.drop("rank"), "m", "o")
    assert made.where("m = 'b'").count() == 700 and made.where("m = 'b'").agg(F.max("o")).first()[0] < made.where("m = 'a' AND o % 10 <> 0").agg(F.min("o")).first()[0]
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()


# pivots


def test_nearest_equals_scan_and_skips(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 5
    rows = [(i, (centres[i % 20] + rng.normal(size=8) * 0.3).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(30)] + [(6000, None), (6001, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found, took = pivots.nearest(queries, table, 5, block_rows=20)
    full = {i: v + [0.0] * (8 - len(v)) for i, v in rows if v is not None}
    got = defaultdict(list)
    for r in found.collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["distance"], 9)))
    for q in (i for i in full if i % 100 == 0):
        near = sorted((math.dist(full[q], v), i) for i, v in full.items() if i != q)[:5]
        assert sorted(got[q]) == [(n, i, round(d, 9)) for n, (d, i) in enumerate(near, 1)]
    share = took.agg((F.sum("compared") / F.sum("rows"))).first()[0]
    assert share < 0.3
    assert pivots.nearest(queries.limit(0), table, 5)[0].count() == 0 and pivots.nearest(queries, table.limit(0), 5)[0].count() == 0


# entity join


def hybrid(a, b):
    cos = 0.0
    both = a["v"] is not None and b["v"] is not None
    if both and len(a["v"]) == len(b["v"]):
        scale = math.sqrt(sum(x * x for x in a["v"])) * math.sqrt(sum(x * x for x in b["v"]))
        cos = sum(x * y for x, y in zip(a["v"], b["v"])) / scale if scale else 0.0
    one, two = a["name"], b["name"]
    row = list(range(len(two) + 1))
    for i, x in enumerate(one, 1):
        row, old = [i], row
        for j, y in enumerate(two, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    name = 1 - row[-1] / max(len(one), len(two)) if one and two else 0.0
    same, union = a["kind"] == b["kind"], a["obs"] | b["obs"]
    total = 0.4 * cos + 0.25 * name + 0.15 * same + (0.2 * len(a["obs"] & b["obs"]) / len(union) if union else 0)
    return total / (0.4 * both + 0.25 + 0.15 * same + 0.2 * bool(union))


@pytest.mark.parametrize(("least", "block"), [(0.7, 256), (0.8, 5)])
def test_entity_links_by_all_pairs(spark, least, block):
    rng = np.random.default_rng(6)
    names = ["alpha service", "alpha servise", "beta store", "gamma", "gama", "delta handler", "delta handlers", "x", ""]
    notes = [f"note {i}" for i in range(7)]
    centres = rng.normal(size=(5, 6))
    rows = []
    for i in range(220):
        vector = (centres[i % 5] + rng.normal(size=6) * 0.5).tolist() if i % 3 else None
        obs = [str(x) for x in rng.choice(notes, int(rng.integers(0, 4)))]
        rows.append((i, names[int(rng.integers(0, len(names)))] if i % 4 else names[0], ["class", "function", None][int(rng.integers(0, 3))], obs, vector))
    hot = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows += [(300 + i, "hot name", "class", ["Same Note", "same note", None], hot) for i in range(30)]
    rows += [(400 + i, f"other {i}", "class", ["same note"], hot) for i in range(20)]
    rows += [(500, "alpha service", "class", None, [0.0] * 6), (501, "alpha service", "class", None, [0.0] * 6), (502, None, None, None, None), (503, "short", "class", ["note 1"], [1.0, 2.0]), (None, "alpha service", "class", [], None)]
    table = spark.createDataFrame(rows, "id bigint, name string, entity_type string, observations array<string>, embedding array<double>")
    full = {i: {"name": n or "", "kind": k or "", "obs": frozenset(x.lower() for x in o or [] if x is not None), "v": tuple(v) if v is not None else None} for i, n, k, o, v in rows if i is not None}
    first = {}
    for i in sorted(full):
        first.setdefault(tuple(full[i].items()), i)
    want = set()
    for i, e in full.items():
        a = first[tuple(e.items())]
        if a != i and hybrid(e, e) >= least - 1e-9:
            want.add(("member", a, i))
    heads = sorted(set(first.values()))
    want |= {("similar", a, b) for n, a in enumerate(heads) for b in heads[n + 1 :] if hybrid(full[a], full[b]) >= least - 1e-9}
    got = entity_join.entity_links(table, least, block).collect()
    assert {(r["kind"], r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    for r in got[:200]:
        assert r["score"] == pytest.approx(hybrid(full[r["a"]], full[r["b"]]))


def test_entity_links_of_nothing_and_of_low_thresholds(spark):
    empty = spark.createDataFrame([], "id bigint, name string, entity_type string, observations array<string>, embedding array<double>")
    assert entity_join.entity_links(empty).count() == 0
    with pytest.raises(ValueError):
        entity_join.entity_links(empty, 0.3)


def test_entity_links_have_no_all_pairs_plan(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("name "), F.col("id")).alias("name"), F.lit("k").alias("entity_type"), F.array(F.lit("o")).alias("observations"), F.array(F.lit(1.0)).alias("embedding"))
    plan = entity_join.entity_links(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_entity_links_leave_tasks_scored_and_once(spark):
    rng = np.random.default_rng(8)
    words = ["", "a", "gamma", "gama", "ga\u00e9mma", "delta handlers"]
    pairs = [(x, y) for x in words for y in words]
    by_loop = {("gamma", "gama"): 1, ("gamma", "ga\u00e9mma"): 1, ("", "gamma"): 5, ("a", "gamma"): 4, ("gama", "delta handlers"): 12}
    got = dict(zip(pairs, entity_join.edit_distances(*map(list, zip(*pairs, strict=True))).tolist(), strict=True))
    assert all(got[p] == n == got[p[::-1]] for p, n in by_loop.items()) and all(got[w, w] == 0 for w in words)
    centres = rng.normal(size=(3, 5))
    rows = [(i, "name", 1, [7], (centres[i % 3] + rng.normal(size=5) * 0.4).tolist()) for i in range(90)] + [(90, "name", 1, [], None), (91, "name", 1, [], [0.0] * 5)]
    table = spark.createDataFrame(rows, "id bigint, name string, kind bigint, notes array<bigint>, vector array<double>")
    found = [(r["a"], r["b"]) for r in entity_join.near_vectors(table, 0.7, sent_rows=7).collect()]
    v = np.array([r[4] for r in rows[:90]])
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    assert sorted(found) == [(a, b) for a in range(90) for b in range(a + 1, 90) if v[a] @ v[b] >= 0.7]
    place = {"place": 1, "i": 0, "j": 0, "ordered": True, "kind": 1, "name": "n", "vector": None}
    held = [place | {"side": side, "id": i, "mark": mark, "notes": [3, 5, 10 + i, 20 + i]} for mark in (3, 5) for side in (0, 1) for i in range(4)]
    schema = pa.schema([("place", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("side", pa.int32()), ("ordered", pa.bool_()), ("mark", pa.int64()), ("id", pa.int64()), ("name", pa.string()), ("kind", pa.int64()), ("notes", pa.list_(pa.int64())), ("vector", pa.list_(pa.float64()))])
    told = {mark: [r for b in entity_join.block_links(iter([pa.RecordBatch.from_pylist([h for h in held if h["mark"] == mark], schema)]), 0.7, "names") for r in b.to_pylist()] for mark in (3, 5)}
    assert len(told[3]) == 6 and not told[5]  # two observations are shared, the place of the least one tells


# posting lists


@pytest.mark.parametrize(("k", "rare"), [(3, 1), (50, 2)])
def test_posting_search_equals_the_scan(spark, k, rare):
    from mnemospark.operators import search

    rng = random.Random(9)
    words = ["red", "reds", "widget", "widgets", "gear", "gearbox", "ox", "a", "b-c", "blue_bolt", "bolt"]
    rows = [(f"n{i:03d}", " ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice(["part", "box"]), [rng.choice(words)] if i % 2 else None) for i in range(150)]
    rows += [(f"m{i:03d}", "red widget", "part", None) for i in range(20)] + [("z", "", "part", []), ("y", None, "part", None)]
    nodes = spark.createDataFrame(rows, "id string, name string, entity_type string, observations array<string>")
    texts = ["red widget", "gear", "a", "boltt ox", "zzz", "", "Widgets!"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")
    got = defaultdict(list)
    for r in search.fuzzy_search_many(nodes, queries, k, rare=rare).collect():
        got[r["query_id"]].append((r["rank"], r["id"], round(r["score"], 9)))
    for i, text in enumerate(texts):
        found = [(r["id"], r["score"]) for r in search.fuzzy_search(nodes, text).collect()] if text else []
        best = sorted(found, key=lambda f: (-round(f[1], 9), f[0]))[:k]
        assert sorted(got[i]) == [(n, node, round(s, 9)) for n, (node, s) in enumerate(best, 1)], text


def test_posting_search_takes_equal_queries_once_and_in_blocks(spark):
    from mnemospark.operators import postings, search

    rows = [(f"n{i:03d}", ["red bolt", "red bolts", "Blue gear"][i % 3], "part", None) for i in range(60)]
    nodes = spark.createDataFrame(rows, "id string, name string, entity_type string, observations array<string>")
    queries = spark.createDataFrame([(i, ["red bolt", "RED  bolt!", "gear", "bolts"][i % 4]) for i in range(40)], "query_id bigint, text string")
    got = search.fuzzy_search_many(nodes, queries, 2, block_rows=2)
    want = {t: sorted(((r["id"], round(r["score"], 9)) for r in search.fuzzy_search(nodes, t).collect()), key=lambda f: (-f[1], f[0]))[:2] for t in ("red bolt", "gear", "bolts")}
    expected = {(q["query_id"], n, *f) for q in queries.collect() for n, f in enumerate(want[q["text"].lower().replace("  ", " ").strip("!")], 1)}
    assert {(r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got.collect()} == expected
    weights = pa.table({"wish": ["b", "a", "a"], "place": [1, 2, 1], "feature": ["x", "x", "y"], "w": [2.0, 0.5, 1.0], "read": [True, False, True], "least": [0.0, 1.2, 1.2]})
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "features": [["x", "z"], ["y", "x"], ["y"]]})
    met = [r for b in postings.matches(iter([batch]), postings.Wishes(weights), None) for r in b.to_pylist()]
    assert sorted((r["wish"], r["id"], r["raw"]) for r in met) == [("a", 2, 1.5), ("b", 1, 2.0), ("b", 2, 2.0)]


def test_far_vectors_take_a_product_only_and_cells_meet_once(monkeypatch):
    """All pairs were scored in full, by vectors, names, types and notes, and in both directions."""
    rng = np.random.default_rng(12)
    units = rng.normal(size=(400, 64))
    units[1::40], units[300] = units[::40], units[7]
    units /= np.sqrt((units * units).sum(axis=1))[:, None]
    points, sizes, plain = units[:2] * [[1.0], [-1.0]], [], entity_join.linked
    gap = entity_join.pivots.distances(units, points)
    cell = gap.argmin(axis=1)
    order = np.lexsort((gap.min(axis=1), cell))
    rows = pa.table({"id": np.arange(400), "kind": np.ones(400, np.int64), "name": ["n"] * 400, "notes": pa.array([[7]] * 400, pa.list_(pa.int64())), "vector": pa.array(units.tolist())}).take(order)
    units, cell, gap = units[order], cell[order].astype(np.int32), gap[order]
    batch = pa.RecordBatch.from_arrays([rows.to_struct_array().combine_chunks(), rows.column("vector").combine_chunks(), pa.array(cell), pa.array(gap.min(axis=1))], ["key", "vector", "cell", "reach"])
    monkeypatch.setattr(entity_join, "linked", lambda a, b, *rest: sizes.append(len(a.ids) * len(b.ids)) or plain(a, b, *rest))
    found = [(r["a"], r["b"]) for b in entity_join.cell_links(iter([batch]), rows, units.astype(np.float32), cell, gap, 0.7) for r in b.to_pylist()]
    full = dict(zip(rows.column("id").to_pylist(), units, strict=True))
    assert sorted(found) == [(a, b) for a in range(400) for b in range(a + 1, 400) if full[a] @ full[b] >= 0.7] and len(found) == 11
    assert 11 <= sum(sizes) < 1000 and len(set(cell)) == 2


@pytest.mark.parametrize("least", [0.7, 0.8])
def test_pairs_of_unlike_names_are_passed_over_by_observations(monkeypatch, least):
    """Every pair of a place of names was scored by vectors and types; what passes is told as by the loop."""
    rng = np.random.default_rng(13)

    def part(name, low):
        notes = [[5, *sorted(rng.choice(np.arange(10, 16), int(rng.integers(0, 4)), replace=False).tolist())] for _ in range(60)]
        vector = pa.array([rng.normal(size=3).tolist() if i % 2 else None for i in range(60)], pa.list_(pa.float64()))
        return entity_join.Part(pa.table({"id": np.arange(low, low + 60), "kind": rng.integers(0, 3, 60), "name": [name] * 60, "notes": pa.array(notes, pa.list_(pa.int64())), "vector": vector}))

    for name, most in (("red bolt", 3600), ("red bold", 3600), ("rod bald", 1800)):
        a, b = part("red bolt", 0), part(name, 100)
        with monkeypatch.context() as m:
            m.setattr(entity_join, "likely", lambda a, b, shared, least: np.ones(shared.shape, bool))
            want = entity_join.linked(a, b, least, "names", False, 5)
        got = entity_join.linked(a, b, least, "names", False, 5)
        assert sorted(zip(got[0].tolist(), got[1].tolist(), got[2].round(9).tolist(), strict=True)) == sorted(zip(want[0].tolist(), want[1].tolist(), want[2].round(9).tolist(), strict=True))
        values = np.unique(np.concatenate([a.notes, b.notes]))
        left = np.count_nonzero(entity_join.likely(a, b, a.holds(values) @ b.holds(values).T, least))
        assert len(want[0]) <= left < most and (len(want[0]) or name == "rod bald")

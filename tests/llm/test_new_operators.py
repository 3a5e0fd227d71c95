"""Filter audit, hard negatives and the MinHash forest against brute force, on hard rows and on the smallest tables."""

import itertools
import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mnemospark.llm import filter_audit, hard_negatives, minhash_forest

from .test_operators import clusters, low, words_of
from .test_queries import SF

# filter audit


def audit_by_hand(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    smallest, good, toxic = {}, set(), set()
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    for d, q, x in labels:
        good |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if x == 1 and d is not None else set()
    parts = defaultdict(list)
    for d, t, s in docs:
        t = t or ""
        w = words_of(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)}
        fails |= {"D": any(c in "#$%&*|" for c in t), "E": d is not None and d > smallest[t]}
        parts[s or ""].append((frozenset(k for k, v in fails.items() if v), d in good, d in toxic))
    rows, shapley = [], Counter()
    for part, own in parts.items():
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in own if letter in x[0] and not x[0] & before]
                kept = sum(not x[0] & (before | {letter}) for x in own)
                redundant = sum(letter in x[0] and bool(x[0] & before) for x in own)
                unique = sum(x[0] == {letter} for x in own)
                shapley[part, letter] += len(gone)
                rows.append((part, "".join(order), step, kept, len(gone), redundant, unique, sum(x[1] for x in gone), sum(x[2] for x in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit_on_hard_rows(spark):
    rng = np.random.default_rng(4)
    prose = lambda n, pool: " ".join(rng.choice(pool, n))
    rich, poor = [f"word{i}" for i in range(900)], ["the", "of", "Aa"]
    docs = [(i, prose(int(rng.integers(150, 260)), rich if i % 3 else poor) + ("" if i % 4 else " #"), ["x", "y", None, ""][i % 4]) for i in range(60)]
    docs += [(100 + i, docs[1][1], "x" if i % 2 else "z") for i in range(50)]  # copies
    docs += [docs[2], docs[2], (1, "UP " * 300, "x"), (None, docs[1][1], "x"), (None, None, None), (70, None, "y"), (71, "", "y"), (72, "\n", "q"), (-5, docs[3][1], "far")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(101, 1, None), (101, None, 1), (102, 1, 1), (102, 0, 0), (None, 1, 1), (1, 1, 0)]
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id bigint, text string, source string, part string, mask int")
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got = filter_audit.audit(table, marks)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == audit_by_hand(docs, labels)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert filter_audit.audit(table.limit(0), marks).count() == 0
    assert sorted(map(tuple, filter_audit.audit(table, marks.limit(0)).collect())) == audit_by_hand(docs, [])


def test_filter_audit_with_many_parts(spark):
    """More rows than Spark's own limit of a recursion would allow with its default of a million, in proportion."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id") % 7).alias("text"), F.col("id").cast("string").alias("source"))
    got = filter_audit.audit(rows, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert got.count() == 4000 * 600
    assert got.where("step = 1 AND substr(filter_order, 1, 1) = 'A'").agg(F.sum("removed")).first()[0] == 4000 * 24


def test_the_recursion_is_spark_s_own(spark):
    cells = spark.createDataFrame([("p", 3, 2, 1, 0), ("p", 0, 5, 1, 1)], "part string, mask int, n bigint, good bigint, toxic bigint")
    walk = {r["prefix"]: r for r in filter_audit.prefix_metrics(cells).collect()}
    assert len(walk) == 325 and walk["A"]["removed"] == 2 and walk["BA"]["redundant"] == 2 and walk["BA"]["removed"] == 0 and walk["CDE"]["kept"] == 7


# hard negatives


def negatives_by_hand(rows):
    one = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        one[i] = min(one.get(i, (label, q)), (label, q))
    score = lambda a, b: sum(x * y for x, y in zip(one[a][1], one[b][1]))
    out = []
    for a in (i for i in one if i % 50 == 0):
        near = sorted(((-score(a, b), b) for b in one if b != a and one[b][0] == one[a][0]))[:5]
        others = sorted((-score(a, b), b) for b in one if one[b][0] != one[a][0])
        for s, p in near:
            fit = [(n, -t) for t, n in others if 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, rank, n, -s, t) for rank, (n, t) in enumerate(fit, 1)]
    return sorted(out)


EMBEDDINGS = "vec_id bigint, label int, embedding array<float>, score string, q int"


def hard_vectors():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 12))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 6] + 0.4 * rng.normal(size=12)).astype("float32").tolist()) for i in range(-100, 500)]
    same = rows[130][2]
    rows += [(600 + i, i % 3, same) for i in range(120)]  # ties
    rows += [(750, 1, [0.0] * 12), (800, None, same), (850, 1, None), (900, 1, [float("nan")] * 12), (950, 1, [None, *same[1:]]), (None, 1, same), (1000, 2, [float("inf"), *same[1:]])]
    rows += [(1050, 2, same[:5]), (1051, 3, same + [1.0, 2.0]), (1100, 9, []), (1150, 77, same), (50, 3, same), (50, 3, same)]
    return rows


@pytest.mark.parametrize("round_rows", [1 << 14, 3])
def test_hard_negatives_on_hard_rows(spark, round_rows):
    rows = hard_vectors()
    table = spark.createDataFrame([(*r, "clash", 0) for r in rows], EMBEDDINGS)
    got = hard_negatives.mine(table, F.col("vec_id") % 50 == 0, round_rows=round_rows)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == negatives_by_hand(rows)
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(table.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def test_wide_numbers_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (rng.normal(size=4) * 1e6).astype("float32").tolist()) for i in range(100)]
    got = hard_negatives.mine(spark.createDataFrame([(*r, "", 0) for r in rows], EMBEDDINGS), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == negatives_by_hand(rows)


def test_walks_end_early_and_lose_nothing():
    """On clustered vectors most places of the lists are never reached; the best rows are those of a full scan."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.rint(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 30).astype(np.int64)
    labels, ids = rng.integers(0, 3, 6000), np.arange(6000)
    own = slice(0, 60)
    searches = hard_negatives.Searches(ids[own], labels[own], x[own], hard_negatives.fit_centroids(x[own]))
    parts = [(ids[i : i + 3000], labels[i : i + 3000], x[i : i + 3000]) for i in (0, 3000)]
    search, found, score, asked = searches.walk(iter(parts))
    assert asked < 0.5 * 60 * 6000
    got = defaultdict(list)
    for s, i, v in zip(search.tolist(), found.tolist(), score.tolist(), strict=True):
        got[s].append((-v, i))
    for a in range(60):
        assert sorted(got[a]) == sorted((-int(x[a] @ x[b]), b) for b in range(6000) if b != a and labels[b] == labels[a])[:5]


# MinHash forest


def forest_by_hand(docs):
    sets = []
    for _, t in docs:
        w = words_of(low(t or ""))
        sets.append(frozenset(tuple(w[i : i + 2]) for i in range(len(w) - 1)) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    group = clusters({s for s in sets if s}, linked)
    first = {}
    for (d, _), s in zip(docs, sets, strict=True):
        if s and d is not None:
            first[group[s]] = min(d, first.get(group[s], d))
    out = []
    for (d, _), s in zip(docs, sets, strict=True):
        c = first.get(group[s]) if s else d
        out.append((d, len(s), c, d == c))
    return Counter(out)


def hard_texts():
    rng = np.random.default_rng(8)
    prose = lambda n: rng.choice([f"w{i}" for i in range(3000)], n).tolist()
    docs, at = [], 0
    base = prose(120)
    for _ in range(70):  # near copies: most link with the base alone
        copy = list(base)
        for p in rng.integers(0, 120, int(rng.integers(1, 9))):
            copy[p] = f"z{rng.integers(0, 1 << 40)}"
        docs.append((at := at + 1, " ".join(copy)))
    chain = prose(100)
    for _ in range(25):  # each links with the next
        chain = chain[4:] + prose(4)
        docs.append((at := at + 1, " ".join(chain)))
    passage = prose(60)
    for _ in range(40):  # a common passage, no links
        docs.append((at := at + 1, " ".join(prose(70) + passage)))
    docs += [(at := at + 1, " ".join(prose(int(n)))) for n in rng.integers(1, 30, 40)]
    docs += [(500 - i, " ".join(base).upper()) for i in range(20)] + [(501, "\t" + "\n ".join(base))]  # copies
    docs += [(600, None), (601, ""), (602, " \n"), (603, "one"), (604, "One "), (605, "one two"), (606, "two one"), (607, "one two one two one"), (608, "one two one")]
    docs += [(None, " ".join(base)), (None, "alone null words"), (None, None), docs[0], (3, " ".join(prose(50)))]
    docs.append((700, " ".join(prose(20000))))
    docs.append((701, docs[-1][1] + " end"))
    return docs


@pytest.mark.parametrize("sizes", [{}, {"weight": 400}, {"weight": 3000, "region": 8, "levels": 2}, {"weight": 1000, "region": 2, "levels": 0}])
def test_minhash_forest_on_hard_rows(spark, sizes):
    docs = hard_texts()
    table = spark.createDataFrame([(*d, "clash", "clash", 1) for d in docs], "doc_id bigint, text string, component_id string, cid string, n int")
    got = minhash_forest.near_duplicates(table, **sizes)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == forest_by_hand(docs)
    if not sizes:
        assert minhash_forest.near_duplicates(table.limit(0)).count() == 0


def test_min_hashes_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        shared, own = rng.integers(0, 1 << 62, 800), rng.integers(0, 1 << 62, (2, 100))
        a, b = (minhash_forest.min_hashes(np.unique(np.concatenate([shared, x]))) for x in own)
        errors.append(np.mean(a == b) - 0.8)
        bits = [minhash_forest.sketch(x).view(np.uint64) for x in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= minhash_forest.FAR
    assert abs(np.mean(errors)) < 0.03


def test_miss_chance_of_the_forest():
    assert (1 - 0.8**minhash_forest.DEPTH) ** minhash_forest.TREES < 1e-6
    places = minhash_forest.picks(1, minhash_forest.TREES)
    assert places.shape == (minhash_forest.TREES, minhash_forest.DEPTH) and all(len(set(p)) == minhash_forest.DEPTH for p in places)


# registered queries

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", ["op1_decontaminate", "op11_filter_audit", "op12_hard_negatives", "op13_minhash_forest"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made, want = entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(made.columns) == sorted(names)
    assert sorted(map(tuple, made.select(*names).collect())) == sorted(want.fetchall())


@needs_tables
def test_op13(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, entry.queries()["op13_minhash_forest"](spark, SF).collect())) == forest_by_hand(docs)


def test_op3_counts_rows_as_documents(spark, tmp_path):
    """Rows that repeat an id are documents of their own, for the operator and for its SQL."""
    rows = [(i // 3, f"shared line\n own {i % 4}\nline of {i}") for i in range(30)] + [(1, None), (None, "shared line"), (None, "shared line")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["op3_line_runs"])
    names = [d[0] for d in want.description]
    made = entry.queries()["op3_line_runs"](spark, f"file://{tmp_path}")
    assert sorted(map(repr, map(tuple, made.select(*names).collect()))) == sorted(map(repr, want.fetchall()))

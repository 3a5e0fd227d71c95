"""The registered queries on the smallest tables, against SQL or brute force."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from mnemospark.llm import boosted_quality, license_scan

from .test_operators import clusters, fingerprint, kneser_ney_by_hand, low, phrase_places, words_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def leak_pairs(docs, items):
    own = {i: grams(t) for i, t in items.items()}
    return {(d, i) for d, t in docs.items() for g in [grams(t)] for i, o in own.items() if o and len(o & g) >= 0.8 * len(o) - 1e-9}


def components(docs):
    prints = {d: fingerprint(t) for d, t in docs.items()}
    group = clusters(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    first = defaultdict(lambda: 1 << 60)
    for d, p in prints.items():
        first[group[p]] = min(first[group[p]], d)
    return {d: (f"{p:016x}", first[group[p]]) for d, p in prints.items()}


def kept_lines(docs):
    key = lambda x: low(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    count = Counter(k for t in docs.values() for k in {key(x) for x in (t or "").split("\n")})
    return {d: "\n".join(x for x in (t or "").split("\n") if not (key(x) and count[key(x)] >= 10)) for d, t in docs.items()}


@pytest.mark.parametrize("name", ["op3_line_runs", "op6_chat_format"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(made.columns) == sorted(names)
    assert sorted(map(tuple, made.select(*names).collect())) == sorted(want.fetchall())


def test_op1(spark, docs, items):
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op1_decontaminate")} == leak_pairs(docs, items)


@pytest.mark.parametrize(("name", "parts", "rest", "limit"), [("op2_boosted_quality", 3, 1, 0.5), ("op5_weak_toxicity", 4, 2, 0.3)])
def test_classifiers(spark, docs, name, parts, rest, limit):
    rows = run(spark, name)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (fold(r["doc_id"], parts) == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)


def test_held_out_labels_are_not_learnt(spark):
    """Flipping the labels of held-out rows changes no score."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (boosted_quality.train(docs, x, allowed=~out) for x in (labels, flipped))
    assert np.array_equal(one.value, two.value) and np.array_equal(one.threshold, two.threshold)


def test_op4(spark, docs):
    for r in run(spark, "op4_license_scan"):
        n, found = phrase_places(docs[r["doc_id"]], license_scan.BASE_PHRASES)
        starts = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))


def test_op7(spark, docs):
    for r in run(spark, "op7_line_crf"):
        words = words_of(docs[r["doc_id"]])
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(marked))


def test_op8(spark, docs):
    want = dict(zip(docs, kneser_ney_by_hand([t for d, t in docs.items() if fold(d, 10)], list(docs.values())), strict=True))
    for r in run(spark, "op8_kneser_ney"):
        w = want[r["doc_id"]]
        assert r["held_out"] == (fold(r["doc_id"], 10) == 0) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert math.isclose(r["base_score"], w[3], rel_tol=1e-9) and math.isclose(r["score"], w[4], rel_tol=1e-9)


def test_op9(spark, docs):
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op9_simhash")} == components(docs)


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in texts.items()}


def pieces(texts):
    out = Counter()
    for d, ids in token_ids(texts).items():
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            out[(d, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    return out


def check_packing(rows, texts):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces(texts)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= math.ceil(sum(r["length"] for r in rows) / 4096) * 1.05 + 1


def test_op10(spark, docs):
    check_packing(run(spark, "op10_packing"), docs)


def test_pipeline(spark, docs, items):
    """Every stage by brute force, but for the classifier, whose scores are taken as they are."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    forest = boosted_quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in boosted_quality.score(table, forest).collect() if r["score"] >= 0.5}
    left = kept_lines({d: t for d, t in docs.items() if d in good})
    left = {d: left[d] for d, (_, c) in components(left).items() if d == c}
    bad = {d for d, _ in leak_pairs(left, items)}
    check_packing(corpus_pipeline.run(spark, SF).collect(), {d: t for d, t in left.items() if d not in bad})


def test_stages_keep_columns(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, SF).schema.simpleString() == table.schema.simpleString()

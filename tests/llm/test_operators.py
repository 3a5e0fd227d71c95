"""Operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm import (
    boosted_quality,
    chat_format,
    decontaminate,
    kneser_ney,
    license_scan,
    line_crf,
    line_runs,
    packing,
    simhash,
    weak_toxicity,
)

BLANK = r"[\x20\x09-\x0D]"
DOCS = "doc_id bigint, text string, score string, component_id string, label int"
SAMPLE = "/root/testdata/sf0.001"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words_of(text):
    return [w for w in re.split(BLANK + "+", text or "") if w]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(7)
    pool = ["the", "of", "Foo", "bar,", "ÉA", "ñu", "x", "MIT", "License", "cc", "by", "apache", "%%%"]
    make = lambda n: " ".join(rng.choice(pool, n))
    out = [make(int(n)) for n in rng.integers(1, 80, 40)]
    out += [f"{make(5)}\nShared Line here\n{make(4)}" for _ in range(12)]
    out += ["", None, " \t\n ", "one", "one two", out[3], out[3], make(6000), "tab\tin\x0bside\r\n  Shared line HERE \n"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "one two three", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_decontaminate(spark, docs, none, texts):
    item = " ".join(f"w{i}" for i in range(30))
    near = item.replace("w3 ", "Q ")
    far = item.replace("w3 ", "Q ").replace("w20 ", "Q ").replace("w11 ", "Q ")
    more = [(1000, "a b " + item.upper() + "! c"), (1001, "x " + near), (1002, far), (1003, " ".join(["z"] * 3000) + " " + item), (1004, "q short item"), (None, item), (1000, "a b " + item.upper() + "! c")]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    items = spark.createDataFrame([(1, item, 5), (2, "short item", 5), (3, None, 5), (4, "...", 5), (1, item, 5)], "item_id bigint, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(all_docs, items).collect()}
    grams = lambda t, n: {tuple(w[i : i + n]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))] for i in range(len(w) - n + 1)}
    want = set()
    for d in all_docs.collect():
        for i in items.collect():
            n = min(5, len(re.findall(r"\w+", i["text"] or "")))
            own = grams(i["text"], n) if n else set()
            if own and len(own & grams(d["text"], n)) >= 0.8 * len(own):
                want.add((d["doc_id"], i["item_id"]))
    assert got == want
    assert {(1000, 1), (1001, 1), (1003, 1), (1004, 2), (None, 1)} <= got and (1002, 1) not in got
    kept = decontaminate.drop_leaking(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_sketch_threshold_bounds_misses():
    assert decontaminate.needed(20, 64, 0.8, 1e-6) == 16
    k = decontaminate.needed(1000, 64, 0.8, 1e-6)
    below = sum(math.comb(800, x) * math.comb(200, 64 - x) for x in range(k)) / math.comb(1000, 64)
    assert 20 < k < 52 and below <= 1e-6


def test_line_runs(spark, docs, none, texts):
    rows = [t for _, t, *_ in docs.collect()]
    key = lambda x: low(re.sub(f"^{BLANK}+|{BLANK}+$", "", x))
    count = Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")})
    want = []
    for t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and count[key(x)] >= 3)]
        want.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    hot = line_runs.frequent_lines(docs, 3, 1, batches=5)
    for limit in (10, 0):  # by broadcast, by shuffle
        got = line_runs.drop_lines(docs, hot, 1, broadcast_keys=limit)
        assert sorted((r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == sorted(want)
        assert got.select("row.*").columns == [c for c in docs.columns if c != "text"]
    assert any(d for _, _, d in want)
    assert line_runs.dedup_lines(none).count() == 0


def fingerprint(text):
    words = words_of(low(text or ""))
    if not words:
        return 0
    width = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def clusters(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_simhash(spark, docs, bucket):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = " ".join(f"k{i}" for i in range(120))
    rows += [(2000 + i, base + " e" * i) for i in range(12)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket).collect()
    prints = {t: fingerprint(t) for _, t in rows}
    group = clusters(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    first = defaultdict(lambda: 1 << 60)
    for d, t in rows:
        if d is not None:
            first[group[prints[t]]] = min(first[group[prints[t]]], d)
    want = Counter((d, f"{prints[t]:016x}", first.get(group[prints[t]])) for d, t in rows)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_simhash_buckets_lose_no_link():
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(300)}
    signed = np.array(sorted(p - (1 << 64) if p >> 63 else p for p in prints), np.int64)
    edges = simhash.tree_edges(signed)
    group = clusters(signed.tolist(), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert len(edges) == len(signed) - len(set(group.values()))
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in edges)


def test_drop_near_duplicates(docs, none):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and ids.count(None) == 2
    assert simhash.near_duplicates(none).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    got = {r["u"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing(spark, docs, none, texts, tokenizer):
    from tokenizers import Tokenizer

    odd = ["it's, fine... ok!!,", "a<|endoftext|>b", "x²,y", "éa, É.", "don't.,", "1,000.5", " wide gap\x1c.", "Σς ΑΣ, ǅ."]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + list(enumerate(odd, 5000))
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), tokenizer, capacity=100, groups=8).toPandas()
    t = Tokenizer.from_file(tokenizer)
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 100):
            part = ids[k : k + 100]
            want[(-1 if d is None else d, k // 100, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 100
    assert packing.pack(none, tokenizer).count() == 0


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.clip(np.exp(rng.normal(6.4, 0.9, 50_000)).astype(int), 1, 4096)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    runs = packing.plan(histogram)
    used = Counter()
    for n, inside in runs:
        assert sum(inside) <= 4096
        for x in inside:
            used[x] += n
    assert used == histogram
    assert sum(n for n, _ in runs) <= 1.005 * math.ceil(lengths.sum() / 4096)
    placed = packing.places(runs)
    assert sum(high - low for _, low, high, _, _ in placed) == len(lengths)


@pytest.mark.parametrize("doc_id", ["id", "CAST(NULL AS BIGINT)", "7L"])
def test_numbering_splits_hot_lengths(spark, monkeypatch, doc_id):
    """Null and repeated ids too, with equal token ids."""
    monkeypatch.setattr(packing, "NUMBERED", 10)
    pieces = spark.range(400).select(F.expr(doc_id).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).alias("ids_crc32"), F.when(F.col("id") < 360, 5).otherwise(6).cast("long").alias("length"), F.col("id").alias("row_id"))
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"))
    got = packing.numbered(pieces, histogram).toPandas()
    assert sorted(got[got.length == 5].number) == list(range(360)) and sorted(got[got.length == 6].number) == list(range(40))
    assert got[got.length == 5].sort_values("number").row_id.tolist() != list(range(360))  # dealt to salts, not one row after another


def test_many_null_ids_are_packed(spark, tokenizer):
    docs = spark.createDataFrame([(None, f"text number {i % 3}") for i in range(60)], "doc_id bigint, text string")
    rows = packing.pack(docs, tokenizer).collect()
    assert len(rows) == 60 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 60


def kneser_ney_by_hand(train, test):
    seqs = [["<s>", *words_of(low(t or "")), "</s>"] for t in train]
    uni, pairs = Counter(w for s in seqs for w in s[1:]), Counter(p for s in seqs for p in zip(s, s[1:]))
    n, v = sum(uni.values()), len(uni)

    def disc(counts):
        c = [sum(x == i for x in counts) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0
        return [0, *(min(max(i - (i + 1) * y * c[i] / c[i - 1], 0), i) if c[i - 1] else 0 for i in (1, 2, 3))]

    before = Counter(b for _, b in pairs)
    d2, d1 = disc(list(pairs.values())), disc(list(before.values()))
    g1 = sum(d1[min(x, 3)] for x in before.values()) / len(pairs)
    lower = lambda w: max(before[w] - d1[min(before[w], 3)], 0) / len(pairs) + g1 / (v + 1)
    total, gamma = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        gamma[a] += d2[min(c, 3)]
    out = []
    for t in test:
        s = ["<s>", *words_of(low(t or "")), "</s>"]
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s[1:])
        full = 0.0
        for a, w in zip(s, s[1:]):
            p = lower(w)
            if total[a]:
                p = max(pairs[a, w] - d2[min(pairs[a, w], 3)], 0) / total[a] + gamma[a] / total[a] * p
            full += math.log10(p)
        out.append((len(s) - 1, sum(uni[w] > 0 for w in s[1:]), n, base, full))
    return out


def test_kneser_ney(spark, docs, none):
    odd = F.coalesce(F.col("doc_id") % 2, F.lit(1)) == 1
    got = kneser_ney.score(docs, kneser_ney.train(docs, odd, chars_per_shard=5000)).collect()
    rows = docs.collect()
    want = kneser_ney_by_hand([r["text"] for r in rows if r["doc_id"] is None or r["doc_id"] % 2], [r["text"] for r in rows])
    assert len(got) == len(rows)
    for r, w in zip(got, want, strict=True):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert (r["base_score"], r["score"]) == pytest.approx(w[3:], rel=1e-9)
    assert kneser_ney.score(none, kneser_ney.train(none)).count() == 0
    assert all(math.isfinite(r["score"]) for r in kneser_ney.score(docs, kneser_ney.train(none)).collect())


def phrase_places(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    found = []
    for p, label in phrases.items():
        own = p.split()
        found += [(i, label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return len(words), found


def test_license_scan(spark, docs, none):
    notice = license_scan.TEMPLATES["mit-text"]
    cut = notice.replace("free of charge, ", "").replace("sublicense, ", "relicense, ")
    more = [(1, "The MIT License (MIT) MIT License cc by cc by. " + notice), (2, cut), (3, "GNU GENERAL public license gnu general"), (4, notice[:120]), (5, " ".join(["gnu general public license"] * 500))]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = license_scan.scan_licenses(both).collect()
    for r, d in zip(got, both.collect(), strict=True):
        n, found = phrase_places(d["text"], license_scan.BASE_PHRASES)
        starts = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got[-5:]}
    assert "mit-text" in by[1]["labels"] and "mit-text" in by[2]["labels"] and "mit-text" not in by[4]["labels"]
    assert 0.8 < by[2]["score"] < 1 == by[1]["score"]
    assert license_scan.scan_licenses(none).count() == 0


def test_matching_statistics_by_brute_force():
    rng = np.random.default_rng(2)
    strings = [rng.integers(1, 4, int(n)).tolist() for n in rng.integers(1, 30, 8)]
    machine = license_scan.Automaton()
    for s in strings:
        machine.add(s)
    whole = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = rng.integers(1, 5, 400).tolist()
    state = length = 0
    for at, w in enumerate(text, 1):
        state, length = machine.step(state, length, w)
        assert length == max((n for n in range(at + 1) if tuple(text[at - n : at]) in whole), default=0)


RECORDS = [
    {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 3},
    {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]},
    {"prompt": "p", "completion": "c"},
    {"instruction": "i", "input": "", "output": "o"},
    {"messages": []},
    {"unknown": 1},
]


def test_chat_layouts(spark):
    rows = [(json.dumps(r),) for r in RECORDS] + [("{broken",), (None,)]
    got = [r["turns"] for r in chat_format.json_turns(spark.createDataFrame(rows, "record string")).collect()]
    plain = [None if t is None else [tuple(x) for x in t] for t in got]
    assert plain == [[("user", "hi"), ("assistant", "yo")], [("user", "a"), ("assistant", "")], [("user", "p"), ("assistant", "c")], [("user", "i"), ("user", ""), ("assistant", "o")], [], None, None, None]
    assert chat_format.layout_of_schema(T.StructType.fromDDL("turn int, extra int, role string, conv_id int, text string")).name == "turn_rows"
    with pytest.raises(ValueError):
        chat_format.layout_of_schema(T.StructType.fromDDL("a int"))


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\l\\b\\e", "<[\\]>", "", None, "é\n[", "\\\\<s>"]
    rows = [(c, i, ("user", "assistant", "system", None)[(i + c) % 4], t, "x") for c in range(5) for i, t in enumerate(nasty)] + [(0, 0, "user", nasty[0], "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").select("conv_id", "turn", "role", "text")
    made = chat_format.format_turns(chat_format.turn_rows(df))
    made = made.withColumn("back", chat_format.parse_formatted(F.col("formatted"))).withColumn("loss", chat_format.masked_text(F.col("formatted"), F.col("loss_spans")))
    for r in made.collect():
        assert r["back"] == r["turns"] and len(r["turns"]) == len(nasty) + (r["conv_id"] == 0)
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    assert chat_format.turn_rows(df.limit(0)).count() == 0


def test_line_rules(spark, docs, none):
    chain = line_crf.fit([b"good line here.\nother good line."] * 8 + [b"BUY!! NOW!!\nBUY!! NOW!!"] * 8, np.array([1] * 8 + [0] * 8))
    got = line_crf.judge(docs, chain).collect()
    for r, d in zip(got, docs.collect(), strict=True):
        text = d["text"] or ""
        words = words_of(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert line_crf.judge(none, chain).count() == 0
    assert line_crf.repeat_words([b"a"] * 30) == 30


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(1)
    chain = line_crf.Chain(rng.normal(size=(2, line_crf.N_FEATURES)), rng.normal(size=(2, 2)))
    x = rng.integers(0, 2, (8, line_crf.N_FEATURES)).astype(float)
    score = lambda path: sum(chain.emit[s] @ f for s, f in zip(path, x, strict=True)) + sum(chain.move[a, b] for a, b in zip(path, path[1:]))
    best = max(([k >> i & 1 for i in range(8)] for k in range(256)), key=score)
    assert chain.decode(x).tolist() == best


def held_out(docs, labels, scored, label, parts, rest, limit):
    fold = F.crc32(F.col("doc_id").cast("string")) % parts
    rows = scored.join(labels, "doc_id").where(fold == rest).select("score", label).toPandas()
    return ((rows["score"] >= limit) == (rows[label] > 0)).mean()


def test_quality_and_toxicity_on_held_out_rows(spark, none):
    docs, labels = (spark.read.parquet(f"{SAMPLE[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = lambda n: F.crc32(F.col("doc_id").cast("string")) % n
    forest = boosted_quality.train(docs, labels, allowed=fold(3) != 1)
    assert held_out(docs, labels, boosted_quality.score(docs, forest), "quality", 3, 1, 0.5) > 0.9
    model = weak_toxicity.train(docs, labels, allowed=fold(4) != 2)
    assert held_out(docs, labels, weak_toxicity.score(docs, model), "toxic", 4, 2, 0.3) > 0.9
    assert boosted_quality.score(none, forest).count() == weak_toxicity.score(none, model).count() == 0


def test_rare_toxic_words_are_voters(spark):
    """A word in under 1 % of many toxic rows is a voter, though the sample has few of them; of a word and its beginnings the word is one."""
    n = 6_000
    text = [f"plain{i % 50} words{i % 31} zzqqvvkk" if i < 30 else f"plain{i % 50} words{i % 31} evil{i}" if i < n else f"plain{i % 50} words{i % 31} calm{i}" for i in range(2 * n)]
    docs = spark.createDataFrame([(i, f"{t} row{i}") for i, t in enumerate(text)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(2 * n)], "doc_id bigint, toxic int")
    found = weak_toxicity.train(docs, labels).voters
    assert b"zzqqvvkk" in found and not any(k.endswith(b"*") and b"zzqqvvkk".startswith(k[:-1]) for k in found)
    rows = [(b"abcdefgh", 5, 0), (b"abcd*", 7, 0), (b"abcde*", 5, 0), (b"abcdef*", 5, 0), (b"wxyz1*", 4, 1), (b"wxyz*", 4, 1), (b"wxyz", 4, 1)]
    kept = weak_toxicity.without_repeats(spark.createDataFrame(rows, "key binary, n1 bigint, n0 bigint"))
    assert {bytes(r["key"]) for r in kept.collect()} == {b"abcdefgh", b"abcd*", b"wxyz1*", b"wxyz"}


def test_classifiers_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in boosted_quality.score(docs, boosted_quality.train(docs, empty)).collect()} == {0.5}
    assert max(r["score"] for r in weak_toxicity.score(docs, weak_toxicity.train(docs, empty)).collect()) < 0.01
    assert line_crf.train(docs, empty).emit.sum() == 0


def test_keep_good_passes_columns(docs):
    forest = boosted_quality.fit(np.zeros((0, len(boosted_quality.FEATURES))), np.zeros(0))
    assert sorted(map(str, boosted_quality.keep_good(docs, forest).collect())) == sorted(map(str, docs.collect()))


def test_correlated_voters_share_their_weight():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    one, other = rng.random(4000) < np.where(y, 0.7, 0.1), rng.random(4000) < np.where(y, 0.7, 0.1)
    v = np.column_stack([one, one, one, other]).astype(float)
    rate = lambda k: np.array([v[y == k][:, j].mean() for j in range(4)])
    post, rates, corr = weak_toxicity.label_model(v, rate(1), rate(0), 0.3)
    assert corr[0, 1] > 0.9 > 0.3 > corr[0, 3]
    alone = post[(one == 1) & (other == 0)].mean()
    assert 0.3 < alone < 0.9  # three copies don't count as three voices


def test_arrays_through_another_file_system(monkeypatch, tmp_path):
    from pyarrow import fs

    monkeypatch.setattr(kneser_ney, "_open", lambda path: (fs.LocalFileSystem(), path))
    kneser_ney.load.cache_clear()
    kneser_ney.save(f"{tmp_path}/a/b.keys", np.arange(5, dtype="<u8"))
    assert kneser_ney.load(f"{tmp_path}/a/b.keys", "<u8").tolist() == [0, 1, 2, 3, 4]
    assert len(kneser_ney.load(f"{tmp_path}/a/none", "<u8")) == 0
    kneser_ney.load.cache_clear()


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_buckets_do_not_depend_on_batches(size):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 40))
    prints = np.array(sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 40, (60, 2))} | {1 << 50, (1 << 50) + 1}), np.int64)
    rows = sorted((m, int(p) & m, int(p)) for m in simhash.block_masks() for p in prints)
    table = pa.table({"mask": [r[0] for r in rows], "a": [r[1] for r in rows], "b": [r[2] for r in rows]}, schema=pa.schema([("mask", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))
    edges = [(a, b) for batch in simhash.link_buckets(iter(table.to_batches(size))) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
    linked = {frozenset(e) for e in edges}
    joined = clusters(prints.tolist(), lambda a, b: frozenset((a, b)) in linked)
    true = clusters(prints.tolist(), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    same = lambda g: {frozenset(x for x in g if g[x] == r) for r in set(g.values())}
    assert same(joined) == same(true)

"""Methods by brute force: what the operators do inside, and rows that are hard for them."""

import itertools
import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from mnemospark.llm import boosted_quality, chat_format, decontaminate, kneser_ney, license_scan, line_crf, line_runs, packing, simhash, weak_toxicity

from .test_operators import BLANK, clusters, fingerprint, kneser_ney_by_hand, low, tokenizer, words_of  # noqa: F401
from .test_queries import SF, fold, grams, run

# line labelling


def features_by_hand(text):
    rows, seen, lines = [], set(), text.split("\n")
    for i, line in enumerate(lines):
        words = words_of(line)
        n, code = len(words), line.encode()
        solid = max(len(re.sub(BLANK, "", line).encode()), 1)
        count = lambda pattern: len(re.findall(pattern, line))  # noqa: B023, E731
        letters = count("[A-Za-z]")
        fresh, same = len(set(words)), sum(a == b for a, b in zip(words, words[1:]))
        rows.append([
            True, n == 0, 1 <= n <= 3, 4 <= n <= 10, 11 <= n <= 30, n > 30,
            count(r"[#*$%&|<>]") > 0.02 * solid, count(r"[#*$%&|<>]") > 0.08 * solid, count(r"\|") > 0.05 * solid,
            count("[A-Z]") > 0.3 * max(letters, 1), count("[A-Z]") > 0.7 * max(letters, 1), "!!" in line, count("!") > 0.05 * solid,
            n > 0 and fresh < 0.7 * n, n > 0 and fresh < 0.4 * n, same > 0.05 * max(n, 1), same > 0.3 * max(n, 1),
            n > 0 and words[-1][-1] in ".?!", solid < 3 * max(n, 1), solid > 9 * max(n, 1),
            n > 0 and line in seen, count("[0-9]") > 0.2 * solid, letters < 0.5 * solid,
            any(x in code.lower() for x in line_crf.NOTICES), i == 0, i == len(lines) - 1, count(r"[%$&*#]") > 0.03 * solid,
        ])
        seen.add(line)
    return rows


def test_line_features(monkeypatch):
    rng = np.random.default_rng(3)
    pool = ["a", "The", "BUY!!", "|", "éü", "cookie", "42", "x.", "%%%", "Log in", "\t", "same", "same", "longerwordhere"]
    texts = ["\n".join(" ".join(rng.choice(pool, int(rng.integers(0, 40)))) for _ in range(int(rng.integers(1, 12)))) for _ in range(60)] + ["", "\n\n", " \t", "a\n b\na\na"]
    split = [t.encode().split(b"\n") for t in texts]
    again = [line_crf.base_rules(t.encode(), own)[1] for t, own in zip(texts, split, strict=True)]
    for chunk in (1 << 19, 60):
        monkeypatch.setattr(line_crf, "CHUNK", chunk)
        got, words = line_crf.line_features(split, again)
        assert got.tolist() == [row for t in texts for row in features_by_hand(t)]
        assert words.tolist() == [len(words_of(x)) for t in texts for x in t.split("\n")]


def test_posteriors_by_all_paths():
    rng = np.random.default_rng(2)
    sizes, move = np.array([5, 3, 3, 1]), rng.normal(size=(2, 2))
    unary = rng.normal(size=(sizes.sum(), 2))
    total, content, moves = line_crf.Sequences(sizes).posteriors(unary, move)
    at, want_moves = 0, np.zeros((2, 2))
    for i, n in enumerate(sizes.tolist()):
        own, mass = unary[at : at + n], Counter()
        for path in itertools.product((0, 1), repeat=n):
            mass[path] = math.exp(sum(own[k, s] for k, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        z = sum(mass.values())
        assert total[i] == pytest.approx(math.log(z))
        assert content[at : at + n] == pytest.approx([sum(m for p, m in mass.items() if p[k]) / z for k in range(n)])
        for path, m in mass.items():
            for a, b in zip(path, path[1:]):
                want_moves[a, b] += m / z
        at += n
    assert moves == pytest.approx(want_moves)


def test_mixed_documents_get_both_states(spark):
    good, bad = "the calm river runs past the old mill and the trees.", "BUY!! NOW!! CHEAP!! BUY!! NOW!! CHEAP!! BUY!!"
    rows, rng = [], np.random.default_rng(0)
    for i in range(120):  # one line of every document is of the other sort
        n, y = int(rng.integers(25, 40)), i % 2
        lines = [f"{good[:-1]} w{i} v{k}." if (k == 7) != bool(y) else f"{bad} {i} {k}" for k in range(n)]
        rows.append((i, "\n".join(lines), y))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    chain = line_crf.train(docs.drop("quality"), docs.drop("text"))
    mixed = "\n".join([good, bad, bad, good, good])
    split = [mixed.encode().split(b"\n")]
    features, _ = line_crf.line_features(split, [line_crf.base_rules(mixed.encode(), split[0])[1]])
    assert chain.decode(features).tolist() == [1, 0, 0, 1, 1]
    shares = [r["content_share"] for r in line_crf.judge(docs, chain).collect()]
    assert sum(0 < s < 1 for s in shares) > 100


def test_op7_columns_and_verdict(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    agree = []
    for r in run(spark, "op7_line_crf"):
        text, seen, dup = docs[r["doc_id"]], set(), 0
        for line in text.split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", text)), dup)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["content_share"] >= 0.5)
        if r["doc_id"] in label and not r["base_failed"]:
            agree.append(r["kept"] == (label[r["doc_id"]] > 0))
    assert np.mean(agree) > 0.95


def test_training_takes_one_row_an_id(spark):
    rows = [(1, "a b c.", 9)] * 3 + [(1, "other text here", 9), (2, "x\ny", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id bigint, quality int")
    lines = line_crf.training_lines(docs, labels, "quality", 10).collect()
    assert sorted((r["doc_id"], r["y"], len(r["bits"])) for r in lines) == [(1, 1, 1), (2, 0, 2)]
    assert np.isfinite(line_crf.train(docs, labels).emit).all()


# packing


def test_letters_that_normalise_before_stops(tokenizer):  # noqa: F811
    cache = packing.TokenCache(tokenizer)
    letters = [c for c in map(chr, range(33, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and (c.isalnum() or ord(c) in range(0x300, 0x370))]
    for tail in (".", ",", "a."):
        words = [c + tail for c in letters]
        want = cache.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        bad = [w for w, a, b in zip(words, want, cache.encode([w.encode() for w in words]), strict=True) if np.array(a.ids, "<u4").tobytes() != b]
        assert not bad


def test_signs_and_blanks_of_all_kinds_end_parts(tokenizer):  # noqa: F811
    cache = packing.TokenCache(tokenizer)
    letters = [c for c in map(chr, range(33, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.isalnum()]
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [f"{c}&&&" for c in letters] + [f"{w}{a}{b}" for w in ("ab", "9", "é", "x's", "<|endoftext|>", "<|endoftext") for a in signs for b in ("", *signs)]
    texts += [f"{c}aB!{c}{c}cD." for c in map(chr, range(0x3100))] + ["", " ", "\n \x0b"]
    want = cache.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    bad = [t for low, high in packing.together([t.encode() for t in texts], 10_000)
           for t, a, b in zip(texts[low:high], want[low:high], cache.encode([t.encode() for t in texts[low:high]]), strict=True) if np.array(a.ids, "<u4").tobytes() != b]
    assert not bad


def test_words_that_are_plain_spare_the_normaliser(tokenizer, monkeypatch):  # noqa: F811
    cache = packing.TokenCache(tokenizer)
    whole, sent = cache.tokenizer, []

    class Counting:
        normalizer = whole.normalizer

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    texts = ["Some words&&& and a-z, $$$ signs!?", "words### of (both) kinds... é é&&&"]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(cache, "tokenizer", Counting())
    assert list(cache.encode([t.encode() for t in texts])) == want
    assert sorted(x for t in sent for x in t.split()) == ["(both", "a-z", "é"]


def test_texts_are_taken_together_up_to_a_size():
    sizes = [0, 5, 3, 20, 0, 0, 2, 9, 1]
    ranges = list(packing.together([b"x" * n for n in sizes], 10))
    assert [x for a, b in ranges for x in range(a, b)] == list(range(9))
    assert all(sum(sizes[a:b]) <= 10 or sum(map(bool, sizes[a:b])) == 1 for a, b in ranges)
    assert list(packing.together([])) == []


def test_random_texts_have_the_tokenizers_ids(tokenizer):  # noqa: F811
    rng = np.random.default_rng(8)
    alphabet = list("abZ09 .,!'-\n\t|éÉßİΣςक़ढ़़́日本語한ﬁ²½’…") + ["<|endoftext|>", "n't", "'s"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(1, 40)))) for _ in range(3000)]
    cache = packing.TokenCache(tokenizer)
    want = cache.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, a, b in zip(texts, want, cache.encode([t.encode() for t in texts]), strict=True) if np.array(a.ids, "<u4").tobytes() != b] == []


def test_configurations_keep_to_the_counts_and_the_bound():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 20):
        sizes = sorted(rng.choice(np.arange(700, 4096), n, replace=False).tolist(), reverse=True)
        counts = rng.integers(1, 3000, n).tolist()
        made, bound = packing.configurations(sizes, counts, 4096)
        used, sequences = Counter(), 0
        for times, use in made:
            assert times > 0 and sum(sizes[i] * k for i, k in use.items()) <= 4096
            sequences += times
            for i, k in use.items():
                used[i] += times * k
        assert all(used[i] <= counts[i] for i in range(n))
        left = sum(counts[i] - used[i] for i in range(n))
        assert bound <= sequences + left + 1e-6 and bound <= sum(counts)
        assert bound * packing.UNIT >= 0 and left <= 6 * n


def test_best_configuration_by_trying_all():
    rng = np.random.default_rng(6)
    for _ in range(20):
        sizes = np.array(sorted(rng.choice(np.arange(15, 60), 5, replace=False), reverse=True))
        prices = rng.random(5)
        price, made = packing.best_configuration(prices, sizes, 90)
        every = [p for p in itertools.product(range(7), repeat=5) if np.dot(p, sizes) <= 90]
        assert price == pytest.approx(max(np.dot(p, prices) for p in every)) and np.dot(made, sizes) <= 90 and np.dot(made, prices) == pytest.approx(price)


# language model


def test_repeated_rows_have_finite_scores(spark):
    train = spark.createDataFrame([(i, "one two three") for i in range(5)], "doc_id bigint, text string")
    other = spark.createDataFrame([(1, "one three two"), (2, "new words"), (3, None), (4, "one two three")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in kneser_ney.score(other, kneser_ney.train(train)).collect()}
    assert all(math.isfinite(x) for x in got.values()) and got[4] == max(got[4], got[1], got[2])
    model = kneser_ney.train(train)
    words = [b"one", b"two", b"three", b"\n", b"unseen"]
    reader = kneser_ney.Reader(model)
    for context in (b"one", b"three", b"never"):  # a distribution over the vocabulary and one unknown word
        one = [10 ** (reader.score([context + b" " + w])[0][3] - reader.score([context])[0][3] + 0) for w in words[:3]]
        assert all(0 < x for x in one)


def test_counts_beyond_32_bits(tmp_path):
    for counts in ([1, 2, 3], [1, 1 << 33, 5], []):
        path = f"{tmp_path}/{len(counts)}{sum(counts)}.counts"
        kneser_ney.save_counts(path, np.array(counts, np.int64))
        assert kneser_ney.load_counts(path, len(counts)).tolist() == counts


def test_fetched_arrays_are_bounded(monkeypatch, tmp_path):
    from pyarrow import fs

    monkeypatch.setattr(kneser_ney, "_open", lambda path: (fs.LocalFileSystem(), path))
    monkeypatch.setattr(kneser_ney, "CACHE_BYTES", 100)
    held = kneser_ney.Fetched()
    for i in range(5):
        kneser_ney.save(f"{tmp_path}/{i}", np.full(10, i, "<u4"))
    for i in (0, 1, 2, 3, 4, 0):
        assert np.frombuffer(held.get(f"{tmp_path}/{i}"), "<u4").tolist() == [i] * 10
    assert held.size <= 100 and len(held.held) == 2


# decontamination


def test_partition_thresholds():
    for c in (0, 3, 5, 6, 7, 9):
        sizes = range(1 << c, 2 << c)
        assert decontaminate.partition_needed(c, 64, 0.8, 1e-6) <= min(decontaminate.needed(n, 64, 0.8, 1e-6) for n in sizes)


def test_planted_leaks_of_all_sizes(spark):
    """Items of 1 to 400 words, whole or in part, in long texts; a start that all items share; copies of texts and items."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 5000)}"
    opening = "in this shared opening of every single item we say the same words".split()
    items = [(i, " ".join([*opening[: max(0, min(13, n - 3))], *(word() for _ in range(n))])) for i, n in enumerate([1, 2, 4, 5, 9, 20, 40, 63, 64, 65, 90, 130, 200, 400] * 3)]
    items += [(900 + i, items[i + 3][1]) for i in range(4)] + [(950, None), (951, " ,. ")]
    docs = []
    for i, (_, text) in enumerate(items[:42]):
        words = text.split()
        for part in (1.0, 0.95, 0.85, 0.7):
            cut = words[: max(1, int(len(words) * part))]
            docs.append((len(docs), " ".join([*(word() for _ in range(60)), *cut, *(word() for _ in range(60))])))
    docs += [(d + 1000, t) for d, t in docs[::7]] + [(5000, None), (5001, ""), (None, docs[0][1])]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    own = {i: grams(t) for i, t in items}
    width = {i: min(5, len((t or "").split())) for i, t in items}
    want = set()
    for d, t in docs:
        words = re.findall(r"\w+", t or "")
        for i, g in own.items():
            here = {tuple(words[k : k + width[i]]) for k in range(len(words) - width[i] + 1)} if g else set()
            if g and len(g & here) >= 0.8 * len(g) - 1e-9:
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want) > 100


def test_probes_hold_one_hash_of_every_match(spark):
    items = spark.createDataFrame([(i, " ".join(f"{'s' if k < 6 else i}x{k}" for k in range(30))) for i in range(20)], "item_id bigint, text string")
    rows = decontaminate.item_grams(items, 5, 64, 0.8, 1e-6)
    probes = decontaminate.item_probes(rows.drop("item_id").distinct()).toPandas()
    sizes = probes.groupby("item_key").size()
    assert set(sizes) == {26 - int(probes["needed"].iloc[0]) + 1}
    assert probes.groupby("h").item_key.nunique().max() == 1  # the shared shingles probe nothing


# chat


def test_fingerprints_are_sparks(spark):
    made = spark.range(1).select(*[chat_format.path_fingerprint(F.array(*[F.lit(p) for p in (*x.paths, "other")]), x).alias(x.name) for x in chat_format.LAYOUTS]).first()
    assert [made[x.name] for x in chat_format.LAYOUTS] == [x.fingerprint for x in chat_format.LAYOUTS]
    assert len({x.fingerprint for x in chat_format.LAYOUTS}) == len(chat_format.LAYOUTS) == len({x.name for x in chat_format.LAYOUTS})


MORE_RECORDS = [
    ({"instruction": "i", "input": "n", "output": "o", "text": "all", "system": "s"}, [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")]),
    ({"system": "be kind", "messages": [{"role": "user", "content": "hi", "name": "x"}]}, [("system", "be kind"), ("user", "hi")]),
    ({"conv_id": 4, "turn": 1, "prompt": "p", "messages": [{"role": "user", "content": "hi"}]}, [("user", "hi")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "[1]"}]}, [("user", "ab"), ("assistant", "[1]")]),
    ({"messages": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, [("user", "q"), ("assistant", "r")]),
    ({"prompt": "p", "response": None, "score": 3}, [("user", "p"), ("assistant", "")]),
]


def test_extra_fields_never_break_a_record(spark):
    rows = [(json.dumps(r), "x") for r, _ in MORE_RECORDS]
    got = chat_format.json_turns(spark.createDataFrame(rows, "record string, turns string")).collect()
    assert [[tuple(t) for t in r["turns"]] for r in got] == [want for _, want in MORE_RECORDS]


def test_tables_of_every_kind(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a", "p"), (1, 2, "assistant", "b", "p"), (1, 2, "assistant", None, "p")], "conv_id bigint, turn int, role string, text string, prompt string")
    assert [tuple(t) for t in chat_format.table_turns(rows).first()["turns"]] == [("user", "a"), ("assistant", ""), ("assistant", "b")]
    lists = spark.createDataFrame([(7, [("human", "a"), ("gpt", None)], "S"), (8, None, None), (9, [], None)], "id int, conversations array<struct<from:string,value:string>>, system string")
    got = {r["id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat_format.table_turns(lists).collect()}
    assert got == {7: [("system", "S"), ("user", "a"), ("assistant", "")], 8: None, 9: []}
    parts = spark.createDataFrame([([("user", [("text", "x"), ("text", "y")])],)], "messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert [tuple(t) for t in chat_format.table_turns(parts).first()["turns"]] == [("user", "xy")]
    pairs = spark.createDataFrame([("q", "a", 1)], "question string, answer string, extra int")
    assert [tuple(t) for t in chat_format.table_turns(pairs).first()["turns"]] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat_format.turn_rows(pairs)


def test_helper_names_are_safe(spark):
    df = spark.createDataFrame([([("user", "a<"), ("assistant", "b")], "mine", "also", "old")], "turns array<struct<role:string,text:string>>, _blocks string, _blocks_ string, formatted string")
    made = chat_format.format_turns(df)
    r = made.first()
    assert (r["_blocks"], r["_blocks_"]) == ("mine", "also") and r["formatted"].startswith("<s>")
    assert made.columns == ["turns", "_blocks", "_blocks_", "formatted", "loss_spans"]


# near-duplicates and lines


@pytest.mark.parametrize("limit", [500_000, 0])
def test_rows_of_different_texts_are_never_lost(spark, limit):
    base = " ".join(f"k{i}" for i in range(100))
    rows = [(1, "alpha beta gamma delta", "a"), (1, "one two three four five", "b"), (2, "red green blue yellow", "c"), (3, base, "d"), (4, base + " e", "e"), (3, base, "d"), (3, base, "c"), (5, base, "f"), (None, base, "g"), (6, None, "h"), (6, "", "i"), (7, "", "j")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, text_key string")
    kept = simhash.drop_near_duplicates(docs, broadcast_keys=limit)
    assert kept.columns == docs.columns
    prints = {t: fingerprint(t) for _, t, _ in rows}
    group = clusters(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    got = kept.collect()
    assert Counter(group[prints[r["text"]]] for r in got if r["doc_id"] is not None) == Counter(set(group.values()))
    assert {(r["doc_id"], r["text"]) for r in got} >= {(1, "alpha beta gamma delta"), (1, "one two three four five"), (2, "red green blue yellow"), (3, base), (None, base)}
    assert [r["text_key"] for r in got if r["doc_id"] == 3] == ["c"]


def test_runs_leave_no_tables(spark):
    docs = spark.createDataFrame([(i, f"all share this\nown {i}\nfew {i % 20}") for i in range(200)], "doc_id bigint, text string")
    hot = line_runs.frequent_lines(docs, 10, 1, batches=7)
    assert hot.count() == 21  # the line of all, and twenty of ten documents each
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_merges_need_no_exchange(spark):
    runs = line_runs.LineRuns(spark, 3)
    many = spark.range(2000).select((F.col("id") * 7919 % 1000).alias("h1"), (F.col("id") % 10).alias("h2"), F.lit(1).cast("bigint").alias("n"), (F.col("id") % 3).cast("int").alias("batch"))
    stored = runs.store(many.repartition(runs.buckets, "h1", "h2").groupBy("batch", "h1", "h2").agg(F.sum("n").alias("n")), "batch")
    part = lambda b: spark.table(stored).where(F.col("batch") == b).select("h1", "h2", "n")
    first = runs.store(part(0))
    plan = part(1).join(runs.hot(first).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.levels = [[first, runs.store(part(1)), runs.store(part(2))]]
    merged = spark.table(runs.merge(runs.levels[0])).collect()
    want = Counter()
    for r in many.collect():
        want[(r["h1"], r["h2"])] += 1
    assert {(r["h1"], r["h2"]): r["n"] for r in merged} == want


# licences


def chains_by_hand(words, template, min_match, max_gap, coverage):
    """Best covered share by maximal common runs and every chain of them."""
    found = []
    for d, p in itertools.product(range(len(words)), range(len(template))):
        if words[d] == template[p] and not (d and p and words[d - 1] == template[p - 1]):
            n = 0
            while d + n < len(words) and p + n < len(template) and words[d + n] == template[p + n]:
                n += 1
            if n >= min_match:
                found.append((d, p, n))
    best = {}
    for d, p, n in sorted(found):
        best[d, p, n] = n
        for d0, p0, n0 in list(best):
            lap = max(0, d0 + n0 - d, p0 + n0 - p)
            if d0 < d and p0 < p and lap < n and d - d0 - n0 <= max_gap and p - p0 - n0 <= max_gap:
                best[d, p, n] = max(best[d, p, n], best[d0, p0, n0] + n - lap)
    share = min(1.0, max(best.values(), default=0) / len(template))
    return share if share >= coverage else 0.0


def test_license_labels_and_score_by_hand(spark):
    rng = np.random.default_rng(4)
    templates = {"one": "a b c d e f g h i j k l", "two": "the m n o p q r s t u"}
    rows = []
    for i in range(150):
        words = list(rng.choice(list("vwxyz"), 8)) + templates[("one", "two")[i % 2]].split() + list(rng.choice(list("vwxyz"), 5))
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(0, len(words)))] = str(rng.choice(list("xyz")))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = license_scan.scan_licenses(docs, {"m": "em"}, templates, min_match=2, max_gap=3, coverage=0.5).collect()
    for r, (_, text) in zip(got, rows, strict=True):
        share = {t: chains_by_hand(text.split(), w.split(), 2, 3, 0.5) for t, w in templates.items()}
        base = text.split().count("m")
        assert r["n_base"] == base and r["score"] == pytest.approx(max(0.5 * bool(base), *share.values()))
        assert set(filter(None, r["labels"].split(","))) == {t for t, s in share.items() if s} | ({"em"} if base else set())


def test_one_word_phrases_and_many_notices(spark):
    notice = license_scan.TEMPLATES["apache-2.0"]
    docs = spark.createDataFrame([(1, "the gpl is here, GPL"), (2, f"{notice} x y z. " * 6000)], "doc_id bigint, text string")
    one, two = license_scan.scan_licenses(docs, {"gpl": "gpl", "": "none"}).collect()
    assert (one["n_base"], one["first_word"], one["last_word"], one["labels"]) == (2, 1, 4, "gpl")
    assert len(two["spans"]) == 6000 and two["score"] == 1


# classifiers


def test_flattened_trees_by_hand():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, len(boosted_quality.FEATURES)))
    y = (x[:, 3] + 0.5 * x[:, 7] > 0).astype(float)
    forest = boosted_quality.fit(x, y, trees=5, depth=3)

    def leaf(t, row):
        k = 0
        for _ in range(forest.depth):
            k = 2 * k + 1 + int(row[forest.feature[t, k]] > forest.threshold[t, k])
        return forest.value[t, k - (2**forest.depth - 1)]

    by_hand = [1 / (1 + math.exp(-(forest.base + sum(leaf(t, row) for t in range(5))))) for row in x[:50]]
    assert forest.score(x[:50]) == pytest.approx(by_hand)


def test_first_split_by_trying_all():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, len(boosted_quality.FEATURES))).round(1)
    y = (x[:, 5] > 0.3).astype(float)
    forest = boosted_quality.fit(x, y, trees=1, depth=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    grad, hess = y - p, np.full(len(y), p * (1 - p))
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for edge in np.unique(np.quantile(x[:, j], np.linspace(0, 1, boosted_quality.BINS + 1)[1:-1])):
            left = x[:, j] <= edge
            gain = sum(grad[m].sum() ** 2 / (hess[m].sum() + 1) for m in (left, ~left)) - grad.sum() ** 2 / (hess.sum() + 1)
            if gain > best[0] + 1e-9 and min(hess[left].sum(), hess[~left].sum()) >= 1e-2:
                best = (gain, j, edge)
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    assert forest.value[0] == pytest.approx([0.2 * grad[m].sum() / (hess[m].sum() + 1) for m in (left, ~left)])


def test_label_model_by_loops():
    rng = np.random.default_rng(8)
    y = rng.random(300) < 0.4
    v = np.column_stack([rng.random(300) < np.where(y, a, b) for a, b in ((0.8, 0.1), (0.6, 0.05), (0.2, 0.3))]).astype(float)
    one, zero, prior = v[y].mean(0), v[~y].mean(0), 0.4
    post, rates, corr = weak_toxicity.label_model(v, one, zero, prior, rounds=1)
    for i in range(300):
        odds = prior / (1 - prior)
        for j in range(3):
            if v[i, j]:
                odds *= one[j] / zero[j]
        assert post[i] == pytest.approx(odds / (1 + odds))
    for j in range(3):
        assert rates[1, j] == pytest.approx((sum(post * v[:, j]) + 100 * one[j]) / (post.sum() + 100))
    assert np.allclose(np.diag(corr), 1, atol=1e-3)


def test_held_out_toxic_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (weak_toxicity.train(docs, x, allowed=~out) for x in (labels, flipped))
    assert one.voters == two.voters and np.array_equal(one.weights, two.weights) and one.base == two.base
    for r in run(spark, "op5_weak_toxicity"):
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2)


def test_equal_texts_with_two_labels_count_once_as_toxic(spark):
    rows = [(i, f"calm words here {i % 40}") for i in range(80)] + [(100 + i, f"evilword stays {i % 10}") for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, int(d >= 100 and d % 3 == 0 or d < 0)) for d, _ in rows], "doc_id bigint, toxic int")
    keys = {r["doc_id"]: (r["n"], r["y"]) for r in weak_toxicity.labelled_keys(docs, labels.withColumnRenamed("toxic", "y")).collect()}
    assert len(keys) == len({t for _, t in rows}) and keys[0] == (2, 0) and all(y == 1 for d, (_, y) in keys.items() if d >= 100)
    models = [weak_toxicity.train(docs.repartition(n), labels) for n in (1, 3)]
    assert models[0].voters == models[1].voters and np.allclose(models[0].weights, models[1].weights)


# pipeline


def test_pipeline_on_hard_rows(spark, tmp_path, tokenizer):  # noqa: F811
    """Nulls, empty and repeated rows, ids that two texts share, columns with the names of the operators' own."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(rng.choice([f"word{i}" for i in range(400)], n))
    shared = "every page has this very same footer line"
    rows = [(i, f"{prose(60)}.\n{shared}", "en", "web", i, "c") for i in range(30)]
    rows += [rows[0], rows[1], (2, prose(70), "en", None, None, None), (None, prose(50), None, None, 1, "c"), (40, None, "en", "web", 0, "c"), (41, "", None, None, None, None), (None, None, None, None, None, None)]
    item = prose(20)
    rows += [(50, f"{prose(30)} {item} {prose(30)}", "en", "web", 1, "c")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string"
    for name, table in (("full", rows), ("none", [])):
        base = f"file://{tmp_path}/{name}"
        spark.createDataFrame(table, schema).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
        docs = spark.read.parquet(f"{base}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, base)
            assert made.columns == docs.columns
            docs = spark.createDataFrame(made.collect(), schema)
        left = docs.collect()
        packed = corpus_pipeline.run(spark, base).collect()
        assert Counter(r["doc_id"] for r in packed) == Counter(r["doc_id"] for r in left)
        if name == "full":
            assert not any(shared in (r["text"] or "") for r in left) and 50 not in {r["doc_id"] for r in left}
            ids = Counter(r["doc_id"] for r in left)
            assert ids[2] == 2 and ids[0] == ids[1] == 1 and set(range(30)) <= set(ids)
        else:
            assert packed == []


def test_empty_schema_is_no_layout():
    with pytest.raises(ValueError):
        chat_format.layout_of_schema(T.StructType([]))

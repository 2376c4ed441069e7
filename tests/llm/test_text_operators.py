"""Operators 1, 3, 5, 8 and 9 against brute force over the whole small table."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from gristmill.llm import maxent, phrases, pieces, quality, registry, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(900001, None), (900002, ""), (900003, "one"), (900003, "one"), (900004, "a b\n\na b\n" * 60), (None, "no id"), (900005, "Straße Ünïcode ▁ x  y" + "\t" + "é" * 30), (900006, "word " * 30000), (900007, "ends in a space "), (900008, " "), (900009, "  two  ")]


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)

def test_run_sums():
    r = np.random.default_rng(1)
    for n in (1, 5, 40, 5000):
        key, g, src = np.sort((r.pareto(1, n) * 3).astype(int)), r.normal(size=(n, 4)), r.permutation(n)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        assert np.allclose(maxent.run_sums(g, src, first), np.add.reduceat(g[src], first, axis=0))


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'x' source", "1 as n", "2 as h", "3 as key", "4 as c")
    return real.selectExpr("*", "1 as n", "2 as h", "3 as key", "4 as c").unionByName(odd)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_lm_counts_and_base(docs, texts):
    got = sorted((r.asDict() for r in maxent.op1(docs).collect()), key=lambda r: (r["doc_id"] or 0, r["n_tokens"]))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c: Counter = Counter()
    for i, t in texts:
        if not held(i):
            c.update(WORD.findall(lower(t)) + [0])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in texts:
        w = WORD.findall(lower(t)) + [0]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, held(i), len(w), sum(c[x] > 0 for x in w), base))
    want.sort(key=lambda r: (r[0] or 0, r[2]))
    assert len(got) == len(want)
    for g, (i, h, k, known, base) in zip(got, want, strict=True):
        assert (g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (i, h, k, known, n)
        assert g["base_score"] == pytest.approx(base, rel=1e-9)
        assert g["score"] <= 0
    mine = sum(g["score"] for g in got if g["held_out"])
    assert mine > sum(g["base_score"] for g in got if g["held_out"])  # learns more than word counts


def test_lm_probabilities_sum_to_one(docs, spark):
    from gristmill.llm.store import Scratch

    _, lex, model, _ = maxent.train(docs, Scratch(spark))
    t = maxent.Tokens([b"the cat sat on the mat"], lex)
    at = t.targets[3:4]
    f = t.features(at)
    top = np.exp(maxent._log_softmax(maxent._logits(model["cb"], model["cw"], f)))[0].astype(float)
    assert top.sum() == pytest.approx(1, abs=1e-4)
    inner = [np.exp(maxent._log_softmax(maxent._logits(model["ib"][[k]], model["iw"], maxent.inner_features(f, np.array([k]))))).sum() for k in range(maxent.HEAD)]
    assert inner == pytest.approx([1] * maxent.HEAD, abs=1e-4)


def brute_rules(t: str) -> tuple[int, ...]:
    w = WORD.findall(t)
    seen: set[str] = set()
    dup = 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    in_repeat = [False] * len(w)
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            in_repeat[i : i + 8] = [True] * 8
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, sum(in_repeat)


def test_rules(docs, texts):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.op3(docs).collect())
    want: Counter = Counter()
    for i, t in texts:
        b = brute_rules(t)
        want[(i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0])] += 1
    assert got == want
    assert not rules.op3(docs).filter("base_failed and kept").count()


def test_rule_sketches_merge(docs, spark):
    rows = rules.measured(docs)
    for k, c in rules._shares().items():
        rows = rows.withColumn(f"m_{k}", c)
    whole = rules.thresholds(rules.sketch(rows))
    halves = rules.sketch(rows.filter("doc_id % 2 = 0")).unionByName(rules.sketch(rows.filter("not (doc_id % 2 = 0) or doc_id is null")))
    merged = halves.groupBy("lang", "source", "measure", "bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    told = lambda x: {(r.lang, r.source): dict(r.limits) for r in x.collect()}
    assert told(whole) == told(rules.thresholds(merged))


def test_fingerprints(docs, texts):
    got = phrases.op5(docs).collect()
    known = [(i, t) for i, t in texts if i is not None and i != 900003]  # ties have their own order
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    following = {order[k][0]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    for i, t in known:
        half = len(t) // 2
        form = t[: len(t) - half] + following[i][:half]
        assert by[i].n_chars == len(t)
        assert by[i].edited_sha256 == hashlib.sha256(form.encode()).hexdigest()
        assert by[i].fingerprint == phrases._hex(phrases.fingerprint(t))
        assert by[i].edited_fingerprint == phrases._hex(phrases.fingerprint(form))
        assert by[i].near_next == phrases.likeness(phrases.fingerprint(t), phrases.fingerprint(following[i]))
    long = [r for r in got if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.1 + np.mean([r.near_next for r in long])


def test_pieces_equal_the_library(docs, texts):
    import sentencepiece

    path = registry.tokenizer_file()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want: Counter = Counter()
    for i, t in texts:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
    got = pieces.digest_documents(docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_piece_spans_cover_the_text(docs, texts):
    rows = pieces.encode_documents(docs, registry.tokenizer_file(), ["doc_id", "text"]).collect()
    for r in rows:
        assert list(r.starts[1:]) == list(r.ends[:-1]) or not r.text
        assert (r.starts[0], r.ends[-1]) == (0, len((r.text or "").encode()))


def test_classifier_holds_out_and_learns(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op9(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    told = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out and r.quality is not None]
    pos, neg = [s for s, q in told if q == 1], [s for s, q in told if q == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9


def test_classifier_without_labels(docs, spark):
    got = quality.op9(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in got} == {0.5} and len(got) == docs.count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for run in (maxent.op1, rules.op3, phrases.op5, lambda d: quality.op9(d, labels), lambda d: pieces.digest_documents(d, registry.tokenizer_file())):
        assert run(none).count() == 0


def test_thresholds_of_bad_groups(spark):
    def text(i, bad):
        return " ".join(f"w{i}x{j}" + "####" * bad for j in range(30))

    rows = [(i, text(i, False), "en", "copies") for i in range(60)] + [(100 + i, text(999, True), "en", "copies") for i in range(40)]
    rows += [(200 + i, text(i, i % 3 == 0), "en", "third") for i in range(60)]  # a third of distinct texts is bad
    rows += [(300, text(1, True), "en", "one"), (301, text(2, False), "en", "one"), (302, text(3, True), "xx", None), (303, text(4, False), "xx", None), (304, None, None, None)]
    got = {r.doc_id: r.kept for r in rules.op3(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: t is not None and "#" not in t for i, t, _, _ in rows}
    assert rules.op3(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0

"""Operators 11, 12 and 13 against SQL and brute force, on whole small tables and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from gristmill.llm import collocations, registry, simhash, trie

from tests import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.mark.parametrize("name", ["op11_collocations", "op13_prefix_trie"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, name, size):
    d = f"/root/testdata/{size}"
    n, mine, theirs = compare.difference(registry.queries()[name](spark, d), compare.tables(d), registry.oracle_sql()[name])
    assert not mine and not theirs
    assert n > 10


# ---- 11: collocations


def phrases_by_brute_force(docs, least, longest, top):
    times, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                times[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    rows = []
    for lang, f in times.items():
        often = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        inside = {w[i : i + k] for w, a in often.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if a >= often.get(w[i : i + k], 1 << 60)}
        found = []
        for w, a in often.items():
            if w not in inside:
                score, cut = min((1000 * a * total[lang] // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), f[w[:cut]], f[w[cut:]]))
        for rank, (score, a, w, le, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, w.decode(), -a, le, r, total[lang], -score))
    return sorted(rows)


def phrase_rows(docs):
    rng = random.Random(3)
    words = [f"W{i}" for i in range(12)] + ["é", "Straße", "\x0bx", "a b"]
    out = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",", "!", "\n"]) for _ in range(rng.randrange(60)))) for _ in range(docs)]
    return [*out, ("en", None), ("en", ""), (None, " . , "), ("en", "a a a a a a a a"), ("en", "a a a a a a a a"), ("xx", "one"), ("en", "w1 w2 " * 20_000)]


def test_phrases_against_brute_force(spark):
    rows = phrase_rows(300)
    docs = spark.createDataFrame([(la, t, 1, 2, 3) for la, t in rows], "lang string, text string, n int, chunk int, phrase int").repartition(7)
    for least, longest, top in ((5, 5, 2000), (3, 4, 7), (40, 2, 100)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least, longest, top).collect())
        assert got == phrases_by_brute_force(rows, least, longest, top)


def test_phrases_in_small_chunks(spark, monkeypatch):
    rows = phrase_rows(200)[:-1]
    monkeypatch.setattr(collocations, "CHUNK", 400)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(3)
    words = collocations.chunks(docs).collect()
    assert len({w.chunk for w in words}) == len(words)
    got = sorted(tuple(r) for r in collocations.collocations(docs, 4).collect())
    assert got == phrases_by_brute_force(rows, 4, 5, 2000)


def test_phrase_scores_pass_64_bits(spark):
    at = spark.createDataFrame([(10**12, 10**15, 10**12 + 7, 10**12 + 1)], "a long, n long, l long, r long").selectExpr(f"{collocations._SCORE} as s", "10 s2")
    assert at.first().s == 1000 * 10**12 * 10**15 // ((10**12 + 7) * (10**12 + 1))


# ---- 12: SimHash


def print_by_brute_force(text, k=3):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(len(w) - k, 0) + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(prints):
    """{fingerprint: a name of its component}, by comparing all pairs."""
    x = np.array(sorted(set(prints)), np.uint64)
    forest = simhash._Forest(len(x))
    for i, f in enumerate(x):
        j = [k for k in range(len(x)) if int(f ^ x[k]).bit_count() <= 3]
        forest.join(np.full(len(j), i), np.array(j))
    return {int(f): int(r) for f, r in zip(x, forest.root, strict=True)}


def simhash_by_brute_force(rows):
    prints = [print_by_brute_force(t) for _, t in rows]
    group = near_groups(prints)
    least = {}
    for (d, _), f in zip(rows, prints, strict=True):
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], 1 << 62))
    return Counter((d, f"{f:016x}", least.get(group[f])) for (d, _), f in zip(rows, prints, strict=True))


def test_simhash_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in simhash.op12(docs).collect()) == simhash_by_brute_force(rows)


def test_simhash_planted(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", "one", "One two", "one TWO", "é ü", "word " * 5000, "x" * 4000]
    for n in (40, 150, 400):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(w))
        texts += [" ".join(base)] * 20
    rng.shuffle(texts)
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, "one"), (7, "one")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, list int").repartition(5)
    assert Counter(tuple(r) for r in simhash.op12(docs).collect()) == simhash_by_brute_force(rows)


@pytest.mark.parametrize("short, compared", [(16, 4096), (2, 4096), (2, 3)])
def test_links_of_long_lists(spark, monkeypatch, short, compared):
    """Clouds of near fingerprints, so that lists are long: pairs, comparison and look-up give the same components."""
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(simhash, "_COMPARED", compared)
    r = np.random.default_rng(7)
    prints = set()
    for _ in range(3):
        centre = int(r.integers(0, 1 << 63)) * 2 + 1
        prints |= {centre ^ sum(1 << int(b) for b in r.choice(24, int(r.integers(1, 9)), replace=False)) for _ in range(250)}
        prints |= {centre ^ sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in range(40)}
    x = np.array(sorted(prints), np.uint64)
    a, b = [], []
    for at, shared in enumerate(simhash.LISTS):
        key = x & simhash.MASKS[at]
        by = np.argsort(key, kind="stable")
        i, j = simhash.run_links(np.full(len(x), at), key[by], x[by])
        a.append(i)
        b.append(j)
    a, b = np.concatenate(a), np.concatenate(b)
    forest, at = simhash._Forest(len(x)), {int(f): i for i, f in enumerate(x)}
    forest.join(np.array([at[int(f)] for f in a]), np.array([at[int(f)] for f in b]))
    want = near_groups(prints)
    assert [want[int(f)] for f in x] == forest.root.tolist()
    assert len(a) <= 56 * len(x) * max(short - 1, 1)


# ---- 13: prefix trie


def trie_by_brute_force(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    plain = {c: [(r[1], t[1]) for _, r, t in sorted(v)] for c, v in told.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in plain}
    made = {c: plain.get(c - int(np.fmod(c, 20)), [])[: h[c]] + v[h[c] :] for c, v in plain.items()}
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        own = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not children[k]
    out = Counter()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(k))
        out[(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_rows():
    rng = random.Random(11)
    rows = []
    for c in [*range(120), -7, -20, -33, 1 << 40, 5000, 5001]:
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a b", "A b", "x", " ", "one two three"])))
    same = [(0, "user", "hello you"), (1, "assistant", "all of us")]
    rows += [(c, *t) for c in range(200, 290) for t in same]
    rows += [(c, *same[0]) for c in range(300, 330)]
    rows += [(400, 0, None, None), (400, None, "user", "first"), (400, 1, "user", None), (401, 1, "b", "x"), (401, 1, "a", "y"), (401, 1, "a", "y"), (None, 0, "user", "lost")]
    rows += [(600, t, "user", f"turn {t % 3}") for t in range(90)] + [(601, t, "user", f"turn {t % 3}") for t in range(91)]
    return rows


@pytest.mark.parametrize("block, pack", [(4096, 1000), (8, 3)])
def test_trie_against_brute_force(spark, monkeypatch, block, pack):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PACK", pack)
    rows = conversation_rows()
    got = trie.op13(spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, a int, depth int").repartition(6))
    assert Counter(tuple(r[k] for k in NODE) for r in got.collect()) == trie_by_brute_force(rows)


def test_trie_without_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.op13(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "a")]  # crc32("1") % 4 is 3: the only turn is cut and conversation 0 is absent
    assert Counter(tuple(r[k] for k in NODE) for r in trie.op13(spark.createDataFrame(rows, schema)).collect()) == trie_by_brute_force(rows)


@pytest.mark.parametrize("name, schema", [("op11_collocations", "lang string, text string"), ("op12_simhash", "doc_id long, text string")])
def test_empty_table(spark, name, schema):
    of = {"op11_collocations": collocations.op11, "op12_simhash": simhash.op12}[name]
    assert of(spark.createDataFrame([], schema)).count() == 0

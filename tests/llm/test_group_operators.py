"""Operators 2, 4, 6, 7 and 10 and the pipeline's stages against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from gristmill.llm import chat, jaccard, mixing, passages, registry, warc

from tests import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t: str, k: int) -> frozenset:
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)) if w else frozenset()


def groups_by_brute_force(texts, k, percent):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t, k) for _, t in texts]
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(least[find(i)], d)
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(texts))


def planted(seed: int) -> list[tuple[int, str]]:
    """Random texts, with chains of edits, exact copies and many sets that share one frequent line."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(vocabulary) for _ in range(14))
    out: list[str] = ["", " \n", "one", "one two", "one two", "One TWO three four", "one two three four"]
    for n in (4, 6, 9, 12, 20, 30, 60, 150, 400):
        for _ in range(5):
            w = [rng.choice(vocabulary) for _ in range(n)]
            out.append(" ".join(w))
            for _ in range(4):
                w = list(w)
                for _ in range(max(1, n // 50)):
                    w[rng.randrange(n)] = rng.choice(vocabulary)
                out.append(" ".join(w))
    out += [line] * 40 + [f"{line} {rng.choice(vocabulary)}" for _ in range(60)] + [f"{line} {' '.join(rng.choice(vocabulary) for _ in range(30))}" for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out, 1000))


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_planted(spark, k, percent):
    texts = planted(k)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id long, text string, key int, n int").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.grouped(docs, k, percent).collect())
    assert got == groups_by_brute_force(texts, k, percent)


def test_jaccard_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op2(docs).collect())
    assert got == groups_by_brute_force(texts, 4, 85)


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(90001, None, None), (90002, "a b c", None), (90002, "a b c", None), (None, "x y", "zz"), (90003, "", "zz")], docs.schema))
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
        left -= sum(3.0 * size[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out = mixing.op4(docs).collect()
    assert len(out) == len(rows)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.op4(docs.repartition(7)).collect()))
    taken: Counter = Counter()
    named = defaultdict(set)
    for r in rows:
        named[(r.doc_id, len(WORD.findall(r.text or "")))].add(r.source)
    for r in out:
        source = next(iter(named[(r.doc_id, r.size)]))
        assert r.source_size == size[source] and r.target == pytest.approx(target[source], rel=1e-9)
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[source] += r.taken
    for s in order:
        most = max((k[1] for k, v in named.items() if s in v), default=0)
        assert target[s] - most <= taken[s] <= target[s] + 1e-6


def test_stage_mixes_rows_of_one_id_apart(spark):
    import corpus_pipeline as p

    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(None, words(f"n{i}", 5 + i), "web") for i in range(30)] + [(7, words(f"s{i}", 40 + i), "web") for i in range(12)] + [(8, words("t", 9), "zz")] * 3 + [(8, words("u", 11), "zz"), (9, None, None), (None, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want: Counter = Counter()
    for r in mixing.op4(docs).collect():
        want[(r.doc_id, r["size"])] += r.times
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in p.mix(spark, docs, "").collect())
    assert got == +want


def test_chat_against_sql(spark, sf):
    q, sql = registry.queries()["op6_chat_format"], registry.oracle_sql()["op6_chat_format"]
    n, mine, theirs = compare.difference(q(spark, sf), compare.tables(sf), sql)
    assert n and not mine and not theirs


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a</turn>\n### user: b\\h\\b"), (2, 5, None, ""), (2, 5, None, ""), (None, 0, "assistant", "x"), (3, None, "as:sistant", "#<\\")]
    got = {r.conv_id: r for r in chat.op6(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == sha(("user", ""), ("assistant", "a</turn>\n### user: b\\h\\b"))
    assert got[1].loss_chars == len("a</turn>\n### user: b\\h\\b") and got[2].n_turns == 2 and got[3].turns_sha256 == sha(("as:sistant", "#<\\"))
    assert got[None].loss_chars == 1 and got[-7].n_turns == 2


def test_best_branch_of_a_tree(spark):
    #      1 -> 2 -> 4 (score 1 + 2 + 5), 1 -> 3 -> 5 -> 6 (1 + 1 + 1 + 1)
    nodes = spark.createDataFrame([(7, 1, None, 1.0), (7, 2, 1, 2.0), (7, 3, 1, 1.0), (7, 4, 2, 5.0), (7, 5, 3, 1.0), (7, 6, 5, 1.0)], "tree long, node long, parent long, score double")
    rows = chat.best_paths(nodes, keep=2).collect()
    path = lambda rank: [r.node for r in sorted((r for r in rows if r["rank"] == rank), key=lambda r: -r.back)]
    assert path(1) == [1, 2, 4] and path(2) == [1, 3, 5, 6]


def test_cycles_have_no_path(spark):
    rows = [(1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (2, 1, 1, 1.0), (3, 1, None, 1.0), (3, 2, 1, 1.0), (3, 2, 1, 5.0), (3, 4, 5, 1.0), (3, 5, 4, 1.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = sorted((r.tree, -r.back, r.node) for r in chat.best_paths(nodes).collect())
    assert got == [(3, -1, 1), (3, 0, 2)]


def test_shards_are_disjoint_and_cover_all_draws(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.row_key: r for r in mixing.mix_documents(docs, docs_per_block=8).collect()}
    draws = [(k, d["pass"]) for k, r in taken.items() for d in r.draws]
    assert len(draws) == len(set(draws)) == sum(r.times for r in taken.values())
    rows = mixing.mixed_rows(docs).collect()
    want = Counter((r.doc_id, d["pass"], d.shard, d.place) for r in mixing.mix_documents(docs).collect() for d in r.draws)
    assert Counter((r.doc_id, r.draw["pass"], r.draw.shard, r.draw.place) for r in rows) == want


def test_small_sets_meet_by_subsets():
    texts = [b"a b c d e f g h i j", b"b c d e f g h i j k"]
    import numpy as np

    none = np.zeros(0, np.uint64)
    token, key, n, subset, heavy, rare = jaccard.prefixes(texts, 1, 80, none, np.zeros(0, np.int64), 20, set())
    one, two = ({t for t, s, k in zip(token, subset, key, strict=True) if s and k == x} for x in dict.fromkeys(key.tolist()))
    assert one & two
    sizes = {n: 1000 for n in range(6, 14)}
    assert jaccard.boundary(sizes, 0.5, 85) > 6


def test_warc_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(900001, None, None), (900002, "u", ""), (900003, "u\r\nx", "é" * 9), (900004, "u", "é" * 9)], "page_id long, url string, html string")
    pages = pages.select("page_id", "url", "html").unionByName(odd)
    rows = pages.collect()
    last: dict[str, int] = {}
    for r in rows:
        last[r.html or ""] = max(last.get(r.html or "", r.page_id), r.page_id)
    want: Counter = Counter()
    for r in rows:
        p = (r.html or "").encode()
        again = r.page_id != last[r.html or ""]
        want[(r.page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", last[r.html or ""] if again else None)] += 1
    assert Counter(map(tuple, warc.op7(pages).collect())) == want


class _File(io.BytesIO):
    def read_at(self, n, offset):
        self.seek(offset)
        return self.read(n)


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    each = [warc.record("response", i, "http://x/", (f"<p>{i}</p>" * 50).encode()) for i in range(6)]
    parts = [gzip.compress(x) if packed else x for x in each]
    at = len(parts[0]) + len(parts[1])
    data = bytearray(b"".join(parts))
    data[at + len(parts[2]) // 2] ^= 0xFF  # breaks record 2
    data[at + len(parts[2]) : at + len(parts[2])] = b"junk" * 10
    cut = bytes(data[: len(data) - len(parts[5]) // 2])  # and the last one is cut short
    out = list(warc.salvage(_File(cut), len(cut)))
    ids = [int(x[3]["warc-record-id"][10:-1]) for x in out if x[0] == "record"]
    gaps = [(x[1], x[2]) for x in out if x[0] == "gap"]
    assert ids == [0, 1, 3, 4]
    assert gaps == [(at, at + len(parts[2]) + 40), (len(data) - len(parts[5]), len(cut))]


def _salvaged(data: bytes):
    out = list(warc.salvage(_File(data), len(data)))
    return [int(x[3]["warc-record-id"][10:-1]) for x in out if x[0] == "record"], [x[1:] for x in out if x[0] == "gap"]


def test_warc_salvage_within_members(spark):
    each = [warc.record("response", i, "http://x/", random.Random(i).randbytes(3000)) for i in range(8)]
    bad = bytearray(each[1])
    bad[-100] ^= 0xFF
    member = gzip.compress(each[0] + bytes(bad) + each[2])
    # a member with a bad record, a plain record, a member of two, plain junk, a member
    data = member + each[3] + gzip.compress(each[4] + each[5]) + b"junk" + gzip.compress(each[6])
    ids, gaps = _salvaged(data)
    assert ids == [0, 2, 3, 4, 5, 6]
    at = data.index(b"junk")
    assert gaps == [(0, len(member), "digest", (len(each[0]), len(each[0]) + len(each[1]))), (at, at + 4, "version line", None)]
    # one member a file: cut short, and with a broken checksum
    whole = gzip.compress(b"".join(each))
    ids, gaps = _salvaged(whole[: len(whole) * 6 // 8])
    assert ids == [0, 1, 2, 3, 4] and [g[:3] for g in gaps][-1] == (0, len(whole) * 6 // 8, "truncated member")
    ids, gaps = _salvaged(whole[:-8] + b"\0\0\0\0" + whole[-4:] + each[0])
    assert ids == [*range(8), 0] and len(gaps) == 1
    # records that only the broken member vouches for are quarantined
    plain = [re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", x) for x in each]
    assert _salvaged(gzip.compress(b"".join(plain)))[0] == list(range(8))
    assert _salvaged(gzip.compress(b"".join(plain))[:-3])[0] == []
    # large records and members, longer than every window
    big = [warc.record("response", i, "u", random.Random(i).randbytes(700_000)) for i in range(3)]
    assert _salvaged(gzip.compress(b"".join(big), 1))[0] == [0, 1, 2] and _salvaged(b"".join(big))[0] == [0, 1, 2]
    assert _salvaged(b"") == ([], []) and _salvaged(b"\x1f\x8b\x08") == ([], [(0, 3, "truncated member", None)])


def test_passages(spark):
    rng = random.Random(5)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    shared, common, short = words(80), words(60), words(40)
    edited = list(shared)
    edited[40] = "changed"
    texts = {1: words(30) + shared + words(20), 2: words(200) + shared, 3: words(10) + edited + words(10), 4: words(90), 5: words(40) + short, 6: short + words(70), 7: [], 8: shared[:3]}
    texts |= {100 + i: words(i % 9) + common + words(20) for i in range(40)}
    rows = [(d, " ".join(w)) for d, w in texts.items()] + [(9, None), (None, " ".join(shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = passages.op10(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} | set(range(100, 140))
    two = [r for r in got if r.doc_id == 2 and not r.is_first]
    assert [(r.start_word, r.end_word, r.first_doc, r.first_start) for r in two] == [(200, 280, 1, 30)]
    cut = {r.doc_id: r.text for r in passages.dedup(docs).collect()}
    assert cut[1] == rows[0][1] and cut[4] == rows[3][1] and cut[5] == rows[4][1] and cut[6] == rows[5][1]
    assert cut[2] == " ".join(texts[2][:200])
    assert all(len(cut[d].split()) == len(texts[d]) - 60 for d in range(101, 140))
    assert cut[9] is None and cut[None] == " ".join(shared) and cut[7] == ""


def covered(got, doc: int, start: int, end: int) -> bool:
    """Whether the document's later occurrences hold all words from start to end."""
    held = {w for r in got if r.doc_id == doc and not r.is_first for w in range(r.start_word, r.end_word)}
    return held >= set(range(start, end))


def test_passages_with_inserted_and_deleted_words(spark):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    texts, places = {}, {}
    for k in range(60):  # 88 words with one edit have a similarity of 0.8 or more
        n = rng.randrange(88, 99)
        passage, at = words(n), rng.randrange(30, n - 30)
        other = {0: passage[:at] + ["new"] + passage[at:], 1: passage[:at] + passage[at + 1 :], 2: passage[:at] + ["new"] + passage[at + 1 :]}[k % 3]
        before = rng.randrange(40)
        texts[2 * k], texts[2 * k + 1] = words(rng.randrange(40)) + passage + words(20), words(before) + other + words(30)
        places[2 * k + 1] = (before, before + len(other))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(5)
    got = passages.op10(docs).collect()
    assert [d for d, (a, z) in places.items() if not covered(got, d, a, z)] == []
    assert {r.doc_id for r in got if not r.is_first} == set(places)


def test_passages_behind_a_first_that_fails(spark):
    rng = random.Random(7)
    words = lambda n: [f"v{rng.randrange(9000)}" for _ in range(n)]
    boiler, line = words(30), words(14)
    texts = {d: words(rng.randrange(60)) + boiler + words(40) for d in range(30)} | {d: words(rng.randrange(60)) + line + words(50) + line for d in range(30, 60)}
    places = {}
    for k in range(60, 90, 3):  # two passages in the boilerplate's company, and one that begins with the line
        for j, passage in enumerate((boiler + words(25), words(25) + boiler, line + words(40))):
            a, z = 300 + 10 * k + j, 1300 + 10 * k + j
            texts[a], texts[z] = words(20) + passage + words(20), words(35) + passage + words(9)
            places[z] = (35, 35 + len(passage))
    for k in range(20):  # a first copy with every 20th word changed, then two exact copies
        passage = words(60)
        bad = [f"x{i}" if i % 20 == 19 else w for i, w in enumerate(passage)]
        texts[3000 + k], texts[4000 + k], texts[5000 + k] = words(9) + bad, words(12) + passage, passage + words(15)
        places[5000 + k] = (0, 60)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(5)
    got = passages.op10(docs).collect()
    assert [d for d, (a, z) in places.items() if not covered(got, d, a, z)] == []
    assert {r.doc_id for r in got if not r.is_first} == set(places)


def test_passages_do_not_depend_on_unrelated_documents(spark):
    """Twelve families: 40 badly edited copies, an exact copy, one with a word inserted; then the same beside 300 documents with a common line."""
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(20000)}" for _ in range(n)]
    texts, places = {}, {}
    for k in range(12):
        passage, at = words(88), rng.randrange(30, 58)
        for j in range(40):  # every 7th to 9th word changed: a few windows in common, no passage
            texts[1000 + 40 * k + j] = words(rng.randrange(30)) + [f"y{k}.{j}.{i}" if i % 16 in (3, 11) and i % 3 != j % 3 else w for i, w in enumerate(passage)] + words(9)
        a, z = 5000 + 2 * k, 5001 + 2 * k
        texts[a], texts[z] = words(12) + passage + words(15), words(7) + passage[:at] + ["new"] + passage[at:] + words(20)
        places[z] = (7, 7 + 89)
    line = words(42)
    noise = {20000 + d: words(rng.randrange(60)) + line + words(40) for d in range(300)}
    found = []
    for more in ({}, noise):
        docs = spark.createDataFrame([(d, " ".join(w)) for d, w in (texts | more).items()], "doc_id long, text string").repartition(5)
        got = passages.op10(docs).collect()
        assert [d for d, (a, z) in places.items() if not covered(got, d, a, z)] == []
        assert not any(r.doc_id >= 20000 for r in got)
        found.append({(r.doc_id, r.start_word, r.end_word) for r in got if not r.is_first})
    assert found[0] == found[1]


def test_shared_tokens_of_rows():
    rng = np.random.default_rng(9)
    for high in (4, 60, 5000):
        x, y = rng.integers(0, high, (7, 50)), rng.integers(0, high, (5, 50))
        x[:3, 40:], y[2:, 45:] = -1, -2
        want = [[sum((Counter(p.tolist()) & Counter(q.tolist())).values()) for q in y] for p in x]
        assert passages.shared_tokens(x, y).tolist() == want
    assert passages.shared_tokens(np.full((2, 9), -1), np.full((3, 9), -2)).tolist() == [[0] * 3] * 2


def test_places_that_may_hold_a_passage():
    rng = np.random.default_rng(10)
    n, least = 2 * passages.REACH, passages.LEAST
    x = rng.integers(0, 1 << 30, n)
    y = np.where(rng.random((60, n)) < np.linspace(0.05, 0.4, 60)[:, None], -2, x)
    y[50:] = -2
    for k in range(50, 60):  # a common run of 41 to 50 tokens around the place
        y[k, 70 : 61 + k] = x[70 : 61 + k]
    held = np.array([np.isin(x, q) for q in y])
    spans = [(i, j) for i in range(passages.REACH + 1) for j in range(max(passages.REACH + 1, i + least), n + 1)]
    want = [any(h[i] and h[j - 1] and 5 * h[i:j].sum() >= 4 * (j - i) for i, j in spans) for h in held]
    assert passages.may_hold_place(x, y).tolist() == want and 5 < sum(want) < 55
    assert all(may for may, q in zip(want, y, strict=True) if passages.holds_place(x, q))


def test_places_of_a_repeated_word_are_one_row(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    texts = [" ".join([*(word() for _ in range(60)), *["again"] * (150 + 3 * i), *(word() for _ in range(60))]) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    members = passages.shared_windows(docs).cache()
    sizes = members.groupBy(F.col("sig").alias("_g")).count()
    got = passages.in_blocks(members, sizes, passages._token_arrays(docs, members).cache()).collect()
    places = members.select("doc_id", "c").distinct().groupBy("doc_id").count().collect()
    assert min(r["count"] for r in places) > 90  # a place a word, each a row of its own before
    assert {r.doc_id for r in got} == set(range(1, 20)) and {r.first_doc for r in got} == {0}
    pieces = members.select("sig", "doc_id", F.floor(F.col("c") / passages.PIECE)).distinct().count()
    assert len(got) <= 4 * pieces
    for r in members.select("doc_id", "c").distinct().collect():
        mine = [x for x in got if x.doc_id == r.doc_id]
        assert r.doc_id == 0 or min(x.c for x in mine) <= r.c <= max(x.c for x in mine)


def test_passages_of_two_documents():
    """Against all stretches of an edited copy, by longest common subsequences of runs."""
    import numpy as np

    rng = random.Random(8)
    for _ in range(60):
        x = [rng.randrange(1 << 30) for _ in range(rng.randrange(20, 60))]
        y = list(x)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(3)] = [rng.randrange(1 << 30) for _ in range(rng.randrange(3))]
        y = [1] * rng.randrange(5) + y + [2] * rng.randrange(5)
        place = {v: k for k, v in enumerate(y)}
        same = [(a, place[v]) for a, v in enumerate(x) if v in place]
        want: set[int] = set()
        for p in range(len(same)):
            for q in range(p, len(same)):
                (a, b), (z, w), s = same[p], same[q], q - p + 1
                if min(z - a, w - b) + 1 >= 12 and 9 * s >= 4 * (z - a + w - b + 2):
                    want |= set(range(a, z + 1))
        found = passages.passages_of(np.array(x, "<u4"), np.array(y, "<u4"), 12, 1)
        assert {k for a, z, *_ in found for k in range(a, z)} == want
        assert all(s >= 0.8 for *_, s in found)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for run, frame in ((jaccard.op2, docs), (mixing.op4, docs), (passages.op10, docs), (passages.dedup, docs), (warc.op7, pages)):
        assert run(frame).count() == 0
    assert chat.op6(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    labels = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = p.run(spark, sf).collect()
    assert out and {r.doc_id for r in out} <= labels
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in out)


def test_stage_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline as p

    words = lambda a: " ".join(f"{a}{i}" for i in range(20))
    rows = [(1, words("x")), (5, words("x")), (5, words("y")), (5, words("z")), (5, words("z")), (6, words("z")), (None, words("q")), (None, words("r")), (None, ""), (None, ""), (7, None), (8, " \n")]
    docs = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, n_chars long").repartition(4)
    got = Counter((r.doc_id, r.text) for r in p.join_near_copies(spark, docs, "").collect())
    assert got == Counter([(1, words("x")), (5, words("y")), (5, words("z")), (None, words("q")), (None, words("r")), (None, ""), (None, ""), (7, None), (8, " \n")])


def test_stage_keeps_one_of_each_group(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.join_near_copies(spark, docs, sf)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = {c for _, _, c in groups_by_brute_force(texts, 5, 80)}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)

"""Substring dedup by compact windows.

Tokens are five-word shingles. A passage is a pair of stretches of two documents,
each of at least 46 tokens (50 words), with a Jaccard similarity of 0.8 or more:
9 s >= 4 (a + b) for s equal tokens in stretches of a and b.

Windows. For each of four hash functions, the Cartesian tree over a document's
token hashes (least hash at the root) groups all token sequences with the same
minimum: the node at c whose subtree spans [l, r] stands for every sequence that
begins in [l, c] and ends in [c, r]. Only nodes that span a window (38 tokens)
matter, and the starts of their windows form one interval. The intervals of two
hash functions are joined within the document: where they meet, the windows
share both minima, and the two make one signature. Two pairs of hash functions
are joined; a window and its copy at similarity 0.8 have an equal signature with a
chance of 0.87 (more pairs raise it and the cost alike), and a passage has several
windows, whole ones between its edits among them. Exact passages always have one. Inserted or deleted words move a minimum and do not change it.

Groups. Documents with an equal signature are a group; its least document leads
and is compared with every other. Members whose place lies in a passage found so
far are done; the leader and they leave, and the rest of the group goes into the
next round, with the next leader. So a stretch is compared with every earlier one of
its groups that is not a repeat itself. A round is linear in the rows of the
groups. From the second round on, what is left of a group of FEW rows or fewer is
compared pair by pair. What a larger group still holds after ROUNDS rounds (documents
alike but not alike enough, or with a common line) is compared completely, blocks of
the group with blocks: a document's places within a stretch are one row there; a matrix product
counts the tokens that the surroundings of two rows share, and the pairs with enough of them
are aligned, edits allowed; each place keeps its earliest match of a block. Every group goes this way by its own
size, so other documents do not decide what is found in it.

Leaders come from an aggregation before the shuffle and a join that Spark can
split, so a passage that very many documents share is no single task.

Edge cases: null and short texts have no windows; repeats inside one document
do not count; exact copies are passages too; rows with the same doc_id count as
one document, whose texts are told apart by a hash; null ids are left out; equal
places tie towards the smaller position; of a document's stretches those within
a stretch that an earlier document holds are not listed again. In ``dedup`` a
column of the caller's may have any name but those in OWN.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import Scratch

SHINGLE = 5
LEAST = 46
#: Tokens of a window; a passage of twice as many and one edit holds a whole window without it.
WINDOW = 38
HASHES = 4
#: Hash functions whose windows are joined into one signature.
JOINED = ((0, 1), (2, 3))
_SEEDS = tk.mix(np.arange(1, HASHES + 1, dtype=tk.U) * tk.U(0x9E3779B97F4A7C15))
#: Rows of a group up to which all its pairs are compared, so a row has 8 pairs at most on average.
FEW = 17
ROUNDS = 3
_BLOCK = 256
#: Tokens whose places in a document are one row of a block.
PIECE = 128
#: Tokens on either side of a place that are looked at.
REACH = 2 * LEAST
#: Equal tokens of the shortest passage: 9 s >= 4 (LEAST + LEAST).
SHARED = -(-8 * LEAST // 9)
#: An edit between two equal runs costs 9 tokens of the two stretches at least, so at most one a 81 of them: some run is so long.
RUN = 21
#: Matches of two documents that are held at once, and bytes of a batch of pairs.
_MATCHES = 1 << 20
_BATCH = "16m"
#: Runs of two documents up to which the gaps between all of them are one table.
_TABLE = 512
#: Tokens that one matrix product counts.
_COLUMNS = 4096
#: Columns that ``dedup`` adds on its way.
OWN = ("_d", "_cuts")


def compact_windows(h: np.ndarray, off: np.ndarray, least: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every start of ``least`` tokens (flat, document by document): the place of its least hash, and the document.

    Starts with the same place are one node of the Cartesian tree. ``h`` holds the
    documents' token hashes, flat. Ties go to the left.
    """
    n = np.diff(off)
    count = np.maximum(n - least + 1, 0)
    if not count.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the low bits of a hash make room for the place, so values are distinct whatever the length
    low = tk.U((1 << len(h).bit_length()) - 1)
    size = -(-len(h) // least) * least
    padded = np.full(size, ~tk.U(0))
    padded[: len(h)] = h & ~low | np.arange(len(h), dtype=tk.U)
    blocks = padded.reshape(-1, least)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[:-1], count)
    return (np.minimum(behind[at], ahead[at + least - 1]) & low).astype(np.int64) - off[doc], doc


def signatures(t: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document, place) of all joined windows of documents with tokens ``t``."""
    places = []
    for seed in _SEEDS:
        c, doc = compact_windows(tk.mix(t ^ seed), off)
        places.append(c)
    found = []
    for i, j in JOINED:
        x, y = places[i], places[j]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (doc[1:] != doc[:-1])
        x, y, d = x[new], y[new], doc[new]
        sig = tk.mix(tk.mix(t[off[d] + x] + _SEEDS[i]) * tk.U(3) + tk.mix(t[off[d] + y] + _SEEDS[j]))
        found.append((sig, d, x))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _windows_of(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int32()), ("c", pa.int32())])

    def task(batches):
        for b, texts in tk.parts(batches, most=1_000_000):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            t, off = tk.Words(texts).shingles(SHINGLE)
            keys = text_keys(t, off)
            sig, d, c = signatures(t, off)
            for i in range(0, len(sig), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((sig[s].view(np.int64), ids[d[s]], keys[d[s]], c[s]), schema.types, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(task, "sig long, doc_id long, text_key int, c int")


def text_keys(t: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 31-bit hash of each document's token sequence."""
    spread = tk.mix(t + np.arange(len(t), dtype=tk.U) - np.repeat(off[:-1], np.diff(off)).astype(tk.U))
    total = np.concatenate((np.zeros(1, tk.U), np.cumsum(spread, dtype=tk.U)))
    return (tk.mix(total[off[1:]] - total[off[:-1]]) >> tk.U(33)).astype(np.int32)


MEMBER = ["sig", "doc_id", "text_key", "c"]
PAIR = ["doc_id", "text_key", "first_doc", "first_key"]


def shared_windows(docs: DataFrame) -> DataFrame:
    """Windows whose signature two documents hold; the windows are made twice rather than written."""
    held = _windows_of(docs).groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo != hi").select(F.col("sig").alias("_g"))
    windows = _windows_of(docs)
    return windows.join(held, windows.sig == F.col("_g")).select(*MEMBER)


def leaders(members: DataFrame) -> DataFrame:
    """(_g, first_doc, first_key, fc, m): the least member of each group that two documents hold, and its size."""
    g = members.groupBy("sig").agg(F.min(F.struct("doc_id", "text_key", "c")).alias("f"), F.max("doc_id").alias("hi"), F.count("*").alias("m")).filter("f.doc_id != hi")
    return g.select(F.col("sig").alias("_g"), F.col("f.doc_id").alias("first_doc"), F.col("f.text_key").alias("first_key"), F.col("f.c").alias("fc"), "m")


def stretches(met: DataFrame) -> DataFrame:
    """One row a pair of documents: the places that met, [lo, hi], and their shifts."""
    shift = F.col("c") - F.col("fc")
    return met.groupBy(*PAIR).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(shift).alias("low"), F.max(shift).alias("high"))


def uncovered(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members whose place lies in no passage of their document."""
    spans = found.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    out = members.join(spans, (members.doc_id == F.col("_d")) & (members.text_key == F.col("_k")), "left")
    held = F.exists("spans", lambda x: (x.start_word <= F.col("c")) & (F.col("c") + SHINGLE <= x.end_word))
    return out.filter(F.col("spans").isNull() | ~held).select(*members.columns)


def _token_arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text_key, tokens) of the wanted documents; only their texts are shuffled, if at all."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int32()), ("tokens", pa.binary())])

    def task(batches):
        for b, texts in tk.parts(batches):
            t, off = tk.Words(texts).shingles(SHINGLE)
            small = (t >> tk.U(32)).astype("<u4")
            rows = [small[a:z].tobytes() for a, z in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_keys(t, off), pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    ids = wanted.select(F.col("doc_id").alias("_w")).distinct()
    picked = docs.join(ids, docs.doc_id == F.col("_w"), "left_semi").select("doc_id", "text")
    return picked.mapInArrow(task, "doc_id long, text_key int, tokens binary").dropDuplicates(["doc_id", "text_key"])


def aligned(p: np.ndarray, q: np.ndarray, least: int = LEAST) -> list[tuple[int, int, float]]:
    """Stretches [i, j) of two token sequences at one shift of which at least 8 in 9 are equal, and their similarity.

    Runs of equal tokens are joined from left to right while the joined stretch
    keeps 8 in 9; each stretch begins and ends with an equal token.
    """
    edge = np.flatnonzero(np.diff((p == q).astype(np.int8), prepend=0, append=0))
    found: list[list[int]] = []
    for a, z in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        own = [a, z, z - a]
        while found and 9 * (found[-1][2] + own[2]) >= 8 * (own[1] - found[-1][0]):
            left = found.pop()
            own = [left[0], own[1], left[2] + own[2]]
        found.append(own)
    return [(a, z, n / (2 * (z - a) - n)) for a, z, n in found if z - a >= least]


def equal_runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows (start in x, start in y, length) of all maximal equal runs, by start in x."""
    order = np.argsort(y, kind="stable")
    ys = y[order]
    lo = np.searchsorted(ys, x, "left")
    count = np.searchsorted(ys, x, "right") - lo
    upto = np.concatenate(([0], np.cumsum(count)))
    parts, a = [], 0
    while a < len(x):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + _MATCHES, "right")) - 1)
        n = count[a:z]
        i = np.repeat(np.arange(a, z), n)
        if len(i):
            j = order[np.arange(len(i)) - np.repeat(upto[a:z] - upto[a], n) + np.repeat(lo[a:z], n)]
            key = np.sort((i - j + len(y)) << 32 | i)  # by shift, then place
            new = np.flatnonzero(np.diff(key, prepend=key[0] - 2) != 1)
            parts.append(np.stack((key[new], np.diff(new, append=len(key)))))
        a = z
    if not parts:
        return np.zeros((0, 3), np.int64)
    key, n = np.concatenate(parts, axis=1)
    if len(parts) > 1:  # runs that go on in the next part
        by = np.argsort(key)
        key, n = key[by], n[by]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1] + n[:-1])))
        key, n = key[new], np.add.reduceat(n, new)
    i = key & 0xFFFFFFFF
    out = np.stack((i, i - (key >> 32) + len(y), n), axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def dense(held: np.ndarray, least: int) -> np.ndarray:
    """The places in some stretch of ``least`` or more of which 4 in 5 are held; no passage has others."""
    total = np.concatenate(([0], np.cumsum(np.where(held, 1, -4))))
    most = np.maximum.accumulate(total[::-1])[::-1]
    end = np.searchsorted(-most, -total, "right") - 1  # the last end with a sum of 0 or more
    start = np.flatnonzero(end - np.arange(len(total)) >= least)
    open_ = np.zeros(len(total), np.int64)
    np.add.at(open_, start, 1)
    np.add.at(open_, end[start], -1)
    return np.cumsum(open_)[:-1] > 0


def passages_of(x: np.ndarray, y: np.ndarray, least: int = LEAST, run: int = RUN, shifts: tuple[int, int] | None = None) -> list[tuple[int, int, int, int, float]]:
    """Stretches [a, z) of x and [b, w) of y with similarity 0.8 or more; none lies in another's place in x.

    ``shifts`` bounds the shifts of runs: stretches drift by less than a window from where they met.

    f and g are the best chains that end and begin with a run; two are joined
    where their sum pays for the gap between them, though one alone may not.
    Every passage has an equal run of ``run`` tokens. Stretches within the others
    together are left out.
    """
    if min(len(x), len(y)) < least:
        return []
    in_x = dense(np.isin(x, y), least)
    in_y = dense(np.isin(y, x[in_x]), least) if in_x.any() else in_x
    if not in_y.any():
        return []
    runs = equal_runs(x, y)
    runs = runs[in_x[runs[:, 0]] & in_y[runs[:, 1]]]
    if shifts:
        runs = runs[(runs[:, 0] - runs[:, 1] >= shifts[0]) & (runs[:, 0] - runs[:, 1] <= shifts[1])]
    i, j, n = runs.T
    if not len(n) or n.max() < run:
        return []
    iz, jz, k = i + n, j + n, len(n)
    f, g, left, right = n.copy(), n.copy(), np.arange(k), np.arange(k)
    best, back, ahead = np.full(k, -(1 << 40)), np.zeros(k, np.int64), np.full(k, -(1 << 40))
    forth = np.zeros(k, np.int64)

    def gap(p, r):
        """What it costs to go from run p to run r; runs that overlap give up the overlap."""
        over = np.maximum(np.maximum(iz[p] - i[r], jz[p] - j[r]), 0)
        cost = over + 4 * (i[r] - iz[p] + j[r] - jz[p] + 2 * over)
        return np.where(over < np.minimum(n[p], n[r]), cost, 1 << 40)

    every = np.arange(k)
    gaps = gap(every[:, None], every[None, :]) if k <= _TABLE else None  # else row by row
    for r in range(1, k):
        v = f[:r] - (gap(slice(0, r), r) if gaps is None else gaps[:r, r])
        p = int(np.argmax(v))
        best[r], back[r] = v[p], p
        if v[p] > 0:
            f[r], left[r] = n[r] + v[p], left[p]
    for p in range(k - 2, -1, -1):
        v = g[p + 1 :] - (gap(p, slice(p + 1, k)) if gaps is None else gaps[p, p + 1 :])
        r = int(np.argmax(v))
        ahead[p], forth[p] = v[r], p + 1 + r
        if v[r] > 0:
            g[p], right[p] = n[p] + v[r], right[p + 1 + r]
    found = set()
    for r in range(k):
        found.add((int(left[r]), int(right[r]), int(f[r] + g[r] - n[r])))
        if best[r] + g[r] >= 0:
            found.add((int(left[back[r]]), int(right[r]), int(best[r] + g[r])))
        if ahead[r] + f[r] >= 0:
            found.add((int(left[r]), int(right[forth[r]]), int(ahead[r] + f[r])))
    places = {(int(i[p]), int(iz[r]), int(j[p]), int(jz[r]), v) for p, r, v in found}
    places = sorted((q for q in places if min(q[1] - q[0], q[3] - q[2]) >= least), key=lambda q: (q[0], -q[1], q[2]))
    out, reach, at = [], -1, 0
    while at < len(places):  # of the stretches that begin by where the last one ends, the one that ends last
        until = at
        while until < len(places) and places[until][0] <= max(reach, places[at][0]):
            until += 1
        a, z, b, w, weight = max(places[at:until], key=lambda q: q[1])
        at = until
        if z > reach:
            s = (weight + 4 * (z - a + w - b)) // 9
            out.append((a, z, b, w, s / (z - a + w - b - s)))
            reach = z
    return out


_FOUND = "doc_id long, text_key int, first_doc long, start_word long, end_word long, first_start long, first_end long, similarity double"
_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.float64()]


def compared(x: np.ndarray, y: np.ndarray, low: int, high: int, lo: int, hi: int) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end in x, start, end in y, similarity); at one known shift if that holds all of [lo, hi] and what is left of x and y has no token in common, else by chained runs."""
    if low == high:
        a, z = max(0, low), min(len(x), len(y) + low)
        out = [(a + i, a + j, a + i - low, a + j - low, s) for i, j, s in aligned(x[a:z], y[a - low : z - low])]
        if len(out) == 1:
            i, j, k, m, _ = out[0]
            if i <= lo and hi < j and not np.isin(np.concatenate((x[:i], x[j:])), np.concatenate((y[:k], y[m:]))).any():
                return out
    return passages_of(x, y, shifts=(low - LEAST, high + LEAST))


def _cut(lo, hi):
    """Tokens [lo, hi) as bytes."""
    return F.substring(F.col("tokens"), 4 * lo + 1, 4 * (F.least(hi, (F.length("tokens") / 4).cast("int")) - lo))


def shared_tokens(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens each row of x shares with each row of y, repeats counted as often as both have them."""

    def numbered(t):
        t = np.sort(t, axis=1)
        place = np.broadcast_to(np.arange(t.shape[1]), t.shape)
        new = np.diff(t, axis=1, prepend=t[:, :1] - 1) != 0
        return (t << 16) + place - np.maximum.accumulate(np.where(new, place, 0), axis=1)

    x, y = numbered(x), numbered(y)
    both = np.intersect1d(x, y)
    total = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, len(both), _COLUMNS):
        part = both[a : a + _COLUMNS]
        held = []
        for t in (x, y):
            at = np.minimum(np.searchsorted(part, t), len(part) - 1)
            row, col = np.nonzero(part[at] == t)
            m = np.zeros((len(t), len(part)), np.float32)
            m[row, at[row, col]] = 1
            held.append(m)
        total += held[0] @ held[1].T
    return total


def may_hold_place(x: np.ndarray, y: np.ndarray, last: int = REACH) -> np.ndarray:
    """For the row x and every row of y: whether some LEAST or more tokens of x around a place from REACH to ``last``, from one in y to one in y, have 4 in 5 in y. Every passage has."""
    vocabulary, at = np.unique(x, return_inverse=True)
    place = np.minimum(np.searchsorted(vocabulary, y), len(vocabulary) - 1)
    row, col = np.nonzero(vocabulary[place] == y)
    known = np.zeros((len(y), len(vocabulary)), bool)
    known[row, place[row, col]] = True
    held = known[:, at]
    total = np.zeros((len(y), len(x) + 1), np.int16)
    np.cumsum(np.where(held, 1, -4), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(np.where(held[:, : last + 1], total[:, : last + 1], np.int16(1 << 14)), axis=1)
    end = np.arange(REACH + 1, len(x) + 1)
    gain = total[:, end] - low[:, np.minimum(last, end - LEAST)]
    return (held[:, end - 1] & (gain >= 0)).any(axis=1)


def holds_place(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether a passage of p and q holds the place in p that its row was cut around."""
    return bool(places_held(p, q, np.array([REACH]), 0))


def places_held(p: np.ndarray, q: np.ndarray, places: np.ndarray, spread: int) -> list[tuple[int, int, int]]:
    """(first, last, shift) of the places in p that each passage of p and q holds, of passages that hold one; the places in q that they met are ``spread`` apart."""
    n = min(len(p), len(q))
    found = [(a, z, 0) for a, z, _ in aligned(p[:n], q[:n])]
    if not all(any(a <= c < z for a, z, _ in found) for c in places):
        shifts = (int(places[0]) - REACH - spread - LEAST, int(places[-1]) - REACH + LEAST)
        found += [(a, z, a - b) for a, z, b, *_ in passages_of(p, q, shifts=shifts)]
    out = []
    for a, z, shift in found:
        held = places[(places >= a) & (places < z)]
        if len(held):
            out.append((int(held[0]), int(held[-1]), shift))
    return out


def in_blocks(members: DataFrame, sizes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, text_key, c, first_doc, first_key, fc) of members of the groups in ``sizes`` (_g) and, for each place, the least document of a block with a passage there.

    A document's places within PIECE tokens are one row with its surroundings: a run of
    one word has as many places as words. A passage gives its first and last place.
    """
    piece = F.floor(F.col("c") / PIECE).alias("piece")
    pieces = members.join(sizes.select("_g"), members.sig == F.col("_g"), "left_semi").groupBy("sig", "doc_id", "text_key", piece).agg(F.array_sort(F.collect_set("c")).alias("cs"))
    m = pieces.groupBy("sig").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks")).select(F.col("sig").alias("_g"), "blocks")
    rows = pieces.join(m, pieces.sig == F.col("_g")).join(tokens, ["doc_id", "text_key"])
    from_, to = F.greatest(F.get("cs", F.lit(0)) - REACH, F.lit(0)), F.element_at("cs", -1) + REACH
    slices = rows.select("sig", F.pmod(F.xxhash64("doc_id", "text_key", "piece"), F.col("blocks")).alias("block"), "doc_id", "text_key", "cs", _cut(from_, to).alias("p"))
    blocks = slices.groupBy("sig", "block").agg(F.collect_list(F.struct("doc_id", "text_key", "cs", "p")).alias("rows"))  # about _BLOCK rows each
    x = blocks.select("sig", F.col("block").alias("i"), F.col("rows").alias("x"))
    y = blocks.select("sig", F.col("block").alias("j"), F.col("rows").alias("y"))

    def columns(rows, blank):
        doc, key, cs, p = rows.flatten().flatten()
        cs = [np.array(c, np.int64) for c in cs.to_pylist()]
        table = np.full((len(cs), 2 * REACH + max(int(c[-1] - c[0]) for c in cs)), blank, np.int64)
        for k, b in enumerate(p.to_pylist()):
            t, at = np.frombuffer(b, "<u4"), max(0, REACH - int(cs[k][0]))
            table[k, at : at + len(t)] = t
        return doc.to_numpy(), key.to_numpy(), cs, table

    def matches(late, early):
        """(late row, c, early row, fc): for each place of a late row the least early document that holds a passage there."""
        near = (early[0][None, :] < late[0][:, None]) & (shared_tokens(late[3], early[3]) >= SHARED)
        for a in np.flatnonzero(near.any(axis=1)):
            row = np.flatnonzero(near[a])
            cs, lo = late[2][a], int(late[2][a][0])
            row = row[may_hold_place(late[3][a], early[3][row], REACH + int(cs[-1]) - lo)]
            for b in row[np.argsort(early[0][row], kind="stable")]:
                start = int(cs[0]) - lo  # what is left of the row's places, and their surroundings
                p, other = late[3][a][start : int(cs[-1]) - lo + 2 * REACH], early[2][b]
                for first, last, shift in places_held(p, early[3][b], cs - lo - start + REACH, int(other[-1] - other[0])):
                    for c in {first, last}:
                        yield a, c + start + lo - REACH, b, c - shift - REACH + int(other[0])
                    cs = cs[(cs < first + start + lo - REACH) | (cs > last + start + lo - REACH)]
                if not len(cs):
                    break

    names = ["doc_id", "text_key", "c", "first_doc", "first_key", "fc"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def task(batches):
        for b in batches:
            for k in range(b.num_rows):
                p, q = columns(b.column(0).slice(k, 1), -1), columns(b.column(1).slice(k, 1), -2)
                found = [(p, q, *z) for z in matches(p, q)] + ([(q, p, *z) for z in matches(q, p)] if b.column(2)[k].as_py() else [])
                out = [(l[0][i], l[1][i], c, e[0][j], e[1][j], fc) for l, e, i, c, j, fc in found]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)

    # a group's pairs of blocks go to all tasks, not to the one of its signature
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = x.join(y, "sig").filter("i <= j").repartition(n, "sig", "i", "j").select("x", "y", F.col("i") != F.col("j"))
    return both.mapInArrow(task, "doc_id long, text_key int, c int, first_doc long, first_key int, fc int")


def verified(pairs: DataFrame, tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """The passages of pairs of documents, sought from two window lengths before the places that met to two after them."""
    at, from_ = F.greatest(F.col("lo") - F.col("high") - REACH, F.lit(0)), F.greatest(F.col("lo") - REACH, F.lit(0))
    t = tokens.select(F.col("doc_id").alias("first_doc"), F.col("text_key").alias("first_key"), "tokens")
    first = pairs.join(t, ["first_doc", "first_key"]).withColumn("at", at).withColumn("q", _cut(F.col("at"), F.col("hi") - F.col("low") + REACH)).drop("tokens")
    # joined by the later document last: a leader can be in very many pairs, and its task would compare them all
    both = first.join(tokens, ["doc_id", "text_key"]).withColumn("from", from_).withColumn("p", _cut(F.col("from"), F.col("hi") + REACH))
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def task(batches):
        for b in batches:
            rows = []
            for doc, key, first, lo, hi, low, high, start, at, p, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for a, z, i, j, s in compared(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4"), low - start + at, high - start + at, lo - start, hi - start):
                    rows.append((doc, key, first, start + a, start + z + SHINGLE - 1, at + i, at + j + SHINGLE - 1, s))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(_KINDS), _KINDS, strict=True)], names=names)

    conf, name = pairs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name)
    conf.set(name, _BATCH)  # a long document can be in very many pairs
    try:
        return scratch.keep(both.select("doc_id", "text_key", "first_doc", "lo", "hi", "low", "high", "from", "at", "p", "q").mapInArrow(task, _FOUND), "verified")
    finally:
        conf.set(name, before)


def earliest(found: DataFrame) -> DataFrame:
    """Without stretches that lie within one of a smaller first_doc."""
    schema = found.schema

    def task(batches):
        own, held = None, []
        for b in batches:
            keep = []
            for doc, key, a, z in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if own != (doc, key):
                    own, held = (doc, key), []
                keep.append(not any(s <= a and z <= e for s, e in held))
                if keep[-1]:
                    held.append((a, z))
            yield b.filter(pa.array(keep, pa.bool_()))

    return found.repartition("doc_id").sortWithinPartitions("doc_id", "text_key", "first_doc", "start_word", F.desc("end_word"), "first_start").mapInArrow(task, schema)


def find_passages(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, first_doc, start_word, end_word, first_start, first_end, similarity), one row a passage."""
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    members = scratch.keep(shared_windows(docs), "shared")
    tokens = scratch.keep(_token_arrays(docs, members), "tokens")
    found = None
    for turn in itertools.count():
        lead = scratch.keep(leaders(members), "leaders")
        few = F.col("m") <= FEW
        size = lead.agg(F.count("*").alias("all"), F.count(F.when(few, 1)).alias("few")).first()
        if not size.all:
            break
        met, led = [], None
        if turn and size.few:
            small = members.join(lead.filter(few).select("_g"), members.sig == F.col("_g"))
            before = small.select("_g", F.col("doc_id").alias("first_doc"), F.col("text_key").alias("first_key"), F.col("c").alias("fc"))
            met.append(small.drop("_g").join(before, (F.col("sig") == F.col("_g")) & (F.col("first_doc") < F.col("doc_id"))))
        large = lead.filter(~few) if turn else lead
        if turn == ROUNDS and size.all > size.few:
            met.append(scratch.keep(in_blocks(members, large, tokens), "matches"))
        elif not turn or size.all > size.few:
            led = scratch.keep(members.join(large, members.sig == F.col("_g")).filter("doc_id != first_doc"), "met")
            met.append(led)
        places = [t.select(*PAIR, "c", "fc") for t in met]
        more = verified(stretches(functools.reduce(DataFrame.unionByName, places)), tokens, scratch)
        found = more if found is None else found.unionByName(more)
        if led is None:
            break
        members = scratch.keep(uncovered(led.select(*MEMBER), more), "left")
    if found is None:
        found = docs.sparkSession.createDataFrame([], _FOUND)
    return scratch.keep(earliest(found), "passages")


def op10(docs: DataFrame) -> DataFrame:
    """A row for every repeated passage: where it is, the first document that holds it, and where there.

    First occurrences have rows too (``is_first``, first_doc = doc_id), so that
    every document of a group is listed.
    """
    found = find_passages(docs)
    later = found.select("doc_id", "start_word", "end_word", "first_doc", "first_start", "similarity", F.lit(False).alias("is_first"))
    first = found.select(F.col("first_doc").alias("doc_id"), F.col("first_start").alias("start_word"), F.col("first_end").alias("end_word"), "first_doc", "first_start", F.lit(1.0).alias("similarity"), F.lit(True).alias("is_first"))
    return later.unionByName(first).distinct()


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (start, end); white space around what stays is kept."""
    drop = np.zeros(max(e for _, e in spans), bool)
    for s, e in spans:
        drop[s:e] = True
    out, end = [], 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i < len(drop) and drop[i]:
            end = m.end()
        else:
            out.append(text[end : m.end()])
            end = m.end()
    out.append(text[end:])
    return b"".join(out)


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with later occurrences of passages cut out; documents left without words go.

    Rows are matched to their passages by doc_id; n_chars is set anew where the text changed.
    """
    scratch = Scratch(docs.sparkSession)
    found = find_passages(docs, scratch)
    cuts = found.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    cuts = cuts.groupBy("_d").agg(F.collect_list(F.struct("_k", "spans")).alias("_cuts"))
    joined = docs.join(cuts, docs.doc_id == F.col("_d"), "left").drop("_d")
    schema = docs.schema
    at = {c: i for i, c in enumerate(docs.columns)}

    def task(batches):
        for b in batches:
            cols = [b.column(i) for i in range(len(at))]
            texts, keep = tk.encoded(cols[at["text"]]), np.ones(b.num_rows, bool)
            changed = {}
            for d, c in enumerate(b.column(len(at)).to_pylist()):
                if c:
                    t, off = tk.Words([texts[d]]).shingles(SHINGLE)
                    key = int(text_keys(t, off)[0])
                    spans = [(s["start_word"], s["end_word"]) for x in c if x["_k"] == key for s in x["spans"]]
                    if spans:
                        changed[d] = without_words(texts[d], spans)
                        keep[d] = bool(changed[d].strip())
            if changed:
                new = cols[at["text"]].to_pylist()
                for d, t in changed.items():
                    new[d] = t.decode("utf-8", "replace")
                cols[at["text"]] = pa.array(new, b.schema.field(at["text"]).type)
                if "n_chars" in at:
                    n = cols[at["n_chars"]].to_pylist()
                    for d in changed:
                        n[d] = len(new[d])
                    cols[at["n_chars"]] = pa.array(n, cols[at["n_chars"]].type)
            yield pa.RecordBatch.from_arrays(cols, names=docs_columns).filter(pa.array(keep))

    docs_columns = docs.columns
    return joined.select(*docs.columns, "_cuts").mapInArrow(task, schema)

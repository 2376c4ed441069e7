"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint sums the bits of the XXH64 of all word shingles of a text. Two
fingerprints that differ in 3 bits or fewer differ in 3 bytes at most, so they
share 5 positional bytes at least. Lists of single positional bytes would each hold
1/256 of all fingerprints whatever their number, so the index goes straight to
the guaranteed minimum: its lists are keyed by five positions and their bytes (56
sets of positions). Fingerprints that meet in a list have reached the count; in
short lists the tally of all shared bytes names the one list that reports a pair,
whose differing bits are then counted.

Long lists never make all their pairs. What is left of a list's fingerprints are
three free bytes, so a list holds 2^24 of them at most; each looks up its 2,324
neighbours within 3 bits in a table of that size, and the list gives one link a
member, to the least fingerprint of its component. Links of all lists then meet in
the components of the whole corpus.

Equal fingerprints are one entry of the index, so exact copies cost nothing there.

Edge cases: a text of fewer words than a shingle is one shingle; null texts and
those without words have fingerprint zero, which links like any other; null
doc_ids keep their row, have no part in component_id, and theirs is null if no
other document is reachable; repeated rows and ids stay; very long texts are hashed
in pieces of bounded size; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .links import components
from .store import Scratch

SHINGLE = 3
SEED = 42
MOST_BITS = 3
BYTES = 8
#: Positions that a pair shares at least, and all sets of so many.
SHARED = BYTES - MOST_BITS
LISTS = list(itertools.combinations(range(BYTES), SHARED))
#: Lists up to this length report pairs, longer ones one link a member.
SHORT = 16
#: Lists up to this length compare their members, longer ones look neighbours up.
_COMPARED = 4096
#: Hashes whose bits are summed at once.
_PIECE = 100_000


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


MASKS = np.array([_mask(c) for c in LISTS], np.uint64)
#: For a pattern of equal bytes (bit p: byte p is equal), the first list with its first equal positions.
_FIRST = np.array([next((i for i, c in enumerate(LISTS) if all(m >> p & 1 for p in c)), -1) for m in range(256)])


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text: a bit is set if more than half of the shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for d, text in enumerate(texts):
        words = text.lower().split()  # ASCII only, and the same white space as the word rule
        if not words:
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(shingle, len(words))
        starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
        ones = np.zeros(64, np.int64)
        for at in range(0, len(starts), _PIECE):
            h = np.fromiter((xxhash.xxh64_intdigest(flat[a:z], seed) for a, z in zip(starts[at : at + _PIECE], ends[at : at + _PIECE], strict=True)), np.uint64)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[d] = weights[2 * ones > len(starts)].sum(dtype=np.uint64)
    return out


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), one row a document; the fingerprint's bits as a signed long."""

    def task(batches):
        for b, texts in tk.parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(texts).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, fp long")


def index(prints: DataFrame) -> DataFrame:
    """(list, shared, fp): an entry for each distinct fingerprint and set of positions."""
    entries = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("list"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("shared")) for i, m in enumerate(MASKS)]))
    return prints.select("fp", entries.alias("e")).select("e.list", "e.shared", "fp")


class _Forest:
    """Components of n entries, joined at their least."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _free_bits(fps: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """The bytes outside ``positions`` as one number of 24 bits."""
    out = np.zeros(len(fps), np.int64)
    for p in sorted(set(range(BYTES)) - set(positions)):
        out = out << 8 | (fps >> np.uint64(8 * p) & np.uint64(0xFF)).astype(np.int64)
    return out


_PATTERNS = [sum(1 << b for b in c) for n in range(1, MOST_BITS + 1) for c in itertools.combinations(range(8 * MOST_BITS), n)]


def list_links(fps: np.ndarray, positions: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member of its component) of one list of distinct fingerprints that share ``positions``."""
    forest, n = _Forest(len(fps)), len(fps)
    if n <= _COMPARED:
        for at in range(0, n, 512):
            i, j = np.nonzero(np.bitwise_count(fps[at : at + 512, None] ^ fps[None, :]) <= MOST_BITS)
            forest.join(i + at, j)
    else:
        x, every = _free_bits(fps, positions), np.arange(n)
        place = np.full(1 << 8 * MOST_BITS, -1, np.int32)
        place[x] = every
        for pattern in _PATTERNS:
            there = place[x ^ pattern]
            near = there >= 0
            forest.join(every[near], there[near])
    member = np.flatnonzero(forest.root != np.arange(n))
    return fps[member], fps[forest.root[member]]


def run_links(which: np.ndarray, shared: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole lists that lie one after the other: entries of a list have equal ``which`` and ``shared``."""
    n = len(fps)
    new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (shared[1:] != shared[:-1]))))
    size = np.diff(np.append(new, n))
    a, b = [], []
    if (size > 1).any():
        number, length = np.repeat(np.arange(len(new)), size), np.repeat(size, size)
        kept = np.flatnonzero((length > 1) & (length <= SHORT))
        for step in range(1, SHORT):
            i = kept[kept + step < n]
            i = i[number[i] == number[i + step]]
            if not len(i):
                break
            x = fps[i] ^ fps[i + step]
            equal = np.packbits(x.astype("<u8").view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").ravel()
            # the tally is 5 at least here; the pair counts in the first of its lists only
            near = (_FIRST[equal] == which[i]) & (np.bitwise_count(x) <= MOST_BITS)
            a.append(fps[i[near]])
            b.append(fps[i[near] + step])
        for at, m in zip(new[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            i, j = list_links(fps[at : at + m], LISTS[which[at]])
            a.append(i)
            b.append(j)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever differs in 3 bits or fewer; ``prints`` has distinct ``fp``."""

    def task(batches):
        rest = None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            whole = [np.concatenate(c) for c in zip(rest, new, strict=True)] if rest else new
            if not len(whole[2]):
                continue
            # the last list may go on in the next batch
            last = np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            rest = [c[end:] for c in whole]
            if end:
                yield found(*(c[:end] for c in whole))
        if rest:
            yield found(*rest)

    def found(*lists):
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in run_links(*lists)], names=["a", "b"])

    return index(prints).repartition("list", "shared").sortWithinPartitions("list", "shared", "fp").mapInArrow(task, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), one row a document."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprint_documents(docs), "prints")
    prints = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(prints.select("fp")), scratch).select(F.col("node").alias("_n"), "root")
    known = scratch.keep(prints.join(root, prints.fp == F.col("_n"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    groups = known.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("_r"), "component_id")
    ids = known.join(groups, known.root == F.col("_r")).select(F.col("fp").alias("_f"), "component_id")
    return rows.join(ids, rows.fp == F.col("_f")).select("doc_id", "fp", "component_id")


def op12(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

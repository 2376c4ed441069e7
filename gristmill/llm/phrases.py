"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of the LZ78 dictionary over code points; the
set of its phrases, hashed, is reduced to a one-permutation minimum-hash
signature of 128 bins of 16 bits. The share of equal bins estimates the Jaccard
similarity of two phrase sets, which is high when one text compresses well with
the other's dictionary.

Documents are dealt into ranges of doc_id, each range sorted in descending
order, so that a document and the next one meet in one task; the head of the
next range is added to each range. Equal ids are ordered by descending text,
null ids come last.

Edge cases: null text is empty; an empty text has no phrases and its signature
equals only that of another empty text; with one document, it is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

BINS = 128
_SHIFT = tk.U(57)
_STEP = 1 << 21


def _run(codes: list[int], tree: dict[int, int], node: int, fresh: int, at: int, ends: list[int]) -> tuple[int, int]:
    """Parse further; appends the position after each finished phrase."""
    get, add = tree.get, ends.append
    for c in codes:
        at += 1
        key = node + c
        found = get(key)
        if found is None:
            tree[key] = fresh
            fresh += _STEP
            node = 0
            add(at)
        else:
            node = found
    return node, fresh


def _phrases(codes: np.ndarray, ends: list[int]) -> np.ndarray:
    """Sorted hashes of the phrases; a last unfinished one counts."""
    if len(codes) and (not ends or ends[-1] < len(codes)):
        ends = [*ends, len(codes)]
    stop = np.array(ends, np.int64)
    start = np.concatenate(([0], stop[:-1])).astype(np.int64)
    h = tk.span_hashes(tk.mix(codes.astype(tk.U) + tk.U(1)), start, stop)
    h.sort()
    return h


def signature(h: np.ndarray) -> np.ndarray:
    """Least hash of each bin, 16 bits kept; an empty bin borrows from the next filled one."""
    if not len(h):
        return np.zeros(BINS, np.uint16)
    first = np.searchsorted(h, np.arange(BINS, dtype=tk.U) << _SHIFT)
    value = h[np.minimum(first, len(h) - 1)]
    filled = (first < len(h)) & (value >> _SHIFT == np.arange(BINS, dtype=tk.U))
    where = np.flatnonzero(filled)
    lender = where[np.searchsorted(where, np.arange(BINS)) % len(where)]
    far = ((lender - np.arange(BINS)) % BINS).astype(tk.U)
    return (tk.mix(value[lender] + far * tk.U(0x9E3779B97F4A7C15)) & tk.U(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends: list[int] = []
    _run(codes.tolist(), {}, 0, _STEP, 0, ends)
    return signature(_phrases(codes, ends))


def with_edit(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of the text and of its edited form, and that form. Both parses share the kept half."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cut = len(codes) - len(codes) // 2
    added = np.frombuffer(following[: len(codes) // 2].encode("utf-32-le"), np.uint32)
    tree: dict[int, int] = {}
    ends: list[int] = []
    node, fresh = _run(codes[:cut].tolist(), tree, 0, _STEP, 0, ends)
    tree2, ends2 = dict(tree), list(ends)
    _run(codes[cut:].tolist(), tree, node, fresh, cut, ends)
    _run(added.tolist(), tree2, node, fresh, cut, ends2)
    return signature(_phrases(codes, ends)), signature(_phrases(np.concatenate((codes[:cut], added)), ends2)), text[:cut] + following[: len(codes) // 2]


def _hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def in_descending_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (part, extra, doc_id, text) sorted within parts, each part ending with the row that follows it."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("key"), "doc_id", "text")
    bounds = docs.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    # two short scans (every 64th bound, then the 64 after it) instead of one long one
    groups = [bounds[i : i + 64] for i in range(0, len(bounds), 64)] or [[]]
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    below = lambda x: F.size(F.filter(x, lambda b: b <= F.col("key")))
    coarse = F.greatest(below(longs([g[0] for g in groups if g])), F.lit(1))
    part = (coarse - 1) * 64 + below(F.element_at(F.array(*map(longs, groups)), coarse))
    dealt = docs.withColumn("part", part)
    heads = sorted((r.part, r.key) for r in dealt.groupBy("part").agg(F.max("key").alias("key")).collect())  # one row a range
    # the part above takes the head of the part below it; the lowest takes the highest head
    target = spark.createDataFrame([(key, heads[(i + 1) % len(heads)][0]) for i, (_, key) in enumerate(heads)], "head long, part int")
    first = docs.join(F.broadcast(target), F.col("key") == F.col("head")).groupBy("part").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "key", "doc_id")).alias("r"))
    rows = dealt.select("part", F.lit(0).alias("extra"), "key", "doc_id", "text").unionByName(first.select("part", F.lit(1).alias("extra"), "r.key", "r.doc_id", "r.text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "part").sortWithinPartitions("part", "extra", F.desc("key"), F.desc_nulls_last("text"))


def op5(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``ranges`` is a number of key ranges, four a shuffle partition by default, 8192 at most."""
    ranges = ranges or min(8192, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = in_descending_ranges(docs, ranges)

    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema(list(zip(fields, [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2], strict=True)))

    def task(batches):
        before = None  # (part, doc_id, text): its edited form needs the next row
        pending = None  # (row so far, signature): near_next needs the next row's signature
        done: list[tuple] = []
        for b in batches:
            for part, extra, doc_id, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                text = text or ""
                if before is not None:
                    own, edited, form = with_edit(before[2], text)
                    if pending:
                        done.append((*pending[0], likeness(pending[1], own)))
                    sha = hashlib.sha256(form.encode("utf-8", "replace")).hexdigest()
                    pending = (before[1], len(before[2]), sha, _hex(own), _hex(edited), likeness(own, edited)), own
                before = (part, doc_id, text)
                if extra:  # the end of a part
                    done.append((*pending[0], likeness(pending[1], fingerprint(text))))
                    before = pending = None
                if len(done) >= 200:
                    yield pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in done], schema=schema)
                    done = []
        yield pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in done], schema=schema)

    return rows.mapInArrow(task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

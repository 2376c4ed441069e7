"""N-gram Jaccard join: size-aware, heavy-light.

Documents become sets of hashed word shingles. Equal sets are one set from the
start (its key is a hash of the set), so copies never meet each other again.

Tokens are ordered rare before frequent; a set's prefix under that order must
hold at least k tokens of every partner, where its length is
n - ceil(t n) + k. Small sets enumerate the fixed-size subsets (pairs, k = 2) of
their prefix and meet on equal subsets; large sets scan the inverted lists of
the single tokens (k = 1) of their prefix, in which small sets stand too if they
are large enough to link with a large one. The size that divides small from
large is the one of least estimated cost (rows emitted and list entries met).

Lists are read from one shuffle sorted by token, as a stream; those of frequent
tokens, which can hold a third of all sets, are dealt over many tasks. Lists with
the same members are one list. Lists are handled by contraction: each list's most
central set is compared with the others first, which is one pair an entry; once
linked sets form components, blocks of a list that still spans several are
compared with blocks, in numpy, and only pairs across components that may link go
on. Candidates are thinned by exact bounds (sizes, and parity bitmaps as wide as
the sets: the popcount of the xor never exceeds the symmetric difference), then
verified on whole sets: each set's nearest candidate first, then whatever still
joins different components. Nothing is capped and no link is lost; what is
skipped is a link inside a known component.

Shingle hashes have 64 bits, set comparison uses 40 of them: two sets of 1,000
tokens have a common false token with a chance of about one in a million, and
one such token decides only at the very threshold.

Edge cases: null text or text without words: an empty set, its own component;
fewer words than a shingle: the whole sequence is the one element; repeated
rows share a component; null ids count as the smallest id; other columns are
ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .links import components
from .store import Scratch

#: Frequent tokens that every task may hold: at most this many (16 bytes each).
MOST_HEAVY = 1 << 18
_SEEN = 4  # a task reports tokens of at least so many of its documents
_WORDS = 16  # 64-bit words of the smallest parity bitmap
_BLOCK = 512
#: What a candidate pair costs, in list entries of 24 bytes: two bitmaps of 128 bytes and more, and two sets.
PAIR_COST = 16
_SPREAD = 64  # parts over which the list of a frequent token is dealt
#: Bits a wanted key has in the filter that thins a scan, and its largest size; beyond it a join alone picks the rows.
_BITS, _MOST_BITS = 16, 1 << 26


def token_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each text, offsets, and a key of each set (0: empty)."""
    w = tk.Words(texts)
    n = w.counts
    g, off = w.shingles(k)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = {int(d): tk.windows(w.hashes[w.off[d] : w.off[d + 1]] + tk.U(int(n[d])), np.array([0, n[d]]), int(n[d]))[0][0] for d in short}
        g = np.insert(g, off[short], [extra[int(d)] for d in short])
        off = off + np.concatenate(([0], np.cumsum(np.isin(np.arange(len(texts)), short))))
    v, off = tk.per_document_unique(g, off)
    total = np.concatenate((np.zeros(1, tk.U), np.cumsum(tk.mix(v ^ tk.U(0x5851F42D4C957F2D)), dtype=tk.U)))
    key = tk.mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(tk.U)).view(np.int64)
    key = np.where(np.diff(off) == 0, 0, np.where(key == 0, 1, key))
    return v, off, key


def need(n, percent: int):
    """Least overlap that a set of n tokens has with any partner."""
    return -(-percent * n // 100)


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, th, n, key) for documents, th a hash of the text, and (tokens, counts) for each task's frequent tokens."""

    def task(batches):
        pile: list[np.ndarray] = []
        count = 0
        tokens, counts = np.zeros(0, tk.U), np.zeros(0, np.int64)

        def fold(least):
            v = np.concatenate((np.concatenate(pile) if pile else np.zeros(0, tk.U), tokens))
            w = np.concatenate((np.ones(len(v) - len(tokens), np.int64), counts))
            order = np.argsort(v)
            v, w = v[order], w[order]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, int)
            w = np.add.reduceat(w, first) if len(v) else w
            v = v[first]
            pile.clear()
            return v[w >= least], w[w >= least]

        def out(ids, th, n, key, t=None, c=None):
            m = len(key)
            lists = [pa.array([t] if t is not None else [None] * m, pa.list_(pa.int64())), pa.array([c] if c is not None else [None] * m, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([ids, th, pa.array(n, pa.int64()), pa.array(key, pa.int64()), *lists], names=["doc_id", "th", "n", "key", "tokens", "counts"])

        for b, texts in tk.parts(batches):
            v, off, key = token_sets(texts, k)
            yield out(b.column(0), b.column(2), np.diff(off), key)
            pile.append(v)
            count += len(v)
            if count > 2_000_000:
                tokens, counts = fold(2)
                count = 0
        tokens, counts = fold(_SEEN)
        for i in range(0, len(tokens), 50_000):
            yield out(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), [0], [0], tokens[i : i + 50_000].view(np.int64), counts[i : i + 50_000])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(task, "doc_id long, th long, n long, key long, tokens array<long>, counts array<long>")


def boundary(sizes: dict[int, int], repeat: float, percent: int) -> int:
    """The largest size that counts as small: least cost over all choices.

    A small set emits the pairs of its prefix. A large one, or one that can link
    with a large one, emits single tokens, each of which meets another list entry
    with probability ``repeat``.
    """
    most = max((n for n in sizes if n <= 200), default=0)
    p = lambda n: n - need(n, percent) + 1
    small = {n: c * p(n) * (p(n) + 1) // 2 for n, c in sizes.items() if n <= 200}
    large = {n: c * p(n) * (1 + PAIR_COST * repeat) for n, c in sizes.items() if n <= 200}
    cost = lambda x: sum(c for n, c in small.items() if n <= x) + sum(c for n, c in large.items() if n >= need(x + 1, percent))
    return min(range(5, max(most, 5) + 1), key=cost)


def prefixes(texts: list[bytes], k: int, percent: int, heavy: np.ndarray, df: np.ndarray, small: int, seen: set[int]):
    """Rows (token, key, n, is subset, is heavy, rare tokens) of sets not seen before."""
    v, off, key = token_sets(texts, k)
    n = np.diff(off)
    where = np.searchsorted(heavy, v) if len(heavy) else np.zeros(len(v), int)
    hot = (heavy[np.minimum(where, len(heavy) - 1)] == v) if len(heavy) else np.zeros(len(v), bool)
    new = np.zeros(len(texts), bool)
    for d, x in enumerate(key.tolist()):
        if n[d] >= -(-percent // (100 - percent)) and x not in seen:
            seen.add(x)
            new[d] = True
    rare = tk.sums((~hot).astype(np.int64), off)
    length = n - need(n, percent) + 1
    first_large = need(small + 1, percent)
    doc = np.repeat(np.arange(len(texts)), n)
    rank = np.cumsum(~hot) - 1
    rank = rank - np.repeat(np.concatenate(([0], np.cumsum(rare)))[:-1], n)
    take = ~hot & new[doc] & (rank < length[doc]) & (n[doc] >= first_large)
    cols = [v[take], key[doc[take]], n[doc[take]], np.zeros(take.sum(), bool), np.zeros(take.sum(), bool), rare[doc[take]]]
    more: list[tuple] = []
    for d in np.flatnonzero(new & ((n <= small) | (rare < length))):
        s = slice(off[d], off[d + 1])
        cool, warm = v[s][~hot[s]], v[s][hot[s]]
        warm = warm[np.lexsort((warm, df[where[s][hot[s]]]))]
        about = (key[d], n[d])
        if n[d] >= first_large:
            more += [(t, *about, False, True, rare[d]) for t in warm[: max(0, length[d] - len(cool))]]
        if n[d] <= small:
            row = [(t, False) for t in cool] + [(t, True) for t in warm]
            for (a, ha), (b, hb) in itertools.combinations(row[: length[d] + 1], 2):
                more.append((tk.mix(np.array([a], tk.U) * tk.U(3) ^ tk.mix(np.array([b], tk.U)))[0], *about, True, ha and hb, rare[d]))
    if more:
        cols = [np.concatenate((c, np.array(m, c.dtype))) for c, m in zip(cols, zip(*more, strict=True), strict=True)]
    return cols


_ENTRY = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("subset", pa.bool_()), ("heavy", pa.bool_()), ("rare", pa.int32())])


def _entries(docs: DataFrame, k: int, percent: int, heavy, df, small: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((heavy, df))

    def task(batches):
        heavy, df = shared.value
        seen: set[int] = set()
        for _, texts in tk.parts(batches):
            token, *rest = prefixes(texts, k, percent, heavy, df, small, seen)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((token.view(np.int64), *rest), _ENTRY.types, strict=True)], schema=_ENTRY)

    return docs.select("text").mapInArrow(task, "token long, key long, n int, subset boolean, heavy boolean, rare int")


_MET = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("rare", pa.int32())])


def shared_rows(batches):
    """Of sorted rows (token, key, n, rare, heavy), those whose token another key has too, and all heavy ones; repeats of a row go.

    One row is held back from batch to batch, so lists of any length pass.
    """
    held, listed = None, False  # the last row, and whether the row before it has its token
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if held is not None:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
        token, key = cols[0], cols[1]
        if not len(token):
            continue
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        cols = [c[fresh] for c in cols]
        token = cols[0]
        same = token[1:] == token[:-1]
        keep = cols[4].astype(bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= listed
        listed = bool(keep[-1]) if len(token) == 1 else bool(same[-1])
        held = [c[-1:] for c in cols]
        yield [c[:-1][keep[:-1]] for c in cols[:4]]
    if held is not None and (listed or held[4][0]):
        yield [c for c in held[:4]]


def _met(entries: DataFrame) -> DataFrame:
    """(token, key, n, rare) of the lists with more than one set, and of all frequent tokens."""

    def task(batches):
        for cols in shared_rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _MET.types, strict=True)], schema=_MET)

    # a token known to be frequent is dealt over many tasks, so no list is a large part of one
    part = F.when(F.col("heavy"), F.pmod(F.xxhash64("key"), F.lit(_SPREAD))).otherwise(0)
    rows = entries.select("token", "key", "n", "rare", "heavy").repartition("token", part).sortWithinPartitions("token", "key")
    return rows.mapInArrow(task, "token long, key long, n int, rare int")


def _lists(met: DataFrame) -> DataFrame:
    """(token, key, n, lead, lead_n) of each different list of more than one set; it is led by its most central set (fewest rare tokens)."""
    lists = met.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "key")).alias("y"), F.min(F.struct("rare", "n", "key")).alias("l")).filter("m > 1")
    one = lists.groupBy("m", "x", "y").agg(F.min(F.struct("token", "l")).alias("t"))
    one = one.select(F.col("t.token").alias("_t"), F.col("t.l.key").alias("lead"), F.col("t.l.n").alias("lead_n"))
    return met.join(one, met.token == F.col("_t")).select("token", "key", "n", "lead", "lead_n")


def _star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each list's leading set with the others."""
    both = lists.filter((F.col("key") != F.col("lead")) & (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")))
    return both.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()


def _picked(docs: DataFrame, wanted: DataFrame, k: int, whole: bool) -> DataFrame:
    """(key, n, data) of the wanted keys; ``data`` is the set itself (whole) or its parity bitmap.

    A filter sized by the number of keys thins the one scan; the join decides.
    """
    wanted = wanted.select(F.col("key").alias("_w"))
    bits = 1 << max(20, (wanted.count() * _BITS - 1).bit_length())
    bloom = None
    if bits <= _MOST_BITS:
        spots = wanted.select(F.explode(F.array(F.pmod("_w", F.lit(bits)), F.pmod(F.shiftright("_w", 24), F.lit(bits)))).alias("s"))
        words = spots.groupBy((F.col("s") / 32).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 32).cast("int"))).alias("w")).toPandas()  # at most _MOST_BITS / 32 rows
        bloom = np.zeros(bits // 32, np.uint32)
        bloom[words["i"].to_numpy(np.int64)] = words["w"].to_numpy(np.int64).astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def task(batches):
        bloom, seen = shared.value, set()
        for _, texts in tk.parts(batches):
            v, off, key = token_sets(texts, k)
            has = np.ones(len(key), bool)
            for s in (key % bits, (key >> 24) % bits) if bloom is not None else ():
                has &= (bloom[s >> 5] >> (s & 31).astype(np.uint32) & 1).astype(bool)
            rows = []
            for d in np.flatnonzero(has):
                if (x := int(key[d])) in seen:
                    continue
                seen.add(x)
                t = v[off[d] : off[d + 1]]
                rows.append({"key": x, "n": len(t), "data": squeeze(t) if whole else parity(t)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    found = docs.select("text").mapInArrow(task, "key long, n long, data binary")
    return found.join(wanted, found.key == F.col("_w"), "left_semi").dropDuplicates(["key"])


def parity(t: np.ndarray) -> bytes:
    """One bit for each of 2^m >= n buckets (1,024 at least): whether it holds an odd number of tokens."""
    width = max(64 * _WORDS, 1 << (len(t) - 1).bit_length())
    odd = np.bincount((t & tk.U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, words: int) -> np.ndarray:
    """The bitmap over fewer buckets: bucket b of the smaller one takes all b + i * width."""
    x = np.frombuffer(bits, np.uint64)
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) if len(x) > words else x


def squeeze(t: np.ndarray) -> bytes:
    """The top 40 bits of sorted tokens."""
    return (t >> tk.U(32)).astype("<u4").tobytes() + (t >> tk.U(24) & tk.U(255)).astype(np.uint8).tobytes()


def unsqueeze(b: bytes) -> np.ndarray:
    n = len(b) // 5
    return np.frombuffer(b, "<u4", n).astype(np.int64) << 8 | np.frombuffer(b, np.uint8, n, 4 * n)


def most_apart(total, percent: int):
    """The largest symmetric difference of two linked sets with so many tokens in all."""
    return total - 2 * -(-percent * total // (100 + percent))


def _near_by_bits(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart) of the pairs whose parity bitmaps allow a link; apart in per mille of the tokens."""
    x = bits.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("data").alias("xa"))
    y = bits.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("data").alias("xb"))

    def task(batches):
        for b in batches:
            total = b.column(2).to_numpy() + b.column(4).to_numpy()
            apart = np.zeros(b.num_rows, np.int64)
            for i, (p, q) in enumerate(zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)):
                words = min(len(p), len(q)) // 8
                apart[i] = np.bitwise_count(folded(p, words) ^ folded(q, words)).sum()
            ok = pa.array(apart <= most_apart(total, percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1000 * apart // np.maximum(total, 1))], names=["a", "b", "apart"]).filter(ok)

    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "xa", "nb", "xb").mapInArrow(task, "a long, b long, apart long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that link, counted on whole sets."""
    x = sets.select(F.col("key").alias("a"), F.col("data").alias("ta"))
    y = sets.select(F.col("key").alias("b"), F.col("data").alias("tb"))

    def task(batches):
        for b in batches:
            keep = []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = unsqueeze(s), unsqueeze(t)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not known to be in one component."""
    x = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    y = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    out = pairs.join(x, "a", "left").join(y, "b", "left")
    return out.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def may_link(p: tuple, q: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows (key, n, root, bitmaps) of two blocks whose sizes and bitmaps allow a link across components.

    Two bitmaps are compared at the width of the narrower one; where sizes allow
    a link, the other is at most twice as wide.
    """
    found = []
    tables = [({w: [k for k, x in enumerate(side[3]) if len(x) == 8 * w] for w in {len(x) // 8 for x in side[3]}}, side) for side in (p, q)]
    (by_p, _), (by_q, _) = tables
    for wp, rows_p in by_p.items():
        for wq, rows_q in by_q.items():
            w = min(wp, wq)
            if max(wp, wq) > 2 * w:
                continue
            x, y = np.array([folded(p[3][k], w) for k in rows_p]), np.array([folded(q[3][k], w) for k in rows_q])
            rows_a, rows_b = np.array(rows_p), np.array(rows_q)
            n, m = p[1][rows_a][:, None], q[1][rows_b][None, :]
            i, j = np.nonzero((p[2][rows_a][:, None] != q[2][rows_b][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            for at in range(0, len(i), max(1, (1 << 21) // w)):
                a, b = i[at : at + max(1, (1 << 21) // w)], j[at : at + max(1, (1 << 21) // w)]
                apart = np.bitwise_count(x[a] ^ y[b]).sum(1, dtype=np.int64)
                ok = apart <= most_apart(p[1][rows_a[a]] + q[1][rows_b[b]], percent)
                found.append((rows_a[a[ok]], rows_b[b[ok]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _block_pairs(lists: DataFrame, bits: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components within lists, blocks against blocks."""
    r = roots.select(F.col("node").alias("key"), "root")
    m = lists.select("token", "key").join(r, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = m.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).filter("lo != hi")
    m = m.join(mixed.select("token", F.ceil(F.col("m") / _BLOCK).alias("blocks")), "token").join(bits, "key")
    m = m.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    blocks = m.groupBy("token", "block").agg(F.collect_list(F.struct("key", "n", "root", "data")).alias("rows"))  # about _BLOCK rows each
    x = blocks.select("token", F.col("block").alias("i"), F.col("rows").alias("x"))
    y = blocks.select("token", F.col("block").alias("j"), F.col("rows").alias("y"))

    def columns(rows):
        key, n, root, data = rows.flatten().flatten()
        return key.to_numpy(), n.to_numpy(), root.to_numpy(), data.to_pylist()

    def task(batches):
        for b in batches:
            for k in range(b.num_rows):
                p, q = columns(b.column(0).slice(k, 1)), columns(b.column(1).slice(k, 1))
                i, j = may_link(p, q, percent)
                a, c = p[0][i], q[0][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["a", "b"])

    return x.join(y, "token").filter("i <= j").select("x", "y").mapInArrow(task, "a long, b long").distinct()


def linked(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, th, n, key) and the components (node, root) of set keys with links."""
    scratch = scratch or Scratch(docs.sparkSession)
    scanned = scratch.keep(_scan(docs, k), "scan")
    rows = scanned.filter("tokens is null").select("doc_id", "th", "n", "key")
    counts = scanned.filter("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("c"))
    counts = scratch.keep(counts, "counts")
    total = rows.agg(F.sum("n")).first()[0] or 0
    # a token is heavy from the least count on that leaves at most MOST_HEAVY of them, 16 at least
    level = F.floor(F.log2("c") * 8)
    floor, size = 1 << 62, 0
    for r in sorted(counts.filter("c >= 16").groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), reverse=True):  # at most 512 rows
        size += r.n
        if size > MOST_HEAVY:
            break
        floor = r.c
    found = counts.filter(F.col("c") >= floor).toPandas()
    order = np.argsort(found["token"].to_numpy(np.int64).view(tk.U))
    heavy, df = found["token"].to_numpy(np.int64).view(tk.U)[order], found["c"].to_numpy(np.int64)[order]
    # the share of entries whose token some task has met several times; each meets the leading set of its list
    repeat = (counts.agg(F.sum("c").alias("c")).first().c or 0) / max(1, total)
    sizes = {r.n: r["count"] for r in rows.filter("n between 1 and 200").groupBy("n").count().collect()}
    small = boundary(sizes, repeat, percent)
    met = scratch.keep(_met(_entries(docs, k, percent, heavy, df, small)), "met")
    lists = scratch.keep(_lists(met), "lists")
    scratch.drop(met)
    pairs = scratch.keep(_star_pairs(lists, percent), "pairs")
    both = lambda t: t.select(F.explode(F.array("a", "b")).alias("key"))
    bits = scratch.keep(_picked(docs, lists.select("key").distinct(), k, whole=False), "bits")
    near = scratch.keep(_near_by_bits(pairs, bits, percent), "near")
    scratch.drop(pairs)
    sets = scratch.keep(_picked(docs, both(near).distinct(), k, whole=True), "sets")
    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "apart"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "apart"))).alias("e")).select("e.*")
    nearest = ends.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()
    links = scratch.keep(_verified(nearest, sets, percent), "links")
    roots = scratch.keep(components(links, scratch), "roots")
    more = scratch.keep(_verified(_across(near, roots), sets, percent), "links")
    links = links.unionByName(more)
    if not more.isEmpty():
        roots = scratch.keep(components(links, scratch), "roots")
    scratch.drop(sets)
    rest = scratch.keep(_block_pairs(lists, bits, roots, percent), "rest")
    if not rest.isEmpty():
        sets = scratch.keep(_picked(docs, both(rest).distinct(), k, whole=True), "sets")
        last = scratch.keep(_verified(rest, sets, percent), "links")
        if not last.isEmpty():
            roots = scratch.keep(components(links.unionByName(last), scratch), "roots")
        scratch.drop(sets)
    scratch.drop(bits, near, rest, lists)
    return rows, roots


def grouped(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, root) for every row; root tells components apart where ids repeat, null without words."""
    rows, roots = linked(docs, k, percent)
    least = rows.filter("key != 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    r = roots.select(F.col("node").alias("key"), "root")
    known = least.join(r, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    member = known.select("key", "root").join(lowest, "root").select("key", "root", "component_id")
    out = rows.join(member, "key", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def op2(docs: DataFrame) -> DataFrame:
    return grouped(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id")

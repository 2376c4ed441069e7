"""Hashed maximum-entropy language model.

P(word | context) = P(class | context) P(word | class, context). Both factors
are softmaxes over sums of weight rows that hashed context features select: the
last four words one by one (skips), and the last two together (n-gram). The
1,024 most frequent training tokens sit in 32 classes of 32; every other word
is in one of 32 spelling classes (from its last two bytes) and within it has
probability (c + 1) / (N_class + V_class + 1), which leaves room for one unseen
word, so probabilities of each context sum to one.

Counts cover every training document. Training runs in rounds of distributed
gradient updates: each task starts from the broadcast weights, makes AdaGrad
steps on its documents' positions, and the tasks' weights are averaged row by row,
weighted by how often a task updated the row, in two levels so that no task
gathers all of them. Each round takes every ROUNDS-th position, each time another
residue, so that all rounds together learn from every position once. The weights
have a fixed size (4 MB) whatever the corpus: words outside the frequent classes
share context rows by spelling class, a limit of this model's capacity.

Words are told apart by 64-bit hashes. Counts of at most 131,072 frequent words
are broadcast; the rest go through a join: a document's other words are written
once and joined to their counts by hash.

Edge cases: null and empty texts have one token, the end; without training
documents all counts are 0 and the classes are uniform; repeated rows are scored
each, and counted each; null ids hash as the empty text; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .quality import remainder
from .store import Scratch

WIDTH = 32  # words in a class
HEAD = 32  # classes of frequent words
TAIL = 32  # classes of other words
CLASSES = HEAD + TAIL
FREQUENT = 1 << 17
BEGIN = HEAD * WIDTH + TAIL
CONTEXTS = BEGIN + 1
SKIPS = 4
ROWS, INNER = 1 << 13, 1 << 14  # at most 65,536 each: rows are sorted as 16-bit numbers
ROUNDS = 2
BLOCKS = 8
_END = tk.mix(np.array([77], tk.U))[0]


class Index:
    """Positions of distinct 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask, self.shift = (1 << bits) - 1, tk.U(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot[at] < 0
            place, first = np.unique(at[free], return_index=True)
            self.slot[place] = left[free][first]
            missed = self.slot[at] != left
            left, at = left[missed], (at[missed] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        out = np.full(len(h), -1, np.int32)
        at = (h >> self.shift).astype(np.int64)
        todo = np.arange(len(h))
        for _ in range(self.probes):
            s = self.slot[at]
            filled = s >= 0
            todo, at, s = todo[filled], at[filled], s[filled]
            hit = self.keys[s] == h[todo]
            out[todo[hit]] = s[hit]
            todo, at = todo[~hit], (at[~hit] + 1) & self.mask
            if not len(todo):
                break
        return out


def spelling_class(w: tk.Words) -> np.ndarray:
    last = w.arr[w.ends - 1].astype(np.int64)
    before = np.where(w.ends - w.starts > 1, w.arr[np.maximum(w.ends - 2, 0)], 0)
    return (last * 5 + before * 11) % TAIL


def _counted(docs: DataFrame) -> DataFrame:
    """(h, cls, c) of each task's words, ends included."""
    schema = pa.schema([("h", pa.int64()), ("cls", pa.int32()), ("c", pa.int64())])

    def task(batches):
        pile: list[tuple] = []
        size = 0

        def fold():
            h, s, c = (np.concatenate(x) for x in zip(*pile, strict=True))
            order = np.argsort(h)
            h, s, c = h[order], s[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return h[first], s[first], np.add.reduceat(c, first)

        def rows(t):
            for i in range(0, len(t[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], k) for x, k in zip((t[0].view(np.int64), t[1], t[2]), schema.types, strict=True)], schema=schema)

        for _, texts in tk.parts(batches):
            w = tk.Words(texts)
            h, first, c = np.unique(w.hashes, return_index=True, return_counts=True)
            pile.append((np.append(h, _END), np.append(spelling_class(w)[first], 0), np.append(c, len(texts))))
            size += len(h)
            if size > 1_500_000:
                pile[:] = [fold()]
                size = len(pile[0][0])
                if size > 1_000_000:
                    yield from rows(pile.pop())
                    size = 0
        if pile:
            yield from rows(fold())

    return docs.select("text").mapInArrow(task, "h long, cls int, c long")


class Lexicon:
    """Frequent words and totals: what every task holds."""

    def __init__(self, hashes, counts, n: int, v: int, tail_n, tail_v):
        order = np.lexsort((hashes, -counts, hashes != _END))
        self.hashes, self.counts = hashes[order], counts[order]
        self.n, self.v = n, v
        self.tail_log = np.log10(tail_n + tail_v + 1.0)
        self.index = Index(self.hashes)
        self.rank = min(len(self.hashes), HEAD * WIDTH)


def lexicon(counts: DataFrame) -> tuple[Lexicon, int]:
    """The broadcast part of the counts, and the count from which on words are in it."""
    total = counts.agg(F.sum("c"), F.count("*")).first()
    level = F.floor(F.log2("c") * 16)
    levels = sorted(counts.groupBy(level.alias("l")).count().collect(), reverse=True)  # at most 1,024 rows
    least, size = 1 << 62, 0
    for r in levels:
        size += r["count"]
        if size > FREQUENT:
            break
        least = r.l
    top = counts.filter((level >= least) | (F.col("h") == int(_END.view(np.int64)))).toPandas()
    h, c, s = top["h"].to_numpy(np.int64).view(tk.U), top["c"].to_numpy(np.int64), top["cls"].to_numpy()
    if not (h == _END).any():
        h, c, s = np.append(h, _END), np.append(c, 0), np.append(s, 0)
    per = {r.cls: r for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tail_n = np.array([per[k].n if k in per else 0 for k in range(TAIL)], float)
    tail_v = np.array([per[k].v if k in per else 0 for k in range(TAIL)], float)
    ranked = np.lexsort((h, -c, h != _END))[: HEAD * WIDTH]
    ranked = ranked[c[ranked] > 0]
    np.subtract.at(tail_n, s[ranked], c[ranked])
    np.subtract.at(tail_v, s[ranked], 1)
    return Lexicon(h, c, int(total[0] or 0), int(total[1]), tail_n, tail_v), least


class Tokens:
    """Tokens of a batch with their contexts, flat; each document ends with the end token."""

    def __init__(self, texts: list[bytes], lex: Lexicon):
        w = self.words = tk.Words(texts)
        self.found = lex.index.find(w.hashes)
        self.spelling = spelling_class(w)
        ids = np.where((self.found >= 0) & (self.found < lex.rank), self.found, HEAD * WIDTH + self.spelling)
        n, d = w.counts, len(texts)
        base = w.off[:-1] + np.arange(d) * (SKIPS + 1)
        seq = np.full(len(ids) + d * (SKIPS + 1), BEGIN, np.int32)
        self.at = np.arange(len(ids)) + np.repeat(np.arange(d) * (SKIPS + 1) + SKIPS, n)
        seq[self.at] = ids
        self.ends = base + SKIPS + n
        seq[self.ends] = 0  # the end is the first of the frequent tokens
        self.seq = seq
        self.targets = np.sort(np.concatenate((self.at, self.ends)))
        self.off = w.off + np.arange(d + 1)

    def features(self, at: np.ndarray) -> np.ndarray:
        f = np.empty((len(at), SKIPS + 1), np.int64)
        for k in range(SKIPS):
            f[:, k] = k * CONTEXTS + self.seq[at - 1 - k]
        two = self.seq[at - 1].astype(np.uint64) * tk.U(CONTEXTS) + self.seq[at - 2].astype(np.uint64)
        f[:, SKIPS] = SKIPS * CONTEXTS + ((two * tk.U(0x9E3779B97F4A7C15) >> tk.U(40)) % tk.U(ROWS - SKIPS * CONTEXTS)).astype(np.int64)
        return f


def class_of(y: np.ndarray) -> np.ndarray:
    return np.where(y < HEAD * WIDTH, y // WIDTH, y - HEAD * WIDTH + HEAD)


def inner_features(f: np.ndarray, cls: np.ndarray) -> np.ndarray:
    x = f.astype(np.uint64) * tk.U(CLASSES) + cls.astype(np.uint64)[:, None]
    return (x * tk.U(0xD6E8FEB86659FD93) >> tk.U(50)).astype(np.int64)


def start(lex: Lexicon) -> dict[str, np.ndarray]:
    """Weights that equal the unigram model: logs of counts as biases, all else nought."""
    c = np.zeros(HEAD * WIDTH)
    c[: lex.rank] = lex.counts[: lex.rank] + 0.5
    tail = 10**lex.tail_log
    with np.errstate(divide="ignore"):
        by_class = np.log(np.concatenate((c.reshape(HEAD, WIDTH).sum(1), tail)) + 1e-3)
        inner = np.maximum(np.log(c.reshape(HEAD, WIDTH)), -30.0)
    return {"cb": by_class.astype(np.float32), "ib": inner.astype(np.float32), "cw": np.zeros((ROWS, CLASSES), np.float32), "iw": np.zeros((INNER, WIDTH), np.float32)}


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _logits(bias, table, f):
    x = np.take(table, f[:, 0], axis=0)
    x += bias
    more = np.empty_like(x)
    for k in range(1, f.shape[1]):
        x += np.take(table, f[:, k], axis=0, out=more, mode="clip")
    return x


def run_sums(g: np.ndarray, src: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows ``g[src]`` over runs that start at ``first``.

    Runs are cut into pieces of at most 16 rows and the longest pieces come first, so
    that the r-th rows of all pieces are added at once; sums of pieces are summed likewise.
    """
    length = np.diff(np.append(first, len(src)))
    pieces = (length + 15) // 16
    off = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(off, pieces)
    at, size = np.repeat(first, pieces) + 16 * nth, np.minimum(16, np.repeat(length, pieces) - 16 * nth)
    order = np.argsort(-size, kind="stable")
    at, longer = at[order], np.searchsorted(-size[order], -np.arange(1, 16))
    total = np.take(g, src[at], axis=0)
    for r, n in enumerate(longer.tolist(), 1):
        if n:
            total[:n] += np.take(g, src[at[:n] + r], axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out if len(out) == len(first) else run_sums(out, np.arange(len(out)), off)


def log10_probability(m: dict, t: Tokens) -> np.ndarray:
    """Of each target token; for words outside the frequent classes, of their class only."""
    out = np.empty(len(t.targets))
    for i in range(0, len(t.targets), 4096):
        at = t.targets[i : i + 4096]
        y, f = t.seq[at], t.features(at)
        cls = class_of(y)
        p = _log_softmax(_logits(m["cb"], m["cw"], f))[np.arange(len(at)), cls].astype(float)
        h = np.flatnonzero(y < HEAD * WIDTH)
        if len(h):
            x = _logits(m["ib"][cls[h]], m["iw"], inner_features(f[h], cls[h]))
            p[h] += _log_softmax(x)[np.arange(len(h)), y[h] % WIDTH]
        out[i : i + 4096] = p
    return out / np.log(10)


class Learner:
    """AdaGrad on one task's positions, with one accumulator a weight row."""

    def __init__(self, m: dict, rate: float = 0.3):
        self.m, self.rate = {k: v.copy() for k, v in m.items()}, rate
        self.seen = {"cw": np.zeros(ROWS, np.float32), "iw": np.zeros(INNER, np.float32)}
        self.norm = {k: np.full(len(v), 1e-3, np.float32) for k, v in self.seen.items()}

    def _step(self, name: str, f: np.ndarray, g: np.ndarray) -> None:
        flat = f.astype(np.uint16).ravel()
        order = np.argsort(flat, kind="stable")
        row = flat[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        row = row[first]
        total = run_sums(g, order // f.shape[1], first)
        self.norm[name][row] += np.einsum("ij,ij->i", total, total) / g.shape[1]
        total *= (self.rate / np.sqrt(self.norm[name][row] * g.shape[1])).astype(np.float32)[:, None]
        self.m[name][row] -= total
        self.seen[name][row] += np.diff(np.append(first, len(flat)))

    def learn(self, t: Tokens, at: np.ndarray) -> None:
        for i in range(0, len(at), 4096):
            a = at[i : i + 4096]
            y, f = t.seq[a], t.features(a)
            cls = class_of(y)
            g = np.exp(_log_softmax(_logits(self.m["cb"], self.m["cw"], f)))
            g[np.arange(len(a)), cls] -= 1
            self._step("cw", f, g)
            h = np.flatnonzero(y < HEAD * WIDTH)
            if len(h):
                f2 = inner_features(f[h], cls[h])
                g = np.exp(_log_softmax(_logits(self.m["ib"][cls[h]], self.m["iw"], f2)))
                g[np.arange(len(h)), y[h] % WIDTH] -= 1
                self._step("iw", f2, g)


_PART = pa.schema([("block", pa.int32()), ("task", pa.int64()), ("w", pa.binary()), ("seen", pa.binary())])


def _round(docs: DataFrame, lex, model: dict, turn: int, rounds: int) -> dict:
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))

    def task(batches):
        lex, m = shared.value
        learner, carry = None, turn
        for _, texts in tk.parts(batches):
            learner = learner or Learner(m)
            t = Tokens(texts, lex)
            learner.learn(t, t.targets[carry % rounds :: rounds])
            carry -= len(t.targets)
        if learner:
            who = TaskContext.get().partitionId()
            for i, name in enumerate(("cw", "iw")):
                w, seen = learner.m[name].astype(np.float16), learner.seen[name]
                for b, (x, s) in enumerate(zip(np.split(w, BLOCKS), np.split(seen, BLOCKS), strict=True)):
                    yield pa.RecordBatch.from_pydict({"block": [i * BLOCKS + b], "task": [who], "w": [x.tobytes()], "seen": [s.tobytes()]}, schema=_PART)

    def average(tables):
        """Mean of weight rows, weighted by their updates, over an iterator of batches."""
        block, who, num, den = 0, 0, None, None
        for b in tables:
            for block, who, w, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen = np.frombuffer(s, np.float32).astype(float)
                x = np.frombuffer(w, np.float16).reshape(len(seen), -1) * seen[:, None]
                num, den = (x, seen) if num is None else (num + x, den + seen)
        mean = (num / np.maximum(den, 1e-9)[:, None]).astype(np.float16)
        return pa.RecordBatch.from_pydict({"block": [block], "task": [who // 64], "w": [mean.tobytes()], "seen": [den.astype(np.float32).tobytes()]}, schema=_PART)

    fields = "block int, task long, w binary, seen binary"
    parts = docs.select("text").mapInArrow(task, fields)

    def merged(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([average(table.to_batches())])

    one = parts.groupBy("block", F.floor(F.col("task") / 64)).applyInArrow(merged, fields)
    rows = one.groupBy("block").applyInArrow(merged, fields).collect()  # 2 * BLOCKS rows, 4 MB in all
    new = dict(model)
    for i, (name, size) in enumerate((("cw", CLASSES), ("iw", WIDTH))):
        table = model[name].copy()
        for r in rows:
            if r.block // BLOCKS == i:
                n = len(table) // BLOCKS
                seen = np.frombuffer(r.seen, np.float32) > 0
                part = table[(r.block % BLOCKS) * n : (r.block % BLOCKS + 1) * n]
                part[seen] = np.frombuffer(r.w, np.float16).reshape(n, size)[seen]
        new[name] = table
    return new


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_head double, score_head double, tail_h array<long>, tail_m array<int>"


def _scored(docs: DataFrame, lex: Lexicon, model: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((lex, model))

    def task(batches):
        lex, m = shared.value
        rid = TaskContext.get().partitionId() << 36
        for b, texts in tk.parts(batches, most=1_000_000):
            t = Tokens(texts, lex)
            n = np.diff(t.off)
            model_p = tk.sums(log10_probability(m, t), t.off)
            known = t.found >= 0
            c = np.where(known, lex.counts[np.maximum(t.found, 0)], 0)
            logs = np.log10(c + 1.0)
            off = t.words.off
            base = tk.sums(logs, off) + np.log10(lex.counts[0] + 1.0) - n * np.log10(lex.n + lex.v + 1.0)
            inner = np.where(t.found >= lex.rank, logs, 0.0) - np.where((t.found >= lex.rank) | ~known, lex.tail_log[t.spelling], 0.0)
            score = model_p + tk.sums(inner, off)
            n_known = tk.sums(known.astype(np.int64), off) + int(lex.counts[0] > 0)
            rare = np.flatnonzero(~known)
            doc = t.words.docs()[rare]
            roff = np.searchsorted(doc, np.arange(len(texts) + 1))
            h, hoff = tk.per_document_unique(t.words.hashes[rare], roff)
            # multiplicity of each distinct rare word of a document
            order = np.lexsort((t.words.hashes[rare], doc))
            hs, ds = t.words.hashes[rare][order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])))) if len(hs) else np.zeros(0, int)
            mult = np.diff(np.append(first, len(hs)))
            lists = [pa.ListArray.from_arrays(pa.array(hoff, pa.int32()), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(hoff, pa.int32()), pa.array(mult, pa.int32()))]
            cols = [pa.array(rid + np.arange(len(texts))), b.column(0), b.column(2), pa.array(n), pa.array(n_known), pa.array(base), pa.array(score), *lists]
            rid += len(texts)
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCORED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    return rows.mapInArrow(task, _SCORED)


def train(docs: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, Lexicon, dict, int]:
    """Counts of all words, the lexicon, the weights, and the least level of the lexicon."""
    counts = scratch.keep(_counted(docs).groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c")), "counts")
    lex, least = lexicon(counts)
    model = start(lex)
    for k in range(rounds):
        model = _round(docs, lex, model, k, rounds)
    return counts, lex, model, least


def op1(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    counts, lex, model, least = train(docs.filter("not held_out"), scratch)
    rows = scratch.keep(_scored(docs, lex, model), "scored")
    # an unseen word adds log10(1) = 0, so only known words need to be met
    tail = rows.select("rid", F.explode(F.arrays_zip("tail_h", "tail_m")).alias("x")).select("rid", F.col("x.tail_h").alias("h"), F.col("x.tail_m").alias("m"))
    rest = counts.filter(F.floor(F.log2("c") * 16) < least).select("h", "c")
    more = tail.join(rest, "h").groupBy("rid").agg(F.sum(F.col("m") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum(F.col("m").cast("long")).alias("known"))
    zero = F.lit(0.0)
    out = rows.drop("tail_h", "tail_m").join(more, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(lex.n).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("logs", zero)).alias("base_score"), (F.col("score_head") + F.coalesce("logs", zero)).alias("score"),
    )

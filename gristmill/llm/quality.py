"""Quality classifier: naive Bayes support vectors.

Indicators of hashed word and word-shape n-grams are scaled by the log ratio of
their smoothed counts in the two classes; a linear hinge-loss model over the
scaled, length-normalised indicators is fitted by dual coordinate descent and
its margin is turned into a probability by a logistic fit on rows that the
descent did not see. Only the text enters a score.

Edge cases: a null or empty text has no indicators and gets the score of the
bias; labels that are null or other than 0 and 1 are ignored; without labelled
rows of both classes the score is the share of label 1 (0.5 without labels).
Repeated rows are scored once each; columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

BUCKETS = 1 << 18
#: At most about this many labelled rows are fitted, chosen by a hash of doc_id.
SAMPLE = 5000
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, with offsets."""
    w = tk.Words(texts)
    cased = tk.Words(texts, lower=False)
    shape = _SHAPE[cased.arr]
    same = np.zeros(len(shape), bool)
    same[1:] = (shape[1:] == shape[:-1]) & (shape[1:] != 10)
    first = np.flatnonzero(~same)
    bytes_off = np.searchsorted(first, cased.byte_off)
    cased.byte_off = bytes_off
    cased._index(shape[first])
    found = []
    for kind, (h, off) in enumerate(((w.hashes, w.off), (cased.hashes, cased.off))):
        found.append((tk.mix(h + tk.U(2 * kind + 1)), off))
        found.append((tk.windows(h + tk.U(7 * kind), off, 2)[0], tk.windows(h, off, 2)[1]))
    echo = np.zeros(len(w.hashes), tk.U)
    echo[1:] = w.hashes[1:] == w.hashes[:-1]
    found.append(tk.windows(echo + tk.U(99), w.off, 3))
    doc = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(off)) for _, off in found]).astype(np.int64)
    bucket = np.concatenate([(h >> tk.U(46)).astype(np.int64) for h, _ in found])
    both = np.unique(doc << 18 | bucket)
    return both & (BUCKETS - 1), np.searchsorted(both >> 18, np.arange(len(texts) + 1))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, rounds: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over rows of feature numbers."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    xs = [(r, (ratio[r] / max(1e-9, np.sqrt((ratio[r] ** 2).sum()))).astype(np.float32)) for r in rows]
    norm = np.array([2.0 if len(r) else 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, x = xs[i]
            slope = y[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margin: np.ndarray, y01: np.ndarray) -> tuple[float, float]:
    """Platt's fit of label 1 on the margin, with his smoothed targets."""
    pos, neg = (y01 == 1).sum(), (y01 == 0).sum()
    target = np.where(y01 == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, s = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(d * margin).sum(), d.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def fit(texts: list[bytes], labels: list[int]) -> dict:
    y01 = np.array(labels, int)
    if len(set(labels)) < 2:
        return {"share": float(y01.mean()) if len(y01) else 0.5}
    rows: list[np.ndarray] = []
    for i in range(0, len(texts), 200):
        f, off = indicators(texts[i : i + 200])
        f = f.astype(np.int32)
        rows += [f[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y01[held])) < 2 or len(set(y01[~held])) < 2:
        held = np.zeros(len(rows), bool)
    count = np.ones((2, BUCKETS))
    for i in np.flatnonzero(~held):
        count[y01[i], rows[i]] += 1  # a row's features are distinct
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio[np.abs(count[0] + count[1]) < 2.5] = 0.0
    fitted = np.flatnonzero(~held)
    w, bias = descend([rows[i] for i in fitted], 2.0 * y01[fitted] - 1, ratio)
    model = {"wr": (w * ratio).astype(np.float32), "rr": (ratio * ratio).astype(np.float32), "bias": bias}
    at = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    margin = np.array([model["wr"][rows[i]].sum() / max(1e-9, np.sqrt(model["rr"][rows[i]].sum())) + bias for i in at])
    model["a"], model["b"] = logistic(margin, y01[at])
    return model


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    if "share" in model:
        return np.full(len(texts), model["share"])
    f, off = indicators(texts)
    margin = tk.sums(model["wr"][f].astype(float), off) / np.maximum(1e-9, np.sqrt(tk.sums(model["rr"][f].astype(float), off))) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -30, 30)))


def remainder(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit in one task on at most about ``sample`` labelled rows; the driver gets the weights."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    known = known.filter(remainder(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 20)) < int(sample / total * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # its size is bounded by ``sample``

    def task(batches):
        texts, y = [], []
        got = sorted((i or 0, t, q) for b in batches for i, t, q in zip(b.column(0).to_pylist(), tk.encoded(b.column(1)), b.column(2).to_pylist(), strict=True))
        for _, t, q in got[: 2 * sample]:
            texts.append(t)
            y.append(q)
        m = fit(texts, y)
        floats = [float(m.get(k, np.nan)) for k in ("share", "bias", "a", "b")]
        yield pa.RecordBatch.from_pydict({"floats": [floats], "wr": [m["wr"].tobytes() if "wr" in m else b""], "rr": [m["rr"].tobytes() if "rr" in m else b""]}, schema=pa.schema([("floats", pa.list_(pa.float64())), ("wr", pa.binary()), ("rr", pa.binary())]))

    found = rows.repartition(1).mapInArrow(task, "floats array<double>, wr binary, rr binary").collect()
    if not found:
        return {"share": 0.5}
    share, bias, a, b = found[0].floats
    if not found[0].wr:
        return {"share": share}
    return {"wr": np.frombuffer(found[0].wr, np.float32), "rr": np.frombuffer(found[0].rr, np.float32), "bias": bias, "a": a, "b": b}


def score_documents(docs: DataFrame, model: dict, columns: list[str] | None = None) -> DataFrame:
    """The named columns (all, if not given) with ``quality_score``; a narrow map, no shuffle."""
    keep = columns or docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for b, texts in tk.parts(batches):
            out = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array(scores(shared.value, texts))], names=[*keep, "quality_score"])

    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).schema.add("quality_score", "double")
    return frame.mapInArrow(task, schema)


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

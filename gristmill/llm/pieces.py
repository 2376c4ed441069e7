"""SentencePiece encoding and decoding with byte offsets.

The model file's normaliser is read here: its compiled character map (a double
array over UTF-8 bytes with the replacements after it) is walked for the longest
prefix at every position, and every byte of the normalised text keeps the span
of source bytes it came from. Ids come from the sentencepiece library; their
lengths in the normalised text project each piece back onto source bytes.

No vocabulary piece holds a space mark after another character, so a text whose
normalisation is the identity can be encoded space by space, and the ids of a
word are looked up in a bounded table. ``Encoder`` checks that property on the
model and otherwise gives the library whole texts.

Edge cases: a null text counts as empty and encodes as begin and end ids only;
very long texts are encoded whole; repeated rows are encoded once each.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from . import textkit as tk

MARK = "▁"
_INTS = ArrayType(IntegerType())
_CHUNKS = re.compile(r" +[^ ]*")


def _fields(data: bytes):
    """(number, value) of every field of a protobuf message."""
    i = 0

    def varint(i):
        n = s = 0
        while True:
            n |= (data[i] & 127) << s
            s += 7
            i += 1
            if data[i - 1] < 128:
                return n, i

    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            v, i = data[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            v, i = data[i : i + n], i + n
        yield key >> 3, v


class CharMap:
    """A compiled character map: longest prefix of source bytes -> replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key at i, or None."""
        units, best = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for j in range(i, len(data)):
            node ^= data[j]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[j]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                at = units[node] & 0x7FFFFFFF
                best = j - i + 1, self.texts[at : self.texts.index(b"\0", at)]
        return best


class Encoder:
    def __init__(self, model: str, remember: int = 200_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        with open(model, "rb") as f:
            fields = list(_fields(f.read()))
        norm = dict(_fields(next((v for n, v in fields if n == 3), b"")))
        self.map = CharMap(norm.get(2, b""))
        self.dummy, self.squeeze, self.mark = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.length = np.array([1 if self.sp.is_byte(i) else 0 if self.sp.is_control(i) else len(p.encode()) for i, p in enumerate(pieces)])
        self.unknown = self.sp.unk_id()
        self.by_word = not self.map.units and self.dummy and not self.squeeze and self.mark and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.ends = [self.sp.bos_id()], [self.sp.eos_id()]
        self.known: dict[str, bytes] = {}
        self.remember = remember

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source offset at which each of them begins (one more: the end)."""
        mark = MARK.encode() if self.mark else b" "
        if not self.map.units and not self.squeeze:
            arr = np.frombuffer(text, np.uint8)
            size = np.where(arr == 32, len(mark), 1)
            at = np.repeat(np.arange(len(arr)), size)
            lead = len(mark) if self.dummy and text else 0
            return (mark if lead else b"") + text.replace(b" ", mark), np.concatenate((np.zeros(lead, int), at, [len(arr)]))
        out, at, i = bytearray(), [], 0
        while i < len(text):
            used, new = self.map.longest(text, i) or (0, b"")
            if not used:
                used = next((k for k in range(1, 5) if i + k >= len(text) or text[i + k] & 0xC0 != 0x80), 1)
                new = text[i : i + used]
            for k, c in enumerate(new):
                out.append(c)
                at.append(i + min(k, used - 1) if len(new) == used else i)
            i += used
        at.append(len(text))
        pairs = list(zip(bytes(out), at, strict=False))
        if self.squeeze:
            kept, space = [], True
            for c, a in pairs:
                if c == 32 and space:
                    continue
                kept.append((c, a))
                space = c == 32
            while kept and kept[-1][0] == 32:
                kept.pop()
            pairs = kept
        if self.dummy and pairs:
            pairs = [(32, pairs[0][1]), *pairs]
        norm, where = bytearray(), []
        for c, a in pairs:
            new = mark if c == 32 else bytes([c])
            norm += new
            where += [a] * len(new)
        return bytes(norm), np.array([*where, len(text)])

    def _learn(self, chunks: set[str]) -> None:
        """Puts the words of ``chunks`` into the table, in one call of the library."""
        new = list(chunks - self.known.keys())
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
            new = list(chunks)
        # the library gives an empty text no mark, so a lone last space is looked up
        found = [[self.sp.piece_to_id(MARK)] if c == " " else g for c, g in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1), strict=True)]
        flat = np.fromiter(itertools.chain.from_iterable(found), "<u4").tobytes()
        ends = itertools.accumulate((4 * len(g) for g in found), initial=0)
        self.known.update((c, flat[i:j]) for c, (i, j) in zip(new, itertools.pairwise(ends), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Begin id, ids and end id of each text, as little-endian 32-bit integers."""
        plain = [_CHUNKS.findall(" " + t) if t and self.by_word and MARK not in t else None for t in texts]
        self._learn({c for p in plain if p for c in p})
        begin, end = (np.array(x, "<u4").tobytes() for x in self.ends)
        out = []
        for t, p in zip(texts, plain, strict=True):
            body = b"".join(map(self.known.__getitem__, p)) if p else np.array(self.sp.encode(t), "<u4").tobytes()
            out.append(begin + body + end)
        return out

    def spans(self, text: bytes, ids: np.ndarray) -> np.ndarray:
        """Start and end source byte of every id; begin and end ids get empty spans.

        An unknown piece (possible only without byte fallback) takes what its
        neighbours leave; there the library's own surface offsets are used.
        """
        norm, where = self.normalise(text)
        size = self.length[ids]
        if (ids[1:-1] == self.unknown).any():
            got = self.sp.encode(text.decode("utf-8", "replace"), out_type="immutable_proto")
            marks = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text.decode("utf-8", "replace")])))
            inner = [(marks[p.begin], marks[p.end]) for p in got.pieces]
            return np.array([(0, 0), *inner, (len(text), len(text))])
        stop = np.cumsum(size)
        assert stop[-1] == len(norm), "pieces do not cover the normalised text"
        return np.stack((where[stop - size], where[stop]), 1)

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    """One per worker process."""
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def encode_documents(docs: DataFrame, model: str, columns: list[str], spans: bool = True) -> DataFrame:
    """The named columns with ``ids`` and, if asked for, ``starts`` and ``ends`` (source bytes of each id)."""

    def task(batches):
        e = encoder(model)
        for b, texts in tk.parts(batches, most=500_000):
            ids = [np.frombuffer(x, "<u4") for x in e.ids([t.decode("utf-8", "replace") for t in texts])]
            out = [b.column(b.schema.get_field_index(c)) for c in columns] + [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
            names = [*columns, "ids"]
            if spans:
                found = [e.spans(t, x) for t, x in zip(texts, ids, strict=True)]
                out += [pa.array([s[:, k].astype(np.int32) for s in found], pa.list_(pa.int32())) for k in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = docs.select(*columns).schema.add("ids", _INTS)
    if spans:
        schema = schema.add("starts", _INTS).add("ends", _INTS)
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(task, schema)


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """Digests of ids and of the decoded text, and how many source bytes the pieces cover; one narrow map."""

    def task(batches):
        e = encoder(model)
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        for b, texts in tk.parts(batches, most=500_000):
            rows: list[list] = [[], [], [], []]
            for t, ids in zip(texts, e.ids([t.decode("utf-8", "replace") for t in texts]), strict=True):
                s = e.spans(t, np.frombuffer(ids, "<u4"))
                for r, v in zip(rows, (len(ids) // 4, hexed(ids), hexed(e.decode(ids).encode()), int((s[:, 1] - s[:, 0]).sum())), strict=True):
                    r.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("covered_bytes", "long")
    return docs.select("doc_id", "text").mapInArrow(task, schema)

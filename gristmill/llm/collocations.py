"""Phrase collocation mining with vertical positional inverted lists.

Texts are read once into chunks: the words of some megabytes of one language as
numbers of the chunk's own vocabulary, with marks where pieces end. A phrase's list
is the sorted places of its occurrences in a chunk, and the lengths of its lists
add up to its exact frequency. Phrases grow a word at a time: in each chunk the
places of frequent phrases are merge-joined with the places one further, where
another frequent phrase (its last words and the adjacent one) must begin. What is
left makes one (phrase, length) row a chunk, whatever the length; these are added
up before and after one shuffle, the only one of a step.

A chunk knows the frequent phrases by a Bloom filter of at most FILTER_BYTES, the
one thing that is broadcast. A false hit adds rows of phrases that then turn out
rare; beyond the filter's size there are more of them. No frequent phrase is ever
missed, and of a phrase either all lists are counted or none, so frequencies are exact.

Candidates are read back from the chunk of their first list for words and the
hashes of their parts. A longer candidate with all occurrences of a shorter one
makes every phrase between them as frequent, so containment is tested against
phrases of one word more. Scores are whole numbers of up to 38 digits. The first
``top`` of a language are taken from the first ``top`` of each of its buckets.

Phrases are told apart by 64-bit hashes of language and words.

Edge cases: null text is empty; null language is ``und``, as is a language of that
name; texts without words and an empty table give no rows; repeated rows count each
time; a very long text is one chunk with all its words; null and repeated doc_ids do not matter; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk
from .store import Scratch

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bytes of text of a chunk, all its languages together.
CHUNK = 4_000_000
#: Most bytes of a filter of frequent phrases; 16 bits a phrase up to that.
FILTER_BYTES = 1 << 25
#: Buckets of a language in which its first candidates are sought.
BUCKETS = 64
_CUTS = np.zeros(256, bool)
_CUTS[[*range(0x0A, 0x0E), *b".,;:!?"]] = True
_BETWEEN = _CUTS.copy()
_BETWEEN[[0x20, 0x09]] = True
_STEP = tk.U(0xC2B2AE3D27D4EB4F)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(hashes, begins, known, words): each word's hash and whether a piece begins with it; the distinct hashes and their words."""
    buf = (b"\n".join(texts) + b"\n").lower()
    arr = np.frombuffer(buf, np.uint8)
    edge = np.flatnonzero(np.diff(~_BETWEEN[arr], prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    hashes = tk.span_hashes(tk._BYTE[arr], starts, ends)
    known, at = np.unique(hashes, return_index=True)
    piece = np.cumsum(_CUTS[arr], dtype=np.int32)[starts]
    begins = np.ones(len(piece), bool)
    begins[1:] = piece[1:] != piece[:-1]
    return hashes, begins, known, [buf[a:z] for a, z in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]


def numbered(parts: list[tuple]) -> tuple[int, bytes, bytes]:
    """(number of words, stream, vocabulary) of what ``words_of`` gave for the parts of a chunk.

    The stream has twice the number of each word, plus 1 where a piece begins, byte
    by byte of significance; frequent words have small numbers, so it packs well.
    The vocabulary has the words by number, one a line.
    """
    hashes, begins = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    known, number, count = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first, at = np.unique(np.concatenate([p[2] for p in parts]), return_index=True)
    words = [w for p in parts for w in p[3]]
    assert np.array_equal(first, known)
    coded = (2 * place[number] + begins).astype("<u4")
    return len(hashes), coded.view(np.uint8).reshape(-1, 4).T.tobytes(), b"\n".join(words[i] for i in at[order].tolist())


class Chunk:
    """The words of a chunk: hashes within their language, and the piece of each."""

    def __init__(self, lang: str, stream: bytes, words: bytes):
        coded = np.frombuffer(stream, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        self.number, self.piece = coded >> 1, np.cumsum(coded & 1)
        self.hashes = tk.mix(tk.Words([words], lower=False).hashes ^ tk.U(xxhash.xxh64_intdigest(lang)))[self.number]

    def phrases(self, k: int) -> np.ndarray:
        """The hash of the k words from each place on."""
        n = max(len(self.hashes) - k + 1, 0)
        g = np.zeros(n, tk.U)
        for i in range(k):
            g = g * _STEP + self.hashes[i : i + n]
        return tk.mix(g)

    def within(self, places: np.ndarray, k: int) -> np.ndarray:
        """The places whose k words are in one piece."""
        places = places[places + k <= len(self.piece)]
        return places[self.piece[places] == self.piece[places + k - 1]]

    def lists(self, k: int, frequent: Filter | None) -> np.ndarray:
        """Places, ascending, of phrases of k words of which the first and the last k - 1 are in ``frequent`` (k = 1: all)."""
        if k == 1:
            return np.arange(len(self.hashes))
        places = self.within(np.flatnonzero(frequent.has(self.phrases(k - 1))), k - 1)
        # the merge-join with the lists one place further: ascending places that are neighbours
        return self.within(places[:-1][np.diff(places) == 1], k)


class Filter:
    """A Bloom filter of 64-bit hashes: four bits of one 64-bit word for each."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, h: np.ndarray) -> np.ndarray:
        one, bits = tk.U(1), np.zeros(len(h), tk.U)
        for shift in (0, 6, 12, 18):
            bits |= one << (h >> tk.U(shift) & tk.U(63))
        return self.words[(h >> tk.U(24)) & tk.U(len(self.words) - 1)] & bits == bits

    @classmethod
    def of(cls, phrases: DataFrame) -> Filter:
        """Made by Spark, a row for each word of the filter; its size is a power of 2."""
        size = 1
        n = phrases.count()
        while size * 4 < n and size * 16 <= FILTER_BYTES:
            size *= 2
        bits = None
        for shift in (0, 6, 12, 18):
            bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(phrase, {shift}) & 63L as int))")
            bits = bit if bits is None else bits.bitwiseOR(bit)
        rows = phrases.select(F.expr(f"shiftrightunsigned(phrase, 24) & {size - 1}L").alias("at"), bits.alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(size, tk.U)
        words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(tk.U)
        return cls(words)


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, lang, n, stream, words); ``n`` counts the words."""
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("stream", pa.binary()), ("words", pa.binary())])

    def task(batches):
        held: dict[str, list[tuple]] = {}
        size, number = 0, TaskContext.get().partitionId() << 32
        for b, texts in tk.parts(batches):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), texts, strict=True):
                by.setdefault(lang, []).append(text)
                size += len(text)
            for lang, some in by.items():
                held.setdefault(lang, []).append(words_of(some))
            if size >= CHUNK:
                yield from made(held, number)
                number += len(held)
                held, size = {}, 0
        yield from made(held, number)

    def made(held, number):
        for i, lang in enumerate(sorted(held)):
            n, stream, words = numbered(held[lang])
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number + i, lang, n, stream, words), schema.types, strict=True)], schema=schema)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(task, "chunk long, lang string, n long, stream binary, words binary")


def occurrences(words: DataFrame, k: int, frequent: DataFrame | None) -> DataFrame:
    """(phrase, chunk, n) of phrases of k words: the length of the list; ``frequent`` has the phrases of k - 1 words."""
    schema = pa.schema([("phrase", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64())])
    known = words.sparkSession.sparkContext.broadcast(None if frequent is None else Filter.of(frequent))

    def task(batches):
        for b in batches:
            for i in range(b.num_rows):
                chunk, lang, stream, text = (b.column(j)[i].as_py() for j in range(4))
                c = Chunk(lang, stream, text)
                phrase, n = np.unique(c.phrases(k)[c.lists(k, known.value)], return_counts=True)
                for at in range(0, len(phrase), 100_000):
                    s = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((phrase[s].view(np.int64), np.full(len(phrase[s]), chunk), n[s]), schema.types, strict=True)], schema=schema)

    return words.select("chunk", "lang", "stream", "words").mapInArrow(task, "phrase long, chunk long, n long")


def frequent_phrases(words: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """For each length (phrase, f, chunk): the phrases with f >= least occurrences and the first chunk that holds one."""
    found: list[DataFrame] = []
    for k in range(1, longest + 1):
        rows = occurrences(words, k, found[-1] if found else None)
        total = rows.groupBy("phrase").agg(F.sum("n").alias("f"), F.min("chunk").alias("chunk")).filter(F.col("f") >= least)
        found.append(scratch.keep(total, f"frequent{k}"))
    return found


def candidates(words: DataFrame, found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, k, text, a, cuts) of frequent phrases of two words or more; ``cuts`` has the hashes of both parts for each first part."""
    each, longest = None, len(found)
    for k, rows in enumerate(found, 1):
        if k > 1:
            one = rows.select("chunk", F.struct(F.lit(k).alias("k"), "phrase", F.col("f").alias("a")).alias("p"))
            each = one if each is None else each.unionByName(one)
    asked = each.groupBy(F.col("chunk").alias("_c")).agg(F.collect_list("p").alias("asked"))  # at most the phrases of a chunk
    out = pa.schema(
        [("lang", pa.string()), ("phrase", pa.int64()), ("k", pa.int32()), ("text", pa.string()), ("a", pa.int64()), ("cuts", pa.list_(pa.struct([("cut", pa.int32()), ("left", pa.int64()), ("right", pa.int64())])))]
    )

    def task(batches):
        for b in batches:
            for i in range(b.num_rows):
                lang, stream, text, asked = (b.column(j)[i].as_py() for j in range(4))
                c, word = Chunk(lang, stream, text), text.split(b"\n")
                hashes = [None, *(c.phrases(k).view(np.int64) for k in range(1, longest + 1))]
                rows = []
                for k in range(2, longest + 1):
                    wanted = [(q["phrase"], q["a"]) for q in asked if q["k"] == k]
                    places = c.within(np.flatnonzero(np.isin(hashes[k], np.array([p for p, _ in wanted], np.int64))), k)
                    known, first = np.unique(hashes[k][places], return_index=True)
                    place = dict(zip(known.tolist(), places[first].tolist(), strict=True))
                    for phrase, a in wanted:
                        p = place[phrase]
                        cuts = [{"cut": x, "left": int(hashes[x][p]), "right": int(hashes[k - x][p + x])} for x in range(1, k)]
                        rows.append({"lang": lang, "phrase": phrase, "k": k, "text": b" ".join(word[x] for x in c.number[p : p + k]).decode(), "a": a, "cuts": cuts})
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    rows = words.select("chunk", "lang", "stream", "words").join(asked, F.col("chunk") == F.col("_c")).select("lang", "stream", "words", "asked")
    return rows.mapInArrow(task, "lang string, phrase long, k int, text string, a long, cuts array<struct<cut: int, left: bigint, right: bigint>>")


#: floor(1000 a n / (l r)), exact in 38 digits.
_SCORE = "cast(a as decimal(20,0)) * cast(n as decimal(18,0)) * 1000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``longest`` words of each language."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(chunks(docs), "chunks")
    found = frequent_phrases(words, scratch, least, longest)
    phrases = scratch.keep(candidates(words, found), "candidates")
    # phrases that one of a word more holds as often
    parts = phrases.filter("k > 2").select("a", F.explode(F.array(F.col("cuts")[F.col("k") - 2]["left"], F.col("cuts")[0]["right"])).alias("_p"))
    held = parts.groupBy("_p").agg(F.max("a").alias("_a"))
    open_ = phrases.join(held, phrases.phrase == F.col("_p"), "left").filter("_a is null or _a < a")
    times = None
    for rows in found[:-1]:
        one = rows.select("phrase", "f")
        times = one if times is None else times.unionByName(one)
    cut = open_.select("lang", "phrase", "text", "a", F.explode("cuts").alias("c")).select("lang", "phrase", "text", "a", "c.*")
    cut = cut.join(times.select(F.col("phrase").alias("_l"), F.col("f").alias("l")), F.col("left") == F.col("_l"))
    cut = cut.join(times.select(F.col("phrase").alias("_r"), F.col("f").alias("r")), F.col("right") == F.col("_r"))
    total = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"))
    scored = cut.join(total, F.col("lang") == F.col("_lang")).withColumn("score", F.expr(_SCORE))
    best = scored.groupBy("lang", "phrase", "text", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", F.col("phrase").alias("_h"), F.col("text").alias("phrase"), "a", "m.l", "m.r", "n", "m.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    near = best.withColumn("_b", F.pmod("_h", F.lit(BUCKETS))).withColumn("_i", F.row_number().over(W.partitionBy("lang", "_b").orderBy(*order))).filter(F.col("_i") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) r(k))),
f AS (SELECT lang, k, w, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
held AS (SELECT DISTINCT s.lang, s.w FROM f s JOIN f t ON t.lang = s.lang AND t.k = s.k + 1 AND t.f = s.f AND (t.w[1:s.k] = s.w OR t.w[2:] = s.w) WHERE s.k > 1),
c AS (SELECT f.lang, f.w, f.f AS a, unnest(range(1, k)) AS cut FROM f ANTI JOIN held ON held.lang = f.lang AND held.w = f.w WHERE k > 1),
s AS (SELECT c.lang, c.w, a, cut, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:cut] JOIN f y ON y.lang = c.lang AND y.w = c.w[cut + 1:] JOIN n ON n.lang = c.lang),
b AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000"""

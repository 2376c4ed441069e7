"""Archives: the reader fetches a file about once, and a payload that very many pages have gathers nowhere."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest
from gristmill.llm import warc
from gristmill.llm.store import Scratch


class _Counted:
    def __init__(self, data: bytes):
        self.data, self.fetched = data, 0

    def read_at(self, n: int, offset: int) -> bytes:
        got = self.data[offset : offset + n]
        self.fetched += len(got)
        return got


@pytest.mark.parametrize("kind", ["revisit", "response"])
def test_reader_fetches_a_file_about_once(kind):
    rng = random.Random(3)
    data = b"".join(gzip.compress(warc.record(kind, i, f"http://x/{i}", rng.randbytes(300), 7 if kind == "revisit" else None)) for i in range(3000))
    f = _Counted(data)
    assert sum(x[0] == "record" for x in warc.salvage(f, len(data))) == 3000
    assert len(data) > 2 * warc.STEP and f.fetched < 1.5 * len(data)


def test_members_across_windows():
    rng = random.Random(4)
    parts = [gzip.compress(warc.record("response", i, "u", rng.randbytes(rng.choice([10, 5000, 90_000, 400_000])))) for i in range(40)]
    data = bytearray(b"".join(parts))
    data[sum(map(len, parts[:20])) + len(parts[20]) // 2] ^= 0xFF
    out = list(warc.salvage(_Counted(bytes(data)), len(data)))
    assert [int(x[3]["warc-record-id"][10:-1]) for x in out if x[0] == "record"] == [i for i in range(40) if i != 20]
    assert [x[1:3] for x in out if x[0] == "gap"] == [(sum(map(len, parts[:20])), sum(map(len, parts[:21])))]


def test_a_revisit_needs_no_payload():
    p = b"<p>x</p>"
    assert warc.record("revisit", 1, "u", b"", 2, (len(p), warc.digest(p))) == warc.record("revisit", 1, "u", p, 2)
    assert warc.record("response", 1, "u", b"", None, (0, warc.digest(b""))) == warc.record("response", 1, "u", b"")


def test_a_common_payload_is_spread(spark, monkeypatch):
    monkeypatch.setattr(warc, "COMMON", 50)
    rows = [(i, "u", "same" if i % 2 else ("twice" if i in (10, 12) else f"p{i}")) for i in range(400)] + [(None, "u", "same"), (None, "n", None), (500, "n", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    last = {"same": 399, "twice": 12, "": 500}
    want = set()
    for i, _, html in rows:
        p = html or ""
        to = last.get(p, i)
        want.add((i, len(p), base64.b32encode(hashlib.sha1(p.encode()).digest()).decode(), "response" if i == to else "revisit", None if i == to else to))
    got = warc.op7(pages)
    assert got.count() == len(rows) and {tuple(r) for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = warc.with_types(pages, Scratch(spark)).filter("html = 'same'").rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(parts) == 201 and max(parts) < 60

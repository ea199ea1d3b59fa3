import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeloom.llm import warc as W
from quakeloom.llm.common import new_path


def records(n):
    return [W.page_record(i, "http://x/ \r\n" + "é" * (i % 3), bytes([i % 251]) * (i * 37 % 5000) + W.MAGIC * (i % 4), hashlib.sha1(b"").hexdigest(), None) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4000), st.integers(0, 12))
def test_every_record_is_owned_once(split, n):
    made = records(n)
    data = b"junk" * (n % 2) + b"".join(made)
    starts, at = [], 4 * (n % 2)
    for m in made:
        starts.append(at)
        at += len(m)
    got = [o for a in range(0, len(data), split) for o, _ in W.members(io.BytesIO(data), a, min(len(data), a + split), len(data))]
    assert got == starts


def test_magic_inside_stored_data_is_no_record():
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    inner = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = z.compress(b"WARC/1.0\r\nContent-Length: 40\r\n\r\n" + inner.compress(b"not a record") + inner.flush()) + z.flush()
    assert [o for a in range(0, len(data), 7) for o, _ in W.members(io.BytesIO(data), a, min(len(data), a + 7), len(data))] == [0]


def test_broken_record_raises():
    data = records(3)[2][:-9]
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(data), 0, len(data), len(data)))


def test_round_trip(spark):
    big, small = "x" * 1000, "y" * 999
    rows = [(1, "http://a", big), (5, None, big), (3, "u\nv", big), (4, "b", small), (6, "b", small), (7, "c", None), (None, "d", big), (8, "e", "é" * 500), (8, "e", "é" * 500), (9, "f", "é" * 500 + "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS type", "1 AS bytes")
    got = sorted(map(tuple, W.archive(df, new_path(spark, "t"), split=300).collect()), key=str)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, g in rows if (g or "").encode() == raw and q is not None]
        revisit = len(raw) >= 1000 and (p is None or p < max(same))
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)


def test_nothing(spark):
    assert W.archive(spark.createDataFrame([], "page_id long, url string, html string"), new_path(spark, "t")).count() == 0

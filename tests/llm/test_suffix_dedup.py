import hashlib
import random
import re
from collections import Counter

import pytest

from quakeloom.llm import suffix_dedup as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if n[r[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(r, cover, strict=True) if not y)
        out.append((len(r), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest(), kept))
    return out


def texts():
    r = random.Random(4)
    some = lambda n: "".join(r.choices("abcdefgh é", k=n))
    shared = [some(230), some(520), some(199)]
    out = [None, "", "short", "a" * 1000, "ab" * 300, some(3000)]
    for i in range(25):
        parts = [some(r.randrange(0, 400)), r.choice(shared), some(r.randrange(0, 90)), r.choice(shared)[: r.randrange(150, 520)]]
        out.append("".join(parts))
    out += [out[10], out[11] + "!", "?" + out[12], out[5][:1500] + "#" + out[5][1501:]]
    return out


@pytest.mark.parametrize("piece", [1 << 17, 700])
def test_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    t = texts()
    rows = [(i if i != 8 else 7, x) for i, x in enumerate(t)] + [(None, t[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ranges", "0 AS k")
    got = S.cut_repeats(df).collect()
    want = brute([x for _, x in rows], 200)
    assert sorted((str(g.doc_id), *tuple(g)[1:5], bytes(g.kept)) for g in got) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))


def test_texts_without_repeats(spark):
    t = texts()
    df = spark.createDataFrame([(i, x, len(x or "")) for i, x in enumerate(t)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in S.without_repeats(df).collect()}
    for i, w in enumerate(brute(t, 200)):
        left = w[4].decode("utf-8", "ignore")
        assert (out[i].text or "") == left and (t[i] is None) == (out[i].text is None)
        assert out[i].n_chars == len(left)


def test_empty(spark):
    assert S.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id_whose_texts_share_a_32_bit_hash_are_told_apart(spark):
    import hashlib

    from pyspark.sql import functions as F

    a, b = ("".join(hashlib.sha256(f"{i}-{n}".encode()).hexdigest() for i in range(4)) for n in (12894, 103908))
    df = spark.createDataFrame([(None, a), (None, b), (1, a)], "doc_id long, text string")
    assert df.select(F.hash("text")).distinct().count() == 1
    assert sorted((str(r.doc_id), r.n_removed) for r in S.cut_repeats(df).collect()) == [("1", 256), ("None", 0), ("None", 256)]
    assert sorted(len(r.text) for r in S.without_repeats(df).collect()) == [0, 0, 256]

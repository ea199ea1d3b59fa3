import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeloom.llm import packing as P


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in sorted(set(range(len(bins))), key=lambda j: bins[j]):
            if bins[j] >= items[i]:
                bins[j] -= items[i]
                go(i + 1, bins)
                bins[j] += items[i]
        bins.append(capacity - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def check_plan(plan, items, capacity):
    got = {}
    for filling, n in plan:
        assert n > 0 and sum(a * b for a, b in filling) <= capacity
        for a, b in filling:
            got[a] = got.get(a, 0) + b * n
    assert got == {x: items.count(x) for x in items}
    return sum(n for _, n in plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_cases_are_optimal_or_near(items):
    s, c = np.unique(items, return_counts=True)
    assert P.size_bound(s, c, 20) <= optimum(items, 20)
    check_plan(P.best_fit(s, c, 20), items, 20)
    plan, known = P.bin_completion(s, c, 20)
    assert known and check_plan(plan, items, 20) == optimum(items, 20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(8, 60), min_size=6, max_size=14))
def test_completed_search_is_optimal(items):
    s, c = np.unique(items, return_counts=True)
    plan, known = P.bin_completion(s, c, 100)
    assert known and check_plan(plan, items, 100) == optimum(items, 100)


def test_search_beats_best_fit():
    items = [59, 43, 15, 27, 39, 31, 37, 46, 11, 58, 32]
    s, c = np.unique(items, return_counts=True)
    plan, known = P.bin_completion(s, c, 100)
    assert known and check_plan(plan, items, 100) == 4 < check_plan(P.best_fit(s, c, 100), items, 100)
    plan, known = P.bin_completion(np.array([*s, 1000]), np.array([*c, 0]), 100, nodes=3)
    assert not known and check_plan(plan, items, 100) == 5


def test_large_histogram_meets_the_bound():
    g = np.random.default_rng(1)
    items = np.minimum(2048, g.lognormal(6, 1, 20000).astype(int) + 1)
    s, c = np.unique(items, return_counts=True)
    plan, known = P.bin_completion(s, c)
    assert known
    assert sum(n for _, n in plan) <= P.size_bound(s, c, 2048) + 2
    assert len(P.slots(plan)) < 40_000


def test_query_against_a_plain_run(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, "Hello  World\tagain\n<|endoftext|> it's 42 ÉÀ"), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (None, "x"), (6, "ΣΑΣ ας  x\x1cy"), (7, "a" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS piece", "1 AS length")
    out = P.pack(docs).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(-1 if i is None else i, k, a, len(p := ids[a : a + 2048]), zlib.crc32(p.tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = [tuple(map(int, r)) for r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).to_numpy()]
    assert sorted(got) == sorted(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *itertools.accumulate(g["length"])][:-1] and g["length"].sum() <= 2048


def test_ids_of_odd_texts():
    """Marks, ligatures, letters with a longer lower case and added tokens next to punctuation, by the whole tokenizer."""
    import random

    import public_tokenizers

    words = P._Words(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(2)
    parts = [*"abXYZsé Ñ  İıßΣσς'’\"!-.,0129\n\t\x0b\x0c\x85\u2028\u0338\u0301\u0307日한ﬁ가ÅÅ\x00|>≠ǅⅷ²½_*%", "\u1100\u1161", "'s", "'ll", "don't", "<|endoftext|>", "</w>"]
    texts = ["Bİ!", "İ-", "x" * 100, "don't.'s", *("".join(r.choices(parts, k=r.randrange(30))) for _ in range(6000))]
    got = [x for i in range(0, len(texts), 512) for x in P.token_bytes(words, texts[i : i + 512], b"")]
    assert got == [*map(words.ids, texts)]


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_ranks_are_gapless(spark, n):
    df = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "id % 3 AS length", "id AS ids_crc32")
    got = P.ranked(df, n).groupBy("length").agg({"rank": "max", "doc_id": "count"}).collect()
    assert all(r["max(rank)"] == r["count(doc_id)"] - 1 for r in got)

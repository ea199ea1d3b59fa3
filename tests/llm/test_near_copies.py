import random

import numpy as np
import pytest

from quakeloom.llm import near_copies as N


def kept_by_brute_force(data, least=0.8):
    sets = [set(N.shingle_set(t).tolist()) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, (k, _) in enumerate(data):
        groups.setdefault(find(i), set()).add(k)
    return sorted(min(g) for g in groups.values())


def kept(spark, data, **named):
    return sorted(r.doc_id for r in N.keep_one(spark.createDataFrame(data, "doc_id long, text string"), **named).collect())


@pytest.mark.parametrize("block,few", [(256, 48), (7, 2)])
def test_large_group_around_a_base_in_the_middle(spark, monkeypatch, block, few):
    """Copies that are near to the base alone: two groups of them that share a passage, and versions that drift."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "FEW", few)
    r = random.Random(3)
    texts = []
    common = [f"c{i}" for i in range(60)]
    for g in range(2):
        base = common + [f"w{g}_{i}" for i in range(300)]
        copies = []
        for n in range(120):
            w = list(base)
            for i in r.sample(range(60, len(w), 6), 7):
                w[i] = f"e{g}_{n}_{i}"
            copies.append(" ".join(w))
        texts += [*copies[:60], " ".join(base), *copies[60:]]
    drift = [f"d{i}" for i in range(200)]
    for n in range(40):
        drift = drift[5:] + [f"d{200 + 5 * n + i}" for i in range(5)]
        texts.append(" ".join(drift))
    order = list(range(len(texts)))
    r.shuffle(order)
    data = [(i, texts[i]) for i in order]
    want = kept_by_brute_force(sorted(data))
    assert len(want) < 10 and kept(spark, data) == want


@pytest.mark.parametrize("repeats", [1, 4])
def test_blocks_appended_cut_off_and_put_in(spark, repeats):
    data = []
    for g in range(60):
        n = 100 + 20 * g
        base = [f"b{g}_{i % (n // repeats)}_{i // (n // repeats) if i % 7 == 0 else 0}" for i in range(n)]
        shingles = len(N.shingle_set(" ".join(base)))
        new = [f"n{g}_{i}" for i in range(shingles // 4 - 4 - g % 3)]
        for w in (base, base + new, base[: n // 2] + new + base[n // 2 :], base[: len(base) - n // 6]):
            data.append((len(data), " ".join(w)))
    want = kept_by_brute_force(data)
    assert len(want) < len(data) / 2 and kept(spark, data) == want


@pytest.mark.parametrize("block,few", [(256, 48), (8, 2)])
def test_group_at_the_threshold(spark, monkeypatch, block, few):
    """Copies of a base that is not there, with similarities on both sides of the threshold, and texts that share a passage."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "FEW", few)
    r = random.Random(5)
    base, texts = [f"w{i}" for i in range(120)], []
    for n in range(150):
        w = list(base)
        for i in r.sample(range(len(w)), r.choice([1, 2, 2, 3])):
            w[i] = f"e{n}_{i}"
        texts.append(" ".join(w))
    for n in range(60):
        texts.append(" ".join([f"u{n}_{i}" for i in range(n % 9)] + [f"p{i}" for i in range(40)]))
    r.shuffle(texts)
    data = list(enumerate(texts))
    want = kept_by_brute_force(data)
    assert 1 < len(want) < len(data) and kept(spark, data) == want


def test_prefixes_and_parities_lose_nothing(spark):
    r = random.Random(4)
    for n in range(1, 60):
        for m in range(n, int(n / 0.8) + 1):
            both = -(-4 * (n + m) // 9)  # the least overlap of sets of n and m elements at 0.8
            if both <= n:
                assert n - both < N.short_length(n, 0.8) and m - both < N.prefix_length(m, 0.8)
    for n in (*range(1, 40), 97, 1000):
        for least in (0.5, 0.8, 1.0):
            assert n - N.prefix_length(n, least) < least * n <= n - N.prefix_length(n, least) + 1 + 1e-9
    a = {r.getrandbits(63) for _ in range(500)}
    b = set(r.sample(sorted(a), 400)) | {r.getrandbits(63) for _ in range(70)}
    x, y = (N.parities(np.array(sorted(s), np.int64)).tolist() for s in (a, b))
    assert 0 < sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) <= len(a ^ b)


def test_words_of_any_script_and_length(spark):
    r = random.Random(1)
    alphabet = "abé İß_9 .,\n\tσΣ日本 ١"
    texts = ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(1000)]
    texts.append(" ".join("".join(r.choices("abc", k=r.randrange(1, 9))) for _ in range(100_000)))  # several chunks
    seen = {}
    for t in texts:
        w, h = N.WORD.findall(t.lower()), N.word_hashes(t).tolist()
        assert len(w) == len(h) and all(seen.setdefault(x, y) == y for x, y in zip(w, h, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_clashing_columns_and_empty_table(spark):
    data = [(1, "a b c d e f", 1, 2, "x"), (2, "a b c d e f", 3, 4, "y"), (None, None, None, None, None), (3, "?", 5, 6, "z"), (4, "other words than those", 7, 8, "w"), (4, "other words than those", 7, 8, "w")]
    df = spark.createDataFrame(data, "doc_id long, text string, k long, own long, tid string").selectExpr("*", "k AS doc", "own AS first", "k AS _k", "tid AS _tid", "k AS stays", "k AS n")
    out = N.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.k) for r in out.collect() if r.doc_id) == [(1, 1), (4, 7)] and out.count() == 3
    assert N.keep_one(df.limit(0)).count() == 0

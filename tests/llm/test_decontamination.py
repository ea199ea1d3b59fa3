import random
from collections import Counter

import numpy as np

from quakeloom.llm import decontamination as D

R = random.Random(3)
VOCAB = [f"w{i}" for i in range(400)]
ITEMS = [(i, " ".join(R.choices(VOCAB, k=n))) for i, n in enumerate([40, 25, 12, 60, 5, 3, 33, 33])]


def brute(text, items, least):
    w, out = D.words(text), []
    for i, t in items:
        v = D.words(t)
        if not v or not w:
            continue
        k, n = min(5, len(v)), min(len(v), len(w))
        item = Counter(D.shingles(v, k))
        got = [(D.similarity(Counter(D.shingles(w[a : a + n], k)), item) if n >= k else 0, -a) for a in range(len(w) - n + 1)]
        if got and max(got)[0] >= least:
            s, a = max(got)
            out.append((i, -a, n, round(s, 9)))
    return sorted(out)


def texts():
    yield None
    yield ""
    for i, t in ITEMS:
        w = t.split()
        filler = R.choices(VOCAB, k=R.randrange(200))
        yield " ".join(filler + w + filler)
        yield " ".join([*filler, *w[: len(w) // 2], "odd", *w[len(w) // 2 :], *filler])
        yield " ".join([*filler, *w[1:], *filler]).upper().replace(" ", ", ")
        yield t + "\n" + t
        yield " ".join(w[:-1])
    yield " ".join(R.choices(VOCAB, k=3000))


def test_matches_against_brute_force():
    index = D.Index(ITEMS)
    for text in texts():
        got = sorted((m[0], m[1], m[2], round(m[4], 9)) for m in index.matches(text))
        assert got == brute(text, ITEMS, 0.8), text


def test_blocks_find_all_within_radius():
    index = D.Index(ITEMS)
    g = np.random.default_rng(0)
    for i, p in enumerate(index.prints):
        for n in (0, 1, 9, 17):
            flips = g.choice(64, n, replace=False)
            q = np.uint64(int(p) ^ sum(1 << int(b) for b in flips))
            assert (0, i, n) in index.within(np.array([q]))


def test_tables(spark):
    rows = [(n, t, "x") for n, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, rows[2], (None, ITEMS[0][1], "y")], "doc_id long, text string, similarity string")
    items = spark.createDataFrame([*ITEMS, (None, "a b"), (99, None), (98, "!")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in D.find(docs, items).collect())
    want = sorted((n, *m) for n, t, _ in rows for m in brute(t, ITEMS, 0.8))
    assert got == want
    kept = D.remove(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {n for n, *_ in rows} - {w[0] for w in want}
    assert D.find(docs.limit(0), items).count() == 0 and D.find(docs, items.limit(0)).count() == 0


def test_item_blocks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [len(b) for b in D.item_blocks(items, 3)] == [3, 3, 2]

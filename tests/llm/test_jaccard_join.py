import random

import numpy as np
import pytest

from quakeloom.llm import jaccard_join as J


def plain_set(text, k=4):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({b" ".join(w)} if w else set())


def plain(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    least = [i for i, _ in rows]
    low = lambda a, b: b if a is None else a if b is None else min(a, b)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = low(least[i], least[j])
            changed |= (least[i], least[j]) != (m, m)
            least[i] = least[j] = m
    return sorted(((i, len(s), m) for (i, _), s, m in zip(rows, sets, least, strict=True)), key=str)


def edited(r, words, n, tag):
    w = list(words)
    for at in r.sample(range(len(w)), n):
        w[at] = f"{tag}{at}"
    return w


def made(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: r.choices(words, k=n)
    rows = []
    base = text(200)
    for i in range(90):  # copies near a base in the middle, not near one another
        rows.append(edited(r, base, 0 if i == 45 else r.randrange(1, 5), f"x{i}_"))
    drift = text(120)
    for i in range(40):  # versions that drift
        rows.append(list(drift))
        at = r.randrange(0, 117)
        drift[at : at + 2] = text(2)
    passage = text(60)
    for _ in range(60):  # a common passage
        n = r.randrange(0, 30)
        rows.append(text(n) + passage + text(r.randrange(0, 30)))
    for n in (1, 2, 3, 4, 5, 20, 300):
        t = text(n)
        rows += [t, t, t + text(1), t[1:]]
    for _ in range(6):  # near the limit, by a tail
        t = text(100)
        rows += [t, t + text(16), t + text(17), t + text(18)]
    out = [(1000 + i, " ".join(t)) for i, t in enumerate(rows)]
    r.shuffle(out)
    out += [(5, None), (6, ""), (7, " \t\n"), (None, "w1 w2 w3 w4 w5"), (8, "W1\tw2  w3\nw4 w5"), (None, None), (9, out[0][1]), (9, out[0][1]), (10, "éÉ É"), (11, "éÉ é")]
    return out


@pytest.mark.parametrize("block,rounds,listed", [(256, 2, 1 << 18), (5, 1, 3)])
def test_against_brute_force(spark, monkeypatch, block, rounds, listed):
    rows = made(block)
    for name, x in (("BLOCK", block), ("ROUNDS", rounds), ("LISTED", listed)):
        monkeypatch.setattr(J, name, x)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tid", "2 AS n", "3 AS own")
    got = [tuple(x) for x in J.jaccard_components(docs).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_nothing_near_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(docs).collect())) == [(1, 2, 1), (2, 2, 2), (3, 0, 3)]
    assert J.jaccard_components(docs.limit(0)).count() == 0


def test_required_occurrences_are_those_of_near_sets():
    r = random.Random(4)
    seen = 0
    for _ in range(3000):
        n = r.randrange(1, 60)
        a = set(r.sample(range(80), n))
        b = set(a)
        for x in r.sample(sorted(a), r.randrange(0, 1 + n // 6)):
            b.discard(x)
        b |= set(r.sample(range(80), r.randrange(0, 1 + n // 6)))
        if b and 100 * len(a & b) >= 85 * len(a | b):
            first = [set(sorted(s)[: J.indexed(len(s), 85)]) for s in (a, b)]
            assert len(first[0] & first[1]) >= J.occurrences(len(a), np.array([len(b)]), 85)[0] >= 1
            seen += 1
    assert seen > 500


def test_search_by_heap_and_probes_counts_all_lists():
    r = random.Random(5)
    cs = [r.sample(range(40), r.randrange(1, 25)) for _ in range(80)]
    weight = {c: r.randrange(1, 4) for c in range(40)}
    ws = [[weight[c] for c in x] for x in cs]
    block = J.Block([np.array(x) for x in cs], [np.array(x) for x in ws])
    for i in range(80):
        for least in (1, 4, 9, 20):
            need = np.array([least + r.randrange(3) for _ in range(80)])
            want = [j for j in range(80) if sum(weight[c] for c in set(cs[i]) & set(cs[j])) >= need[j]]
            assert list(block.search(cs[i], ws[i], need)) == want


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"Wé{i % 997}" for i in range(5000)) + "x" * 500 + " end"
    whole = J.gram_set(text)
    assert len(whole) == len(plain_set(text))
    monkeypatch.setattr(J, "CHUNK", 64)
    assert np.array_equal(J.gram_set(text), whole)

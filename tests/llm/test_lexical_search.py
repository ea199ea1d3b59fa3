import math
import random
import re

from quakeloom.llm import lexical_search as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    """Every document scored for every item."""
    parsed = [(i, terms(t)) for i, t in docs]
    parsed = [(i, t) for i, t in parsed if t]
    n, length = len(parsed), sum(len(t) for _, t in parsed)
    df = {}
    for _, t in parsed:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc_id, t in parsed:
            m = 75 + 25 * len(t) * n // length
            s = 0
            for x in terms(text):
                if tf := t.count(x):
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if s:
                found.append((-s, (doc_id is not None, doc_id or 0), doc_id))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def made(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Éa", "ÉA", "x_y", "a-b", "日本"]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, odds, k=r.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(30)]  # ties
    docs += [(5, docs[5][1]), (None, docs[7][1]), (None, None), (n + 50, None), (n + 51, ""), (n + 52, " .,- ")]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 12)))) for i in range(12)] + [(1, "W1 w1 w1 w2"), (3, None), (4, ""), (None, "w3"), (6, "unseen words")]
    items += [items[2], (20, docs[3][1])]
    return docs, items


def test_against_brute_force_over_slices_blocks_and_owners(spark, monkeypatch):
    docs, items = made(1, 150)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS uid", "2 AS n", "3 AS slice")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS ikey", "2 AS term")
    monkeypatch.setattr(L, "ITEMS", 5)
    for top, owners, per_slice in ((5, 4, 20), (3, 1, 1000), (40, 3, 7)):
        got = [tuple(r) for r in L.search(d, i, top, owners, per_slice).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=str) == plain(docs, items, top)


def test_empty_tables(spark):
    docs, items = made(2, 5)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (d.filter("text IS NULL"), i)):
        out = L.search(x, y)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert out.count() == 0


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}-Éx{i % 7}" for i in range(5000)) + "tail" * 200
    whole = L.term_counts(text)
    assert whole == {t.encode(): terms(text).count(t) for t in set(terms(text))}
    monkeypatch.setattr(L, "CHUNK", 64)
    assert L.term_counts(text) == whole

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quakeloom.llm import lm_scoring as L


def symbols(text):
    b = bytes(L.DEPTH) + (text or "").encode().lower() + b"\0"
    return [(b[i - L.DEPTH : i], b[i]) for i in range(L.DEPTH, len(b))]


def plain(train, texts):
    """Context-tree weighting by recursion over dictionaries."""
    n = defaultdict(lambda: [0, 0])
    for t in train:
        for ctx, s in symbols(t):
            for k in range(8):
                z, bit = (1 << k) | (s >> (8 - k)), s >> (7 - k) & 1
                for d in range(L.DEPTH + 1):
                    n[ctx[L.DEPTH - d :], z][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
    below = defaultdict(float)
    pw = {}
    for d in range(L.DEPTH, -1, -1):
        for (ctx, z), c in list(n.items()):
            if len(ctx) == d:
                e = kt(*c)
                if d < L.DEPTH:
                    o = below[ctx, z]
                    pw[ctx, z] = max(e, o) + math.log1p(math.exp(-abs(e - o))) - math.log(2)
                else:
                    pw[ctx, z] = e
                if d:
                    below[ctx[1:], z] += pw[ctx, z]

    def one(ctx, z):
        """Probability of a one, from the root to the deepest context seen."""
        p, rest = 0.5, 1.0
        out = 0.0
        for d in range(L.DEPTH + 1):
            key = ctx[L.DEPTH - d :], z
            if key not in n:
                break
            a, b = n[key]
            p = (b + 0.5) / (a + b + 1)
            last = d == L.DEPTH or (ctx[L.DEPTH - d - 1 :], z) not in n
            w = 1.0 if last else math.exp(kt(a, b) - math.log(2) - pw[key])
            out += rest * w * p
            rest *= 1 - w
        return out if (b"", z) in n else 0.5

    score = []
    for t in texts:
        total = 0.0
        for ctx, s in symbols(t):
            for k in range(8):
                p = one(ctx, (1 << k) | (s >> (8 - k)))
                total += math.log10(p if s >> (7 - k) & 1 else 1 - p)
        score.append(total)
    return score


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_against_brute_force(spark):
    r = random.Random(7)
    words = ["The", "cat", "sat", "É", "mat", "on", "日本", "a"]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "new zebra\x00\n\twords"), (63, "The\x1ccat"), (None, "the cat"), (5, "the cat sat"), (5, "the cat sat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS batch", "2 AS train")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    got = L.score(df, fold == 2, batch_bytes=200).collect()
    train = [t for i, t in rows if not held(i)]
    tokens = Counter(w for t in train for w in [*(t or "").encode().lower().split(), None])
    total, distinct = sum(tokens.values()), len(tokens)
    scores = plain(train, [t for _, t in rows])
    want = []
    for (i, t), s in zip(rows, scores, strict=True):
        w = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((tokens[x] + 1) / (total + distinct + 1)) for x in w)
        want.append((str(i), held(i), len(w), sum(tokens[x] > 0 for x in w), total, round(base, 6), round(s, 5)))
    assert sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), round(g.score, 5)) for g in got) == sorted(want)


def test_probabilities_of_a_symbol_sum_to_one(spark):
    text = "abracadabra"
    grams = L.grams([b"abracadabra"])[0]
    keys = {int(g) >> 8 << 8 | b for g in grams for b in range(256)}
    seen = Counter(map(int, grams))
    df = spark.createDataFrame([(k, seen.get(k, 0)) for k in keys], "key long, n long")
    p = {r.key: 10**r.value for r in L.gram_scores(df).collect()}
    for ctx in {k >> 8 for k in keys}:
        assert sum(p[ctx << 8 | b] for b in range(256)) == pytest.approx(1)
    assert len(text) + 1 == len(grams)


def test_no_training_text_and_no_rows(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    r = L.score(df, F.lit(True)).first()
    assert r.score == pytest.approx(-32 * math.log10(2)) and r.n_known == 0 and r.base_score == 0
    assert L.score(df.limit(0), F.lit(False)).count() == 0

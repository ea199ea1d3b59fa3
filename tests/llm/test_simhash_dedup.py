import random

import xxhash
from pyspark.sql import functions as F

from quakeloom.llm import simhash_dedup as S


def plain(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """Brute force: smallest id reachable over links of two or fewer bits."""
    least = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_hash_is_sparks_own(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("a b é", 42)


def test_components_against_brute_force(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(1, 80)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail" * (i % 2)) for i in range(20)]
    long = r.choices(words, k=3000)
    for i in range(12):
        w = list(long)
        w[i * 200] = f"x{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "one two"), (5, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS n")
    got = S.simhash_components(docs).collect()
    assert sorted((g.doc_id, g.fingerprint) for g in got) == sorted((i, f"{plain(t):016x}") for i, t in rows)
    least = groups([(n, plain(t)) for n, (_, t) in enumerate(rows)])
    ids = {}
    for n, (i, t) in enumerate(rows):
        ids.setdefault(least[n], []).append(i)
    want = sorted((i, f"{plain(t):016x}", min(ids[least[n]])) for n, (i, t) in enumerate(rows))
    assert sorted(tuple(g) for g in got) == want
    assert S.simhash_components(docs.limit(0)).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_pairs_are_complete_within_two_bits_in_small_and_large_buckets(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(5)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 1, 2, 2, 2, 3, 4, 6) for _ in range(6)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    want = groups([(p, p) for p in map(signed, prints)] and [(signed(p), p) for p in prints])
    for bucket in (64, 3):
        edges = S.close_pairs(df, bucket=bucket)
        roots = {x.node: x.root for x in S.components(edges).collect()}
        for p in map(signed, prints):
            assert roots.get(p, p) == want[p]


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "CHUNK", 64)
    assert S.fingerprint(text) == whole == plain(text)

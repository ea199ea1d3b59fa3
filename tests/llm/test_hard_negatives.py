import math
import random

import numpy as np
from pyspark.sql import functions as F

from quakeloom.llm import hard_negatives as H


def plain(rows, positives=5, negatives=3):
    """Every anchor against every row."""
    ok = [(u, i, y, [math.floor(256 * float(v)) for v in x]) for u, (i, x, y) in enumerate(rows) if i is not None and y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for u, i, y, q in ok:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p, strict=False)), j, v, z) for v, j, z, p in ok if v != u]
        for s, pos, *_ in sorted(x for x in scored if x[3] == y)[:positives]:
            found = sorted(x for x in scored if x[3] != y and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
            out += [(i, pos, r + 1, neg, -s, -t) for r, (t, neg, *_) in enumerate(found)]
    return sorted(out)


def made(seed, n, dims=9):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [c + r.gauss(0, 0.15) for c in centres[i % 4]], (i % 4 if r.random() < 0.8 else r.randrange(4))) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 3) for i in range(60)]  # one common vector
    rows += [(50, rows[51][1], 1), (n + 90, None, 1), (n + 91, rows[1][1], None), (None, rows[1][1], 1), (n + 92, [None] * dims, 1), (n + 93, [math.nan] * dims, 1), (n + 94, [math.inf] * dims, 1)]
    rows += [(n + 95, [], 1), (n + 96, [0.5, 0.5], 2), (1000, rows[1][1], 7)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_against_brute_force_over_shards_and_blocks(spark, monkeypatch):
    rows = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x], y) for i, x, y in made(1, 400)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS uid", "2 AS shard", "3 AS q")
    monkeypatch.setattr(H, "BATCH", 8)
    monkeypatch.setattr(H, "ANCHORS", 3)
    for codes, per_shard in ((5, 100), (2, 10_000), (12, 37)):
        got = H.mine(df, F.col("vec_id") % 50 == 0, codes=codes, per_shard=per_shard)
        assert sorted(map(tuple, got.collect())) == plain(rows)


def test_empty_tables_and_no_anchors(spark):
    df = spark.createDataFrame(made(2, 20), SCHEMA)
    assert H.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert H.mine(df, F.col("vec_id") == 19_000).count() == 0


def test_cells_come_by_falling_bounds_once_each_and_stop_early(monkeypatch):
    import pandas as pd

    r = np.random.default_rng(3)
    x = np.floor(256 * (r.normal(0, 0.05, (3000, 16)) + r.normal(0, 0.4, (10, 16))[np.arange(3000) % 10])).astype(np.int64)
    rows = pd.DataFrame({"uid": np.arange(3000), "vec_id": np.arange(3000), "label": np.arange(3000) % 10, "q": list(x)})
    index = H.MultiIndex(rows, (H.codebook(x[:, :8], 12), H.codebook(x[:, 8:], 12)))
    cells = list(index.cells(x[0]))
    assert sorted(a for a, *_ in cells) == sorted({a for a, *_ in cells})
    assert sum(b - a for a, b, _ in cells) == 3000
    assert [c[2] for c in cells] == sorted((c[2] for c in cells), reverse=True)
    for a, b, bound in cells:
        assert index.scores(np.arange(a, b), x[0]).max() <= bound
    seen = []

    def take(at, score):
        seen.append(score)
        return sorted(np.concatenate(seen))[-5]

    monkeypatch.setattr(H, "BATCH", 100)
    index.visit(x[0], -np.inf, take, lambda at: at >= 0)
    assert sum(map(len, seen)) < 1500
    assert sorted(np.concatenate(seen))[-5:] == sorted(x @ x[0])[-5:]

"""Nearest rows by tiles equal plain ones, and candidates don't become rows."""

import numpy as np
import pytest

from quakeloom.operators import nearest, neighbors


@pytest.mark.parametrize(("axes", "block"), [("XYZ", 65_536), ("XYZ", 50), ("XY", 65_536)])
def test_nearest_equal_plain_ones(spark, monkeypatch, axes, block):
    r = np.random.default_rng(7)
    place = np.concatenate([np.round(r.normal(0, 6, (260, 3))), r.uniform(-900, 900, (40, 3)), np.full((12, 3), 3.0)]) + 1000
    key = [f"e{n}" for n in r.permutation(len(place))]
    real, seen = nearest.nearest_within, []

    def parts(rows, points, *a):
        found = real(rows, points, *a, block=block)
        seen.append((rows.count(), found.count()))
        return found

    monkeypatch.setattr(nearest, "nearest_within", parts)
    monkeypatch.setattr(neighbors, "MANY", 100)
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in zip(key, place, strict=True)], "ID string, X double, Y double, Z double")
    got = sorted(tuple(x) for x in neighbors.knn(df, 4, "ID", tuple(axes)).select("i", "rank", "j", "d").collect())
    used, want = place[:, : len(axes)], []
    for i, p in enumerate(used):
        order = sorted((float(sum((q - p) ** 2)), key[j]) for j, q in enumerate(used) if j != i)[:4]
        want += [(key[i], n, j, d**0.5) for n, (d, j) in enumerate(order, 1)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], rtol=1e-12)
    assert seen
    if block > 50:
        assert all(found <= 4 * rows for rows, found in seen)

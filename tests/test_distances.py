"""Sums of distances by trees and by nodes that stand for far clusters."""

import numpy as np
import pytest

from quakeloom.operators import cluster, distances


@pytest.mark.parametrize("axes", [2, 3])
def test_sums_by_trees(axes):
    r = np.random.default_rng(8)
    sheet = r.uniform(-500, 500, (4000, axes)) * np.r_[np.ones(axes - 1), 0.02] + 100_000
    places = np.concatenate([sheet, r.normal(0, 30, (1500, axes)) + 101_500, np.full((300, axes), 100_040.0), [[np.nan] * axes]])
    weights = r.uniform(-1, 2, len(places))
    for x, y, w in ((places, places, weights), (sheet, places[4000:-1], weights[4000:-1]), (places[:7], sheet, weights[:4000])):
        got, want = distances.distance_sums(x, y, w, 64), distances._plain(x, y, w)
        assert np.allclose(got, want, rtol=1e-8, atol=1e-4, equal_nan=True)
    assert (distances.distance_sums(places[5500:5800], places[5500:5800], np.ones(300), 64) == 0).all()


def test_silhouette_of_far_clusters_sends_nodes_for_rows(spark, monkeypatch):
    """Patches far apart with rows without a place, a patch of such rows alone, one of one row, and two that lie in one another."""
    r = np.random.default_rng(9)
    middle = np.array([[0, 0, 0], [60, 0, 0], [0, 60, 0], [60, 60, 10], [61, 60, 10]]) * 100 + 500_000
    label = np.sort(r.integers(0, 5, 9000))
    x = middle[label] + r.normal(0, (200, 200, 3), (9000, 3))
    rows = [(int(k), *map(float, p)) for k, p in zip(label, x, strict=True)] + [(7, 4e5, 5e5, 5e5), (-1, 0.0, 0.0, 0.0), (2, None, 5e5, 5e5)]
    df = spark.createDataFrame(rows, "label int, X double, Y double, Z double")
    x, label = np.r_[x, [[4e5, 5e5, 5e5]]], np.r_[label, 7]
    n = {k: int((label == k).sum()) + (k == 2) for k in set(label)}
    sums = {k: distances._plain(x, x[label == k], np.ones(int((label == k).sum()))) for k in n}
    value = []
    for i, k in enumerate(label):
        b = min(sums[j][i] / n[j] for j in n if j != k)
        value.append((b - sums[k][i] / (n[k] - 1)) / max(b, sums[k][i] / (n[k] - 1)) if n[k] > 1 else 0)
    c = df.filter("label >= 0").selectExpr("label", "X", "Y", "Z", "monotonically_increasing_id() AS r")
    for block in (700, 524_288):
        assert abs(cluster.clustering_quality(df, ("X", "Y", "Z"), block=block).first()["silhouette"] - sum(value) / 9002) < 1e-9
    assert cluster._distance_sums(c, ("X", "Y", "Z"), 524_288).filter("label = 0").select("to").distinct().count() < 6

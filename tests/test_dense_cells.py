"""Work on dense cells grows with the rows, not with their pairs."""

import numpy as np

from quakeloom.operators import cluster

XYZ = ("X", "Y", "Z")


def brute(xyz, eps, least):
    """Core rows' labels, numbered by their smallest row; -1 for all others."""
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= least
    label, n = np.full(len(xyz), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                near = np.flatnonzero((d[todo.pop()] <= eps) & core & (label < 0))
                label[near] = n
                todo += near.tolist()
            n += 1
    return label


def table(spark, xyz):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(xyz)], "eid long, X double, Y double, Z double")


def sheets(rng, n):
    """Two dense sheets 130 apart, one 400 away, and loose rows."""
    flat = rng.uniform(0, 600, (n, 3)) * [1, 1, 0.05]
    flat[n // 3 : 2 * n // 3, 2] += 160
    flat[2 * n // 3 :, 2] += 700
    return np.vstack([flat, rng.uniform(-2000, 2000, (n // 10, 3))])


def test_rows_of_dense_cells_are_compared_once_a_cell_is_joined(spark, monkeypatch):
    xyz = sheets(np.random.default_rng(5), 1200)
    left, joined = [], cluster._joined

    def spy(pairs, roots, *a):
        root = {r.node: r.root for r in roots.collect()}
        left.append(sum(root[r.i__node] != root[r.j__node] for r in pairs.collect()))
        return joined(pairs, roots, *a)

    monkeypatch.setattr(cluster, "_joined", spy)
    got = {r.eid: r.label for r in cluster.dbscan(table(spark, xyz), XYZ, 150.0, 8, "eid").filter("core").collect()}
    assert [got.get(i, -1) for i in range(len(xyz))] == brute(xyz, 150.0, 8).tolist()
    assert left[0] > 200 and left[1] < left[0] / 20


def test_density_ladder_writes_no_pairs(spark, monkeypatch):
    xyz = sheets(np.random.default_rng(6), 900)
    rows, cut = [], cluster.cut

    def spy(df):
        rows.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(cluster, "cut", spy)
    lost = spark.createDataFrame([(-1, None, 0.0, 0.0), (-2, float("nan"), 0.0, 0.0)], "eid long, X double, Y double, Z double")
    found = cluster.density_ladder(table(spark, xyz).union(lost), XYZ, [60.0, 150.0], 5, "eid").collect()
    for eps in (60.0, 150.0):
        got = {r.eid: r.label for r in found if r.eps == eps}
        assert (got.pop(-1), got.pop(-2)) == (-1, -1)
        assert [got[i] for i in range(len(xyz))] == brute(xyz, eps, 6).tolist()
    assert max(rows) < 20 * len(xyz)  # over 100 pairs a row within 150


def test_silhouette_bounds_hold_rows_of_a_cell_in_vectors(spark, capsys):
    xyz = sheets(np.random.default_rng(7), 600)
    df = table(spark, xyz).selectExpr("*", "CAST(eid DIV 200 AS INT) AS label")
    whole = cluster.silhouette_bounds(df, XYZ, detail=4)
    parts = cluster.silhouette_bounds(df, XYZ, detail=4, block=5).first()
    assert np.allclose(whole.first(), parts, rtol=1e-12)
    capsys.readouterr()
    whole.explain()
    assert "FlatMapCoGroupsInPandas" in capsys.readouterr().out

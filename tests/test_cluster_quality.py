import numpy as np
import pytest

from quakeloom.operators import cluster, lineage

XYZ = ("X", "Y", "Z")


def test_silhouette_over_many_blocks(spark):
    """Repeated rows at few places, so brute force is over these."""
    r = np.random.default_rng(5)
    places, labels = r.normal(size=(12, 3)) * 10, np.array([0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2, -1])
    times = np.array([230, 190, 200, 170, 180, 210, 160, 220, 150, 140, 250, 30])
    df = spark.createDataFrame([(int(lb), int(n), *map(float, p)) for p, lb, n in zip(places, labels, times, strict=True)], "label int, n int, X double, Y double, Z double")
    df = df.selectExpr("label", "X", "Y", "Z", "explode(sequence(1, n)) AS one")
    got = cluster.clustering_quality(df, XYZ, block=200).collect()[0]
    d, w = np.linalg.norm(places[:, None] - places[None], axis=2), times
    value = []
    for i in range(11):
        mean = {c: (d[i] * w)[labels == c].sum() / (w[labels == c].sum() - (c == labels[i])) for c in range(3)}
        a, b = mean.pop(labels[i]), min(mean.values())
        value.append((b - a) / max(a, b))
    assert w[:11].sum() > 2_000 and abs(got.silhouette - np.average(value, weights=w[:11])) < 1e-9


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_dbscan_of_dense_cells_against_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(0, 0.9, (500, 2)), axis=0)  # a chain of touching, partly filled cells
    blobs = np.concatenate([rng.normal(c, 0.4, (120, 2)) for c in ((40, 0), (41.6, 0), (60, 5), (60, 5))])
    p, eps, least = np.concatenate([walk, blobs, rng.uniform(-60, 60, (200, 2))]), 1.0, 6
    gap = np.abs(p[:, None] - p[None])
    dist = {"euclidean": np.sqrt((gap**2).sum(-1)), "manhattan": gap.sum(-1), "chebyshev": gap.max(-1)}[metric]
    near = dist <= eps
    core, root = near.sum(1) >= least, np.arange(len(p))
    for _ in range(len(p)):
        low = np.where(near & core[None] & core[:, None], root[None], len(p)).min(1)
        new = np.where(core, np.minimum(low, root), root)
        if (new == root).all():
            break
        root = new
    number = {r: i for i, r in enumerate(sorted(set(root[core].tolist())))}
    label = np.array([number[r] if c else -1 for r, c in zip(root.tolist(), core, strict=True)])
    want = [int(x) if c else min((int(v) for v in label[n & core]), default=-1) for x, c, n in zip(label, core, near, strict=True)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "ID long, X double, Y double")
    got = {r.ID: r.label for r in cluster.dbscan(df, ("X", "Y"), eps, least, metric=metric).collect()}
    assert [got[i] for i in range(len(p))] == want and len(number) > 3


def test_numbers_run_over_ranges(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k", "id AS v")
    assert [r.no for r in lineage.numbered(df, ("k",), "no").orderBy("k").collect()] == list(range(1, 1001))
    assert lineage.numbered(df.limit(0), ("k",), "no").count() == 0


def test_silhouette_lies_within_its_bounds(spark):
    import numpy as np
    from quakeloom.operators import cluster

    r = np.random.default_rng(6)
    n = 2000
    label = np.where(np.arange(n) < 3, -1, np.arange(n) % 5)
    label[3] = 9  # a cluster of one row
    x = np.array([[0, 0, 0], [30, 0, 0], [0, 40, 5], [33, 6, 0], [600_000, 0, 0]])[label % 5] + r.normal(0, 6, (n, 3)) + 500_000
    df = spark.createDataFrame([(int(v), *map(float, p)) for v, p in zip(label, x, strict=True)], "label int, X double, Y double, Z double")
    kept = label >= 0
    d = np.sqrt(((x[kept][:, None] - x[kept][None]) ** 2).sum(axis=2))
    y, values = label[kept], []
    for i in range(len(y)):
        means = {v: d[i, y == v].sum() / ((y == v).sum() - (v == y[i]) or 1) for v in set(y)}
        a, b = means.pop(y[i]), min(means.values())
        values.append(0.0 if (y == y[i]).sum() == 1 else (b - a) / max(a, b))
    widths = []
    for detail in (4, 16):
        got = cluster.silhouette_bounds(df, ("X", "Y", "Z"), detail=detail).first()
        assert got.silhouette_low - 1e-9 <= np.mean(values) <= got.silhouette_high + 1e-9
        widths.append(got.silhouette_high - got.silhouette_low)
    assert widths[1] < widths[0] and widths[1] < 0.03
    assert cluster.silhouette_bounds(df.filter("label < 0"), ("X", "Y", "Z")).first().silhouette is None
    assert cluster.silhouette_bounds(df.filter("label = 1"), ("X", "Y", "Z")).first().silhouette == 0.0


def test_small_to_noise_finds_its_labels_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    labels = spark.range(100, numPartitions=2).selectExpr("id AS eid", "CAST(if(id < 10, 1, 2) AS INT) AS label").mapInPandas(count, "eid long, label int")
    got = {r["eid"]: r["label"] for r in cluster.small_to_noise(labels, 20).collect()}
    assert got == {i: -1 if i < 10 else 2 for i in range(100)}
    assert seen.value == 100


def test_silhouette_adds_up_blocks_not_rows_of_pairs(spark, capsys):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(120, 3)), np.sort(rng.integers(-1, 9, 120))
    rows = [(int(k), *map(float, p)) for k, p in zip(label, x, strict=True)]
    rows[50] = (int(label[50]), None, 0.0, 0.0)
    df = spark.createDataFrame(rows, "label int, X double, Y double, Z double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[50], d[:, 50] = 0, 0
    want = []
    for i in np.flatnonzero(label >= 0):
        n = {k: int((label == k).sum()) for k in set(label[label >= 0])}
        a = d[i][label == label[i]].sum() / (n[label[i]] - 1) if n[label[i]] > 1 else None
        b = min(d[i][label == k].sum() / n[k] for k in n if k != label[i])
        want.append(0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    for block in (7, 4096):
        got = cluster.clustering_quality(df, ("X", "Y", "Z"), block=block)
        assert abs(got.first()["silhouette"] - np.mean(want)) < 1e-9
        capsys.readouterr()
        got.explain()
        assert "FlatMapGroupsInPandas" in capsys.readouterr().out

"""Clusters over given pairs, splits of planes and groups, polygon lookup, fronts and mixtures, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom.operators import cluster, neighbors, orient, subclusters, tuning

XYZ = ("X", "Y", "Z")


def cloud(spark, seed, n):
    r = random.Random(seed)
    rows = [(i, *(r.choice((0, 40, 90)) + r.gauss(0, 4) for _ in range(3)), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "ID long, X double, Y double, Z double, o int")


@pytest.mark.parametrize("min_samples", [1, 4, 9])
def test_clusters_over_pairs_equal_those_over_places(spark, min_samples):
    p = cloud(spark, 1, 160)
    pairs = neighbors.grid_pairs(p, p, XYZ, 6.0, ("o",)).filter(neighbors.d2() <= 36).select(F.col("i_ID").alias("i"), F.col("j_ID").alias("j"))
    got = cluster.dbscan_pairs(p, pairs, min_samples, on=("o",)).orderBy("ID").collect()
    assert got == cluster.dbscan(p, XYZ, 6.0, min_samples, on=("o",)).orderBy("ID").collect()


def test_split_by_disc_points(spark):
    """Two stacks of parallel planes 100 m apart: one by distance in space, two across their planes; one plane without a normal."""
    rows = [(i, 10.0 * (i % 5), 10.0 * (i // 5 % 2), 100.0 * (i // 10) + i % 3, 0.0, 0.0, -1.0 if i % 4 else 1.0, 30.0) for i in range(20)]
    rows += [(90, 0.0, 0.0, 0.0, None, None, None, 30.0), (91, 9000.0, 0.0, 0.0, 0.0, 0.0, 1.0, 30.0)]
    planes = spark.createDataFrame(rows, "ID long, X double, Y double, Z double, normal_vector_x double, normal_vector_y double, normal_vector_z double, rupt_radius double")
    points = planes.select("ID", *XYZ).withColumn("ring_index", F.explode(F.sequence(F.lit(0), F.lit(2))))
    points = points.withColumn("X", F.col("X") + F.col("ring_index") * 5)
    lab = lambda **o: {r.ID: r.label for r in subclusters.split_spatially(planes, points, min_samples=4, **o).collect()}
    flat = lab(anisotropic=(150.0, 20.0))
    assert [flat[i] for i in range(20)] == [0] * 10 + [1] * 10
    assert (flat[90], flat[91]) == (-1, -1)
    round_ = lab(eps=120.0)
    assert {round_[i] for i in range(20)} == {0} and round_[90] == 0 and round_[91] == -1


def test_groups_fall_back_to_kmeans(spark):
    r = random.Random(2)
    rows = [(i, r.gauss(0, 1) + 500 * (i % 2), r.gauss(0, 1), 0.0, "dense") for i in range(40)]
    rows += [(100 + i, 1000.0 * i, 0.0, 0.0, "loose") for i in range(12)] + [(200 + i, 0.0, 0.0, 0.0, "few") for i in range(3)]
    rows += [(300 + i, 5.0, 5.0, 5.0, "same") for i in range(10)]
    df = spark.createDataFrame(rows, "ID long, X double, Y double, Z double, group string")
    got = {x.ID: x.label for x in subclusters.adaptive_split(df, 3, 5).collect()}
    assert len(got) == len(rows)
    assert [got[i] for i in range(40)] == [i % 2 for i in range(40)]
    assert [got[100 + i] for i in range(12)] == [0] * 6 + [1] * 6
    assert {got[200 + i] for i in range(3)} == {0} == {got[300 + i] for i in range(10)}
    assert subclusters.adaptive_split(df.limit(0)).count() == 0


def test_polygons_by_squares(spark):
    r = random.Random(3)
    rings = []
    for n in range(60):
        x, y, size = r.uniform(0, 100), r.uniform(0, 100), 10 ** r.uniform(-1, 2)
        turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(r.randrange(3, 12)))
        rings.append((f"D{n:02d}", float(n), [(x + size * r.uniform(0.2, 1) * math.cos(t), y + size * r.uniform(0.2, 1) * math.sin(t)) for t in turns]))
    rings += [("D99", 1.0, [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]), ("A0", 7.0, [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)])]
    points = [(i, r.uniform(-20, 130), r.uniform(-20, 130)) for i in range(1500)] + [(9000, None, 1.0)]

    def holds(ring, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    dom = spark.createDataFrame(rings, "Domain string, R double, ring array<struct<x: double, y: double>>")
    got = {e.ID: e.Domain for e in neighbors.with_domain(spark.createDataFrame(points, "ID long, X double, Y double"), dom).collect()}
    assert len(got) == len(points)
    for i, x, y in points:
        assert got[i] == min((n for n, _, ring in rings if x is not None and holds(ring, x, y)), default=None)
    squares = neighbors.polygon_cells(dom.select("Domain", "ring"))
    assert squares.groupBy("Domain").count().agg(F.max("count")).first()[0] <= 17 * 17
    assert neighbors.with_domain(spark.createDataFrame(points, "ID long, X double, Y double"), dom.limit(0)).filter("Domain IS NOT NULL").count() == 0


def test_front_over_blocks(spark):
    r = random.Random(4)
    rows = [(i, float(r.randrange(30)), float(r.randrange(30)), float(r.randrange(30))) for i in range(600)]
    rows += [(700 + i, float(i), float(29 - i), -1.0) for i in range(30)] + [(900, None, 0.0, 0.0)]
    want = {i for i, *v in rows if None in v or not any(all(a <= b for a, b in zip(w, v, strict=True)) and w != v for _, *w in rows if None not in w)}
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(4)
    for block in (4096, 9):
        assert {x.id for x in tuning.pareto(df, ("a", "b", "c"), block).collect()} == want
    assert tuning.pareto(df.limit(0), ("a", "b")).count() == 0


def test_mixtures_together_equal_steps_one_by_one(spark):
    r = np.random.default_rng(5)
    c = np.array([[1, 0, 0], [0, 1, 0], [0, 0, -1.0]])[np.arange(240) % 3] + r.normal(0, 0.15, (240, 3))
    v = c / np.linalg.norm(c, axis=1, keepdims=True)
    u = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "ID long, x double, y double, z double")
    for hard in (False, True):
        start = {"mu": v[[0, 4, 8]], "kappa": np.full(3, 10.0), "weight": np.full(3, 1 / 3)}
        sums = orient._all_sums(u, {0: start, 1: {**start, "mu": v[[3, 1, 2]]}}, hard)
        for m, mu in ((0, v[[0, 4, 8]]), (1, v[[3, 1, 2]])):
            new, _, weight, loglik = orient.em_step(u, mu, start["kappa"], start["weight"], hard)
            assert np.allclose(sums[m][:, 1:4] / np.linalg.norm(sums[m][:, 1:4], axis=1, keepdims=True), new)
            assert np.allclose(sums[m][:, 0] / 240, weight) and math.isclose(sums[m][0, 4], loglik)
    models = orient.vmf_mixtures(u, range(1, 5), starts=4, max_iter=60)
    assert sorted(models) == [1, 2, 3, 4]
    assert models[3]["inertia"] < models[2]["inertia"] < models[1]["inertia"]
    labels = {r.ID: r.label for r in orient.vmf_labels(u, models[3]).collect()}
    assert len({(i % 3, labels[i]) for i in range(240)}) == 3
    assert orient.vmf_mixture(u.limit(0), 2)[0].count() == 0


def test_classes_part_by_discs_across_their_planes(spark):
    from quakeloom.plans import pipeline

    rows = [(f"E{i:02d}", 20.0 * (i % 5), 0.0, 120.0 * (i // 10) + i % 2, 0.0, 0.0, -1.0, 40.0) for i in range(20)]
    df = spark.createDataFrame(rows, "ID string, X double, Y double, Z double, normal_vector_x double, normal_vector_y double, normal_vector_z double, rupt_radius double")
    part = lambda **o: {r.ID: r.cluster for r in pipeline.classify(df, 1, min_samples=4, min_events=5, starts=1, **o).collect()}
    assert set(part(eps=150.0).values()) == {"0-0"}
    split = part(disc_spacing=(20.0, 40.0), anisotropic=(200.0, 30.0))
    assert [split[f"E{i:02d}"] for i in range(20)] == ["0-0"] * 10 + ["0-1"] * 10

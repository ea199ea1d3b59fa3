"""Sums of neighbourhoods in vectors equal those of the table of pairs, which they do without."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeloom import registry
from quakeloom.operators import neighbors, planes, tiles

COV = planes.COVARIANCE


def table(df, seq=()):
    return {tuple(r[c] for c in ("i", *seq)): (r["n"], *(None if r[c] is None else round(r[c], 9) for c in COV)) for r in df.collect()}


def scattered(spark, n=700):
    """A dense heap, a sheet through it, far rows, copies in one place, rows on edges of cells, and rows that have no place."""
    h = lambda k, m: f"pmod(xxhash64(id, {k}), {m})"
    axis = lambda k: f"CASE WHEN id % 7 = 0 THEN {h(k, 5000)} - 2500 WHEN id % 5 = 0 THEN 100 * ({h(k, 7)} - 3) WHEN id % 11 = 0 THEN 40 ELSE {h(k, 1601)} / 4 - 200 END"
    rows = spark.range(n).selectExpr("CONCAT('e', id) AS ID", f"CAST({axis(1)} AS DOUBLE) AS X", f"CAST({axis(2)} AS DOUBLE) AS Y", f"CAST({axis(3)} AS DOUBLE) AS Z", "CAST('2020-01-01' AS TIMESTAMP) AS Date", "CASE WHEN id % 50 <> 3 THEN CONCAT('s', id % 2) END AS s", "CAST(id % 3 AS INT) AS k")
    odd = spark.createDataFrame([("a", None, 0.0, 0.0), ("b", float("nan"), 0.0, 0.0)], "ID string, X double, Y double, Z double")
    return rows.unionByName(odd.withColumns({"Date": F.lit("2020-01-01").cast("timestamp"), "s": F.lit("s1"), "k": F.lit(1)}))


@pytest.mark.parametrize("seq", [(), ("s", "k")])
@pytest.mark.parametrize("block", [16_384, 40])
def test_equals_moments_of_pairs(spark, seq, block):
    cat = scattered(spark)
    want = table(planes.moments(neighbors.neighbor_pairs(cat, 100.0, None, "ID", seq), ("i", *seq)), seq)
    assert max(v[0] for v in want.values()) > 10
    assert table(planes.neighbor_moments(cat, 100.0, "ID", seq, None, block), seq) == want


def test_more_places_to_be_found(spark):
    cat, extra = scattered(spark, 300), scattered(spark, 500).filter("ID > 'e2'").withColumn("X", F.col("X") + 10)
    want = table(planes.moments(neighbors.neighbor_pairs(cat, 100.0, None, "ID", ("k",), extra), ("i", "k")), ("k",))
    assert table(planes.neighbor_moments(cat, 100.0, "ID", ("k",), extra, 40), ("k",)) == want


def test_no_rows(spark):
    assert planes.neighbor_moments(scattered(spark).limit(0), 100.0).count() == 0


@pytest.mark.parametrize("name", ["a1_plane_fit", "a2_plane_acceptance", "a3_monte_carlo_planes", "a14_plane_quality"])
def test_plane_queries_make_no_row_of_a_pair(spark, sf_dir, capsys, name):
    capsys.readouterr()
    registry.QUERIES[name](spark, sf_dir).explain()
    text = capsys.readouterr().out
    assert "MapInArrow" in text and "j_X" not in text


@pytest.mark.parametrize("spread", [60.0, 9.0])
def test_sums_by_cells_equal_those_by_pairs(spread):
    """A sheet, a heap, many rows in one place, and rows at exactly the radius; on quarters, so sums have no rounding."""
    r = np.random.default_rng(4)
    sheet = np.round(r.normal(0, (spread, spread, 1), (4000, 3)) * 4) / 4
    place = np.concatenate([sheet, np.round(r.normal(40, 10, (900, 3)) * 4) / 4, np.full((600, 3), 25.0), [[100.0, 0, 0], [0, -60.0, 80.0], [0, 0, 0]]]) + (590_000, 120_000, -5_000)
    mine = place[::3]
    got, want = planes._cell_sums(mine, place, 100.0, 8, 20), np.zeros((len(mine), 10))
    for i, x in enumerate(mine):
        g = place[((place - x) ** 2).sum(axis=1) <= 10_000] - x
        want[i] = np.r_[len(g), g.sum(axis=0), [(g[:, a] * g[:, b]).sum() for a, b in planes.PRODUCTS]]
    assert (got == want).all()


def test_few_rows_are_held_against_each_other(monkeypatch):
    """Rows that lie wholly within the radius of one another go by their cells' sums."""
    place, held = np.random.default_rng(4).normal(0, 5, (5000, 3)), []
    ring = planes._ring_sums
    monkeypatch.setattr(planes, "_ring_sums", lambda x, by, at, *a: held.append(len(x) * len(at)) or ring(x, by, at, *a))
    assert (planes._group_sums(place, place, 100.0)[:, 0] == 5000).all() and not sum(held)


def test_dense_tiles_are_repeated_for_few_parts(spark):
    cat = spark.range(100_000).selectExpr("id AS ID", "CAST(id % 100 AS DOUBLE) AS _X", "CAST(id % 97 AS DOUBLE) AS _Y", "0D AS _Z", "id AS i", "true AS _own").drop("ID")
    met, by = tiles.tile_groups(cat, 100.0, (), 131_072)
    assert met.count() == 200_000 and met.select(*by).distinct().count() == 1

"""Moments over a grid of radii and spans without a row for each pair."""

import random

import numpy as np
import pytest

from quakeloom.operators import tuning

RADII, SPANS = [60.0, 100.0, 150.0], [2.0, 24.0, 9_999_999.0]


def events(spark):
    r = random.Random(5)
    rows = [(f"E{i}", *(round(r.gauss(r.choice((-400, 0, 300)), 90) * 4) / 4 for _ in range(3)), r.choice((0, 7199, 7200, 90_000, 90_001, 10**8)) + r.randrange(2) * 10**7) for i in range(700)]
    rows += [("null", None, 0.0, 0.0, 5), ("late", 0.0, 0.0, 0.0, None), ("E0", *rows[0][1:])]
    return spark.createDataFrame(rows, "ID string, X double, Y double, Z double, t long").selectExpr("ID", "X", "Y", "Z", "timestamp_seconds(t) AS Date")


def test_grid_moments_make_no_pair_a_row(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a join of pairs")

    monkeypatch.setattr(tuning, "neighbor_pairs", never)
    assert tuning.grid_moments(events(spark), RADII, SPANS).count() > 500


@pytest.mark.parametrize("spans", [SPANS, [1.0, 8000.0, 8783.0, 8784.0]])
def test_tiles_equal_the_join(spark, spans):
    cat = events(spark)
    got, want = (f(cat, RADII, spans, "ID").groupBy("i", "a", "b").agg({k: "sum" for k in ("n", *(f"s{k}" for k in range(9)))}).orderBy("i", "a", "b").collect() for f in (tuning._tile_sums, tuning._pair_sums))
    assert len(want) > 3000 and got == want
    assert {x.dt for x in tuning.grid_moments(cat, RADII, spans).collect()} <= set(spans)


def test_dense_sums_by_slices_of_time(monkeypatch):
    r = np.random.default_rng(3)
    place = np.round(r.normal(0, (80, 80, 2), (1500, 3)) * 4) / 4
    t = r.choice((0, 7199, 7200, 7201, 10_799, 10_800, 50_000, 89_999, 90_000), 1500) + r.integers(0, 2, 1500) * 300_000
    spans, radii = np.array([10_800.0, 90_000.0, 10.0**7, 10.0**8]), np.array(RADII)
    want = tuning._binned_sums(place[:500], place, (t[:500], t), radii, spans)
    assert (tuning._dense_sums(place[:500], place, (t[:500], t), radii, spans, 800) == want).all()


def test_spans_over_the_whole_catalog_are_found_once(spark, monkeypatch):
    """Spans that hold all events are equal, so only the first of them is worked out."""
    asked, tiles = [], tuning._tile_sums
    monkeypatch.setattr(tuning, "_tile_sums", lambda cat, rs, ts, key: asked.append(ts) or tiles(cat, rs, ts, key))
    cat = events(spark).selectExpr("*", "10D AS EX", "10D AS EY")
    longest = (10**8 + 10**7) // 3600
    spans = [24.0, float(longest), longest + 100.0, 9_999_999.0]
    got = {x.dt: (x.planes, x.mean_ratio) for x in tuning.grid_search(cat, [150.0, 300.0], spans).filter("r = 300").collect()}
    assert asked == [spans[:2]] and set(got) == set(spans) and got[spans[1]] == got[spans[2]] == got[spans[3]]
    assert {x.dt for x in tuning.grid_moments(cat, [300.0], spans).collect()} == set(spans)

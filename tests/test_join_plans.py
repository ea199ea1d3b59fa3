"""Joins are planned for tables of any size: none is broadcast by the size of its compressed files."""

import pytest

from quakeloom import registry
from quakeloom.operators.neighbors import XYZ, grid_pairs


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_neighbour_join_shuffles_both_sides(spark, tmp_path, capsys):
    path = str(tmp_path / "points")
    spark.range(500).selectExpr("id AS eid", "id % 7 * 100.0D AS X", "id % 5 * 100.0D AS Y", "0.0D AS Z").write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    try:
        p = spark.read.parquet(path)
        assert "SortMergeJoin" in (text := plan(grid_pairs(p, p, XYZ, 150.0), capsys)) and "Broadcast" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["w5_reference_flip", "j3_match_by_id", "a1_neighborhood_moments"])
def test_queries_broadcast_nothing_by_estimate(spark, sf_dir, capsys, name):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan(registry.QUERIES[name](spark, sf_dir), capsys)
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") is not None


#: Queries of pairs that broadcast 600,000 rows by the size of their files before both sides were shuffled.
PAIR_QUERIES = [
    "j1_neighbor_pairs_in_time",
    "a14_plane_quality",
    "c18_grid_moments",
    "j9_anisotropic_pairs",
    "j1_neighbor_pairs",
]


@pytest.mark.parametrize("name", PAIR_QUERIES)
def test_pair_queries_broadcast_no_events(spark, sf_dir, capsys, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    assert "BroadcastHashJoin" not in (text := plan(registry.QUERIES[name](spark, sf_dir), capsys)) and "SortMergeJoin" in text

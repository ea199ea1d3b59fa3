import pytest

from quakeloom.operators.graph import connected_components


def test_unsettled_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, 2)
    assert {tuple(r) for r in connected_components(edges).collect()} == {(i, 0) for i in range(65)}
    assert connected_components(edges.limit(0)).count() == 0

"""Loops leave their plans behind as garbage; a cut has the driver collect it at times."""

import pytest

from quakeloom import registry
from quakeloom.operators import lineage


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_cut_collects_garbage_at_times(spark, monkeypatch):
    monkeypatch.setattr(lineage, "_collected", [0.0])
    monkeypatch.setattr(lineage, "COLLECT_S", 3600.0)
    monkeypatch.setattr(lineage.time, "monotonic", lambda: 5000.0)
    before = full_collections(spark)
    assert lineage.cut(spark.range(5)).count() == 5
    first = full_collections(spark)
    assert first > before
    assert lineage.cut(spark.range(7)).count() == 7
    assert lineage._collected == [5000.0]


@pytest.mark.parametrize("name", ["c6_two_step_report", "c7_hdbscan"])
def test_loops_collect_garbage(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(lineage, "_collected", [0.0])
    monkeypatch.setattr(lineage, "COLLECT_S", 0.0)
    before = full_collections(spark)
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
    assert full_collections(spark) > before + 1

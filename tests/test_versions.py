import pytest
from pyspark.sql import functions as F

from quakeloom.sources import versions as V


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_merge_and_keep_the_old_on_failure(spark, tmp_path):
    folder = f"{tmp_path}/db"
    a = spark.createDataFrame([("F1", 1), ("F2", 2)], "fault_id string, n long")
    b = spark.createDataFrame([("F2", 20), ("F3", 30)], "fault_id string, n long")
    assert V.versions(spark, folder) == [] and V.load(spark, folder) == {}
    assert V.publish(spark, folder, {"metadata": a, "focals": a.limit(1)}) == 1
    assert V.publish(spark, folder, {"metadata": b}, {"metadata": "fault_id"}) == 2
    assert rows(V.load(spark, folder)["metadata"]) == [("F1", 1), ("F2", 20), ("F3", 30)]
    assert rows(V.load(spark, folder, 1)["metadata"]) == [("F1", 1), ("F2", 2)]
    assert V.load(spark, folder)["focals"].count() == 1
    broken = b.withColumn("n", F.raise_error(F.lit("half way")).cast("long"))
    with pytest.raises(Exception, match="half way"):
        V.publish(spark, folder, {"metadata": b, "focals": broken})
    with pytest.raises(V.CommitConflict):
        V.publish(spark, folder, {"metadata": a}, base=1)
    assert V.versions(spark, folder) == [1, 2]
    assert rows(V.load(spark, folder)["metadata"]) == [("F1", 1), ("F2", 20), ("F3", 30)]
    assert V.publish(spark, folder, {"metadata": a}) == 3
    assert rows(V.load(spark, folder)["metadata"]) == [("F1", 1), ("F2", 2)]

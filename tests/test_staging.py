from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestone import staging


def session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app", getConf=lambda: SimpleNamespace(get=lambda key: None)),
    )


def test_tables_go_to_the_shared_folder():
    assert staging.shared_root(session("spark://host:7077", "hdfs://store/tmp/")) == "hdfs://store/tmp/lodestone-app"
    assert staging.shared_root(session("local[4]")).startswith("file:///")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_root(session("yarn"))


def test_numbers_in_order_without_one_task(spark):
    rows = [(i * 7 % 100, "x" * (i % 3)) for i in range(100)] + [(None, "n")]
    frame = spark.createDataFrame(rows, "a int, b string").repartition(5)
    order = [F.col("a").asc_nulls_last()]
    got = staging.Staging(spark, "t").numbered(frame, order, "place", "numbered")
    assert sorted((r.place, r.a) for r in got.collect()) == [*((i, i) for i in range(100)), (100, None)]
    assert got.columns == ["a", "b", "place"]

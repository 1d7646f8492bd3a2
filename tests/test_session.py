import os

import pytest
from pyspark.sql import functions as F

from hearken import session


def test_cut_outlives_its_source_and_is_released(spark):
    df = session.cut(spark.range(5).withColumn("x", F.rand()))
    assert df.orderBy("id").collect() == df.orderBy("id").collect()
    folder = session.shared_folder(spark).removeprefix("file://")
    assert any(f.startswith("cut-") for f in os.listdir(folder))
    session.release(spark)
    assert not any(f.startswith("cut-") for f in os.listdir(folder))


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "a"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert session.shared_folder(Session()).startswith("file://")


def test_sized(spark):
    assert session.sized(spark.range(5), 5).count() == 5 and session.sized(spark.range(0), 5).count() == 0
    with pytest.raises(Exception, match="more than 4 rows"):
        session.sized(spark.range(5), 4).collect()

"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings worth having on a cluster; all are runtime settings and none is needed for right results.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME` to a session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors share: ``spark.checkpoint.dir``. Only a session within one process may go without: it gets one of its own.

    A session of several processes without that setting raises, since a local folder isn't shared between nodes.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/hearken-{spark.sparkContext.applicationId}"


#: Paths given out by :func:`fresh_path`, by application.
_WRITTEN: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses; :func:`release` deletes what is written there."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_release_all)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends in files that outlive any executor.

    The files stay until :func:`release` or the end of the process, as results that read them are lazy.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what :func:`cut` wrote for this application; results that still read it are lost."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # at exit the JVM may be gone before its files
            release(spark)


def sized(df: DataFrame, most: int) -> DataFrame:
    """A table that an operator takes in one task, with a check that it has at most ``most`` rows: the query fails if it has more.

    The check is a second, narrow pass over the table, which is as small as it should be.
    """
    rows = df.limit(most + 1).agg(F.count(F.lit(1)).alias("__rows"))
    checked = rows.select(F.when(F.col("__rows") <= most, F.lit(1)).otherwise(F.raise_error(F.lit(f"more than {most} rows where one task takes them all")).cast("int")).alias("__ok"))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(checked), F.col("__one") == F.col("__ok")).drop("__one", "__ok")


def spread(df: DataFrame, *, waves: int = 3) -> DataFrame:
    """A scan spread over all cores before a costly map, where its files make fewer tasks than that.

    Only the placement of rows changes. Large inputs, which have enough tasks of their own, aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * waves) if df.rdd.getNumPartitions() < 2 * cores else df

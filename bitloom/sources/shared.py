"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of the tables that this process has made and not yet deleted.
_made: list[str] = []

#: Whether Spark deletes the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master (tests) gets a local folder; a cluster is refused."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = "file://" + tempfile.mkdtemp(prefix="bitloom-")
    sc.setCheckpointDir(local)
    return local


def stored(df: DataFrame, name: str = "round") -> DataFrame:
    """df written once and read back: cuts lineage, survives lost executors, and has the sizes it really has.

    A checkpoint would keep the estimates of the plan behind it, which a loop of joins squares
    each round until planning takes longer than the work. The write's shuffle files go when it ends:
    they would stand until the driver happens to collect its garbage, those of several rounds at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bitloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _made:
        _made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() made and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


def clear(spark: SparkSession) -> int:
    """Deletes the tables this process has made that still stand, and says how many.

    A result may read its last tables for as long as it is used: call this when results are written.
    """
    left = list(_made)
    for path in left:
        _delete(spark, path)
    return len(left)

"""Structured Streaming forms of intake, dirty state and gap runs.

Each takes `place`, a folder that keeps the stream's state and its output: a later run with the same
place takes up only what has come since. Without one, a run has a fresh place in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bitloom.operators import aggs
from bitloom.sources.shared import shared_dir


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files of a path as a stream; each is taken up once."""
    held = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(held.schema)
    # a stream reads folders: a table that is one file is its folder's only file of that name
    if any(f.endswith(f"/{name}") for f in held.inputFiles()):
        return source.option("pathGlobFilter", name).parquet(folder)
    return source.parquet(path)


def finished(stream: DataFrame, mode: str, place: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """All output of a stream over what is there now.

    Append mode adds each batch's rows to what earlier runs wrote; complete mode replaces the whole
    result with each batch. Update mode writes the rows of the keys that a batch changed, and the result
    is the latest row of each key. A batch that is run again after a failure overwrites its own rows;
    in append and update mode those of earlier batches are never touched.
    """
    spark = stream.sparkSession
    base = place or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}" if mode != "complete" else f"{out}/batch=0")

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        every = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", out).parquet(f"{out}/batch=*")
        return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in stream.columns])
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def intake(stream: DataFrame, detect: Callable[[DataFrame], DataFrame], place: str | None = None) -> DataFrame:
    """A detection that needs no state, over files as they come."""
    return finished(detect(stream), "append", place)


def dirty_state(log: DataFrame, key: str, seq: str, action: str, rev: str, place: str | None = None) -> DataFrame:
    """Dirty flags of a revision log that is still growing: the batch aggregate, whose changed keys are written with each batch."""
    return finished(aggs.dirty(log, key, seq, action, rev), "update", place, [key])


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str, mode: str = "complete", place: str | None = None) -> DataFrame:
    """(key, start, end, n): runs of events whose gaps are below `gap`.

    In complete mode all runs so far, whose state is kept for good. In append mode a run is given once
    no event could join it any more, its state is dropped then, and rows later than `late` are left out.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    runs = timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return finished(runs.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"), mode, place)

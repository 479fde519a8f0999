"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.

    Only a local master, whose tasks run on this machine, may do without the setting;
    a cluster without it is an error, as its executors don't see each other's disks.
    """
    sc = spark.sparkContext._jsc.sc()
    if sc.getCheckpointDir().isDefined():
        return sc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="hearthline-")
    spark.sparkContext.setCheckpointDir(folder)
    return sc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows as Parquet in the shared folder and read them again.

    Any executor can read the table, so none that is lost takes data with it. Unlike
    a checkpointed plan, it carries neither inferred constraints nor estimated sizes
    of its origin, which grow without bound in loops of joins, but true file sizes.
    The tables are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4()}"
    df.write.parquet(path)
    if not _written:
        atexit.register(clear)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Remove the tables written so far; frames that read them can't be used afterwards."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

"""Tables that a plan writes for its own later steps, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Deletes a command's shuffle files once it has ended: what it wrote needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own on a local master alone."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, every_row: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of any executor.

    every_row: rows hold megabytes that are compressed already, so that pages and row groups must be measured after each.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    # no marker file: the table is read by its path in this session alone
    writer = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    if every_row:
        writer = writer.option("compression", "uncompressed").option("parquet.page.size.row.check.min", "1").option("parquet.block.size.row.check.min", "1").option("parquet.block.size", str(32 << 20))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later step reads."""
    for table in tables:
        jvm = table.sparkSession._jvm
        conf = table.sparkSession._jsc.hadoopConfiguration()
        folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
        for name in folders:
            if "/quire-" in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)

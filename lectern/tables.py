"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode a temporary one where none is configured."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(root)
        return root
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="lectern-shared-")
    context.setCheckpointDir(root)
    return root


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Fewer rows an Arrow batch than Spark's default, as these rows are whole texts; a smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise narrow rows in the shared folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Materialise rows as a Parquet table in the shared folder and read it back: the planner then knows its size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def still_there(*frames: DataFrame) -> bool:
    """Whether the first files that the frames were planned over exist, for what is kept between queries of one application."""
    for df in frames:
        for name in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            if not path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(path):
                return False
    return True

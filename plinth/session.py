"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plinth", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, no NTZ surprises)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **{name.replace("__", "."): value for name, value in conf.items()},
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; set one only where none is named (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: its lineage ends there.

    It survives lost executors, its rows are computed once (a Dataset checkpoint computes them
    twice), and Spark knows its size in bytes: a side that fits is then broadcast, a larger one
    is joined by shuffle with AQE's skew handling.  The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.option("maxRecordsPerFile", 0).parquet(path)  # one file a task
    return spark.read.schema(df.schema).parquet(path)


# Bytes of an input up to which it may be dealt over the cores.
SMALL_INPUT = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal an input of at most SMALL_INPUT bytes over all cores.

    One small file would keep every step up to the first shuffle in one task.  A larger
    input has splits enough and is never shuffled for this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df


# A derived side that several plans use: the same table, whose size in bytes is then known.
measured = cut_lineage

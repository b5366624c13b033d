"""Session settings the jobs rely on, applied only where the caller left them unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "sparemesh") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only when neither that setting nor
    ``SparkContext.setCheckpointDir`` gives one (a local test run) is a temporary folder made.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="sparemesh-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def checkpointed(df):
    """Materialise ``df`` reliably so that later passes see the very same partitions."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """``df`` as a Parquet table in the shared checkpoint folder: computed once, and later readers fetch only the columns they use."""
    folder = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df, *keys):
    """``df`` dealt over all cores by ``keys``, for work that is heavy per row.

    A small table may be one file with one row group, which Spark reads as one task, however many rows it has. The number of parts is
    given, so the adaptive planner does not join small parts again.
    """
    spark = df.sparkSession
    count = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(count, *keys)

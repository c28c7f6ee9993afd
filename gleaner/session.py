"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans are written for; all are plain Spark SQL options.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and local benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(master).appName("gleaner")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for name, value in {**RUNTIME_OPTIONS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's checkpoint directory.

    Where a local session names none, a temporary folder is set up.  A cluster
    that names none is an error, since a machine-local folder would be lost
    with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="gleaner-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system, as the cluster sees them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the driver ends."""
    root = f"{shared_dir(spark).rstrip('/')}/gleaner-{spark.sparkContext.applicationId}"
    path, store = _hadoop(spark, root)
    if not store.exists(path):
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


WIDE_BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch, for rows that carry whole texts.

    At Spark's default of 10,000 a batch of long texts takes hundreds of megabytes on both sides
    of the Python boundary.  A value that the session sets itself is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(WIDE_BATCH_ROWS))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows to the shared folder and reading them back.

    The written table survives lost executors, and its known size lets the
    planner broadcast it where it turns out small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Written intermediate tables of one job.

    As a context they are deleted when it ends, so the job's result must be written by then.
    Rows that are returned unwritten may go on reading them where there is no context: then
    they go with the application's scratch folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self.count = 0

    def __enter__(self) -> "Steps":
        return self

    def __exit__(self, *exc: object) -> None:
        path, store = _hadoop(self.spark, self.root)
        store.delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write rows under the job's folder and read them back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

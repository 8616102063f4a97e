"""Session helpers: where intermediate results are settled, and a session for tests and benches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Set by local_session() where the caller brings no spark.checkpoint.dir: tests and benches on one machine.
LOCAL_SHARED_DIR = "/tmp/basketflow-shared"


def local_session(cores: str = "*", shuffle_partitions: int = 8, shared: str = LOCAL_SHARED_DIR) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("basketflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and settled tables, as ``spark.checkpoint.dir`` names it.

    A local session that names none gets ``LOCAL_SHARED_DIR``; a cluster must name one.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = LOCAL_SHARED_DIR
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder, in the folder of this application."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    What was computed stays computed: later uses read only the columns they
    need, see the table's real size, and survive the loss of an executor.
    The table belongs to the application: ``clear_settled`` deletes it.
    """
    path = fresh_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_settled(spark: SparkSession) -> None:
    """Deletes every table this application has settled; results that still read them must be written first."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")


class Scratch:
    """Tables settled on the way to a result, deleted when the block ends.

    >>> with Scratch(spark) as scratch:
    ...     steps = scratch.settle(df)
    ...     result = settle(build(steps))
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.tables:
            _delete(self.spark, path)
        self.tables = []

    def settle(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "scratch")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, settled: DataFrame) -> None:
        """Deletes a table of this block that no later step reads."""
        for _, path in [t for t in self.tables if t[0] is settled]:
            _delete(self.spark, path)
        self.tables = [t for t in self.tables if t[0] is not settled]


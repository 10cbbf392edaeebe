"""Session helpers: a local test session and tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With this on, Spark deletes the shuffle files of an execution as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench, not for a cluster."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessel")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or by ``setCheckpointDir`` before.

    Where neither is set, a local session gets a temporary folder; elsewhere that would lose data, so it is an error.
    """
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if (named := context._jsc.sc().getCheckpointDir()).isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessel-"))
        named = context._jsc.sc().getCheckpointDir()
    return named.get().rstrip("/")


#: Narrow rows that one task writes, where a bound of the rows is known.
TASK_ROWS = 200_000


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as a table to the shared folder and read back, which cuts its lineage.

    The shuffle files that made it are deleted at once, as nothing reads them again. ``release`` deletes the table.
    ``rows``, a bound of its narrow rows, saves small tables from being written by as many tasks as the session shuffles to.
    Without its native library, Hadoop starts a ``chmod`` for every file that a task creates on a local disk, and until
    that runs, the new process shows the memory of the executor as its own.
    """
    if rows is not None:
        df = df.coalesce(1 + rows // TASK_ROWS)
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/tessel-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    done = spark.read.schema(df.schema).parquet(path)
    done._written = path
    return done


def release(*written: DataFrame) -> None:
    """Delete tables that ``checkpoint`` wrote, once nothing that is still to run reads them."""
    for df in written:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

"""Session helpers: lineage cuts that survive executor loss, and set-up for tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "offerlens", cpus: str = "*", **conf: str) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir.

    Only when nothing is configured and the master is local (tests) a
    temporary folder is taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="offerlens-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; for wide intermediate tables cheaper than a checkpoint."""
    return stored_at(df, shared_folder(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """``stored`` at a path of ``shared_folder``, for a table that its reader removes with ``free_finished`` when its own result is written."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_finished(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no result reads any more, and let Spark remove the shuffle files of finished jobs.

    Its cleaner waits for a collection of the driver's memory, which may come late.
    """
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark.sparkContext._jvm.System.gc()

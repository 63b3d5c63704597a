"""Session settings: a local session for tests and the bench, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def local_session(name: str = "armwatch", cpus: int | str = "*", memory: str = "8g",
                  partitions: int = 8) -> SparkSession:
    """A session of one machine, with a folder of its own where none is named.

    Sides of a join over 1 MB are shuffled, not broadcast: a small file is one row group, which
    one task reads, and after a broadcast join the same task would do all that follows.
    """
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.autoBroadcastJoinThreshold", "1m")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables and checkpoints that all executors share.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset, a session of one
    machine (master ``local``) takes a folder of its own; a cluster must name one.
    """
    named = spark.conf.get(FOLDER, None)
    context = spark.sparkContext
    if named:
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {FOLDER} to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="armwatch-"))
    return context.getCheckpointDir()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for one written intermediate table, removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/armwatch/{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage by a checkpoint on the shared folder.

    For aggregates that several branches of a plan read: the source is scanned once, and a lost
    executor costs no recomputation. Spark removes a checkpoint when the frame is collected as
    garbage (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``settled`` as a Parquet table, so that Spark knows its size when it plans a join."""
    path = f"{scratch_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

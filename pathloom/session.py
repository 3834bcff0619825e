"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pathloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        wanted = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not wanted:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            wanted = tempfile.mkdtemp(prefix="pathloom-")
        sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back.

    Lost executors cost nothing that was written; unlike a cached frame the table
    also has sizes that the planner can use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Below so many bytes for each core a table is dealt anew before long work on its rows.
SPREAD_BYTES = 8 << 20


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Tables of fewer bytes are left to the planner's choice of join, which may broadcast them.
HELD_BYTES = 1 << 20


def held(df: DataFrame) -> DataFrame:
    """df as the right side of a join that has a row or few a key: a task holds its share of df by hash, the left side streams by.

    Merge joins sort both sides instead, so a task holds all rows of its keys, and a key with many rows whole.
    """
    return df.hint("shuffle_hash") if plan_bytes(df) >= HELD_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small; its file may have one row group, and one task would do all the work.

    Large tables have more splits than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < SPREAD_BYTES * cores else df


def dropped(df: DataFrame) -> None:
    """Removes a table made by written() that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Removes all tables that this session wrote to the shared folder; frames that read them are then useless."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch on its way to a Python worker; long texts would else fill 64 MB each.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Prepares Python workers: small Arrow batches, and this package sent to them, once in a session's life."""
    sc, limit = spark.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(limit).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(limit, str(BATCH_BYTES))
    if getattr(sc, "_pathloom_sent", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.realpath(os.path.join(tempfile.mkdtemp(prefix="pathloom-"), "pathloom.zip"))
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("pathloom", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._pathloom_sent = True

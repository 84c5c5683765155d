"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, name: str = "tallyloom", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests, one machine), a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("tallyloom.scratch", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("tallyloom.scratch", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


#: Bytes of Parquet for which a task is taken where rows are sorted or summed.
BYTES_A_TASK = 4 << 20


#: Bytes of Parquet up to which a table is sent to every task where rows look up its keys.
SMALL_BYTES = 8 << 20


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads."""
    spark, size = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return size


def tasks_for(df: DataFrame) -> int | None:
    """How many tasks the files that df reads ask for; None where the session's number is enough (below it Spark joins small partitions by itself)."""
    tasks = -(-file_bytes(df) // BYTES_A_TASK)
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys into tasks whose number grows with the files that df reads, so that a task's share does not."""
    tasks = tasks_for(df)
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def looked_up(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """df joined with a table by key: the table is broadcast while its files are small, else both are dealt by key into tasks whose number grows with the files."""
    return df.join(F.broadcast(table), key) if file_bytes(table) <= SMALL_BYTES else dealt(df, key).join(table, key)


def cut(df: DataFrame) -> DataFrame:
    """A checkpointed copy of df: later jobs restart from the shared folder, not from df's lineage."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df written to the shared folder as Parquet and read again (columnar: later reads prune columns)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote. Nothing that is still to be computed may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def repo_on_worker_path() -> None:
    """Let Python workers started from this process import the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    parts = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in parts:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *[p for p in parts if p]])

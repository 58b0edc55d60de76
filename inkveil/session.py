"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkveil")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.extraJavaOptions", "-Xss8m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder all executors see, below the one the cluster names for checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a shared folder, or name a path explicitly")
    return f"{root.rstrip('/')}/{name}"


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="inkveil-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for intermediate tables that all executors see. A session on one machine that names no shared folder
    uses one of its process; a cluster has to name one."""
    on_one_machine = spark.sparkContext.master.split("[")[0] == "local"
    if on_one_machine and not spark.conf.get("spark.checkpoint.dir", None):
        path = f"file://{_own_folder()}/{name}"
    else:
        path = shared_folder(spark, name)
    return f"{path}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, for steps that read it more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

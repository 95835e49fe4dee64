"""Tables in the shared folder that spark.checkpoint.dir names, until the driver ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine only where all runs on it and none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    if not _made:
        atexit.register(_clear)
    made = f"{shared(spark)}/loomline-{name}-{uuid.uuid4().hex}"
    _made.add(made)
    return made


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    for path in _made if spark else ():
        try:
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

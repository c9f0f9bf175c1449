"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two collections of garbage at least.
TIDY_SECONDS = 5
_tidied = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local folder serves a session of one machine; on a cluster, executors would not share it, so
    that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder belongs to the cluster then
        return


def _tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, else shuffle files that no plan needs stay until it happens to; now and then only."""
    if time.monotonic() - _tidied[0] > TIDY_SECONDS:
        _tidied[0] = time.monotonic()
        spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that it was running.  The table goes at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidentia/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(drop, spark, path)
    _tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of ``stored`` that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop(df.sparkSession, path)

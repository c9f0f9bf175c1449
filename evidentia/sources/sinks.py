"""Sinks: tables, idempotent appends, manifests and logs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.keyed import KeyedTable


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def create(spark: SparkSession, path: str, schema: str) -> bool:
    """An empty Parquet table, if there is none; whether it was made."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(f"{path}/bucket=00")  # the layout of KeyedTable
    return True


def upsert(df: DataFrame, path: str, key: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> KeyedTable:
    """Append rows whose key the table does not have; a run that is repeated adds nothing.  Tells what was read and added."""
    table = KeyedTable(df.sparkSession, path, key)
    table.upsert(df, finish)
    return table


def record(spark: SparkSession, path: str, **values) -> None:
    """A small JSON file that is there whole or not at all: it is written under another name and moved."""
    target, draft = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.draft"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(values).encode()))
    out.close()
    fs.rename(draft, target)


def dual(df: DataFrame, path: str) -> None:
    """The same rows as Parquet and as CSV."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}.csv")


def weekly_csv(df: DataFrame, path: str) -> None:
    """CSV files in a folder per domain and week; a domain's week that is written again takes the place of the old one."""
    named = df.withColumn("domain", F.replace("domain", F.lit("."), F.lit("_")))
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "week")
    writer.option("header", "true").option("escape", '"').csv(path)


def json_file(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def mark(spark: SparkSession, path: str, done: DataFrame) -> None:
    """Add (keys, status) rows to a manifest."""
    done.write.mode("append").parquet(path)


def log_run(spark: SparkSession, path: str, **values) -> None:
    """One JSON line per run."""
    spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).coalesce(1).write.mode("append").json(path)

"""Scans of evidence files: CSV, Parquet, plain text, JSON."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia import schemas as S
from evidentia.operators.curate import union_tables
from evidentia.sources import csv_scan


def listing(spark: SparkSession, prefix: str) -> DataFrame:
    """s3_key, bytes and kind of each file under a prefix: csv, parquet or text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix).select(F.col("path").alias("s3_key"), F.col("length").alias("bytes"))
    low = F.lower("s3_key")
    return files.withColumn("kind", F.when(low.endswith(".csv"), "csv").when(low.endswith(".parquet"), "parquet").otherwise("text"))


def csv_rows(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """All columns as strings, null as empty.  Rows with more fields than columns go; shorter ones are filled up.

    Columns are those of the header line, which the files of one path share, unless a schema names them.  Files are
    read in ranges, several tasks a file, and row_index counts a file's rows from 1.
    """
    records, totals = csv_scan.records(spark, path)
    if schema is None:
        first = records.where("number = 0").select(F.min("text")).first()[0]
        names = next(csv.reader([(first or "text").lstrip("\ufeff")]))
    else:
        names = T.StructType.fromDDL(schema).names
    rows = csv_scan.parsed(records.where("number > 0"), names)
    return csv_scan.numbered(rows, totals).na.fill("").select(*names, "s3_key", "row_index")


def parquet_rows(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """All columns as strings, null as empty.  Row numbers come from the files, so nothing is shuffled."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]").options(**options)
    rows = read.parquet(*([path] if isinstance(path, str) else path))
    named = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns), F.col("_metadata.file_path").alias("s3_key"), (F.col("_metadata.row_index") + 1).cast("int").alias("row_index"))
    return named.na.fill("", subset=rows.columns)


def text_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """One row per file: its whole text.  Without a pattern, all files whose name ends as neither CSV nor Parquet."""
    more = {"pathGlobFilter": glob} if glob else {}
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, **more)
    if not glob:
        rows = rows.where(~F.lower("_metadata.file_path").rlike(r"\.(csv|parquet)$"))
    return rows.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("s3_key"), F.lit(1).alias("row_index"))


def rows(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("csv", "parquet", "text")) -> DataFrame:
    """All files under a path, one table: by their kind, of which any may be absent; what is neither CSV nor Parquet is text."""
    by_kind = {"csv": csv_rows, "parquet": parquet_rows, "text": text_files}
    there = {r.kind for r in listing(spark, path).select("kind").distinct().collect()}  # at most three
    found = [by_kind[k](spark, path) for k in kinds if k in there]
    return union_tables(*found) if found else spark.createDataFrame([], "text string, s3_key string, row_index int")


def json_rows(spark: SparkSession, path: str, schema: str = S.GOLD) -> DataFrame:
    """An array of objects, as the gold set has it."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file's whole JSON text, for from_json."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("path"))

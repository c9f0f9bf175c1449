"""Published datasets: folders of files by split, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dataset(spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet", schema: str | None = None, streaming: bool = False, most_files: int = 1000) -> DataFrame:
    """The rows of a dataset, or of its split: the files whose names begin with the split's name.

    ``streaming`` reads the files as a stream, ``most_files`` a batch, so that nothing is read before a query asks for
    it and a query that stops goes on where it was.  A stream needs a schema; without one, that of the files is taken.
    """
    options = {"pathGlobFilter": f"{split}[-._]*"} if split else {}
    if fmt == "csv":
        options |= {"header": "true", "multiLine": "true", "escape": '"'}
    table = spark.read.format(fmt).options(**options)
    if not streaming:
        return (table.schema(schema) if schema else table).load(path)
    kind = schema or table.load(path).schema
    return spark.readStream.format(fmt).schema(kind).options(**options, maxFilesPerTrigger=str(most_files)).load(path)

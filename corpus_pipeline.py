"""A corpus pipeline of five stages; each is written as Parquet before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import language_id, near_dedup, packing, source_mix, suffix_dedup
from evidentia.llm.common import stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is found.

    What has no letter goes, null and empty texts among it, and what scores below the model's limit, the least score of
    a training text for its own language.  If there is nothing to learn from, all documents with a letter stay.
    Repeated rows meet one verdict; doc_ids of any kind and other columns, whatever their names, stay as they are.
    """
    names = ("_identified", "_identified_score")
    model = language_id.fit_language_model(docs)
    found = language_id.with_language(docs, model, names)
    enough = F.lit(True) if model is None else F.col(names[1]) >= model.limit
    return found.where(~F.col(names[0]).eqNullSafe("und") & enough).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates; of repeated rows one; those without a doc_id or words stay."""
    return near_dedup.drop_near_duplicates(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove bytes under strings that also start earlier; a document of which none is left goes.

    Null and blank texts stay as they are; rows without a doc_id come last in the order.
    """
    return suffix_dedup.remove_repeats(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the sources' targets ask for, in the order of the curriculum.

    Rows are taken one by one, whatever their doc_id; a text without words is never taken; a null source is a source.
    """
    return source_mix.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into bins: one row per piece.  Each row is packed, also repeated ones and those without words."""
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing sources to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Not expressible in SQL; tests hold run() against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Each earlier stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs

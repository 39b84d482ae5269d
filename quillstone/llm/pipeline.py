"""A corpus pipeline of five stages, each applying one operator to all that the one before it kept.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``.  In every
stage null texts count as empty, null ids and repeated rows take part like others, extra columns stay
whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.materialize import materialize

from . import decontam, mixing, neardup, sharding, toxicity

SHARD_BYTES = 32 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from ``labels``.

    Rows of equal text are kept or dropped together, by the text alone; without any labels all stay.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least id, null ids last.

    Empty and null texts are one class; texts without words are classed by their bytes; of repeated
    rows one stays.
    """
    return neardup.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go; null and empty texts hold none and stay."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order: part by part, row by row.

    Null sources are one source; rows without words come along with the words around them.
    """
    return mixing.mix(docs)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its place in the training order, ``(order_file, order_row)``.

    The place is read off the files that ``docs`` comes from, whose names and rows ascend with
    training time; for a table that is not read from files it is the place in its partitions.
    Copies that the mix took more than once lie in one shard, or in numbered parts of one.
    """
    return sharding.shard(with_order(docs), SHARD_BYTES)


def with_order(docs: DataFrame) -> DataFrame:
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("order_file", "order_row")]
    try:
        part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("int"), F.lit(0))
        return docs.select(*own, part.alias("order_file"), F.col("_metadata.row_index").alias("order_row"))
    except AnalysisException:  # no files behind it
        return docs.select(*own, F.spark_partition_id().alias("order_file"), F.monotonically_increasing_id().alias("order_row"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("near duplicates", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
    ("sharding", stage_shard),
]

#: A trained classifier and sampled sketches have no SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

"""Pseudo-relevance feedback: queries borrow terms from their first results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import STOP_WORDS
from quillstone.plans.limits import least, share

from .index import Index


@dataclass(frozen=True)
class ExpansionConfig:
    """Results fed back, terms borrowed from them at most, and the share that the question itself keeps."""

    feedback_docs: int = field(default=5)
    feedback_terms: int = field(default=10)
    original_weight: float = field(default=0.6)

    def __post_init__(self) -> None:
        least("feedback_docs", self.feedback_docs, 1)
        least("feedback_terms", self.feedback_terms, 0)
        share("original_weight", self.original_weight)


def feedback_weights(feedback: DataFrame) -> DataFrame:
    """``(query_id, chunk_index, weight)`` summing to 1 per query, from ``feedback(query_id, chunk_index, score)``.

    Scores are shifted only if one is negative; if nothing is left all weigh the same.
    """
    w = Window.partitionBy("query_id")
    f = feedback.withColumn("shifted", F.col("score") - F.least(F.lit(0.0), F.min("score").over(w)))
    f = f.withColumn("total", F.sum("shifted").over(w)).withColumn("n", F.count("*").over(w))
    return f.select("query_id", "chunk_index", F.when(F.col("total") > 0, F.col("shifted") / F.col("total")).otherwise(1.0 / F.col("n")).alias("weight"))


def relevance_model(index: Index, feedback: DataFrame, exclude: DataFrame, top_terms: int) -> DataFrame:
    """``(query_id, term, weight)``: the best terms of the feedback chunks, weights summing to 1 per query.

    Stop words, whole numbers and the terms in ``exclude(query_id, term)`` are left out.
    """
    d = feedback_weights(feedback).join(index.postings_of(feedback).select("chunk_index", "term", "tf", "len"), "chunk_index")
    d = d.where(~F.col("term").isin(*STOP_WORDS) & ~F.col("term").rlike("^[0-9]+$")).join(exclude.select("query_id", "term"), ["query_id", "term"], "left_anti")
    p = d.groupBy("query_id", "term").agg(F.sum(F.col("weight") * F.col("tf") / F.col("len")).alias("p"))
    p = p.join(index.terms.select("term", "idf_bm25"), "term").select("query_id", "term", F.round(F.col("p") * F.col("idf_bm25"), 12).alias("value")).where("value > 0")
    w = Window.partitionBy("query_id")
    best = p.withColumn("r", F.row_number().over(w.orderBy(F.col("value").desc(), "term"))).where(F.col("r") <= top_terms)
    return best.select("query_id", "term", (F.col("value") / F.sum("value").over(w)).alias("weight"))


def query_distribution(terms: DataFrame) -> DataFrame:
    """``(query_id, term, weight)``: each query's own term frequencies over its length."""
    w = Window.partitionBy("query_id")
    return terms.select("query_id", "term", (F.col("qtf") / F.sum("qtf").over(w)).alias("weight"))


def expand(index: Index, terms: DataFrame, pool: DataFrame, config: ExpansionConfig) -> DataFrame:
    """``(query_id, term, weight, borrowed)``: own distribution blended with that of the feedback.

    ``pool`` has ``pool_rank``; the first ``feedback_docs`` are fed back.  A query that borrows nothing
    keeps its own distribution whole.
    """
    own = query_distribution(terms)
    if config.original_weight >= 1 or config.feedback_terms == 0:
        return own.withColumn("borrowed", F.lit(False))
    new = relevance_model(index, pool.where(F.col("pool_rank") <= config.feedback_docs).select("query_id", "chunk_index", "score"), terms, config.feedback_terms)
    a = config.original_weight
    some = new.select("query_id").distinct().withColumn("some", F.lit(True))
    own = own.join(some, "query_id", "left").select("query_id", "term", F.when(F.col("some"), F.lit(a) * F.col("weight")).otherwise(F.col("weight")).alias("weight"), F.lit(False).alias("borrowed"))
    return own.unionByName(new.select("query_id", "term", (F.lit(1 - a) * F.col("weight")).alias("weight"), F.lit(True).alias("borrowed")))

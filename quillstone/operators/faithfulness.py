"""Faithfulness of answers to the passages they were drawn from.

``answers(query_id, text, citations)``, ``passages(query_id, doc_id, text)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx


MEASURES = tuple(f"{what}_{how}" for what, how in (("sentence", "grounding"), ("token", "grounding"), ("citation", "precision"), ("citation", "recall")))


def answer_sentences(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


def supporting_docs(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """``(query_id, pos, doc_id)``: documents with a passage that holds the sentence's token stream.

    Only sentences and passages of one query meet; a sentence without tokens has no support.
    """
    s = answer_sentences(answers).select("query_id", "pos", tx.canonical(F.col("sentence")).alias("needle")).where(F.col("needle") != " ")
    p = passages.select("query_id", "doc_id", tx.canonical(F.col("text")).alias("hay"))
    return s.join(p, "query_id").where(F.contains("hay", "needle")).select("query_id", "pos", "doc_id").distinct()


def report(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """``(query_id, sentence_grounding, token_grounding, citation_precision, citation_recall)``; 0 where undefined."""
    support = supporting_docs(answers, passages)
    n = answer_sentences(answers).groupBy("query_id").agg(F.count("*").alias("n"))
    cited = answers.select("query_id", F.explode(F.array_distinct("citations")).alias("doc_id"))
    marked = support.join(cited.withColumn("cited", F.lit(1)), ["query_id", "doc_id"], "left")
    each = marked.groupBy("query_id", "pos").agg(F.max(F.coalesce("cited", F.lit(0))).alias("credited"))
    grounded = each.groupBy("query_id").agg(F.count("*").alias("grounded"), F.sum("credited").alias("credited"))
    used = cited.join(support.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("used"))
    t = answers.select("query_id", F.posexplode(tx.content_tokens(F.col("text"))).alias("at", "token"))
    known = passages.select("query_id", F.explode(tx.tokens(F.col("text"))).alias("token")).distinct().withColumn("known", F.lit(1))
    t = t.join(known, ["query_id", "token"], "left").groupBy("query_id").agg(F.avg(F.coalesce("known", F.lit(0))).alias("token_grounding"))
    out = answers.select("query_id", F.size(F.array_distinct("citations")).alias("nc"))
    for part in (n, grounded, used, t):
        out = out.join(part, "query_id", "left")
    z = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(name)
    return out.select(
        "query_id",
        z(F.col("grounded") / F.col("n"), "sentence_grounding"),
        z(F.col("token_grounding"), "token_grounding"),
        z(F.when(F.col("nc") > 0, F.coalesce("used", F.lit(0)) / F.col("nc")), "citation_precision"),
        z(F.col("credited") / F.col("grounded"), "citation_recall"),
    )


def mean_report(reports: DataFrame) -> DataFrame:
    """One row: the mean of each measure, 0 without answers."""
    return reports.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in MEASURES])


def cited_gold(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """``(query_id, cited_gold)``: whether a cited document is relevant."""
    c = answers.select("query_id", F.explode("citations").alias("item")).join(gold.select("query_id", "item"), ["query_id", "item"], "left_semi").select("query_id").distinct().withColumn("y", F.lit(1))
    return answers.select("query_id").join(c, "query_id", "left").select("query_id", F.coalesce("y", F.lit(0)).alias("cited_gold"))


def weakest(reports: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` answers of least token grounding: a report, so it is limited by nature."""
    return reports.orderBy("token_grounding", "query_id").limit(n)

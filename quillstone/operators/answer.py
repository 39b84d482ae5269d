"""Extractive answers with citations, and prompts for an outside model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from .search import PLACES

NOTHING = "Nothing in these documents answers the question."


def term_weights(queries: DataFrame, results: DataFrame) -> DataFrame:
    """``(query_id, term, weight)``: how rare each content term of a question is among its results."""
    t = queries.select("query_id", F.explode(F.array_distinct(tx.content_tokens(F.col("question")))).alias("term"))
    r = results.select("query_id", "rank", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    df = r.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    return t.join(n, "query_id").join(df, ["query_id", "term"], "left").select("query_id", "term", (F.log((1.0 + F.col("n")) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0).alias("weight"))


def sentence_scores(queries: DataFrame, results: DataFrame) -> DataFrame:
    """``(query_id, rank, pos, sentence, doc_id, chunk_id, score)`` of the sentences that cover a term.

    Coverage over the root of the sentence's distinct tokens, discounted by the rank of its chunk.
    Chunk texts are split anew; headings say nothing and are passed over.
    """
    s = results.select("query_id", "rank", "doc_id", "chunk_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).where(~tx.is_heading(F.col("sentence")))
    s = s.withColumn("tokens", F.array_distinct(tx.tokens(F.col("sentence"))))
    hit = s.select("query_id", "rank", "pos", F.explode("tokens").alias("term")).join(term_weights(queries, results), ["query_id", "term"])
    cover = hit.groupBy("query_id", "rank", "pos").agg(F.sum("weight").alias("coverage"))
    return s.join(cover, ["query_id", "rank", "pos"]).select("query_id", "rank", "pos", "sentence", "doc_id", "chunk_id", F.round(F.col("coverage") / F.sqrt(F.size("tokens").cast("double")) / F.col("rank"), PLACES).alias("score")).where("score > 0")


def extractive(queries: DataFrame, results: DataFrame, max_sentences: int = 3) -> DataFrame:
    """``(query_id, text, citations, method, supporting_chunks)``, one answer per query.

    ``results(query_id, rank, doc_id, chunk_id, text)``.  Best sentences first, each string once.
    Without results the answer says so; if no sentence scores, it is the first chunk whole.
    """
    if max_sentences < 1:
        raise ValueError("max_sentences must be positive")
    s = sentence_scores(queries, results)
    order = [F.col("score").desc(), "rank", "pos"]
    once = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "sentence").orderBy(*order))).where("r = 1")
    best = once.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("r") <= max_sentences)
    # at most max_sentences rows per query
    picked = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "sentence", "doc_id", "chunk_id"))).alias("p"))
    first = results.where("rank = 1").select("query_id", F.col("text").alias("t1"), F.col("doc_id").alias("d1"), F.col("chunk_id").alias("c1"))
    a = queries.select("query_id").join(first, "query_id", "left").join(picked, "query_id", "left")
    none = F.array().cast("array<string>")
    pick = lambda f, one: F.when(F.col("p").isNotNull(), F.array_distinct(F.transform("p", lambda x: x[f]))).when(F.col("t1").isNotNull(), F.array(one)).otherwise(none)
    text = F.when(F.col("p").isNotNull(), F.array_join(F.transform("p", lambda x: x["sentence"]), "\n")).otherwise(F.coalesce("t1", F.lit(NOTHING)))
    return a.select("query_id", text.alias("text"), pick("doc_id", F.col("d1")).alias("citations"), F.lit("extractive").alias("method"), pick("chunk_id", F.col("c1")).alias("supporting_chunks"))


def formatted(answers: DataFrame) -> DataFrame:
    """``(query_id, formatted)``: the text, then its sources if it has any."""
    tail = F.when(F.size("citations") > 0, F.concat(F.lit("\n\nSources: "), F.array_join("citations", ", "))).otherwise(F.lit(""))
    return answers.select("query_id", F.concat("text", tail).alias("formatted"))


def prompts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """``(query_id, prompt)``: numbered sources and the question."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("doc_id"), F.lit(") "), F.col("text"))
    r = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("p"))  # k rows
    body = F.coalesce(F.array_join(F.transform("p", lambda x: x["b"]), "\n\n"), F.lit(""))
    return queries.join(r, "query_id", "left").select("query_id", F.concat(F.lit("Sources:\n"), body, F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))


class ModelAnswerer:
    """Answers by an outside model: ``client(prompt) -> text`` is called in the executors, in batches.

    Without a client there is nobody to ask, and answering is an error.
    """

    def __init__(self, client: Callable[[str], str] | None = None, name: str = "model"):
        self.client, self.name = client, name

    @property
    def available(self) -> bool:
        return self.client is not None

    def answer(self, queries: DataFrame, results: DataFrame) -> DataFrame:
        if not self.available:
            raise RuntimeError("no model client is configured; use the extractive answerer")
        client = self.client

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"query_id": b["query_id"], "text": [client(p).strip() for p in b["prompt"]]})

        kind = dict(queries.dtypes)["query_id"]
        texts = prompts(queries, results).mapInPandas(ask, f"query_id {kind}, text string")
        cited = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "chunk_id"))).alias("p"))
        none = F.array().cast("array<string>")
        every = lambda f: F.coalesce(F.transform("p", lambda x: x[f]), none).alias({"doc_id": "citations", "chunk_id": "supporting_chunks"}[f])
        return texts.join(cited, "query_id", "left").select("query_id", "text", every("doc_id"), F.lit(f"model:{self.name}").alias("method"), every("chunk_id"))

"""Continuous ingest: what needs no corpus statistics is computed as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators.chunking import check_sizes, spans


def stream_chunks(documents: DataFrame, target: int = 120, overlap: int = 30) -> DataFrame:
    """``(doc_id, chunk_ord, chunk_id, text)`` of a stream or a table of ``(doc_id, text)``; stateless.

    Global chunk indexes, document frequencies and lengths need a batch pass over what has arrived.
    """
    check_sizes(target, overlap)
    d = documents.select(F.col("doc_id").cast("string").alias("doc_id"), tx.sentences(F.col("text")).alias("sents"))
    d = d.withColumn("spans", spans(F.transform("sents", lambda s: F.size(tx.tokens(s))), target, overlap))
    text = F.transform("spans", lambda s: F.array_join(F.slice("sents", s["a"] + 1, s["b"] - s["a"] + 1), "\n"))
    c = d.select("doc_id", F.posexplode(text).alias("chunk_ord", "text"))
    return c.select("doc_id", "chunk_ord", F.concat("doc_id", F.lit("::"), F.col("chunk_ord").cast("string")).alias("chunk_id"), "text")

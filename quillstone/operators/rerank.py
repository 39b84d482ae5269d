"""Maximal marginal relevance and redundancy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.limits import share

from .index import Index
from .search import PLACES


def normalize_scores(pool: DataFrame) -> DataFrame:
    """``pool`` with ``relevance``: scores scaled to 0..1 per query, all 1 if they are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return pool.withColumn("relevance", F.when(high - low > 0, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))


def pool_similarities(index: Index, pool: DataFrame) -> DataFrame:
    """``(query_id, a, b, sim)`` of the pairs of chunks in each query's pool that share a term, both ways."""
    v = pool.select("query_id", "chunk_index").join(index.postings_of(pool).select("chunk_index", "term", "w"), "chunk_index")
    x, y = v.select("query_id", "term", F.col("chunk_index").alias("a"), F.col("w").alias("wa")), v.select("query_id", "term", F.col("chunk_index").alias("b"), F.col("w").alias("wb"))
    s = x.join(y, ["query_id", "term"]).where("a < b").groupBy("query_id", "a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), PLACES).alias("sim"))
    return s.unionByName(s.select("query_id", F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def mmr(pool: DataFrame, similarities: DataFrame, k: int, lambda_: float = 0.7) -> DataFrame:
    """``(query_id, chunk_index, score, mmr_rank)``: greedy choice by relevance less redundancy.

    ``pool(query_id, chunk_index, score, pool_rank)`` is bounded per query by the candidate limit, so a
    query's greedy loop is a small group; ties keep the pool's order; pairs without a row in
    ``similarities(query_id, a, b, sim)`` have similarity 0.
    """
    share("lambda_", lambda_)
    p = normalize_scores(pool.select("query_id", "chunk_index", "score", "pool_rank"))
    kind = dict(pool.dtypes)

    def choose(cands: pd.DataFrame, sims: pd.DataFrame) -> pd.DataFrame:
        cands = cands.sort_values("pool_rank")
        sim = {(a, b): s for a, b, s in zip(sims["a"], sims["b"], sims["sim"])}
        left = list(zip(cands["chunk_index"], cands["relevance"]))
        worst = {c: 0.0 for c, _ in left}
        chosen = []
        while left and len(chosen) < k:
            i = max(range(len(left)), key=lambda i: (round(lambda_ * left[i][1] - (1 - lambda_) * worst[left[i][0]], PLACES), -i))
            c, _ = left.pop(i)
            chosen.append(c)
            for other, _ in left:
                worst[other] = max(worst[other], sim.get((other, c), 0.0))
        out = cands.set_index("chunk_index").loc[chosen].reset_index() if chosen else cands.iloc[:0]
        return pd.DataFrame({"query_id": out["query_id"], "chunk_index": out["chunk_index"], "score": out["score"], "mmr_rank": range(1, len(out) + 1)})

    s = similarities.select(F.col("query_id").alias("sq"), F.col("a").alias("a"), F.col("b").alias("b"), F.col("sim").alias("sim"))
    return p.groupBy("query_id").cogroup(s.groupBy("sq")).applyInPandas(choose, f"query_id {kind['query_id']}, chunk_index {kind['chunk_index']}, score double, mmr_rank int")


def mean_pairwise_similarity(results: DataFrame, similarities: DataFrame) -> DataFrame:
    """``(query_id, redundancy)``: mean similarity over unordered pairs of results; 0 for fewer than two."""
    n = results.where("chunk_index >= 0").groupBy("query_id").agg(F.count("*").alias("n"))
    a, b = results.select("query_id", F.col("chunk_index").alias("a")), results.select("query_id", F.col("chunk_index").alias("b"))
    total = similarities.where("a < b").join(a, ["query_id", "a"]).join(b, ["query_id", "b"]).groupBy("query_id").agg(F.sum("sim").alias("total"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(total, "query_id", "left").select("query_id", F.round(F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / pairs).otherwise(0.0), 9).alias("redundancy"))

"""Retrieval metrics over ``ranked(query_id, item, rank)``, ``gold(query_id, item)`` and all ``queries(query_id)``.

Every metric starts from the queries, so one that finds nothing counts as 0.  Gold items count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Numbers of results that are looked at.
CUTS = (1, 3, 5)


def _judged(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    g = gold.select("query_id", "item").distinct().withColumn("rel", F.lit(1))
    return ranked.join(g, ["query_id", "item"], "left").select("query_id", "item", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def per_query(queries: DataFrame, ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = CUTS) -> DataFrame:
    """``(query_id, k, hit, recall, precision)``; precision divides by the results there are."""
    q = queries.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    j = _judged(ranked, gold).select("query_id", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "item", "rank", "rel").where("rank <= k")
    a = j.groupBy("query_id", "k").agg(F.max("rel").alias("hit"), F.countDistinct(F.when(F.col("rel") == 1, F.col("item"))).alias("found"), F.avg("rel").alias("precision"))
    n = gold.select("query_id", "item").distinct().groupBy("query_id").agg(F.count("*").alias("gold"))
    z = F.lit(0.0)
    return q.join(a, ["query_id", "k"], "left").join(n, "query_id", "left").select("query_id", "k", F.coalesce(F.col("hit").cast("double"), z).alias("hit"), F.coalesce(F.col("found") / F.col("gold"), z).alias("recall"), F.coalesce("precision", z).alias("precision"))


def ndcg(queries: DataFrame, ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = CUTS, gains: DataFrame | None = None) -> DataFrame:
    """``(query_id, k, ndcg)``.  ``gains(query_id, item, gain)`` override gold and extend the ideal.

    A repeated item is credited where it first occurs, but its repeats keep their places.
    """
    g = gold.select("query_id", "item").distinct().withColumn("one", F.lit(1.0))
    if gains is not None:
        g = g.join(gains.select("query_id", "item", F.col("gain").cast("double").alias("gain")), ["query_id", "item"], "full_outer").select("query_id", "item", F.coalesce("gain", "one").alias("gain"))
    else:
        g = g.select("query_id", "item", F.col("one").alias("gain"))
    ksa = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    disc = lambda r: F.log2(F.col(r) + 1.0)
    ideal = g.where("gain > 0").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "item")))
    idcg = ideal.select("query_id", "r", "gain", ksa).where("r <= k").groupBy("query_id", "k").agg(F.sum(F.col("gain") / disc("r")).alias("idcg"))
    first = ranked.groupBy("query_id", "item").agg(F.min("rank").alias("rank")).join(g.where("gain > 0"), ["query_id", "item"])
    dcg = first.select("query_id", "rank", "gain", ksa).where("rank <= k").groupBy("query_id", "k").agg(F.sum(F.col("gain") / disc("rank")).alias("dcg"))
    q = queries.select("query_id").distinct().select("query_id", ksa)
    return q.join(idcg, ["query_id", "k"], "left").join(dcg, ["query_id", "k"], "left").select("query_id", "k", F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 9).alias("ndcg"))


def reciprocal_rank(queries: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``(query_id, rr)`` over the whole list."""
    r = _judged(ranked, gold).where("rel = 1").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").distinct().join(r, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr"))


def aggregate(queries: DataFrame, ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = CUTS, by: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """``(*within, slice, k, queries, hit, recall, precision, ndcg, mrr)``: means over all queries, and over those of each ``by``.

    ``within``: columns of ``queries`` that keep runs of different settings apart.
    """
    m = per_query(queries, ranked, gold, ks).join(ndcg(queries, ranked, gold, ks), ["query_id", "k"]).join(reciprocal_rank(queries, ranked, gold), "query_id")
    m = m.join(queries.select("query_id", *by, *within), "query_id")
    r6 = lambda c, name: F.round(F.avg(c), 6).alias(name)
    cols = [F.count("*").alias("queries"), r6("hit", "hit"), r6("recall", "recall"), r6("precision", "precision"), r6("ndcg", "ndcg"), r6("rr", "mrr")]
    keep = [F.col(c) for c in (*within, "k")]
    out = [*within, "slice", "k", "queries", "hit", "recall", "precision", "ndcg", "mrr"]
    if not by:
        return m.groupBy(*keep).agg(*cols).withColumn("slice", F.lit("all")).select(*out)
    name = F.when(F.grouping(by[0]) == 1, F.lit("all")).otherwise(F.col(by[0])).alias("slice")
    return m.groupingSets([keep, [*keep, F.col(by[0])]], *keep, F.col(by[0])).agg(name, *cols).select(*out)


def misses_partials(queries: DataFrame, ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``(query_id, outcome)`` of the queries with gold of which nothing (miss) or not all (partial) is in the top k."""
    p = per_query(queries, ranked, gold, (k,)).join(gold.select("query_id").distinct(), "query_id", "left_semi")
    return p.where("recall < 1").select("query_id", F.when(F.col("hit") == 0, F.lit("miss")).otherwise(F.lit("partial")).alias("outcome"))

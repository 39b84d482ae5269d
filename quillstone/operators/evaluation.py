"""Reports over a gold set: methods, expansion settings, diversity and faithfulness, each sweep as one plan.

A sweep tags the ids of its queries with the number of the setting, so that all settings are searched,
ranked and averaged together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.materialize import materialize
from quillstone.plans.spread import few

from . import answer as answers
from . import faithfulness as fa
from . import metrics as me
from . import rerank as rr
from . import search as rs
from .expansion import ExpansionConfig, expand

_MARK = "\x1f"


def parse_settings(text: str, feedback_docs: int = 5) -> list[tuple[str, ExpansionConfig]]:
    """``"terms:weight,terms:weight"`` as named settings; a missing weight is 0.8, blank parts are passed over."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        terms, _, weight = part.partition(":")
        e = ExpansionConfig(feedback_docs, int(terms), float(weight) if weight else 0.8)
        out.append((f"{e.feedback_terms}t a{e.original_weight:g}", e))
    return out


def describe(gold: DataFrame) -> DataFrame:
    """One row ``(questions, multiple)``: how many questions have relevant documents, and more than one, in ``gold(query_id, item)``."""
    return gold.groupBy("query_id").agg(F.countDistinct("item").alias("n")).agg(F.count("*").alias("questions"), F.count_if(F.col("n") > 1).alias("multiple"))


def table(rows: Sequence[dict], label: str, width: int = 15) -> str:
    """Lines of text: a heading, a rule, and a line per row with three places of each number; nothing for no rows."""
    if not rows:
        return ""
    names = [c for c in rows[0] if c != label]
    head = f"{label:<8}" + "".join(f"{c:>{width}}" for c in names)
    lines = [f"{r[label]!s:<8}" + "".join(f"{r[c]:>{width}.3f}" for c in names) for r in rows]
    return "\n".join([head, "-" * len(head), *lines])


def _tag(df: DataFrame, i: int) -> DataFrame:
    return df.withColumn("query_id", F.concat(F.lit(f"{i}{_MARK}"), F.col("query_id").cast("string")))


def _all(df: DataFrame, names: Sequence[str], label: str | None = None) -> DataFrame:
    """``df`` once for each setting, with tagged ids and the setting's name."""
    every = df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    every = every.withColumn("query_id", F.concat(F.col("__i").cast("string"), F.lit(_MARK), F.col("query_id").cast("string")))
    return every.withColumn(label, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__i") + 1)).drop("__i") if label else every.drop("__i")


def _documents(engine, pool: DataFrame, k: int, rank: str) -> DataFrame:
    """``(query_id, item, rank)``: the first k documents among the best 4k chunks of a pool."""
    best = materialize(pool.where(F.col(rank) <= 4 * k).select("query_id", "chunk_index", F.col(rank).alias("rank")))
    found = few(best).join(engine.index.chunks.select("chunk_index", "doc_id"), "chunk_index")
    return rs.ranked_docs(found, k).withColumnRenamed("doc_id", "item")


def _cuts(k: int, *more: int) -> tuple[int, ...]:
    return tuple(sorted({*more, k}))


def method_report(engine, queries: DataFrame, gold: DataFrame, k: int = 5, methods: Sequence[str] = rs.METHODS, by: Sequence[str] = ()) -> DataFrame:
    """``(method, slice, k, queries, hit, recall, precision, ndcg, mrr)`` at 1, 3 and k; both lists are ranked once for all methods."""
    size = max(engine.config.candidates, 4 * k)
    lists = engine._lists(queries, size)
    pools = [_tag(rs.pool(m, engine.config.rrf_k, *lists, size), i) for i, m in enumerate(methods)]
    every = pools[0]
    for p in pools[1:]:
        every = every.unionByName(p)
    ranked = materialize(_documents(engine, every, k, "pool_rank"))
    return me.aggregate(_all(queries, methods, "method"), ranked, _all(gold, methods), _cuts(k, 1, 3), by, ("method",))


def expansion_report(engine, queries: DataFrame, gold: DataFrame, settings: Sequence[tuple[str, ExpansionConfig]], k: int = 5, method: str = rs.HYBRID, by: Sequence[str] = ()) -> DataFrame:
    """``(setting, slice, k, queries, hit, recall, precision, ndcg, mrr)`` for each named setting.

    The first pass is shared; the second searches the questions of all settings at once.
    """
    names = [n for n, _ in settings]
    size = max(engine.config.candidates, 4 * k)
    pool, terms = materialize(engine._pool(queries, method, size)), rs.query_terms(queries)
    model = None
    for i, (_, e) in enumerate(settings):
        own = _tag(expand(engine.index, terms, pool, e), i)
        model = own if model is None else model.unionByName(own)
    model = materialize(model)
    borrowed = model.where("borrowed").select("query_id").distinct()
    second = engine._pool(queries, method, size, model.join(borrowed, "query_id", "left_semi").select("query_id", "term", "weight"))
    both = _all(pool, names).join(borrowed, "query_id", "left_anti").unionByName(second)
    ranked = materialize(_documents(engine, both, k, "pool_rank"))
    return me.aggregate(_all(queries, names, "setting"), ranked, _all(gold, names), _cuts(k, 1, 3), by, ("setting",))


def diversity_report(engine, queries: DataFrame, gold: DataFrame, lambdas: Sequence[float | None], k: int = 5, method: str = rs.HYBRID) -> DataFrame:
    """``(setting, k, queries, hit, mrr, redundancy, distinct_docs)`` for each lambda; None is the order of the pool.

    The greedy choice of k results is the beginning of that of 4k, so one choice serves both.
    """
    names = ["off" if x is None else f"{x:g}" for x in lambdas]
    size = max(engine.config.candidates, 4 * k)
    pool = materialize(engine._pool(queries, method, size))
    sims = materialize(rr.pool_similarities(engine.index, pool))
    order = None
    for i, x in enumerate(lambdas):
        one = pool.select("query_id", "chunk_index", F.col("pool_rank").alias("place")) if x is None else rr.mmr(pool, sims, 4 * k, x).select("query_id", "chunk_index", F.col("mmr_rank").alias("place"))
        order = _tag(one, i) if order is None else order.unionByName(_tag(one, i))
    order = materialize(order)
    first = order.where(F.col("place") <= k)
    q = _all(queries.select("query_id"), names, "setting")
    same = rr.mean_pairwise_similarity(first, _all(sims, names))
    distinct = few(first).join(engine.index.chunks.select("chunk_index", "doc_id"), "chunk_index").groupBy("query_id").agg(F.countDistinct("doc_id").alias("docs"))
    z = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(name)
    spread = q.join(same, "query_id", "left").join(distinct, "query_id", "left").groupBy("setting").agg(z("redundancy", "redundancy"), z(F.col("docs").cast("double"), "distinct_docs"))
    ranked = materialize(_documents(engine, order, k, "place"))
    hits = me.aggregate(q, ranked, _all(gold, names), _cuts(k, 1), (), ("setting",))
    return hits.join(spread, "setting").select("setting", "k", "queries", "hit", "mrr", "redundancy", "distinct_docs")


def _answered(engine, queries: DataFrame, ks: Sequence[int], max_sentences: int, settings: dict) -> tuple[DataFrame, DataFrame]:
    names = [str(k) for k in ks]
    found = materialize(engine.search(queries, max(ks), **settings))
    results = _all(found, names, "k").where(F.col("rank") <= F.col("k").cast("int"))
    results = materialize(results.drop("k", "components"))
    return materialize(answers.extractive(_all(queries, names), results, max_sentences)), results


def faithfulness_report(engine, queries: DataFrame, gold: DataFrame, ks: Sequence[int] = (3, 4, 5), max_sentences: int = 3, **settings) -> DataFrame:
    """``(k, queries, sentence_grounding, token_grounding, citation_precision, citation_recall, cited_gold)``: means for each number of results."""
    a, results = _answered(engine, queries, ks, max_sentences, settings)
    each = fa.report(a, results).join(fa.cited_gold(a, _all(gold, [str(k) for k in ks])), "query_id")
    k = F.element_at(F.array(*[F.lit(k) for k in ks]), F.substring_index("query_id", _MARK, 1).cast("int") + 1).alias("k")
    return each.groupBy(k).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in (*fa.MEASURES, "cited_gold")])

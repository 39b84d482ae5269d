"""The queries of the retrieval engine over the driver's tables.

Corpus: all ``documents``.  Questions: all ``benchmark`` items.  A document is relevant to an item if
it holds one of the item's sentences of four tokens or more.  Gains: labels.quality + 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, EngineConfig
from .functions import text as tx
from .operators import answer as ans
from .operators import evaluation as ev
from .operators import expansion as ex
from .operators import faithfulness as fa
from .operators import metrics as me
from .operators import rerank as rr
from .operators import search as rs
from .operators.chunking import chunk
from .operators.index import build_index, chunk_lengths, term_frequencies
from .plans.materialize import materialize, shared_folder
from .plans.spread import few, spread
from .sources import store

PRF = ex.ExpansionConfig(5, 5, 0.8)
K = 5


def documents(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("query_id"), F.coalesce("text", F.lit("")).alias("question"))


@dataclass
class Setup:
    engine: Engine
    queries: DataFrame

    @cached_property
    def gold(self) -> DataFrame:
        """Chunks are lines of whole sentences, so each sentence of a document is found in one of its chunks at least."""
        asked = self.queries.select("query_id", F.explode(F.array_distinct(F.filter(tx.sentences(F.col("question")), lambda s: F.size(tx.tokens(s)) > 3))).alias("sentence"))
        held = self.engine.index.chunks.select("doc_id", F.explode(F.split("text", "\n")).alias("sentence"))
        return materialize(few(materialize(asked)).join(held, "sentence").select("query_id", F.col("doc_id").alias("item")).distinct())


_kept: dict[tuple[str, str], Setup] = {}


def setup(spark: SparkSession, d: str) -> Setup:
    """The index of a corpus, built once a session and kept as tables in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _kept:
        _kept[key] = Setup(Engine(documents(spark, d), EngineConfig()), questions(spark, d))
    return _kept[key]


def r6(c: str):
    return F.round(c, 6).alias(c)


def q_normalize(spark, d):
    return spread(documents(spark, d), "doc_id").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("normal_md5"))


def q_tokenize(spark, d):
    t = tx.tokens(F.col("text"))
    return spread(documents(spark, d), "doc_id").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def q_tokenize_nostop(spark, d):
    t = tx.without_stop_words(tx.tokens(F.col("text")))
    return spread(documents(spark, d), "doc_id").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


HEADINGS = ("# One", "###### Six", "####### Seven", "#tag", "   ## Three blanks", "    # Four blanks", "plain", "#  ", "## Two\nlines")


def q_headings(spark, d):
    """Lines and headings of every document, and of a few lines made for it."""
    made = spark.createDataFrame([(f"made {i}", h) for i, h in enumerate(HEADINGS)], "doc_id string, line string").select("doc_id", F.array("line").alias("lines"))
    every = spread(documents(spark, d), "doc_id").select("doc_id", F.split("text", "\n").alias("lines")).unionByName(made)
    return every.select("doc_id", F.size("lines").alias("n_lines"), F.size(F.filter("lines", tx.is_heading)).alias("n_headings"))


def q_sentences(spark, d):
    s = spread(documents(spark, d), "doc_id").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_idx", "sentence"))
    return s.select("doc_id", "sent_idx", "sentence", F.size(tx.tokens(F.col("sentence"))).alias("n_tokens"))


def q_chunks(spark, d):
    return setup(spark, d).engine.index.chunks.drop("metadata")


def q_chunk_stats(spark, d):
    s = setup(spark, d).engine.stats()
    return s.select("documents", "chunks", "vocabulary", r6("mean_tokens"), "min_tokens", "max_tokens")


def q_term_freq(spark, d):
    return term_frequencies(setup(spark, d).engine.index.chunks)


def q_chunk_len(spark, d):
    return chunk_lengths(setup(spark, d).engine.index.chunks)


def q_doc_freq(spark, d):
    return setup(spark, d).engine.index.terms.select("term", "df")


def q_bm25_idf(spark, d):
    return setup(spark, d).engine.index.terms.select("term", F.round("idf_bm25", 9).alias("idf"))


def q_tfidf_idf(spark, d):
    return setup(spark, d).engine.index.terms.select("term", F.round("idf_tfidf", 9).alias("idf"))


def q_tfidf_vectors(spark, d):
    return setup(spark, d).engine.index.postings.select("chunk_index", "term", r6("w"))


def _list(t: DataFrame) -> DataFrame:
    return t.select("query_id", "rank", "chunk_index", r6("score"))


def q_bm25_scores(spark, d):
    s = setup(spark, d)
    return rs.bm25_totals(s.engine.index, rs.as_weights(rs.query_terms(s.queries))).select("query_id", "chunks", F.round("total", 4).alias("total"), r6("best"))


def q_dense_scores(spark, d):
    """Every chunk for every question, zeros included, as one line per question."""
    s = setup(spark, d)
    every = rs.dense_scores(s.engine.index, rs.as_weights(rs.query_terms(s.queries)))
    return every.groupBy("query_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("score") == 0).alias("zeros"), F.round(F.sum("score"), 4).alias("total"))


def q_bm25_topk(spark, d):
    s = setup(spark, d)
    return _list(s.engine._lists(s.queries, 10)[0])


def q_tfidf_topk(spark, d):
    s = setup(spark, d)
    return _list(s.engine._lists(s.queries, 10)[1])


def _weights(s: Setup) -> DataFrame:
    return rs.query_terms(s.queries).select("query_id", "term", (F.col("qtf") / (1.0 + F.col("first_pos"))).alias("weight"))


def q_bm25_weighted_topk(spark, d):
    s = setup(spark, d)
    return _list(s.engine._lists(s.queries, 10, _weights(s))[0])


def q_tfidf_weighted_topk(spark, d):
    s = setup(spark, d)
    return _list(s.engine._lists(s.queries, 10, _weights(s))[1])


def q_rrf_fusion(spark, d):
    s = setup(spark, d)
    return rs.fuse(*s.engine._lists(s.queries, 25)).select("query_id", "chunk_index", r6("score"), "bm25_rank", "vector_rank")


def q_search(spark, d):
    s = setup(spark, d)
    return s.engine.search(s.queries, K).select("query_id", "rank", "chunk_index", "doc_id", "chunk_id", "text", r6("score"), "bm25_rank", "vector_rank")


def q_search_components(spark, d):
    s = setup(spark, d)
    r = s.engine.search(s.queries, K)
    return r.select("query_id", "rank", *[F.round(F.element_at("components", F.lit(c)), 6).alias(c) for c in ("bm25_rrf", "vector_rrf")])


def q_ranked_docs(spark, d):
    s = setup(spark, d)
    return s.engine.ranked_doc_ids(s.queries, K)


def _ranked(s: Setup) -> DataFrame:
    return s.engine.ranked_doc_ids(s.queries, K).withColumnRenamed("doc_id", "item")


def q_pairwise_similarity(spark, d):
    s = setup(spark, d)
    found = s.engine.search(s.queries, K)
    a, b = found.select("query_id", F.col("chunk_index").alias("a")), found.select("query_id", F.col("chunk_index").alias("b"))
    return rs.pairwise_similarity(s.engine.index, a.join(b, "query_id").where("a <= b")).select("a", "b", r6("sim"))


def _pool(s: Setup) -> DataFrame:
    return s.engine._pool(s.queries, "hybrid", 25)


def q_feedback_weights(spark, d):
    return ex.feedback_weights(_pool(setup(spark, d)).where("pool_rank <= 5").select("query_id", "chunk_index", "score")).select("query_id", "chunk_index", r6("weight"))


def q_relevance_model(spark, d):
    s = setup(spark, d)
    feedback = _pool(s).where("pool_rank <= 5").select("query_id", "chunk_index", "score")
    return ex.relevance_model(s.engine.index, feedback, rs.query_terms(s.queries), 5).select("query_id", "term", r6("weight"))


def q_expanded_query(spark, d):
    s = setup(spark, d)
    return s.engine.expansion_model(s.queries, expansion=PRF).select("query_id", "term", r6("weight"))


def q_expanded_search(spark, d):
    s = setup(spark, d)
    return s.engine.search(s.queries, K, expansion=PRF).select("query_id", "rank", "chunk_index", r6("score"))


def q_minmax_scores(spark, d):
    return rr.normalize_scores(_pool(setup(spark, d))).select("query_id", "chunk_index", r6("relevance"))


def q_mmr_topk(spark, d):
    s = setup(spark, d)
    return s.engine.search(s.queries, K, mmr_lambda=0.7).select("query_id", "mmr_rank", "chunk_index", r6("score"))


def q_redundancy(spark, d):
    s = setup(spark, d)
    return s.engine.redundancy(materialize(s.engine.search(s.queries, K))).select("query_id", r6("redundancy"))


def _results(s: Setup) -> DataFrame:
    return materialize(s.engine.search(s.queries, 4))


def q_term_weights(spark, d):
    s = setup(spark, d)
    return ans.term_weights(s.queries, _results(s)).select("query_id", "term", r6("weight"))


def q_sentence_scores(spark, d):
    s = setup(spark, d)
    return ans.sentence_scores(s.queries, _results(s)).select("query_id", "rank", "pos", "sentence", r6("score"))


def _answers(s: Setup) -> tuple[DataFrame, DataFrame]:
    results = _results(s)
    return materialize(ans.extractive(s.queries, results)), results


def q_extractive_answer(spark, d):
    a, _ = _answers(setup(spark, d))
    j = lambda c: F.array_join(c, "|").alias(c)
    return a.join(ans.formatted(a), "query_id").select("query_id", "text", j("citations"), "method", j("supporting_chunks"), "formatted")


def q_prompt(spark, d):
    s = setup(spark, d)
    return ans.prompts(s.queries, _results(s))


def _metric(spark, d, name):
    s = setup(spark, d)
    return me.per_query(s.queries, _ranked(s), s.gold).select("query_id", "k", r6(name))


def q_hit_at_k(spark, d):
    return _metric(spark, d, "hit")


def q_recall_at_k(spark, d):
    return _metric(spark, d, "recall")


def q_precision_at_k(spark, d):
    return _metric(spark, d, "precision")


def q_ndcg_at_k(spark, d):
    s = setup(spark, d)
    return me.ndcg(s.queries, _ranked(s), s.gold).select("query_id", "k", r6("ndcg"))


def q_ndcg_graded(spark, d):
    s = setup(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy(F.col("doc_id").cast("string").alias("item")).agg((F.max("quality") + 1).alias("gain"))
    return me.ndcg(s.queries, _ranked(s), s.gold, gains=s.gold.join(labels, "item").select("query_id", "item", "gain")).select("query_id", "k", r6("ndcg"))


def q_mrr(spark, d):
    s = setup(spark, d)
    return me.reciprocal_rank(s.queries, _ranked(s), s.gold).select("query_id", r6("rr"))


def _levels(s: Setup) -> DataFrame:
    return s.queries.withColumn("difficulty", F.when(F.length("question") < 200, F.lit("short")).otherwise(F.lit("long")))


def q_metric_slices(spark, d):
    s = setup(spark, d)
    return ev.method_report(s.engine, _levels(s), s.gold, K, by=("difficulty",))


SETTINGS = "5:1.0,3:0.9,5:0.8,10:0.8,5:0.7"
LAMBDAS = (None, 1.0, 0.9, 0.7, 0.5, 0.3)


def q_expansion_report(spark, d):
    s = setup(spark, d)
    return ev.expansion_report(s.engine, _levels(s), s.gold, ev.parse_settings(SETTINGS), K, by=("difficulty",))


def q_diversity_report(spark, d):
    s = setup(spark, d)
    return ev.diversity_report(s.engine, s.queries, s.gold, LAMBDAS, K)


def q_faithfulness_report(spark, d):
    s = setup(spark, d)
    return ev.faithfulness_report(s.engine, s.queries, s.gold)


def q_gold_summary(spark, d):
    return ev.describe(setup(spark, d).gold)


def q_misses_partials(spark, d):
    """At the first place, where most items that occur in several documents are found in part."""
    s = setup(spark, d)
    return me.misses_partials(s.queries, _ranked(s), s.gold, 1)


def q_answer_fallbacks(spark, d):
    """Questions of a word that no document holds: half of them with results, of which none scores, half without any."""
    s = setup(spark, d)
    odd = F.col("query_id").cast("bigint") % 2 == 1
    q = s.queries.select("query_id", F.concat(F.lit("zq"), F.md5("question")).alias("question"))
    a = ans.extractive(q, _results(s).where(odd))
    j = lambda c: F.array_join(c, "|").alias(c)
    return a.select("query_id", "text", j("citations"), j("supporting_chunks"))


def q_supporting_docs(spark, d):
    a, results = _answers(setup(spark, d))
    return fa.supporting_docs(a, results)


def q_faithfulness(spark, d):
    a, results = _answers(setup(spark, d))
    return fa.report(a, results)


def q_faithfulness_mean(spark, d):
    return fa.mean_report(q_faithfulness(spark, d))


def q_cited_gold(spark, d):
    s = setup(spark, d)
    return fa.cited_gold(_answers(s)[0], s.gold)


def q_weakest_answers(spark, d):
    return fa.weakest(q_faithfulness(spark, d)).select("query_id", "token_grounding")


def q_fingerprint(spark, d):
    return store.fingerprint_row(documents(spark, d), 120, 30)


def q_index_roundtrip(spark, d):
    s = setup(spark, d)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    s.engine.save(path)
    return _list(Engine.load(spark, path).search(s.queries, K))


def q_build_index(spark, d):
    """Cold build of all index tables; one row of sizes."""
    i = build_index(chunk(documents(spark, d)))
    return i.postings.agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as made

    return made()

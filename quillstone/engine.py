"""The engine: documents in, ranked passages, answers and metrics out, for whole tables of questions."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answer as answers
from .operators import search as rs
from .operators.chunking import check_sizes, chunk
from .operators.expansion import ExpansionConfig, expand
from .operators.index import Index, build_index
from .operators.rerank import mean_pairwise_similarity, mmr, pool_similarities
from .plans.limits import least, share
from .plans.materialize import materialize
from .plans.spread import few
from .sources import store
from .sources.corpus import read_corpus


@dataclass(frozen=True)
class EngineConfig:
    """Chunk sizes in tokens, the constant of the fusion, candidates per retriever, and what is off unless set."""

    target_tokens: int = field(default=120)
    overlap_tokens: int = field(default=30)
    rrf_k: int = field(default=60)
    candidates: int = field(default=25)
    mmr_lambda: float | None = None
    expansion: ExpansionConfig | None = None

    def __post_init__(self) -> None:
        check_sizes(self.target_tokens, self.overlap_tokens)
        least("rrf_k", self.rrf_k, 1)
        share("mmr_lambda", self.mmr_lambda)


class Engine:
    """Chunks and indexes ``documents(doc_id, text)``; every method takes ``queries(query_id, question)``."""

    def __init__(self, documents: DataFrame, config: EngineConfig | None = None, index: Index | None = None):
        self.config = config or EngineConfig()
        self.documents = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        self.index = index or build_index(chunk(self.documents, self.config.target_tokens, self.config.overlap_tokens))

    @classmethod
    def from_corpus(cls, spark: SparkSession, path: str, config: EngineConfig | None = None) -> Engine:
        return cls(read_corpus(spark, path), config)

    def save(self, path: str) -> None:
        c = asdict(self.config)
        store.save(path, self.documents, self.index, c)

    @classmethod
    def load(cls, spark: SparkSession, path: str, corpus: str | None = None, **overrides) -> Engine:
        """A saved engine; with ``corpus`` it must have been built from that folder.  Query-time settings can be overridden."""
        docs, index, c = store.load(spark, path)
        c = dict(c, expansion=ExpansionConfig(**c["expansion"]) if c.get("expansion") else None)
        if corpus is not None:
            store.load(spark, path, store.fingerprint(read_corpus(spark, corpus), c["target_tokens"], c["overlap_tokens"]))
        return cls(docs, replace(EngineConfig(**c), **{k: v for k, v in overrides.items() if v is not None}), index)

    def __len__(self) -> int:
        return self.index.lengths.count()

    def stats(self) -> DataFrame:
        """One row: documents, chunks, vocabulary, mean, least and most tokens of a chunk."""
        c = self.index.lengths.agg(F.count("*").alias("chunks"), *[F.coalesce(f("len").cast("double"), F.lit(0.0)).alias(n) for f, n in ((F.avg, "mean_tokens"), (F.min, "min_tokens"), (F.max, "max_tokens"))])
        return self.documents.agg(F.count("*").alias("documents")).join(c).join(self.index.terms.agg(F.count("*").alias("vocabulary")))  # one row each

    def _lists(self, queries: DataFrame, size: int, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The best ``size`` chunks by BM25 and by cosine, of the questions or of explicit weights."""
        if weights is None:
            terms = rs.query_terms(queries)
            return rs.both_tops(self.index, rs.as_weights(terms), rs.query_vectors(self.index, terms), size)
        return rs.both_tops(self.index, weights, rs.weighted_vectors(self.index, weights), size)

    def _pool(self, queries: DataFrame, method: str, size: int, weights: DataFrame | None = None) -> DataFrame:
        return rs.pool(method, self.config.rrf_k, *self._lists(queries, size, weights), size)

    def expansion_model(self, queries: DataFrame, method: str = rs.HYBRID, candidates: int = 25, expansion: ExpansionConfig | None = None) -> DataFrame:
        """``(query_id, term, weight)`` after one feedback pass; no rows where expansion is off."""
        e = expansion or self.config.expansion
        terms = rs.query_terms(queries)
        if e is None:
            return terms.select("query_id", "term", F.lit(0.0).alias("weight")).where("false")
        return expand(self.index, terms, self._pool(queries, method, max(candidates, e.feedback_docs)), e).select("query_id", "term", "weight")

    def search(self, queries: DataFrame, k: int = 5, method: str = rs.HYBRID, mmr_lambda: float | None = None, expansion: ExpansionConfig | None = None) -> DataFrame:
        """``(query_id, rank, chunk_index, doc_id, chunk_id, text, score, method, bm25_rank, vector_rank, mmr_rank, components)``.

        Settings left None are the engine's own.  Queries without tokens or matches give no rows.
        """
        if method not in rs.METHODS:
            raise ValueError(f"method must be one of {rs.METHODS}")
        if k < 0:
            raise ValueError("k must not be negative")
        lam = self.config.mmr_lambda if mmr_lambda is None else mmr_lambda
        e = self.config.expansion if expansion is None else expansion
        size = max(self.config.candidates, k)
        pool = self._pool(queries, method, size)
        if e is not None:
            pool = materialize(pool)
            model = materialize(expand(self.index, rs.query_terms(queries), pool, e))
            borrowed = model.where("borrowed").select("query_id").distinct()
            second = self._pool(queries, method, size, model.join(borrowed, "query_id", "left_semi").select("query_id", "term", "weight"))
            pool = pool.join(borrowed, "query_id", "left_anti").unionByName(second)
        if lam is None:
            chosen = pool.where(F.col("pool_rank") <= k).withColumn("rank", F.col("pool_rank")).withColumn("mmr_rank", F.lit(None).cast("int"))
        else:
            pool = materialize(pool)
            m = mmr(pool, pool_similarities(self.index, pool), k, lam).select("query_id", "chunk_index", "mmr_rank")
            chosen = pool.join(m, ["query_id", "chunk_index"]).withColumn("rank", F.col("mmr_rank"))
        # texts join only the k results, which go to them if they are few
        c = self.index.chunks.select("chunk_index", "doc_id", "chunk_id", "text")
        return few(materialize(chosen)).join(c, "chunk_index").select(
            "query_id", "rank", "chunk_index", "doc_id", "chunk_id", "text", "score", F.lit(method).alias("method"), "bm25_rank", "vector_rank", "mmr_rank", rs.components(method, self.config.rrf_k).alias("components")
        )

    def ranked_doc_ids(self, queries: DataFrame, k: int = 5, method: str = rs.HYBRID, **settings) -> DataFrame:
        """``(query_id, doc_id, rank)`` of the first k documents among the best 4k chunks."""
        return rs.ranked_docs(self.search(queries, 4 * k, method, **settings), k)

    def answer(self, queries: DataFrame, k: int = 4, answerer=None, **settings) -> DataFrame:
        """``(query_id, text, citations, method, supporting_chunks)``; ``answerer.answer(queries, results)`` may take over."""
        results = materialize(self.search(queries, k, **settings))
        return answerer.answer(queries, results) if answerer is not None else answers.extractive(queries, results)

    def redundancy(self, results: DataFrame) -> DataFrame:
        """``(query_id, redundancy)`` of search results."""
        return mean_pairwise_similarity(results, pool_similarities(self.index, results))

"""Batch retrieval: queries are a table, scoring is a join and a grouped sum."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import words
from quillstone.plans.limits import least
from quillstone.plans.materialize import materialize

from .index import Index, Weigher

HYBRID = "hybrid"
METHODS = (HYBRID, "bm25", "vector")
#: Scores are compared after rounding to so many places, since sums of doubles depend on their order.
PLACES = 10


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf, first_pos)`` of ``queries(query_id, question)``."""
    t = queries.select("query_id", F.posexplode(tx.tokens(F.col("question"))).alias("pos", "term"))
    return t.groupBy("query_id", "term").agg(F.count("*").cast("int").alias("qtf"), F.min("pos").alias("first_pos"))


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "chunk_index", rank: str = "rank") -> DataFrame:
    """The ``k`` best of each group, ranked from 1; rows beyond k are dropped before the shuffle."""
    if k < 0:
        raise ValueError("k must not be negative")
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bm25_scores(index: Index, weights: DataFrame) -> DataFrame:
    """``(query_id, chunk_index, score)`` above 0, for ``weights(query_id, term, weight)``."""
    return dense_scores(index, weights).where("score > 0")


def bm25_totals(index: Index, weights: DataFrame) -> DataFrame:
    """``(query_id, chunks, total, best)`` of the scores above 0; each task sums up those of its own chunks."""
    t = _scored(index, _own(weights), lambda q, batches, weigher: q.totals(batches, weigher), "chunks bigint, total double, best double")
    return t.groupBy("query_id").agg(F.sum("chunks").alias("chunks"), F.sum("total").alias("total"), F.max("best").alias("best"))


def dense_scores(index: Index, weights: DataFrame) -> DataFrame:
    """BM25 scores of every chunk for every query of ``weights``, zeros included: as many rows as the result has by definition.

    Each task makes those of its own chunks for a block of queries; no rows are paired by a join.
    """
    return _scored(index, _own(weights), lambda q, batches, weigher: q.every(batches, weigher), "chunk_index int, score double")


def _own(weights: DataFrame) -> DataFrame:
    return weights.select("query_id", "term", "weight", F.lit(0.0).alias("qw"))


def _unit(raw: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id")
    return raw.select("query_id", "term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(w))).alias("qw"))


def query_vectors(index: Index, terms: DataFrame) -> DataFrame:
    """Unit vectors ``(query_id, term, qw)`` of queries, damped like chunks; unknown terms drop out first."""
    tf = 1.0 + F.log("qtf") if index.config.sublinear_tf else F.col("qtf").cast("double")
    return _unit(terms.join(index.terms, "term").select("query_id", "term", (tf * F.col("idf_tfidf")).alias("raw")))


def weighted_vectors(index: Index, weights: DataFrame) -> DataFrame:
    """Unit vectors of explicit weights, without damping; weights of 0 or less drop out."""
    return _unit(weights.where("weight > 0").join(index.terms, "term").select("query_id", "term", (F.col("weight") * F.col("idf_tfidf")).alias("raw")))


def vector_scores(index: Index, vectors: DataFrame) -> DataFrame:
    s = vectors.join(index.postings.select("term", "chunk_index", "w"), "term")
    s = s.groupBy("query_id", "chunk_index").agg(F.round(F.sum(F.col("qw") * F.col("w")), PLACES).alias("score"))
    return s.where("score > 0")


def as_weights(terms: DataFrame) -> DataFrame:
    return terms.select("query_id", "term", F.col("qtf").cast("double").alias("weight"))


def both_tops(index: Index, weights: DataFrame, vectors: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The ``size`` best chunks of each query by BM25 and by cosine, ``(query_id, chunk_index, score, rank)`` each.

    The queries go to every task in blocks of ``BLOCK_TERMS`` terms or so, and each task scores its own
    chunks whole, for both lists at once, and sends on no more than ``size`` a query and list.  So no
    score is shuffled, and the work is one pass over the chunks per block of queries.
    """
    t = weights.select("query_id", "term", "weight").join(vectors.select("query_id", "term", "qw"), ["query_id", "term"], "full_outer")
    t = t.select("query_id", "term", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("qw", F.lit(0.0)).alias("qw"))
    found = _scored(index, t, lambda q, batches, weigher: q.best(batches, size, weigher), "chunk_index int, score double, own boolean")
    found = materialize(found)
    return tuple(top(found.where(F.col("own") == own).select("query_id", "chunk_index", "score"), size) for own in (True, False))


#: Query terms that tasks hold at a time, and scores of queries and chunks that one holds at a time.
BLOCK_TERMS, BLOCK_SCORES = 500_000, 1 << 20


def _scored(index: Index, t: DataFrame, made: Callable, schema: str) -> DataFrame:
    """What ``made(block of queries, batches of chunks, weigher)`` gives in all tasks for all blocks of ``t(query_id, term, weight, qw)``."""
    found, weigher = None, index.weigher
    for held, kind in _blocks(t):
        part = index.texts.mapInArrow(lambda batches, held=held: made(held.value, batches, weigher.value), f"query_id {kind}, {schema}")
        found = part if found is None else found.unionByName(part)
    return found


def _blocks(t: DataFrame):
    """Broadcast blocks of ``(query_id, term, weight, qw)``, and the type of the ids."""
    t = materialize(t)
    kind = t.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-t.count() // BLOCK_TERMS))
    for i in range(blocks):
        own = t if blocks == 1 else t.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        yield t.sparkSession.sparkContext.broadcast(Questions.of(own.toArrow())), kind  # about BLOCK_TERMS terms


@dataclass
class Questions:
    """A block of queries: their terms, and for each of these where its queries and weights stand."""

    ids: pa.Array
    terms: pa.Array
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    qw: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Questions:
        t = t.combine_chunks()
        ids, terms = (pc.dictionary_encode(t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)) for c in ("query_id", "term"))
        q, at = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((q, at))
        first = np.searchsorted(at[order], np.arange(len(terms.dictionary) + 1))
        return cls(ids.dictionary, terms.dictionary.cast(pa.string()), first, q[order], t.column("weight").to_numpy()[order], t.column("qw").to_numpy()[order])

    def _parts(self, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        """The chunks in ``batches``, so few at a time that there are ``most`` scores of them, and no more text than a piece."""
        step = max(1, most // max(1, len(self.ids)))
        for batch in batches:
            for b in words.pieces(batch, 1) if len(self.ids) else ():
                for a in range(0, b.num_rows, step):
                    yield b.slice(a, step)

    def best(self, batches: Iterator[pa.RecordBatch], size: int, weigher: Weigher) -> Iterator[pa.RecordBatch]:
        """The ``size`` best of all chunks in ``batches`` for each query, by either score; only scores above 0."""
        n = len(self.ids)
        kept = [(np.zeros((n, 0)), np.zeros((n, 0), dtype=np.int64)) for _ in range(2)]
        if size:
            for part in self._parts(batches, BLOCK_SCORES):
                chunk = part.column(0).to_numpy().astype(np.int64)
                column = np.argsort(chunk, kind="stable")
                place = np.empty(len(column), dtype=np.int64)
                place[column] = np.arange(len(column))
                for k, m in enumerate(self._scores(part, place, weigher)):
                    score, at = np.concatenate([kept[k][0], m], axis=1), np.concatenate([kept[k][1], np.broadcast_to(chunk[column], m.shape)], axis=1)
                    kept[k] = _leading(score, at, size)
        for own, (score, at) in zip((True, False), kept):
            q, j = np.nonzero(score > 0)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q)), pa.array(at[q, j].astype(np.int32)), pa.array(score[q, j]), pa.array(np.full(len(q), own))], names=["query_id", "chunk_index", "score", "own"])

    def every(self, batches: Iterator[pa.RecordBatch], weigher: Weigher) -> Iterator[pa.RecordBatch]:
        """The first score of all queries and all chunks in ``batches``."""
        n = len(self.ids)
        for part in self._parts(batches, 1 << 18):
            (score,) = self._scores(part, np.arange(part.num_rows), weigher, 1)
            q = np.repeat(np.arange(n), part.num_rows)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q)), part.column(0).take(pa.array(np.tile(np.arange(part.num_rows), n))), pa.array(score.reshape(-1))], names=["query_id", "chunk_index", "score"])

    def totals(self, batches: Iterator[pa.RecordBatch], weigher: Weigher) -> Iterator[pa.RecordBatch]:
        """Number, sum and greatest of the first scores above 0 of each query."""
        count, total, best = (np.zeros(len(self.ids), dtype=kind) for kind in (np.int64, np.float64, np.float64))
        for part in self._parts(batches, BLOCK_SCORES):
            (score,) = self._scores(part, np.arange(part.num_rows), weigher, 1)
            above = np.maximum(score, 0.0)
            count += (above > 0).sum(axis=1)
            total += above.sum(axis=1)
            best = np.maximum(best, above.max(axis=1))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(some)), *(pa.array(x[some]) for x in (count, total, best))], names=["query_id", "chunks", "total", "best"])

    def _scores(self, part: pa.RecordBatch, place: np.ndarray, weigher: Weigher, lists: int = 2) -> list[np.ndarray]:
        """Matrices of the scores of all queries and chunks of ``part``, chunks in the order of ``place``: by BM25, and by cosine."""
        n, c = len(self.ids), part.num_rows
        counts, *weights = weigher.weigh(part.column(1))
        asked = pc.fill_null(pc.index_in(counts.terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        term = asked[counts.term].astype(np.int64)
        known = term >= 0
        term, column = term[known], place[counts.row[known]]
        count = self.first[term + 1] - self.first[term]
        entry = np.repeat(self.first[term] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(term) else np.zeros(0, np.int64)
        cell = self.query[entry] * c + np.repeat(column, count)
        out = []
        for values, own in list(zip(weights, (self.weight, self.qw)))[:lists]:
            x = np.repeat(values[known], count) * own[entry]
            out.append(np.round(np.bincount(cell, weights=x, minlength=n * c).astype(np.float64).reshape(n, c), PLACES))
        return out


def _leading(score: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` greatest of each line; of equal ones those of least ``at``."""
    if score.shape[1] > 4 * size:  # what lies under the last place cannot be in it
        last = np.partition(score, score.shape[1] - size, axis=1)[:, -size]
        width = max(size, int((score >= np.maximum(last, 1e-300)[:, None]).sum(axis=1).max()))
        if width < score.shape[1]:
            some = np.argpartition(-score, width - 1, axis=1)[:, :width]
            score, at = np.take_along_axis(score, some, axis=1), np.take_along_axis(at, some, axis=1)
    order = np.argsort(at, axis=1, kind="stable")
    score, at = np.take_along_axis(score, order, axis=1), np.take_along_axis(at, order, axis=1)
    order = np.argsort(-score, axis=1, kind="stable")[:, :size]
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(at, order, axis=1)


def pairwise_similarity(index: Index, pairs: DataFrame) -> DataFrame:
    """``(a, b, sim)`` for ``pairs(a, b)`` of chunks: cosine, exactly 1 for a chunk with itself."""
    p = materialize(pairs.select("a", "b").distinct())
    v = materialize(index.postings_of(p.select(F.explode(F.array("a", "b")).alias("chunk_index"))).select("chunk_index", "term", "w"))
    dot = p.join(v.toDF("a", "term", "wa"), "a").join(v.toDF("b", "term", "wb"), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return p.join(dot, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.round(F.coalesce("dot", F.lit(0.0)), PLACES)).alias("sim"))


def fuse(bm25: DataFrame, vector: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: ``(query_id, chunk_index, score, bm25_rank, vector_rank)``."""
    least("rrf_k", rrf_k, 1)
    b = bm25.select("query_id", "chunk_index", F.col("rank").alias("bm25_rank"))
    v = vector.select("query_id", "chunk_index", F.col("rank").alias("vector_rank"))
    part = lambda r: F.coalesce(1.0 / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    return b.join(v, ["query_id", "chunk_index"], "full_outer").withColumn("score", F.round(part("bm25_rank") + part("vector_rank"), PLACES))


def pool(method: str, rrf_k: int, b: DataFrame, v: DataFrame, size: int) -> DataFrame:
    """Candidates ``(query_id, chunk_index, score, pool_rank, bm25_rank, vector_rank)`` from both ranked lists.

    Both lists hold ``size`` chunks whatever the method; a fused pool can hold up to twice as many.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    p = fuse(b, v, rrf_k)
    if method != HYBRID:
        own = (b if method == "bm25" else v).select("query_id", "chunk_index", F.col("score").alias("own"))
        p = p.join(own, ["query_id", "chunk_index"]).withColumn("score", F.col("own")).drop("own")
    return top(p, 2 * size, rank="pool_rank")


def components(method: str, rrf_k: int) -> Column:
    """Map of the parts of a score."""
    if method != HYBRID:
        return F.create_map(F.lit(method), F.col("score"))
    part = lambda r: F.coalesce(1.0 / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    return F.create_map(F.lit("bm25_rrf"), part("bm25_rank"), F.lit("vector_rrf"), part("vector_rank"))


def ranked_docs(results: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc_id, rank)``: documents by their best chunk in ``results(query_id, doc_id, rank)``."""
    d = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy("best")
    return d.select("query_id", "doc_id", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)

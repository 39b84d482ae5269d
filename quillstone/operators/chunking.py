"""Sentence-aligned overlapping chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import words
from quillstone.plans.limits import least
from quillstone.plans.materialize import materialize
from quillstone.plans.spread import ordered


def span_list(counts: list[int], target: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first sentence, last sentence, tokens) of each chunk: a step per chunk, by search in the running sums of tokens."""
    n = len(counts)
    if not n:
        return []
    p = [0, *accumulate(counts)]
    out, s, least = [], 0, 1
    while True:
        j = max(least, bisect_right(p, p[s] + target) - 1)
        if j >= n:
            return [*out, (s, n - 1, p[n] - p[s])]
        out.append((s, j - 1, p[j] - p[s]))
        carried = max(s + 1, bisect_left(p, p[j] - overlap)) if overlap else j
        s, least = carried if carried < j or not overlap else j - 1, j + 1


def spans(counts: Column, target: int, overlap: int) -> Column:
    """Array of (first sentence, last sentence, tokens) of each chunk, from the token counts of the sentences.

    A chunk ends before the sentence that would take it past ``target``.  With overlap the next one
    starts at the earliest later sentence from which at most ``overlap`` tokens are carried, at the
    last sentence at least; a carried start is not checked against the target again.  Only the counts
    go to Python, a batch of documents at a time: a fold over an array copies it at each step.
    """

    @F.pandas_udf("array<struct<a:int,b:int,n:int>>")
    def each(c: pd.Series) -> pd.Series:
        return c.map(lambda x: [{"a": a, "b": b, "n": n} for a, b, n in span_list([] if x is None else x.tolist(), target, overlap)])

    return each(counts)


def check_sizes(target: int, overlap: int) -> None:
    least("target_tokens", target, 1)
    least("overlap_tokens", overlap, 0)
    least("target_tokens", target, overlap + 1)


def _cut(batches: Iterator[pa.RecordBatch], target: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Chunks of ``(doc_id, sentences as lines, the same in lower case with a line end)``: slices of the lines."""
    for batch in batches:
        # left out here: a condition on the sentences would be pushed under the shuffle, and they with it
        for b in words.pieces(batch.filter(pc.greater(pc.binary_length(batch.column(1)), 0)), 1):
            data, at = words.raw(b.column(1))
            low, low_at = words.raw(b.column(2))
            line_end = np.flatnonzero(low == 10)
            counts = np.bincount(np.searchsorted(line_end, words.bounds(low)[0]), minlength=len(line_end)).tolist()
            last = np.searchsorted(line_end, low_at[1:]).tolist()
            inner = np.flatnonzero(data == 10)
            begins, ends = (np.sort(np.concatenate(x)).tolist() for x in ((at[:-1], inner + 1), (inner, at[1:])))
            text, rows, first = data.tobytes(), [], 0
            for row, end in enumerate(last):
                rows += [(row, k, text[begins[first + i] : ends[first + j]], n, i, j) for k, (i, j, n) in enumerate(span_list(counts[first:end], target, overlap))]
                first = end
            row, k, made, n, i, j = zip(*rows) if rows else ((),) * 6
            small = lambda x: pa.array(x, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), small(k), pa.array(made, pa.binary()).cast(pa.string()), small(n), small(i), small(j)], names=["doc_id", "chunk_ord", "text", "token_count", "sentence_start", "sentence_end"])


#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_ROWS = 33


def chunk(documents: DataFrame, target: int = 120, overlap: int = 30) -> DataFrame:
    """``(chunk_index, doc_id, chunk_ord, chunk_id, text, token_count, sentence_start, sentence_end, metadata)``.

    ``documents`` has ``doc_id`` (string, unique) and ``text``.  Indexes go by doc_id in code-point
    order, then by place in the document; a document without sentences has no chunks.

    Texts are shuffled once, into the order of their ids, and chunks are written once: with the number
    of each partition's chunks, the place in its partition is the index.
    """
    check_sizes(target, overlap)
    d = ordered(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("doc_id is not null"), "doc_id")
    d = d.select("doc_id", F.array_join(tx.sentences(F.col("text")), "\n").alias("lines"))
    d = d.select("doc_id", "lines", F.concat(F.lower("lines"), F.lit("\n")).alias("low"))
    c = d.mapInArrow(partial(_cut, target=target, overlap=overlap), "doc_id string, chunk_ord int, text string, token_count int, sentence_start int, sentence_end int")
    c = materialize(c.withColumn("at", F.monotonically_increasing_id()), "zstd")
    part = F.shiftright("at", _ROWS).cast("int")
    held = dict(c.groupBy(part.alias("part")).agg(F.count("*")).collect())  # one row a partition
    base = [0, *accumulate(held.get(i, 0) for i in range(max(held, default=0)))]
    return c.select(
        (F.element_at(F.array(*[F.lit(x) for x in base]), part + 1) + F.col("at").bitwiseAND(F.lit((1 << _ROWS) - 1))).cast("int").alias("chunk_index"),
        "doc_id",
        "chunk_ord",
        F.concat("doc_id", F.lit("::"), F.col("chunk_ord").cast("string")).alias("chunk_id"),
        "text",
        "token_count",
        "sentence_start",
        "sentence_end",
        F.create_map().cast("map<string,string>").alias("metadata"),
    )

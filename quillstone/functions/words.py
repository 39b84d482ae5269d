"""The tokens of ``functions.text.tokens`` for tasks that count them a column of texts at a time, on bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

_RUN, _JOINT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_RUN[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_JOINT[list(b"-'")] = True
#: Bytes of text that a task cuts at a time.
PIECE = 1 << 23


def ready(text: Column, normal: bool = False) -> Column:
    """What ``split`` takes: a blank at the end of each text keeps tokens from going on in the next.  ``normal``: it is normalized already."""
    full = F.coalesce(text, F.lit(""))
    return F.concat(F.lower(full if normal else tx.normalize(full)), F.lit(" "))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins, with the end."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def pieces(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``b`` in slices of about ``PIECE`` bytes of one column, of a row at least."""
    end = raw(b.column(column))[1][1:]
    a = 0
    while a < len(end):
        z = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + PIECE, side="right")))
        yield b.slice(a, z - a)
        a = z


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens begin and end in bytes of lower case, and which bytes are theirs.

    A hyphen or apostrophe between two letters or digits joins them, so a token is a run of such bytes.
    """
    own = _RUN[data]
    if len(data) > 2:
        own[1:-1] |= _JOINT[data[1:-1]] & own[:-2] & own[2:]
    edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
    return edge[::2], edge[1::2], own


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of texts made ``ready``, in their order, and the row of each."""
    data, at = raw(texts)
    begin, end, own = bounds(data)
    offsets = np.zeros(len(begin) + 1, dtype=np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    terms = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[own]))
    return terms, np.searchsorted(at, begin, side="right") - 1


@dataclass
class Counts:
    """Row ``row[i]`` holds ``terms[term[i]]`` ``tf[i]`` times, ordered by row; ``length`` has the tokens of every row."""

    terms: pa.Array
    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    length: np.ndarray


def counted(texts: pa.Array) -> Counts:
    """The tokens of each text, counted."""
    tokens, row = split(texts)
    d = pc.dictionary_encode(tokens)
    n = max(1, len(d.dictionary))
    key, tf = np.unique(row * n + d.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return Counts(d.dictionary.cast(pa.string()), key // n, key % n, tf, np.bincount(row, minlength=len(texts)))

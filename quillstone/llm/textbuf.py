"""Vectorised text primitives over Arrow string buffers.

Everything works on whole batches of UTF-8 bytes with numpy, never per row: words are found
with byte masks, and any substring gets a polynomial hash out of one prefix sum modulo 2**64.
Words are maximal runs of ASCII letters, digits, ``_`` and non-ASCII letters; symbols of the
Latin-1 block and general punctuation separate; every CJK character is a word of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 19
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        size = max(n, PIECE + 4096)
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["p"][:n], _pow["i"][:n]


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """One contiguous string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    return pc.utf8_lower(column) if lower else column


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (relative to the bytes) of a large_string array."""
    n = len(column)
    _, off, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def row_slices(column: pa.Array, target: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes of text each (one row at least)."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < n:
        base = ends[a - 1] if a else 0
        b = max(a + 1, min(a + (1 << 17), int(np.searchsorted(ends, base + target, side="right"))))
        yield a, b
        a = b


def _word_mask(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Which bytes belong to words, and which start a CJK character."""
    w = _WORD[raw]
    n = len(raw)
    high = np.flatnonzero(raw >= 0xC2)
    if not len(high):
        return w, None
    lead = raw[high]
    c2 = high[lead == 0xC2]
    w[c2] = False
    w[np.minimum(c2 + 1, n - 1)] = False
    e2 = high[lead == 0xE2]
    e2 = e2[e2 + 2 < n]
    e2 = e2[(raw[e2 + 1] == 0x80) | (raw[e2 + 1] == 0x81)]
    e3 = high[lead == 0xE3]
    e3 = e3[e3 + 2 < n]
    e3 = e3[raw[e3 + 1] == 0x80]
    for p in (e2, e3):
        for k in range(3):
            w[p + k] = False
    cjk = high[(lead >= 0xE3) & (lead <= 0xED)]
    if not len(cjk):
        return w, None
    m = np.zeros(n, dtype=bool)
    m[cjk] = True
    m &= w
    return w, m


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word and the index of each row's first word (n + 1 entries).

    Long buffers are worked through in pieces cut between words, so memory stays bounded.
    """
    n = len(raw)
    hs, ss, es = [], [], []
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets[:-1]] = True
    a = 0
    while a < n:
        b = min(n, a + PIECE)
        while b < n:
            # cut at a byte that is no word byte: a blank nearly always lies close by
            back = np.flatnonzero(~_WORD[raw[max(a + 1, b - 4096) : b]])
            if len(back):
                b = max(a + 1, b - 4096) + int(back[-1]) + 1
                break
            b = min(n, b + PIECE)
        piece = raw[a:b]
        w, cjk = _word_mask(piece)
        first = row_start[a:b]
        prev = np.empty(len(w), dtype=bool)
        prev[0] = False
        prev[1:] = w[:-1]
        start = w & (~prev | first)
        if cjk is not None:
            start |= cjk
            after = np.flatnonzero(cjk) + 3
            after = after[after < len(w)]
            start[after[w[after]]] = True
        s = np.flatnonzero(start)
        if len(s):
            stop = np.empty(len(w), dtype=bool)
            stop[-1] = True
            stop[:-1] = ~w[1:] | start[1:]
            e = np.flatnonzero(stop & w) + 1
            p, inv = _powers(len(piece))
            c = np.empty(len(piece) + 1, dtype=U64)
            c[0] = 0
            np.cumsum((piece.astype(U64) + U64(1)) * p, out=c[1:])
            hs.append(mix((c[e] - c[s]) * inv[s]))
            ss.append(s + a)
            es.append(e + a)
        a = b
    cat = lambda x, d: np.concatenate(x) if x else np.zeros(0, d)
    h, s, e = cat(hs, U64), cat(ss, np.int64), cat(es, np.int64)
    return h, s, e, np.searchsorted(s, offsets)


def span_hash(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each byte span [s, e): the same function that ``words`` uses.  ``s`` ascends."""
    out = np.empty(len(s), dtype=U64)
    i = 0
    while i < len(s):
        j = int(np.searchsorted(s, s[i] + PIECE))
        a, b = int(s[i]), int(e[i:j].max())
        p, inv = _powers(b - a + 1)
        c = np.zeros(b - a + 1, dtype=U64)
        np.cumsum((raw[a:b].astype(U64) + U64(1)) * p[:-1], out=c[1:])
        out[i:j] = mix((c[e[i:j] - a] - c[s[i:j] - a]) * inv[s[i:j] - a])
        i = j
    return out


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each row, and their rows.

    A row of fewer words (at least one) has one shingle: all its words.
    """
    rows = len(first) - 1
    count = np.diff(first)
    row = np.repeat(np.arange(rows), count)
    short = (count > 0) & (count < width)
    g = h * U64(0x2545F4914F6CDD1D)
    for k in range(1, width):
        nxt = np.zeros_like(g)
        if len(h) > k:
            nxt[:-k] = h[k:]
        g = (g ^ (g >> U64(32))) * U64(0x9FB21C651E98DF25) + nxt
    last = np.repeat(first[1:], count)
    ok = np.arange(len(h)) + width <= last
    out_h, out_r = mix(g[ok]), row[ok]
    if short.any():
        idx = np.flatnonzero(short)
        extra = np.array([int(_fold(h[first[i] : first[i + 1]])) for i in idx], dtype=U64)
        pos = np.searchsorted(out_r, idx)
        out_h, out_r = np.insert(out_h, pos, extra), np.insert(out_r, pos, idx)
    return out_h, out_r


def _fold(h: np.ndarray) -> np.uint64:
    g = U64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            g = (g ^ (g >> U64(29))) * U64(0x9FB21C651E98DF25) + x
    return mix(np.array([g], dtype=U64))[0]


def row_digest(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of words."""
    out = []
    n = len(h)
    p, inv = _powers(n + 1)
    for salt in (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93):
        c = np.zeros(n + 1, dtype=U64)
        np.cumsum(mix(h ^ U64(salt)) * p[:n], out=c[1:])
        out.append(mix((c[first[1:]] - c[first[:-1]]) * inv[first[:-1]] + np.diff(first).astype(U64)))
    return out[0], out[1]


def distinct_counts(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with their numbers: hashes keep their upper 46 bits, rows must be under 2**18."""
    key = (row.astype(U64) << U64(46)) | (h >> U64(18))
    key.sort()
    if not len(key):
        return key, row[:0], row[:0]
    new = np.empty(len(key), dtype=bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    return key & U64((1 << 46) - 1), (key >> U64(46)).astype(np.int64), tf


def row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=rows)[:rows]

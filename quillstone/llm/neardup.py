"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of shingles are counted over all rows into a hashed table of fixed size.
2. One pass draws ``bands * rows`` consistent weighted samples of each text's TF-IDF vector.
3. Texts of equal words are one node.  Nodes that agree on a band share a bucket.
4. In each bucket a pivot is compared with the other members; whoever cannot be decided by it goes
   on to the next round, until no bucket is left.  Weighted Jaccard distance is a metric, so a pair
   is left out if the triangle inequality rules a link out, or both ends already are in the class of
   one pivot.  The inequality is fed with exact distances, and for pairs whose samples hardly agree
   with a bound that their agreement gives at 4.3 standard errors, which fails one time in 100,000.
   Small rests are compared pair by pair.
5. A pair is linked if the exact weighted Jaccard similarity of its texts reaches the threshold;
   classes are the connected components of the links.
6. Which links the pivots happened to verify does not matter for the counts: inside each class whose
   pairs are not all verified yet, every pair of texts is compared, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.components import connected_components
from quillstone.plans.materialize import materialize

from . import textbuf as tb

U64 = np.uint64


@dataclass(frozen=True)
class NearDupConfig:
    """``threshold``: weighted Jaccard similarity of a link.  ``width``: words of a shingle.

    ``df_bits``: the document-frequency table has 2**df_bits cells (4 MB at 20), whatever the corpus.
    ``rest``: a bucket of so many undecided members or fewer is compared pair by pair.
    """

    threshold: float = 0.55
    width: int = 2
    bands: int = 28
    rows: int = 4
    df_bits: int = 20
    rest: int = 24
    seed: int = 20240611

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> int:
        """Agreeing samples under which a pair at the threshold is a one in 100,000 case."""
        n, p = self.samples, self.threshold
        return max(0, int(n * p - 4.3 * (n * p * (1 - p)) ** 0.5))


_TABLE = 1 << 15


class Sampler:
    """Consistent weighted samples: (r, c, beta) of a shingle come from its hash, so they are the same in every text."""

    def __init__(self, cfg: NearDupConfig):
        g = np.random.RandomState(cfg.seed)
        self.cfg = cfg
        r = g.gamma(2.0, 1.0, _TABLE)
        c = g.gamma(2.0, 1.0, _TABLE)
        beta = g.uniform(0.0, 1.0, _TABLE)
        self.r = np.maximum(r, 1e-3).astype(np.float32)
        self.beta = beta.astype(np.float32)
        # ln a = ln c - r * (t - beta + 1)
        self.q = (np.log(c) + self.r * (beta - 1.0) + 64.0).astype(np.float32)
        self.mul = [U64(int(x) * 2 + 1) for x in g.randint(1, 2**62, cfg.samples, dtype=np.int64)]

    def __call__(self, h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, step: int = 1 << 15) -> np.ndarray:
        """uint32 sample ids, one line per row; rows without shingles have 0 everywhere. ``row`` ascends."""
        k = self.cfg.samples
        best = np.full((k, rows), np.iinfo(np.uint64).max, dtype=U64)
        logw = np.log(weight).astype(np.float32)
        for a in range(0, len(h), step):
            x, lw, rr = h[a : a + step], logw[a : a + step], row[a : a + step]
            n = len(x)
            at = np.flatnonzero(np.r_[True, rr[1:] != rr[:-1]])
            which = rr[at]
            packed = np.empty((n, 2), dtype=np.uint32)
            flat = packed.view(U64).reshape(-1)
            r, t, q = np.empty(n, np.float32), np.empty(n, np.float32), np.empty(n, np.float32)
            for i, mul in enumerate(self.mul):
                m = x * mul
                idx = (m >> U64(49)).view(np.int64)
                np.take(self.r, idx, out=r, mode="clip")
                np.take(self.beta, idx, out=t, mode="clip")
                np.take(self.q, idx, out=q, mode="clip")
                t += lw / r
                np.floor(t, out=t)
                r *= t
                q -= r
                packed[:, 1] = np.maximum(q, np.float32(1e-6)).view(np.uint32)
                m >>= U64(16)
                packed[:, 0] = m.astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
                best[i, which] = np.minimum(best[i, which], np.minimum.reduceat(flat, at))
        ids = (best & U64(0xFFFFFFFF)).astype(np.uint32)
        ids[best == np.iinfo(np.uint64).max] = 0
        return np.ascontiguousarray(ids.T)


def _vectors(texts: pa.Array, cfg: NearDupConfig):
    raw, off = tb.buffer(tb.strings(texts, lower=True))
    h, s, e, first = tb.words(raw, off)
    sh, row = tb.shingles(h, first, cfg.width)
    key, r, tf = tb.distinct_counts(sh, row)
    return raw, off, h, first, key, r, tf


def _cells(key: np.ndarray, cfg: NearDupConfig) -> np.ndarray:
    return (key >> U64(46 - cfg.df_bits)).astype(np.int64)


def shingle_df(docs: DataFrame, text: str, cfg: NearDupConfig) -> tuple[np.ndarray, int]:
    """Document frequency of each cell over all rows, and the number of rows with words."""
    size, part = 1 << cfg.df_bits, min(1 << cfg.df_bits, 1 << 12)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, rows = np.zeros(size, dtype=np.int64), 0
        for b in batches:
            col = b.column(0)
            for x, y in tb.row_slices(col):
                *_, key, r, _ = _vectors(col.slice(x, y - x), cfg)
                acc += np.bincount(_cells(key, cfg), minlength=size)
                rows += len(np.unique(r))
        if rows:
            yield _counts(np.arange(size // part), acc.reshape(-1, part), "<i4")
            yield _counts(np.array([-1]), np.array([[rows]]), "<i4")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(v.as_buffer(), dtype="<i4").astype(np.int64)
                total[i] = total[i] + x if i in total else x
        for i, x in total.items():
            yield _counts(np.array([i]), x[None, :], "<i8")

    # each task sends its counts in size / part packed lines; as many lines in all reach the driver
    sent = docs.select(F.col(text)).mapInArrow(count, "part int, n binary")
    got = sent.repartition("part").mapInArrow(add, "part int, n binary").toArrow()
    df, rows = np.zeros(size, dtype=np.int64), 0
    for i, v in zip(got.column("part").to_pylist(), got.column("n")):
        x = np.frombuffer(v.as_py(), dtype="<i8")
        if i < 0:
            rows += int(x[0])
        else:
            df[i * part : (i + 1) * part] += x
    return np.minimum(df, np.iinfo(np.int32).max).astype(np.int32), rows


def _counts(parts: np.ndarray, lines: np.ndarray, kind: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), _binary(lines.astype(kind))], names=["part", "n"])


def _weights(key: np.ndarray, tf: np.ndarray, df: np.ndarray, n: int, cfg: NearDupConfig) -> np.ndarray:
    """tf * idf, idf = ln((1 + n) / (1 + df)) + 0.1: above zero for every shingle."""
    return tf * (np.log((1.0 + n) / (1.0 + np.minimum(df[_cells(key, cfg)], n))) + 0.1)


def sketches(docs: DataFrame, doc_id: str, text: str, cfg: NearDupConfig, df_table: np.ndarray, n: int) -> DataFrame:
    """``(id, th, node, bands, sig)`` per row: xxhash64 of the text, digest of its words, band hashes, 8 bits of each sample."""
    held = docs.sparkSession.sparkContext.broadcast(df_table)  # 2**df_bits * 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(cfg)
        for b in batches:
            col = b.column(2)
            for x, y in tb.row_slices(col):
                raw, off, h, first, key, r, tf = _vectors(col.slice(x, y - x), cfg)
                rows = y - x
                ids = sampler(key, r, _weights(key, tf, held.value, n, cfg), rows)
                node = np.stack(tb.row_digest(h, first), axis=1)
                empty = np.diff(first) == 0
                for i in np.flatnonzero(empty):  # no words: only equal bytes are equal
                    node[i] = np.frombuffer(hashlib.blake2b(raw[off[i] : off[i + 1]].tobytes(), digest_size=16, person=b"no words").digest(), dtype=U64)
                bands = np.empty((rows, cfg.bands), dtype=U64)
                for k in range(cfg.bands):
                    g = np.full(rows, k + 1, dtype=U64)
                    for c in range(k * cfg.rows, (k + 1) * cfg.rows):
                        g = tb.mix(g ^ (ids[:, c].astype(U64) + U64(0x9E3779B97F4A7C15)))
                    bands[:, k] = g
                ends = np.r_[0, np.where(empty, 0, cfg.bands).cumsum()].astype(np.int32)
                for shift in (16, 8):
                    ids ^= ids >> np.uint32(shift)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, rows), b.column(1).slice(x, rows), _binary(node), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[~empty].reshape(-1).view(np.int64))), _binary(ids.astype(np.uint8))],
                    names=["id", "th", "node", "bands", "sig"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, th bigint, node binary, bands array<bigint>, sig binary")


def _binary(a: np.ndarray) -> pa.Array:
    """The lines of a contiguous matrix as a binary column."""
    width = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())


def agreement(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """Number of equal bytes of two binary columns of ``k`` bytes a row."""
    x, y = (tb.buffer(c.cast(pa.large_binary()))[0].reshape(-1, k) for c in (a, b))
    return (x == y).sum(axis=1).astype(np.int32)


def pivot_similarity(texts: pa.Array, pivot: np.ndarray, df: np.ndarray, n: int, cfg: NearDupConfig) -> np.ndarray:
    """Exact weighted Jaccard similarity of each text to the one at ``pivot``; each vector is made once."""
    *_, key, r, tf = _vectors(texts, cfg)
    w, rows = _weights(key, tf, df, n, cfg), len(texts)
    code = (r.astype(U64) << U64(46)) | key  # ascends
    if not len(code):
        return np.zeros(rows)
    want = (pivot[r].astype(U64) << U64(46)) | key
    at = np.minimum(np.searchsorted(code, want), len(code) - 1)
    hit = code[at] == want
    low = tb.row_sums(np.minimum(w[hit], w[at[hit]]), r[hit], rows)
    own = tb.row_sums(w, r, rows)
    total = own + own[pivot]
    return np.divide(low, total - low, out=np.zeros(rows), where=total > low)


def weighted_jaccard(a: pa.Array, b: pa.Array, df: np.ndarray, n: int, cfg: NearDupConfig) -> np.ndarray:
    """Exact weighted Jaccard similarity of the TF-IDF vectors of row-aligned texts; 0 if one has no words."""
    rows = len(a)
    sides = []
    for col in (a, b):
        *_, key, r, tf = _vectors(col, cfg)
        sides.append(((r.astype(U64) << U64(46)) | key, _weights(key, tf, df, n, cfg), r))
    (ka, wa, ra), (kb, wb, rb) = sides
    total = tb.row_sums(wa, ra, rows) + tb.row_sums(wb, rb, rows)
    if not len(kb):
        return np.zeros(rows)
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    hit = kb[at] == ka
    low = tb.row_sums(np.minimum(wa[hit], wb[at[hit]]), ra[hit], rows)
    return np.divide(low, total - low, out=np.zeros(rows), where=total > low)


#: A pivot's members are compared with it so many at a time.
STAR_ROWS = 512


class _Verifier:
    """``texts(node, text)``: all nodes that share a bucket, so that documents are searched for them once."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, cfg: NearDupConfig, df: np.ndarray, n: int):
        self.texts, self.nodes, self.cfg, self.n = texts, nodes, cfg, n
        self.held = texts.sparkSession.sparkContext.broadcast(df)  # 2**df_bits * 4 bytes

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """``(a, b, far, link)``: exact distances where the samples leave a link possible, else a lower bound."""
        cfg, n, held, k, limit = self.cfg, self.n, self.held, self.cfg.samples, self.cfg.threshold - 1e-9
        sig = self.nodes.select("node", "sig")
        both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

        def count(batches):
            for t in batches:
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(agreement(t.column(2), t.column(3), k))], names=["a", "b", "agree"])

        def exact(batches):
            last = pa.array([None], pa.string())  # the text of the last pivot
            for t in batches:
                for x, y in tb.row_slices(t.column(3), 1 << 20):
                    part = t.slice(x, y - x)
                    texts = pa.concat_arrays([last, part.column(3).cast(pa.string())])
                    member = part.column(1).to_numpy(zero_copy_only=False)
                    own = np.r_[True, ~member]
                    pivot = np.maximum.accumulate(np.where(own, np.arange(y - x + 1), 0))
                    last = texts.slice(int(pivot[-1]), 1)
                    if member.any():
                        s = pivot_similarity(texts, pivot, held.value, n, cfg)[1:][member]
                        keep = pa.array(member)
                        yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(2).filter(keep), pa.array(1.0 - s), pa.array(s >= limit)], names=["a", "b", "far", "link"])

        counted = materialize(both.mapInArrow(count, "a binary, b binary, agree int"))
        p = F.col("agree") / F.lit(float(k))
        most = F.least(F.lit(1.0), p + 4.3 * F.sqrt(p * (1 - p) / k) + 0.02)
        unlike = counted.where(F.col("agree") < cfg.floor).select("a", "b", (1.0 - most).alias("far"), F.lit(False).alias("link"))
        like = counted.where(F.col("agree") >= cfg.floor).select("a", "b")
        if like.isEmpty():
            return unlike
        # a pivot's text goes once to each group of its members, a member's text once to each of its pivots
        parts = like.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(STAR_ROWS))).alias("parts"))
        salted = like.join(parts, "a").select("a", F.expr("CAST(pmod(xxhash64(b), parts) AS INT)").alias("salt"), "b")
        rows = salted.select("a", "salt", F.lit(True).alias("member"), F.col("b").alias("node"))
        rows = rows.unionByName(salted.select("a", "salt").distinct().select("a", "salt", F.lit(False).alias("member"), F.col("a").alias("node")))
        stars = rows.join(self.texts, "node").select("a", "member", "node", "text", "salt").repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
        return stars.drop("salt").mapInArrow(exact, "a binary, b binary, far double, link boolean").unionByName(unlike)


def _links(sized: DataFrame, verify: _Verifier, cfg: NearDupConfig, rows: int) -> DataFrame:
    """Links ``(a, b)`` that connect all that the buckets ``(bucket, node, m, pivot)`` can show; ones within a pivot's own class may lack.

    After the first round the undecided members are few as a rule: if all their pairs are fewer than
    ``rows``, they are compared at once; else buckets of at most ``rest`` members are, and larger
    ones go through another pivot.
    """
    done, first, rest = None, True, cfg.rest
    while True:
        if not first:
            sizes = materialize(active.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).where("m > 1"))
            if (sizes.agg(F.sum(F.expr("m * (m - 1) DIV 2"))).first()[0] or 0) <= rows:
                rest = 1 << 62
            sized = active.join(sizes, "bucket")
        star = sized.where("node != pivot").where(F.lit(True) if first else F.col("m") > F.lit(rest))
        star = materialize(star.select("bucket", F.col("pivot").alias("a"), F.col("node").alias("b")))  # the pivot is the least
        pairs = star.select("a", "b")
        if not first:
            few = sized.where(F.col("m") <= F.lit(rest)).select("bucket", "node")
            pairs = pairs.unionByName(few.toDF("bucket", "a").join(few.toDF("bucket", "b"), "bucket").where("a < b").select("a", "b"))
        pairs = pairs.distinct()
        found = materialize(verify(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")))
        done = found if done is None else done.unionByName(found)
        near = star.join(done, ["a", "b"]).select("bucket", F.col("b").alias("node"), "far", "link")
        nearest = near.where("not link").groupBy("bucket").agg(F.min("far").alias("nearest"))
        # undecided: members not linked to the pivot, and linked ones that one of those may reach
        left = near.join(nearest, "bucket").where((~F.col("link")) | (F.col("far") >= F.col("nearest") - (1.0 - cfg.threshold))).select("bucket", "node")
        active = materialize(left.join(left.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"), "bucket"))
        first, rest = False, rest * (1 if first else 8)
        if active.isEmpty():
            return done.where("link").select("a", "b")


#: Bytes of text and texts in a block of a class, on average; two blocks meet in one task.
BLOCK_BYTES, BLOCK_ROWS = 1 << 22, 1024


#: A shingle is summed by matrix products if at least one in so many pairs of rows share it, else pair by pair.
DENSE = 128
#: Columns of a matrix product, pairs summed in one step, and weights of a shingle beyond which it is compared by itself.
COLUMNS, PAIRS, LEVELS = 1024, 1 << 20, 16


def _shared(col: np.ndarray, w: np.ndarray, row: np.ndarray, left: int, rows: int, sides: bool) -> np.ndarray:
    """Sums of the lesser weights of all pairs of rows: the first ``left`` ones to the others if ``sides``, else all to all.

    The lesser of two weights is the sum of the steps between a shingle's weights that both rows reach,
    so a step is a column of ones and zeros, and the sums are products of such columns with themselves.
    """
    base = left if sides else 0
    low = np.zeros((left, rows - base))
    order = np.lexsort((w, col))
    col, w, row = col[order], w[order], row[order]
    new = np.r_[True, col[1:] != col[:-1]]
    step = new | np.r_[True, w[1:] != w[:-1]]
    start = np.flatnonzero(new)
    level = np.cumsum(step) - 1
    level -= np.repeat(level[start], np.diff(np.r_[start, len(col)]))
    ends = np.r_[start[1:], len(col)]
    many = level[ends - 1] >= LEVELS
    for x, y in zip(start[many], ends[many]):
        a, b = (np.flatnonzero(row[x:y] < left) + x, np.flatnonzero(row[x:y] >= base) + x)
        low[np.ix_(row[a], row[b] - base)] += np.minimum.outer(w[a], w[b])
    keep = ~np.repeat(many, ends - start)
    size = np.where(step, w - np.where(new, 0.0, np.r_[0.0, w[:-1]]), 0.0)[step & keep]  # of each step, in order
    number = np.cumsum(step & keep) - 1  # of an entry's last step
    row, level, number = row[keep], level[keep], number[keep]
    # an entry reaches its own step and all before it
    times = level + 1
    at = np.repeat(number - level, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row = np.repeat(row, times)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    la, lr = (at[row < left], row[row < left]) if sides else (at, row)
    ra, rr = (at[row >= base], row[row >= base] - base) if sides else (at, row)
    nl, nr = np.bincount(la, minlength=len(size)), np.bincount(ra, minlength=len(size))
    pairs = nl * nr
    dense = pairs * DENSE >= low.size
    dense &= pairs > (0 if sides else 1)
    wanted = np.flatnonzero(dense)
    place = np.full(len(size), -1)
    place[wanted] = np.arange(len(wanted))
    lp, rp = place[la], place[ra]  # ascend where they are not -1
    lx, rx = np.flatnonzero(lp >= 0), np.flatnonzero(rp >= 0)
    for c in range(0, len(wanted), COLUMNS):
        d = min(c + COLUMNS, len(wanted))
        own, other = np.zeros((left, d - c)), np.zeros((rows - base, d - c))
        x = lx[np.searchsorted(lp[lx], c) : np.searchsorted(lp[lx], d)]
        own[lr[x], lp[x] - c] = size[la[x]]
        x = rx[np.searchsorted(rp[rx], c) : np.searchsorted(rp[rx], d)]
        other[rr[x], rp[x] - c] = 1.0
        low += own @ other.T
    x = np.flatnonzero(~dense[la] & (pairs[la] > (0 if sides else 1)))
    first, sent = np.cumsum(nr) - nr, np.cumsum(nr[la[x]])
    flat, a = low.reshape(-1), 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(sent, (sent[a - 1] if a else 0) + PAIRS, side="right")))
        e = x[a:b]
        n = nr[la[e]]
        to = np.repeat(first[la[e]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flat += np.bincount(np.repeat(lr[e] * low.shape[1], n) + rr[to], weights=np.repeat(size[la[e]], n), minlength=len(flat))
        a = b
    return low


def _group_links(key: np.ndarray, w: np.ndarray, r: np.ndarray, side: np.ndarray, limit: float) -> np.ndarray:
    """Links of each row to the others if all are of side 0, else between sides 1 and 2.  ``r`` ascends."""
    n, sides = len(side), bool(side.any())
    out = np.zeros(n, dtype=np.int64)
    if not len(key):
        return out
    total = tb.row_sums(w, r, n)
    order = np.argsort(side, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    total, left = total[order], int((side == 1).sum()) if sides else n
    base = left if sides else 0
    low = _shared(np.unique(key, return_inverse=True)[1], w, rank[r], left, n, sides)
    hit = low >= limit * (total[:left, None] + total[None, base:] - low)
    hit &= (total[:left, None] > 0) & (total[None, base:] > 0)
    if sides:
        out[:left] = hit.sum(axis=1)
        out[left:] = hit.sum(axis=0)
    else:
        np.fill_diagonal(hit, False)
        out[:] = hit.sum(axis=1)
    return out[rank]


def _link_counts(texts: DataFrame, links: DataFrame, component: DataFrame, df: np.ndarray, n: int, cfg: NearDupConfig) -> DataFrame:
    """``(node, links)``: how many other nodes of its class each node with a link is linked to.

    Where ``links`` holds all pairs of a class, it is counted; the other classes are split into blocks
    by hash, and each pair of blocks of a class is compared whole by one task.
    """
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "node")
    of = materialize(component.join(degree, "node").select("node", "component", "links"))
    partial = of.groupBy("component").agg(F.count("*").alias("m"), F.sum("links").alias("ends")).where("ends < m * (m - 1)").select("component")
    full = of.join(partial, "component", "left_anti").select("node", "links")
    texts = materialize(of.join(partial, "component").select("component", "node").join(texts, "node").select("component", "node", "text"))
    if texts.isEmpty():
        return full
    parts = F.ceil(F.greatest(F.sum(F.octet_length("text")) / F.lit(float(BLOCK_BYTES)), F.count("*") / F.lit(float(BLOCK_ROWS)))).cast("int")
    placed = texts.join(texts.groupBy("component").agg(F.greatest(parts, F.lit(1)).alias("parts")), "component")
    placed = placed.withColumn("part", F.expr("CAST(pmod(xxhash64(node), parts) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    grouped = placed.select(
        F.concat_ws(":", F.hex("component"), F.least("part", "other"), F.greatest("part", "other")).alias("group"),
        F.expr("CASE WHEN part = other THEN 0 WHEN part < other THEN 1 ELSE 2 END").alias("side"),
        "node",
        "text",
    )
    spark = texts.sparkSession
    held, limit = spark.sparkContext.broadcast(df), cfg.threshold - 1e-9

    def count(t: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        *_, key, r, tf = _vectors(t.column(3), cfg)
        w = _weights(key, tf, held.value, n, cfg)
        side = t.column(1).to_numpy(zero_copy_only=False)
        got = []
        for a, b in zip([0, *ends], ends):
            x, y = np.searchsorted(r, [a, b])
            got.append(_group_links(key[x:y], w[x:y], r[x:y] - a, side[a:b], limit))
        return pa.RecordBatch.from_arrays([t.column(2), pa.array(np.concatenate(got))], names=["node", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back = None  # the last group of a batch may go on in the next
        for b in chain(batches, (None,)):
            t = b if held_back is None else held_back if b is None else pa.concat_batches([held_back, b])
            if t is None or not t.num_rows:
                continue
            g = t.column(0)
            ends = (np.flatnonzero(pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()
            held_back = None if b is None else t.slice(ends[-1] if ends else 0)
            ends += [len(g)] if b is None else []
            size = np.r_[0, np.cumsum(pc.binary_length(t.column(3)).to_numpy(zero_copy_only=False).astype(np.int64))]
            a, cut = 0, []
            for z in ends:
                cut.append(z)
                if size[z] - size[a] >= BLOCK_BYTES or z == ends[-1]:
                    yield count(t.slice(a, z - a), [c - a for c in cut])
                    a, cut = z, []

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = grouped.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(run, "node binary, links bigint")
    return counted.groupBy("node").agg(F.sum("links").alias("links")).unionByName(full)


def _texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, text)``: the text of each wanted node's row of least id; documents are shuffled once, repeated rows fall away where they meet."""
    w = nodes.select("node", "least").join(wanted, "node", "left_semi").select("node", "least.*")
    w = w.select("node", F.col("id").alias("wid"), F.col("th").alias("wth"), F.xxhash64("id", "th").alias("k"))
    t = docs.select("id", F.xxhash64("text").alias("th"), "text").withColumn("k", F.xxhash64("id", "th"))
    return t.join(w, "k").where(F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).dropDuplicates(["k", "node"]).select("node", "text")


def _classes(docs: DataFrame, cfg: NearDupConfig) -> tuple[DataFrame, DataFrame, Callable[[], DataFrame]]:
    """The rows ``(id, th, node)`` of ``(id, text)``, ``(node, class_id, class_size, copies, component)``, and a call for ``(node, links)``."""
    df, n = shingle_df(docs, "text", cfg)
    rows = materialize(sketches(docs, "id", "text", cfg, df, n))
    # texts of equal words are one node, whose row with the least id stands for all
    nodes = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th")).alias("least"), F.min("id").alias("least_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = materialize(nodes)
    member = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "node")
    busy = member.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).where("m > 1")
    sized = materialize(member.join(busy, "bucket").select("bucket", "node", "m", "pivot"))
    texts = materialize(_texts_of(sized.select("node").distinct(), nodes, docs))
    links = materialize(_links(sized, _Verifier(texts, nodes, cfg, df, n), cfg, n))
    component = materialize(connected_components(links, "a", "b"))
    known = nodes.select("node", "copies", "least_id").join(component, "node", "left")
    known = materialize(known.select("node", "copies", "least_id", F.coalesce("component", "node").alias("component")))
    classes = known.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    info = known.join(classes, "component").select("node", "class_id", "class_size", "copies", "component")
    return rows.select("id", "th", "node"), info, lambda: _link_counts(texts, links, component, df, n, cfg)


def _id_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """One line per row of ``docs``: ``(id, th, class_id, class_size, copies, links)``.

    ``class_id``: the least id of the class; ``class_size``: its rows; ``copies``: rows whose text has
    the same words in the same order; ``links``: other texts (of other words or another order) of the
    class whose exact similarity to this one reaches the threshold, each pair of the class compared,
    whichever way the buckets were decided and whatever else the table holds but for the shingle weights.
    Rows with null ids take part (a class without any id has a null class_id); null texts count as
    empty; texts without a word are classed by their bytes alone; repeated rows are copies; an empty
    table gives an empty result.  ``th`` is the xxhash64 of the text, to find a row again.
    """
    rows, info, count = _classes(_id_text(docs, doc_id, text), cfg)
    info = info.join(count(), "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return rows.join(info, "node").select("id", "th", "component", "class_id", "class_size", "copies", "links")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the least id (null ids last).

    All columns stay; of repeated rows one is kept, so no class is lost whole.
    """
    rows, info, _ = _classes(_id_text(docs, doc_id, text), cfg)
    found = rows.join(info.select("node", "component"), "node").select("id", "th", "component")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("w")).select("w.id", "w.th")
    best = best.select(F.col("id").alias("__nd_id"), F.col("th").alias("__nd_th")).join(found.groupBy(F.col("id").alias("__nd_id2"), F.col("th").alias("__nd_th2")).agg(F.count("*").alias("__nd_n")), (F.col("__nd_th") == F.col("__nd_th2")) & F.col("__nd_id").eqNullSafe(F.col("__nd_id2"))).select("__nd_id", "__nd_th", "__nd_n")
    best = materialize(best)
    hit = docs.withColumn("__nd_h", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(best, (F.col("__nd_h") == F.col("__nd_th")) & F.col(doc_id).eqNullSafe(F.col("__nd_id")))
    out = list(docs.columns)
    single = hit.where("__nd_n = 1").select(*[F.col(f"`{c}`") for c in out])
    w = Window.partitionBy("__nd_id", "__nd_th").orderBy(*[F.col(f"`{c}`") for c in out if docs.schema[c].dataType.typeName() != "map"])
    many = hit.where("__nd_n > 1").withColumn("__nd_r", F.row_number().over(w)).where("__nd_r = 1").select(*[F.col(f"`{c}`") for c in out])
    return single.unionByName(many)

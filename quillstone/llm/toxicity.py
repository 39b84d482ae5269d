"""Toxicity: a linear classifier of words and word beginnings, regularised by counterfactuals.

Training sentences that name a group are rendered again with every other term of the same kind in
its place; a penalty on the square of the score's change keeps the classifier from learning that a
neutral mention of a group is toxic.

Features are hashed into ``2**bits`` cells: each word, and its first three, four and five bytes.
Only cells whose log-odds between the classes differ by ``z`` standard errors take part, so long
clean texts do not gather noise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.materialize import materialize

from . import textbuf as tb

U64 = np.uint64

#: Kinds of interchangeable terms, by language.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("frauen", "männer"),
    ("muslime", "juden", "christen"),
    ("femmes", "hommes"),
    ("musulmans", "juifs", "chrétiens"),
    ("mujeres", "hombres"),
    ("musulmanes", "judíos", "cristianos"),
)


@dataclass(frozen=True)
class ToxicityConfig:
    """``sample``: at most so many labelled rows are fitted on (those of least hash of their id).

    ``swap``: weight of the counterfactual penalty.  ``swaps``: terms put in place of one, at most.
    """

    bits: int = 18
    sample: int = 24_000
    z: float = 3.0
    least: int = 5
    l2: float = 5e-5
    swap: float = 5.0
    swaps: int = 5
    steps: int = 600
    terms: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)


PREFIXES = (3, 4, 5)


def cells(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell) of every feature of every word, one kind of feature at a time."""
    raw, off = tb.buffer(tb.strings(texts, lower=True))
    h, s, e, first = tb.words(raw, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    top = U64(64 - bits)
    yield row, (h >> top).astype(np.int64)
    for n in PREFIXES:
        long = e - s > n
        x = tb.span_hash(raw, s[long], s[long] + n) * U64(2 * n + 0x9E3779B97F4A7C15)
        yield row[long], (x >> top).astype(np.int64)


def counterfactuals(text: str, terms: tuple[tuple[str, ...], ...], most: int) -> list[str]:
    """The text with its identity terms exchanged for others of their kind; none if it names no group."""
    where = {t: (g, i) for g, group in enumerate(terms) for i, t in enumerate(group)}
    pattern = _pattern(terms)
    if not pattern.search(text):
        return []
    longest = max(len(g) for g in terms)
    out = []
    for shift in range(1, min(most, longest - 1) + 1):

        def other(m: re.Match) -> str:
            g, i = where[m[0].lower()]
            return terms[g][(i + shift) % len(terms[g])]

        new = pattern.sub(other, text)
        if new != text and new not in out:
            out.append(new)
    return out


def terms_of(table: DataFrame, kind: str = "kind", term: str = "term") -> tuple[tuple[str, ...], ...]:
    """Identity terms for ``ToxicityConfig.terms`` from a table of ``(kind, term)``; kinds of one term have no exchange."""
    rows = table.select(F.col(kind).alias("k"), F.lower(F.trim(F.col(term))).alias("t")).where("k IS NOT NULL AND t <> ''")
    found = rows.groupBy("k").agg(F.array_sort(F.collect_set("t")).alias("t")).where(F.size("t") > 1).orderBy("k")
    return tuple(tuple(r.t) for r in found.collect())  # a word list


_patterns: dict = {}


def _pattern(terms) -> re.Pattern:
    if terms not in _patterns:
        words = sorted({t for g in terms for t in g}, key=len, reverse=True)
        _patterns[terms] = re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE)
    return _patterns[terms]


@dataclass
class ToxicityModel:
    """Weights by cell, ``2**bits`` floats, and the bias."""

    weight: np.ndarray
    bias: float
    bits: int

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text; a text without known features gets the bias alone."""
        rows = len(texts)
        total = np.full(rows, self.bias)
        hits = []
        for row, cell in cells(texts, self.bits):
            known = self.weight[cell] != 0
            hits.append((row[known] << self.bits) | cell[known])
        found = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        total += np.bincount(found >> self.bits, weights=self.weight[found & ((1 << self.bits) - 1)], minlength=rows)[:rows]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit_arrays(row: np.ndarray, col: np.ndarray, y: np.ndarray, swap_row: np.ndarray, swap_col: np.ndarray, swap_value: np.ndarray, swaps: int, width: int, cfg: ToxicityConfig) -> tuple[np.ndarray, float]:
    """Logistic regression on a binary matrix with an L2 and a counterfactual penalty, by Nesterov steps.

    ``swap_*``: the entries of the matrix of differences between texts and their counterfactuals.
    """
    n = len(y)
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    # step: one over the greatest curvature, by power iteration
    v, curve = np.ones(width + 1) / np.sqrt(width + 1), 1.0
    for _ in range(30):
        xv = (np.bincount(row, weights=v[col], minlength=n) + v[-1]) * (0.25 / n)
        u = np.append(np.bincount(col, weights=xv[row], minlength=width), xv.sum())
        if swaps:
            d = np.bincount(swap_row, weights=swap_value * v[swap_col], minlength=swaps)
            u[:-1] += np.bincount(swap_col, weights=(2 * cfg.swap / swaps) * d[swap_row] * swap_value, minlength=width)
        curve = float(np.linalg.norm(u))
        v = u / curve
    rate = 1.0 / (1.1 * curve + cfg.l2)
    vw, vb, pw, pb = w.copy(), b, w.copy(), b
    for t in range(cfg.steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(row, weights=vw[col], minlength=n) + vb, -30, 30)))
        g = (p - y) / n
        gw = np.bincount(col, weights=g[row], minlength=width) + cfg.l2 * vw
        if swaps:
            d = np.bincount(swap_row, weights=swap_value * vw[swap_col], minlength=swaps)
            gw += np.bincount(swap_col, weights=(2 * cfg.swap / swaps) * d[swap_row] * swap_value, minlength=width)
        w, b = vw - rate * gw, vb - rate * g.sum()
        m = t / (t + 3.0)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        pw, pb = w, b
    return w, b


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on the labelled rows whose crc32(id as text) mod 5 is not 0; at most ``cfg.sample`` ids of them.

    Rows without a label, an id or a text are not learnt from; several labels of one id are averaged.
    Without examples of both labels every score is the share of label 1, within 0.001 to 0.999 (0.001
    without any): a corpus that nobody has judged loses nothing.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    known = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0).orderBy(F.xxhash64("id"), "id").limit(cfg.sample)
    # at most cfg.sample pairs of numbers, so the broadcast is bounded
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    rows = materialize(rows.select("text", "y"))
    size = 1 << cfg.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, size), dtype=np.int64)
        n = np.zeros(2, dtype=np.int64)
        for t in batches:
            for a, z in tb.row_slices(t.column(0)):
                y = t.column(1).slice(a, z - a).to_numpy()
                n += np.bincount(y, minlength=2)
                seen = [np.unique((r << cfg.bits) | c) for r, c in cells(t.column(0).slice(a, z - a), cfg.bits)]
                seen = np.unique(np.concatenate(seen))
                r, c = seen >> cfg.bits, seen & (size - 1)
                for k in (0, 1):
                    acc[k] += np.bincount(c[y[r] == k], minlength=size)
        at = np.flatnonzero(acc.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[acc[0][at], n[0]]), pa.array(np.r_[acc[1][at], n[1]])], names=["cell", "n0", "n1"])

    got = rows.mapInArrow(count, "cell int, n0 bigint, n1 bigint").groupBy("cell").agg(F.sum("n0"), F.sum("n1")).toArrow()
    c, n0, n1 = (got.column(i).to_numpy() for i in range(3))
    all0, all1 = int(n0[c < 0].sum()), int(n1[c < 0].sum())
    if not all0 or not all1:
        share = min(max(all1 / (all0 + all1), 1e-3), 1 - 1e-3) if all0 + all1 else 1e-3
        return ToxicityModel(np.zeros(size), float(np.log(share / (1 - share))), cfg.bits)
    c, n0, n1 = c[c >= 0], n0[c >= 0].astype(float), n1[c >= 0].astype(float)
    odds = np.log((n1 + 0.5) / (all1 - n1 + 0.5)) - np.log((n0 + 0.5) / (all0 - n0 + 0.5))
    error = np.sqrt(1 / (n1 + 0.5) + 1 / (all1 - n1 + 0.5) + 1 / (n0 + 0.5) + 1 / (all0 - n0 + 0.5))
    chosen = np.sort(c[(np.abs(odds) > cfg.z * error) & (n0 + n1 >= cfg.least)])
    place = np.full(size, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    held = spark.sparkContext.broadcast(place)  # 2**bits * 4 bytes

    def select(texts: pa.Array) -> list[np.ndarray]:
        keys = np.unique(np.concatenate([(r << 32) | p for r, q in cells(texts, cfg.bits) for p in [held.value[q].astype(np.int64)] for r, p in [(r[p >= 0], p[p >= 0])]]))
        ends = np.searchsorted(keys, np.arange(1, len(texts) + 1) << 32)
        return np.split((keys & 0xFFFFFFFF).astype(np.int32), ends[:-1])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, z in tb.row_slices(t.column(0)):
                part = t.column(0).slice(a, z - a)
                own = select(part)
                swapped = [(i, s) for i, x in enumerate(part.to_pylist()) for s in counterfactuals(x, cfg.terms, cfg.swaps)]
                diff: list[list] = [[] for _ in own]
                if swapped:
                    for (i, _), new in zip(swapped, select(pa.array([s for _, s in swapped], pa.string()))):
                        diff[i].append(np.r_[np.setdiff1d(own[i], new), ~np.setdiff1d(new, own[i])].astype(np.int32).tolist())
                yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in own], pa.list_(pa.int32())), t.column(1).slice(a, z - a), pa.array(diff, pa.list_(pa.list_(pa.int32())))], names=["x", "y", "diff"])

    data = rows.mapInArrow(features, "x array<int>, y int, diff array<array<int>>").toArrow()
    x = data.column("x").combine_chunks()
    order = sorted(range(len(x)), key=lambda i: (data.column("y")[i].as_py(), x[i].as_py()))  # as rows come in any order
    data = data.take(pa.array(order))
    x = data.column("x").combine_chunks()
    count_x = np.diff(x.offsets.to_numpy())
    y = data.column("y").to_numpy().astype(float)
    sr, sc, sv, k = [], [], [], 0
    for lines in data.column("diff").to_pylist():
        for line in lines:
            for v in line:
                sr.append(k)
                sc.append(v if v >= 0 else ~v)
                sv.append(1.0 if v >= 0 else -1.0)
            k += 1
    w, b = fit_arrays(np.repeat(np.arange(len(y)), count_x), x.flatten().to_numpy(), y, np.array(sr, dtype=np.int64), np.array(sc, dtype=np.int64), np.array(sv), k, len(chosen), cfg)
    weight = np.zeros(size)
    weight[chosen] = w
    return ToxicityModel(weight, float(b), cfg.bits)


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row; null texts count as empty, null ids are never held out."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, z in tb.row_slices(t.column(1)):
                s = held.value.score(t.column(1).slice(a, z - a))
                yield pa.RecordBatch.from_arrays([t.column(0).slice(a, z - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under ``threshold``.

    Null and empty texts score as texts without known words, by the bias alone; ids play no part, so
    null and repeated ones are kept or dropped by their texts; texts are read whole, however long; an
    empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, z in tb.row_slices(t.column(at)):
                part = t.slice(a, z - a)
                yield part.filter(pa.array(held.value.score(part.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)

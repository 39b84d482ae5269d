"""Quality by hierarchical empirical Bayes.

A document classifier, fitted on labelled rows, gives each document a probability of being good.
Sites (hosts) and parts of sites (paths) get Beta posteriors from the probabilities of their other
documents: a path's prior is its host's posterior, a host's prior the whole corpus, and how strongly
each holds is read off the spread between the groups by moments.  So sparse sites shrink toward the
global rate.  A document's score adds its own log-odds to what its path's posterior says beyond the
global rate.  All sums are grouped aggregates, partially aggregated before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.materialize import materialize

from . import textbuf as tb


@dataclass(frozen=True)
class QualityConfig:
    """``sample``: at most so many labelled rows are fitted on (those of least hash of their id).

    ``threshold``: documents whose score reaches it are kept.  ``trust``: weight of the site's log-odds.
    """

    sample: int = 24_000
    l2: float = 1e-3
    steps: int = 40
    threshold: float = 0.5
    trust: float = 1.0
    most_strength: float = 1e6


FEATURES = ("log_words", "word_bytes", "distinct", "repeats", "symbols", "upper", "digits", "lines", "bars", "marks", "long_words")


def features(texts: pa.Array) -> np.ndarray:
    """One line of numbers per text, from all of it; zeros for a text without words."""
    rows = len(texts)
    low = tb.strings(texts, lower=True)
    raw, off = tb.buffer(low)
    h, s, e, first = tb.words(raw, off)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    per = np.maximum(n, 1)
    size = np.maximum(np.diff(off), 1)
    wl = (e - s).astype(float)
    _, ur, _ = tb.distinct_counts(h, row)
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    src, soff = tb.buffer(tb.strings(texts))
    kind = _KIND[src]
    count = lambda k: np.add.reduceat(np.r_[kind == k, False], soff[:-1]) * (np.diff(soff) > 0)
    ssize = np.maximum(np.diff(soff), 1)
    symbol, upper, digit, line, bar, mark = (count(k) for k in range(1, 7))
    return np.column_stack(
        [
            np.log1p(n),
            tb.row_sums(wl, row, rows) / per,
            np.bincount(ur, minlength=rows) / per,
            tb.row_sums(same, row, rows) / per,
            symbol / ssize,
            upper / ssize,
            digit / ssize,
            line / per,
            bar / per,
            mark / per,
            tb.row_sums((wl > 24).astype(float), row, rows) / per,
        ]
    ).astype(float)


_KIND = np.zeros(256, dtype=np.uint8)
for _c in range(33, 127):
    _KIND[_c] = 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 0 if 97 <= _c <= 122 else 5 if _c == 124 else 6 if chr(_c) in ".,;:?" else 1
_KIND[10] = 4


def _wide(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, x * x, x[:, :1] * x[:, 2:3], np.minimum(np.abs(x), 1.0)])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, texts: pa.Array) -> np.ndarray:
        """Log-odds that each text is good, within -12..12."""
        x = np.clip((features(texts) - self.mean) / self.scale, -6, 6)
        return np.clip(_wide(x) @ self.weight + self.bias, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, cfg: QualityConfig) -> QualityModel:
    """Logistic regression by Newton steps; without both labels the model knows only their share."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        width = _wide(np.zeros((1, len(FEATURES)))).shape[1]
        return QualityModel(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(width), float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = _wide(np.clip((x - mean) / scale, -6, 6))
    z = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], cfg.l2 * len(y))
    reg[-1] = 1e-6
    loss = np.inf
    for _ in range(cfg.steps):
        m = np.clip(z @ w, -30, 30)
        p = 1 / (1 + np.exp(-m))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(reg), z.T @ (p - y) + reg * w)
        w = w - step
        new = float(np.logaddexp(0, -np.where(y > 0.5, m, -m)).sum())
        if abs(loss - new) < 1e-7 * max(1.0, abs(new)):
            break
        loss = new
    return QualityModel(mean, scale, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", cfg: QualityConfig = QualityConfig(), all_labels: bool = True) -> QualityModel:
    """Fit the document classifier on labelled rows; ``all_labels=False`` leaves out ids with crc32 mod 5 = 0, to measure on."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    if not all_labels:
        known = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    known = known.orderBy(F.xxhash64("id"), "id").limit(cfg.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, z in tb.row_slices(t.column(0)):
                x = features(t.column(0).slice(a, z - a))
                yield pa.RecordBatch.from_arrays([t.column(1).slice(a, z - a), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["y", *FEATURES])

    # at most cfg.sample pairs of numbers, so the broadcast is bounded
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").select("text", "y")
    got = rows.mapInArrow(run, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    x = np.column_stack([got.column(f).to_numpy() for f in FEATURES]) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order], cfg)



def assess(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """``(doc_id, evidence, host_posterior, path_posterior, score, keep)`` per row of ``docs``.

    Null hosts are one host, null paths one path of their host; null and empty texts are judged by
    the classifier as texts without words; repeated rows count as often as they occur; the
    posteriors leave the row itself out; an empty table gives no rows.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (doc_id, host, path)}
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, z in tb.row_slices(t.column(3)):
                part = t.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(held.value.logit(part.column(3)))], names=["id", "host", "path", "z"])

    d = docs.select(F.col(doc_id).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"))
    d = materialize(d.mapInArrow(run, f"id {kinds[doc_id]}, host {kinds[host]}, path {kinds[path]}, z double"))
    p = 1.0 / (1.0 + F.exp(-F.col("z")))
    # sums in a fixed order of magnitude (2**-40), so that they do not depend on the order of rows
    exact = F.sum((p * F.lit(2.0**40)).cast("bigint").cast("decimal(38,0)"))
    paths = materialize(d.groupBy("host", "path").agg(F.count("*").alias("n"), exact.alias("s")))
    paths = paths.select("host", "path", "n", (F.col("s").cast("double") / 2.0**40).alias("s"))
    hosts = paths.groupBy(F.col("host").alias("h_host")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    if not total["n"]:
        return d.selectExpr("id AS doc_id", "z AS evidence", "z AS host_posterior", "z AS path_posterior", "z AS score", "true AS keep")
    mu = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6)

    def strength(groups: DataFrame, n: str, s: str, centre) -> float:
        g = groups.select(F.col(n).cast("double").alias("n"), (F.col(s) / F.col(n)).alias("m"), centre.alias("c"))
        r = g.agg(F.sum(F.col("n") * (F.col("m") - F.col("c")) ** 2).alias("between"), F.sum(F.col("n") * F.col("c") * (1 - F.col("c"))).alias("within"), F.count("*").alias("k"), F.sum("n").alias("all")).first()
        if not r["all"] or not r["within"]:
            return cfg.most_strength
        within = r["within"] / r["all"]
        spread = r["between"] / r["all"] - within * r["k"] / r["all"]
        return float(min(max(within / spread - 1, 1.0), cfg.most_strength)) if spread > 0 else cfg.most_strength

    k1 = strength(hosts, "hn", "hs", F.lit(mu))
    both = materialize(paths.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "n", "s", "hn", "hs"))
    k2 = strength(both, "n", "s", (F.col("hs") + k1 * mu) / (F.col("hn") + k1))
    j = d.join(both, F.col("host").eqNullSafe(F.col("b_host")) & F.col("path").eqNullSafe(F.col("b_path"))).withColumn("p", p)
    j = j.withColumn("host_posterior", (F.lit(k1 * mu) + F.col("hs") - F.col("p")) / (F.lit(k1) + F.col("hn") - 1))
    j = j.withColumn("path_posterior", (F.lit(k2) * F.col("host_posterior") + F.col("s") - F.col("p")) / (F.lit(k2) + F.col("n") - 1))
    safe = F.least(F.greatest(F.col("path_posterior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.col("z") + F.lit(cfg.trust) * (F.log(safe / (1 - safe)) - F.lit(float(np.log(mu / (1 - mu)))))
    j = j.withColumn("score", F.round(1.0 / (1.0 + F.exp(-z)), 9))
    return j.select(F.col("id").alias("doc_id"), F.round("z", 9).alias("evidence"), F.round("host_posterior", 9).alias("host_posterior"), F.round("path_posterior", 9).alias("path_posterior"), "score", (F.col("score") >= cfg.threshold).alias("keep"))

"""Document fingerprints by winnowing.

The hash of every run of ``k`` code points rolls out of one prefix sum; of each window of ``w`` such
hashes the least is chosen, the rightmost of equal ones, with its position.  Two texts that share
``k + w - 1`` code points in a row share a fingerprint; runs under ``k`` never match.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.plans.materialize import materialize

from . import textbuf as tb

U64 = np.uint64
_LOW = U64(0xFFFFFFFF)


@dataclass(frozen=True)
class WinnowConfig:
    """``group_bytes``: about so much text is ordered by one task when documents meet their successors.

    From ``small_groups`` groups on they grow with the corpus up to ``big_bytes`` each, and beyond that
    their number grows, so no task's share does.
    """

    k: int = 16
    w: int = 32
    group_bytes: int = 8 << 20
    small_groups: int = 4096
    big_bytes: int = 1 << 30

    def groups(self, total: int) -> int:
        n = total // self.group_bytes
        return int(max(1, n if n <= self.small_groups else max(self.small_groups, total // self.big_bytes)))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and where each text begins."""
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), off


def _grams(cp: np.ndarray, k: int) -> np.ndarray:
    """Upper 32 bits of the hash of each run of ``k`` code points."""
    p, inv = tb._powers(len(cp) + 1)
    c = np.zeros(len(cp) + 1, dtype=U64)
    np.cumsum((cp.astype(U64) + U64(1)) * p[:-1], out=c[1:])
    return tb.mix((c[k:] - c[:-k]) * inv[: len(cp) - k + 1]) >> U64(32)


def winnow(cp: np.ndarray, off: np.ndarray, cfg: WinnowConfig = WinnowConfig(), step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``cp``, 32-bit hash) of the chosen runs of all texts, by position.

    A text with fewer than ``w`` runs is one window; one shorter than ``k`` has one hash, of all of it.
    """
    k, w, n = cfg.k, cfg.w, len(cp)
    length = np.diff(off)
    where, what = [], []
    for a in range(0, n, step):
        b = min(n, a + step)
        piece = cp[a : min(n, b + w + k - 2)]
        if len(piece) < k + w - 1:
            break
        h = _grams(piece, k)
        key = (h << U64(32)) | (_LOW - np.arange(len(h), dtype=U64))
        size = 1
        while size < w:
            grow = min(size, w - size)
            key = np.minimum(key[:-grow], key[grow:])
            size += grow
        r0, r1 = np.searchsorted(off, a, side="right") - 1, np.searchsorted(off, b, side="left")
        bounds = np.clip(off[r0 : r1 + 1], a, b)
        end = np.repeat(off[r0 + 1 : r1 + 1], np.diff(bounds))[: len(key)]
        key = key[: len(end)]
        key = key[np.arange(a, a + len(key)) + (w + k - 1) <= end]
        where.append((_LOW - (key & _LOW)).astype(np.int64) + a)
        what.append((key >> U64(32)).astype(np.uint32))
    short = np.flatnonzero((length > 0) & (length < k + w - 1))
    for r in short:
        x = cp[off[r] : off[r + 1]]
        if len(x) >= k:
            h = _grams(x, k)
            i = len(h) - 1 - int(np.argmin(h[::-1]))
        else:
            h, i = _grams(x, len(x)), 0
        where.append(np.array([off[r] + i]))
        what.append(h[i : i + 1].astype(np.uint32))
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    pos, h = np.concatenate(where), np.concatenate(what)
    order = np.argsort(pos, kind="stable")
    pos, h = pos[order], h[order]
    new = np.r_[True, pos[1:] != pos[:-1]] if len(pos) else np.zeros(0, bool)
    return pos[new], h[new]


_HEX = np.array([list(f"{i:02x}".encode()) for i in range(256)], dtype=np.uint8)


def hex_strings(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The hashes of each text as one string, eight digits a hash, in order of position."""
    digits = _HEX[h.astype(">u4").view(np.uint8)].reshape(-1)
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(digits))])


def _sets(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(bounds) - 1, dtype=U64), np.diff(bounds))
    return np.unique((row << U64(32)) | h.astype(U64))


def likeness(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Jaccard similarity of each row's two sets of hashes; 1 if both are empty."""
    na, nb = (np.bincount((x >> U64(32)).astype(np.int64), minlength=rows) for x in (a, b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:][both[1:] == both[:-1]]
    ni = np.bincount((same >> U64(32)).astype(np.int64), minlength=rows)
    union = na + nb - ni
    return np.where(union > 0, ni / np.maximum(union, 1), 1.0)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: WinnowConfig = WinnowConfig()) -> DataFrame:
    """``(doc_id, n_chars, hashes, positions)`` per row; null texts count as empty, which have no hash."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, z in tb.row_slices(t.column(1), 1 << 20):
                cp, off = code_points([x or "" for x in t.column(1).slice(a, z - a).to_pylist()])
                pos, h = winnow(cp, off, cfg)
                bounds = np.searchsorted(pos, off)
                row = np.repeat(off[:-1], np.diff(bounds))
                at = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays([t.column(0).slice(a, z - a), pa.array(np.diff(off)), pa.ListArray.from_arrays(at, pa.array(h.astype(np.int64))), pa.ListArray.from_arrays(at, pa.array(pos - row))], names=["doc_id", "n_chars", "hashes", "positions"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars bigint, hashes array<bigint>, positions array<bigint>")


def edited(text: str, following: str) -> str:
    """The text whose last third (rounded down) gives way to as much of the beginning of the next."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _lists(pos: np.ndarray, bounds: np.ndarray, off: np.ndarray) -> pa.Array:
    """The positions of each text's hashes, counted from its start."""
    local = pos - np.repeat(off[:-1], np.diff(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(local.astype(np.int32)))


def compare(texts: list[str], cfg: WinnowConfig) -> list[pa.Array]:
    """Result columns, without the id, of all texts but the last, each followed by the next."""
    rows = len(texts) - 1
    cp, off = code_points(texts)
    pos, h = winnow(cp, off, cfg)
    bounds = np.searchsorted(pos, off)
    changed = [edited(x, y) for x, y in zip(texts[:-1], texts[1:])]
    ecp, eoff = code_points(changed)
    epos, eh = winnow(ecp, eoff, cfg)
    ebounds = np.searchsorted(epos, eoff)
    own, nxt = _sets(h[: bounds[-2]], bounds[:-1]), _sets(h[bounds[1] :], bounds[1:] - bounds[1])
    return [
        pa.array(np.diff(off)[:rows]),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed], pa.large_string()),
        hex_strings(h[: bounds[-2]], bounds[:-1]),
        hex_strings(eh, ebounds),
        pa.array(likeness(own, _sets(eh, ebounds), rows)),
        pa.array(likeness(own, nxt, rows)),
        _lists(pos[: bounds[-2]], bounds[:-1], off[:-1]),
        _lists(epos, ebounds, eoff),
    ]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions"]
_KINDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, edited_positions array<int>"


def _group(splits: list[tuple], kind: str, key: Column) -> Column:
    """How many of the descending ``splits`` lie above the key: in two steps over blocks of about their root."""
    if not splits:
        return F.lit(0)
    size = math.isqrt(len(splits) - 1) + 1
    one = f"struct<id:{kind},th:bigint>"
    held = [[{"id": i, "th": t} for i, t in splits[a : a + size]] for a in range(0, len(splits), size)]
    heads = F.from_json(F.lit(json.dumps([b[0] for b in held], default=str)), f"array<{one}>")
    blocks = F.from_json(F.lit(json.dumps(held, default=str)), f"array<array<{one}>>")
    above = lambda table: F.size(F.filter(table, lambda s: F.struct(s["id"].alias("id"), s["th"].alias("th")) > key))
    block = above(heads)
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * size + above(F.get(blocks, block - 1)))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cfg: WinnowConfig = WinnowConfig()) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row, by descending id (columns: ``NAMES``).

    ``fingerprint``: the chosen hashes in order of position, eight hexadecimal digits each; their
    positions, in code points, are in ``positions``; the same of the edited text.  ``near_``: Jaccard
    similarity of two sets of hashes, 1 if both are empty.
    Rows are dealt to groups by ranges of (id, hash of the text), and each group also gets the first
    row of the next one, so no order over all rows is ever made in one task and texts move once.
    Null ids come last; rows of one id go by the hash of their text; the row after the last is the
    first (itself, if it is alone); null texts count as empty; an empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    keys = materialize(d.select("id", "th", F.octet_length("text").alias("n")))
    rows, total = keys.agg(F.count("*"), F.sum("n")).first()
    if not rows:
        return d.selectExpr("id AS doc_id", "0L AS n_chars", "'' AS edited_sha256", "'' AS fingerprint", "'' AS edited_fingerprint", "0D AS near_edited", "0D AS near_next", "CAST(array() AS array<int>) AS positions", "CAST(array() AS array<int>) AS edited_positions")
    groups = cfg.groups(int(total))
    # splits from a bounded sample; they only balance the groups and never change a result
    sample = keys.select("id", "th").orderBy(F.xxhash64("id", "th", F.lit(5))).limit(groups * 20).toArrow()
    order = sorted(zip(sample.column(0).to_pylist(), sample.column(1).to_pylist()), key=lambda x: (x[0] is not None, x[0] or 0 if not isinstance(x[0], str) else x[0], x[1]))
    splits = list(dict.fromkeys(order[i * len(order) // groups] for i in range(1, groups)))[::-1]
    key = F.struct(F.col("id").alias("id"), F.col("th").alias("th"))
    group = _group(splits, kind, key)
    firsts = {g: (i, t) for g, i, t in keys.select(group.alias("g"), key.alias("k")).groupBy("g").agg(F.max("k").alias("k")).select("g", "k.id", "k.th").collect()}  # one row per group
    have = sorted(firsts)
    after = [(g, *firsts[have[(i + 1) % len(have)]]) for i, g in enumerate(have)]
    want = docs.sparkSession.createDataFrame(after, f"g int, wid {kind}, wth bigint")  # one row per group
    ends = d.join(F.broadcast(want), (F.col("th") == F.col("wth")) & F.col("id").eqNullSafe(F.col("wid"))).select("g", "id", "th", "text").dropDuplicates(["g"])
    every = d.select(group.cast("int").alias("g"), F.lit(False).alias("end"), "id", "th", "text").unionByName(ends.select("g", F.lit(True).alias("end"), "id", "th", "text"))
    every = every.repartition(max(1, len(have)), "g").sortWithinPartitions("g", "end", F.col("id").desc_nulls_last(), F.col("th").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for t in batches:
            for a, z in tb.row_slices(t.column(2), 1 << 20):
                part = t.slice(a, z - a)
                ends, ids, texts = part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()
                if held is not None:
                    ends, ids, texts = [held[0], *ends], pa.concat_arrays([held[1], ids]), [held[2], *texts]
                if len(texts) > 1:
                    out = pa.RecordBatch.from_arrays([ids.slice(0, len(ids) - 1), *compare(texts, cfg)], names=NAMES)
                    yield out.filter(pa.array([not e for e in ends[:-1]]))
                held = ends[-1], ids.slice(len(ids) - 1, 1), texts[-1]

    return every.select("end", "id", "text").mapInArrow(run, f"doc_id {kind}, {_KINDS}")

"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document leaks an item if some run of its words is within ``rate`` word edits of the item.
Windows of the item's size that cannot be (by the q-gram lemma they hold too few of the items'
word pairs) are passed over, which loses nothing.  Every other window is embedded by the random
walk of Chakraborty, Goldenberg and Koucky, under which edit distance becomes Hamming distance;
tables keyed by sampled positions of the embedding give candidates, and a candidate counts only
after its exact edit distance.  The number of tables is raised until edited copies of the items,
made with as many edits as the rate allows, are found at the target recall; where no number of
tables does, every window that the word pairs let through is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textbuf as tb

U64 = np.uint64


@dataclass(frozen=True)
class LeakConfig:
    """``rate``: edits per word of the item.  ``recall``: target of the candidate search for one match.

    ``max_tables``: where so many tables miss the target, there are none, and every window that the
    word pairs let through is verified, which misses nothing.  ``min_words``: items of fewer words
    are no evidence.  ``block_bytes``: an index takes so much memory at most (a single item may take
    more); a larger benchmark is worked through in blocks.
    """

    rate: float = 0.2
    recall: float = 0.995
    min_words: int = 1
    positions: int = 3
    walks: int = 6
    max_tables: int = 240
    block_bytes: int = 256 << 20
    seed: int = 7


def edit_distances(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edit distance of ``pattern`` to a substring of ``text`` that ends at each place 0..len(text)."""
    n = len(text)
    j = np.arange(n + 1)
    prev = np.zeros(n + 1, dtype=np.int64)
    for i, x in enumerate(pattern):
        cur = np.empty(n + 1, dtype=np.int64)
        cur[0] = i + 1
        cur[1:] = np.minimum(prev[:-1] + (text != x), prev[1:] + 1)
        prev = np.minimum.accumulate(cur - j) + j
    return prev


#: Bytes of embeddings and of windows that are held at a time.
_CHUNK = 32 << 20


class LeakIndex:
    """The tables of one block of items.  ``recall`` is what the candidate search was measured to find."""

    def __init__(self, ids: list, texts: list[str], cfg: LeakConfig):
        self.cfg = cfg
        h, _, _, first = tb.words(*tb.buffer(tb.strings(pa.array(texts, pa.large_string()), lower=True)))
        own = [(i, h[a:b]) for i, a, b in zip(ids, first[:-1], first[1:]) if b - a >= max(1, cfg.min_words)]
        self.ids = [i for i, _ in own]
        self.items = [x for _, x in own]
        self.n = np.array([len(x) for x in self.items], dtype=np.int64)
        self.k = np.floor(self.n * cfg.rate).astype(np.int64)
        #: windows of long items start every so many words; the tables are calibrated with that
        self.stride = np.maximum(1, self.k // 4)
        one = np.flatnonzero(self.n == 1)
        order = np.argsort([int(self.items[i][0]) for i in one], kind="stable") if len(one) else one
        self.single_owner = one[order]
        self.single = np.array([self.items[i][0] for i in self.single_owner], dtype=U64)
        self._sieve()
        g = np.random.RandomState(cfg.seed)
        self.seeds = g.randint(1, 2**62, cfg.walks, dtype=np.int64).astype(U64)
        self.where = np.sort(g.uniform(0, 1, (cfg.max_tables, cfg.positions)), axis=1)
        self.tables, self.recall = cfg.max_tables, 1.0
        if len(self.n):
            self._calibrate(g)
        if self.tables and len(self.n):
            flat = self._all_keys(self.items).reshape(-1)
            order = np.argsort(flat, kind="stable")
            self.keys, self.owner = flat[order], np.repeat(np.arange(len(self.n)), self.tables)[order]

    def _calibrate(self, g: np.random.RandomState) -> None:
        """Least number of tables that finds the target share of items after as many edits as allowed.

        The edited copies also lie off their window by up to half a stride.  If all tables together
        fall short, there are none and ``search`` verifies every window.
        """
        count = int(np.clip(400_000 / self.n.mean(), 50, 1000))
        items, edited = [], []
        for i in g.randint(len(self.items), size=count):
            x, shift = self.items[i], int(g.randint(self.stride[i] // 2 + 1))
            y = list(x)
            for _ in range(int(self.k[i])):
                at, kind = g.randint(len(y)), g.randint(3)
                new = U64(g.randint(1, 2**62))
                if kind == 0:
                    y[at] = new
                elif kind == 1:
                    y.insert(at, new)
                elif len(y) > 1:
                    del y[at]
            fill = g.randint(1, 2**62, len(x) + shift, dtype=np.int64).astype(U64)
            y = np.concatenate([np.array(y, dtype=U64)[shift:], fill] if g.randint(2) else [fill[:shift], np.array(y, dtype=U64), fill])
            items.append(x)
            edited.append(y[: len(x)])
        same = self._all_keys(items) == self._all_keys(edited)
        found = np.logical_or.accumulate(same, axis=1).mean(axis=0)
        enough = np.flatnonzero(found >= self.cfg.recall)
        self.tables, self.recall = (int(enough[0]) + 1, float(found[enough[0]])) if len(enough) else (0, 1.0)
        self.where = self.where[: self.tables]

    def _all_keys(self, texts: list[np.ndarray]) -> np.ndarray:
        """Keys of texts of any length: those of like length together, so many at a time as fit."""
        n = np.array([len(x) for x in texts], dtype=np.int64)
        keys = np.empty((len(texts), self.tables), dtype=U64)
        for part in _alike(n, self.cfg.walks):
            w = np.zeros((len(part), int(n[part].max())), dtype=U64)
            for i, j in enumerate(part):
                w[i, : n[j]] = texts[j]
            keys[part] = self._keys(w, n[part])
        return keys

    def _keys(self, windows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hash of each window's sampled places in each table.  A window's words end at its ``n``."""
        m, width = windows.shape
        walks = self.cfg.walks
        out = np.zeros((walks, m, 3 * width), dtype=U64)
        padded = np.concatenate([windows, np.zeros((m, 1), dtype=U64)], axis=1)
        line = np.arange(m)
        at = np.zeros((walks, m), dtype=np.int64)
        seeds = tb.mix(self.seeds[:, None] ^ (np.arange(1, 3 * width + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))[None, :])
        for j in range(3 * width):
            sym = padded[line, at]
            out[:, :, j] = sym
            step = ((sym * U64(0x9E3779B97F4A7C15) ^ seeds[:, j : j + 1]) * U64(0xD6E8FEB86659FD93)) >> U64(63)
            at += step.astype(np.int64)
            np.minimum(at, n, out=at)
        keys = np.empty((m, self.tables), dtype=U64)
        for t in range(self.tables):
            key = np.full(m, t + 1, dtype=U64) * U64(0x9FB21C651E98DF25) + n.astype(U64)
            for p in self.where[t]:
                key = tb.mix(key ^ out[t % walks, line, (p * 3 * n).astype(np.int64)])
            keys[:, t] = key
        return keys

    def _sieve(self) -> None:
        """Word pairs of the items, for a lossless choice of windows.

        ``k`` edits destroy at most ``2 * k`` of an item's ``d`` distinct pairs, so a match holds ``need =
        max(1, d - 2 * k)`` of them, and one at least of any ``d - need + 1``: of the rarest, here.
        """
        pairs = [_pairs(x)[:-1] for x in self.items]
        words, freq = np.unique(np.concatenate(self.items), return_counts=True) if self.items else (np.zeros(0, U64), np.zeros(0))
        keys, pre, owner, offset = [], [], [], []
        self.need = np.zeros(len(pairs), dtype=np.int64)
        for o, (x, g) in enumerate(zip(self.items, pairs)):
            u, at = np.unique(g, return_index=True)
            f = freq[np.searchsorted(words, x)].astype(float)
            rare = (f[:-1] * f[1:])[at]
            self.need[o] = max(1, len(u) - 2 * self.k[o])
            few = u[np.argsort(rare, kind="stable")[: len(u) - self.need[o] + 1]]
            keys.append(tb.mix(u ^ U64((o + 1) * 0x9E3779B97F4A7C15 % 2**64)))
            p = np.flatnonzero(np.isin(g, few))
            pre.append(g[p])
            offset.append(p)
            owner.append(np.full(len(p), o))
        cat = lambda v, d: np.concatenate(v) if v else np.zeros(0, d)
        self.all_keys = np.sort(cat(keys, U64))
        pre, owner, offset = cat(pre, U64), cat(owner, np.int64), cat(offset, np.int64)
        order = np.argsort(pre, kind="stable")
        self.pre, self.pre_owner, self.pre_offset = pre[order], owner[order], offset[order]
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(pre)) * 32))))
        self.sieve = np.zeros(1 << self.bits, dtype=bool)
        self.sieve[(self.pre >> U64(64 - self.bits)).astype(np.int64)] = True

    def _windows(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of all windows near which enough of an item's word pairs occur."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = _pairs(h)
        hit = self.sieve[(g >> U64(64 - self.bits)).astype(np.int64)]
        hit[first[1:][first[1:] > 0] - 1] = False  # pairs across rows
        at = np.flatnonzero(hit)
        lo, hi = np.searchsorted(self.pre, g[at], side="left"), np.searchsorted(self.pre, g[at], side="right")
        count = hi - lo
        if not count.sum():
            return none
        post = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        at = np.repeat(at, count)
        o = self.pre_owner[post]
        row = np.searchsorted(first, at, side="right") - 1
        step = self.stride[o]
        start = (at - self.pre_offset[post]) // step * step  # a match starts at most k before and k + step after it
        _, one = np.unique(np.stack([o, start, row]), axis=1, return_index=True)
        o, row, start, step = o[one], row[one], start[one], step[one]
        k, n = self.k[o], self.n[o]
        ok = np.zeros(len(o), dtype=bool)
        reach = n + 3 * k + step
        for part in _alike(reach, 1):
            span = int(reach[part].max())
            place = (start - k)[part, None] + np.arange(span)
            inside = (np.arange(span) < reach[part, None] - 1) & (place >= first[row[part]][:, None]) & (place < first[row[part] + 1][:, None] - 1)
            key = tb.mix(g[np.clip(place, 0, len(h) - 1)] ^ ((o[part, None] + 1).astype(U64) * U64(0x9E3779B97F4A7C15)))
            member = inside & (self.all_keys[np.minimum(np.searchsorted(self.all_keys, key), len(self.all_keys) - 1)] == key)
            need = self.need[o[part]]
            for i in np.flatnonzero(member.sum(axis=1) >= need):
                ok[part[i]] = len(np.unique(key[i][member[i]])) >= need[i]
        if not ok.any():
            return none
        k, row, start, step, o = k[ok], row[ok], start[ok], step[ok], o[ok]
        wide = 2 * (-(-k // step)) + 2
        s = np.repeat(start - (-(-k // step)) * step, wide) + (np.arange(wide.sum()) - np.repeat(np.r_[0, np.cumsum(wide)[:-1]], wide)) * np.repeat(step, wide)
        r, o = np.repeat(row, wide), np.repeat(o, wide)
        inside = (s >= first[r]) & (s < first[r + 1])
        near = np.clip(s, first[r], first[r + 1] - 1)[~inside & (s < first[r]) & (s + np.repeat(step, wide) > first[r])]
        edge = ~inside & (s < first[r]) & (s + np.repeat(step, wide) > first[r])
        both = np.unique(np.stack([np.r_[s[inside], near], np.r_[o[inside], o[edge]]]), axis=1)
        return both[0], both[1]

    def _candidates(self, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """Places by (row, item) at which a match may start."""
        found: dict[tuple[int, int], list[int]] = {}
        start, item = self._windows(h, first)
        if not self.tables:
            for s, o, r in zip(start.tolist(), item.tolist(), (np.searchsorted(first, start, side="right") - 1).tolist()):
                found.setdefault((r, o), []).append(s)
            return found
        start, size = np.unique(np.stack([start, self.n[item]]), axis=1) if len(start) else (start, start)
        for part in _alike(size, self.cfg.walks):
            s, n = start[part], size[part]
            width = int(n.max())
            row = np.searchsorted(first, s, side="right") - 1
            place = s[:, None] + np.arange(width)
            w = h[np.minimum(place, len(h) - 1)]
            w[(np.arange(width) >= n[:, None]) | (place >= first[row + 1][:, None])] = 0
            keys = self._keys(w, n).reshape(-1)
            lo, hi = np.searchsorted(self.keys, keys, side="left"), np.searchsorted(self.keys, keys, side="right")
            for q in np.flatnonzero(hi > lo):
                i = q // self.tables
                for o in {*self.owner[lo[q] : hi[q]].tolist()}:
                    found.setdefault((int(row[i]), o), []).append(int(s[i]))
        return found

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, end word) of the best match of each pair of row and item."""
        if not self.items or not len(texts):
            return []
        h, _, _, first = tb.words(*tb.buffer(tb.strings(texts, lower=True)))
        if not len(h):
            return []
        out = []
        if len(self.single):  # items of one word: that word
            lo, hi = np.searchsorted(self.single, h, side="left"), np.searchsorted(self.single, h, side="right")
            at = np.flatnonzero(hi > lo)
            row = np.searchsorted(first, at, side="right") - 1
            seen = set()
            for p, r, a, b in zip(at.tolist(), row.tolist(), lo[at].tolist(), hi[at].tolist()):
                for o in self.single_owner[a:b].tolist():
                    if (r, o) not in seen:
                        seen.add((r, o))
                        out.append((r, o, 0, p - int(first[r]), p - int(first[r]) + 1))
        for (r, o), places in self._candidates(h, first).items():
            item, k, step = self.items[o], int(self.k[o]), int(self.stride[o])
            best = None
            places = sorted(set(places))
            a = places[0]
            for p, nxt in zip(places, [*places[1:], None]):
                if nxt is not None and nxt - p <= len(item):
                    continue
                lo, hi = max(int(first[r]), a - k - step), min(int(first[r + 1]), p + len(item) + k + step)
                d = edit_distances(item, h[lo:hi])
                e = int(d.argmin())
                if d[e] <= k and (best is None or d[e] < best[0]):
                    back = edit_distances(item[::-1], h[lo : lo + e][::-1])
                    begin = lo + e - int(np.flatnonzero(back == d[e])[0]) if (back == d[e]).any() else lo
                    best = (int(d[e]), begin - int(first[r]), lo + e - int(first[r]))
                a = nxt
            if best is not None:
                out.append((r, o, *best))
        return sorted(out)


def _alike(sizes: np.ndarray, each: int) -> Iterator[np.ndarray]:
    """Indexes in groups of like size (within twice), of about ``_CHUNK`` bytes of ``each`` * 3 words a group."""
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        least = max(1, int(sizes[order[a]]))
        z = int(np.searchsorted(sizes[order], 2 * least, side="right"))
        rows = max(1, _CHUNK // (24 * each * int(sizes[order[z - 1]] or 1)))
        yield order[a : min(z, a + rows)]
        a = min(z, a + rows)


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one; of the last with nothing."""
    nxt = np.zeros_like(h)
    nxt[:-1] = h[1:]
    return tb.mix((h ^ (h >> U64(27))) * U64(0x9FB21C651E98DF25) + nxt)


def leak_indexes(benchmark: DataFrame, item_id: str, text: str, cfg: LeakConfig) -> Iterator[LeakIndex]:
    """Indexes of blocks of items, each of ``cfg.block_bytes`` at most on average.

    An item takes its keys in all tables there may be, and at most 48 bytes a byte of its text.
    """
    b = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = b.agg(F.sum(F.octet_length("text") * 48 + 16 * cfg.max_tables)).first()[0] or 0
    blocks = max(1, -(-int(total) // cfg.block_bytes))
    for i in range(blocks):
        part = b.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).toArrow()
        rows = sorted(zip(part.column(0).to_pylist(), part.column(1).to_pylist()), key=lambda x: (x[0] is None, x))
        yield LeakIndex([x for x, _ in rows], [t for _, t in rows], cfg)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """``(doc_id, item_id, distance, n_words, first_word, end_word)`` of each leaked item of each row.

    Where an item occurs more than once in a row, the match of least distance (then the first)
    counts.  Items and texts may be of any length; an item of one word is found wherever that word is.  Null and empty texts match nothing; null ids stay null; repeated rows and repeated
    items each give their own lines; an empty benchmark or table gives no lines.
    """
    ds, bs = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    kind = to_arrow_type(benchmark.schema[item_id].dataType)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in leak_indexes(benchmark, item_id, item_text, cfg):
        held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by cfg.block_bytes

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                for x, y in tb.row_slices(b.column(1)):
                    got = index.search(b.column(1).slice(x, y - x))
                    rows = pa.array([x + g[0] for g in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), pa.array([index.ids[g[1]] for g in got], kind), *(pa.array([int(v) for v in col], pa.int32()) for col in ([g[2] for g in got], [len(index.items[g[1]]) for g in got], [g[3] for g in got], [g[4] for g in got]))],
                        names=["doc_id", "item_id", "distance", "n_words", "first_word", "end_word"],
                    )

        part = d.mapInArrow(run, f"doc_id {ds}, item_id {bs}, distance int, n_words int, first_word int, end_word int")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item; edge cases as in ``find_leaks``."""
    out = docs
    at = docs.columns.index(text)
    for index in leak_indexes(benchmark, item_id, item_text, cfg):
        held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by cfg.block_bytes

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x, y in tb.row_slices(b.column(at)):
                    part = b.slice(x, y - x)
                    keep = np.ones(y - x, dtype=bool)
                    keep[[g[0] for g in held.value.search(part.column(at))]] = False
                    yield part if keep.all() else part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out

"""URL filters: one bit-parallel automaton for all glob rules.

Rules become Shift-And masks, packed side by side into as many 64-bit words as they need.  A step
over one byte of the canonical URL moves the states of every rule at once, for a whole batch of URLs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb

U64 = np.uint64
#: Separates host and path in the canonical URL: a byte that no UTF-8 text holds.
SEP = b"\xff"
#: So many globs share an automaton; more of them make more automata.
BLOCK_RULES = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` are globs (``*`` any run, ``?`` one byte); the path may be empty.

    A rule without glob signs in its host also fits all subdomains, and its path is a prefix.
    """

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def plain(self) -> bool:
        return not re.search(r"[*?]", self.host)

    @property
    def parts(self) -> tuple[str, str]:
        """Globs of the host, with a dot before it, and of the path."""
        return f"*.{self.host}" if self.plain else f".{self.host}", self.path + ("*" if self.plain else "")

    @property
    def glob(self) -> bytes:
        return SEP.join(x.encode() for x in self.parts)


#: The rules that the contract of ``op2`` fixes.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: What decides where no rule fits: names of sites and of files that hold no prose.
GLOBS = (
    *(Rule("block", f"*{w}*", "*") for w in ("casino", "poker", "betting", "porn", "xxx", "escort", "viagra", "pharm-", "warez", "torrent", "free-download", "adserver", "doubleclick")),
    Rule("block", "ads.*", "*"),
    *(Rule("block", "*", f"*/{w}/*") for w in ("login", "cart", "checkout", "wp-admin", "cgi-bin")),
    *(Rule("block", "*", f"*.{w}") for w in ("zip", "exe", "jpg", "jpeg", "png", "gif", "mp3", "mp4", "css", "js")),
)


class Automaton:
    """Shift-And masks of globs over bytes; ``*`` left of the separator does not cross it."""

    def __init__(self, globs: list[bytes]):
        bits = 0
        plans = []
        for g in globs:
            tokens: list[int | None] = []
            loops = set()
            for ch in g:
                if ch == ord("*"):
                    loops.add(len(tokens))
                else:
                    tokens.append(None if ch == ord("?") else ch)
            plans.append((bits, tokens, loops))
            bits += len(tokens) + 1
        self.words = max(1, -(-bits // 64))
        take = np.zeros((256, self.words), dtype=U64)
        stay = np.zeros((256, self.words), dtype=U64)
        self.start = np.zeros(self.words, dtype=U64)
        self.final = []
        for base, tokens, loops in plans:
            self._set(self.start, base)
            sep = tokens.index(SEP[0]) if SEP[0] in tokens else len(tokens)
            for i, t in enumerate(tokens):
                for c in range(256) if t is None else (t,):
                    if t is None and i < sep and c == SEP[0]:
                        continue
                    self._set(take[c], base + i + 1)
            for i in loops:
                for c in range(256):
                    if i <= sep and c == SEP[0]:
                        continue
                    self._set(stay[c], base + i)
            self.final.append(base + len(tokens))
        self.take, self.stay = np.ascontiguousarray(take.T), np.ascontiguousarray(stay.T)

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= U64(1 << (bit % 64))

    def matches(self, urls: pa.Array) -> np.ndarray:
        """(url, rule) matrix of matches of canonical URLs, as a binary column."""
        raw, off = tb.buffer(urls.cast(pa.large_binary()))
        n, length = len(urls), np.diff(off)
        order = np.argsort(-length, kind="stable")
        first, length = off[:-1][order], length[order]
        state = np.repeat(self.start[:, None], n, axis=1)
        live = n
        for j in range(int(length[0]) if n else 0):
            while live and length[live - 1] <= j:
                live = int(np.searchsorted(-length, -j, side="left"))
            c = raw[first[:live] + j]
            old = state[:, :live]
            moved = old << U64(1)
            moved[1:] |= old[:-1] >> U64(63)
            state[:, :live] = (moved & self.take[:, c]) | (old & self.stay[:, c])
        out = np.empty((n, len(self.final)), dtype=bool)
        for k, bit in enumerate(self.final):
            out[order, k] = (state[bit // 64] >> U64(bit % 64)) & U64(1)
        return out


def first_match(machines: list[Automaton], urls: pa.Array) -> np.ndarray:
    """Index of the first glob, over all automata, that fits each URL; their number if none does."""
    total = sum(len(m.final) for m in machines)
    out, base = np.full(len(urls), total), 0
    for m in machines:
        hit = m.matches(urls)
        best = np.where(hit.any(axis=1), hit.argmax(axis=1) + base, total)
        out = np.minimum(out, best)
        base += len(m.final)
    return out


def automata(rules: list[Rule]) -> list[Automaton]:
    globs = [r.glob for r in rules]
    return [Automaton(globs[i : i + BLOCK_RULES]) for i in range(0, len(globs), BLOCK_RULES)]


def canonical(host: pa.Array, path: pa.Array) -> pa.Array:
    """A dot, the host, the separator and the path, as bytes."""
    b = lambda x: pc.cast(x, pa.large_binary())
    return pc.binary_join_element_wise(pa.scalar(b".", pa.large_binary()), b(host), pa.scalar(SEP, pa.large_binary()), b(path), pa.scalar(b"", pa.large_binary()))


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, globs: tuple[Rule, ...] = GLOBS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, glob)`` per row.

    The longest fitting rule decides; where none fits, the longest fitting glob; where none of these
    fits either, a URL is allowed if it has a host and blocked if not.  Null and empty URLs have
    empty host and path; repeated rows are judged alike; of equally long rules the first decides;
    URLs may be of any length and hold any character, line feeds too; an empty table gives no rows.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    tiers = [sorted(t, key=lambda r: -len(r.text)) for t in (rules, globs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [automata(t) for t in tiers]
        names = [np.array([*(r.text for r in t), None], dtype=object) for t in tiers]
        verdicts = [np.array([*(r.verdict for r in t), None], dtype=object) for t in tiers]
        for t in batches:
            for a, z in tb.row_slices(t.column(2), 1 << 18):
                part = t.slice(a, z - a)
                urls = canonical(part.column(1), part.column(2))
                best = [first_match(m, urls) for m in machines]
                default = np.where(np.array([bool(x) for x in part.column(1).to_pylist()]), "allow", "block")
                found = [v[b] for v, b in zip(verdicts, best)]
                verdict = np.where(found[0] != None, found[0], np.where(found[1] != None, found[1], default))  # noqa: E711
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(names[0][best[0]], pa.string()), pa.array(verdict, pa.string()), pa.array(np.where(found[0] == None, names[1][best[1]], None), pa.string())],  # noqa: E711
                    names=["page_id", "host", "path", "rule", "verdict", "glob"],
                )

    d = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return d.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, glob string")


def _regex(glob: str) -> str:
    return "(?s)" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in glob)


def oracle(rules: tuple[Rule, ...] = RULES, globs: tuple[Rule, ...] = GLOBS) -> str:
    """DuckDB SQL for ``judge`` over ``pages``."""

    def case(tier: tuple[Rule, ...], what) -> str:
        fits = lambda r: " AND ".join(f"regexp_full_match({c}, '{_regex(g)}')" for c, g in zip(("'.' || host", "path"), r.parts))
        lines = [f"WHEN {fits(r)} THEN '{what(r)}'" for r in sorted(tier, key=lambda r: -len(r.text))]
        return "CASE " + " ".join(lines) + " END"

    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, {case(rules, lambda r: r.text)} AS rule, {case(rules, lambda r: r.verdict)} AS v, {case(globs, lambda r: r.text)} AS g, {case(globs, lambda r: r.verdict)} AS gv FROM u)
SELECT page_id, host, path, rule, coalesce(v, gv, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN g END AS glob FROM r
"""

"""Mixing sources to target weights: a time-varying curriculum.

Every source has a schedule, its weight as a piecewise linear function of training time 0..1.
A source's share of all words follows its weight, and no source is taken more than ``max_epochs``
times; what that leaves over is shared again by weight.  The words taken of a source form a stream,
ordered by hash of the id and the text, pass after pass.  The integral of the schedule says which part of the
stream is due at which time; its inverse gives each taken document its training position, and a
range sort by position is the training order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.materialize import materialize

#: (time, relative weight) knots from time 0 to time 1.
Schedule = Sequence[tuple[float, float]]

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """``weights`` repeat over the sources by code point, null last; ``schedules`` belong to them.

    ``block_rows``: about so many rows are ordered by one task; a source of any size is spread so.
    """

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    schedules: tuple[Schedule, ...] = (
        ((0.0, 1.5), (1.0, 0.5)),
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    )
    max_epochs: int = 3
    block_rows: int = 20_000


def source_targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """``(source, source_size, turn, target)``: shares by weight, none above ``max_epochs`` times its size.

    The water level is the first one, going up the sources by size per weight, that lies under the
    next source's cap.  One row per source, so its windows over all sources are small.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in cfg.weights]), (F.col("turn") + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("turn", (F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % len(cfg.weights))
    s = s.withColumn("w", w).withColumn("cap", (F.col("source_size") * cfg.max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    up = every.orderBy(F.col("ratio"), F.col("source").isNull(), F.col("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    return s.select("source", "source_size", "turn", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def position(share: Column, schedule: Schedule) -> Column:
    """Inverse of the integral of a schedule: the time at which ``share`` (0..1) of the demand is reached."""
    t, w = [float(x) for x, _ in schedule], [float(x) for _, x in schedule]
    area = [0.0]
    for i in range(len(t) - 1):
        area.append(area[-1] + (t[i + 1] - t[i]) * (w[i] + w[i + 1]) / 2)
    if area[-1] <= 0 or min(w) < 0 or t[0] != 0.0 or t[-1] != 1.0:
        raise ValueError("a schedule runs from time 0 to time 1 and has weight")
    need = share * F.lit(area[-1])
    out = None
    for i in reversed(range(len(t) - 1)):
        slope = (w[i + 1] - w[i]) / (t[i + 1] - t[i])
        rest = need - F.lit(area[i])
        if slope == 0:
            x = F.lit(t[i]) + (rest / F.lit(w[i]) if w[i] else F.lit(0.0))
        else:
            x = F.lit(t[i]) + (F.sqrt(F.greatest(F.lit(w[i] * w[i]) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w[i])) / F.lit(slope)
        out = x if out is None else F.when(need < F.lit(area[i + 1]), x).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cfg: MixConfig = MixConfig()) -> DataFrame:
    """``docs`` with ``__mx_size, __mx_total, __mx_target, __mx_passes, __mx_before, __mx_turn``.

    ``__mx_before``: words of the source that come before the row in one pass.  Whole passes take
    every row; the last, partial one takes the rows whose middle lies within what is left of the
    target, so a source misses it by half a row at most.  Null texts have size 0; null sources are
    one source, the last; null and repeated ids are told apart by their texts, and rows equal in both
    are interchangeable; sources without words have target 0; an empty table gives no rows.
    """
    d = docs.withColumn("__mx_size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"))
    d = d.withColumn("__mx_key", F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\x1f"), F.md5(F.coalesce(F.col(text), F.lit("")))))).withColumn("__mx_src", F.col(source))
    # the narrow columns once: sizes of sources and of blocks of a source come from them
    narrow = materialize(d.select(F.col("__mx_src").alias("source"), F.col("__mx_size").alias("size"), F.substring("__mx_key", 1, 5).alias("head")))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = materialize(source_targets(sizes.select("source", "source_size"), cfg))
    most = sizes.agg(F.max("rows")).first()[0] or 0
    digits = 0  # hex digits of the key that name a block: ids hash evenly, so blocks are even
    while digits < 5 and most > cfg.block_rows * 16**digits:
        digits += 1
    head = F.substring("head", 1, digits) if digits else F.lit("")
    blocks = narrow.groupBy("source", head.alias("block")).agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__mx_offset"))
    known = materialize(offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "o.block", "__mx_offset", "source_size", "turn", "target"))
    d = d.withColumn("__mx_block", F.substring("__mx_key", 1, digits) if digits else F.lit(""))
    within = Window.partitionBy("__mx_src", "__mx_block").orderBy("__mx_key", "__mx_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__mx_local", F.coalesce(F.sum("__mx_size").over(within), F.lit(0)))
    d = d.join(known, F.col("__mx_src").eqNullSafe(known["source"]) & (F.col("__mx_block") == known["block"])).select(
        *[d[f"`{c}`"] for c in docs.columns],
        d["__mx_size"],
        d["__mx_key"],
        known["source_size"].alias("__mx_total"),
        known["turn"].alias("__mx_turn"),
        known["target"].alias("__mx_target"),
        (d["__mx_local"] + known["__mx_offset"]).alias("__mx_before"),
    )
    full = F.when(F.col("__mx_total") > 0, F.floor(F.col("__mx_target") / F.col("__mx_total"))).otherwise(F.lit(0)).cast("bigint")
    left = F.col("__mx_target") - full * F.col("__mx_total")
    extra = (F.col("__mx_before") + F.col("__mx_size") / F.lit(2.0) < left).cast("bigint")
    return d.withColumn("__mx_passes", F.least(full + extra, F.lit(cfg.max_epochs).cast("bigint")))


def position_of(cfg: MixConfig, pass_: Column) -> Column:
    """Training position of a row's copy in pass 0, 1, ...: its start in the source's stream over all the stream."""
    at = F.col("__mx_before") + pass_ * F.col("__mx_total")
    share = F.least(F.when(F.col("__mx_target") > 0, at / F.col("__mx_target")).otherwise(F.lit(0.0)), F.lit(1.0))
    out = None
    for turn, schedule in reversed(list(enumerate(cfg.schedules))):
        x = position(share, schedule)
        out = x if out is None else F.when(F.col("__mx_turn") == turn, x).otherwise(out)
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cfg: MixConfig = MixConfig(), keep: bool = False) -> DataFrame:
    """The training order: each row of ``docs`` as often as it is taken, range-sorted by position, with the same columns.

    ``keep`` adds ``position`` (0..1) and ``pass`` (from 0), in place of columns of these names.  Edge
    cases are those of ``plan``: rows without words are taken as often as their source's passes cover
    them, repeated rows each on their own account; an empty table gives no rows.
    """
    p = plan(docs, doc_id, text, source, cfg).where("__mx_passes > 0")
    p = p.withColumn("__mx_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__mx_passes") - 1)))
    p = p.withColumn("__mx_position", position_of(cfg, F.col("__mx_pass")))
    new = [F.col("__mx_position").alias("position"), F.col("__mx_pass").cast("int").alias("pass")] if keep else []
    own = [F.col(f"`{c}`") for c in docs.columns if not keep or c not in ("position", "pass")]
    # the partition count follows the session; positions are spread over 0..1, so ranges are even
    return p.repartitionByRange("__mx_position", "__mx_key").sortWithinPartitions("__mx_position", "__mx_key").select(*own, *new)


def mixed_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cfg: MixConfig = MixConfig()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, passes, position, position_2, ...)``, one line per row of ``docs``.

    ``position_n``: where the row's copy in pass n is due, null if it is not taken so often.  Edge
    cases are those of ``plan``.
    """
    place = lambda i: F.when(F.col("__mx_passes") > i, F.round(position_of(cfg, F.lit(i)), 6)).alias(f"position_{i + 1}" if i else "position")
    return plan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")), "doc_id", "text", "source", cfg).select(
        "doc_id",
        F.col("__mx_size").alias("size"),
        F.col("__mx_total").alias("source_size"),
        F.col("__mx_target").alias("target"),
        (F.col("__mx_size") * F.col("__mx_passes")).alias("taken"),
        F.col("__mx_passes").alias("passes"),
        *[place(i) for i in range(cfg.max_epochs)],
    )


def position_sql(share: str, schedule: Schedule) -> str:
    """``position`` for DuckDB."""
    t, w = [float(x) for x, _ in schedule], [float(x) for _, x in schedule]
    area = [0.0]
    for i in range(len(t) - 1):
        area.append(area[-1] + (t[i + 1] - t[i]) * (w[i] + w[i + 1]) / 2)
    need = f"({share}) * {area[-1]!r}::DOUBLE"
    out = ""
    for i in reversed(range(len(t) - 1)):
        slope = (w[i + 1] - w[i]) / (t[i + 1] - t[i])
        rest = f"({need} - {area[i]!r}::DOUBLE)"
        x = f"{t[i]!r}::DOUBLE + {rest} / {w[i]!r}::DOUBLE" if slope == 0 else f"{t[i]!r}::DOUBLE + (sqrt(greatest({w[i] * w[i]!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0)) - {w[i]!r}::DOUBLE) / {slope!r}::DOUBLE"
        out = x if not out else f"CASE WHEN {need} < {area[i + 1]!r}::DOUBLE THEN {x} ELSE {out} END"
    return f"least(greatest({out}, 0), 1)"


def oracle(cfg: MixConfig = MixConfig()) -> str:
    """DuckDB SQL for ``mixed_sizes`` over ``documents``."""
    weights = ", ".join(f"{w!r}::DOUBLE" for w in cfg.weights)
    share = lambda p: f"least(CASE WHEN target > 0 THEN (before + {p} * source_size) / target ELSE 0 END, 1)"
    turns = lambda p: " ".join(f"WHEN {i} THEN {position_sql(share(p), s)}" for i, s in enumerate(cfg.schedules))
    places = ", ".join(f"CASE WHEN passes > {p} THEN round(CASE turn {turns(p)} END, 6) END AS position{f'_{p + 1}' if p else ''}" for p in range(cfg.max_epochs))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || chr(31) || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(cfg.weights)} AS turn FROM s),
c AS (SELECT *, [{weights}][turn + 1] AS w, (source_size * {cfg.max_epochs})::DOUBLE AS cap FROM r),
l AS (SELECT *, cap / w AS ratio, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
m AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio > level),
t AS (SELECT l.source, source_size, turn, CASE WHEN m.level IS NULL OR ratio <= m.level THEN cap ELSE m.level * w END AS target FROM l LEFT JOIN m ON true),
b AS (SELECT d.*, t.source_size, t.turn, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM b),
p AS (SELECT *, least(whole + CASE WHEN before + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END, {cfg.max_epochs}) AS passes FROM f)
SELECT doc_id, size, source_size, target, size * passes AS taken, passes, {places} FROM p
"""

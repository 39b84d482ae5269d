"""Chat formatting by perspective rotation.

Every dialogue is rendered once for each of its participants: that one speaks as the assistant, the
others as named users, and the mask covers what the assistant says.  System turns stay system turns.
A dialogue too long for one row goes on in further parts, each under the system turn then in force.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"
#: Marks in names and what stands for them; the first comes first.
CODES = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D"))


@dataclass(frozen=True)
class ChatConfig:
    """``part_turns``: turns of a part of a dialogue; a row has to fit in memory, so one of any length is
    rendered in consecutive parts.  ``block_turns``: turns are numbered in blocks of so many turn values.
    """

    part_turns: int = 1024
    block_turns: int = 1024
    system: str = "system"
    unnamed: str = "unknown"


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, cfg: ChatConfig) -> DataFrame:
    """``(conv, seq, role, text)`` with the turns of each dialogue numbered from 0.

    Numbers come from counts by block of turn values, so a dialogue that holds a third of all rows is
    ordered by many tasks.
    """
    c = conversations.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(cfg.unnamed)).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / cfg.block_turns), F.lit((1 << 62))))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = c.groupBy("conv", "block").agg(F.count("*").alias("n")).select(F.col("conv").alias("oc"), F.col("block").alias("ob"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    c = c.withColumn("rank", F.row_number().over(within))
    return c.join(offset, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("block") == F.col("ob"))).select("conv", (F.col("offset") + F.col("rank") - 1).alias("seq"), "role", "text")


def rotate(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", cfg: ChatConfig = ChatConfig()) -> DataFrame:
    """``(conv_id, perspective, part, n_turns, n_assistant, text, mask, n_masked, carried)``, one line per participant and part.

    Turns go by turn number (null last), then role, then text; repeated rows are turns like others.  A
    null role speaks as "unknown", a null text is empty, rows without a conversation id are one
    dialogue, an empty table gives no lines.  A dialogue of system turns alone has no participant and
    gives no line.  A part after the first begins with the last system turn before it (``carried``: 1),
    which ``n_turns`` does not count; a participant who is silent in a part has a line with an empty
    mask, so each one's parts make up the whole dialogue.  ``<|`` in texts becomes ``<||``, and ``%``,
    ``|``, ``<``, ``>`` and line ends in names become their percent codes, so control marks cannot be
    forged and names stay apart.  ``mask``: comma-separated spans ``start-end`` of code points to learn:
    each assistant turn with its end mark.
    """
    safe = lambda x: F.replace(x, F.lit("<|"), F.lit("<||"))
    t = _turns(conversations, conv_id, turn, role, text, cfg).select("conv", (F.floor(F.col("seq") / cfg.part_turns)).alias("part"), "seq", "role", safe(F.col("text")).alias("text"))
    who = t.where(F.col("role") != cfg.system).select(F.col("conv").alias("wc"), F.col("role").alias("perspective")).distinct()
    # at most part_turns turns meet in one row
    told = F.when(F.col("role") == cfg.system, F.struct("seq", "role", "text"))
    parts = t.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"), F.max(told).alias("told"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("n", F.size("turns")).withColumn("told", F.last("told", True).over(before))
    parts = parts.withColumn("turns", F.when(F.col("told").isNotNull(), F.concat(F.array("told"), F.col("turns"))).otherwise(F.col("turns")))
    r = parts.join(who, F.col("conv").eqNullSafe(F.col("wc"))).select("conv", "perspective", "part", "turns", "n", F.col("told").isNotNull().cast("int").alias("carried"))
    mine = lambda m: m["role"] == F.col("perspective")

    def coded(name: Column) -> Column:
        for mark, code in CODES:
            name = F.replace(name, F.lit(mark), F.lit(code))
        return name

    head = lambda m: F.when(mine(m), F.lit("<|assistant|>\n")).when(m["role"] == cfg.system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), coded(m["role"]), F.lit("|>\n")))
    r = r.withColumn("turns", F.transform("turns", lambda m: F.struct(head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), mine(m).alias("mine"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("n"))
    size = lambda m: F.length(m["head"]) + F.length(m["body"])

    def step(acc, m):
        a = acc["at"] + F.length(m["head"])
        span = F.concat(a.cast("string"), F.lit("-"), (acc["at"] + size(m)).cast("string"))
        return F.struct(
            (acc["at"] + size(m) + 1).alias("at"),
            F.when(m["mine"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
            (acc["n"] + F.when(m["mine"], F.length(m["body"])).otherwise(0)).alias("n"),
        )

    r = r.withColumn("m", F.aggregate("turns", start, step))
    return r.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        F.col("part").cast("int").alias("part"),
        F.col("n").alias("n_turns"),
        F.size("m.spans").alias("n_assistant"),
        F.concat(F.array_join(F.transform("turns", lambda m: F.concat(m["head"], m["body"])), "\n"), F.lit("\n")).alias("text"),
        F.array_join("m.spans", ",").alias("mask"),
        F.col("m.n").alias("n_masked"),
        "carried",
    )


def oracle(cfg: ChatConfig = ChatConfig()) -> str:
    """DuckDB SQL for ``rotate`` over ``conversations``."""
    name = "role"
    for mark, code in CODES:
        name = f"replace({name}, {f'chr({ord(mark)})'}, '{code}')"
    return f"""
WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, '{cfg.unnamed}'), coalesce(text, '')) - 1 AS seq, coalesce(role, '{cfg.unnamed}') AS role, replace(coalesce(text, ''), '<|', '<||') || '{END}' AS body FROM conversations),
t AS (SELECT *, seq // {cfg.part_turns} AS part, 1 AS own FROM n),
c AS (SELECT conv_id, max(seq) AS seq, arg_max(role, seq) AS role, arg_max(body, seq) AS body, part, 0 AS own FROM (SELECT n.*, p.part FROM n JOIN (SELECT DISTINCT conv_id, part FROM t WHERE part > 0) p ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.role = '{cfg.system}' AND n.seq < p.part * {cfg.part_turns}) GROUP BY conv_id, part),
a AS (SELECT conv_id, seq, role, body, part, own FROM t UNION ALL SELECT conv_id, seq, role, body, part, own FROM c),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{cfg.system}'),
h AS (SELECT a.conv_id, perspective, part, seq, own, role = perspective AS mine, CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = '{cfg.system}' THEN '<|system|>' ELSE '<|user name=' || {name} || '|>' END || chr(10) AS head, body FROM a JOIN w ON a.conv_id IS NOT DISTINCT FROM w.conv_id),
p AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM h)
SELECT conv_id, perspective, part::INT AS part, sum(own)::INT AS n_turns, (count(*) FILTER (WHERE mine))::INT AS n_assistant, string_agg(head || body || chr(10), '' ORDER BY seq) AS text, coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + length(head) + length(body))::VARCHAR, ',' ORDER BY seq) FILTER (WHERE mine), '') AS mask, coalesce(sum(length(body)) FILTER (WHERE mine), 0)::INT AS n_masked, max(1 - own)::INT AS carried
FROM p GROUP BY conv_id, perspective, part
"""

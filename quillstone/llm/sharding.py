"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of each row.  A bucket over the byte limit, and
no other, splits on its next bit, until every shard fits.  Sizes of buckets come from one grouped
sum per directory of a few dozen cells per shard; directories of deeper bits are made only of rows
whose cells are still too large.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.plans.materialize import materialize

BITS = 60
STEP = 5
#: A directory of so many buckets (some 40 MB) goes to every executor; beyond that rows meet it by a shuffle.
BROADCAST_LEAVES = 500_000


def _digest(doc_id: str, text: str):
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def shard(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (the bits of its bucket), ``shard_depth``, ``doc_bytes`` and ``shard_bytes``.

    Sizes are UTF-8 bytes of the texts, null texts count 0.  Rows are hashed by id and text, so null
    or repeated ids spread; only rows equal in both share all bits.  A bucket of such rows alone
    splits no further by bits: it is numbered on into parts of as many rows as fit
    (``bits-1``, ``bits-2``, ...).  A single row over the limit is alone in its shard.  An empty table
    gives no rows.  Columns of ``docs`` that have the names of the new ones are replaced.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    own = [c for c in docs.columns if c not in ("shard", "shard_depth", "doc_bytes", "shard_bytes")]
    d = docs.select(
        *[F.col(f"`{c}`") for c in own],
        F.conv(F.substring(_digest(doc_id, text), 1, 15), 16, 10).cast("bigint").alias("__sh_h"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("doc_bytes"),
    )
    narrow = materialize(d.select("__sh_h", "doc_bytes"))
    total = narrow.agg(F.sum("doc_bytes")).first()[0] or 0
    start = max(0, math.ceil(math.log2(max(1, total / limit))))
    depth, done, rows = min(BITS, start + STEP), None, narrow
    floor = 0
    while True:
        cell = F.shiftright("__sh_h", BITS - depth)
        cells = rows.groupBy(cell.alias("cell")).agg(F.sum("doc_bytes").alias("bytes"), F.min("__sh_h").alias("lo"), F.max("__sh_h").alias("hi"))
        cells = materialize(cells)
        levels = cells.select("*", F.explode(F.sequence(F.lit(floor), F.lit(depth))).alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
        sums = levels.groupBy("d", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # a bucket closes where it fits, or where all its rows have one hash
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("d", "prefix", "shard_bytes")
        leaf = levels.join(fits, ["d", "prefix"]).groupBy("cell").agg(F.min(F.struct("d", "prefix", "shard_bytes")).alias("s")).select("cell", "s.*")
        leaf = materialize(leaf.select(F.lit(depth).alias("at"), "cell", F.col("d").alias("shard_depth"), "prefix", "shard_bytes"))
        done = leaf if done is None else done.unionByName(leaf)
        if depth >= BITS or leaf.count() == cells.count():
            break
        rows = materialize(rows.join(leaf, F.shiftright("__sh_h", BITS - depth) == leaf["cell"], "left_anti"))
        floor, depth = depth + 1, min(BITS, depth + STEP)
    # the directory: for each prefix of ``base`` bits the buckets under or over it, about one line per shard
    leaves = materialize(done.select("shard_depth", "prefix", "shard_bytes").distinct())
    base = min(start, BITS)
    over_ = F.explode(F.expr(f"sequence(shiftleft(prefix, greatest({base} - shard_depth, 0)), shiftleft(prefix + 1, greatest({base} - shard_depth, 0)) - 1)"))
    under = F.expr(f"shiftright(prefix, greatest(shard_depth - {base}, 0))")
    slots = leaves.withColumn("slot", over_).withColumn("slot", F.when(F.col("shard_depth") > base, under).otherwise(F.col("slot"))).distinct()
    # at most BITS buckets hang under a prefix once hashes are spread, for each set of rows that share more bits
    directory = materialize(slots.groupBy(F.col("slot").alias("__sh_slot")).agg(F.collect_list(F.struct("shard_depth", "prefix", "shard_bytes")).alias("__sh_leaves")))
    if leaves.count() <= BROADCAST_LEAVES:
        directory = F.broadcast(directory)
    out = d.withColumn("__sh_slot", F.shiftright("__sh_h", BITS - base)).join(directory, "__sh_slot")
    mine = F.filter("__sh_leaves", lambda x: F.call_function("shiftright", F.col("__sh_h"), F.lit(BITS) - x["shard_depth"]) == x["prefix"])
    out = out.withColumn("__sh_leaf", F.get(mine, F.lit(0))).select(*[F.col(f"`{c}`") for c in own], "__sh_h", "doc_bytes", F.col("__sh_leaf.shard_depth").alias("shard_depth"), F.col("__sh_leaf.prefix").alias("__sh_prefix"), F.col("__sh_leaf.shard_bytes").alias("shard_bytes"))
    bits = F.when(F.col("shard_depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(cast(__sh_prefix as string), 10, 2), shard_depth, '0')"))
    over = leaves.where(F.col("shard_bytes") > limit)
    names = [*[F.col(f"`{c}`") for c in own]]
    tail = [F.col("shard"), F.col("shard_depth").cast("int").alias("shard_depth"), "doc_bytes", "shard_bytes"]
    out = out.withColumn("shard", bits)
    if over.isEmpty():
        return out.select(*names, *tail)
    # copies that no bit tells apart: numbered task by task, so that no task sees all of them
    fit = out.where(F.col("shard_bytes") <= limit).select(*names, *tail)
    same = materialize(out.where(F.col("shard_bytes") > limit).select(*names, "__sh_h", "doc_bytes", "shard", "shard_depth", "shard_bytes", F.spark_partition_id().alias("__sh_p"), F.monotonically_increasing_id().alias("__sh_i")))
    before = Window.partitionBy("__sh_h").orderBy("__sh_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = same.groupBy("__sh_h", "__sh_p").agg(F.count("*").alias("n"), F.max("doc_bytes").alias("most")).withColumn("__sh_o", F.coalesce(F.sum("n").over(before), F.lit(0)))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("most", F.lit(1)))).cast("bigint")
    rank = Window.partitionBy("__sh_h", "__sh_p").orderBy("__sh_i")
    same = same.withColumn("__sh_n", F.row_number().over(rank)).join(offset.select("__sh_h", "__sh_p", "__sh_o", each.alias("__sh_e")), ["__sh_h", "__sh_p"])
    part = F.floor((F.col("__sh_n") + F.col("__sh_o") - 1) / F.col("__sh_e")) + 1
    count = F.floor(F.col("shard_bytes") / F.greatest(F.col("doc_bytes"), F.lit(1)))
    last = count - (part - 1) * F.col("__sh_e")
    same = same.withColumn("shard", F.when(count > F.col("__sh_e"), F.concat("shard", F.lit("-"), part.cast("bigint").cast("string"))).otherwise(F.col("shard")))
    same = same.withColumn("shard_bytes", F.least(F.col("__sh_e"), last) * F.col("doc_bytes"))
    return fit.unionByName(same.select(*names, *tail))


def write_shards(docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text", order: tuple[str, ...] = ()) -> None:
    """One folder of Parquet per shard; rows of a shard meet in one task, which the limit bounds.

    ``order``: columns by which the rows of each shard are sorted.  Edge cases are those of ``shard``;
    an empty table writes no shard.
    """
    out = shard(docs, limit, doc_id, text).repartition("shard")
    out = out.sortWithinPartitions("shard", *order) if order else out
    out.write.partitionBy("shard").parquet(path)


def oracle(limit: int, table: str = "documents") -> str:
    """DuckDB SQL for ``shard``'s decisions, for tables without equal rows over the limit."""
    return f"""
WITH d AS (SELECT doc_id, ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), chr(31), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h, coalesce(octet_length(encode(text)), 0)::BIGINT AS doc_bytes FROM {table}),
l AS (SELECT *, h >> ({BITS} - k)::INT AS prefix FROM d, (SELECT unnest(range({BITS + 1}))::INT AS k)),
s AS (SELECT *, sum(doc_bytes) OVER (PARTITION BY k, prefix)::BIGINT AS shard_bytes, min(h) OVER (PARTITION BY k, prefix) = max(h) OVER (PARTITION BY k, prefix) AS one FROM l),
f AS (SELECT * FROM s WHERE shard_bytes <= {limit} OR one QUALIFY row_number() OVER (PARTITION BY h, doc_id ORDER BY k) = 1)
SELECT doc_id, CASE WHEN k = 0 THEN '' ELSE lpad(bin(prefix), k, '0') END AS shard, k AS shard_depth, doc_bytes, shard_bytes FROM f
"""

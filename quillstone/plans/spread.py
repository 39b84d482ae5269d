"""Work on text for as many tasks as there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are sent to every task instead of shuffling what they are joined to.
FEW = 200_000


def _tasks(df: DataFrame) -> tuple[int, int]:
    """The splits of ``df``, and the cores there are."""
    return df._jdf.queryExecution().toRdd().getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` if its splits would leave cores idle, as one file of one row group does.

    A table of more than two splits a core stays as it is, so a large one is never shuffled for this.
    """
    splits, cores = _tasks(df)
    if splits > 2 * cores:
        return df
    return df.repartition(4 * cores, key)


def ordered(df: DataFrame, key: str) -> DataFrame:
    """``df`` in the order of ``key`` through all its partitions, of which there are as many as splits, or four a core."""
    splits, cores = _tasks(df)
    return df.repartitionByRange(max(splits, 4 * cores), F.col(key)).sortWithinPartitions(key)


def few(df: DataFrame) -> DataFrame:
    """A written table ``df``, to be broadcast if it is small: then what it is joined to stays where it is."""
    return F.broadcast(df) if df.count() <= FEW else df

"""Saved indexes: Parquet tables and a manifest, which is written last and marks the index complete."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.index import Index, IndexConfig

FORMAT, VERSION = "quillstone-index", 3
TABLES = ("documents", "chunks", "frequencies", "stats")


class IndexFormatError(ValueError):
    """What lies there is no index of this format and version."""


class StaleIndexError(ValueError):
    """Documents or chunk sizes are others than those the tables were made from."""


def fingerprint(documents: DataFrame, target: int, overlap: int) -> str:
    return fingerprint_row(documents, target, overlap).first()[0]


def fingerprint_row(documents: DataFrame, target: int, overlap: int) -> DataFrame:
    """One row ``(fingerprint)``: SHA-256 of all (doc_id, text) pairs, whatever their order, and of the chunk sizes.

    Row digests are summed by parts modulo 2**64, so nothing is collected.
    """
    row = F.sha2(F.concat(F.lit("d"), F.length("doc_id").cast("string"), F.lit(":"), F.col("doc_id"), F.col("text")), 256)
    part = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    d = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    r = d.agg(F.count("*").cast("string").alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(part)])
    names = ["n", *(f"p{i}" for i in range(8))]
    return r.select(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in names], F.lit(str(target)), F.lit(str(overlap))), 256).alias("fingerprint"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(path: str, documents: DataFrame, index: Index, config: dict) -> None:
    """Write beside ``path`` under a name of its own, then rename; an old index there is replaced.

    What is no index is never replaced.  The old index is moved aside before the new one takes its
    place, and is moved back if that fails.
    """
    spark = documents.sparkSession
    fs, final = _fs(spark, path)
    if fs.exists(final) and not (fs.getFileStatus(final).isDirectory() and not list(fs.listStatus(final))):
        _manifest(spark, path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    tables = {"documents": documents, "chunks": index.chunks, "frequencies": index.frequencies, "stats": index.stats}
    for name in TABLES:
        tables[name].write.parquet(f"{staging}/{name}", compression="zstd")
    n = index.chunks.count()
    manifest = {"config": config, "format": FORMAT, "fingerprint": fingerprint(documents, config["target_tokens"], config["overlap_tokens"]), "version": VERSION, "index": asdict(index.config), "chunks": n, "schemas": {t: tables[t].schema.jsonValue() for t in TABLES}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/manifest")
    _, there = _fs(spark, staging)
    _, aside = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    old = fs.exists(final)
    if old and not fs.rename(final, aside):
        raise OSError(f"cannot move the old index at {path} aside")
    if not fs.rename(there, final):
        if old:
            fs.rename(aside, final)
        raise OSError(f"cannot move the index to {path}")
    if old:
        fs.delete(aside, True)


def _manifest(spark: SparkSession, path: str) -> dict:
    fs, p = _fs(spark, f"{path.rstrip('/')}/manifest")
    if not fs.exists(p):
        raise IndexFormatError(f"{path} holds no index")
    try:
        m = json.loads("\n".join(r[0] for r in spark.read.text(str(p)).collect()))
    except ValueError as e:
        raise IndexFormatError(f"{path}: the manifest is not JSON") from e
    if not isinstance(m, dict) or m.get("format") != FORMAT:
        raise IndexFormatError(f"{path} holds no index of this format")
    return m


def load(spark: SparkSession, path: str, expected: str | None = None) -> tuple[DataFrame, Index, dict]:
    """``(documents, index, config)``; nothing is fitted again.  ``expected``: fingerprint to hold it against."""
    m = _manifest(spark, path)
    if m.get("version") != VERSION:
        raise IndexFormatError(f"{path}: version {m.get('version')} is not supported")
    if expected is not None and expected != m["fingerprint"]:
        raise StaleIndexError(f"{path} was built from other documents; build it again")
    from pyspark.sql.types import StructType

    t = {name: spark.read.schema(StructType.fromJson(m["schemas"][name])).parquet(f"{path}/{name}") for name in TABLES}
    if t["chunks"].count() != m["chunks"]:
        raise ValueError("the saved index does not cover its chunks")
    return t["documents"], Index(t["chunks"], t["frequencies"], t["stats"], IndexConfig(**m["index"])), m["config"]

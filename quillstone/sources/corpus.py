"""Corpus and gold-question sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".md", ".txt")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)`` of the ``.md`` and ``.txt`` files directly in ``path``.

    ``doc_id`` is the file name without its last extension; of two files of one id the later name
    wins.  All line ends become ``\\n``.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not fs.getFileStatus(folder).isDirectory():
        raise FileNotFoundError(f"corpus directory not found: {path}")
    # an extension filter in the listing, so that nothing else is opened
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.{md,txt,MD,TXT,Md,mD,Txt,tXt,txT,TXt,TxT,tXT}").load(path)
    named = raw.select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    named = named.select(F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("name"), "text").where(F.lower("name").rlike(r"\.(md|txt)$"))
    # Spark's listing passes over files without bytes; they are documents with an empty text
    blank = [(f.getPath().getName(), "") for f in fs.listStatus(folder) if f.isFile() and f.getLen() == 0 and f.getPath().getName().lower().endswith(EXTENSIONS)]
    if blank:
        named = named.unionByName(spark.createDataFrame(blank, "name string, text string"))
    docs = named.groupBy(F.regexp_replace("name", r"\.[^.]*$", "").alias("doc_id")).agg(F.max_by("text", "name").alias("text"))
    if docs.isEmpty():
        raise ValueError(f"no .md or .txt documents found in {path}")
    return docs


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, question, relevant, difficulty)`` from JSON lines; difficulty defaults to "easy".

    Blank lines are passed over; a line that is no JSON object with id, question and relevant documents is an error.
    """
    lines = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    g = lines.select("value", F.from_json("value", "id string, question string, relevant array<string>, difficulty string").alias("g"))
    whole = F.col("g").isNotNull() & F.col("g.id").isNotNull() & F.col("g.question").isNotNull() & F.col("g.relevant").isNotNull()
    bad = g.where(~whole).select("value").first()
    if bad is not None:
        raise ValueError(f"no gold question: {bad[0][:200]}")
    g = g.select(F.col("g.id").alias("query_id"), "g.question", "g.relevant", F.coalesce("g.difficulty", F.lit("easy")).alias("difficulty"))
    if g.isEmpty():
        raise ValueError(f"no questions found in {path}")
    return g


def gold_items(gold: DataFrame) -> DataFrame:
    """``(query_id, item)``, each relevant document once."""
    return gold.select("query_id", F.explode(F.array_distinct("relevant")).alias("item"))

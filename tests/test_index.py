"""The index at size: what it writes and moves, and its numbers against brute force."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone import Engine, EngineConfig, build_index, queries
from quillstone.functions import text as tx
from quillstone.functions import words
from quillstone.operators import index as ix
from quillstone.operators import search as rs
from quillstone.operators.chunking import _cut, chunk, span_list
from quillstone.plans import materialize as mt


def size(path):
    p = Path(path)
    return p.stat().st_size if p.is_file() else sum(x.stat().st_size for x in p.rglob("*") if x.is_file())


ODD = ["", " ", "-", "a", "a-b", "a--b c-", "-a'b'c-d-", "Don’t stop—well-known, É x's' 3-4", "İstanbul KK straße ΣΑΣ", "ends in a", "begins", "'tis rock'n'roll", "x\ny\tz　w", None, "é-a éa“b”", "1-2-3'4", "a-é-b"]


def test_tokens_cut_on_bytes_are_those_of_the_expression(spark, monkeypatch):
    g = random.Random(3)
    texts = ODD + ["".join(g.choices("abZ09-'’ —é\n", k=g.randrange(30))) for _ in range(400)]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", tx.tokens(F.col("x")).alias("t"), words.ready(F.col("x")).alias("r")).orderBy("i").collect()
    for a, z in ((0, len(t)), (3, 9), (5, 5)):
        terms, row = words.split(pa.array([r.r for r in t]).slice(a, z - a))
        assert list(zip(row.tolist(), terms.to_pylist())) == [(i, w) for i, r in enumerate(t[a:z]) for w in r.t]
    b = pa.RecordBatch.from_arrays([pa.array([r.r for r in t])], names=["r"])
    monkeypatch.setattr(words, "PIECE", 40)
    assert len(list(words.pieces(b, 0))) > 20 and [x for p in words.pieces(b, 0) for x in p.column(0).to_pylist()] == b.column(0).to_pylist()


def test_sentences_are_those_of_the_full_steps(spark):
    """Paragraphs are not stripped before they are split, and single spaces not replaced by themselves."""
    g = random.Random(6)
    texts = ["".join(g.choices(["A", "b", "9", ".", "! ", " ", "  ", "\t", "\n", "\n\n", "\u3000", "\x85", "\r\n", "# H\n", '"', "—", "\x1c", " \x1f"], k=g.randrange(25))) for _ in range(1500)]
    squeeze = lambda s: tx.strip(F.regexp_replace(s, f"[{tx.WS}]+", " "))
    alone = F.regexp_replace(tx.normalize(F.col("x")), f"(?md)^{tx.HEADING}$", "\n\n$0\n\n")
    parts = F.transform(F.split(alone, tx.PARAGRAPH), lambda p: F.split(tx.strip(p), tx.BOUNDARY))
    full = F.filter(F.transform(F.flatten(parts), squeeze), lambda s: s != "")
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", tx.sentences(F.col("x")).alias("got"), full.alias("want")).collect()
    assert [(r.x, r.got) for r in rows] == [(r.x, r.want) for r in rows] and sum(len(r.got) for r in rows) > 1500


def test_building_writes_little_more_than_the_texts(spark, sf):
    path = f"{sf}/documents.parquet"
    mt.clear(spark)
    Engine(spark.read.parquet(path).select(F.col("doc_id").cast("string").alias("doc_id"), "text")).index.weigher
    assert sum(size(p) for p in mt._written[spark.sparkContext.applicationId]) < 2.5 * size(path)


def test_postings_and_scores_move_no_rows(spark):
    index = build_index(spark.createDataFrame([(i, f"a b{i % 7} c") for i in range(50)], "chunk_index int, text string").repartition(40))
    w = rs.as_weights(rs.query_terms(spark.createDataFrame([("q", "a b1")], "query_id string, question string")))
    for df in (index.postings, rs.bm25_scores(index, w)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") <= plan.count("REPARTITION_BY_NUM")


def test_chunks_are_numbered_through_all_partitions(spark):
    g = random.Random(4)
    docs = {f"d{i}": " ".join(f"{g.choice(['Ä', 'The', 'X-1'])} w{g.randrange(9)} ends." for _ in range(g.choice([0, 1, 3, 40]))) for i in range(60)} | {"D": "!", "dé": "Üb it. So"}
    got = chunk(spark.createDataFrame([*docs.items(), (None, "Lost.")], "doc_id string, text string").repartition(7), 12, 4).orderBy("chunk_index").collect()
    sents = {r.doc_id: (r.s, r.n) for r in spark.createDataFrame(list(docs.items()), "doc_id string, text string").select("doc_id", tx.sentences(F.col("text")).alias("s")).select("doc_id", "s", F.transform("s", lambda x: F.size(tx.tokens(x))).alias("n")).collect()}
    want = [(d, k, "\n".join(s[a : b + 1]), n, a, b) for d in sorted(sents, key=lambda d: d.encode()) for s, c in [sents[d]] for k, (a, b, n) in enumerate(span_list(c, 12, 4))]
    assert [(r.doc_id, r.chunk_ord, r.text, r.token_count, r.sentence_start, r.sentence_end) for r in got] == want
    assert [r.chunk_index for r in got] == list(range(len(want)))


def test_pieces_do_not_matter(monkeypatch):
    lines = ["a b.\nC d", "", "E-f g.", "h\nI\nj k l m n"] * 5
    b = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(20)]), pa.array(lines), pa.array([x.lower() + "\n" for x in lines])], names=["doc_id", "lines", "low"])
    text = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int32()), pa.array([x.lower() + " " for x in lines])], names=["chunk_index", "text"])
    q = rs.Questions.of(pa.table({"query_id": ["x", "x", "y"], "term": ["a", "k", "e-f"], "weight": [1.0, 2.0, 1.0], "qw": [0.5, 0.5, 1.0]}))
    weigher = ix.Weigher(20, 2.0, ix.IndexConfig(), np.zeros(0, np.int64), np.zeros(0, np.int64), {})
    made = []
    for piece in (1 << 23, 12):
        monkeypatch.setattr(words, "PIECE", piece)
        each = (_cut([b], 3, 1), q.best([text], 3, weigher), q.totals([text], weigher), q.every([text], weigher))
        made.append([sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r.values()) for r in pa.Table.from_batches(list(x)).to_pylist()) for x in each])
    assert made[0] == made[1] and all(made[0])


def test_terms_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(ix, "_hashes", lambda terms: pa.array([len(t) for t in terms.to_pylist()], pa.int64()).to_numpy())
    texts = ["a b a", "b ccc", "a dd", "ee b", ""]
    index = build_index(spark.createDataFrame(list(enumerate(texts)), "chunk_index int, text string"))
    df = Counter(t for x in texts for t in set(x.split()))
    assert index.weigher.value.odd == {t: df[t] for t in ("a", "b", "dd", "ee")}
    assert index.weigher.value.df(pa.array(sorted(df))).tolist() == [df[t] for t in sorted(df)]


def test_totals_are_those_of_all_scores(spark):
    g = random.Random(5)
    index = build_index(spark.createDataFrame([(i, " ".join(g.choices("abcdefgh", k=g.randrange(6)))) for i in range(80)], "chunk_index int, text string").repartition(3))
    w = rs.as_weights(rs.query_terms(spark.createDataFrame([("x", "a b"), ("y", "h h c"), ("z", "zz")], "query_id string, question string")))
    scores = rs.bm25_scores(index, w).collect()
    got = {r.query_id: (r.chunks, r.total, r.best) for r in rs.bm25_totals(index, w).collect()}
    assert got == {q: (len(s), pytest.approx(math.fsum(s)), max(s)) for q in {r.query_id for r in scores} for s in [[r.score for r in scores if r.query_id == q]]} and set(got) == {"x", "y"}


def test_gold_is_made_on_demand_from_chunks(spark, sf):
    s = queries.Setup(Engine(queries.documents(spark, sf)), queries.questions(spark, sf))
    s.engine.search(s.queries, 2)
    assert "gold" not in vars(s)
    d = {r.doc_id: set(r.s) for r in queries.documents(spark, sf).select("doc_id", tx.sentences(F.col("text")).alias("s")).collect()}
    q = s.queries.select("query_id", F.filter(tx.sentences(F.col("question")), lambda x: F.size(tx.tokens(x)) > 3).alias("s")).collect()
    assert {tuple(r) for r in s.gold.collect()} == {(r.query_id, i) for r in q for i, own in d.items() if own & set(r.s)}


def test_saving_takes_little_more_than_the_texts(spark, sf, tmp_path):
    path = f"{sf}/documents.parquet"
    e = Engine(spark.read.parquet(path).select(F.col("doc_id").cast("string").alias("doc_id"), "text"), EngineConfig())
    e.save(str(tmp_path / "saved"))
    assert size(tmp_path / "saved") < 2.5 * size(path)
    back = Engine.load(spark, str(tmp_path / "saved"))
    order = ["chunk_index", "term"]
    assert back.index.postings.orderBy(*order).collect() == e.index.postings.orderBy(*order).collect()

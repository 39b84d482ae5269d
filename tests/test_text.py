import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators.chunking import chunk, spans
from quillstone.streaming.ingest import stream_chunks


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_tokens(spark):
    got = one(spark, tx.tokens, "Don’t stop—well-known, a--b 3-4 É x's'", "", None, "éa“b”")
    assert got == [["don't", "stop", "well-known", "a", "b", "3-4", "x's"], [], [], ["a", "b"]]
    assert one(spark, lambda c: tx.without_stop_words(tx.tokens(c)), "What is the index of a term") == [["index", "term"]]
    assert one(spark, tx.content_tokens, "what is the", "what is bm25") == [["what", "is", "the"], ["bm25"]]
    assert one(spark, tx.normalize, "“a” ‘b’—c  d") == ['"a" \'b\' - c  d']
    assert one(spark, tx.canonical, "A b!", "??") == [" a b ", " "]


def test_headings(spark):
    assert one(spark, tx.is_heading, "# One", "  ## Two  ", "#tag", "    # four", "####### seven", "x # y", "#\tTab") == [True, True, False, True, False, False, True]


def test_sentences(spark):
    got = one(
        spark,
        tx.sentences,
        "One two. Three! (Four) five? six. “Seven” e.g. eight.",
        "# Title\nText here. More\n\n  \n- item\n- other\nlast",
        "A. B.\x1cC.　d. E",
        "x\r\n\r\ny",
        "",
        "   ",
    )
    assert got[0] == ["One two.", "Three!", "(Four) five? six.", '"Seven" e.g. eight.']
    assert got[1] == ["# Title", "Text here.", "More", "- item - other last"]
    assert got[2] == ["A.", "B.", "C. d.", "E"]
    assert got[3] == ["x", "y"] and got[4] == got[5] == []


def _reference_spans(counts, target, overlap):
    """The packing rule, sentence by sentence."""
    out, start, held = [], 0, 0
    for j, n in enumerate(counts):
        if j > start and held + n > target:
            out.append((start, j - 1))
            new, carried = j, 0
            if overlap:
                while new - 1 > start and carried + counts[new - 1] <= overlap:
                    new -= 1
                    carried += counts[new]
                new = min(new, j - 1)
            start, held = new, sum(counts[new:j])
        held += n
    return [*out, (start, len(counts) - 1)] if counts else []


def test_spans(spark):
    import random

    g = random.Random(2)
    cases = [([2, 60, 3], 20, 5), ([], 20, 5), ([0, 0, 0], 1, 0), ([50], 20, 5)]
    cases += [([g.choice((0, 1, 3, 8, 20, 45)) for _ in range(g.randrange(1, 25))], t, o) for t, o in ((20, 5), (20, 0), (40, 39), (7, 3)) for _ in range(25)]
    for t, o in {(t, o) for _, t, o in cases}:
        own = [c for c, *k in cases if k == [t, o]]
        rows = spark.createDataFrame([(i, c) for i, c in enumerate(own)], "i int, c array<int>")
        got = [[(s.a, s.b) for s in r[0]] for r in rows.orderBy("i").select(spans(F.col("c"), t, o)).collect()]
        assert got == [_reference_spans(c, t, o) for c in own]
    assert _reference_spans([2, 60, 3], 20, 5) == [(0, 0), (0, 1), (1, 2)]


def test_chunks_are_numbered_in_order(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", " ".join(f"Word {i} {j} and more of it." for j in range(i % 40))) for i in range(60)], "doc_id string, text string")
    rows = chunk(docs.repartition(7), 20, 8).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert [(r.doc_id, r.chunk_ord) for r in rows] == sorted((r.doc_id, r.chunk_ord) for r in rows)
    assert all(r.chunk_id == f"{r.doc_id}::{r.chunk_ord}" and r.metadata == {} for r in rows)
    assert max(r.chunk_ord for r in rows) > 10
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for own in by.values():
        assert own[0].sentence_start == 0 and all(b.sentence_start <= a.sentence_end + 1 for a, b in zip(own, own[1:]))
    assert all(r.token_count == len(re.findall(r"[a-z0-9]+", r.text.lower())) for r in rows)


@pytest.mark.parametrize("sizes", [(10, -1), (0, 0), (10, 10)])
def test_sizes_are_checked(spark, sizes):
    with pytest.raises(ValueError):
        chunk(spark.createDataFrame([("a", "b")], "doc_id string, text string"), *sizes)


def test_streamed_chunks_are_the_batch_ones(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "Some words of a text. " * i) for i in range(12)], "doc_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = stream_chunks(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("chunked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.chunk_id, r.text) for r in spark.table("chunked").collect()}
    assert got == {(r.chunk_id, r.text) for r in chunk(docs).collect()}

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone import Engine, EngineConfig, ExpansionConfig, IndexConfig, IndexFormatError, ModelAnswerer, StaleIndexError, build_index, read_corpus, read_gold
from quillstone.cli import main
from quillstone.operators import evaluation as ev
from quillstone.operators import expansion as ex
from quillstone.operators import faithfulness as fa
from quillstone.operators import metrics as me
from quillstone.operators import rerank as rr
from quillstone.operators import search as rs

TEXTS = {
    "cats": "# Cats\n\nCats purr when content. A cat sleeps most of the day. Cats chase mice at night.",
    "dogs": "# Dogs\n\nDogs bark at strangers. A dog guards the house. Dogs and cats may live together.",
    "sun": "# The sun\n\nThe sun is a star. Light of the sun takes eight minutes to reach us. Stars burn hydrogen.",
    "sun2": "# The sun\n\nThe sun is a star. Light of the sun takes eight minutes to reach us. Stars burn hydrogen.",
    "empty": "",
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    p = tmp_path_factory.mktemp("corpus")
    for k, v in TEXTS.items():
        (p / f"{k}.{'TXT' if k == 'dogs' else 'md'}").write_bytes(v.replace("\n", "\r\n").encode() if k == "cats" else v.encode())
    (p / "skip.html").write_text("no")
    (p / "sub").mkdir()
    (p / "sub" / "deep.md").write_text("no")
    return str(p)


@pytest.fixture(scope="module")
def engine(spark, corpus):
    return Engine.from_corpus(spark, corpus, EngineConfig(20, 5))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([("q1", "Why do cats purr and cats sleep?"), ("q2", "light of the sun"), ("q3", "zzz"), ("q4", "?!")], "query_id string, question string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_corpus(spark, corpus, tmp_path):
    assert {r.doc_id: r.text for r in read_corpus(spark, corpus).collect()} == TEXTS
    (tmp_path / "a.md").write_text("first")
    (tmp_path / "a.txt").write_text("second")
    assert read_corpus(spark, str(tmp_path)).collect() == [("a", "second")]
    with pytest.raises(FileNotFoundError):
        read_corpus(spark, str(tmp_path / "none"))
    (tmp_path / "e").mkdir()
    with pytest.raises(ValueError):
        read_corpus(spark, str(tmp_path / "e"))


def test_gold(spark, tmp_path):
    f = tmp_path / "gold.jsonl"
    f.write_text('{"id": "a", "question": "x", "relevant": ["d", "d"]}\n\n{"id": "b", "question": "y", "relevant": [], "difficulty": "hard"}\n')
    assert rows(read_gold(spark, str(f)).select("query_id", "difficulty"), "query_id") == [("a", "easy"), ("b", "hard")]
    for bad in ('{"id": "a", "question": "x", "relevant": ["d"]}\n{broken', '{"question": "x", "relevant": []}', "[1]"):
        f.write_text(bad)
        with pytest.raises(ValueError, match="no gold question"):
            read_gold(spark, str(f))
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        read_gold(spark, str(tmp_path / "none.jsonl"))


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, "")], "chunk_index int, text string")
    q = spark.createDataFrame([("q", "a a c zz")], "query_id string, question string")
    for k1, b in ((1.5, 0.75), (0.0, 0.5), (1.2, 0.0), (2.0, 1.0)):
        index = build_index(chunks, IndexConfig(k1, b))
        idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
        norm = lambda n: k1 * (1 - b + b * n / (5 / 3))
        want = {0: 2 * idf * 2 * (k1 + 1) / (2 + norm(3)), 1: idf * (k1 + 1) / (1 + norm(2))}
        got = {r.chunk_index: r.score for r in rs.bm25_scores(index, rs.as_weights(rs.query_terms(q))).collect()}
        assert got == pytest.approx(want)
        assert len(rs.dense_scores(index, rs.as_weights(rs.query_terms(q))).collect()) == 3
    blank = build_index(spark.createDataFrame([(0, ""), (1, "!")], chunks.schema))
    assert blank.stats.first() == (2, 0.0) and rs.bm25_scores(blank, rs.as_weights(rs.query_terms(q))).count() == 0
    for bad in ((-1, 0.5), (1, 2)):
        with pytest.raises(ValueError):
            IndexConfig(*bad)


def test_vectors_are_units_and_self_similar(engine):
    p = engine.index.postings
    assert all(abs(r.s - 1) < 1e-9 for r in p.groupBy("chunk_index").agg(F.sum(F.col("w") ** 2).alias("s")).collect())
    pairs = p.select(F.col("chunk_index").alias("a")).distinct().withColumn("b", F.col("a"))
    assert all(r.sim == 1.0 for r in rs.pairwise_similarity(engine.index, pairs).collect())


def test_search(engine, questions):
    found = engine.search(questions, 3)
    got = rows(found.select("query_id", "rank", "doc_id", "score"), "query_id", "rank")
    assert {g[0] for g in got} == {"q1", "q2"} and got[0][2] == "cats"
    assert [g[2] for g in got if g[0] == "q2"][:2] == ["sun", "sun2"]  # equal texts tie, the lower index leads
    for r in found.collect():
        assert sum(r.components.values()) == pytest.approx(r.score, abs=1e-9) and r.score <= 2 / 61
    for m in ("bm25", "vector"):
        r = engine.search(questions, 2, m).collect()
        assert all(list(x.components) == [m] and x.components[m] == x.score for x in r)
    assert engine.search(questions, 0).count() == 0
    for call in (lambda: engine.search(questions, 3, "other"), lambda: engine.search(questions, -1), lambda: EngineConfig(rrf_k=0), lambda: EngineConfig(mmr_lambda=2)):
        with pytest.raises(ValueError):
            call()


def test_ranked_documents_are_distinct(engine, questions):
    got = rows(engine.ranked_doc_ids(questions, 3), "query_id", "rank")
    assert len({(q, d) for q, d, _ in got}) == len(got)
    assert [r for q, _, r in got if q == "q1"] == list(range(1, 1 + sum(q == "q1" for q, *_ in got)))


def test_partitions_do_not_matter(spark, engine, questions):
    other = Engine(engine.documents.repartition(5), engine.config)
    cols = ["query_id", "rank", "chunk_index", "score"]
    assert rows(other.search(questions, 5).select(*cols), *cols) == rows(engine.search(questions, 5).select(*cols), *cols)


def test_expansion(engine, questions, spark):
    cols = ["query_id", "rank", "chunk_index", "score"]
    plain = rows(engine.search(questions, 5).select(*cols), *cols)
    for off in (ExpansionConfig(5, 5, 1.0), ExpansionConfig(5, 0, 0.5)):
        assert rows(engine.search(questions, 5, expansion=off).select(*cols), *cols) == plain
    model = engine.expansion_model(questions, expansion=ExpansionConfig(2, 4, 0.7))
    assert all(abs(r.s - 1) < 1e-9 for r in model.groupBy("query_id").agg(F.sum("weight").alias("s")).collect())
    assert engine.expansion_model(questions).count() == 0
    own = {(r.query_id, r.term) for r in rs.query_terms(questions).collect()}
    new = [r for r in model.collect() if (r.query_id, r.term) not in own]
    assert new and not any(r.term in ("the", "of", "a") or r.term.isdigit() for r in new)
    f = spark.createDataFrame([("a", 1, -1.0), ("a", 2, 1.0), ("b", 1, 0.0), ("b", 2, 0.0)], "query_id string, chunk_index int, score double")
    assert rows(ex.feedback_weights(f), "query_id", "chunk_index") == [("a", 1, 0.0), ("a", 2, 1.0), ("b", 1, 0.5), ("b", 2, 0.5)]
    for bad in ((0, 1, 0.5), (1, -1, 0.5), (1, 1, 1.5)):
        with pytest.raises(ValueError):
            ExpansionConfig(*bad)


def test_mmr(spark, engine, questions):
    pool = spark.createDataFrame([("q", c, s, r) for c, s, r in ((0, 1.0, 1), (1, 0.9, 2), (2, 0.2, 3))], "query_id string, chunk_index int, score double, pool_rank int")
    sims = spark.createDataFrame([("q", 0, 1, 0.95), ("q", 1, 0, 0.95)], "query_id string, a int, b int, sim double")
    order = lambda k, lam: [(r.chunk_index, r.score) for r in rr.mmr(pool, sims, k, lam).orderBy("mmr_rank").collect()]
    assert [c for c, _ in order(3, 1.0)] == [0, 1, 2]
    assert order(2, 0.5) == [(0, 1.0), (2, 0.2)] and order(0, 0.5) == [] and len(order(9, 0.0)) == 3
    with pytest.raises(ValueError):
        rr.mmr(pool, sims, 1, 1.1)
    flat = rr.normalize_scores(pool.withColumn("score", F.lit(0.3)))
    assert {r.relevance for r in flat.collect()} == {1.0}
    cols = ["query_id", "rank", "chunk_index", "score"]
    assert rows(engine.search(questions, 4, mmr_lambda=1.0).select(*cols), *cols) == rows(engine.search(questions, 4).select(*cols), *cols)
    red = lambda **kw: {r.query_id: r.redundancy for r in engine.redundancy(engine.search(questions, 2, **kw)).collect()}
    a, b = red(), red(mmr_lambda=0.5)
    assert a["q2"] == pytest.approx(1.0) and b["q2"] < a["q2"]
    both = engine.search(questions, 3, mmr_lambda=0.5, expansion=ExpansionConfig()).collect()
    assert both and all(r["rank"] == r.mmr_rank for r in both)


def test_answers(spark, engine, questions):
    a = {r.query_id: r for r in engine.answer(questions, 3).collect()}
    assert a["q1"].citations[0] == "cats" and "purr" in a["q1"].text
    assert a["q3"].citations == [] and a["q3"].text.startswith("Nothing in these documents")
    assert "#" not in a["q2"].text and len(a["q2"].text.split("\n")) <= 3
    assert len(set(a["q2"].text.split("\n"))) == len(a["q2"].text.split("\n"))
    with pytest.raises(RuntimeError):
        engine.answer(questions, 3, ModelAnswerer())
    m = {r.query_id: r for r in engine.answer(questions, 2, ModelAnswerer(lambda p: p.upper(), "loud")).collect()}
    assert m["q2"].text.startswith("SOURCES:\n[1] (SUN)") and len(m["q2"].citations) == 2 and m["q2"].method == "model:loud"

    class Own:
        def answer(self, queries, results):
            return queries.select("query_id", F.lit("mine").alias("text"))

    assert engine.answer(questions, 2, Own()).first().text == "mine"
    heads = spark.createDataFrame([("q1", 1, "d", "d::0", "# Cats")], "query_id string, rank int, doc_id string, chunk_id string, text string")
    from quillstone.operators.answer import extractive

    r = extractive(questions.where("query_id = 'q1'"), heads).first()
    assert (r.text, r.citations) == ("# Cats", ["d"])


def test_faithfulness(spark):
    p = spark.createDataFrame([("q", "a", "The cat sat. It slept."), ("q", "b", "Dogs bark.")], "query_id string, doc_id string, text string")
    schema = "query_id string, text string, citations array<string>"
    ask = lambda text, cites: fa.report(spark.createDataFrame([("q", text, cites)], schema), p).first()
    r = ask("The cat sat.\nPigs fly.", ["a", "a", "b"])
    assert (r.sentence_grounding, r.token_grounding, r.citation_precision, r.citation_recall) == (0.5, 0.5, 0.5, 1.0)
    r = ask("Dogs bark.", ["a"])
    assert (r.sentence_grounding, r.citation_precision, r.citation_recall) == (1.0, 0.0, 0.0)
    assert ask("The ca.", []).sentence_grounding == 0.0
    assert tuple(ask("", []))[1:] == (0.0, 0.0, 0.0, 0.0)
    assert ask("Sat. It", ["a"]).sentence_grounding == 1.0
    assert tuple(fa.mean_report(fa.report(spark.createDataFrame([], schema), p)).first()) == (0.0, 0.0, 0.0, 0.0)


def test_metrics(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "z", 1)], "query_id string, item string, rank int")
    gold = spark.createDataFrame([("a", "y"), ("a", "y"), ("a", "w"), ("b", "q")], "query_id string, item string")
    got = {(r.query_id, r.k): (r.hit, r.recall, r.precision) for r in me.per_query(q, ranked, gold, (1, 3)).collect()}
    assert got[("a", 1)] == (0, 0, 0) and got[("a", 3)] == (1, 0.5, pytest.approx(1 / 3)) and got[("c", 3)] == got[("b", 3)] == (0, 0, 0)
    assert {r.query_id: r.rr for r in me.reciprocal_rank(q, ranked, gold).collect()} == {"a": 0.5, "b": 0, "c": 0}
    n = {r.query_id: r.ndcg for r in me.ndcg(q, ranked, gold, (3,)).collect()}
    assert n["a"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-8) and n["c"] == 0
    gains = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 0.0), ("b", "z", 0.0)], "query_id string, item string, gain double")
    g = {r.query_id: r.ndcg for r in me.ndcg(q, ranked, gold, (3,), gains).collect()}
    assert g["a"] == pytest.approx(3 / (3 + 1 / math.log2(3)), abs=1e-8) and g["b"] == 0
    means = me.aggregate(q, ranked, gold, (3,)).first()
    assert means.queries == 3 and means.mrr == pytest.approx(0.5 / 3, abs=1e-6)
    assert rows(me.misses_partials(q, ranked, gold, 3), "query_id") == [("a", "partial"), ("b", "miss")]


def test_chunks_of_a_long_document():
    import time

    from quillstone.operators.chunking import span_list

    def fold(counts, target, overlap):
        p, s, out = [0], 0, []
        for c in counts:
            p.append(p[-1] + c)
        for j in range(len(counts)):
            if j > s and p[j + 1] - p[s] > target:
                out.append((s, j - 1, p[j] - p[s]))
                s = next((i for i in range(s + 1, j) if p[j] - p[i] <= overlap), j - 1) if overlap else j
        return [*out, (s, len(counts) - 1, p[-1] - p[s])] if counts else []

    g = random.Random(1)
    for _ in range(300):
        counts = [g.choice([0, 1, 3, 8, 20, 60]) for _ in range(g.randrange(0, 40))]
        for target, overlap in ((20, 0), (20, 5), (40, 30), (1, 0)):
            assert span_list(counts, target, overlap) == fold(counts, target, overlap)
    assert span_list([2, 60, 3], 20, 5) == [(0, 0, 2), (0, 1, 62), (1, 2, 63)]
    began = time.time()
    assert len(span_list([12] * 100_000, 120, 30)) > 10_000 and time.time() - began < 5


def test_lists_are_those_of_all_scores(spark, engine, monkeypatch):
    g = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(g.choices(words, k=g.randrange(0, 12)))) for i in range(300)] + [(i, "w1 w2") for i in range(300, 330)]
    index = build_index(spark.createDataFrame(texts, "chunk_index int, text string").repartition(5))
    q = spark.createDataFrame([(f"q{i}", " ".join(g.choices([*words, "unknown"], k=5))) for i in range(12)] + [("none", "")], "query_id string, question string")
    terms = rs.query_terms(q)
    w, v = rs.as_weights(terms), rs.query_vectors(index, terms)
    order = ["query_id", "rank"]
    want = [rows(rs.top(x, 7), *order) for x in (rs.bm25_scores(index, w), rs.vector_scores(index, v))]
    for block, scores in ((500_000, 1 << 22), (20, 64)):
        monkeypatch.setattr(rs, "BLOCK_TERMS", block)
        monkeypatch.setattr(rs, "BLOCK_SCORES", scores)
        assert [rows(x, *order) for x in rs.both_tops(index, w, v, 7)] == want


def test_reports(spark, engine, questions):
    gold = spark.createDataFrame([("q1", "cats"), ("q2", "sun"), ("q2", "sun2")], "query_id string, item string")
    assert ev.parse_settings(" 5:1.0, ,3") == [("5t a1", ExpansionConfig(5, 5, 1.0)), ("3t a0.8", ExpansionConfig(5, 3, 0.8))]
    assert ev.describe(gold).first() == (2, 1)
    by = {(r.method, r.k): r for r in ev.method_report(engine, questions, gold, 3).collect()}
    for m in rs.METHODS:
        alone = me.aggregate(questions, engine.ranked_doc_ids(questions, 3, m).withColumnRenamed("doc_id", "item"), gold, (1, 3)).collect()
        assert all(by[m, r.k][2:] == r[1:] for r in alone) and len(alone) == 2
    settings = ev.parse_settings("4:1.0,4:0.7")
    by = {(r.setting, r.k): r for r in ev.expansion_report(engine, questions, gold, settings, 3).collect()}
    for n, e in settings:
        alone = me.aggregate(questions, engine.ranked_doc_ids(questions, 3, expansion=e).withColumnRenamed("doc_id", "item"), gold, (1, 3)).collect()
        assert all(by[n, r.k][2:] == r[1:] for r in alone)
    by = {(r.setting, r.k): r for r in ev.diversity_report(engine, questions, gold, (None, 1.0, 0.3), 2).collect()}
    assert by["off", 2][1:] == by["1", 2][1:] and by["0.3", 2].redundancy < by["off", 2].redundancy and by["0.3", 2].distinct_docs >= by["off", 2].distinct_docs
    f = {r.k: r for r in ev.faithfulness_report(engine, questions, gold, (2, 3)).collect()}
    a, found = engine.answer(questions, 3), engine.search(questions, 3)
    one = fa.mean_report(fa.report(a, found)).first()
    assert f[3].queries == 4 and f[3].token_grounding == one.token_grounding and f[3].cited_gold == 0.5
    text = ev.table([{"k": 1, "hit": 0.5}, {"k": 3, "hit": 1.0}], "k", 8).split("\n")
    assert text == ["k            hit", "----------------", "1          0.500", "3          1.000"] and ev.table([], "k") == ""


def test_store(spark, engine, questions, corpus, tmp_path):
    path = str(tmp_path / "index")
    engine.save(path)
    engine.save(path)
    assert [p.name for p in tmp_path.iterdir()] == ["index"]
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "letter.txt").write_text("dear")
    with pytest.raises(IndexFormatError):
        engine.save(str(tmp_path / "mine"))
    assert (tmp_path / "mine" / "letter.txt").read_text() == "dear"
    cols = ["query_id", "rank", "chunk_id", "score"]
    back = Engine.load(spark, path, corpus)
    assert back.config == engine.config and len(back) == len(engine)
    assert rows(back.search(questions, 5).select(*cols), *cols) == rows(engine.search(questions, 5).select(*cols), *cols)
    assert Engine.load(spark, path, mmr_lambda=0.5, rrf_k=10).config.rrf_k == 10
    other = tmp_path / "other"
    other.mkdir()
    (other / "cats.md").write_text("changed")
    with pytest.raises(StaleIndexError):
        Engine.load(spark, path, str(other))
    with pytest.raises(IndexFormatError):
        Engine.load(spark, str(other))
    for i, text in enumerate(("[1]", "{bad", json.dumps({"format": "x"}), json.dumps({"format": "quillstone-index", "version": 99}))):
        d = tmp_path / f"m{i}" / "manifest"
        d.mkdir(parents=True)
        (d / "part-0.txt").write_text(text)
        with pytest.raises(IndexFormatError):
            Engine.load(spark, str(d.parent))


def test_stats(spark, engine):
    s = engine.stats().first()
    assert s.documents == 5 and s.chunks == len(engine) and s.max_tokens >= s.mean_tokens >= s.min_tokens
    none = Engine(spark.createDataFrame([], "doc_id string, text string"))
    r = none.stats().first()
    assert (r.documents, r.chunks, r.vocabulary, r.mean_tokens, r.max_tokens) == (0, 0, 0, 0.0, 0.0)


def test_cli(spark, corpus, tmp_path, capsys):
    out = str(tmp_path / "saved")
    assert main(["--corpus", corpus, "--chunk-tokens", "20", "--overlap-tokens", "5", "index", out], spark) == 0
    capsys.readouterr()
    assert main(["--corpus", corpus, "--index", out, "search", "cats purr", "-k", "2"], spark) == 0
    saved = capsys.readouterr().out
    assert main(["--corpus", corpus, "--chunk-tokens", "20", "--overlap-tokens", "5", "search", "cats purr", "-k", "2"], spark) == 0
    assert capsys.readouterr().out == saved and "cats::0" in saved and "redundancy" in saved
    assert main(["--corpus", corpus, "--rrf-k", "0", "stats"], spark) == 2
    assert main(["--corpus", corpus, "--expand", "3", "--chunk-tokens", "20", "--overlap-tokens", "5", "index", out], spark) == 0
    assert Engine.load(spark, out).config.expansion == ExpansionConfig(5, 3, 0.8)
    assert main(["--corpus", corpus, "--expand", "3", "ask", "why do cats purr"], spark) == 0
    assert "Sources: cats" in capsys.readouterr().out
    assert main(["--corpus", corpus, "stats"], spark) == 0
    assert "documents: 5" in capsys.readouterr().out
    assert main(["--corpus", str(tmp_path / "no"), "stats"], spark) == 2
    assert main(["--corpus", corpus, "ask", "--llm", "x"], spark) == 2

"""The pipeline as a whole, stage by stage against brute force, and the oracles of its operators."""

import zlib

import corpus_pipeline
import pyarrow as pa
import pytest

from quillstone.llm import decontam, mixing, neardup, pipeline, toxicity
from quillstone.llm import queries as q


def _similar(docs, ids):
    """Links of all pairs, by exact weighted Jaccard similarity, and the least id of each row's class."""
    cfg = neardup.NearDupConfig()
    df, n = neardup.shingle_df(docs, "text", cfg)
    texts = pa.array([t for _, t in ids], pa.string())
    least = {i: i for i, _ in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, (i, t) in enumerate(ids):
        s = neardup.weighted_jaccard(pa.array([t] * (len(ids) - a)), texts[a:], df, n, cfg)
        for b, like in enumerate(s, a):
            if b > a and (like >= cfg.threshold or t == ids[b][1]):
                x, y = sorted((root(i), root(ids[b][0])))
                least[y] = x
    return {i: root(i) for i, _ in ids}


def test_stages_are_those_of_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = before.collect(), after.collect()
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "toxicity":
            m = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            kept = m.score(pa.array([r.text for r in old])) < 0.5
            assert sorted(new) == sorted(r for r, k in zip(old, kept) if k) and len(new) < len(old)
        elif name == "near duplicates":
            of = _similar(before, [(r.doc_id, r.text) for r in old])
            assert sorted(r.doc_id for r in new) == sorted(set(of.values())) and len(new) < len(old)
        elif name == "decontamination":
            index = decontam.LeakIndex(list(range(len(bench))), bench, decontam.LeakConfig())
            words = lambda t: index_words(t)
            items = [words(b) for b in bench]
            leaks = {r.doc_id for r in old if any(_near(i, words(r.text)) for i in items)}
            assert leaks and {r.doc_id for r in new} == {r.doc_id for r in old} - leaks
        elif name == "mixing":
            plan = {r.doc_id: r for r in mixing.mixed_sizes(before).collect()}
            want = sorted((r[f"position_{p}" if p > 1 else "position"], i) for i, r in plan.items() for p in range(1, r.passes + 1))
            order = pipeline.with_order(after).orderBy("order_file", "order_row").collect()
            assert [plan[r.doc_id].source_size > 0 for r in order].count(False) == 0
            seen, got = {}, []
            for r in order:
                seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
                got.append((plan[r.doc_id][f"position_{seen[r.doc_id]}" if seen[r.doc_id] > 1 else "position"], r.doc_id))
            assert sorted(got) == want and [x for x, _ in got] == sorted(x for x, _ in got)
        else:
            assert set(before.columns) < set(after.columns) and len(new) == len(old)
            own = [tuple(r) for r in pipeline.with_order(before).orderBy("order_file", "order_row").select(*docs.columns).collect()]
            assert [tuple(r) for r in after.orderBy("order_file", "order_row").select(*docs.columns).collect()] == own
        before = after
    assert corpus_pipeline.ORACLE_SQL is None


def index_words(t):
    h, _, _, _ = pipeline.decontam.tb.words(*pipeline.decontam.tb.buffer(pipeline.decontam.tb.strings(pa.array([t or ""]), lower=True)))
    return h


def _near(item, text):
    return decontam.edit_distances(item, text).min() <= int(len(item) * 0.2)


def test_odd_rows_pass_through_all_stages(spark, sf, tmp_path):
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(120))
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text + " more"), (None, None), (4, "!!!"), (5, "x"), (6, " ".join(f"long{i}" for i in range(60_000)))]
    odd = spark.createDataFrame([(i, t, None, None if i == 5 else "s", 1, "shard", 3, 7) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, position int, order_row int")
    for name, table in (("odd", odd), ("none", odd.where("false"))):
        before = table
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, before, sf).write.parquet(str(tmp_path / name / step))
            after = spark.read.parquet(str(tmp_path / name / step))
            if step != "sharding":
                assert after.columns == table.columns
            left = sorted({r.doc_id or 0 for r in after.collect()})
            if step == "decontamination":
                assert left == ([] if name == "none" else [1, 2, 4, 5, 6])
            elif step == "mixing":  # what a share of words takes
                taken = {r.doc_id for r in mixing.mixed_sizes(before).where("passes > 0").collect()}
                assert set(left) == taken
            before = after


def test_run_is_repeatable(spark, sf):
    key = lambda df: sorted(zlib.crc32(repr(tuple(r)).encode()) for r in df.drop("order_file", "order_row").collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(corpus_pipeline.run(spark, sf))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_is_its_sql(spark, duck, same, sf, name):
    same(q.queries()[name](spark, sf), duck.sql(q.oracle_sql()[name]))


def test_all_eleven_are_registered():
    names = q.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1

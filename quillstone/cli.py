"""Command line: search, ask, index and stats over a folder of texts."""

from __future__ import annotations

import argparse
import sys
import time

from .engine import Engine, EngineConfig
from .operators.answer import ModelAnswerer, formatted
from .operators.expansion import ExpansionConfig
from .operators.search import HYBRID, METHODS
from .session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    p.add_argument("--corpus", default="corpus", help="folder of .md and .txt files")
    for name, kind, value in (("chunk-tokens", int, 120), ("overlap-tokens", int, 30), ("rrf-k", int, None), ("expand-docs", int, 5), ("expand-weight", float, 0.8)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--index", help="saved index to use instead of building one")
    p.add_argument("--mmr", type=float, metavar="LAMBDA")
    p.add_argument("--expand", type=int, metavar="TERMS")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("search", "ask"):
        s = sub.add_parser(verb)
        s.add_argument("question")
        s.add_argument("-k", type=int, default=5 if verb == "search" else 4)
        s.add_argument("--method", choices=METHODS, default=HYBRID)
        if verb == "ask":
            s.add_argument("--llm", action="store_true")
    sub.add_parser("index").add_argument("output")
    sub.add_parser("stats")
    return p


def _expansion(a) -> ExpansionConfig | None:
    return ExpansionConfig(a.expand_docs, a.expand, a.expand_weight) if a.expand is not None else None


def _engine(spark, a) -> Engine:
    e = _expansion(a)
    if a.index:
        import os

        return Engine.load(spark, a.index, corpus=a.corpus if os.path.isdir(a.corpus) else None, rrf_k=a.rrf_k, mmr_lambda=a.mmr, expansion=e)
    return Engine.from_corpus(spark, a.corpus, _config(a, e))


def _config(a, expansion: ExpansionConfig | None) -> EngineConfig:
    return EngineConfig(a.chunk_tokens, a.overlap_tokens, 60 if a.rrf_k is None else a.rrf_k, mmr_lambda=a.mmr, expansion=expansion)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or local_session()
    try:
        if a.verb == "index":
            began = time.time()
            engine = Engine.from_corpus(spark, a.corpus, _config(a, _expansion(a)))
            engine.save(a.output)
            print(f"indexed {len(engine)} chunks into {a.output} in {time.time() - began:.1f} s")
            return 0
        engine = _engine(spark, a)
        if a.verb == "stats":
            for name, value in engine.stats().first().asDict().items():
                print(f"{name}: {round(value, 2) if isinstance(value, float) else value}")
            return 0
        q = spark.createDataFrame([("q", a.question)], "query_id string, question string")
        if a.verb == "ask":
            print(formatted(engine.answer(q, a.k, ModelAnswerer() if a.llm else None, method=a.method)).first()["formatted"])
            return 0
        if engine.config.expansion:
            model = engine.expansion_model(q, a.method).collect()
            print("terms: " + ", ".join(f"{r.term} {r.weight:.3f}" for r in sorted(model, key=lambda r: (-r.weight, r.term))))
        found = engine.search(q, a.k, a.method)
        rows = found.orderBy("rank").collect()  # k rows of one question
        for r in rows:
            print(f"{r['rank']}. [{r.chunk_id}] {r.score:.4f}\n   {r.text[:300]}")
        if not rows:
            print("nothing found")
        elif len(rows) > 1:
            print(f"redundancy: {engine.redundancy(found).first()['redundancy']:.3f}")
        return 0
    except (ValueError, FileNotFoundError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

"""Passage retrieval, question answering and corpus preparation on Spark DataFrames."""

import importlib

_WHERE = {
    "Engine": "engine",
    "EngineConfig": "engine",
    "ModelAnswerer": "operators.answer",
    "ExpansionConfig": "operators.expansion",
    "Index": "operators.index",
    "IndexConfig": "operators.index",
    "build_index": "operators.index",
    "read_corpus": "sources.corpus",
    "read_gold": "sources.corpus",
    "IndexFormatError": "sources.store",
    "StaleIndexError": "sources.store",
}

__all__ = sorted(_WHERE)


def __getattr__(name: str):
    """Names are looked up on first use, so that executors import no more than they need."""
    if name in _WHERE:
        return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(name)

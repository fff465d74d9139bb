"""Queries of this subpackage, and SQL for those that SQL can express."""

from importlib import import_module

MODULES = ("licenses", "mixing", "quality", "perplexity", "packing", "extraction", "neighbours", "language", "neardup", "repeats")

QUERIES, SQL = {}, {}
for _name in MODULES:
    _module = import_module(f"quillgraph.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

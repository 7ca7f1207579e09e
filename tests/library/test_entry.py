import importlib.util

import __spark_entry__
from loomgraph.registry import ORACLE, QUERIES


def test_contract(spark):
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and set(ORACLE) <= set(QUERIES)
    assert __spark_entry__.entry(spark).count() > 0


def test_library_does_not_know_llm():
    import pathlib

    root = pathlib.Path(importlib.util.find_spec("loomgraph").origin).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "loomgraph.llm" not in path.read_text(), path

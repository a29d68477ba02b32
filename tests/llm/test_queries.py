import re

import __spark_entry__ as entry
from wordpair.llm import queries


def test_every_operator_is_registered():
    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries()) <= set(entry.queries())


def test_the_rest_stands_without_the_subpackage(monkeypatch):
    """A library that is missing, or the folder, takes the llm queries away and no others."""
    import importlib
    import sys
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    for name in [m for m in sys.modules if m.startswith("wordpair.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    try:
        alone = importlib.reload(entry)
        assert alone.LLM is None and alone.PIPELINE is None
        assert len(alone.queries()) > 50 and not any(q.startswith("op") for q in alone.queries())
        assert set(alone.oracle_sql()) <= set(alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)

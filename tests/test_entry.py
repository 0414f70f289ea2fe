import importlib.util

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(entry, "find_spec", lambda name: None if name.startswith(("gramforge.llm", "corpus_pipeline")) else real(name))
    assert "topk_density" in entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())

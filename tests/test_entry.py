import importlib.util

import __spark_entry__


def test_flagship(spark):
    row = __spark_entry__.entry(spark).first()
    assert row["n_cells"] == 24 and abs(row["att"] + 39.947302) < 1e-5


def test_without_training_data_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("panelfx.llm", "corpus_pipeline") else find(n, *a))
    names = set(__spark_entry__.queries())
    assert names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
    assert set(__spark_entry__.oracle_sql()) <= names

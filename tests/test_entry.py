import __spark_entry__ as entry


def test_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 50
    assert "documents" in sql["normalize_text"]


def test_queries_remain_without_the_training_data(monkeypatch):
    """Whether its folder or a library that it needs is missing."""
    real = entry.importlib.import_module
    for missing in ("chartloom.llm.registry", "xxhash"):

        def load(name, missing=missing):
            if name in ("chartloom.llm.registry", "corpus_pipeline"):
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return real(name)

        monkeypatch.setattr(entry.importlib, "import_module", load)
        assert len(entry.queries()) >= 70 and not any(n == "pipeline" or n[:2] == "op" and n[2].isdigit() for n in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

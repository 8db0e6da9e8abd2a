import os

import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts; ids count from 0, sources alternate."""

    def make(texts, langs=None, sources=None, ids=None):
        rows = [
            (ids[i] if ids else i, text, langs[i] if langs else "en", sources[i] if sources else f"s{i % 2}", len(text or ""))
            for i, text in enumerate(texts)
        ]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make


@pytest.fixture
def tables_of(tmp_path, docs_of):
    """A folder with a documents table, as the queries read it."""

    def make(*args, **kwargs):
        docs_of(*args, **kwargs).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_tables():
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    return SF


ODD_TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "one", "Ünïcode — ж 日本 🙂", "a\n\nb\n", "x " * 30_000, "tab\there", "same text", "same text",
    "UPPER lower", "#*$%&|<> symbols", "\x1c control", "no_blank" * 2000, "q" * 49, "q" * 50, "q" * 51,
]

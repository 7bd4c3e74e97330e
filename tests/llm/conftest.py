"""Tests of the corpus operators use the session of the tests around them."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as a folder of Parquet files, with extra columns under names the operators use themselves."""
    def write(texts, **tables):
        rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", 1, "y") for i, t in texts]
        spark.createDataFrame(rows, SCHEMA + ", line string, sampled int, h string").write.parquet(f"{tmp_path}/documents.parquet")
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write

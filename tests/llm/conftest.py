import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, shard int, score string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns whose names operators use themselves."""
    def build(rows, parts=3):
        full = [(i, t, *(list(rest) + [None, None])[:2], None if t is None else len(t), 7, "x", 9, "s") for i, t, *rest in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return build


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

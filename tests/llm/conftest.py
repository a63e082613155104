import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))

from conftest_llm import ODD  # noqa: E402

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, node long, shard int,"
    " score double, words string, blocks long, start int, key_range int, model string, n long"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t), 1, 2, 3, 0.5, "w", 4, 5, 6, "m", 7) for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])

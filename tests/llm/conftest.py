import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with more columns whose names operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, None if i == 7 else f"s{i % 3}", i, f"{i}", i * 2, None) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n bigint, key string, block bigint, pos string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

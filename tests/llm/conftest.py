import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import EDGE, make  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with columns whose names clash with outputs."""
    return make(spark, EDGE, score=1.5, n_words="many", kept="no", spans="x", h="y", key="z", fp="f", n=3)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])

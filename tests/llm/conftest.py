"""Fixtures over small corpora."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpora import BENCHMARK, PAGES, make_documents, write  # noqa: E402


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def corpus(tmp_path_factory, documents):
    labels = [(k, int(k % 4 != 0), 0) for k in range(40)] + [(7, None, None), (None, 1, 0), (999, 0, 0)]
    return write(tmp_path_factory.mktemp("corpus"), documents, PAGES, BENCHMARK, labels)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"))

import os

import pytest

DOC_DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None, lang="en"):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in zip(ids, texts)], DOC_DDL)

    return make


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def odd():
    """Texts that every operator must take: null, empty, blank, one word, repeats, a very long one."""
    return [None, "", " \n\t ", "one", "a b c d e f", "a b c d e f", "é ß 😀 ▁ \x00", "word " * 60_000]

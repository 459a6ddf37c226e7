import pytest

import public_tokenizers


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def frame(spark):
    """documents with a null id, a null text, repeats and columns that clash with the operators' own."""
    def make(rows, schema="doc_id long, text string, rid long, id string, ids string, part int, n int"):
        return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], schema)
    return make

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def frame(spark):
    """Makes a DataFrame of documents, with nulls and further columns with clashing names where asked."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(rows, schema)

    return make



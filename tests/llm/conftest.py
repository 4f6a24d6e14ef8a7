import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from odd import ODD  # noqa: E402

#: Columns whose names clash with those that the operators use inside.
EXTRA = "_doc long, node string, text_sha256 string, keep_id string, digest string, row string, salt string, hash string, lane string, key string, score string"


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a documents table of (doc_id, text) with the usual columns and clashing ones."""
    def make(rows, extra=True):
        names = [c.split()[0] for c in EXTRA.split(", ")] if extra else []
        full = [(i, t, "en", "src", len(t) if t is not None else None, *[None] * len(names)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + (", " + EXTRA if extra else ""))

    return make


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)

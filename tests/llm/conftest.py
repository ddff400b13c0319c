from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Builds a documents table; extra columns have names that operators use inside."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows],
                                   "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "1 as size", "2 as node", "3 as n", "'x' as key", "4 as _range", "5 as score",
                             "6 as row", "7 as h") if extra else df
    return make


def words(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

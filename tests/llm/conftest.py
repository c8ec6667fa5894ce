import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("needs the test tables")
    return DATA


@pytest.fixture(scope="session")
def texts(data):
    import duckdb

    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet' ORDER BY 1").fetchall())


#: What documents may hold: nulls, emptiness, blanks, one very long text, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (5, "a b c"), (5, "a b c"), (6, "word " * 30_000), (7, "x" * 60_000), (8, "Ünïcode 😀 <|endoftext|> don't a@b.co 1.2.3.4"),
    (9, " ".join(f"w{k}" for k in range(200))), (10, " ".join(f"w{k}" for k in range(200)) + " end"), (None, "no id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with the documents' other columns and with columns that bear names of results and of steps."""
    rows = [(d, t, "en", None, len(t or ""), "x", 1, "y", "z", True) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_tokens int, spans string, `a.b` string, row boolean")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

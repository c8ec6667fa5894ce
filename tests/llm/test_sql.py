"""The SQL of this subpackage's queries against the brute-force versions."""

import duckdb
import pytest

from chronolex.llm import queries
from tests.llm.test_merkle import brute as trees
from tests.llm.test_near_dup import brute as near


@pytest.fixture(scope="module")
def con(data):
    found = duckdb.connect()
    found.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    return found


def test_op2(con, texts):
    got = {r[0]: r[1:] for r in con.execute(queries.oracle_sql()["op2_lsh_forest"]).fetchall()}
    assert got == {d: (n, c, c == d) for d, (n, c) in near(list(texts.items())).items()}


def test_op11(con):
    rows = con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    assert sorted(con.execute(queries.oracle_sql()["op11_mountain_manifest"]).fetchall(), key=str) == trees(rows)


def test_names():
    assert set(queries.oracle_sql()) <= set(queries.queries())

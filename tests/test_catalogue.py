"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from chronolex import catalogue  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def told(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple("-" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    got = told(catalogue.queries()[name](spark, str(DATA)).toPandas())
    assert got == told(duck.execute(catalogue.oracle_sql()[name]).df())
    assert got[1] or not name.startswith(("request_", "match_", "sequence_", "rollup_", "append_", "read_", "stream_"))


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    from chronolex.streaming.unigrams import count_files

    source = spark.read.parquet(str(DATA / "events.parquet"))
    days = source.orderBy("ts").collect()
    for part, rows in enumerate((days[: len(days) // 2], days[len(days) // 2 :])):
        spark.createDataFrame(rows, source.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        count_files(spark, str(tmp_path / "in" / "*"), source.schema, "ts", ["event_type"], str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("start", "event_type").distinct().count() > 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cof_two_pass_f2_B", "cof_global_T", "kbest_local", "near_dist2"])
def test_pairs_are_made_once_and_for_the_target_alone(spark, name):
    """One generation of pairs in the plan, under a filter on the target's own attribute; none for N, f1 and f2."""
    plan = catalogue.queries()[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode(around") == 1 and plan.count("Generate posexplode(t") == 1
    filters = [line for line in plan.splitlines() if "Filter" in line and "one#" in line and ".l = " in line]
    assert len(filters) == 1


def test_colocated_matrix_needs_no_shuffle_by_document(spark):
    plan = catalogue.queries()["tdf_colocated_B"](spark, str(DATA))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in text and "Bucketed: true" in text

"""A database that grows against one that is built anew."""

import random

import pytest

from chronolex.plans.database import create
from chronolex.plans.store import Settings, Store

ATTRS = ("l", "p")
SETTINGS = Settings(ATTRS, 3, 3, 2)


def made(spark, docs, seed=1):
    rnd = random.Random(seed)
    rows = [(d, s, k, 1900 + d % 5, rnd.choice("abcde"), rnd.choice("XY")) for d in range(60) for s in range(2) for k in range(rnd.randint(0, 9))]
    return spark.createDataFrame([r for r in rows if r[0] in docs], "doc_id long, sent_id long, pos int, date int, l string, p string"), spark.createDataFrame([(d, f"g{d % 3}") for d in docs], "doc_id long, genre string")


def tables(db):
    return {n: sorted(tuple(r[c] for c in sorted(t.columns)) for r in t.collect()) for n, t in (("xf", db.xf), ("cof", db.cof), ("marginal", db.marginal), ("tdf", db.tdf), ("docs", db.docs))}


def whole(spark, docs, **how):
    return tables(create(*made(spark, docs), ATTRS, distance=3, tuple_min=1, cof_min=3, segment_least=2, **how))


def test_batches_make_the_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SETTINGS)
    with pytest.raises(ValueError):
        store.open()
    for name, docs in (("a", range(25)), ("b", range(25, 30)), ("c", range(30, 60))):
        assert store.append(name, *made(spark, docs))
        assert not store.append(name, *made(spark, docs))
    assert len(store.version().folders) == 3
    want = whole(spark, range(60))
    assert tables(store.open()) == want
    single = [tuple(tables(create(*made(spark, d), ATTRS, distance=3, tuple_min=1, cof_min=3))["cof"]) for d in (range(25), range(25, 30), range(30, 60))]
    assert set(want["cof"]) - {x for s in single for x in s}, "some pairs reach the threshold only together"
    assert store.compact() and not store.compact() and len(store.version().folders) == 1
    assert tables(store.open()) == want and len(store.tidy()) == 3 and store.tidy() == []
    # Pairs under the threshold are still there after a compaction.
    assert store.remove("d", *made(spark, range(10, 20))) and store.append("e", *made(spark, range(10, 15)))
    assert tables(Store(spark, str(tmp_path / "s")).open()) == whole(spark, [*range(15), *range(20, 60)])
    again = Store(spark, str(tmp_path / "s")).open(cof_min=1)
    assert again.cof.count() > len(want["cof"])
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s"), Settings(("l",)))


def test_writers_at_once_and_failed_writers(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "s"), SETTINGS), Store(spark, str(tmp_path / "s"), SETTINGS)
    one, two, again = (store._written(store._counted(*made(spark, d), 1, ("pos",))) for d in (range(5), range(5, 9), range(5)))
    assert store._commit(one, "a") and other._commit(two, "b") and not other._commit(again, "a")
    assert store.version().batches == ("a", "b") and tables(store.open()) == whole(spark, range(9))
    (tmp_path / "s" / "versions" / "00000003.json").write_text('{"fold')  # its writer was lost
    assert store.version().number == 2 and store.append("c", *made(spark, range(9, 12))) and store.version().number == 4
    assert tables(store.open(document_min=2)) == whole(spark, range(12), document_min=2)
    stale = store._written(store._counted(*made(spark, range(3)), 1, ("pos",)))
    assert not store._commit(stale, None, ("no such folder",)) and store.tidy() == []


def test_target_is_pushed_to_each_folder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SETTINGS)
    for name, docs in (("a", range(5)), ("b", range(5, 9))):
        store.append(name, *made(spark, docs))
    found = store.open().profile("cof", {"l": "a"}, ["l"], size=0, name="ld")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(l1,a)") == 2 and found.count() > 0

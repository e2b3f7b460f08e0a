"""The keyed store: merges, snapshots, changes at once, tiers."""

import datetime as dt

import pytest

from quantloom.sources.store import BarStore

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, symbols, days, close=1.0, start=dt.datetime(2020, 1, 1)):
    return spark.createDataFrame([(s, start + dt.timedelta(days=d), close, close, close, close, 1.0) for s in symbols for d in days], BARS)


@pytest.fixture
def own(spark, tmp_path):
    return BarStore(spark, f"file://{tmp_path}/store")


def held(store, version=None):
    return sorted((r.symbol, r.ts.toordinal() - dt.date(2020, 1, 1).toordinal(), r.close) for r in store.rows(version).collect())


def test_bars_inserted_twice_are_held_once(spark, own):
    assert own.versions() == [] and own.files() == [] and own.rows() is None
    assert own.insert(bars(spark, "ab", range(40)), "D1") == 1
    assert own.insert(bars(spark, "ab", range(40)), "D1") == 2
    assert held(own) == [(s, d, 1.0) for s in "ab" for d in range(40)]
    own.insert(bars(spark, "a", range(35, 50), 2.0), "D1")
    own.insert(bars(spark, "a", range(3)), "H1")
    assert held(own) == sorted([("a", d, 2.0 if d >= 35 else 1.0) for d in range(50)] + [("b", d, 1.0) for d in range(40)] + [("a", d, 1.0) for d in range(3)])
    assert own.coverage().where("timeframe = 'D1' AND symbol = 'a'").first().n_bars == 50


def test_only_months_with_new_bars_are_written(spark, own):
    own.insert(bars(spark, "ab", range(90)), "D1")
    before = {f["file"] for f in own.files() if not f["begin"].startswith("2020-02")}
    own.insert(bars(spark, "a", [40], 5.0), "D1")
    after = {f["file"] for f in own.files()}
    assert before and before < after and len(own.files()) == len({f["file"] for f in own.files()})


def test_keys_repeated_in_one_insert_and_rows_without_key(spark, own):
    rows = [("a", dt.datetime(2020, 1, 1), 1.0, 1.0, 1.0, c, 1.0) for c in (3.0, 5.0, 4.0)] + [(None, dt.datetime(2020, 1, 1), *[1.0] * 5), ("a", None, *[1.0] * 5)]
    own.insert(spark.createDataFrame(rows, BARS), "D1")
    assert held(own) == [("a", 0, 5.0)]


def test_readers_stay_on_their_version(spark, own):
    own.insert(bars(spark, "a", range(5)), "D1")
    old = own.rows()
    own.insert(bars(spark, "a", range(5), 9.0), "D1")
    own.delete("a", "D1", "2020-01-01", "2020-01-03")
    assert {r.close for r in old.collect()} == {1.0} and old.count() == 5
    assert held(own, 2) == [("a", d, 9.0) for d in range(5)] and held(own) == [("a", 3, 9.0), ("a", 4, 9.0)]
    assert own.vacuum(keep=2) > 0 and own.versions() == [2, 3] and len(held(own, 2)) == 5
    own.vacuum()
    assert own.versions() == [3] and held(own) == [("a", 3, 9.0), ("a", 4, 9.0)]


class Overtaken(BarStore):
    """Before its first commit another change is made."""

    other = None

    def _commit(self, version, files):
        if self.other:
            change, self.other = self.other, None
            change()
        return super()._commit(version, files)


def test_bars_appended_during_a_delete_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store, other = Overtaken(spark, path), BarStore(spark, path)
    store.insert(bars(spark, "ab", range(20)), "D1")
    store.other = lambda: other.insert(bars(spark, "ac", range(15, 25), 7.0), "D1")
    store.delete("a", "D1", "2020-01-01", "2020-01-17")
    assert held(store) == sorted([("a", d, 7.0) for d in range(17, 25)] + [("b", d, 1.0) for d in range(20)] + [("c", d, 7.0) for d in range(15, 25)])


def test_two_inserts_into_one_month_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store, other = Overtaken(spark, path), BarStore(spark, path)
    store.insert(bars(spark, "a", range(10)), "D1")
    store.other = lambda: other.insert(bars(spark, "a", [3, 12], 8.0), "D1")
    store.insert(bars(spark, "a", [3, 4], 9.0), "D1")
    assert held(store) == [("a", d, {3: 9.0, 4: 9.0, 12: 8.0}.get(d, 1.0)) for d in [*range(10), 12]]


def test_a_change_elsewhere_costs_no_second_write(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store, other = Overtaken(spark, path), BarStore(spark, path)
    store.insert(bars(spark, "a", range(10)), "D1")
    store.other, writes, write = lambda: other.insert(bars(spark, "a", [100]), "D1"), [], store._write
    store._write = lambda *a: writes.append(1) or write(*a)
    store.insert(bars(spark, "a", [3], 9.0), "D1")
    assert len(writes) == 1 and len(held(store)) == 11 and ("a", 3, 9.0) in held(store)


def test_queries_open_only_files_they_meet(spark, own):
    own.insert(bars(spark, [f"s{i:02d}" for i in range(16)], range(0, 1500, 3)), "D1", files=8)
    wanted = (["s03"], "D1", "2020-02-01", "2021-03-31")
    before, found = own.scanned(*wanted), own.query(*wanted).collect()
    assert all(f["first"] <= "s03" <= f["last"] and f["end"] >= "2020-02-01" and f["begin"] <= "2021-03-31 00:00:00" for f in before)
    assert len(before) < len(own.files()) / 2
    own.retier("2024-06-01")
    after = own.scanned(*wanted)
    assert {f["tier"] for f in own.files()} == {"hot", "warm"} and len(after) <= 2 < len(before)
    assert own.query(*wanted).collect() == found and len(found) == len([d for d in range(0, 1500, 3) if 31 <= d <= 455])
    assert own.retier("2024-06-01") is None
    own.retier("2026-06-01")
    assert "cold" in {f["tier"] for f in own.files()} and own.query(*wanted).collect() == found and own.rows().count() == 16 * 500


def test_columns_that_come_later_are_null_before(spark, own):
    own.insert(bars(spark, "a", range(3)), "D1")
    own.insert(bars(spark, "a", [2, 40]).selectExpr("*", "2.5 AS amount"), "D1")
    assert sorted((r.ts.day, r.amount and float(r.amount)) for r in own.rows().collect()) == [(1, None), (2, None), (3, 2.5), (10, 2.5)]
    assert own.delete("zz", "D1") is None and own.query("zz", "D1", "2020-01-01", "2021-01-01").count() == 0
    own.delete("a", "D1")
    assert own.files() == []

"""Landing with a ledger: repeats, changed, lost and broken-off files."""

import datetime as dt
import os

import pytest

from tidemark.sources import landing, ledger

AT = dt.datetime(2024, 3, 1, 4, 0)


def put(folder, name, lines, modified=None):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))
    if modified:
        os.utime(path, (modified, modified))


@pytest.fixture
def feed(tmp_path):
    folder, table = tmp_path / "feed", str(tmp_path / "bronze")
    put(folder, "a.json", ['{"id": 1}', '{"id": 2}'])
    put(folder, "sub dir/b.json", ['{"id": 3}', "not json"])
    return folder, table


def land(spark, folder, table, at=AT, **more):
    return ledger.land(spark, str(folder), table, lambda paths: landing.land_json(spark, paths, "SYS", at, {"id": ("$.id", "int")}), **more)


def ids(spark, table, where="true"):
    return sorted((r["id"] for r in ledger.bronze(spark, table).where(where).collect()), key=lambda x: (x is None, x))


def test_landing_twice_gives_the_same_table(spark, feed):
    folder, table = feed
    assert land(spark, folder, table) == 2
    first = sorted(map(str, ledger.bronze(spark, table).collect()))
    assert ids(spark, table) == [1, 2, 3, None]
    assert land(spark, folder, table, AT + dt.timedelta(days=1)) == 0
    assert sorted(map(str, ledger.bronze(spark, table).collect())) == first


def test_new_and_changed_files_replace_their_own_rows(spark, feed):
    folder, table = feed
    land(spark, folder, table)
    put(folder, "c.json", ['{"id": 9}'])
    put(folder, "a.json", ['{"id": 1}', '{"id": 20}', '{"id": 21}'])
    assert land(spark, folder, table, AT + dt.timedelta(days=1)) == 2
    assert ids(spark, table) == [1, 3, 9, 20, 21, None]
    assert ids(spark, table, "load_date = '2024-03-01'") == [3, None]
    put(folder, "c.json", ['{"id": 8}'], modified=1_700_000_000)  # as long as before, other time
    assert land(spark, folder, table) == 1
    assert ids(spark, table) == [1, 3, 8, 20, 21, None]
    assert ledger.vacuum(spark, table) == 0 and ids(spark, table) == [1, 3, 8, 20, 21, None]
    put(folder, "sub dir/b.json", ['{"id": 4}'])
    land(spark, folder, table)
    assert ledger.vacuum(spark, table) == 1 and ids(spark, table) == [1, 4, 8, 20, 21]


def test_lost_files(spark, feed):
    folder, table = feed
    land(spark, folder, table)
    os.remove(folder / "a.json")
    assert land(spark, folder, table) == 0 and ids(spark, table) == [1, 2, 3, None]
    assert land(spark, folder, table, mirror=True) == 0 and ids(spark, table) == [3, None]
    assert land(spark, folder, table, mirror=True) == 0 and ids(spark, table) == [3, None]
    put(folder, "a.json", ['{"id": 1}', '{"id": 2}'])
    assert land(spark, folder, table, mirror=True) == 1 and ids(spark, table) == [1, 2, 3, None]


def test_a_landing_that_breaks_off_is_not_seen_and_is_done_again(spark, feed, monkeypatch):
    folder, table = feed
    land(spark, folder, table)
    put(folder, "c.json", ['{"id": 9}'])
    put(folder, "a.json", ['{"id": 5}'])

    def broken(paths):
        """Rows that reach the table without their ledger entry."""
        rows = landing.land_json(spark, paths, "SYS", AT + dt.timedelta(days=9), {"id": ("$.id", "int")})
        rows.withColumn("load_date", rows.load_timestamp.cast("date")).write.partitionBy("load_date").parquet(f"{table}/rows/landing=2")
        raise OSError("lost")
    with pytest.raises(OSError):
        ledger.land(spark, str(folder), table, broken)
    assert ids(spark, table) == [1, 2, 3, None]
    assert land(spark, folder, table) == 2
    assert ids(spark, table) == [3, 5, 9, None]


def test_listing_opens_no_file_and_dates_prune(spark, feed):
    folder, table = feed
    land(spark, folder, table)
    plan = ledger.bronze(spark, table).where("load_date = '2024-03-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_date" in plan
    assert "content" not in ledger.listing(spark, str(folder))._jdf.queryExecution().executedPlan().toString()

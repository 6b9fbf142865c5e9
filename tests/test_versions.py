"""Versions of the store: what a change opens and writes, crashes, compaction; ranks."""

import glob
import os
import random
import shutil

import pytest
from conftest import at, ids
from pyspark.sql import functions as F

from usageledger.operators.query import RecordQuery, SortBy
from usageledger.operators.ranking import with_rank
from usageledger.plans import archive, id_index, manifest
from usageledger.plans.manifest import ConcurrentWrite
from usageledger.plans.store import DuplicateRecords, RecordStore
from usageledger.schema import RECORD_ADD, RECORD_UPDATE


def job(record_id, start, stop=None):
    return (record_id, {"site": ["s"]}, [], at(start), at(stop) if stop else None)


def added(spark, *jobs):
    return spark.createDataFrame(list(jobs), RECORD_ADD)


def update_of(spark, *rows):
    return spark.createDataFrame([(i, at(t)) for i, t in rows], RECORD_UPDATE)


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "record_id string")


def files(folder):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def stops(store):
    return {r["record_id"]: r["runtime"] for r in store.records().collect()}


def sixty_months():
    return [job(f"r-{y}-{m:02d}", f"{y}-{m:02d}-05T00:00:00Z", f"{y}-{m:02d}-05T01:00:00Z")
            for y in range(2019, 2024) for m in range(1, 13)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    store = RecordStore(spark, str(tmp_path_factory.mktemp("written") / "years"))
    store.add(added(spark, *sixty_months()))
    return store.path


@pytest.fixture
def years(spark, tmp_path, written):
    """A store of 60 months of its own."""
    path = str(tmp_path / "years")
    shutil.copytree(written, path)
    return RecordStore(spark, path)


def spoil(paths):
    """Make files unreadable."""
    for path in paths:
        crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
        with open(path, "wb") as broken:
            broken.write(b"not a table")


def test_changes_open_their_index_buckets_only(spark, years):
    """With every record file and every other bucket spoilt, ids are still looked up, a
    duplicate is found, and a record is added, corrected and deleted."""
    names = named(spark, "new", "r-2020-02")
    buckets = {r[0] for r in names.select(id_index.bucket(years.manifest().buckets)).collect()}
    own = [f"/bucket={b}/" for b in buckets]
    spoil(files(f"{years.path}/records"))
    spoil(f for f in files(f"{years.path}/ids") if not any(o in f for o in own))
    found = years.lookup(names).collect()
    assert [tuple(r) for r in found] == [("r-2020-02", "2020-02")]
    with pytest.raises(DuplicateRecords):
        years.add(added(spark, job("r-2020-02", "2020-02-05T00:00:00Z"), job("new", "2022-01-01T00:00:00Z")))
    years.add(added(spark, job("new", "2022-01-01T00:00:00Z"), job("r-2020-02", "2020-02-05T00:00:00Z")), "skip")
    years.update(update_of(spark, ("r-2020-02", "2020-03-01T00:00:00Z")), order_by="stop_time")
    years.delete(named(spark, "new"))
    assert years.version() == 4
    assert [r[0] for r in years.lookup(names).collect()] == ["r-2020-02"]


def test_corrections_and_deletions_write_no_records(spark, years):
    before = files(f"{years.path}/records")
    years.update(update_of(spark, ("r-2020-02", "2020-02-05T02:00:00Z")), order_by="stop_time")
    years.update(update_of(spark, ("r-2020-02", "2020-02-05T03:00:00Z")), order_by="stop_time")
    years.delete(named(spark, "r-2021-07", "unknown"))
    assert files(f"{years.path}/records") == before
    runtimes = stops(years)
    assert runtimes["r-2020-02"] == 3 * 3600 and runtimes["r-2020-03"] == 3600
    assert "r-2021-07" not in runtimes and len(runtimes) == 59
    # Other months are scanned without a join.
    query = years.stopped_between("2022-01-01T00:00:00Z", "2022-03-01T00:00:00Z")
    assert "Join" not in query._jdf.queryExecution().executedPlan().toString()
    assert sorted(ids(query)) == ["r-2022-01", "r-2022-02"]


def test_job_that_dies_before_the_pointer(spark, years, monkeypatch):
    """Everything is written but the pointer: the version before stays, and the change can
    be made again."""

    def die(*args):
        raise RuntimeError("lost")

    change = update_of(spark, ("r-2020-02", "2020-02-05T09:00:00Z"))
    more = added(spark, job("late", "2020-02-06T00:00:00Z"))
    with monkeypatch.context() as patch:
        patch.setattr(manifest, "point_to", die)
        for attempt in (
            lambda: years.update(change, order_by="stop_time"),
            lambda: years.add(more),
            lambda: years.delete(named(spark, "r-2020-03")),
            years.compact,
        ):
            if attempt == years.compact:
                patch.undo()
                years.update(change, order_by="stop_time")
                patch.setattr(manifest, "point_to", die)
            with pytest.raises(RuntimeError):
                attempt()
    again = RecordStore(spark, years.path)
    assert again.version() == 2
    assert len(stops(again)) == 60 and stops(again)["r-2020-02"] == 9 * 3600
    again.add(more)
    again.delete(named(spark, "r-2020-03"))
    assert len(stops(again)) == 60 and "late" in stops(again)


def test_second_writer_fails(spark, years):
    base = years.manifest()
    years.add(added(spark, job("x", "2020-01-01T00:00:00Z")))
    with pytest.raises(ConcurrentWrite):
        manifest.publish(spark, years.path, base.following())
    assert "x" in stops(years)


def test_readers_keep_their_version(spark, years):
    old, number = years.records(), years.version()
    years.update(update_of(spark, ("r-2019-01", "2019-01-06T00:00:00Z")), order_by="stop_time")
    years.delete(named(spark, "r-2019-02"))
    years.compact()
    assert old.count() == 60
    assert {r["runtime"] for r in years.records(number).collect()} == {3600}
    assert years.records().count() == 59


def test_compact_and_vacuum(spark, years):
    years.add(added(spark, job("a", "2019-01-09T00:00:00Z"), job("b", "2030-01-01T00:00:00Z")))
    years.update(update_of(spark, ("a", "2019-01-09T00:10:00Z"), ("r-2019-03", "2019-03-06T00:00:00Z")), order_by="stop_time")
    years.delete(named(spark, "b", "r-2019-04"))
    expected = sorted(map(str, years.stored().collect()))
    years.compact()
    version = years.manifest()
    assert not version.changed_months() and len(version.index) == 1
    assert "2030-01" not in version.months() and "2019-04" not in version.months()
    assert sorted(map(str, years.stored().collect())) == expected
    count = len(files(years.path))
    years.vacuum()
    assert len(files(years.path)) < count
    assert sorted(map(str, years.stored().collect())) == expected
    assert years.index().where("NOT live").count() == 0
    years.compact()
    assert years.version() == version.version


def test_record_that_comes_back(spark, tmp_path):
    """Deletions and corrections do not touch a record that was added after them."""
    store = RecordStore(spark, str(tmp_path / "back"))
    store.add(added(spark, job("a", "2024-01-01T00:00:00Z"), job("b", "2024-01-01T00:00:00Z")))
    store.update(update_of(spark, ("a", "2024-01-01T01:00:00Z")), order_by="stop_time")
    store.delete(named(spark, "a"))
    assert ids(store.get()) == ["b"]
    store.add(added(spark, job("a", "2024-02-01T00:00:00Z")))
    assert stops(store) == {"a": None, "b": None}
    assert [tuple(r) for r in store.lookup(named(spark, "a")).collect()] == [("a", "2024-02")]
    with pytest.raises(DuplicateRecords):
        store.add(added(spark, job("a", "2024-01-01T00:00:00Z")))
    store.delete(named(spark, "a"))
    store.add(added(spark, job("a", "2024-01-02T00:00:00Z")))  # into the month it was deleted from
    store.update(update_of(spark, ("a", "2024-01-02T00:00:05Z")), order_by="stop_time")
    assert stops(store) == {"a": 5, "b": None}
    store.compact()
    assert stops(store) == {"a": 5, "b": None}


def test_index_and_records_stay_in_few_segments(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "many"), buckets=4)
    for k in range(10):
        store.add(added(spark, job(f"r-{k}", "2024-01-01T00:00:00Z")))
        if k == 2:
            store.update(update_of(spark, ("r-1", "2024-01-01T00:00:07Z")), order_by="stop_time")
            store.delete(named(spark, "r-2"))
    assert len(store.manifest().index) < manifest.MERGED
    assert store.lookup(named(spark, *[f"r-{k}" for k in range(15)])).count() == 9
    # So do the records of a month, with the changes that came after them.
    assert len(store.manifest().of(manifest.RECORDS)) < manifest.MERGED
    runtimes = stops(store)
    assert len(runtimes) == 9 and runtimes.pop("r-1") == 7 and set(runtimes.values()) == {None}
    store.update(update_of(spark, ("r-1", "2024-01-01T00:00:09Z"), ("r-9", "2024-01-01T00:00:09Z")), order_by="stop_time")
    assert stops(store)["r-1"] == stops(store)["r-9"] == 9
    assert manifest.to_merge(tuple(manifest.IndexSegment(k, 1) for k in range(7))) == 0
    sizes = (10_000, 900, *[100] * 8)
    assert manifest.to_merge(tuple(manifest.IndexSegment(k, n) for k, n in enumerate(sizes))) == 9


def test_preview_of_an_update(spark, years):
    changed = years.preview_update(
        update_of(spark, ("r-2020-02", "2020-02-05T00:00:09Z"), ("nobody", "2020-02-05T00:00:09Z")), order_by="stop_time"
    )
    assert [(r["record_id"], r["runtime"]) for r in changed.collect()] == [("r-2020-02", 9)]
    assert stops(years)["r-2020-02"] == 3600


def test_archive_reads_closed_months_only(spark, years, tmp_path):
    """Files of later months are spoilt and the archive of earlier ones still works."""
    years.add(added(spark, job("open", "2019-01-01T00:00:00Z"), job("long", "2019-01-01T00:00:00Z", "2023-06-01T00:00:00Z")))
    late = [f for f in files(f"{years.path}/records") if "/start_month=202" in f]
    spoil(f for f in late if "/start_month=2019" not in f)
    folder = str(tmp_path / "archive")
    archive.archive_store(years, folder, at("2020-01-15T00:00:00Z"), 0)
    assert archive.archived_months(spark, folder) == {(2019, m) for m in range(1, 13)}
    left = years._live(years.manifest(), {f"2019-{m:02d}" for m in range(1, 13)})
    assert sorted(ids(left)) == ["long", "open"]


def test_rank_of_a_whole_table(spark):
    rng = random.Random(1)
    rows = [(f"r{k}", rng.choice([None, *range(5)]), k % 3) for k in range(5000)]
    table = spark.createDataFrame(rows, "record_id string, value long, _at long").repartition(7)
    order = [F.col("value").desc_nulls_first(), F.col("record_id").asc()]
    found = with_rank(table.drop("_at"), order).collect()
    expected = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert {r["rank"]: r["record_id"] for r in found} == {k + 1: r[0] for k, r in enumerate(expected)}
    # Rows that are equal in the order get different places; no rows give no rows.
    equal = with_rank(table.select("value").withColumn("value", F.lit(1)), [F.col("value")])
    assert sorted(r["rank"] for r in equal.collect()) == list(range(1, 5001))
    assert with_rank(table.where("false"), order).count() == 0


def test_rank_of_the_store(spark, years):
    years.add(added(spark, job("open", "2019-01-01T00:00:00Z")))
    query = RecordQuery().sort_by(SortBy().descending("stop_time")).limit(5)
    ranks = {r["rank"]: r["record_id"] for r in years.ranked(query).collect()}
    assert len(ranks) == 61 and ranks[1] == "open" and ranks[2] == "r-2023-12" and ranks[61] == "r-2019-01"

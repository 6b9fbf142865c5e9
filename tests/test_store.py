from datetime import datetime, timedelta, timezone

import pytest
from conftest import at, component, ids, record
from pyspark.sql import functions as F

from usageledger.catalog import sinks
from usageledger.functions.calendar import month_bounds
from usageledger.operators.query import Operator, RecordQuery
from usageledger.operators.reshape import to_added, to_record, to_update
from usageledger.plans import archive, utilization
from usageledger.plans.store import (
    DuplicateRecords,
    InvalidRecords,
    RecordStore,
    UnknownRecords,
)
from usageledger.schema import RECORD_ADD
from usageledger.session import settings
from usageledger.sources.records import read_archived, read_json


@pytest.fixture
def store(spark, tmp_path):
    return RecordStore(spark, str(tmp_path / "store"))


@pytest.fixture(scope="module")
def four(records_of):
    return to_added(
        records_of(
            record("1", "2022-06-27T15:00:00Z", "2022-06-27T15:01:00Z"),
            record("2", "2022-06-27T16:00:00Z", "2022-06-27T16:04:00Z"),
            record("3", "2022-06-27T14:00:00Z", "2023-06-27T14:08:00Z"),
            record("4", "2022-07-27T13:00:00Z", None, {"site": ["a"]}, [component("c", 1, s=0.5)]),
        )
    )


def test_add_derives_the_runtime(store, four):
    store.add(four)
    assert {r["record_id"]: r["runtime"] for r in store.get().collect()} == {
        "1": 60, "2": 240, "3": 31536480, "4": None,
    }
    assert ids(store.get()) == ["1", "2", "3", "4"]
    row = store.get_single_record("4").first()
    assert row["meta"] == {"site": ["a"]} and row["components"][0]["scores"][0]["value"] == 0.5
    assert store.get_single_record("1").first()["components"] is None
    assert store.get_single_record("5").count() == 0


def test_empty_store(store):
    assert store.get().count() == 0


def test_adding_twice_fails_and_changes_nothing(store, four):
    store.add(four.where("record_id = '1'"))
    with pytest.raises(DuplicateRecords):
        store.bulk_insert(four)
    assert ids(store.get()) == ["1"]
    with pytest.raises(DuplicateRecords):
        store.add(four.where("record_id = '2'").unionByName(four.where("record_id = '2'")))
    store.add(four, on_duplicate="ignore_batch")
    assert ids(store.get()) == ["1"]
    store.add(four.unionByName(four), on_duplicate="skip")
    assert ids(store.get()) == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        store.add(four, on_duplicate="replace")


def test_invalid_records(store, four, spark):
    bad = four.unionByName(
        spark.createDataFrame([(" ", None, [], at("2022-01-01T00:00:00Z"), None)], four.schema)
    )
    with pytest.raises(InvalidRecords):
        store.add(bad)
    assert store.get().count() == 0
    rejects = store.add(bad, on_invalid="skip")
    assert store.get().count() == 4
    assert rejects.first()["reasons"] == ["record_id"]


def test_update(store, four, spark):
    store.add(four, now=at("2024-01-01T00:00:00Z"))
    stop = at("2022-07-27T14:00:00Z")
    updates = spark.createDataFrame(
        [("4", at("2022-07-27T19:00:00Z"), 1), ("4", stop, 2)], "record_id string, stop_time timestamp, seq int"
    )
    store.update(updates, order_by="seq", now=at("2024-01-02T00:00:00Z"))
    row = store.stored().where("record_id = '4'").first()
    assert row["runtime"] == 3600
    assert row["updated_at"].astimezone(timezone.utc) == at("2024-01-02T00:00:00Z")
    untouched = store.stored().where("record_id = '1'").first()
    assert untouched["updated_at"].astimezone(timezone.utc) == at("2024-01-01T00:00:00Z")
    assert store.get().count() == 4


def test_update_of_unknown_records(store, four, spark):
    store.add(four)
    updates = spark.createDataFrame(
        [("9", at("2022-07-27T14:00:00Z")), ("1", at("2022-06-27T15:02:00Z"))],
        "record_id string, stop_time timestamp",
    )
    with pytest.raises(UnknownRecords):
        store.update(updates, order_by="stop_time")
    assert store.get_single_record("1").first()["runtime"] == 60
    assert ids(store.update(updates, order_by="stop_time", on_unknown="return")) == ["9"]
    assert store.get_single_record("1").first()["runtime"] == 120


def test_delete_drops_empty_months(store, four, spark):
    store.add(four)
    store.delete(spark.createDataFrame([("4",), ("1",), ("x",)], "record_id string"))
    assert ids(store.get()) == ["2", "3"]
    assert [r[0] for r in store.stored().select("start_month").distinct().collect()] == ["2022-06"]


def test_start_time_prunes_months(store, four):
    store.add(four)
    query = RecordQuery(start_time=Operator().gte("2022-07-01T00:00:00Z"))
    answer = store.advanced_query(query)
    assert ids(answer) == ["4"]
    plan = answer._jdf.queryExecution().executedPlan().toString()
    assert "start_month" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert ids(store.get_started_since("2022-06-27T15:30:00Z")) == ["2", "4"]
    assert ids(store.get_stopped_since("2022-06-27T16:00:00Z")) == ["2", "3"]


def test_conversions(four):
    assert to_record(four).where("components is not null").count() == 1
    assert ids(to_update(four).orderBy("record_id")) == ["1", "2", "3"]


def test_json(spark, tmp_path):
    lines = [
        '{"record_id": "a", "meta": {"site": ["x"]}, "components": [{"name": "c", "amount": 1, "scores":'
        ' [{"name": "s", "value": 1.5}]}], "start_time": "2022-08-03T09:47:00Z"}',
        '{"record_id": "b", "components": []}',
        '{"components": [], "start_time": "2022-08-03T09:47:00Z"}',
        '{"record_id": "c", "components": [{"name": "c", "amount": -1, "scores": []}],'
        ' "start_time": "2022-08-03T09:47:00Z"}',
    ]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    (tmp_path / "array.json").write_text("[" + ",\n".join(lines) + "]")
    for name, multi in (("lines.json", False), ("array.json", True)):
        valid, rejects = read_json(spark, str(tmp_path / name), multi_line=multi)
        assert ids(valid) == ["a"]
        assert valid.first()["components"][0]["scores"][0]["value"] == 1.5
        assert sorted(r["reasons"] for r in rejects.collect()) == [
            ["component amount"], ["record_id"], ["start_time"],
        ]


# -- archive -----------------------------------------------------------------------


NOW = datetime(2025, 8, 15, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def six(records_of):
    def row(number, start, stop, score):
        return record(number, start, stop, {"group_id": ["g"]}, [component("NumCPUs", 40, HEPSPEC=score)])

    return to_added(
        records_of(
            row("1", "2025-05-27T15:00:00Z", "2025-05-27T15:01:00Z", 1.2),
            row("2", "2025-05-27T16:00:00Z", "2025-05-27T16:04:00Z", 1.5),
            row("3", "2022-06-27T14:00:00Z", "2022-06-27T14:08:00Z", 1.8),
            row("4", "2022-05-30T13:00:00Z", "2022-06-27T13:01:00Z", 0.8),
            row("5", "2025-07-27T13:00:00Z", "2025-07-27T13:01:00Z", 1.0),
            row("6", "2025-07-01T00:00:00Z", "2025-07-01T00:00:00Z", 1.0),
            row("7", "2022-05-30T13:00:00Z", None, 1.0),
        )
    )


@pytest.mark.parametrize("compression", archive.COMPRESSIONS)
def test_archive_round_trip(spark, store, six, tmp_path, compression):
    folder = str(tmp_path / "archive")
    store.add(six)
    archive.archive_store(store, folder, NOW, 1, compression)
    assert ids(store.get()) == ["6", "5", "7"]
    archived = archive.read_archive(spark, folder)
    assert archive.archived_months(spark, folder) == {(2022, 6), (2025, 5)}
    assert archived.count() == 4
    archive.restore(store, folder, [(2025, 5)])
    assert ids(store.get()) == ["1", "2", "6", "5", "7"]
    scores = {
        r["record_id"]: r["components"][0]["scores"][0]["value"]
        for r in store.get().where("record_id in ('1', '2')").collect()
    }
    assert scores == {"1": 1.2, "2": 1.5}
    with pytest.raises(DuplicateRecords):
        archive.restore(store, folder)
    archive.restore(store, folder, on_duplicate="skip")
    assert store.get().count() == 7
    # What was restored is not written over.
    with pytest.raises(archive.ArchiveExists):
        archive.archive_store(store, folder, NOW, 1, compression)
    assert store.get().count() == 7


def test_nothing_to_archive(spark, store, six, tmp_path):
    store.add(six.where("record_id in ('5', '7')"))
    archive.archive_store(store, str(tmp_path / "archive"), NOW, 1)
    assert store.get().count() == 2


def test_archived_rows(spark, records_of, tmp_path):
    rows = records_of(
        record("a", "2022-01-01T00:00:00.123456Z", "2022-01-01T00:00:01.999999Z"),
    )
    folder = str(tmp_path / "archive")
    archive.write_archive(rows, folder, NOW, 1)
    row = archive.read_archive(spark, folder).first()
    assert (row["meta"], row["components"], row["runtime"]) == ("null", "null", 1)
    assert row["start_time"].microsecond == 123000 and row["stop_time"].microsecond == 999000
    assert read_archived(spark, folder).first()["meta"] is None


def test_unreadable_text_becomes_null(spark):
    row = ("a", "{", "[", at("2022-01-01T00:00:00Z"), at("2022-01-01T00:00:00Z"), 0)
    from usageledger.schema import ARCHIVED

    decoded = archive.decode_archive(spark.createDataFrame([row], ARCHIVED)).first()
    assert decoded["meta"] is None and decoded["components"] is None


def test_mismatch_is_found(spark, records_of, tmp_path):
    rows = records_of(
        record("a", "2022-01-01T00:00:00Z", "2022-01-02T00:00:00Z"),
        record("b", "2022-01-01T00:00:00Z", "2022-01-03T00:00:00Z"),
    )
    folder = str(tmp_path / "archive")
    archive.write_archive(rows.where("record_id = 'a'"), folder, NOW, 1)
    wrong = archive.mismatches(rows, archive.read_archive(spark, folder)).collect()
    assert [(r["archived"], r["stored"]) for r in wrong] == [(1, 2)]


def _job(record_id, start, hours):
    begin = at(start)
    return (record_id, {"site": ["s"]}, [], begin, begin + timedelta(hours=hours))


def _scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stop_times_prune_months(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "many"))
    months = [_job(f"r-{m}", f"2023-{m:02d}-10T00:00:00Z", 2) for m in range(1, 13)]
    store.add(spark.createDataFrame(months, RECORD_ADD))
    late = store.get_stopped_since("2023-11-01T00:00:00Z")
    assert sorted(ids(late)) == ["r-11", "r-12"]
    june = store.stopped_between("2023-06-01T00:00:00Z", "2023-07-01T00:00:00Z")
    assert ids(june) == ["r-6"]
    for df in (late, june):
        assert "PartitionFilters: []" not in _scan_of(df) and "PartitionFilters: [" in _scan_of(df)
    # A correction widens the bounds of its month.
    update = spark.createDataFrame([("r-1", at("2023-12-24T00:00:00Z"))], "record_id string, stop_time timestamp")
    store.update(update, order_by="stop_time")
    assert sorted(ids(store.get_stopped_since("2023-12-01T00:00:00Z"))) == ["r-1", "r-12"]


def test_month_reports_prune_months(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "reports"))
    months = [_job(f"r-{m}", f"2023-{m:02d}-10T00:00:00Z", 2) for m in range(1, 13)]
    store.add(spark.createDataFrame(months, RECORD_ADD))
    start, end = month_bounds(2023, 6)
    config = utilization.UtilizationConfig(grouped_by="site", watts=1.0, co2_per_kwh=1.0)
    plan = _scan_of(utilization.report(store.stopped_between(start, end), config, 2023, 6))
    assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan


def test_months_do_not_depend_on_the_session_zone(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "zones"))
    added = spark.createDataFrame([_job("edge", "2023-12-31T23:30:00Z", 1)], RECORD_ADD)
    with settings(spark, spark__sql__session__timeZone="Europe/Berlin"):
        store.add(added)
        assert ids(store.get_started_since("2023-12-31T23:00:00Z")) == ["edge"]
    query = RecordQuery(start_time=Operator().gte("2023-12-31T00:00:00Z").lt("2023-12-31T23:59:00Z"))
    assert ids(store.advanced_query(query)) == ["edge"]
    assert store.stored().first()["start_month"] == "2023-12"


def test_a_batch_is_computed_once(spark, store, records_of):
    """For its checks, its records and its rejects."""
    seen = spark.sparkContext.accumulator(0)

    def count(record_id):
        seen.add(1)
        return record_id

    rows = records_of(*[record(str(n), "2022-06-27T15:00:00Z", None, {"k": [" " if n == 3 else "v"]}) for n in range(6)])
    added = to_added(rows.unionByName(rows.where("record_id = '1'"))).withColumn("record_id", F.udf(count)("record_id"))
    rejects = store.add(added, on_duplicate="skip", on_invalid="skip")
    assert [(r["record_id"], r["reasons"]) for r in rejects.collect()] == [("3", ["meta"])]
    assert sorted(ids(store.records())) == ["0", "1", "2", "4", "5"] and seen.value == 7


def test_update_lookup_returns_the_whole_store(spark, tmp_path):
    """Changed and unchanged records, each with the month that the lookup found."""
    rows = [(n, f"2024-0{n + 1}-05 10:00:00", n, "error" if n % 2 else "view", 10.0, '{"k": 3}') for n in range(4)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    ).write.parquet(f"{tmp_path}/events.parquet")
    found = {r["record_id"]: r for r in sinks.update_lookup(spark, str(tmp_path)).collect()}
    assert {key: (r["start_month"], r["runtime"]) for key, r in found.items()} == {
        "ev-0": ("2024-01", 10), "ev-1": ("2024-02", 90), "ev-2": ("2024-03", 10), "ev-3": ("2024-04", 90),
    }

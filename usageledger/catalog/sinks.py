"""Writes: the record store, the archive, report files.

Every query writes below a fresh scratch folder and returns what it reads back.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from usageledger.catalog.filters import FLAT, flat, summary_config
from usageledger.catalog.registry import query
from usageledger.catalog.reports import (
    GAUGES_SQL,
    KEYS,
    MONTH_SQL,
    REPORTED_SQL,
    SUMMARY_SQL,
    daily_sql,
    six,
    utilization_config,
)
from usageledger.catalog.tables import event_records, order_records, zoned
from usageledger.functions.records import component_amount, score_value
from usageledger.operators.query import Operator, RecordQuery, SortBy
from usageledger.operators.reshape import to_added
from usageledger.plans import apel, archive, metrics, utilization
from usageledger.plans.store import DuplicateRecords, RecordStore
from usageledger.session import scratch_path
from usageledger.sources.records import read_archived, read_json

NOW = datetime(1998, 6, 15, tzinfo=timezone.utc)
OLD = "stop_time < TIMESTAMP '1998-03-01'"


def added_events(spark, sf_dir):
    return to_added(zoned(event_records(spark, sf_dir)))


def _store(spark) -> RecordStore:
    return RecordStore(spark, scratch_path(spark, "store"))


def _event_store(spark, sf_dir) -> RecordStore:
    store = _store(spark)
    store.add(added_events(spark, sf_dir))
    return store


def _order_store(spark, sf_dir) -> RecordStore:
    store = _store(spark)
    store.add(to_added(zoned(order_records(spark, sf_dir))))
    return store


@query("k1_add", f"SELECT {FLAT} FROM ev")
def add(spark, sf_dir):
    return flat(_event_store(spark, sf_dir).records())


@query("k2_bulk_add_all_or_nothing", f"SELECT {FLAT} FROM ev WHERE site = 'site_1'")
def bulk_add(spark, sf_dir):
    store = _store(spark)
    everything = added_events(spark, sf_dir)
    store.add(everything.where(F.col("meta")["site"][0] == "site_1"))
    try:
        store.bulk_insert(everything)
    except DuplicateRecords:
        return flat(store.records())
    raise AssertionError("the second batch holds records that exist")


@query("k3_duplicates_skipped", f"SELECT {FLAT} FROM ev")
def duplicates_skipped(spark, sf_dir):
    store = _store(spark)
    everything = added_events(spark, sf_dir)
    store.add(everything.where(F.col("meta")["site"][0] == "site_1"))
    store.add(everything.unionByName(everything), on_duplicate="skip")
    return flat(store.records())


@query("k3_batch_ignored", f"SELECT {FLAT} FROM ev WHERE site = 'site_1'")
def batch_ignored(spark, sf_dir):
    store = _store(spark)
    everything = added_events(spark, sf_dir)
    store.add(everything.where(F.col("meta")["site"][0] == "site_1"))
    store.add(everything, on_duplicate="ignore_batch")
    return flat(store.records())


UPDATED_SQL = """SELECT record_id, site, group_id, user_id, start_time,
  coalesce(stop_time, start_time + INTERVAL 90 SECOND) AS stop_time, coalesce(runtime, 90) AS runtime FROM ev"""


def closing(records, seconds: int):
    """Updates that close the open records some seconds after their start."""
    is_open = records.where(F.col("stop_time").isNull())
    return is_open.select(
        "record_id",
        F.timestamp_add("SECOND", F.lit(seconds), F.col("start_time")).alias("stop_time"),
    )


@query("k4_update", UPDATED_SQL)
def update(spark, sf_dir):
    store = _event_store(spark, sf_dir)
    store.update(closing(added_events(spark, sf_dir), 90), order_by="stop_time")
    return flat(store.records())


@query(
    "k4_unknown_ids",
    "SELECT 'no-' || record_id AS record_id FROM ev WHERE stop_time IS NULL",
)
def unknown_ids(spark, sf_dir):
    store = _event_store(spark, sf_dir)
    updates = closing(added_events(spark, sf_dir), 90)
    renamed = updates.withColumn("record_id", F.concat(F.lit("no-"), "record_id"))
    return store.update(renamed, order_by="stop_time", on_unknown="return").select("record_id")


@query("w1_last_update_wins", UPDATED_SQL)
def last_update_wins(spark, sf_dir):
    store = _event_store(spark, sf_dir)
    records = added_events(spark, sf_dir)
    updates = (
        closing(records, 300).withColumn("seq", F.lit(1))
        .unionByName(closing(records, 90).withColumn("seq", F.lit(2)))
    )
    store.update(updates, order_by="seq")
    return flat(store.records())


def _changed_store(spark, sf_dir):
    """Events added in two segments, open records closed twice, and one site deleted: changes
    that are merged when they are read."""
    store = _store(spark)
    records = added_events(spark, sf_dir)
    is_first = F.col("meta")["site"][0] == "site_1"
    store.add(records.where(is_first))
    store.add(records.where(~is_first))
    store.update(closing(records, 300), order_by="stop_time")
    store.update(closing(records, 90), order_by="stop_time")
    store.delete(records.where(F.col("meta")["site"][0] == "site_3"))
    return store


CHANGED_SQL = f"SELECT * FROM ({UPDATED_SQL}) WHERE site <> 'site_3'"


@query("k4_changes_merged_on_read", CHANGED_SQL)
def changes_merged(spark, sf_dir):
    return flat(_changed_store(spark, sf_dir).records())


@query("k7_compacted", CHANGED_SQL)
def compacted(spark, sf_dir):
    store = _changed_store(spark, sf_dir)
    store.compact()
    store.vacuum()
    return flat(store.records())


@query("s2_stored_record", f"SELECT * FROM ({CHANGED_SQL}) WHERE record_id = 'ev-17'")
def stored_record(spark, sf_dir):
    return flat(_changed_store(spark, sf_dir).get_single_record("ev-17"))


@query(
    "f3_changed_store",
    f"""SELECT * FROM ({CHANGED_SQL}) WHERE stop_time >= TIMESTAMP '2024-01-10'
        AND stop_time < TIMESTAMP '2024-01-20' AND runtime >= 50""",
)
def filtered_store(spark, sf_dir):
    q = RecordQuery().with_runtime(Operator().gte(50))
    q = q.with_stop_time(Operator().gte("2024-01-10T00:00:00").lt("2024-01-20T00:00:00"))
    return flat(_changed_store(spark, sf_dir).advanced_query(q, ordered=False))


@query(
    "o2_ranked_store",
    f"SELECT *, row_number() OVER (ORDER BY runtime DESC NULLS FIRST, record_id) AS rank FROM ({CHANGED_SQL})",
)
def ranked_store(spark, sf_dir):
    q = RecordQuery().sort_by(SortBy().descending("runtime"))
    return flat(_changed_store(spark, sf_dir).ranked(q), "rank")


@query(
    "j11_update_lookup",
    f"SELECT *, strftime(start_time, '%Y-%m') AS start_month FROM ({UPDATED_SQL})",
)
def update_lookup(spark, sf_dir):
    """All records after updates found by id, half of whose ids are unknown: the changed
    ones as the preview says, the others as the store has them."""
    store = _event_store(spark, sf_dir)
    updates = closing(added_events(spark, sf_dir), 90)
    unknown = updates.withColumn("record_id", F.concat(F.lit("no-"), "record_id"))
    both = updates.unionByName(unknown)
    changed = store.preview_update(both, order_by="stop_time")
    store.update(both, order_by="stop_time", on_unknown="return")
    records = store.records()
    others = records.join(store.lookup(updates), "record_id", "left_anti")
    months = store.lookup(records.select("record_id").unionByName(unknown.select("record_id")))
    return flat(changed.unionByName(others).join(months, "record_id"), "start_month")


@query("j9_new_records", f"SELECT {FLAT} FROM ev WHERE site <> 'site_1'")
def new_records(spark, sf_dir):
    store = _store(spark)
    everything = added_events(spark, sf_dir)
    store.add(everything.where(F.col("meta")["site"][0] == "site_1"))
    fresh = store._new_records(everything)
    return flat(fresh.withColumn("runtime", F.timestamp_diff("SECOND", "start_time", "stop_time")))


# -- archive ------------------------------------------------------------------------------


def _archive(spark, sf_dir, compression: str) -> str:
    folder = scratch_path(spark, "archive")
    archive.write_archive(zoned(order_records(spark, sf_dir)), folder, NOW, 3, compression)
    return folder


def _archived(records):
    return records.select(
        "record_id",
        component_amount("F").alias("f"),
        F.round(score_value("O", "discount"), 6).alias("o"),
        "start_time",
        "stop_time",
        "runtime",
    )


ARCHIVED_SQL = f"""SELECT record_id,
  (SELECT max(amount) FROM comp WHERE l_orderkey = o_orderkey AND name = 'F') AS f,
  (SELECT round(max(discount), 6) FROM comp WHERE l_orderkey = o_orderkey AND name = 'O') AS o,
  start_time, stop_time, runtime FROM ord WHERE {OLD}"""


@query("k5_archive_gzip", ARCHIVED_SQL)
def archive_gzip(spark, sf_dir):
    return _archived(read_archived(spark, _archive(spark, sf_dir, "gzip")))


@query("s4_archive_source", ARCHIVED_SQL)
def archive_source(spark, sf_dir):
    return _archived(read_archived(spark, _archive(spark, sf_dir, "snappy")))


@query(
    "k6_archive_validation",
    f"""SELECT CAST(year(stop_time) AS INTEGER) AS year, CAST(month(stop_time) AS INTEGER) AS month,
        count(*) FILTER (site <> 'NATION_1') AS archived, count(*) AS stored
        FROM ord WHERE {OLD} GROUP BY 1, 2 HAVING count(*) FILTER (site <> 'NATION_1') <> count(*)""",
)
def archive_validation(spark, sf_dir):
    # An archive that misses the records of one site.
    records = zoned(order_records(spark, sf_dir))
    folder = scratch_path(spark, "archive")
    incomplete = records.where(F.col("meta")["site"][0] != "NATION_1")
    archive.write_archive(incomplete, folder, NOW, 3)
    old = archive.old_enough(records, NOW, 3)
    return archive.mismatches(old, archive.read_archive(spark, folder))


@query("k7_delete_archived", f"SELECT {FLAT} FROM ord WHERE {OLD} IS NOT TRUE")
def delete_archived(spark, sf_dir):
    store = _order_store(spark, sf_dir)
    archive.archive_store(store, scratch_path(spark, "archive"), NOW, 3)
    return flat(store.records())


@query(
    "k8_restore",
    f"""SELECT {FLAT} FROM ord WHERE {OLD} IS NOT TRUE
        OR stop_time >= TIMESTAMP '1996-05-01' AND stop_time < TIMESTAMP '1996-06-01'""",
)
def restore(spark, sf_dir):
    store = _order_store(spark, sf_dir)
    folder = scratch_path(spark, "archive")
    archive.archive_store(store, folder, NOW, 3)
    archive.restore(store, folder, [(1996, 5)])
    archive.restore(store, folder, [(1996, 5)], on_duplicate="skip", on_invalid="skip")
    return flat(store.records())


# -- files ----------------------------------------------------------------------------------


@query(
    "s3_json_records",
    f"SELECT {FLAT} FROM ev WHERE k % 10 NOT IN (0, 1)",
)
def json_records(spark, sf_dir):
    folder = scratch_path(spark, "json")
    records = zoned(event_records(spark, sf_dir))
    # Some objects lack a field, some have a negative amount.
    number = F.get_json_object("props", "$.k").cast("bigint") % 10
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("record_id"),
        number.alias("kind"),
    )
    broken = records.join(kinds, "record_id").select(
        F.when(F.col("kind") != 0, F.col("record_id")).alias("record_id"),
        "meta",
        F.transform(
            "components",
            lambda c: c.withField(
                "amount", F.when(F.col("kind") == 1, F.lit(-1)).otherwise(c["amount"])
            ),
        ).alias("components"),
        "start_time",
        "stop_time",
    )
    broken.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)
    valid, _ = read_json(spark, folder)
    return flat(valid.withColumn("runtime", F.timestamp_diff("SECOND", "start_time", "stop_time")))


@query("k9_summary_csv", f"WITH {daily_sql('group_id')} {MONTH_SQL}")
def summary_csv(spark, sf_dir):
    report = utilization.report(event_records(spark, sf_dir), utilization_config(), 2024, 1)
    folder = scratch_path(spark, "csv")
    target = utilization.write_csv(report, folder, "summary", "host", 2024, 1)
    schema = "user string, khs23h double, cpu_eff double, corehours double, power double, co2 double"
    stored = spark.read.option("header", True).schema(schema).csv(target)
    return stored.select(
        "user",
        *[six(name) for name in ("khs23h", "cpu_eff", "corehours")],
        six("power").alias("power_kwh"),
        six("co2").alias("co2_kg"),
    )


@query(
    "k10_message_text",
    f"""WITH {REPORTED_SQL}, sync AS (SELECT "Site", "SubmitHost", "Month", "Year", count(*) AS n
          FROM reported GROUP BY ALL),
        lines AS (
          SELECT 'APEL-sync-message: v0.1' AS value
          UNION ALL SELECT 'Site: ' || "Site" FROM sync UNION ALL SELECT 'SubmitHost: ' || "SubmitHost" FROM sync
          UNION ALL SELECT 'NumberOfJobs: ' || n FROM sync UNION ALL SELECT 'Month: ' || "Month" FROM sync
          UNION ALL SELECT 'Year: ' || "Year" FROM sync UNION ALL SELECT '%%' FROM sync)
        SELECT value FROM lines""",
)
def message_text(spark, sf_dir):
    config = summary_config()
    start, end = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 2, 1, tzinfo=timezone.utc)
    reported = apel.reportable(event_records(spark, sf_dir), config, start, end)
    folder = scratch_path(spark, "message")
    apel.write_message(apel.sync(reported, config), "sync", folder)
    return spark.read.text(folder)


@query("k11_gauge_table", GAUGES_SQL)
def gauge_table(spark, sf_dir):
    folder = scratch_path(spark, "gauges")
    metrics.write_gauges(metrics.record_gauges(event_records(spark, sf_dir), KEYS), folder)
    return spark.read.parquet(folder)


@query("t6_republish_month", f"WITH {REPORTED_SQL} {SUMMARY_SQL}")
def republish_month(spark, sf_dir):
    """Published early with part of the records, then again with all of them."""
    config = summary_config()
    folder = scratch_path(spark, "published")
    records = event_records(spark, sf_dir)
    early = records.where(F.col("start_time") < F.lit("2024-01-15").cast("timestamp_ntz"))
    apel.publish_month(early, config, 2024, 1, folder)
    apel.publish_month(records, config, 2024, 1, folder)
    stored = spark.read.parquet(folder)
    return stored.select(
        "Site", "Month", "Year", "VO", "SubmitHost", "Processors", "Infrastructure",
        *apel.SUMMED, "EarliestEndTime", "LatestEndTime",
    )


@query("api6_store_client", f"SELECT {FLAT} FROM ord WHERE start_time >= TIMESTAMP '1999-01-15'")
def store_client(spark, sf_dir):
    store = _order_store(spark, sf_dir)
    since = RecordQuery(start_time=Operator().gte("1999-01-15T00:00:00"))
    return flat(store.advanced_query(since, ordered=False))

"""The record store: segments that never change, a log of changes, and versions.

Records are added as a segment, partitioned by the month of the start.  The start of a
record never changes, so a record never moves to another partition.  A correction or a
deletion writes only itself, into the month of its record; both are merged when the
month is read, the newest version first, until ``compact`` writes the month again.  An
index of ids in hash buckets says what is there, so that neither an add nor a change
reads records.

Every change ends with a new version (``plans/manifest.py``); a job that dies leaves
the version before.  A DataFrame reads the version that was current when it was made.
One writer at a time is assumed; a second one fails before its version is published.

The version has the span of stop times of each month, so that a query on stop times
opens no other folders.  Months are those of UTC, whatever the session's time zone is.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usageledger.functions.records import runtime_seconds
from usageledger.operators.query import (
    Operator,
    RecordQuery,
    started_since,
    stopped_since,
    time_literal,
)
from usageledger.operators.reshape import to_record
from usageledger.operators.validity import split_checked, with_reasons
from usageledger.plans import id_index, manifest
from usageledger.plans.files import names_in, remove_folder
from usageledger.plans.manifest import (
    CORRECTIONS,
    DELETES,
    RECORDS,
    Entry,
    IndexSegment,
    Manifest,
    to_merge,
)
from usageledger.schema import (
    CORRECTED,
    DELETED,
    RECORD_ADD,
    RECORD_COLUMNS,
    STORED,
    STORED_SEGMENT,
    no_rows,
)
from usageledger.session import materialize, scratch_path

POLICIES = ("error", "ignore_batch", "skip")
#: Buckets of the id index of a new store.  When the whole index is written again they
#: are doubled until each has about ``IDS_PER_BUCKET`` ids.
BUCKETS = 16
IDS_PER_BUCKET = 1 << 20
MOST_BUCKETS = 1 << 16
_SCHEMAS = {RECORDS: STORED_SEGMENT, CORRECTIONS: CORRECTED, DELETES: DELETED}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class DuplicateRecords(ValueError):
    """Records of a batch are in the store already, or twice in the batch."""


class UnknownRecords(ValueError):
    """A correction names records the store does not have."""


class InvalidRecords(ValueError):
    """Records of a batch break the rules for names, amounts or values."""


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets

    # -- versions -----------------------------------------------------------

    def manifest(self, version: int | None = None) -> Manifest:
        if version is not None:
            return manifest.load(self.spark, self.path, version)
        return manifest.current(self.spark, self.path, self.buckets)

    def version(self) -> int:
        return self.manifest().version

    def exists(self) -> bool:
        return bool(self.manifest().months())

    # -- reading ------------------------------------------------------------

    def stored(self, version: int | None = None) -> DataFrame:
        return self._live(self.manifest(version))

    def records(self, version: int | None = None) -> DataFrame:
        return self.stored(version).select(*RECORD_COLUMNS)

    def advanced_query(self, query: RecordQuery, ordered: bool = True) -> DataFrame:
        return query.apply(self._matching(query), ordered)

    def ranked(self, query: RecordQuery) -> DataFrame:
        """All records of a query with their place in its order."""
        return query.rank(self._matching(query))

    def get(self) -> DataFrame:
        return self.advanced_query(RecordQuery())

    def get_started_since(self, since: Any) -> DataFrame:
        return self.advanced_query(started_since(since))

    def get_stopped_since(self, since: Any) -> DataFrame:
        return self.advanced_query(stopped_since(since))

    def stopped_between(self, start: Any, end: Any) -> DataFrame:
        """Records that stopped in [start, end), in no order: what a month report reads."""
        query = RecordQuery(stop_time=Operator().gte(start).lt(end))
        return self.advanced_query(query, ordered=False)

    def stopped_before(self, end: Any) -> DataFrame:
        """Closed records that stopped before a time, in no order: what an archive reads."""
        return self.advanced_query(RecordQuery(stop_time=Operator().lt(end)), ordered=False)

    def get_single_record(self, record_id: str) -> DataFrame:
        """At most one row; none for an unknown or a blank id."""
        return self.records().where(
            (F.col("record_id") == record_id) & F.lit(bool(record_id.strip()))
        )

    def _folders(self, kind: str, entries: list[Entry]) -> DataFrame:
        schema = _SCHEMAS[kind]
        if not entries:
            return no_rows(self.spark, schema)
        base = f"{self.path}/{kind}"
        folders = sorted({f"{base}/segment={e.segment}/start_month={e.month}" for e in entries})
        return self.spark.read.schema(schema).option("basePath", base).parquet(*folders)

    def _live(self, version: Manifest, months: set[str] | None = None) -> DataFrame:
        """The records of some months."""
        return self._live_in(version, version.of(RECORDS, months))

    def _live_in(self, version: Manifest, entries: list[Entry]) -> DataFrame:
        """The records of some folders.  Months without changes are a plain scan."""
        changed = version.changed_months()
        plain = [e for e in entries if e.month not in changed]
        merged = [e for e in entries if e.month in changed]
        parts = [self._folders(RECORDS, plain).select(*STORED.fieldNames())] if plain or not merged else []
        if merged:
            parts.append(self._merged(version, merged))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _merged(self, version: Manifest, entries: list[Entry]) -> DataFrame:
        """Records of changed months with the changes that came after them."""
        months = {e.month for e in entries}
        size = sum(e.rows for kind in (CORRECTIONS, DELETES) for e in version.of(kind, months))
        corrected = self._folders(CORRECTIONS, version.of(CORRECTIONS, months)).select(
            "record_id",
            F.col("segment").alias("corrected"),
            F.struct("stop_time", "updated_at").alias("new"),
            F.lit(None).cast("bigint").alias("deleted"),
        )
        deleted = self._folders(DELETES, version.of(DELETES, months)).select(
            "record_id",
            F.lit(None).cast("bigint").alias("corrected"),
            F.lit(None).cast(corrected.schema["new"].dataType).alias("new"),
            F.col("segment").alias("deleted"),
        )
        changes = (
            corrected.unionByName(deleted)
            .groupBy("record_id")
            .agg(
                F.max("corrected").alias("corrected"),
                F.max_by("new", "corrected").alias("new"),
                F.max("deleted").alias("deleted"),
            )
        )
        applies = F.coalesce(F.col("corrected") > F.col("segment"), F.lit(False))
        runtime = runtime_seconds("start_time", "stop_time")
        return (
            self._folders(RECORDS, entries)
            .join(id_index.by_size(changes, size), "record_id", "left")
            .where("deleted IS NULL OR deleted < segment")
            .withColumns(
                {
                    "stop_time": F.when(applies, F.col("new.stop_time")).otherwise(F.col("stop_time")),
                    "updated_at": F.when(applies, F.col("new.updated_at")).otherwise(F.col("updated_at")),
                    "_changed": applies,
                }
            )
            .withColumn("runtime", F.when(F.col("_changed"), runtime).otherwise(F.col("runtime")))
            .select(*STORED.fieldNames())
        )

    def _matching(self, query: RecordQuery) -> DataFrame:
        """The records of the months that a query's bounds leave."""
        version = self.manifest()
        months = _stop_months(version, query)
        records = self._live(version, months).where(month_condition(query))
        if len(months) < len(version.months()):
            records = records.where(F.col("start_month").isin(*months) if months else F.lit(False))
        return records

    # -- ids ------------------------------------------------------------------

    def index(self) -> DataFrame:
        version = self.manifest()
        return id_index.read(self.spark, self.path, list(version.index))

    def lookup(self, ids: DataFrame) -> DataFrame:
        """record_id and start_month of those of some ids that the store has.  Opens the
        index buckets of these ids, and no records."""
        return id_index.lookup(self.index(), ids, self.manifest().buckets)

    # -- adding -------------------------------------------------------------

    def add(
        self,
        added: DataFrame,
        on_duplicate: str = "error",
        on_invalid: str = "error",
        now: datetime | None = None,
    ) -> DataFrame:
        """Append records; returns the rejected ones with their reasons.

        ``on_duplicate``: ``error`` raises and writes nothing, ``ignore_batch``
        writes nothing, ``skip`` leaves out the records that exist and keeps
        one of several with the same id.  ``on_invalid``: ``error`` or ``skip``.
        """
        if on_duplicate not in POLICIES:
            raise ValueError(f"unknown policy {on_duplicate!r}; one of {POLICIES}")
        checked = with_reasons(added.select(*RECORD_ADD.fieldNames()))
        # The batch is read several times: for checks, mostly of its ids, to be written, and
        # for the rejects.
        folder = scratch_path(self.spark, "checked")
        try:
            checked.write.parquet(folder)
            batch, rejects = split_checked(self.spark.read.schema(checked.schema).parquet(folder))
            bad = [row["record_id"] for row in rejects.select("record_id").take(5)]
            if bad and on_invalid == "error":
                raise InvalidRecords(f"invalid records, for example {bad}")
            if on_duplicate == "skip":
                self._append(self._new_records(batch), now)
            else:
                collisions = [r["record_id"] for r in self._collisions(batch).take(5)]
                if collisions and on_duplicate == "error":
                    raise DuplicateRecords(f"records exist, for example {collisions}")
                if not collisions:
                    self._append(batch, now)
            return materialize(rejects, "rejects") if bad else no_rows(self.spark, rejects.schema)
        finally:
            remove_folder(self.spark, folder)

    def bulk_insert(self, added: DataFrame, on_duplicate: str = "error") -> DataFrame:
        return self.add(added, on_duplicate)

    def _collisions(self, batch: DataFrame) -> DataFrame:
        repeated = batch.groupBy("record_id").count().where("count > 1").select("record_id")
        if not self.manifest().index:
            return repeated
        return repeated.unionByName(self.lookup(batch).select("record_id"))

    def _new_records(self, batch: DataFrame) -> DataFrame:
        order = F.struct(
            "start_time",
            "stop_time",
            F.to_json("meta"),
            F.to_json("components"),
        )
        # Only ids that occur twice need whole rows to be compared.
        repeated = batch.groupBy("record_id").count().where("count > 1").select("record_id")
        number = repeated.count()
        once = batch
        if number:
            repeated = id_index.by_size(repeated, number)
            chosen = (
                batch.join(repeated, "record_id", "left_semi")
                .groupBy("record_id")
                .agg(F.min_by(F.struct(*batch.columns), order).alias("kept"))
                .select("kept.*")
            )
            once = batch.join(repeated, "record_id", "left_anti").unionByName(chosen)
        return once.join(self.lookup(batch), "record_id", "left_anti") if self.manifest().index else once

    def _append(self, added: DataFrame, now: datetime | None) -> None:
        version = self.manifest()
        segment = version.version + 1
        records = to_record(added).withColumn("updated_at", _clock(now))
        self._write_records(with_month(records), segment)
        # Counts, spans and the index come from what is there now, from narrow columns.
        written = self._segment(RECORDS, segment)
        entries = _entries(RECORDS, segment, written)
        if not entries:
            return
        rows = written.select("record_id", "start_month", F.lit(True).alias("live"), F.lit(segment).alias("since"))
        self._publish(version, entries, rows)
        self._merge_segments()

    def _merge_segments(self) -> None:
        """Where a month has many segments of similar size, write the newest as one, with
        the changes that came after them.  A record is written again only when its
        segment has at least doubled; older segments stay as they are."""
        version = self.manifest()
        chosen: list[Entry] = []
        for month in version.months():
            entries = sorted(version.of(RECORDS, {month}), key=lambda e: e.segment)
            chosen += entries[len(entries) - to_merge(entries) :]
        if chosen:
            self._replace(version, chosen, [e for e in version.entries if e not in set(chosen)])

    def _replace(self, version: Manifest, chosen: list[Entry], others: list[Entry]) -> Manifest:
        """Write some folders of records as one segment, in place of these folders."""
        segment = version.version + 1
        self._write_records(self._live_in(version, chosen), segment)
        new = _entries(RECORDS, segment, self._segment(RECORDS, segment))
        following = version.following(entries=(*others, *new))
        manifest.publish(self.spark, self.path, following)
        return following

    def _segment(self, kind: str, segment: int) -> DataFrame:
        folder = f"{self.path}/{kind}/segment={segment}"
        if not any("=" in name for name in names_in(self.spark, folder)):
            return no_rows(self.spark, _SCHEMAS[kind])
        return self.spark.read.schema(_SCHEMAS[kind]).option("basePath", f"{self.path}/{kind}").parquet(folder)

    def _write_records(self, records: DataFrame, segment: int) -> None:
        write_months(records, f"{self.path}/{RECORDS}/segment={segment}")

    def _publish(self, version: Manifest, entries: list[Entry], ids: DataFrame | None) -> None:
        """Index some ids, and make the new folders part of the store."""
        segment, index = version.version + 1, version.index
        if ids is not None:
            id_index.write(ids, self.path, segment, version.buckets)
            index = (*index, IndexSegment(segment, sum(e.rows for e in entries)))
        new = version.following(entries=(*version.entries, *entries), index=index)
        manifest.publish(self.spark, self.path, new)
        merged = to_merge(new.index)
        if merged:
            self._merge_index(new, merged)

    def _merge_index(self, version: Manifest, count: int) -> None:
        """Write the newest ``count`` segments of the index as one.  Where no older segment
        is left, ids that are gone are forgotten, and there may be more buckets."""
        older, merged = version.index[: len(version.index) - count], version.index[len(version.index) - count :]
        rows = id_index.newest(id_index.read(self.spark, self.path, list(merged)))
        segment, buckets = version.version + 1, version.buckets
        size = sum(s.rows for s in merged)
        while not older and buckets * IDS_PER_BUCKET < size and buckets < MOST_BUCKETS:
            buckets *= 2
        id_index.write(rows if older else rows.where("live"), self.path, segment, buckets)
        new = version.following(index=(*older, IndexSegment(segment, size)), buckets=buckets)
        manifest.publish(self.spark, self.path, new)

    # -- correcting ---------------------------------------------------------

    def update(
        self,
        updates: DataFrame,
        order_by: str,
        on_unknown: str = "error",
        now: datetime | None = None,
    ) -> DataFrame:
        """Set stop times; of several for one record the last by ``order_by``
        counts.  Unknown ids raise, or are returned with ``on_unknown='return'``.
        Writes the new stop times and no record."""
        version = self.manifest()
        # Used for the checks, to be written, and by the caller.
        judged = materialize(self._judged(updates, order_by), "updates")
        unknown = judged.where("start_month IS NULL").select("record_id", "stop_time")
        if on_unknown == "error":
            missing = [row["record_id"] for row in unknown.take(5)]
            if missing:
                raise UnknownRecords(f"unknown records, for example {missing}")
        segment = version.version + 1
        # A correction without a stop time changes nothing.
        known = judged.where("start_month IS NOT NULL AND stop_time IS NOT NULL")
        known = known.withColumn("updated_at", _clock(now))
        self._write_changes(CORRECTIONS, known, segment)
        entries = _entries(CORRECTIONS, segment, self._segment(CORRECTIONS, segment))
        if entries:
            self._publish(version, entries, None)
        return unknown

    def _judged(self, updates: DataFrame, order_by: str) -> DataFrame:
        """The last update of each id, with the month of its record, null if unknown."""
        latest = updates.groupBy("record_id").agg(F.max_by("stop_time", order_by).alias("stop_time"))
        latest = latest.withColumn("stop_time", F.col("stop_time").cast("timestamp"))
        return latest.join(self.lookup(latest), "record_id", "left")

    def preview_update(self, updates: DataFrame, order_by: str) -> DataFrame:
        """The records that ``update`` would change, with their new stop time and runtime.
        Reads the months of these records only."""
        judged = materialize(self._judged(updates, order_by).where("start_month IS NOT NULL"), "updates")
        months = {row["start_month"]: row["count"] for row in judged.groupBy("start_month").count().collect()}
        new = id_index.by_size(
            judged.select("record_id", F.col("stop_time").alias("new_stop")), sum(months.values())
        )
        records = self._live(self.manifest(), set(months)).join(new, "record_id")
        changed = records.withColumn("stop_time", F.coalesce("new_stop", "stop_time"))
        return changed.withColumn("runtime", runtime_seconds("start_time", "stop_time")).select(*RECORD_COLUMNS)

    def _write_changes(self, kind: str, rows: DataFrame, segment: int) -> None:
        columns = [f.name for f in _SCHEMAS[kind] if f.name != "segment"]
        (
            rows.select(*columns)
            .hint("rebalance", "start_month")
            .write.mode("overwrite")
            .partitionBy("start_month")
            .parquet(f"{self.path}/{kind}/segment={segment}")
        )

    # -- deleting -----------------------------------------------------------

    def delete(self, ids: DataFrame) -> None:
        """Remove the records with these ids; ids that are not there have no effect.
        Writes the ids and no record; ``compact`` drops what is gone."""
        version = self.manifest()
        gone = materialize(self.lookup(ids.select("record_id").distinct()), "deleted")
        segment = version.version + 1
        self._write_changes(DELETES, gone, segment)
        entries = _entries(DELETES, segment, self._segment(DELETES, segment))
        if entries:
            rows = gone.select("record_id", "start_month", F.lit(False).alias("live"), F.lit(segment).alias("since"))
            self._publish(version, entries, rows)

    # -- compaction -----------------------------------------------------------

    def compact(self, months: set[str] | None = None) -> None:
        """Write months as one segment each: those given, else all that have changes or
        several segments.  Afterwards the index is one segment whose buckets have about
        ``IDS_PER_BUCKET`` ids.  Old folders stay until ``vacuum``."""
        version = self.manifest()
        if months is None:
            several = [e.month for e in version.of(RECORDS)]
            months = version.changed_months() | {m for m in several if several.count(m) > 1}
        months = months & version.months()
        if months:
            others = [e for e in version.entries if e.month not in months]
            version = self._replace(version, version.of(RECORDS, months), others)
        if len(version.index) > 1:
            self._merge_index(version, len(version.index))

    def vacuum(self) -> None:
        """Remove folders and versions that the current version does not need.  Readers of
        older versions have to be done."""
        version = self.manifest()
        needed = {(e.kind, e.segment, e.month) for e in version.entries}
        for kind in _SCHEMAS:
            for name in names_in(self.spark, f"{self.path}/{kind}"):
                segment = int(name.split("=")[1])
                used = {month for k, s, month in needed if (k, s) == (kind, segment)}
                folder = f"{self.path}/{kind}/{name}"
                if not used:
                    remove_folder(self.spark, folder)
                    continue
                for inner in names_in(self.spark, folder):
                    if "=" in inner and inner.split("=")[1] not in used:
                        remove_folder(self.spark, f"{folder}/{inner}")
        segments = {f"segment={s.segment}" for s in version.index}
        for name in names_in(self.spark, f"{self.path}/ids"):
            if name not in segments:
                remove_folder(self.spark, f"{self.path}/ids/{name}")
        for name in names_in(self.spark, f"{self.path}/versions"):
            if name.endswith(".json") and name != f"{version.version:012d}.json":
                remove_folder(self.spark, f"{self.path}/versions/{name}")


def _entries(kind: str, segment: int, rows: DataFrame) -> list[Entry]:
    """Rows and span of stop times of each month of a segment; one row a month comes to
    the driver."""
    stop = F.col("stop_time") if "stop_time" in rows.columns else F.lit(None).cast("timestamp")
    found = rows.groupBy("start_month").agg(
        F.count("*").alias("rows"), F.unix_micros(F.min(stop)).alias("first"), F.unix_micros(F.max(stop)).alias("last")
    )
    return [Entry(kind, segment, r["start_month"], r["rows"], r["first"], r["last"]) for r in found.collect()]


def _micros(value: Any) -> int:
    """Microseconds of a time (datetime or ISO text, naive = UTC)."""
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return (moment - _EPOCH) // timedelta(microseconds=1)


def _stop_months(version: Manifest, query: RecordQuery) -> set[str]:
    """The months that may hold what a condition on the stop time asks for."""
    months = version.months()
    if query.stop_time is None:
        return months
    bounds = query.stop_time.effective(on_time=True, strict=query.strict)
    if not bounds:
        return months

    def inside(span: tuple[int, int] | None) -> bool:
        return span is not None and all(
            span[1] >= _micros(value) if name in ("gt", "gte") else span[0] <= _micros(value)
            for name, value in bounds.items()
        )

    return {month for month, span in version.stop_spans().items() if inside(span)}


def utc_month(moment: Column) -> Column:
    """``yyyy-MM`` in UTC, in a session of any time zone."""
    day = F.floor(F.unix_seconds(moment.cast("timestamp")) / 86_400).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM")


def with_month(records: DataFrame) -> DataFrame:
    return records.withColumn("start_month", utc_month(F.col("start_time")))


def write_months(records: DataFrame, path: str) -> None:
    """Write month partitions.

    Large months are split and small ones merged by their size at run time;
    rows are sorted by stop time inside a file, so reports over stop times skip
    row groups, and a Bloom filter serves lookups by id.
    """
    (
        records.select(*STORED.fieldNames())
        .hint("rebalance", "start_month")
        .sortWithinPartitions("start_month", "stop_time")
        .write.mode("overwrite")
        .partitionBy("start_month")
        .option("parquet.bloom.filter.enabled#record_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(path)
    )


def month_condition(query: RecordQuery) -> Column:
    """What a condition on the start time says about the month partitions."""
    condition = F.lit(True)
    if query.start_time is None:
        return condition
    bounds = query.start_time.effective(on_time=True, strict=query.strict)
    for name, value in bounds.items():
        month = utc_month(time_literal(value, T.TimestampType()))
        column = F.col("start_month")
        condition &= column >= month if name in ("gt", "gte") else column <= month
    return condition


def one_record(records: DataFrame, record_id: str) -> DataFrame:
    if not record_id.strip():
        return records.limit(0)
    return RecordQuery(record_id=record_id).apply(records, ordered=False)


def _clock(now: datetime | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return time_literal(now.astimezone(timezone.utc), RECORD_ADD["start_time"].dataType)

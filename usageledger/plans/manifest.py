"""Versions of a record store: which folders belong to it, and what they cover.

Every change writes new folders and then a new version, a small JSON file that lists
all folders with the month, the number of rows and the span of stop times of each.
One pointer file names the current version and is replaced last, so a reader has the
version before or the one after, and folders of a job that died belong to none.

The list has one line for each segment and month and is read by the driver; compaction
keeps it short.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import SparkSession

from usageledger.plans.files import read_text, replace_text

#: Segments of similar size that are merged to one.
MERGED = 8

RECORDS, CORRECTIONS, DELETES = "records", "corrections", "deletes"


class ConcurrentWrite(RuntimeError):
    """Somebody else has changed the store since this change began."""


@dataclass(frozen=True)
class Entry:
    """One month of one segment; stop times in microseconds, None without any."""

    kind: str
    segment: int
    month: str
    rows: int
    first: int | None = None
    last: int | None = None


@dataclass(frozen=True)
class IndexSegment:
    segment: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    entries: tuple[Entry, ...] = ()
    index: tuple[IndexSegment, ...] = ()

    def of(self, kind: str, months: Iterable[str] | None = None) -> list[Entry]:
        wanted = None if months is None else set(months)
        return [e for e in self.entries if e.kind == kind and (wanted is None or e.month in wanted)]

    def months(self) -> set[str]:
        return {e.month for e in self.entries if e.kind == RECORDS}

    def changed_months(self) -> set[str]:
        """Months in which records have been corrected or deleted since they were written."""
        return {e.month for e in self.entries if e.kind != RECORDS}

    def stop_spans(self) -> dict[str, tuple[int, int] | None]:
        """First and last stop time of each month, corrections included."""
        spans: dict[str, tuple[int, int] | None] = dict.fromkeys(self.months())
        for e in self.entries:
            if e.kind == DELETES or e.first is None or e.month not in spans:
                continue
            known = spans[e.month]
            spans[e.month] = (e.first, e.last) if known is None else (min(known[0], e.first), max(known[1], e.last))
        return spans

    def following(self, **changes) -> Manifest:
        return replace(self, version=self.version + 1, **changes)


def to_merge(segments: Sequence[IndexSegment | Entry]) -> int:
    """How many of the newest segments to merge: those whose sizes are similar, if they
    are many."""
    total, count = 0, 0
    for segment in reversed(segments):
        if count and segment.rows > 2 * total:
            break
        total, count = total + segment.rows, count + 1
    return count if count >= MERGED else 0


def _folder(path: str) -> str:
    return f"{path}/versions"


def current(spark: SparkSession, path: str, buckets: int) -> Manifest:
    """The current version; a store that is not there yet has version 0."""
    pointer = read_text(spark, f"{_folder(path)}/current")
    return Manifest(0, buckets) if pointer is None else load(spark, path, int(pointer))


def load(spark: SparkSession, path: str, version: int) -> Manifest:
    text = read_text(spark, f"{_folder(path)}/{version:012d}.json")
    if text is None:
        raise ValueError(f"{path} has no version {version}")
    content = json.loads(text)
    return Manifest(
        content["version"],
        content["buckets"],
        tuple(Entry(**entry) for entry in content["entries"]),
        tuple(IndexSegment(**segment) for segment in content["index"]),
    )


def write(spark: SparkSession, path: str, manifest: Manifest) -> None:
    replace_text(spark, f"{_folder(path)}/{manifest.version:012d}.json", json.dumps(asdict(manifest)))


def point_to(spark: SparkSession, path: str, version: int) -> None:
    replace_text(spark, f"{_folder(path)}/current", str(version))


def publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make a version the current one; it has to follow the current one."""
    if current(spark, path, manifest.buckets).version != manifest.version - 1:
        raise ConcurrentWrite(f"{path} has changed since version {manifest.version - 1}")
    write(spark, path, manifest)
    point_to(spark, path, manifest.version)

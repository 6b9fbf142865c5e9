"""Named queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from usageledger.catalog.tables import EVENTS_SQL, ORDERS_SQL, plain_times
from usageledger.session import prepare

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query.  Its SQL may use the tables ``ev`` (records of events),
    ``ord`` (records of orders) and ``comp`` (components of orders)."""

    def register(run: Run) -> Run:
        if name in ENTRIES:
            raise ValueError(f"query {name!r} is registered twice")

        def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_times(run(prepare(spark), sf_dir))

        ENTRIES[name] = Entry(checked, None if sql is None else _complete(sql))
        return run

    return register


def _complete(sql: str) -> str:
    """Put the shared table expressions in front of a query that uses them."""
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    parts = []
    if "ev" in words:
        parts.append(EVENTS_SQL)
    if words & {"ord", "comp", "flag"}:
        parts.append(ORDERS_SQL)
    if not parts:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",".join(parts) + ",\n" + body[5:]
    return "WITH " + ",".join(parts) + "\n" + body

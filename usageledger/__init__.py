"""Resource-accounting analytics on Spark.

Usage records (who ran what, where, for how long, with which resources) are
DataFrames with one nested schema.  The packages are

* ``sources``    scheduler dumps, archives and generators -> records
* ``functions``  column expressions over records and scheduler text
* ``operators``  filters, access rules, validity, configured fields, reshaping
* ``plans``      the record store, the monthly archive and the reports
* ``streaming``  incremental ingest, enrichment backlog, continuous counts
* ``catalog``    every operator as a query over the test tables, with its SQL
"""

from usageledger.operators.query import (
    ComponentQuery,
    MetaOperator,
    MetaQuery,
    Operator,
    RecordQuery,
    SortBy,
    authorize,
)
from usageledger.plans.store import DuplicateRecords, RecordStore, UnknownRecords
from usageledger.session import build_session

__all__ = [
    "ComponentQuery",
    "DuplicateRecords",
    "MetaOperator",
    "MetaQuery",
    "Operator",
    "RecordQuery",
    "RecordStore",
    "SortBy",
    "UnknownRecords",
    "authorize",
    "build_session",
]

import os
import sys
from datetime import datetime, timezone

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from usageledger.schema import RECORD  # noqa: E402
from usageledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
        spark__sql__maxMetadataStringLength="5000",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("scratch")),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def at(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)


def component(name, amount, **scores):
    return (name, amount, list(scores.items()))


def record(record_id, start=None, stop=None, meta=None, components=None):
    start = at(start) if start else None
    stop = at(stop) if stop else None
    runtime = int((stop - start).total_seconds()) if start and stop else None
    return (record_id, meta, components, start, stop, runtime)


@pytest.fixture(scope="session")
def records_of(spark):
    def build(*rows):
        return spark.createDataFrame(list(rows), RECORD)

    return build


def ids(df):
    return [row["record_id"] for row in df.collect()]

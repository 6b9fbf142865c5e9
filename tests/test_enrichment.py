import random

import pytest
from conftest import at

from usageledger.operators.intervals import counter_increase
from usageledger.plans import enrichment
from usageledger.schema import RECORD_ADD

START, STOP = at("2024-01-01T00:00:00Z"), at("2024-01-01T01:00:00Z")


def pod(record_id, name, components=(), stop=STOP, namespaces=("ns",)):
    meta = {"namespace": list(namespaces), "podname": [name]}
    return (record_id, meta, list(components), START, stop)


def sample(name, minute, value, metric=enrichment.CPU_METRIC, series="s"):
    from datetime import timedelta

    return ("ns", name, series, metric, START + timedelta(minutes=minute), float(value))


@pytest.fixture(scope="module")
def samples(spark):
    memory = enrichment.MEMORY_METRIC
    rows = [
        sample("full", 1, 10), sample("full", 2, 25), sample("full", 3, 5), sample("full", 4, 9),
        sample("full", 5, 1, series="t"), sample("full", 50, 2.5, series="t"),
        sample("full", -10, 1000), sample("full", 70, 9000),
        sample("full", 1, 100, memory), sample("full", 2, 122986495.6, memory),
        sample("full", 3, 10, memory, "t"),
        sample("cpu", 1, 1), sample("cpu", 2, 2),
        sample("memory", 1, 7, memory),
        sample("single", 1, 7), sample("single", 1, 7, memory),
    ]
    return spark.createDataFrame(rows, enrichment.SAMPLES)


@pytest.fixture
def queue(spark):
    def build(*pods):
        return enrichment.enqueue(spark.createDataFrame(list(pods), RECORD_ADD))

    return build


def state(df):
    return {
        r["rid"]: (
            {c["name"]: c["amount"] for c in r["record"]["components"]}, r["retry"], r["complete"]
        )
        for r in df.collect()
    }


def test_one_attempt(queue, samples):
    given = queue(
        pod("r-full", "full"), pod("r-cpu", "cpu"), pod("r-memory", "memory"), pod("r-none", "zzz"),
        pod("r-single", "single"), pod("r-half", "memory", [("cpu", 3, [])]),
        pod("r-open", "full", stop=None), pod("r-two", "full", namespaces=("ns", "other")),
    )
    after = enrichment.merge_step(given, samples, now=1000, max_retries=2, interval=60)
    assert state(after) == {
        # Counter: 15, then a reset to 5, then 4; the other series 1.5: 25.5 -> 26.
        "r-full": ({"cpu": 26, "memory": 122986506}, 0, True),
        "r-cpu": ({"cpu": 1}, 1, False),
        # No memory without CPU.
        "r-memory": ({}, 1, False),
        "r-none": ({}, 1, False),
        # One sample has no increase.
        "r-single": ({}, 1, False),
        "r-half": ({"cpu": 3, "memory": 7}, 0, True),
        # Malformed entries stay.
        "r-open": ({}, 0, False),
        "r-two": ({}, 0, False),
    }


def test_retries_and_giving_up(queue, samples):
    now, step = queue(pod("r-cpu", "cpu"), pod("r-full", "full")), enrichment.merge_step
    now = step(now, samples, 1000, 1, 60)
    assert [r["record_id"] for r in enrichment.emitted(now, 1).collect()] == ["r-full"]
    now = enrichment.remaining(now, 1)
    assert state(step(now, samples, 1059, 1, 60)) == state(now), "too early"
    assert state(step(now, samples, 2000, 1, 60, reachable=False)) == state(now)
    now = step(now, samples, 1060, 1, 60)
    assert state(now) == {"r-cpu": ({"cpu": 1}, 2, False)}
    assert [r["record_id"] for r in enrichment.emitted(now, 1).collect()] == ["r-cpu"]
    assert enrichment.remaining(now, 1).count() == 0


@pytest.mark.parametrize("piece_seconds", [1, 7, 60, 100000])
def test_increase_does_not_depend_on_the_pieces(spark, piece_seconds):
    random.seed(5)
    rows, expected = [], {}
    for series in "abc":
        before = None
        for second in sorted(random.sample(range(500), 120)):
            value = float(random.randint(0, 9))
            rows += [("r", series, second * 1_000_000, value)] * random.choice((1, 1, 3))
            if before is not None:
                step = value if value < before else value - before
                expected[series] = expected.get(series, 0.0) + step
            before = value
    points = spark.createDataFrame(rows, "record_id string, series string, at long, value double")
    found = counter_increase(points, piece_seconds).collect()
    assert {r["series"]: r["increase"] for r in found} == pytest.approx(expected)

"""Joins: time buckets, configured sites, patterns as labels, nested records, marks."""

import random
import re

import pytest
from conftest import at, component, record
from pyspark.sql import functions as F

from usageledger.operators import reshape
from usageledger.operators.intervals import samples_within
from usageledger.operators.lookup import assign_report_sites
from usageledger.plans.label_match import matching_labels
from usageledger.plans.store import RecordStore
from usageledger.sources import htcondor
from usageledger.streaming import ingest

SPANS = "record_id string, namespace string, pod string, start_time timestamp, stop_time timestamp"
SAMPLES = "namespace string, pod string, metric string, series string, ts timestamp, value double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def timed(spark):
    rng = random.Random(2)
    base = 1_700_000_000
    spans, samples = [], []
    for k in range(60):
        start = base + rng.randrange(40_000)
        stop = None if k % 11 == 0 else start + rng.choice([0, 1, 59, 3600, 7200, 20_000])
        spans.append((f"r{k}", "n", "hot" if k % 3 else f"p{k}", start, stop))
    for k in range(3000):
        samples.append(("n", "hot" if k % 2 else f"p{k % 60}", "m", "s", base - 10_000 + rng.randrange(90_000), float(k)))
    return spans, samples


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_samples_meet_spans_in_time_buckets(spark, tmp_path, timed, kind):
    spans, samples = timed
    table = spark.createDataFrame(
        [(r, n, p, a, b) for r, n, p, a, b in spans], "record_id string, namespace string, pod string, a long, b long"
    ).selectExpr("record_id", "namespace", "pod", "timestamp_seconds(a) start_time", "timestamp_seconds(b) stop_time")
    spark.createDataFrame(samples, SAMPLES.replace("ts timestamp", "ts long")).withColumn(
        "ts", F.timestamp_seconds("ts").cast(kind)
    ).write.parquet(str(tmp_path / kind))
    stored = spark.read.parquet(str(tmp_path / kind))
    found = samples_within(table, stored)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan_of(found))
    expected = sorted(
        (r, value)
        for r, n, p, a, b in spans
        if b is not None
        for n2, p2, _, _, t, value in samples
        if (n, p) == (n2, p2) and b - (b - a + 1) <= t <= b
    )
    assert sorted((r["record_id"], r["value"]) for r in found.collect()) == expected
    # A hot pod has as many keys as hours.
    assert re.search(r"Join \[namespace[^\]]*bucket", plan_of(found))


def test_no_spans_read_no_samples(spark):
    spans = spark.createDataFrame([("r", "n", "p", at("2024-01-01T00:00:00Z"), None)], SPANS)
    samples = spark.createDataFrame([("n", "p", "m", "s", at("2024-01-01T00:00:00Z"), 1.0)], SAMPLES)
    assert samples_within(spans, samples).count() == 0


@pytest.mark.parametrize("count", [90, 1000])
def test_many_configured_sites(spark, records_of, count):
    """9,000 ids, as a literal, and 100,000 as a table; equal rows stay apart."""
    sites = {f"S{k}": [f"id{k}-{j}" for j in range(100)] for k in range(count)}
    sites["both"] = ["id1-1", "id2-2"]
    rows = records_of(
        record("a", "2024-01-01T00:00:00Z", None, {"site": ["id5-7", "id5-8", "nowhere"]}),
        record("a", "2024-01-01T00:00:00Z", None, {"site": ["id5-7", "id5-8", "nowhere"]}),
        record("b", "2024-01-01T00:00:00Z", None, {"site": ["id1-1"], "other": ["id2-2", "id89-99"]}),
        record("c", "2024-01-01T00:00:00Z", None, {"site": ["nowhere"]}),
        record(None, "2024-01-01T00:00:00Z", None, {"site": ["id0-0"]}),
        record("d", "2024-01-01T00:00:00Z", None, None),
    )
    found = assign_report_sites(rows, sites, ["site", "other"])
    pairs = sorted((str(r["record_id"]), r["report_site"]) for r in found.collect())
    assert pairs == [("None", "S0"), ("a", "S5"), ("a", "S5"), ("b", "S1"), ("b", "S2"), ("b", "S89"), ("b", "both")]
    assert found.columns == [*rows.columns, "report_site"]
    with pytest.raises(Exception, match="reported twice for site S5: a"):
        assign_report_sites(rows, sites, ["site"], check_duplicates=True).collect()
    single = rows.where("record_id IN ('c', 'd')")
    assert assign_report_sites(single, sites, ["site"], True).count() == 0
    assert ("Exchange" in plan_of(found)) == (count == 1000)


def test_patterns_as_labels(spark):
    """Every pattern against every value of its day, as a regular expression would find it."""
    values = ["cms", "cms-prod", "atlas", "atlas.prod", "a", "", "u17", "u170", "x[y]", "zz", "(tag)", "A-B_C", "aXXb", "tab\tz"]
    patterns = [
        "^cms", "cms-?prod$", "atl.s", "atlas\\.prod", "(cms|atlas)", "cms|u17", "u1[0-9]+", "u\\d+", "x\\[y\\]", "z{2}",
        "zz?", "z*", ".*", "at(la)+s", "aX+b", "a(?:X)+b", "(?i)CMS", "[]a]z", "\\(tag\\)", "A.B_C", "a?tlas", "prod|",
        "((at)l)as", "\\Qcms\\E", "\\x63ms", "[a-c]ms", "ta[b]\\tz", "no.match", "cm{1,2}s-prod", "[^c]ms",
    ]
    usable = [p for p in patterns if p not in ("[]a]z", "\\Qcms\\E")]
    rows = [("d1", v) for v in values + patterns if v != "[]a]z"] + [("d2", "cms"), ("d2", "atl.s"), (None, "q"), ("d2", None)]
    table = spark.createDataFrame(rows + rows[:5], "day string, value string")
    found = {tuple(r) for r in matching_labels(table, "day", "value").collect()}
    special = re.compile(r"[\\.^$|?*+()\[\]{}]")
    everything = {v for d, v in rows if d == "d1"}
    for label in everything - {"\\Qcms\\E"}:
        test = re.compile(label).search if special.search(label) else lambda v, label=label: label in v
        assert {v for d, l, v in found if d == "d1" and l == label} == {v for v in everything if test(v)}, label
    assert {v for d, l, v in found if l == "\\Qcms\\E"} == {v for v in everything if "cms" in v}
    assert {(l, v) for d, l, v in found if d == "d2"} == {("cms", "cms"), ("atl.s", "atl.s")}
    assert len(usable) > 20 and matching_labels(table, "day", "value").count() == len(found)


@pytest.fixture(scope="module")
def nested(records_of):
    rows = [
        record(f"r{k}", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z",
               {"site": [f"s{k % 3}"], "user": ["b", "a"]} if k % 5 else None,
               [component("cpu", k, hs=1.5, same=2.0), component("mem", 2 * k)][: k % 3] or None)
        for k in range(40)
    ]
    return records_of(*rows)


def test_nested_records_have_one_exchange_by_record(spark, nested):
    tables = reshape.to_flat_tables(nested)
    tables = {name: spark.createDataFrame(df.collect(), df.schema) for name, df in tables.items()}
    back = reshape.from_flat_tables(tables)
    plan = plan_of(back)
    assert plan.count("hashpartitioning(record_id") == 1 and plan.count("hashpartitioning(component_id") == 1
    assert plan.count("Exchange hashpartitioning") == 2
    assert sorted(map(str, back.select("record_id", "components").collect())) == sorted(
        map(str, nested.select("record_id", "components").collect())
    )
    meta = {r["record_id"]: r["meta"] for r in back.collect()}
    assert meta["r1"] == {"site": ["s1"], "user": ["a", "b"]} and meta["r0"] is None
    # Ids that only other tables have are no records; accounting rows stay as often as they are.
    more = tables | {"accounting": tables["accounting"].unionByName(tables["accounting"].where("record_id = 'r1'"))}
    more["meta"] = more["meta"].unionByName(spark.createDataFrame([("zz", "k", "v")], more["meta"].schema))
    assert reshape.from_flat_tables(more).count() == 41


def test_salted_scores(spark, nested):
    tables = reshape.to_flat_tables(nested)
    joined = [
        sorted(map(str, reshape.scored_links(tables["components_scores"], tables["scores"], rows).collect()))
        for rows in (1000, 0)
    ]
    assert joined[0] == joined[1] and len(joined[0]) > 20


CONFIG = htcondor.CondorConfig(
    class_ads=("GlobalJobId", "ClusterId", "ProcId", "LastMatchTime", "CompletionDate", "JobStatus"), meta={}, components=()
)


def test_history_that_is_read_again(spark, tmp_path, monkeypatch):
    """Batches take the jobs behind the marks; the marks and their versions stay few."""
    drops, marks_path = str(tmp_path / "drops"), str(tmp_path / "marks")
    store = RecordStore(spark, str(tmp_path / "store"))
    sizes = []
    add = store.add
    monkeypatch.setattr(store, "add", lambda records, **rest: (sizes.append(records.count()), add(records, **rest))[1])

    def drop(first, last):
        lines = [
            (f"s#{k}.0#{1_700_000_000 + k} , {k} , 0 , {1_700_000_000 + k} , {1_700_000_100 + k} , 4", f"schedd{k % 2}")
            for k in range(first, last)
        ]
        spark.createDataFrame(lines, "value string, schedd string").coalesce(1).write.mode("append").partitionBy("schedd").text(drops)
        stream = ingest.text_stream(spark, drops)
        ingest.ingest_history(stream, CONFIG, store, marks_path, str(tmp_path / "checkpoint")).awaitTermination()

    for first, last in ((1, 9), (1, 9), (5, 13), (13, 15), (1, 15)):
        drop(first, last)
    assert sizes == [8, 0, 4, 2, 0]
    assert {tuple(r) for r in ingest.marks(spark, marks_path).collect()} == {("schedd0", 14, 0), ("schedd1", 13, 0)}
    assert store.records().count() == 14
    assert len(list((tmp_path / "marks").glob("batch=*"))) == 2


def test_labels_and_pieces_are_not_broadcast(spark):
    """However small the rows look before they are cut to pieces; a pattern whose keys all
    meet a value matches it once."""
    table = spark.createDataFrame([("d", v) for v in ("cms", "cms-u17", "u17|cms", "cms|u17|s-u")], "day string, value string")
    found = matching_labels(table, "day", "value")
    assert re.search(r"SortMergeJoin \[day#\d+, key#\d+\]", plan_of(found))
    assert sorted((r["label"], r["value"]) for r in found.collect()) == sorted(
        (label, value)
        for label in ("cms", "cms-u17", "u17|cms", "cms|u17|s-u")
        for value in ("cms", "cms-u17", "u17|cms", "cms|u17|s-u")
        if "|" in label or label in value
    )


def test_a_pair_of_label_and_value_is_made_by_compiled_code(spark):
    """Alternatives match each other, so that pairs grow with the square of a day's values: no
    lambda is interpreted for a pair, and a choice of literals is not tried as a pattern."""
    texts = ["u95", "u12345|u95", "u12346|u95", "u95|u12345|u95", "u|u9", "", "|", "x|", "very-long-group-a|z", "very-long-group-b",
             "^u1234[0-4]?$", "u12345", "u1234", "very-long-group-[ab]$", "z", "u95|", "(u95|x)z?"]
    found = matching_labels(spark.createDataFrame([("d", v) for v in texts], "day string, value string"), "day", "value")
    join = next(line for line in plan_of(found).splitlines() if "SortMergeJoin" in line)
    assert "RLIKE" in join and "lambda" not in join and re.search(r"NOT is_pattern#\d+ OR RLIKE", join)
    assert sorted((r["label"], r["value"]) for r in found.collect()) == sorted(
        (label, value) for label in texts for value in texts if re.search(label, value)
    )


def test_many_pieces_of_spans_are_not_broadcast(spark):
    """Few spans, but 210,000 hours of them."""
    spans = spark.createDataFrame([("r", "n", "p", at("2000-01-01T00:00:00Z"), at("2024-01-01T00:00:00Z"))], SPANS)
    samples = spark.createDataFrame([("n", "p", "m", "s", at("2023-01-01T00:00:00Z"), 1.0)], SAMPLES)
    found = samples_within(spans, samples)
    assert re.search(r"SortMergeJoin \[namespace[^\]]*bucket", plan_of(found))
    assert [r["value"] for r in found.collect()] == [1.0]


def test_many_ids_are_not_broadcast(spark, records_of, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"))
    store.add(reshape.to_added(records_of(record("7", "2024-01-01T00:00:00Z"))))
    found = store.lookup(spark.range(100_001).select(F.col("id").cast("string").alias("record_id")))
    assert "SortMergeJoin" in plan_of(found) and "BroadcastHashJoin" not in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [("7", "2024-01")]
    assert "BroadcastHashJoin" in plan_of(store.lookup(spark.range(3).selectExpr("CAST(id AS STRING) record_id")))

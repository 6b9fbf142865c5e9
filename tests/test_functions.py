import math

import pytest
from conftest import at, component, record
from pyspark.sql import functions as F

from usageledger.functions import calendar, numbers, parsing, text
from usageledger.functions.records import merge_maps, runtime_seconds
from usageledger.operators.fields import (
    ComponentField,
    ConstantField,
    MetaField,
    NormalisedField,
    RecordField,
    ScoreField,
)
from usageledger.operators.validity import split_valid, valid_name, valid_value
from usageledger.schema import RECORD_ADD


@pytest.fixture(scope="module")
def value(spark):
    def evaluate(build, *inputs):
        """Apply a column function to each input, as data (not folded)."""
        df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
        rows = df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()
        return [row["y"] for row in rows]

    return evaluate


def test_clock(value):
    assert value(
        parsing.clock_seconds, "43:28.686", "10:07:24", "2-08:19:41", "1:2", "43:28", None
    ) == [2608, 36444, 202781, None, None, None]


def test_numbers(value):
    assert value(parsing.integer, "12", "-3", "+4", " 5", "1.5", "", str(2**63)) == [
        12, -3, 4, None, None, None, None,
    ]
    assert value(parsing.integer_mega, "2000M", "M", "20") == [2000, None, 2]
    assert value(parsing.loose_amount, "3", "3.9", "true", "false", "x", "5d") == [
        3, 3, 1, 0, None, None,
    ]
    assert value(parsing.loose_text, "007", "1.50", "true", "abc") == ["7", "1.5", "True", "abc"]


STYLES = (
    "{'voms': '/atlas/Role=production', 'headnode': 'gsiftp://host:2811/jobs', 'subject': '/a/'}",
    "\"{'voms': '/atlas/Role=production', 'headnode': 'gsiftp://host:2811/jobs', 'subject': '/a/'}\"",
    '{"voms": "/atlas/Role=production", "headnode": "gsiftp://host:2811/jobs", "subject": "/a/"}',
    '"{"voms": "/atlas/Role=production", "headnode": "gsiftp://host:2811/jobs", "subject": "/a/"}"',
)


def test_json_map(value):
    expected = {
        "voms": "/atlas/Role=production", "headnode": "gsiftp://host:2811/jobs", "subject": "/a/",
    }
    assert value(parsing.json_map, *STYLES) == [expected] * 4
    assert value(parsing.json_map, "", "{", '{"a": 1}', None) == [{}] * 4


def test_local_datetime(value):
    def berlin(x):
        return parsing.local_datetime(x, "Europe/Berlin").cast("string")

    assert value(berlin, "2023-11-07T10:14:01", "2023-07-07T10:14:01", "Unknown") == [
        "2023-11-07 09:14:01", "2023-07-07 08:14:01", None,
    ]


def test_quantity(value):
    assert value(
        parsing.quantity_milli, "1", "500m", "2k", "1Ki", "1M", "1Mi", "1Gi", "1.5", "3X", "Ki", ""
    ) == [
        1000, 500, 2_000_000, 1_024_000, 10**9, 1024**2 * 1000, 1024**3 * 1000,
        None, None, None, None,
    ]


def test_text_rules(value):
    assert value(text.display_name, "/atlas/Role=production/Capability=NULL",
                 "/atlas/Role=NULL/Capability=NULL", "/a/b", "plain") == [
        "atlas-production", "atlas", "/a/b", "plain",
    ]
    assert value(text.percent_decode, "a%2Fb+c", "100%", "%zz%20", "%C3%A9") == [
        "a/b+c", "100%", "%zz ", "é",
    ]
    assert value(lambda x: text.regex_or_none(x, "(?<=/).+"), "a/b", "ab") == ["b", "None"]
    assert value(lambda x: text.vo_mapping(x, {"a": "A", "ab": "B"}), "abc", "c") == ["A", "None"]
    assert value(lambda x: text.first_contained(x, ["prod", "p"]), "xprod", "p", "z") == [
        "prod", "p", "z",
    ]
    assert value(parsing.account_id, "user(1000)", "user") == ["user", "user"]
    with pytest.raises(KeyError):
        text.named_function("other")


def test_rounding(value):
    def of(function):
        return value(lambda x: function(x.cast("double")), "2.5", "3.5", "-2.5", "2.4")

    assert of(numbers.half_even) == [2, 4, -2, 2]
    assert of(numbers.half_away) == [3, 4, -3, 2]


def test_runtime_cuts_toward_zero(spark):
    df = spark.createDataFrame(
        [(at("2022-01-01T00:00:00Z"), at("2022-01-01T00:00:01.900Z"))], "a timestamp, b timestamp"
    )
    row = df.select(runtime_seconds("a", "b").alias("up"), runtime_seconds("b", "a").alias("down"))
    assert row.first().asDict() == {"up": 1, "down": -1}


def test_merge_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"})], "x map<string,string>, y map<string,string>")
    assert df.select(merge_maps(F.col("x"), F.col("y")).alias("m")).first()["m"] == {"a": "1", "b": "2"}


def test_calendar():
    assert calendar.month_bounds(2024, 12) == (at("2024-12-01T00:00:00Z"), at("2025-01-01T00:00:00Z"))
    assert calendar.begin_previous_month(at("2024-01-31T10:00:00Z")) == at("2023-12-01T00:00:00Z")
    assert calendar.report_month(at("2024-03-01T00:00:00Z"), at("2024-02-28T00:00:00Z")) == at(
        "2024-02-01T00:00:00Z"
    )
    assert calendar.report_month(at("2024-03-05T00:00:00Z"), at("2024-03-04T00:00:00Z")) == at(
        "2024-03-01T00:00:00Z"
    )
    assert calendar.archive_cutoff(at("2025-01-31T00:00:00Z"), 3) == at("2024-10-01T00:00:00Z")


# -- validity ------------------------------------------------------------------


def test_names(value):
    family = "\N{MAN}\N{ZERO WIDTH JOINER}\N{WOMAN}\N{ZERO WIDTH JOINER}\N{GIRL}"
    assert value(
        valid_name, "a", "/()\"<>\\{}", " ", "  ", "", "x" * 256, "x" * 257,
        "é" * 256, "é" * 257, family * 256, None,
    ) == [True, True, False, False, False, True, False, True, False, True, False]


def test_values(spark):
    df = spark.createDataFrame([(0.0,), (-1e-9,), (math.nan,), (None,)], "x double")
    assert [r[0] for r in df.select(valid_value(F.col("x"))).collect()] == [True, False, True, False]


def test_random_names_and_amounts(spark):
    from usageledger.operators.reshape import to_added
    from usageledger.sources.synthetic import hostile_records

    valid, rejects = split_valid(to_added(hostile_records(spark, 200)))
    assert valid.count() == 200 and rejects.count() == 0


def test_reasons(spark):
    start = at("2022-01-01T00:00:00Z")
    rows = [
        ("ok", None, [], start, None),
        (None, None, [], start, None),
        ("no start", None, [], None, None),
        ("no list", None, None, start, None),
        ("meta key", {" ": ["a"]}, [], start, None),
        ("meta value", {"k": ["a", ""]}, [], start, None),
        ("amount", None, [("c", -1, [])], start, None),
        ("name", None, [("", 1, [])], start, None),
        ("score", None, [("c", 1, [("s", -0.1)])], start, None),
        ("score name", None, [("c", 1, [(" ", 0.1)])], start, None),
    ]
    valid, rejects = split_valid(spark.createDataFrame(rows, RECORD_ADD))
    assert [r["record_id"] for r in valid.collect()] == ["ok"]
    found = {r["record_id"]: r["reasons"] for r in rejects.collect()}
    assert found == {
        None: ["record_id"], "no start": ["start_time"], "no list": ["components"],
        "meta key": ["meta"], "meta value": ["meta"], "amount": ["component amount"],
        "name": ["component name"], "score": ["score value"], "score name": ["score name"],
    }


# -- fields --------------------------------------------------------------------


@pytest.fixture(scope="module")
def one(records_of):
    return records_of(
        record(
            "r", "2024-05-01T00:00:00Z", "2024-05-01T00:00:03Z",
            {"voms": ["/atlas/x"], "empty": []},
            [component("Cores", 8, HEP=1.5), component("CPU", 2500), component("Cores", 99)],
        )
    )


def test_fields(one):
    score = ScoreField("HEP", "Cores")
    fields = {
        "cores": ComponentField("Cores"),
        "cpu": ComponentField("CPU", divide_by=1000),
        "score": score,
        "vo": MetaField("voms", function=("vo_mapping", {"/atlas": "atlas"})),
        "part": MetaField("voms", regex=r"(?<=/)\w+$"),
        "unmatched": MetaField("voms", regex="zzz"),
        "absent": MetaField("nowhere"),
        "empty": MetaField("empty"),
        "month": RecordField("stop_time", "month"),
        "norm": NormalisedField(score),
        "norm_cpu": NormalisedField(score, ComponentField("CPU", divide_by=1000)),
        "const": ConstantField("x"),
    }
    row = one.select(*[f.required(name).alias(name) for name, f in fields.items()]).first()
    assert row.asDict() == {
        "cores": 8, "cpu": 2, "score": 1.5, "vo": "atlas", "part": "x", "unmatched": "None",
        "absent": "None", "empty": "None", "month": 5, "norm": 4, "norm_cpu": 3, "const": "x",
    }


@pytest.mark.parametrize(
    "field", [ComponentField("Disk"), ScoreField("HEP", "Disk"), ScoreField("HS", "Cores")]
)
def test_missing_fields_fail(one, field):
    assert one.select(field.column()).first()[0] is None
    with pytest.raises(Exception, match="is missing in record r"):
        one.select(field.required("f")).collect()


def test_refused_fields():
    with pytest.raises(TypeError):
        NormalisedField(ScoreField("a", "b"), RecordField("record_id")).column()
    with pytest.raises(AttributeError):
        RecordField("stop_time", "weekday").column()
    with pytest.raises(KeyError):
        MetaField("a", function=("nope", {})).column()

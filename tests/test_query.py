from datetime import datetime, timezone

import pytest
from conftest import component, ids, record

from usageledger.operators.query import (
    ComponentQuery,
    MetaOperator,
    MetaQuery,
    Operator,
    RecordQuery,
    SortBy,
    authorize,
    started_since,
    stopped_since,
)
from usageledger.plans.store import one_record


@pytest.fixture(scope="module")
def nine(records_of):
    """r1..r9, one per day at noon, stopping two days later."""
    return records_of(
        *[
            record(
                f"r{i}",
                f"2022-10-0{i}T12:00:00Z",
                f"2022-10-{i + 2:02d}T12:00:00Z",
                {"group_id": ["group_1", f"g{i % 2}"]},
                [component("Memory", i), component("cpu", 4)],
            )
            for i in range(1, 10)
        ]
    ).cache()


@pytest.mark.parametrize("day", range(1, 10))
def test_started_since(nine, day):
    query = started_since(f"2022-10-0{day}T09:47:00Z")
    assert ids(query.apply(nine)) == [f"r{i}" for i in range(day, 10)]


def test_stopped_since(nine):
    query = stopped_since("2022-10-05T09:47:00Z")
    assert ids(query.apply(nine)) == [f"r{i}" for i in range(3, 10)]


def test_empty_store(nine):
    assert ids(started_since("2022-10-01T00:00:00Z").apply(nine.limit(0))) == []


def test_meta_contains_all_values(nine):
    def asking(*values):
        operator = MetaOperator().contains(values)
        return RecordQuery().with_meta_query(MetaQuery().meta_operator("group_id", operator))

    assert len(ids(asking("group_1").apply(nine))) == 9
    assert ids(asking("group_1", "g1").apply(nine)) == ["r1", "r3", "r5", "r7", "r9"]
    assert ids(asking("g0", "g1").apply(nine)) == []


def test_meta_does_not_contain_needs_the_key(records_of):
    df = records_of(
        record("a", "2022-01-01T00:00:00Z", None, {"site": ["x"]}),
        record("b", "2022-01-01T00:00:00Z", None, {"site": ["y"]}),
        record("c", "2022-01-01T00:00:00Z", None, {"other": ["y"]}),
        record("d", "2022-01-01T00:00:00Z", None, None),
    )
    operator = MetaOperator().does_not_contain(["x"])
    query = RecordQuery().with_meta_query(MetaQuery().meta_operator("site", operator))
    assert ids(query.apply(df)) == ["b"]


def test_component_looks_at_the_first_one(nine):
    equals = ComponentQuery().component_operator("cpu", Operator().equals(4))
    assert ids(RecordQuery(component=equals).apply(nine)) == []
    assert len(ids(RecordQuery(component=equals, component_scope="any").apply(nine))) == 9
    first = ComponentQuery().component_operator("Memory", Operator().gt(7))
    assert ids(RecordQuery(component=first).apply(nine)) == ["r8", "r9"]
    both = first.component_operator("cpu", Operator().gt(1))
    assert ids(RecordQuery(component=both).apply(nine)) == []


def test_amounts_beyond_32_bits(records_of):
    df = records_of(
        record("a", "2022-01-01T00:00:00Z", None, None, [component("m", 2**40)]),
    )
    query = ComponentQuery().component_operator("m", Operator().gte(2**40))
    assert ids(RecordQuery(component=query).apply(df)) == ["a"]


def test_sort_and_limit(nine):
    down = RecordQuery().sort_by(SortBy().descending("start_time"))
    assert ids(down.apply(nine)) == [f"r{i}" for i in range(9, 0, -1)]
    assert ids(down.limit(4).apply(nine)) == ["r9", "r8", "r7", "r6"]
    assert ids(down.limit(0).apply(nine)) == []


def test_open_records_sort_last_and_never_match_a_stop(records_of):
    df = records_of(
        record("open", "2022-01-01T00:00:00Z"),
        record("late", "2022-01-01T00:00:00Z", "2022-01-03T00:00:00Z"),
        record("soon", "2022-01-01T00:00:00Z", "2022-01-02T00:00:00Z"),
    )
    assert ids(RecordQuery().apply(df)) == ["soon", "late", "open"]
    down = RecordQuery().sort_by(SortBy().descending("stop_time"))
    assert ids(down.apply(df)) == ["open", "late", "soon"]
    assert ids(stopped_since("2000-01-01T00:00:00Z").apply(df)) == ["soon", "late"]


def test_single_record(nine):
    assert ids(one_record(nine, "r3")) == ["r3"]
    assert ids(one_record(nine, "r33")) == []
    assert ids(one_record(nine, "  ")) == []


def test_contradictory_bounds_drop_the_condition(nine):
    t = datetime(2022, 10, 5, tzinfo=timezone.utc)
    query = RecordQuery(start_time=Operator().gt(t).gte(t))
    assert len(ids(query.apply(nine))) == 9
    with pytest.raises(ValueError):
        RecordQuery(start_time=Operator().gt(t).gte(t), strict=True).apply(nine)


def test_time_equality_is_ignored(nine):
    t = datetime(2022, 10, 5, 12, tzinfo=timezone.utc)
    assert len(ids(RecordQuery(start_time=Operator().equals(t)).apply(nine))) == 9
    with pytest.raises(ValueError):
        RecordQuery(start_time=Operator().equals(t), strict=True).apply(nine)


def test_refused_queries():
    for bad in (
        {"stop": {"gte": 1}},
        {"runtime": {"above": 1}},
        {"runtime": {"gt": -1}},
        {"component": {"cpu": {"gt": -1}}},
        {"limit": -1},
        {"record_id": " "},
        {"sort_by": {"asc": "meta"}},
        {"sort_by": {"up": "runtime"}},
    ):
        with pytest.raises(ValueError):
            RecordQuery.from_dict(bad)


def test_setting_a_field_again_replaces_it(nine):
    query = RecordQuery().with_runtime(Operator().lt(1)).with_runtime(Operator().gt(1))
    assert len(ids(query.apply(nine))) == 9


def test_access_rules(nine):
    assert ids(authorize(nine, {"group_id": ["g0"]}).orderBy("record_id")) == [
        "r2", "r4", "r6", "r8",
    ]
    assert ids(authorize(nine, {"group_id": ["g0", "g1"]}, mode="all")) == []

    def asking(operator):
        return RecordQuery().with_meta_query(MetaQuery().meta_operator("group_id", operator))

    with pytest.raises(PermissionError):
        authorize(nine, {"group_id": ["g0"]}, asking(MetaOperator().contains(["g1"])))
    with pytest.raises(PermissionError):
        authorize(nine, {"group_id": ["g0"]}, asking(MetaOperator().does_not_contain(["g0"])))
    with pytest.raises(PermissionError):
        authorize(nine, {})
    # Excluding something else still restricts to what is allowed.
    query = asking(MetaOperator().does_not_contain(["g1"]))
    assert len(ids(authorize(nine, {"group_id": ["g0"]}, query))) == 4


def test_conditions_reach_the_scan(spark, nine, tmp_path):
    nine.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    query = RecordQuery(
        record_id="r3",
        start_time=Operator().gte("2022-10-01T00:00:00Z"),
        runtime=Operator().gt(5),
    )
    plan = query.apply(stored, ordered=False).select("record_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(record_id,r3)", "GreaterThanOrEqual(start_time", "GreaterThan(runtime"):
        assert pushed in text
    assert "meta" not in text.split("ReadSchema")[1]

import re

import pytest
from conftest import at, component, record
from pyspark.sql import functions as F

from usageledger.catalog.tables import order_records
from usageledger.operators.reconcile import reconcile
from usageledger.operators.reshape import (
    decode_names,
    from_flat_tables,
    milli_to_whole,
    to_flat_tables,
)
from usageledger.session import scratch_root, settings
from usageledger.sources.records import FLAT_TABLES, read_flat
from usageledger.sources.synthetic import hostile_records, steady_records

T0, T1 = "2022-01-01T00:00:00Z", "2022-01-01T00:01:00Z"


def test_unit_conversion(records_of):
    df = records_of(
        *[record(str(a), T0, T1, None, [component("Cores", 1), component("TotalCPU", a)]) for a in (2733, 4577, 3)],
        record("none", T0, T1, None, [component("Cores", 1)]),
        record("null", T0, T1),
    )
    once = milli_to_whole(df, "TotalCPU")
    found = {
        r["record_id"]: [(c["name"], c["amount"]) for c in r["components"] or []] for r in once.collect()
    }
    assert found == {
        "2733": [("Cores", 1), ("TotalCPU", 3), ("TotalCPU_milli", 2733)],
        "4577": [("Cores", 1), ("TotalCPU", 5), ("TotalCPU_milli", 4577)],
        "3": [("Cores", 1), ("TotalCPU", 0), ("TotalCPU_milli", 3)],
        "none": [("Cores", 1)],
        "null": [],
    }
    assert sorted(map(str, milli_to_whole(once, "TotalCPU").collect())) == sorted(map(str, once.collect()))


def test_decode(records_of):
    row = decode_names(records_of(record("a%20b", T0, T1, {"k%20": ["x%2Fy", "+"]}))).first()
    assert row["record_id"] == "a b" and row["meta"] == {"k%20": ["x/y", "+"]}


def test_flat_round_trip(spark, tmp_path):
    # Value lists of the flat model are sets: order and repeats are not kept.
    records = hostile_records(spark, 60).withColumns(
        {
            "meta": F.map_filter(
                F.transform_values("meta", lambda _, v: F.array_sort(F.array_distinct(v))),
                lambda _, v: F.size(v) > 0,
            ),
            "components": F.transform(
                "components", lambda c: c.withField("scores", F.array_sort(F.array_distinct(c["scores"])))
            ),
        }
    ).withColumn("meta", F.when(F.size("meta") > 0, F.col("meta")))
    tables = to_flat_tables(records)
    back = reconcile(records, from_flat_tables(tables))
    assert {r["status"] for r in back.collect()} == {"equal"}
    for name in FLAT_TABLES:
        tables[name].write.parquet(str(tmp_path / name))
    stored = reconcile(records, read_flat(spark, str(tmp_path)))
    assert {r["status"] for r in stored.collect()} == {"equal"}


def test_reconcile(records_of):
    def row(rid, start=T0, stop=T1, amount=1, score=1.0):
        return record(rid, start, stop, {"a": ["1"]}, [component("c", amount, s=score)])

    left = records_of(row("same"), row("time"), row("score"), row("amount"), row("late"), row("left"))
    right = records_of(
        row("same"), row("time", "2022-01-01T00:00:00.0009Z"), row("score", score=1.0 + 1e-9),
        row("amount", amount=2), row("late", stop="2022-01-01T00:01:02Z"), row("right"),
    )
    found = {r["record_id"]: (r["status"], r["fields"]) for r in reconcile(left, right).collect()}
    assert found["same"] == ("equal", [])
    assert found["score"] == ("equal", [])
    assert found["amount"] == ("differs", ["components"])
    assert found["late"] == ("differs", ["stop_time", "runtime"])
    assert found["left"] == ("left_only", None) and found["right"] == ("right_only", None)
    assert "start_time" not in found["time"][1]


def test_steady_records(spark):
    df = steady_records(spark, 2000)
    rows = df.orderBy("start_time").limit(2).collect()
    assert rows[0]["start_time"].timestamp() == at("2023-01-01T00:00:00Z").timestamp()
    assert (rows[1]["start_time"] - rows[0]["start_time"]).seconds == 315
    hours = df.select(F.avg(F.col("runtime") / 3600)).first()[0]
    assert 14 < hours < 16
    assert df.select(F.explode(F.col("meta")["site_id"])).distinct().count() == 6
    amounts = [r[0] for r in df.select(F.col("components")[0]["amount"]).distinct().collect()]
    assert sorted(amounts) == [5, 6, 7, 8, 9, 10]


def test_generators_repeat(spark):
    assert hostile_records(spark, 20).collect() == hostile_records(spark, 20).collect()
    sizes = hostile_records(spark, 100).select(F.size("components")).distinct().collect()
    assert {r[0] for r in sizes} == set(range(1, 10))


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError), settings(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_scratch_is_the_named_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_lists_are_built_where_their_rows_are(spark):
    """Rows are dealt out by component and by record before lists are built of them."""
    plan = from_flat_tables(to_flat_tables(steady_records(spark, 20)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(component_id#\d+, \d+\), REPARTITION_BY_COL", plan)
    assert re.search(r"hashpartitioning\(record_id#\d+, \d+\), REPARTITION_BY_COL", plan)


def test_items_of_orders_are_dealt_out_once(spark, tmp_path):
    """Items without an order belong to no record; the others are sent once."""
    at_time = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    tables = {
        "lineitem": "SELECT * FROM VALUES (1L, 'F', 'A', 2.0D, 0.02D), (1L, 'F', 'N', 3.0D, 0.04D), (1L, 'O', 'N', 1.0D, 0.05D), "
        "(CAST(NULL AS BIGINT), 'F', 'R', 9.0D, 0.01D) AS t(l_orderkey, l_linestatus, l_returnflag, l_quantity, l_discount)",
        "orders": f"SELECT 1L AS o_orderkey, 5L AS o_custkey, {at_time} AS o_orderdate UNION ALL SELECT NULL, 5L, {at_time}",
        "customer": "SELECT 5L AS c_custkey, 'BUILDING' AS c_mktsegment, 2L AS c_nationkey",
        "nation": "SELECT 2L AS n_nationkey, 'N2' AS n_name",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    records = order_records(spark, str(tmp_path))
    assert len(re.findall(r"hashpartitioning\(l_orderkey", records._jdf.queryExecution().executedPlan().toString())) == 1
    rows = {r["record_id"]: r for r in records.collect()}
    assert set(rows) == {"order-1", None}
    assert [(c["name"], c["amount"], round(c["scores"][0]["value"], 6)) for c in rows["order-1"]["components"]] == [
        ("F", 5, 0.03), ("O", 1, 0.05),
    ]
    assert rows["order-1"]["meta"]["flags"] == ["A", "N"] and rows["order-1"]["runtime"] == 6 * 3600
    assert rows[None]["components"] is None and "flags" not in rows[None]["meta"]

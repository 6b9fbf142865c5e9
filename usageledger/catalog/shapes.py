"""Reshaping between the nested and the flat model, corrections, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from usageledger.catalog.filters import FLAT, flat
from usageledger.catalog.registry import query
from usageledger.catalog.tables import event_records, order_records, table
from usageledger.functions.records import component_amount, first_meta, meta_values, score_value
from usageledger.operators import reshape
from usageledger.operators.reconcile import reconcile
from usageledger.session import materialize, scratch_path
from usageledger.sources.records import FLAT_TABLES, read_flat


def _tables(spark, sf_dir):
    # All six tables come from the same records: compute those once.
    return reshape.to_flat_tables(materialize(order_records(spark, sf_dir), "records"))


@query(
    "j1_nested_from_flat",
    """SELECT record_id, site, group_id, user_id, start_time, stop_time, runtime,
              (SELECT string_agg(flag, ',' ORDER BY flag) FROM flag WHERE l_orderkey = o_orderkey) AS flags,
              (SELECT max(amount) FROM comp WHERE l_orderkey = o_orderkey AND name = 'F') AS f,
              (SELECT round(max(discount), 6) FROM comp WHERE l_orderkey = o_orderkey AND name = 'O') AS o
       FROM ord""",
)
def nested_from_flat(spark, sf_dir):
    records = reshape.from_flat_tables(_tables(spark, sf_dir))
    return records.select(
        "record_id",
        first_meta("site").alias("site"),
        first_meta("group_id").alias("group_id"),
        first_meta("user_id").alias("user_id"),
        "start_time",
        "stop_time",
        "runtime",
        F.array_join(meta_values("flags"), ",").alias("flags"),
        component_amount("F").alias("f"),
        F.round(score_value("O", "discount"), 6).alias("o"),
    )


@query(
    "j2_flat_components",
    """SELECT record_id, 'order-' || l_orderkey || '#' ||
              lpad(CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY name) - 1 AS VARCHAR), 10, '0')
              AS component_id, name, amount
       FROM ord JOIN comp ON o_orderkey = l_orderkey""",
)
def flat_components(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    return tables["records_components"].join(tables["components"], "component_id")


@query(
    "j2_flat_meta",
    """SELECT record_id, 'site' AS key, site AS value FROM ord
       UNION ALL SELECT record_id, 'group_id' AS key, group_id AS value FROM ord
       UNION ALL SELECT record_id, 'user_id' AS key, user_id AS value FROM ord
       UNION ALL SELECT record_id, 'flags' AS key, flag AS value FROM ord JOIN flag ON l_orderkey = o_orderkey""",
)
def flat_meta(spark, sf_dir):
    return _tables(spark, sf_dir)["meta"]


@query(
    "s10_flat_tables",
    f"SELECT {FLAT} FROM ord",
)
def flat_tables(spark, sf_dir):
    folder = scratch_path(spark, "flat")
    tables = _tables(spark, sf_dir)
    for name in FLAT_TABLES:
        tables[name].write.parquet(f"{folder}/{name}")
    return flat(read_flat(spark, folder))


@query(
    "a1_meta_pivot",
    """SELECT 'order-' || CAST(l_orderkey AS VARCHAR) AS record_id,
              string_agg(flag, ',' ORDER BY flag) AS flags, count(*) AS num FROM flag GROUP BY l_orderkey""",
)
def meta_pivot(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("record_id"),
        F.lit("flags").alias("key"),
        F.col("l_returnflag").alias("value"),
    )
    maps = reshape.meta_maps(pairs.distinct())
    return maps.select(
        "record_id",
        F.array_join(meta_values("flags"), ",").alias("flags"),
        F.size(meta_values("flags")).cast("bigint").alias("num"),
    )


@query(
    "a2_component_lists",
    """SELECT record_id, count(*) AS components, CAST(sum(amount) AS BIGINT) AS amount,
              round(sum(discount), 6) AS scores
       FROM ord JOIN comp ON o_orderkey = l_orderkey GROUP BY record_id""",
)
def component_lists(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    lists = reshape.component_lists(
        tables["components"],
        tables["scores"],
        tables["components_scores"],
        tables["records_components"],
    )
    zero = F.lit(0).cast("bigint")
    return lists.select(
        "record_id",
        F.size("components").cast("bigint").alias("components"),
        F.aggregate("components", zero, lambda total, c: total + c["amount"]).alias("amount"),
        F.round(
            F.aggregate(
                "components", F.lit(0.0), lambda total, c: total + c["scores"][0]["value"]
            ),
            6,
        ).alias("scores"),
    )


@query(
    "p23_unit_conversion",
    """SELECT record_id, CAST(round(total_cpu / 1000.0, 0) AS BIGINT) AS cpu, total_cpu AS milli,
              3 AS components FROM ev""",
)
def unit_conversion(spark, sf_dir):
    once = reshape.milli_to_whole(event_records(spark, sf_dir), "TotalCPU")
    twice = reshape.milli_to_whole(once, "TotalCPU")
    return twice.select(
        "record_id",
        component_amount("TotalCPU").alias("cpu"),
        component_amount("TotalCPU_milli").alias("milli"),
        F.size("components").alias("components"),
    )


@query(
    "p24_decode_names",
    "SELECT record_id || ' a+b' AS record_id, '/' || site AS site, group_id || '%' AS group_id FROM ev",
)
def decode_names(spark, sf_dir):
    records = event_records(spark, sf_dir)
    encoded = records.withColumns(
        {
            "record_id": F.concat("record_id", F.lit("%20a+b")),
            "meta": F.create_map(
                F.lit("site"), F.array(F.concat(F.lit("%2F"), first_meta("site"))),
                F.lit("group_id"), F.array(F.concat(first_meta("group_id"), F.lit("%25"))),
            ),
        }
    )
    decoded = reshape.decode_names(encoded)
    return decoded.select(
        "record_id", first_meta("site").alias("site"), first_meta("group_id").alias("group_id")
    )


@query(
    "x25_reconcile",
    """SELECT CASE WHEN k % 7 = 0 THEN 'left_only' WHEN k % 7 = 1 THEN 'differs' ELSE 'equal' END AS status,
              CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN 'runtime' ELSE '' END AS fields, count(*) AS num
       FROM ev GROUP BY 1, 2""",
)
def reconciled(spark, sf_dir):
    left = event_records(spark, sf_dir)
    k = (
        table(spark, sf_dir, "events")
        .select(
            F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("record_id"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )
    )
    # The right side lacks some records, is off by one second of runtime in
    # some, and has times and scores within the tolerance everywhere.
    right = left.join(k, "record_id").where(F.col("k") % 7 != 0)
    right = right.withColumns(
        {
            "runtime": F.when(
                F.col("k") % 7 == 1, F.coalesce("runtime", F.lit(0)) + 1
            ).otherwise(F.col("runtime")),
            "start_time": F.col("start_time") + F.expr("INTERVAL '0.0005' SECOND"),
            "components": F.transform(
                "components",
                lambda c: c.withField(
                    "scores",
                    F.transform(
                        c["scores"], lambda s: s.withField("value", s["value"] * (1 + 1e-9))
                    ),
                ),
            ),
        }
    ).drop("k")
    return (
        reconcile(left, right)
        .groupBy("status", F.array_join("fields", ",").alias("fields"))
        .agg(F.count("*").alias("num"))
    )

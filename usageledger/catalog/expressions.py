"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from usageledger.catalog.filters import FLAT, flat
from usageledger.catalog.registry import query
from usageledger.catalog.tables import event_columns, event_records, order_records, table
from usageledger.functions import calendar, numbers, parsing, text
from usageledger.functions.records import (
    component_amount,
    first_meta,
    has_component,
    meta_values,
    record_key,
    runtime_seconds,
    score_value,
    single_meta,
)
from usageledger.operators.fields import (
    ComponentField,
    ConstantField,
    MetaField,
    NormalisedField,
    RecordField,
    ScoreField,
    flatten,
)
from usageledger.operators.lookup import watt_per_core
from usageledger.operators.reshape import to_added, to_record, to_update
from usageledger.plans import archive, metrics
from usageledger.sources.slurm import as_text

VO = {"cl": "clicks", "pur": "sales", "s": "signups"}
ORDER_NAMES = "SELECT record_id, c.name, c.amount FROM ord JOIN comp c ON o_orderkey = l_orderkey"


def events(spark, sf_dir):
    return event_columns(table(spark, sf_dir, "events"))


# -- record projections -----------------------------------------------------------


@query(
    "p2_flatten",
    """SELECT record_id, start_time, stop_time, runtime, site, group_id, cores AS "Cores",
              total_cpu AS "TotalCPU", CAST(18.4 AS DOUBLE) AS "HEPscore23" FROM ev""",
)
def flatten_records(spark, sf_dir):
    return flatten(
        event_records(spark, sf_dir),
        meta=("site", "group_id"),
        amounts=("Cores", "TotalCPU"),
        scores=("HEPscore23",),
    )


@query(
    "p3_meta_field",
    """SELECT record_id, group_id AS vo, regexp_extract(user_id, '[0-9]+', 0) AS number,
              CASE WHEN site LIKE 'site_1%' THEN 'site_1' ELSE 'None' END AS one_site,
              CASE WHEN group_id LIKE 'cl%' THEN 'clicks' WHEN group_id LIKE 'pur%' THEN 'sales'
                   WHEN group_id LIKE 's%' THEN 'signups' ELSE 'None' END AS mapped,
              'None' AS missing
       FROM ev""",
)
def meta_field(spark, sf_dir):
    fields = {
        "vo": MetaField("group_id"),
        "number": MetaField("user_id", regex="(?<=u)[0-9]+"),
        "one_site": MetaField("site", regex="^site_1"),
        "mapped": MetaField("group_id", function=("vo_mapping", VO)),
        "missing": MetaField("nowhere"),
    }
    return event_records(spark, sf_dir).select(
        "record_id", *[field.column().alias(name) for name, field in fields.items()]
    )


@query(
    "p4_component_field",
    """SELECT record_id, cores, CAST(round_even(total_cpu / 4.0, 0) AS BIGINT) AS quarter,
              CAST(round_even(total_cpu / 2.0, 0) AS BIGINT) AS half FROM ev""",
)
def component_field(spark, sf_dir):
    return event_records(spark, sf_dir).select(
        "record_id",
        ComponentField("Cores").required("cores").alias("cores"),
        ComponentField("TotalCPU", divide_by=4).required("quarter").alias("quarter"),
        ComponentField("TotalCPU", divide_by=2).required("half").alias("half"),
    )


@query(
    "p5_score_field",
    """SELECT record_id, round(c.discount, 6) AS score FROM ord
       LEFT JOIN (SELECT * FROM comp WHERE name = 'O') c ON o_orderkey = l_orderkey""",
)
def score_field(spark, sf_dir):
    return order_records(spark, sf_dir).select(
        "record_id", F.round(ScoreField("discount", "O").column(), 6).alias("score")
    )


@query(
    "p6_record_field",
    """SELECT record_id, runtime, CAST(month(stop_time) AS INTEGER) AS month,
              CAST(year(stop_time) AS INTEGER) AS year, CAST(hour(start_time) AS INTEGER) AS hour
       FROM ev""",
)
def record_field(spark, sf_dir):
    return event_records(spark, sf_dir).select(
        "record_id",
        RecordField("runtime").column().alias("runtime"),
        RecordField("stop_time", "month").column().alias("month"),
        RecordField("stop_time", "year").column().alias("year"),
        RecordField("start_time", "hour").column().alias("hour"),
    )


@query(
    "p7_normalised_field",
    """SELECT record_id,
              CAST(round_even(CAST(runtime AS DOUBLE) * CAST(18.4 AS DOUBLE), 0) AS BIGINT) AS wall,
              CAST(round_even(CAST(total_cpu AS DOUBLE) * CAST(18.4 AS DOUBLE), 0) AS BIGINT) AS cpu
       FROM ev""",
)
def normalised_field(spark, sf_dir):
    score = ScoreField("HEPscore23", "Cores")
    return event_records(spark, sf_dir).select(
        "record_id",
        NormalisedField(score).column().alias("wall"),
        NormalisedField(score, ComponentField("TotalCPU")).column().alias("cpu"),
    )


@query("p8_constant_field", "SELECT record_id, 'grid' AS infrastructure, 1 AS nodes FROM ev")
def constant_field(spark, sf_dir):
    return event_records(spark, sf_dir).select(
        "record_id",
        ConstantField("grid").column().alias("infrastructure"),
        ConstantField(1).column().alias("nodes"),
    )


@query(
    "p20_power_attribution",
    """SELECT record_id, CASE site WHEN 'site_1' THEN 4.6::DOUBLE WHEN 'site_2' THEN 4.3::DOUBLE
              END AS watts, 3.5::DOUBLE AS fallback
       FROM ev""",
)
def power_attribution(spark, sf_dir):
    flat_rows = flatten(event_records(spark, sf_dir), meta=("site",))
    by_site = watt_per_core(flat_rows, {"site_1": 4.6, "site_2": 4.3})
    renamed = by_site.withColumnRenamed("watt_per_core", "watts")
    return watt_per_core(renamed, 3.5).select(
        "record_id", "watts", F.col("watt_per_core").alias("fallback")
    )


@query(
    "p21_group_mapping",
    """SELECT record_id, CASE WHEN contains(group_id, 'sign') THEN 'sign'
              WHEN contains(group_id, 'i') THEN 'i' WHEN contains(group_id, 'chase') THEN 'chase'
              ELSE group_id END AS mapped FROM ev""",
)
def group_mapping(spark, sf_dir):
    return event_records(spark, sf_dir).select(
        "record_id",
        text.first_contained(first_meta("group_id"), ["sign", "i", "chase"]).alias("mapped"),
    )


@query("p25_conversions", f"SELECT {FLAT} FROM ord")
def conversions(spark, sf_dir):
    return flat(to_record(to_added(order_records(spark, sf_dir))))


@query("p25_to_update", "SELECT record_id, stop_time FROM ord WHERE stop_time IS NOT NULL")
def update_conversion(spark, sf_dir):
    return to_update(order_records(spark, sf_dir))


# -- access to the nested parts --------------------------------------------------


@query(
    "x1_first_meta",
    """SELECT record_id, (SELECT min(flag) FROM flag WHERE l_orderkey = o_orderkey) AS flag
       FROM ord""",
)
def first_value(spark, sf_dir):
    return order_records(spark, sf_dir).select("record_id", first_meta("flags").alias("flag"))


@query(
    "x2_component_amount",
    """SELECT record_id, (SELECT max(amount) FROM comp WHERE l_orderkey = o_orderkey
              AND name = 'F') AS amount FROM ord""",
)
def amount(spark, sf_dir):
    return order_records(spark, sf_dir).select("record_id", component_amount("F").alias("amount"))


@query(
    "x3_score_value",
    """SELECT record_id, (SELECT round(max(discount), 6) FROM comp WHERE l_orderkey = o_orderkey
              AND name = 'F') AS score FROM ord""",
)
def score(spark, sf_dir):
    return order_records(spark, sf_dir).select(
        "record_id", F.round(score_value("F", "discount"), 6).alias("score")
    )


@query(
    "x4_component_exists",
    """SELECT record_id, o_orderkey IN (SELECT l_orderkey FROM comp WHERE name = 'O') AS has_o
       FROM ord""",
)
def component_exists(spark, sf_dir):
    return order_records(spark, sf_dir).select("record_id", has_component("O").alias("has_o"))


@query(
    "x5_single_meta",
    """SELECT record_id, (SELECT CASE WHEN count(*) = 1 THEN min(flag) END FROM flag
              WHERE l_orderkey = o_orderkey) AS flag FROM ord""",
)
def single_value(spark, sf_dir):
    return order_records(spark, sf_dir).select("record_id", single_meta("flags").alias("flag"))


# -- text ------------------------------------------------------------------------


@query(
    "x6_regex_or_none",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{3,}')
              THEN regexp_extract(text, '[0-9]{3,}', 0) ELSE 'None' END AS found
       FROM documents""",
)
def regex_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.regex_or_none(F.col("text"), "[0-9]{3,}").alias("found")
    )


@query(
    "x7_vo_mapping",
    """SELECT event_id, CASE WHEN event_type LIKE 'cl%' THEN 'clicks'
              WHEN event_type LIKE 'pur%' THEN 'sales' WHEN event_type LIKE 's%' THEN 'signups'
              ELSE 'None' END AS vo FROM events""",
)
def prefix_mapping(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", text.vo_mapping(F.col("event_type"), VO).alias("vo")
    )


@query(
    "d1_function_registry",
    """SELECT event_id, CASE WHEN event_type LIKE 'cl%' THEN 'clicks'
              WHEN event_type LIKE 'pur%' THEN 'sales' WHEN event_type LIKE 's%' THEN 'signups'
              ELSE 'None' END AS vo FROM events""",
)
def function_registry(spark, sf_dir):
    mapping = text.named_function("vo_mapping")
    return events(spark, sf_dir).select(
        "event_id", mapping(F.col("event_type"), VO).alias("vo")
    )


@query(
    "d2_field_objects",
    """SELECT record_id, site, cores, CAST(18.4 AS DOUBLE) AS score,
              CAST(day(start_time) AS INTEGER) AS day, 'batch' AS kind FROM ev""",
)
def field_objects(spark, sf_dir):
    fields = {
        "site": MetaField("site"),
        "cores": ComponentField("Cores"),
        "score": ScoreField("HEPscore23", "Cores"),
        "day": RecordField("start_time", "day"),
        "kind": ConstantField("batch"),
    }
    return event_records(spark, sf_dir).select(
        "record_id", *[field.column().alias(name) for name, field in fields.items()]
    )


@query(
    "x8_runtime_seconds",
    """SELECT record_id, date_sub('second', start_time, ended + INTERVAL 700 MILLISECONDS) AS up,
              date_sub('second', ended + INTERVAL 700 MILLISECONDS, start_time) AS down FROM ev""",
)
def whole_seconds(spark, sf_dir):
    e = events(spark, sf_dir)
    late = F.col("ended") + F.expr("INTERVAL '0.7' SECOND")
    return e.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("record_id"),
        runtime_seconds(F.col("ts"), late).alias("up"),
        runtime_seconds(late, F.col("ts")).alias("down"),
    )


@query(
    "x9_integer",
    "SELECT event_id, CASE k % 4 WHEN 0 THEN k WHEN 1 THEN -k END AS whole FROM ev",
)
def whole_number(spark, sf_dir):
    digits, style = F.col("k").cast("string"), F.col("k") % 4
    written = (
        F.when(style == 0, digits)
        .when(style == 1, F.concat(F.lit("-"), digits))
        .when(style == 2, F.concat(digits, F.lit(".5")))
        .otherwise(F.concat(F.lit(" "), digits))
    )
    return events(spark, sf_dir).select("event_id", parsing.integer(written).alias("whole"))


@query("x10_integer_mega", "SELECT record_id, cores * 2000 AS memory FROM ev")
def mega(spark, sf_dir):
    written = F.concat((F.col("cores") * 2000).cast("string"), F.lit("M"))
    return events(spark, sf_dir).select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("record_id"),
        parsing.integer_mega(written).alias("memory"),
    )


def _two(value):
    return F.lpad(value.cast("bigint").cast("string"), 2, "0")


@query(
    "x11_clock_seconds",
    """SELECT event_id, total_cpu % 3600 AS short, total_cpu % 86400 AS hours,
              k * 86400 + total_cpu % 86400 AS days FROM ev""",
)
def clock(spark, sf_dir):
    t = F.col("total_cpu")
    hours = F.concat_ws(
        ":", _two(F.floor(t % 86400 / 3600)), _two(F.floor(t % 3600 / 60)), _two(t % 60)
    )
    short = F.concat(_two(F.floor(t % 3600 / 60)), F.lit(":"), _two(t % 60), F.lit(".686"))
    return events(spark, sf_dir).select(
        "event_id",
        parsing.clock_seconds(short).alias("short"),
        parsing.clock_seconds(hours).alias("hours"),
        parsing.clock_seconds(F.concat(F.col("k").cast("string"), F.lit("-"), hours)).alias("days"),
    )


@query(
    "x12_local_datetime",
    """SELECT event_id, date_trunc('second', start_time) AS utc,
              date_trunc('second', start_time) - INTERVAL 1 HOUR AS berlin FROM ev""",
)
def local_time(spark, sf_dir):
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return events(spark, sf_dir).select(
        "event_id",
        parsing.local_datetime(written).alias("utc"),
        parsing.local_datetime(written, "Europe/Berlin").alias("berlin"),
    )


@query(
    "x12_summer_time",
    """SELECT event_id, date_trunc('second', start_time) + INTERVAL 170 DAY AS utc,
              date_trunc('second', start_time) + INTERVAL 170 DAY - INTERVAL 2 HOUR AS berlin FROM ev""",
)
def summer_time(spark, sf_dir):
    written = F.date_format(F.col("ts") + F.expr("INTERVAL 170 DAY"), "yyyy-MM-dd'T'HH:mm:ss")
    return events(spark, sf_dir).select(
        "event_id",
        parsing.local_datetime(written).alias("utc"),
        parsing.local_datetime(written, "Europe/Berlin").alias("berlin"),
    )


@query("x13_account_id", "SELECT event_id, user_id AS account FROM ev")
def account(spark, sf_dir):
    written = F.concat("user", F.lit("("), F.col("uid").cast("string"), F.lit(")(x)"))
    return events(spark, sf_dir).select("event_id", parsing.account_id(written).alias("account"))


@query(
    "x14_json_map",
    """SELECT event_id, k AS style, CASE WHEN k % 5 < 4 THEN group_id END AS voms,
              CASE WHEN k % 5 < 4 THEN 2 ELSE 0 END AS entries FROM ev""",
)
def json_text(spark, sf_dir):
    single = F.concat(
        F.lit("{'voms': '"), F.col("event_type"), F.lit("', 'user': '"), F.col("user"), F.lit("'}")
    )
    double = F.replace(single, F.lit("'"), F.lit('"'))
    style = F.col("k") % 5
    written = (
        F.when(style == 0, single)
        .when(style == 1, F.concat(F.lit('"'), single, F.lit('"')))
        .when(style == 2, double)
        .when(style == 3, F.concat(F.lit('"'), double, F.lit('"')))
        # A number is no text: the whole map is refused.
        .otherwise(F.concat(F.lit('{"voms": "x", "n": '), F.col("k").cast("string"), F.lit("}")))
    )
    parsed = events(spark, sf_dir).select("event_id", "k", parsing.json_map(written).alias("map"))
    return parsed.select(
        "event_id",
        F.col("k").alias("style"),
        F.try_element_at("map", F.lit("voms")).alias("voms"),
        F.size("map").alias("entries"),
    )


@query(
    "x15_as_text",
    """SELECT event_id, CAST(k AS VARCHAR) AS number, group_id AS text,
              strftime(start_time, '%Y-%m-%d %H:%M:%S UTC') AS moment FROM ev""",
)
def typed_as_text(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        as_text(F.col("k"), "Integer").alias("number"),
        as_text(F.col("event_type"), "String").alias("text"),
        as_text(F.col("ts"), "DateTime").alias("moment"),
    )


@query(
    "x16_loose_values",
    """SELECT event_id,
              CASE k % 5 WHEN 0 THEN k WHEN 1 THEN seconds WHEN 2 THEN 1 WHEN 3 THEN 0 END AS amount,
              CASE k % 5 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN CAST(seconds AS VARCHAR) || '.5'
                   WHEN 2 THEN 'True' WHEN 3 THEN 'False' ELSE group_id END AS label
       FROM ev""",
)
def loose_values(spark, sf_dir):
    style = F.col("k") % 5
    cell = (
        F.when(style == 0, F.lpad(F.col("k").cast("string"), 4, "0"))
        .when(style == 1, F.concat(F.col("seconds").cast("string"), F.lit(".50")))
        .when(style == 2, "true")
        .when(style == 3, "false")
        .otherwise(F.col("event_type"))
    )
    return events(spark, sf_dir).select(
        "event_id",
        parsing.loose_amount(cell).alias("amount"),
        parsing.loose_text(cell).alias("label"),
    )


@query(
    "x18_quantity",
    """SELECT event_id, CASE k % 6 WHEN 0 THEN k * 1000 WHEN 1 THEN k WHEN 2 THEN k * 1024000
              WHEN 3 THEN k * 1000000000 WHEN 4 THEN k * 1073741824000 END AS milli FROM ev""",
)
def quantity(spark, sf_dir):
    suffixes = {0: "", 1: "m", 2: "Ki", 3: "M", 4: "Gi", 5: "Q"}
    suffix = F.lit("")
    for number, unit in suffixes.items():
        suffix = F.when(F.col("k") % 6 == number, unit).otherwise(suffix)
    written = F.concat(F.col("k").cast("string"), suffix)
    return events(spark, sf_dir).select("event_id", parsing.quantity_milli(written).alias("milli"))


@query(
    "x19_display_name",
    """SELECT event_id, CASE k % 3 WHEN 0 THEN site || '-' || group_id WHEN 1 THEN site
              ELSE '/' || site END AS user FROM ev""",
)
def voms_name(spark, sf_dir):
    role = F.when(F.col("k") % 3 == 0, F.col("event_type")).otherwise("NULL")
    path = F.concat(F.lit("/"), F.col("site"), F.lit("/Role="), role, F.lit("/Capability=NULL"))
    path = F.when(F.col("k") % 3 == 2, F.concat(F.lit("/"), F.col("site"))).otherwise(path)
    return events(spark, sf_dir).select("event_id", text.display_name(path).alias("user"))


@query(
    "x20_percent_decode",
    """SELECT event_id, site || '/' || group_id || '+100%' || ' %zz' AS decoded FROM ev""",
)
def decode(spark, sf_dir):
    encoded = F.concat("site", F.lit("%2F"), "event_type", F.lit("+100%25%20%zz"))
    return events(spark, sf_dir).select(
        "event_id", text.percent_decode(encoded).alias("decoded")
    )


@query(
    "x21_month_bounds",
    """SELECT record_id, CAST(date_trunc('month', start_time) AS DATE) AS first,
              CAST(date_trunc('month', start_time) - INTERVAL 1 MONTH AS DATE) AS previous,
              CAST(date_trunc('month', start_time) + INTERVAL 1 MONTH AS DATE) AS following
       FROM ord""",
)
def months(spark, sf_dir):
    start = F.col("start_time")
    return order_records(spark, sf_dir).select(
        "record_id",
        calendar.month_start(start).alias("first"),
        calendar.month_start(start, -1).alias("previous"),
        calendar.month_start(start, 1).alias("following"),
    )


@query(
    "x22_rounding",
    """SELECT event_id, CAST(round_even(total_cpu / 2.0, 0) AS BIGINT) AS even,
              CAST(round(total_cpu / 2.0, 0) AS BIGINT) AS away,
              CAST(round(-total_cpu / 2.0, 0) AS BIGINT) AS below FROM ev""",
)
def rounding(spark, sf_dir):
    half = F.col("total_cpu") / 2
    return events(spark, sf_dir).select(
        "event_id",
        numbers.half_even(half).alias("even"),
        numbers.half_away(half).alias("away"),
        numbers.half_away(-half).alias("below"),
    )


@query(
    "x23_json_encode",
    """SELECT record_id, CASE WHEN runtime IS NULL THEN 'null' ELSE (
         SELECT '[' || string_agg('{"name":"' || name || '","amount":' || CAST(amount AS VARCHAR)
                || '}', ',' ORDER BY name) || ']' FROM comp WHERE l_orderkey = o_orderkey) END
         AS components
       FROM ord""",
)
def json_encode(spark, sf_dir):
    # Scores are left out: engines print decimals differently.
    plain = F.transform(
        "components", lambda c: F.struct(c["name"].alias("name"), c["amount"].alias("amount"))
    )
    records = order_records(spark, sf_dir).withColumn("components", plain)
    return records.select("record_id", archive.as_text("components").alias("components"))


@query("x24_record_key", "SELECT 'slurm-' || CAST(event_id AS VARCHAR) || '-' || group_id AS id FROM ev")
def key(spark, sf_dir):
    return events(spark, sf_dir).select(
        record_key("slurm", F.col("event_id").cast("string"), F.col("event_type")).alias("id")
    )


@query(
    "w2_first_match",
    """SELECT record_id, min(c.name) AS first_name,
              CASE WHEN min(c.name) IS NULL THEN 'none' WHEN bool_or(c.name = 'O') THEN 'open'
                   ELSE 'final' END AS kind
       FROM ord LEFT JOIN comp c ON o_orderkey = l_orderkey GROUP BY record_id""",
)
def first_match(spark, sf_dir):
    return order_records(spark, sf_dir).select(
        "record_id",
        F.try_element_at("components", F.lit(1))["name"].alias("first_name"),
        F.coalesce(
            F.when(has_component("O"), F.lit("open")),
            F.when(has_component("F"), F.lit("final")),
            F.lit("none"),
        ).alias("kind"),
    )


@query(
    "a22_distinct_labels",
    "SELECT DISTINCT flag FROM flag",
)
def distinct_labels(spark, sf_dir):
    return metrics.distinct_values(order_records(spark, sf_dir), "flags").withColumnRenamed("name", "flag")

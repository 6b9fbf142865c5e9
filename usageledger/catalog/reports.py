"""Counts, priorities, utilisation and accounting summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usageledger.catalog.filters import summary_config
from usageledger.catalog.registry import query
from usageledger.catalog.tables import event_records, order_records
from usageledger.functions.calendar import month_bounds
from usageledger.functions.records import first_meta
from usageledger.plans import apel, archive, metrics, priority, utilization
from usageledger.plans.label_match import matching_labels
from usageledger.sources.slurm import next_mark

KEYS = {"site": "site", "group_id": "group_id", "user_id": "user_id"}


# -- counts -------------------------------------------------------------------------


@query("a3_count_records", "SELECT count(*) AS num FROM ord")
def count_records(spark, sf_dir):
    return metrics.count_records(order_records(spark, sf_dir))


@query("a4_count_per_site", "SELECT site AS name, count(*) AS num FROM ord GROUP BY site")
def per_site(spark, sf_dir):
    return metrics.count_per_value(order_records(spark, sf_dir), "site")


@query("a4_count_multi_valued", "SELECT flag AS name, count(*) AS num FROM flag GROUP BY flag")
def per_flag(spark, sf_dir):
    return metrics.count_per_value(order_records(spark, sf_dir), "flags")


@query("a5_count_per_group", "SELECT group_id AS name, count(*) AS num FROM ev GROUP BY group_id")
def per_group(spark, sf_dir):
    return metrics.count_per_value(event_records(spark, sf_dir), "group_id")


@query("a6_count_per_user", "SELECT user_id AS name, count(*) AS num FROM ord GROUP BY user_id")
def per_user(spark, sf_dir):
    return metrics.count_per_value(order_records(spark, sf_dir), "user_id")


GAUGES_SQL = """
SELECT 'num_records_database' AS metric, NULL AS label, NULL AS label_value, count(*) AS value FROM ev
UNION ALL SELECT 'num_records_database_per_site', 'site', site, count(*) FROM ev GROUP BY site
UNION ALL SELECT 'num_records_database_per_group', 'group_id', group_id, count(*) FROM ev GROUP BY group_id
UNION ALL SELECT 'num_records_database_per_user', 'user_id', user_id, count(*) FROM ev GROUP BY user_id
"""


@query("k11_record_gauges", GAUGES_SQL)
def record_gauges(spark, sf_dir):
    return metrics.record_gauges(event_records(spark, sf_dir), KEYS)


@query("a20_oldest_stop", "SELECT min(stop_time) AS oldest_stop FROM ord")
def oldest_stop(spark, sf_dir):
    return archive.oldest_stop(order_records(spark, sf_dir))


@query(
    "a21_next_mark",
    """SELECT max(stop_time) AS last_check, arg_max(record_id, {'s': stop_time, 'r': record_id}) AS last_id
       FROM ev WHERE stop_time IS NOT NULL""",
)
def mark(spark, sf_dir):
    return next_mark(event_records(spark, sf_dir))


# -- priorities ---------------------------------------------------------------------

GROUPS = ["click", "view", "signup", "error", "nobody"]
USAGE_SQL = """
usage AS (
  SELECT g.group_id, coalesce(sum(runtime * cores * CAST(18.4 AS DOUBLE) * total_cpu), 0) AS usage
  FROM (VALUES ('click'), ('view'), ('signup'), ('error'), ('nobody')) g(group_id)
  LEFT JOIN ev ON ev.group_id = g.group_id GROUP BY g.group_id
),
bounds AS (SELECT min(usage) AS lo, max(usage) AS hi, sum(usage) AS total FROM usage)"""


def _usage(spark, sf_dir):
    # TotalCPU has no score of that name: it counts with its amount alone.
    scores = {"Cores": "HEPscore23", "TotalCPU": "HEPscore23"}
    return priority.usage(event_records(spark, sf_dir), GROUPS, scores)


@query("a15_group_usage", f"WITH {USAGE_SQL} SELECT group_id, round(usage, 3) AS usage FROM usage")
def group_usage(spark, sf_dir):
    return _usage(spark, sf_dir).select("group_id", F.round("usage", 3).alias("usage"))


@query(
    "j5_configured_groups",
    f"WITH {USAGE_SQL} SELECT group_id, usage > 0 AS used FROM usage",
)
def configured_groups(spark, sf_dir):
    return _usage(spark, sf_dir).select("group_id", (F.col("usage") > 0).alias("used"))


@query(
    "a16_usage_bounds",
    f"""WITH {USAGE_SQL} SELECT group_id, round(lo, 3) AS lo, round(hi, 3) AS hi,
        round(total, 3) AS total FROM usage, bounds""",
)
def usage_bounds(spark, sf_dir):
    return priority.with_bounds(_usage(spark, sf_dir)).select(
        "group_id",
        F.round("usage_min", 3).alias("lo"),
        F.round("usage_max", 3).alias("hi"),
        F.round("usage_sum", 3).alias("total"),
    )


@query(
    "a17_full_spread",
    f"""WITH {USAGE_SQL} SELECT group_id,
        CAST(round((usage - lo) / (hi - lo) * 65334 + 1) AS BIGINT) AS priority FROM usage, bounds""",
)
def full_spread(spark, sf_dir):
    return priority.priorities(_usage(spark, sf_dir)).select("group_id", "priority")


@query(
    "a18_scaled_by_sum",
    f"""WITH {USAGE_SQL} SELECT group_id,
        CAST(round(65334 / total * usage + 1) AS BIGINT) AS priority FROM usage, bounds""",
)
def scaled_by_sum(spark, sf_dir):
    ranked = priority.priorities(_usage(spark, sf_dir), "ScaledBySum")
    return ranked.select("group_id", "priority")


@query(
    "k11_priority_gauges",
    f"""WITH {USAGE_SQL}
        SELECT 'resource_usage' AS metric, 'group' AS label, group_id AS label_value,
               CAST(floor(round(usage, 3)) AS BIGINT) AS value FROM usage
        UNION ALL
        SELECT 'priority', 'group', group_id,
               CAST(round((usage - lo) / (hi - lo) * 65334 + 1) AS BIGINT) FROM usage, bounds""",
)
def priority_gauges(spark, sf_dir):
    rounded = _usage(spark, sf_dir).withColumn("usage", F.round("usage", 3))
    return metrics.priority_gauges(priority.priorities(rounded))


# -- utilisation ----------------------------------------------------------------------


def utilization_config(**changes) -> utilization.UtilizationConfig:
    defaults = {
        "grouped_by": "group_id",
        "watts": {"site_1": 4.6, "site_2": 4.3, "site_3": 4.1},
        "co2_per_kwh": 0.363,
    }
    return utilization.UtilizationConfig(**{**defaults, **changes})


def daily_sql(label: str, divisor: int = 1) -> str:
    return f"""
daily AS (
  SELECT CAST(stop_time AS DATE) AS day, {label} AS user,
         sum(cores * runtime)::DECIMAL(28,0) AS core_seconds,
         sum(total_cpu)::DOUBLE / {divisor} / nullif(sum(runtime * cores), 0)::DOUBLE AS cpu_eff,
         coalesce(sum(CASE site WHEN 'site_1' THEN 4.6::DECIMAL(2,1) WHEN 'site_2' THEN 4.3::DECIMAL(2,1)
                  WHEN 'site_3' THEN 4.1::DECIMAL(2,1) END * (cores * runtime)::DECIMAL(18,0)), 0) AS watt_seconds
  FROM ev WHERE stop_time >= TIMESTAMP '2024-01-01' AND stop_time < TIMESTAMP '2024-02-01'
  GROUP BY 1, 2
)"""


NUMBERS = ("khs23h", "cpu_eff", "corehours", "power_kwh", "co2_kg")


def _six_sql(value: str) -> str:
    """Six digits of the decimal value: a tie is not left to binary fractions."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,12)), 6) AS DOUBLE)"


def _numbers_sql(total: str, mean: str) -> str:
    seconds, watts = total.format("core_seconds"), total.format("watt_seconds")
    power = f"{watts}::DOUBLE / 3600.0::DOUBLE / 1000.0::DOUBLE"
    work = f"({seconds}::DECIMAL(28,0) * 18.4::DECIMAL(3,1))::DOUBLE / 3600.0::DOUBLE / 1000.0::DOUBLE"
    return f"""{_six_sql(work)} AS khs23h, {_six_sql(mean)} AS cpu_eff,
      {_six_sql(f"{seconds}::DOUBLE / 3600.0::DOUBLE")} AS corehours, {_six_sql(power)} AS power_kwh,
      {_six_sql(f"{power} * 0.363::DOUBLE")} AS co2_kg"""


NUMBERS_SQL = _numbers_sql("{}", "cpu_eff")
MONTH_SQL = f"SELECT user, {_numbers_sql('sum({})', 'avg(cpu_eff)')} FROM daily GROUP BY user"


def six(name: str) -> Column:
    return F.round(F.col(name).cast("decimal(38,12)"), 6).cast("double").alias(name)


def rounded(report, *keys):
    return report.select(*keys, *[six(name) for name in NUMBERS])


def _daily(spark, sf_dir, config):
    start, end = month_bounds(2024, 1)
    window = utilization.in_window(event_records(spark, sf_dir), start, end)
    return utilization.daily_report(window, config)


@query(
    "a12_daily_utilization",
    f"WITH {daily_sql('group_id')} SELECT day, user, {NUMBERS_SQL} FROM daily",
)
def daily_utilization(spark, sf_dir):
    return rounded(_daily(spark, sf_dir, utilization_config()), "day", "user")


@query(
    "a13_efficiency_units",
    f"WITH {daily_sql('group_id', 1000)} SELECT day, user, round(cpu_eff, 9) AS cpu_eff FROM daily",
)
def efficiency_units(spark, sf_dir):
    report = _daily(spark, sf_dir, utilization_config(collector="slurm"))
    return report.select("day", "user", F.round("cpu_eff", 9).alias("cpu_eff"))


@query("a14_month_utilization", f"WITH {daily_sql('group_id')} {MONTH_SQL}")
def month_utilization(spark, sf_dir):
    report = utilization.report(event_records(spark, sf_dir), utilization_config(), 2024, 1)
    return rounded(report, "user")


@query(
    "u1_union_of_days",
    f"""WITH {daily_sql('group_id')} SELECT day, count(*) AS groups, {_six_sql("sum(core_seconds)::DOUBLE / 3600.0::DOUBLE")} AS corehours
        FROM daily GROUP BY day""",
)
def union_of_days(spark, sf_dir):
    start, end = month_bounds(2024, 1)
    window = utilization.in_window(event_records(spark, sf_dir), start, end)
    days = utilization.daily_totals(window, utilization_config()).groupBy("day")
    totals = days.agg(F.count("*").alias("groups"), (F.sum("core_seconds") / 3600.0).alias("corehours"))
    return totals.select("day", "groups", six("corehours"))


_OVERLAP_LABEL = """CASE WHEN contains(group_id, 'ig') THEN 'ig' WHEN contains(group_id, 'i') THEN 'i'
  ELSE group_id END"""


@query(
    "j3_label_match_overlap",
    f"""WITH {daily_sql(_OVERLAP_LABEL)},
        rows AS (SELECT CAST(stop_time AS DATE) AS day, {_OVERLAP_LABEL} AS label, cores, runtime, total_cpu
                 FROM ev WHERE stop_time >= TIMESTAMP '2024-01-01' AND stop_time < TIMESTAMP '2024-02-01'),
        labels AS (SELECT DISTINCT day, label FROM rows)
        SELECT l.day, l.label AS user, {_six_sql("sum(cores * runtime)::DOUBLE / 3600.0::DOUBLE")} AS corehours,
               {_six_sql("sum(total_cpu)::DOUBLE / nullif(sum(runtime * cores), 0)::DOUBLE")} AS cpu_eff
        FROM labels l JOIN rows r ON r.day = l.day AND contains(r.label, l.label) GROUP BY 1, 2""",
)
def label_match(spark, sf_dir):
    config = utilization_config(grouping="overlap", group_list=("ig", "i"))
    report = _daily(spark, sf_dir, config)
    return report.select(
        "day",
        "user",
        F.round("corehours", 6).alias("corehours"),
        F.round("cpu_eff", 6).alias("cpu_eff"),
    )


@query(
    "j3_matching_labels",
    """WITH d AS (SELECT DISTINCT CAST(start_time AS DATE) AS day, user_id AS value FROM ev)
       SELECT a.day, b.value AS label, a.value FROM d a JOIN d b
       ON a.day = b.day AND contains(a.value, b.value)""",
)
def label_pairs(spark, sf_dir):
    # u1 is found inside u1, u10, u11, ...
    values = event_records(spark, sf_dir).select(
        F.col("start_time").cast("date").alias("day"), first_meta("user_id").alias("user")
    )
    return matching_labels(values, "day", "user")


_PATTERNS_SQL = """d AS (
  SELECT DISTINCT CAST(start_time AS DATE) AS day, unnest([user_id, '^' || user_id || '[0-4]?$', 'u.*' || user_id[2:],
    'u(1|2)+' || user_id[-1:], user_id || '|' || 'u9' || user_id[-1:], '[13]' || user_id[-1:] || '{1,2}$']) AS value FROM ev)"""


@query(
    "j3_pattern_labels",
    f"""WITH {_PATTERNS_SQL} SELECT a.day, b.value AS label, a.value FROM d a JOIN d b
        ON a.day = b.day AND regexp_matches(a.value, b.value)""",
)
def pattern_labels(spark, sf_dir):
    """Values that are patterns: anchors, classes, groups, repetitions, alternatives."""
    user = first_meta("user_id")
    last = F.right(user, F.lit(1))
    values = event_records(spark, sf_dir).select(
        F.col("start_time").cast("date").alias("day"),
        F.explode(
            F.array(
                user,
                F.concat(F.lit("^"), user, F.lit("[0-4]?$")),
                F.concat(F.lit("u.*"), F.substring(user, 2, 9)),
                F.concat(F.lit("u(1|2)+"), last),
                F.concat(user, F.lit("|u9"), last),
                F.concat(F.lit("[13]"), last, F.lit("{1,2}$")),
            )
        ).alias("value"),
    )
    return matching_labels(values, "day", "value")


@query(
    "j4_site_watts",
    """SELECT site, round(sum(CASE site WHEN 'site_1' THEN 4.6::DOUBLE WHEN 'site_2' THEN 4.3::DOUBLE
              WHEN 'site_3' THEN 4.1::DOUBLE END * cores), 6) AS watts FROM ev GROUP BY site""",
)
def site_watts(spark, sf_dir):
    from usageledger.operators.fields import flatten
    from usageledger.operators.lookup import watt_per_core

    rows = flatten(event_records(spark, sf_dir), meta=("site",), amounts=("Cores",))
    priced = watt_per_core(rows, utilization_config().watts)
    return priced.groupBy("site").agg(
        F.round(F.sum(F.col("watt_per_core") * F.col("Cores")), 6).alias("watts")
    )


@query(
    "s11_configured_lookup",
    """SELECT record_id, site, CASE site WHEN 'site_1' THEN 'north' WHEN 'site_2' THEN 'south' END AS region
       FROM ev""",
)
def configured_lookup(spark, sf_dir):
    from pyspark.sql import types as T

    from usageledger.operators.lookup import lookup_table

    regions = lookup_table(
        spark, {"site_1": "north", "site_2": "south"}, "site", "region", T.StringType()
    )
    rows = event_records(spark, sf_dir).select("record_id", first_meta("site").alias("site"))
    return rows.join(regions, "site", "left").select("record_id", "site", "region")


@query(
    "s14_several_hosts",
    """SELECT host, site, count(*) AS num, CAST(sum(runtime) AS BIGINT) AS runtime
       FROM (SELECT 'a' AS host, site, runtime FROM ev
             UNION ALL SELECT 'b' AS host, site, runtime FROM ord ) GROUP BY host, site""",
)
def several_hosts(spark, sf_dir):
    stores = [event_records(spark, sf_dir), order_records(spark, sf_dir)]
    return (
        utilization.read_hosts(stores, ["a", "b"])
        .groupBy("host", first_meta("site").alias("site"))
        .agg(F.count("*").alias("num"), F.sum("runtime").alias("runtime"))
    )


@query(
    "s14_host_reports",
    f"""WITH {daily_sql("CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END || '/' || group_id")}, month AS ({MONTH_SQL})
        SELECT split_part(user, '/', 1) AS host, split_part(user, '/', 2) AS user,
               khs23h, cpu_eff, corehours, power_kwh, co2_kg FROM month""",
)
def host_reports(spark, sf_dir):
    records = event_records(spark, sf_dir)
    even = F.substring_index("record_id", "-", -1).cast("bigint") % 2 == 0
    stores = [records.where(even), records.where(~even)]
    return rounded(utilization.host_reports(stores, ["a", "b"], utilization_config(), 2024, 1), "host", "user")


# -- accounting summaries ---------------------------------------------------------------

REPORTED_SQL = """
reported AS (
  SELECT s.report_site AS "Site", CAST(month(stop_time) AS INTEGER) AS "Month",
         CAST(year(stop_time) AS INTEGER) AS "Year", group_id AS "VO", substr(user_id, 2, 1) AS "SubmitHost",
         cores AS "Processors", 'grid' AS "Infrastructure", CAST(floor(epoch(stop_time)) AS BIGINT) AS stop,
         CAST(stop_time AS DATE) AS day, runtime,
         CAST(round_even(total_cpu / 4.0, 0) AS BIGINT) AS cpu, record_id
  FROM ev JOIN (VALUES ('EAST', 'site_1'), ('EAST', 'site_2'), ('WEST', 'site_3'), ('WEST', 'site_4'),
                       ('WEST', 'site_1')) s(report_site, id) ON ev.site = s.id
  WHERE runtime > 0 AND stop_time >= TIMESTAMP '2024-01-01' AND stop_time < TIMESTAMP '2024-02-01'
),
valued AS (
  SELECT *, CAST(round_even(CAST(runtime AS DOUBLE) * CAST(18.4 AS DOUBLE), 0) AS BIGINT) AS nwall,
         CAST(round_even(CAST(cpu AS DOUBLE) * CAST(18.4 AS DOUBLE), 0) AS BIGINT) AS ncpu FROM reported
)"""
MEASURES_SQL = """count(*) AS "NumberOfJobs", CAST(sum(runtime) AS BIGINT) AS "WallDuration",
  CAST(sum(cpu) AS BIGINT) AS "CpuDuration", CAST(sum(nwall) AS BIGINT) AS "NormalisedWallDuration",
  CAST(sum(ncpu) AS BIGINT) AS "NormalisedCpuDuration", min(stop) AS "EarliestEndTime",
  max(stop) AS "LatestEndTime\""""
SUMMARY_SQL = f"""SELECT "Site", "Month", "Year", "VO", "SubmitHost", "Processors", "Infrastructure",
  {MEASURES_SQL} FROM valued GROUP BY ALL"""


def reported_rows(spark, sf_dir, config=None):
    config = config or summary_config()
    start, end = month_bounds(2024, 1)
    return apel.reportable(event_records(spark, sf_dir), config, start, end)


@query(
    "p10_summary_rows",
    f"""WITH {REPORTED_SQL} SELECT "Site", "Month", "Year", stop AS "StopTime", runtime AS "WallDuration",
        record_id AS "RecordID", day AS "Day", "VO", "SubmitHost", "Processors", cpu AS "CpuDuration",
        nwall AS "NormalisedWallDuration", ncpu AS "NormalisedCpuDuration", "Infrastructure" FROM valued""",
)
def summary_rows(spark, sf_dir):
    return apel.summary_rows(reported_rows(spark, sf_dir), summary_config())


@query("a7_summary", f"WITH {REPORTED_SQL} {SUMMARY_SQL}")
def summary(spark, sf_dir):
    return apel.month_summary(event_records(spark, sf_dir), summary_config(), 2024, 1)


@query(
    "a8_sync",
    f"""WITH {REPORTED_SQL} SELECT "Site", "Month", "Year", "SubmitHost", count(*) AS "NumberOfJobs"
        FROM reported GROUP BY ALL""",
)
def sync(spark, sf_dir):
    return apel.sync(reported_rows(spark, sf_dir), summary_config())


@query("a9_merged_partials", f"WITH {REPORTED_SQL} {SUMMARY_SQL}")
def merged_partials(spark, sf_dir):
    config = summary_config()
    rows = apel.summary_rows(reported_rows(spark, sf_dir), config)
    return apel.merge_partials(apel.daily_partials(rows, config), config)


@query(
    "a9_daily_partials",
    f"""WITH {REPORTED_SQL} SELECT day AS "Day", "Site", "Month", "Year", "VO", "SubmitHost", "Processors",
        "Infrastructure", {MEASURES_SQL} FROM valued GROUP BY ALL""",
)
def daily_partials(spark, sf_dir):
    config = summary_config()
    return apel.daily_partials(apel.summary_rows(reported_rows(spark, sf_dir), config), config)


@query(
    "a11_site_totals",
    f"""WITH {REPORTED_SQL} SELECT "Site", "Month", "Year", count(*) AS "NumberOfJobs",
        CAST(sum(runtime) AS BIGINT) AS "WallDuration", CAST(sum(cpu) AS BIGINT) AS "CpuDuration",
        CAST(sum(nwall) AS BIGINT) AS "NormalisedWallDuration",
        CAST(sum(ncpu) AS BIGINT) AS "NormalisedCpuDuration" FROM valued GROUP BY ALL""",
)
def site_totals(spark, sf_dir):
    return apel.totals(summary(spark, sf_dir))


@query(
    "j12_site_assignment",
    f"""WITH {REPORTED_SQL} SELECT "Site" AS report_site, count(*) AS num FROM reported GROUP BY 1""",
)
def site_assignment(spark, sf_dir):
    return reported_rows(spark, sf_dir).groupBy("report_site").agg(F.count("*").alias("num"))


@query(
    "u2_union_over_ids",
    """SELECT CASE WHEN flag = 'A' THEN 'first' ELSE 'rest' END AS report_site,
              count(DISTINCT l_orderkey) AS num FROM flag GROUP BY 1""",
)
def union_over_ids(spark, sf_dir):
    from usageledger.operators.lookup import assign_report_sites

    # A record with the flags N and R belongs to "rest" once.
    sites = {"first": ["A"], "rest": ["N", "R"]}
    assigned = assign_report_sites(order_records(spark, sf_dir), sites, ["flags", "nowhere"])
    return assigned.groupBy("report_site").agg(F.count("*").alias("num"))


@query(
    "k10_message_blocks",
    f"""WITH {REPORTED_SQL}, s AS ({SUMMARY_SQL})
        SELECT "Site", "VO", 'Site: ' || "Site" || chr(10) || 'Month: ' || "Month" || chr(10) || 'Year: ' || "Year"
          || chr(10) || 'VO: ' || "VO" || chr(10) || 'SubmitHost: ' || "SubmitHost" || chr(10)
          || 'Infrastructure: ' || "Infrastructure" || chr(10) || 'Processors: ' || "Processors" || chr(10)
          || 'EarliestEndTime: ' || "EarliestEndTime" || chr(10) || 'LatestEndTime: ' || "LatestEndTime"
          || chr(10) || 'WallDuration: ' || "WallDuration" || chr(10) || 'CpuDuration: ' || "CpuDuration"
          || chr(10) || 'NormalisedWallDuration: {{HEPscore23: ' || "NormalisedWallDuration" || '}}' || chr(10)
          || 'NormalisedCpuDuration: {{HEPscore23: ' || "NormalisedCpuDuration" || '}}' || chr(10)
          || 'NumberOfJobs: ' || "NumberOfJobs" || chr(10) || '%%' AS value FROM s""",
)
def message_blocks(spark, sf_dir):
    return apel.message_blocks(summary(spark, sf_dir), "summary").select("Site", "VO", "value")

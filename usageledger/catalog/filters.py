"""Filters, order, limit and the query interface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageledger.catalog.registry import query
from usageledger.catalog.tables import event_records, order_records
from usageledger.functions.calendar import archive_cutoff, month_bounds
from usageledger.functions.records import component_amount, first_meta
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
from usageledger.operators.reshape import unconverted
from usageledger.operators.validity import split_valid, with_reasons
from usageledger.plans import apel, archive, priority, utilization
from usageledger.plans.store import one_record
from usageledger.schema import COMPONENTS_DDL

FLAT = "record_id, site, group_id, user_id, start_time, stop_time, runtime"


def flat(records: DataFrame, *more: str) -> DataFrame:
    return records.select(
        "record_id",
        first_meta("site").alias("site"),
        first_meta("group_id").alias("group_id"),
        first_meta("user_id").alias("user_id"),
        "start_time",
        "stop_time",
        "runtime",
        *more,
    )


def ask(q: RecordQuery, records: DataFrame) -> DataFrame:
    return flat(q.apply(records, ordered=q.limit_rows is not None))


JAN_10, JAN_20 = "2024-01-10T00:00:00", "2024-01-20T00:00:00"


# -- scans ---------------------------------------------------------------------


@query(
    "s1_get_records",
    "SELECT record_id, site, cores, total_cpu, start_time, stop_time, runtime FROM ev",
)
def get_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RecordQuery().apply(event_records(spark, sf_dir)).select(
        "record_id",
        first_meta("site").alias("site"),
        component_amount("Cores").alias("cores"),
        component_amount("TotalCPU").alias("total_cpu"),
        "start_time",
        "stop_time",
        "runtime",
    )


@query("s2_get_one_record", f"SELECT {FLAT} FROM ord WHERE record_id = 'order-17'")
def get_one_record(spark, sf_dir):
    return flat(one_record(order_records(spark, sf_dir), "order-17"))


@query("p1_record_projection", f"SELECT {FLAT} FROM ord")
def record_projection(spark, sf_dir):
    return flat(RecordQuery().apply(order_records(spark, sf_dir), ordered=False))


# -- field conditions ------------------------------------------------------------


@query("f1_record_id", f"SELECT {FLAT} FROM ev WHERE record_id = 'ev-42'")
def record_id(spark, sf_dir):
    return ask(RecordQuery().with_record_id("ev-42"), event_records(spark, sf_dir))


@query(
    "f2_start_time_range",
    f"""SELECT {FLAT} FROM ev
        WHERE start_time >= TIMESTAMP '2024-01-10' AND start_time < TIMESTAMP '2024-01-20'""",
)
def start_time_range(spark, sf_dir):
    q = RecordQuery().with_start_time(Operator().gte(JAN_10).lt(JAN_20).equals(JAN_10))
    return ask(q, event_records(spark, sf_dir))


@query(
    "f3_stop_time_range",
    f"""SELECT {FLAT} FROM ev
        WHERE stop_time > TIMESTAMP '2024-01-10' AND stop_time <= TIMESTAMP '2024-01-20'""",
)
def stop_time_range(spark, sf_dir):
    q = RecordQuery().with_stop_time(Operator().gt(JAN_10).lte(JAN_20))
    return ask(q, event_records(spark, sf_dir))


@query("f4_runtime", f"SELECT {FLAT} FROM ev WHERE runtime >= 20 AND runtime < 60")
def runtime(spark, sf_dir):
    return ask(RecordQuery().with_runtime(Operator().gte(20).lt(60)), event_records(spark, sf_dir))


@query("f4_runtime_equals", f"SELECT {FLAT} FROM ev WHERE runtime = 30")
def runtime_equals(spark, sf_dir):
    return ask(RecordQuery().with_runtime(Operator().equals(30)), event_records(spark, sf_dir))


@query(
    "f5_meta_contains",
    f"""SELECT {FLAT} FROM ord WHERE o_orderkey IN (
          SELECT l_orderkey FROM flag WHERE flag IN ('A', 'R')
          GROUP BY l_orderkey HAVING count(*) = 2)""",
)
def meta_contains(spark, sf_dir):
    wanted = MetaOperator().contains(["A", "R"])
    q = RecordQuery().with_meta_query(MetaQuery().meta_operator("flags", wanted))
    return ask(q, order_records(spark, sf_dir))


@query(
    "f6_meta_does_not_contain",
    f"""SELECT {FLAT} FROM ord
        WHERE o_orderkey IN (SELECT l_orderkey FROM flag)
          AND o_orderkey NOT IN (SELECT l_orderkey FROM flag WHERE flag = 'R')""",
)
def meta_does_not_contain(spark, sf_dir):
    unwanted = MetaOperator().does_not_contain(["R"])
    q = RecordQuery().with_meta_query(MetaQuery().meta_operator("flags", unwanted))
    return ask(q, order_records(spark, sf_dir))


@query("f7_component_first", f"SELECT {FLAT} FROM ev WHERE cores = 6")
def component_first(spark, sf_dir):
    q = ComponentQuery().component_operator("Cores", Operator().equals(6))
    return ask(RecordQuery().with_component_query(q), event_records(spark, sf_dir))


@query("f7_component_not_first", f"SELECT {FLAT} FROM ev WHERE false")
def component_not_first(spark, sf_dir):
    # The second component is not looked at.
    q = ComponentQuery().component_operator("TotalCPU", Operator().gte(0))
    return ask(RecordQuery().with_component_query(q), event_records(spark, sf_dir))


@query(
    "f7_component_any",
    f"SELECT {FLAT} FROM ev WHERE total_cpu >= 100 AND total_cpu < 1000 AND cores > 2",
)
def component_any(spark, sf_dir):
    components = (
        ComponentQuery()
        .component_operator("TotalCPU", Operator().gte(100).lt(1000))
        .component_operator("Cores", Operator().gt(2))
    )
    q = RecordQuery(component=components, component_scope="any")
    return ask(q, event_records(spark, sf_dir))


@query("f8_contradictory_bounds", f"SELECT {FLAT} FROM ev WHERE cores >= 3")
def contradictory_bounds(spark, sf_dir):
    # Two lower bounds on the runtime cancel that condition.
    q = RecordQuery().with_runtime(Operator().gt(10).gte(20))
    q = q.with_component_query(ComponentQuery().component_operator("Cores", Operator().gte(3)))
    return ask(q, event_records(spark, sf_dir))


@query("f9_row_access_any", f"SELECT {FLAT} FROM ev WHERE site IN ('site_1', 'site_3')")
def row_access_any(spark, sf_dir):
    return flat(authorize(event_records(spark, sf_dir), {"site": ["site_1", "site_3"]}))


@query(
    "f9_row_access_all",
    f"""SELECT {FLAT} FROM ord
        WHERE site IN ('NATION_1', 'NATION_2', 'NATION_3') AND o_orderkey IN (
          SELECT l_orderkey FROM flag WHERE flag IN ('A', 'N')
          GROUP BY l_orderkey HAVING count(*) = 2)""",
)
def row_access_all(spark, sf_dir):
    records = order_records(spark, sf_dir)
    by_site = authorize(records, {"site": ["NATION_1", "NATION_2", "NATION_3"]})
    return flat(authorize(by_site, {"flags": ["A", "N"]}, mode="all"))


@query(
    "f9_row_access_with_query",
    f"""SELECT {FLAT} FROM ev
        WHERE site IN ('site_1', 'site_3') AND site <> 'site_3' AND runtime > 50""",
)
def row_access_with_query(spark, sf_dir):
    unwanted = MetaOperator().does_not_contain(["site_3"])
    q = RecordQuery().with_meta_query(MetaQuery().meta_operator("site", unwanted))
    q = q.with_runtime(Operator().gt(50))
    allowed = {"site": ["site_1", "site_3"]}
    return ask(q, authorize(event_records(spark, sf_dir), allowed, q))


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of orders, some of them broken in one of the checked ways."""
    records = order_records(spark, sf_dir).withColumn(
        "kind", F.regexp_extract("record_id", "([0-9]+)$", 1).cast("bigint") % 7
    )
    kind = F.col("kind")
    broken = F.transform(
        "components", lambda c: c.withField("amount", F.when(kind == 2, -1).otherwise(c["amount"]))
    )
    broken = F.transform(
        broken,
        lambda c: c.withField(
            "scores",
            F.transform(
                c["scores"],
                lambda s: s.withField(
                    "value", F.when(kind == 3, -0.5).otherwise(s["value"])
                ),
            ),
        ),
    )
    return records.withColumns(
        {
            "record_id": F.when(kind == 1, F.concat(F.repeat(F.lit("x"), 250), "record_id"))
            .when(kind == 4, F.lit("  "))
            .otherwise(F.col("record_id")),
            "components": F.coalesce(broken, F.array().cast(COMPONENTS_DDL)),
        }
    ).drop("kind")


@query(
    "f10_validity_split",
    """SELECT CASE WHEN o_orderkey % 7 IN (1, 4) THEN 'record_id'
                   WHEN o_orderkey % 7 = 2 AND runtime IS NOT NULL THEN 'component amount'
                   WHEN o_orderkey % 7 = 3 AND runtime IS NOT NULL THEN 'score value'
                   ELSE 'valid' END AS reason,
              count(*) AS num
       FROM ord GROUP BY 1""",
)
def validity_split(spark, sf_dir):
    checked = with_reasons(_spoiled(spark, sf_dir))
    verdict = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("valid")))
    return (
        checked.select(F.explode(verdict).alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("num"))
    )


@query(
    "f10_valid_records",
    """SELECT CASE WHEN length(record_id) > 256 THEN NULL ELSE record_id END AS record_id, runtime FROM ord
       WHERE o_orderkey % 7 IN (0, 5, 6) OR o_orderkey % 7 IN (2, 3) AND runtime IS NULL""",
)
def valid_records(spark, sf_dir):
    valid, _ = split_valid(_spoiled(spark, sf_dir))
    return valid.select("record_id", "runtime")


@query(
    "f11_archive_range",
    f"SELECT {FLAT} FROM ord WHERE stop_time < TIMESTAMP '1998-03-01'",
)
def archive_range(spark, sf_dir):
    now = archive_cutoff(month_bounds(1998, 6)[0], 0).replace(day=15)
    return flat(archive.old_enough(order_records(spark, sf_dir), now, 3))


@query("f12_started_since", f"SELECT {FLAT} FROM ev WHERE start_time >= TIMESTAMP '2024-01-20'")
def since_start(spark, sf_dir):
    return ask(started_since(JAN_20), event_records(spark, sf_dir))


@query("f12_stopped_since", f"SELECT {FLAT} FROM ev WHERE stop_time >= TIMESTAMP '2024-01-20'")
def since_stop(spark, sf_dir):
    return ask(stopped_since(JAN_20), event_records(spark, sf_dir))


SITES = {"EAST": ["NATION_1", "NATION_2"], "WEST": ["NATION_3", "NATION_7"]}


def summary_config(**changes) -> apel.SummaryConfig:
    from usageledger.operators.fields import (
        ComponentField,
        ConstantField,
        MetaField,
        NormalisedField,
        ScoreField,
    )

    score = ScoreField("HEPscore23", "Cores")
    defaults = {
        "sites": {"EAST": ["site_1", "site_2"], "WEST": ["site_3", "site_4", "site_1"]},
        "site_meta_keys": ["site"],
        "mandatory": {
            "VO": MetaField("group_id"),
            "SubmitHost": MetaField("user_id", regex="(?<=u)[0-9]"),
            "Processors": ComponentField("Cores"),
            "CpuDuration": ComponentField("TotalCPU", divide_by=4),
            "NormalisedWallDuration": NormalisedField(score),
            "NormalisedCpuDuration": NormalisedField(
                score, ComponentField("TotalCPU", divide_by=4)
            ),
        },
        "optional": {"Infrastructure": ConstantField("grid")},
    }
    return apel.SummaryConfig(**{**defaults, **changes})


@query(
    "f19_summary_record_filter",
    """SELECT 'EAST' AS report_site, record_id, runtime FROM ord
       WHERE runtime > 0 AND site IN ('NATION_1', 'NATION_2')
         AND stop_time >= TIMESTAMP '1997-05-01' AND stop_time < TIMESTAMP '1997-06-01'
       UNION ALL
       SELECT 'WEST' AS report_site, record_id, runtime FROM ord
       WHERE runtime > 0 AND site IN ('NATION_3', 'NATION_7')
         AND stop_time >= TIMESTAMP '1997-05-01' AND stop_time < TIMESTAMP '1997-06-01'""",
)
def summary_record_filter(spark, sf_dir):
    config = summary_config(sites=SITES, site_meta_keys=["site", "flags"])
    start, end = month_bounds(1997, 5)
    reported = apel.reportable(order_records(spark, sf_dir), config, start, end)
    return reported.select("report_site", "record_id", "runtime")


@query(
    "f20_utilization_window",
    f"""SELECT {FLAT} FROM ev
        WHERE stop_time >= TIMESTAMP '2024-01-10' AND stop_time < TIMESTAMP '2024-01-20'""",
)
def utilization_window(spark, sf_dir):
    return flat(utilization.in_window(event_records(spark, sf_dir), JAN_10, JAN_20))


@query("f21_priority_window", f"SELECT {FLAT} FROM ev WHERE start_time >= TIMESTAMP '2024-01-10'")
def priority_window(spark, sf_dir):
    return flat(priority.since(event_records(spark, sf_dir), JAN_10))


@query(
    "f23_conversion_guard",
    """SELECT record_id FROM ord
       WHERE o_orderkey IN (SELECT l_orderkey FROM comp WHERE name = 'F')""",
)
def conversion_guard(spark, sf_dir):
    return order_records(spark, sf_dir).where(unconverted("F")).select("record_id")


# -- order and limit ---------------------------------------------------------------


def ranked(q: RecordQuery, records: DataFrame) -> DataFrame:
    """All records with their place in the order of a query."""
    return flat(q.rank(records), "rank")


def place(order: str, table: str) -> str:
    return f"SELECT {FLAT}, row_number() OVER (ORDER BY {order}) AS rank FROM {table}"


@query("o1_default_order_limit", place("stop_time ASC NULLS LAST, record_id", "ev"))
def default_order(spark, sf_dir):
    return ranked(RecordQuery(), event_records(spark, sf_dir))


@query("o2_sort_descending", place("runtime DESC NULLS FIRST, record_id", "ev"))
def sort_descending(spark, sf_dir):
    # Open records have no runtime and come first.
    return ranked(RecordQuery().sort_by(SortBy().descending("runtime")), event_records(spark, sf_dir))


@query("o2_sort_ascending_start", place("start_time ASC NULLS LAST, record_id", "ord"))
def sort_ascending(spark, sf_dir):
    return ranked(RecordQuery().sort_by(SortBy().ascending("start_time")), order_records(spark, sf_dir))


@query(
    "o3_top_k",
    f"SELECT {FLAT} FROM ord ORDER BY runtime DESC NULLS FIRST, record_id LIMIT 500",
)
def top_k(spark, sf_dir):
    q = RecordQuery().sort_by(SortBy().descending("runtime")).limit(500)
    return ask(q, order_records(spark, sf_dir))


# -- the query interface -------------------------------------------------------------


@query(
    "api1_query_builder",
    f"""SELECT {FLAT} FROM ev
        WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-25'
          AND site = 'site_2' AND cores >= 2 AND runtime < 100
        ORDER BY start_time DESC, record_id LIMIT 200""",
)
def query_builder(spark, sf_dir):
    q = (
        RecordQuery()
        .with_runtime(Operator().lt(1))
        .with_runtime(Operator().lt(100))
        .with_start_time(Operator().gte("2024-01-05T00:00:00").lt("2024-01-25T00:00:00"))
        .with_meta_query(MetaQuery().meta_operator("site", MetaOperator().contains(["site_2"])))
        .with_component_query(ComponentQuery().component_operator("Cores", Operator().gte(2)))
        .sort_by(SortBy().descending("start_time"))
        .limit(200)
    )
    return ask(q, event_records(spark, sf_dir))


@query(
    "api2_operators",
    f"SELECT {FLAT} FROM ev WHERE runtime > 5 AND runtime <= 80 AND stop_time < TIMESTAMP '2024-01-20'",
)
def operators(spark, sf_dir):
    q = RecordQuery.from_dict(
        {"runtime": {"gt": 5, "lte": 80}, "stop_time": {"lt": JAN_20, "equals": JAN_10}}
    )
    return ask(q, event_records(spark, sf_dir))


@query(
    "api3_meta_operators",
    f"""SELECT {FLAT} FROM ev WHERE group_id = 'view' AND site <> 'site_5' AND site <> 'site_6'""",
)
def meta_operators(spark, sf_dir):
    q = RecordQuery.from_dict(
        {"meta": {"group_id": {"c": ["view"]}, "site": {"dnc": ["site_5", "site_6"]}}}
    )
    return ask(q, event_records(spark, sf_dir))


@query("api4_component_query", f"SELECT {FLAT} FROM ev WHERE cores > 2 AND cores <= 5")
def component_query(spark, sf_dir):
    q = RecordQuery.from_dict({"component": {"Cores": {"gt": 2, "lte": 5}}})
    return ask(q, event_records(spark, sf_dir))


@query("api5_sort_by", place("record_id DESC", "ev"))
def sort_by(spark, sf_dir):
    return ranked(RecordQuery.from_dict({"sort_by": {"desc": "record_id"}}), event_records(spark, sf_dir))


# -- the read benchmark's queries ------------------------------------------------------

_B_START, _B_END = "2024-01-01T00:00:00", "2024-01-21T00:00:00"
_RANGE = "start_time >= TIMESTAMP '2024-01-01' AND start_time < TIMESTAMP '2024-01-21'"


def benchmark_query(number: int) -> RecordQuery:
    """The six read queries: all, range, range+site, component, and both mixes."""
    q = RecordQuery()
    if number == 1:
        return q.with_start_time(Operator().gte(_B_START))
    if number != 4:
        q = q.with_start_time(Operator().gte(_B_START).lt(_B_END))
    if number in (3, 5):
        site = MetaOperator().contains(["site_1"])
        q = q.with_meta_query(MetaQuery().meta_operator("site", site))
    if number == 6:
        group = MetaOperator().contains(["purchase"])
        q = q.with_meta_query(MetaQuery().meta_operator("group_id", group))
    if number in (4, 5, 6):
        q = q.with_component_query(
            ComponentQuery().component_operator("Cores", Operator().equals(6))
        )
    return q


_B_SQL = {
    1: "start_time >= TIMESTAMP '2024-01-01'",
    2: _RANGE,
    3: f"{_RANGE} AND site = 'site_1'",
    4: "cores = 6",
    5: f"{_RANGE} AND site = 'site_1' AND cores = 6",
    6: f"{_RANGE} AND group_id = 'purchase' AND cores = 6",
}


def _register_benchmark(number: int) -> None:
    @query(f"b{number}_read", f"SELECT {FLAT} FROM ev WHERE {_B_SQL[number]}")
    def read(spark, sf_dir):
        return flat(benchmark_query(number).apply(event_records(spark, sf_dir)))


for _number in _B_SQL:
    _register_benchmark(_number)

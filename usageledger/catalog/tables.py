"""The test tables as usage records and as scheduler output.

``events`` become records with one resource list each, ``orders`` with their
line items become records with aggregated lists.  Scheduler dumps, pods and
metric samples are written out of the same events, so that the collectors run
on data that grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usageledger.functions.records import make_component, make_score
from usageledger.schema import RECORD_COLUMNS

SITES = 6
QUEUES = ("short-cpu", "long-cpu", "test")
BENCHMARK = 18.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def later(moment: Column, seconds: Column) -> Column:
    zero = F.lit(0)
    return moment + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def event_columns(events: DataFrame) -> DataFrame:
    """Events with the values the adapters share."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    seconds = F.floor("value").cast("bigint")
    return events.select(
        "event_id",
        "ts",
        "event_type",
        F.col("user_id").alias("uid"),
        k.alias("k"),
        seconds.alias("seconds"),
        (k % 8 + 1).alias("cores"),
        # 50 to 99 per cent of the core time, so that daily efficiencies differ.
        F.floor(seconds * (k % 8 + 1) * (F.col("event_id") % 50 + 50) / 100).cast("bigint").alias("total_cpu"),
        F.concat(F.lit("site_"), (F.col("user_id") % SITES + 1).cast("string")).alias("site"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        later(F.col("ts"), seconds).alias("ended"),
    )


def to_event_records(events: DataFrame) -> DataFrame:
    is_open = F.col("event_type") == "error"
    scores = F.array(make_score("HEPscore23", F.lit(BENCHMARK)))
    return event_columns(events).select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("record_id"),
        F.create_map(
            F.lit("site"), F.array("site"),
            F.lit("group_id"), F.array("event_type"),
            F.lit("user_id"), F.array("user"),
        ).alias("meta"),
        F.array(
            make_component("Cores", F.col("cores"), scores),
            make_component("TotalCPU", F.col("total_cpu")),
        ).alias("components"),
        F.col("ts").alias("start_time"),
        F.when(~is_open, F.col("ended")).alias("stop_time"),
        F.when(~is_open, F.col("seconds")).alias("runtime"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_event_records(table(spark, sf_dir, "events"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt out by order once, then folded to at most a handful of rows per order before
    # lists are built.  Items without an order belong to no record.
    parts = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linestatus", "l_returnflag", "l_quantity", "l_discount")
        .where(F.col("l_orderkey").isNotNull())
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linestatus", "l_returnflag")
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.sum("l_discount").alias("discount"),
            F.count("*").alias("n"),
        )
    )
    lists = parts.groupBy("l_orderkey").agg(
        F.sum("quantity").cast("bigint").alias("hours"),
        F.collect_list(
            F.struct("l_linestatus", "l_returnflag", "quantity", "discount", "n")
        ).alias("parts"),
    )

    def total(status: Column, name: str) -> Column:
        def own(part: Column) -> Column:
            return F.when(part["l_linestatus"] == status, part[name]).otherwise(0.0)

        return F.aggregate("parts", F.lit(0.0), lambda acc, part: acc + own(part))

    statuses = F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["l_linestatus"])))
    components = F.transform(
        statuses,
        lambda status: F.struct(
            status.alias("name"),
            total(status, "quantity").cast("bigint").alias("amount"),
            F.array(
                make_score("discount", total(status, "discount") / total(status, "n"))
            ).alias("scores"),
        ),
    )
    flags = F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["l_returnflag"])))
    lists = lists.select(
        "l_orderkey", "hours", components.alias("components"), flags.alias("flags")
    )
    owners = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_mktsegment", "n_name")
    )
    joined = (
        table(spark, sf_dir, "orders")
        .join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(owners, F.col("o_custkey") == F.col("c_custkey"))
    )
    entries = F.array(
        F.struct(F.lit("site").alias("key"), F.array("n_name").alias("value")),
        F.struct(F.lit("group_id").alias("key"), F.array("c_mktsegment").alias("value")),
        F.struct(
            F.lit("user_id").alias("key"), F.array(F.col("c_custkey").cast("string")).alias("value")
        ),
        F.struct(F.lit("flags").alias("key"), F.col("flags").alias("value")),
    )
    return joined.select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("record_id"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("meta"),
        "components",
        F.col("o_orderdate").alias("start_time"),
        later(F.col("o_orderdate"), F.col("hours") * 3600).alias("stop_time"),
        (F.col("hours") * 3600).alias("runtime"),
    ).select(*RECORD_COLUMNS)


def zoned(records: DataFrame) -> DataFrame:
    """Times with a zone, as the store keeps them."""
    return records.withColumns(
        {
            "start_time": F.col("start_time").cast("timestamp"),
            "stop_time": F.col("stop_time").cast("timestamp"),
        }
    )


def plain_times(df: DataFrame) -> DataFrame:
    """Zoned times (UTC) as plain ones, for comparison with other engines."""
    zoned_names = [f.name for f in df.schema if f.dataType.typeName() == "timestamp"]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned_names})


# -- scheduler output out of events -------------------------------------------


def _clock(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def queue_of(uid: Column) -> Column:
    """Users are dealt over three queues; nobody accounts for the last one."""
    return F.element_at(F.array(*(F.lit(name) for name in QUEUES)), (uid % 3 + 1).cast("int"))


def slurm_lines(spark: SparkSession, sf_dir: str, pieces: int | None = None) -> DataFrame:
    """Two lines per event: the job, and its batch step that alone knows the CPU
    time; plus an ``extern`` step that must be ignored.  With ``pieces`` the lines
    are spread over so many partitions, whatever job they belong to.

    Columns: Partition | Comment | NCPUS | ReqMem | TotalCPU | JobID | Start |
    End | Group | User | State.
    """
    e = event_columns(table(spark, sf_dir, "events"))
    job = F.col("event_id").cast("string")
    cpu = F.concat_ws(
        ":",
        F.lpad((F.col("seconds") / 3600).cast("int").cast("string"), 2, "0"),
        F.lpad((F.col("seconds") / 60 % 60).cast("int").cast("string"), 2, "0"),
        F.lpad((F.col("seconds") % 60).cast("string"), 2, "0"),
    )
    comment = F.when(
        F.col("k") % 2 == 0,
        F.concat(F.lit("{'voms': '/atlas/Role="), F.col("event_type"), F.lit("', 'k': '"),
                 F.col("k").cast("string"), F.lit("'}")),
    ).otherwise("")
    state = F.when(F.col("event_type") == "error", "CANCELLED by 1000").otherwise("COMPLETED")
    # Cancelled jobs with an odd k never started.
    started = F.when(
        (F.col("event_type") == "error") & (F.col("k") % 2 == 1), F.lit("Unknown")
    ).otherwise(_clock(F.col("ts")))
    ended = _clock(F.col("ended"))
    partition = queue_of(F.col("uid"))
    memory = F.concat((F.col("cores") * 2000).cast("string"), F.lit("M"))

    def line(*cells: Column) -> Column:
        return F.concat_ws("|", *cells)

    none = F.lit("")
    lines = F.array(
        line(partition, comment, F.col("cores").cast("string"), memory, none, job, started, ended,
             F.col("event_type"), F.col("user"), state),
        line(none, none, F.col("cores").cast("string"), none, cpu, F.concat(job, F.lit(".batch")),
             started, ended, none, none, state),
        line(none, none, F.lit("1"), none, none, F.concat(job, F.lit(".extern")), started, ended,
             none, none, state),
    )
    dump = e.select(F.explode(lines).alias("value"))
    return dump if pieces is None else dump.repartition(pieces, "value")


def detail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``Key=Value`` text per event; the user id occurs twice."""
    e = event_columns(table(spark, sf_dir, "events"))
    return e.select(
        F.concat(
            F.lit("JobId="), F.col("event_id").cast("string"),
            F.lit(" JobName=run=1\n   UserId=nobody(0) GroupId="), F.col("event_type"),
            F.lit("(100) StartTime="), _clock(F.col("ts")),
            F.lit("\n   EndTime="), _clock(F.col("ended")),
            F.lit(" Partition="), queue_of(F.col("uid")),
            F.lit("\n NumCPUs="), F.col("cores").cast("string"),
            F.lit(" UserId="), F.col("user"), F.lit("(1000)"),
        ).alias("value")
    )


CONDOR_ADS = (
    "GlobalJobId", "ClusterId", "ProcId", "LastMatchTime", "CompletionDate", "EpochWriteDate",
    "EnteredCurrentStatus", "JobStatus", "Owner", "VoName", "LastRemoteHost", "CpusProvisioned",
    "MachineAttrApelSpecs0", "RemoteUserCpu",
)


def condor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history row per event, with undefined and zero cells."""
    e = event_columns(table(spark, sf_dir, "events"))
    number = F.col("event_id").cast("string")
    start = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    stop = F.unix_seconds(F.col("ended").cast("timestamp")).cast("string")
    is_open = F.col("event_type") == "error"
    cells = [
        F.concat(F.lit("submit#"), number, F.lit(".0#"), start),
        number,
        F.lit("0"),
        F.when(F.col("k") == 0, F.lit("undefined")).otherwise(start),
        F.when(is_open, F.lit("0")).otherwise(stop),
        F.lit("undefined"),
        F.when(is_open & (F.col("k") % 2 == 0), stop).otherwise("0"),
        F.when(is_open, F.lit("3")).otherwise("4"),
        F.col("user"),
        F.when(F.col("k") % 5 == 0, F.lit("undefined")).otherwise(F.col("event_type")),
        F.concat(F.lit("slot1@"), F.col("site")),
        F.col("cores").cast("string"),
        F.lit("HEPSPEC: 9.5 HEPscore23: 18.4"),
        (F.col("seconds") + 0.5).cast("string"),
    ]
    return e.select(
        F.concat_ws(" , ", *cells).alias("value"),
        F.concat(F.lit("schedd"), (F.col("uid") % 3).cast("string")).alias("schedd"),
    )


def pod_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pod object per event as JSON text; errors are still running, a pod
    with k below 10 has a container without an end."""
    e = event_columns(table(spark, sf_dir, "events"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ended = F.date_format("ended", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    name = F.concat(F.lit("pod-"), F.col("event_id").cast("string"))

    def resources(cpu: Column, memory: Column) -> Column:
        return F.struct(
            F.create_map(F.lit("cpu"), cpu, F.lit("memory"), memory).alias("limits")
        )

    main = resources(F.concat((F.col("cores") * 500).cast("string"), F.lit("m")), F.lit("2Gi"))
    side = resources(F.lit("1"), F.lit("512Mi"))

    def status(container: str, own, end: Column) -> Column:
        return F.struct(
            F.lit(container).alias("name"),
            own.alias("resources"),
            F.struct(
                F.struct(stamp.alias("startedAt"), end.alias("finishedAt")).alias("terminated")
            ).alias("state"),
        )

    pod = F.struct(
        F.struct(
            name.alias("name"),
            F.col("site").alias("namespace"),
            F.concat(F.lit("uid-"), F.col("event_id").cast("string")).alias("uid"),
            F.create_map(F.lit("app"), F.col("event_type")).alias("labels"),
        ).alias("metadata"),
        F.struct(
            F.array(
                F.struct(F.lit("main").alias("name"), main.alias("resources")),
                F.struct(F.lit("side").alias("name"), side.alias("resources")),
            ).alias("containers")
        ).alias("spec"),
        F.struct(
            F.when(F.col("event_type") == "error", "Running").otherwise("Succeeded").alias("phase"),
            stamp.alias("startTime"),
            F.array(
                # The main container's own status carries no limits.
                status("main", F.when(F.lit(False), main), ended),
                status("side", side, F.when(F.col("k") >= 10, ended)),
            ).alias("containerStatuses"),
        ).alias("status"),
    )
    return e.select(F.to_json(pod).alias("value"))


def pod_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pods of a user, each alive for the six hours after a signup."""
    e = event_columns(table(spark, sf_dir, "events")).where(F.col("event_type") == "signup")
    return e.select(
        F.concat(F.lit("pod-"), F.col("event_id").cast("string")).alias("record_id"),
        F.col("site").alias("namespace"),
        F.col("user").alias("pod"),
        F.col("ts").alias("start_time"),
        later(F.col("ts"), F.lit(6 * 3600)).alias("stop_time"),
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter and a gauge sample per event; the counter drops now and then."""
    e = event_columns(table(spark, sf_dir, "events"))
    samples = F.array(
        F.struct(
            F.lit("pod_cpu_usage_seconds_total").alias("metric"),
            F.col("k").cast("double").alias("value"),
        ),
        F.struct(
            F.lit("pod_memory_working_set_bytes").alias("metric"),
            (F.col("seconds") * 1024).cast("double").alias("value"),
        ),
    )
    return e.select(
        F.col("site").alias("namespace"),
        F.col("user").alias("pod"),
        F.concat(F.lit("series-"), (F.col("k") % 2).cast("string")).alias("series"),
        F.col("ts"),
        F.explode(samples).alias("sample"),
    ).select("namespace", "pod", "series", "sample.metric", "ts", "sample.value")


# -- the same in SQL -----------------------------------------------------------

EVENTS_SQL = """
ev AS (
  SELECT 'ev-' || CAST(event_id AS VARCHAR) AS record_id,
         'site_' || CAST(uid % 6 + 1 AS VARCHAR) AS site,
         event_type AS group_id,
         'u' || CAST(uid AS VARCHAR) AS user_id,
         k % 8 + 1 AS cores,
         (seconds * (k % 8 + 1) * (event_id % 50 + 50)) // 100 AS total_cpu,
         ts AS start_time,
         CASE WHEN event_type <> 'error' THEN ts + to_seconds(seconds) END AS stop_time,
         CASE WHEN event_type <> 'error' THEN seconds END AS runtime,
         ts + to_seconds(seconds) AS ended,
         event_id, uid, k, seconds
  FROM (SELECT event_id, ts, user_id AS uid, event_type,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(floor(value) AS BIGINT) AS seconds
        FROM events) e
)"""

ORDERS_SQL = """
comp AS (
  SELECT l_orderkey, l_linestatus AS name, CAST(sum(l_quantity) AS BIGINT) AS amount,
         avg(l_discount) AS discount
  FROM lineitem GROUP BY l_orderkey, l_linestatus
),
hours AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS hours FROM lineitem GROUP BY l_orderkey),
flag AS (SELECT DISTINCT l_orderkey, l_returnflag AS flag FROM lineitem),
ord AS (
  SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS record_id, n_name AS site,
         c_mktsegment AS group_id, CAST(c_custkey AS VARCHAR) AS user_id,
         o_orderkey, o_orderdate AS start_time,
         o_orderdate + to_hours(hours) AS stop_time, hours * 3600 AS runtime
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN hours ON l_orderkey = o_orderkey
)"""

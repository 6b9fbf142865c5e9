"""Collectors and enrichment, on scheduler output written out of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from usageledger.catalog.registry import query
from usageledger.catalog.tables import (
    CONDOR_ADS,
    QUEUES,
    condor_lines,
    detail_texts,
    metric_samples,
    pod_spans,
    pod_texts,
    slurm_lines,
)
from usageledger.functions.calendar import month_bounds
from usageledger.functions.records import component_amount, first_meta, meta_values, score_value
from usageledger.operators import intervals
from usageledger.plans import enrichment
from usageledger.session import scratch_path
from usageledger.sources import htcondor, kubernetes, slurm, slurm_detail
from usageledger.sources.htcondor import CondorComponent, CondorConfig, Getter
from usageledger.sources.records import read_samples
from usageledger.sources.rules import (
    ComponentRule,
    MetaRule,
    OnlyIf,
    ScoreRule,
    SiteRule,
    first_site,
)

# -- Slurm dump -----------------------------------------------------------------------

# Short jobs run at one site on the newer machines, long ones at another; a speed score
# covers every production queue, and short jobs get a second one.
SHORT, LONG = OnlyIf("Partition", "^short-"), OnlyIf("Partition", "^long-")
PRODUCTION = OnlyIf("Partition", "-cpu$")
SLURM = slurm.SlurmConfig(
    sites=(SiteRule("harbour", SHORT), SiteRule("quarry", PRODUCTION)),
    meta=(MetaRule("Comment", "Comment", "Json", allow_empty=True),),
    components=(
        ComponentRule(
            "Cores",
            "NCPUS",
            scores=(ScoreRule("speed", 7.5, PRODUCTION), ScoreRule("turbo", 9.25, SHORT)),
        ),
        ComponentRule("Memory", "ReqMem", "IntegerMega"),
        ComponentRule("TotalCPU", "TotalCPU", "Time"),
        ComponentRule("Priority", "Priority", default_value=5, only_if=LONG),
    ),
    job_filter=slurm.JobFilter(status=("completed", "cancelled")),
)
# The dump has no column for the last component: its key stays empty.
DUMP = slurm.SlurmConfig(
    sites=SLURM.sites,
    meta=SLURM.meta,
    components=SLURM.components[:3],
    job_filter=SLURM.job_filter,
)
NEVER_STARTED = "group_id = 'error' AND k % 2 = 1"
SLURM_SQL = f"""
SELECT 'slurm-' || CAST(event_id AS VARCHAR) AS record_id,
       CASE uid % 3 WHEN 0 THEN 'harbour' ELSE 'quarry' END AS site, user_id, group_id,
       CASE WHEN k % 2 = 0 THEN '/atlas/Role=' || group_id END AS voms,
       cores, cores * 2000 AS memory, seconds AS cpu,
       7.5::DOUBLE AS score, CASE uid % 3 WHEN 0 THEN 9.25::DOUBLE END AS turbo,
       date_trunc('second', start_time) AS start_time, date_trunc('second', ended) AS stop_time
FROM ev WHERE uid % 3 IN (0, 1) AND NOT ({NEVER_STARTED})"""


def slurm_flat(records):
    return records.select(
        "record_id",
        first_meta("site_id").alias("site"),
        first_meta("user_id").alias("user_id"),
        first_meta("group_id").alias("group_id"),
        first_meta("voms").alias("voms"),
        component_amount("Cores").alias("cores"),
        component_amount("Memory").alias("memory"),
        component_amount("TotalCPU").alias("cpu"),
        score_value("Cores", "speed").alias("score"),
        score_value("Cores", "turbo").alias("turbo"),
        "start_time",
        "stop_time",
    )


def _rows(spark, sf_dir):
    return slurm.split_lines(slurm_lines(spark, sf_dir), DUMP)


def _jobs(spark, sf_dir):
    return slurm.merge_steps(_rows(spark, sf_dir), DUMP)


@query(
    "s5_slurm_dump",
    """SELECT CAST(event_id AS VARCHAR) AS job, cores, CAST(NULL AS VARCHAR) AS cpu, group_id AS account FROM ev
       UNION ALL SELECT CAST(event_id AS VARCHAR) || '.batch', cores,
         '00:' || lpad(CAST(seconds // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(seconds % 60 AS VARCHAR), 2, '0'),
         NULL FROM ev
       UNION ALL SELECT CAST(event_id AS VARCHAR) || '.extern', 1, NULL, NULL FROM ev""",
)
def slurm_dump(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        F.col("JobID").alias("job"),
        slurm.parse_value(F.col("NCPUS"), "Integer").alias("cores"),
        F.col("TotalCPU").alias("cpu"),
        F.col("Group").alias("account"),
    )


@query("f14_step_filter", "SELECT CAST(event_id AS VARCHAR) AS job FROM ev")
def step_filter(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.where(~F.col("JobID").rlike(slurm.STEP_ID)).select(F.col("JobID").alias("job"))


@query(
    "j6_job_with_batch_step",
    """SELECT CAST(event_id AS VARCHAR) AS job, user_id, seconds AS cpu FROM ev""",
)
def job_with_batch_step(spark, sf_dir):
    return _jobs(spark, sf_dir).select(
        F.col("JobID").alias("job"),
        F.col("User").alias("user_id"),
        F.col("TotalCPU").alias("cpu"),
    )


@query(
    "f15_cancelled_before_start",
    f"SELECT CAST(event_id AS VARCHAR) AS job FROM ev WHERE NOT ({NEVER_STARTED})",
)
def cancelled_before_start(spark, sf_dir):
    return slurm.started_or_kept(_jobs(spark, sf_dir)).select(F.col("JobID").alias("job"))


@query(
    "f13_job_filters",
    """SELECT CAST(event_id AS VARCHAR) AS job FROM ev WHERE group_id IN ('click', 'view')
       AND uid % 3 <> 2 AND user_id IN ('u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7')""",
)
def job_filters(spark, sf_dir):
    wanted = slurm.JobFilter(
        status=("completed",),
        partition=QUEUES[:2],
        user=tuple(f"u{number}" for number in range(1, 8)),
        group=("click", "view", "error"),
    )
    return slurm.filter_jobs(_jobs(spark, sf_dir), wanted).select(F.col("JobID").alias("job"))


@query(
    "f16_only_if",
    """SELECT CAST(event_id AS VARCHAR) AS job, CASE WHEN uid % 3 < 2 THEN 7.5::DOUBLE END
       AS score, CASE uid % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS scores FROM ev""",
)
def only_if(spark, sf_dir):
    from usageledger.sources.rules import scores_of

    rules = SLURM.components[0].scores
    jobs = _jobs(spark, sf_dir).withColumn("scores", scores_of(rules, F.col))
    return jobs.select(
        F.col("JobID").alias("job"),
        F.try_element_at("scores", F.lit(1))["value"].alias("score"),
        F.size("scores").alias("scores"),
    )


@query(
    "p17_site",
    """SELECT CAST(event_id AS VARCHAR) AS job, CASE uid % 3 WHEN 0 THEN 'harbour' WHEN 1 THEN 'quarry' END AS site
       FROM ev""",
)
def site(spark, sf_dir):
    return _jobs(spark, sf_dir).select(
        F.col("JobID").alias("job"), first_site(SLURM.sites, F.col).alias("site")
    )


@query(
    "p12_components",
    f"""SELECT 'slurm-' || CAST(event_id AS VARCHAR) AS record_id,
               CASE uid % 3 WHEN 0 THEN 'Cores,Memory,TotalCPU' ELSE 'Cores,Memory,TotalCPU,Priority' END AS names,
               CASE uid % 3 WHEN 0 THEN NULL ELSE 5 END AS priority
        FROM ev WHERE uid % 3 IN (0, 1) AND NOT ({NEVER_STARTED})""",
)
def components(spark, sf_dir):
    # The fourth component has no value anywhere: its default applies.
    jobs = slurm.started_or_kept(_jobs(spark, sf_dir))
    records = slurm.to_records(jobs.withColumn("Priority", F.lit(None).cast("bigint")), SLURM)
    return records.select(
        "record_id",
        F.array_join(F.transform("components", lambda c: c["name"]), ",").alias("names"),
        component_amount("Priority").alias("priority"),
    )


@query("p11_slurm_records", SLURM_SQL)
def slurm_records(spark, sf_dir):
    return slurm_flat(slurm.collect(slurm_lines(spark, sf_dir), DUMP))


# -- Slurm job detail -------------------------------------------------------------------

DETAIL = slurm_detail.DetailConfig(
    "here",
    components=(ComponentRule("Cores", "NumCPUs", scores=(ScoreRule("turbo", 9.25, SHORT),)),),
)


@query(
    "s6_job_detail",
    """SELECT CAST(event_id AS VARCHAR) AS job, 'run=1' AS name, user_id || '(1000)' AS account,
              CAST(8 AS BIGINT) AS keys FROM ev""",
)
def job_detail(spark, sf_dir):
    return detail_texts(spark, sf_dir).select(
        slurm_detail.detail("JobId").alias("job"),
        slurm_detail.detail("JobName").alias("name"),
        F.try_element_at(slurm_detail.details_map(), F.lit("UserId")).alias("account"),
        F.size(slurm_detail.details_map()).cast("bigint").alias("keys"),
    )


@query(
    "p13_detail_records",
    """SELECT 'slurm-' || CAST(event_id AS VARCHAR) AS record_id, 'here' AS site, user_id, group_id, cores,
              CASE uid % 3 WHEN 0 THEN 9.25::DOUBLE END AS score,
              date_trunc('second', start_time) AS start_time, date_trunc('second', ended) AS stop_time FROM ev""",
)
def detail_records(spark, sf_dir):
    return slurm_detail.to_records(detail_texts(spark, sf_dir), DETAIL).select(
        "record_id",
        first_meta("site_id").alias("site"),
        first_meta("user_id").alias("user_id"),
        first_meta("group_id").alias("group_id"),
        component_amount("Cores").alias("cores"),
        score_value("Cores", "turbo").alias("score"),
        "start_time",
        "stop_time",
    )


# -- HTCondor ---------------------------------------------------------------------------

NEAR = OnlyIf("LastRemoteHost", "^slot1@site_[123]$")
CONDOR = CondorConfig(
    class_ads=CONDOR_ADS,
    meta={
        "user": [Getter(key="Owner", matches="^(.+)$")],
        "group": [Getter(key="VoName", matches="^(.+)$")],
        "submithost": [Getter(key="GlobalJobId", matches="^([^#]+)#")],
        "site": [
            Getter(name="near", key="LastRemoteHost", matches="^slot1@site_1$"),
            Getter(name="UNDEF"),
        ],
        "labels": [Getter(key="Owner"), Getter(key="VoName"), Getter(name="fixed")],
    },
    components=[
        CondorComponent(
            Getter("Cores", "CpusProvisioned"),
            (
                Getter(
                    "HEPscore23",
                    "MachineAttrApelSpecs0",
                    matches="HEPscore23: ([0-9.]+)",
                    only_if=NEAR,
                ),
            ),
        ),
        CondorComponent(Getter("UserCPU", "RemoteUserCpu")),
    ],
)


def _history(spark, sf_dir):
    return htcondor.split_history(condor_lines(spark, sf_dir), CONDOR)


@query(
    "s7_condor_history",
    """SELECT 'submit#' || event_id || '.0#' || CAST(floor(epoch(start_time)) AS BIGINT) AS id,
              user_id AS owner, CAST(cores AS VARCHAR) AS cores FROM ev""",
)
def condor_history(spark, sf_dir):
    return _history(spark, sf_dir).select(
        F.col("GlobalJobId").alias("id"),
        F.col("Owner").alias("owner"),
        F.col("CpusProvisioned").alias("cores"),
    )


@query(
    "f17_history_filter",
    """SELECT event_id FROM ev WHERE group_id <> 'error' AND floor(epoch(ended)) > 1705000000""",
)
def history_filter(spark, sf_dir):
    config = CondorConfig(
        CONDOR.class_ads, CONDOR.meta, CONDOR.components, job_status=(3, 4), since=1705000000
    )
    return htcondor.filter_history(_history(spark, sf_dir), config).select(
        F.col("ClusterId").cast("bigint").alias("event_id")
    )


@query(
    "f17_constraint",
    "SELECT event_id FROM ev WHERE user_id <> 'u1' AND cores >= 4 AND k % 5 > 0",
)
def history_constraint(spark, sf_dir):
    wanted = "Owner <> 'u1' AND CAST(CpusProvisioned AS INT) >= 4 AND VoName IS NOT NULL"
    config = CondorConfig(CONDOR.class_ads, CONDOR.meta, CONDOR.components, constraint=wanted)
    return htcondor.filter_history(_history(spark, sf_dir), config).select(
        F.col("ClusterId").cast("bigint").alias("event_id")
    )


@query(
    "f17_after_marks",
    """WITH marks AS (SELECT uid % 3 AS schedd, max(event_id) AS mark FROM ev
                      WHERE uid % 3 < 2 AND start_time < TIMESTAMP '2024-01-15' GROUP BY 1)
       SELECT event_id FROM ev LEFT JOIN marks ON ev.uid % 3 = marks.schedd
       WHERE mark IS NULL OR event_id > mark""",
)
def history_after_marks(spark, sf_dir):
    """Two schedulers go on behind their own last job, the third starts anew."""
    jobs = _history(spark, sf_dir)
    cutoff = F.lit("2024-01-15").cast("timestamp")
    seen = F.timestamp_seconds(F.substring_index("GlobalJobId", "#", -1).cast("bigint"))
    known = jobs.where((F.col("schedd") != "schedd2") & (seen < cutoff))
    left = htcondor.after_marks(jobs, htcondor.next_marks(known))
    return left.select(F.col("ClusterId").cast("bigint").alias("event_id"))


@query(
    "p14_condor_records",
    """SELECT 'htcondor-submit#' || event_id || '.0#' || CAST(floor(epoch(start_time)) AS BIGINT) AS record_id,
              user_id, CASE WHEN k % 5 > 0 THEN group_id END AS group_id, cores, seconds AS cpu,
              date_trunc('second', start_time) AS start_time,
              CASE WHEN group_id = 'error' AND k % 2 = 1 THEN TIMESTAMP '1970-01-01'
                   ELSE date_trunc('second', ended) END AS stop_time,
              NOT (group_id = 'error' AND k % 2 = 1) AS has_stop
       FROM ev WHERE k <> 0""",
)
def condor_records(spark, sf_dir):
    return htcondor.collect(condor_lines(spark, sf_dir), CONDOR).select(
        "record_id",
        first_meta("user").alias("user_id"),
        first_meta("group").alias("group_id"),
        component_amount("Cores").alias("cores"),
        component_amount("UserCPU").alias("cpu"),
        "start_time",
        "stop_time",
        "has_stop",
    )


@query(
    "p15_configured_values",
    """SELECT event_id, 'submit' AS host, CASE WHEN site = 'site_1' THEN 'near' END AS near,
              CASE WHEN site IN ('site_1', 'site_2', 'site_3') THEN 18.4::DOUBLE ELSE 0 END AS score,
              CASE WHEN k % 5 > 0 THEN group_id END AS vo, '2.5' AS factor FROM ev""",
)
def configured_values(spark, sf_dir):
    def value(getter):
        return htcondor.value_of(getter, CONDOR_ADS)

    score = CONDOR.components[0].scores[0]
    return _history(spark, sf_dir).select(
        F.col("ClusterId").cast("bigint").alias("event_id"),
        value(CONDOR.meta["submithost"][0]).alias("host"),
        value(CONDOR.meta["site"][0]).alias("near"),
        htcondor.score_of(value(score)).alias("score"),
        value(Getter(key="VoName")).alias("vo"),
        value(Getter(name="x", factor=2.5)).alias("factor"),
    )


@query(
    "p16_meta_lists",
    """SELECT event_id, CASE WHEN site = 'site_1' THEN 'near' ELSE 'UNDEF' END AS site,
              user_id || CASE WHEN k % 5 > 0 THEN ',' || group_id ELSE '' END || ',fixed' AS labels,
              CAST(CASE WHEN k % 5 > 0 THEN 5 ELSE 4 END AS BIGINT) AS keys FROM ev""",
)
def meta_lists(spark, sf_dir):
    jobs = _history(spark, sf_dir).withColumn("meta", htcondor.meta_of(CONDOR))
    return jobs.select(
        F.col("ClusterId").cast("bigint").alias("event_id"),
        F.array_join(meta_values("site"), ",").alias("site"),
        F.array_join(meta_values("labels"), ",").alias("labels"),
        F.size("meta").cast("bigint").alias("keys"),
    )


@query(
    "t2_condor_marks",
    """SELECT 'schedd' || CAST(uid % 3 AS VARCHAR) AS schedd, max(event_id) AS cluster,
              CAST(0 AS BIGINT) AS proc FROM ev GROUP BY 1""",
)
def condor_marks(spark, sf_dir):
    return htcondor.next_marks(_history(spark, sf_dir))


# -- Kubernetes -------------------------------------------------------------------------


def _pods(spark, sf_dir):
    return kubernetes.parse_pods(pod_texts(spark, sf_dir))


POD_SQL = """
SELECT 'kubernetes-' || site || '-pod-' || event_id || '-uid-' || event_id AS record_id,
       'pod-' || event_id AS podname, site AS namespace, 'Succeeded' AS status,
       (seconds * cores * 500 + seconds * 1000) // 1000 AS cpu_time, 2684354560 AS memory,
       date_trunc('milliseconds', start_time) AS start_time, date_trunc('milliseconds', ended) AS stop_time
FROM ev WHERE group_id <> 'error' AND k >= 10"""


def pod_flat(records):
    return records.select(
        "record_id",
        first_meta("podname").alias("podname"),
        first_meta("namespace").alias("namespace"),
        first_meta("status").alias("status"),
        component_amount("naive_cpu_time").alias("cpu_time"),
        component_amount("memory_limit").alias("memory"),
        "start_time",
        "stop_time",
    )


@query("s8_pod_list", "SELECT 'pod-' || event_id AS name, site AS namespace, group_id AS app FROM ev")
def pod_list(spark, sf_dir):
    folder = scratch_path(spark, "pods")
    pod_texts(spark, sf_dir).write.text(folder)
    return kubernetes.read_pods(spark, folder).select(
        "metadata.name", "metadata.namespace", F.col("metadata.labels")["app"].alias("app")
    )


@query("p18_pod_records", POD_SQL)
def pod_records(spark, sf_dir):
    return pod_flat(kubernetes.to_records(_pods(spark, sf_dir)))


@query(
    "u3_pods_of_namespaces",
    "SELECT site AS namespace, count(*) AS num FROM ev WHERE group_id <> 'error' AND k >= 10 GROUP BY site",
)
def pods_of_namespaces(spark, sf_dir):
    folder = scratch_path(spark, "namespaces")
    texts = pod_texts(spark, sf_dir)
    space = F.get_json_object("value", "$.metadata.namespace")
    texts.withColumn("space", space).write.partitionBy("space").text(folder)
    paths = [f"{folder}/space=site_{number}" for number in range(1, 7)]
    records = kubernetes.to_records(kubernetes.read_pods(spark, paths))
    return records.groupBy(first_meta("namespace").alias("namespace")).agg(
        F.count("*").alias("num")
    )


@query(
    "f18_pod_filter",
    """SELECT 'kubernetes-' || site || '-pod-' || event_id || '-uid-' || event_id AS record_id FROM ev
       WHERE group_id = 'view' AND site IN ('site_1', 'site_4') AND k >= 10
         AND date_trunc('milliseconds', ended) > TIMESTAMP '2024-01-10'""",
)
def pod_filter(spark, sf_dir):
    pods = kubernetes.filter_pods(_pods(spark, sf_dir), {"app": "view"}, ["site_1", "site_4"])
    since = month_bounds(2024, 1)[0].replace(day=10)
    return kubernetes.to_records(pods, last_check=since).select("record_id")


@query(
    "p19_pod_components",
    """SELECT 'pod-' || event_id AS name,
              CASE WHEN k >= 10 THEN (seconds * cores * 500 + seconds * 1000) // 1000 END AS cpu_time,
              CASE WHEN k >= 10 THEN 2684354560 END AS memory FROM ev""",
)
def pod_components(spark, sf_dir):
    pods = _pods(spark, sf_dir).withColumn("components", kubernetes.pod_components())
    return pods.select(
        "metadata.name",
        component_amount("naive_cpu_time").alias("cpu_time"),
        component_amount("memory_limit").alias("memory"),
    )


@query(
    "j7_container_limits",
    """SELECT 'pod-' || event_id AS name, cores * 500 AS main_cpu, 1000 AS side_cpu,
              2147483648000 AS main_memory FROM ev""",
)
def container_limits(spark, sf_dir):
    pods = _pods(spark, sf_dir).withColumn("limits", kubernetes.limits())
    return pods.select(
        "metadata.name",
        F.col("limits")[0]["cpu"].alias("main_cpu"),
        F.col("limits")[1]["cpu"].alias("side_cpu"),
        F.col("limits")[0]["memory"].alias("main_memory"),
    )


# -- enrichment ---------------------------------------------------------------------------

POINTS_SQL = """
points AS (
  SELECT 'pod-' || CAST(p.event_id AS VARCHAR) AS record_id, 'series-' || CAST(s.k % 2 AS VARCHAR) AS series,
         s.start_time AS ts, max(s.k) AS counter, max(s.seconds * 1024) AS gauge
  FROM ev p JOIN ev s ON p.site = s.site AND p.user_id = s.user_id
  WHERE p.group_id = 'signup' AND s.start_time >= p.start_time - INTERVAL 1 SECOND
    AND s.start_time <= p.start_time + INTERVAL 6 HOUR
  GROUP BY 1, 2, 3
),
steps AS (
  SELECT *, counter - lag(counter) OVER (PARTITION BY record_id, series ORDER BY ts) AS delta FROM points
),
per_series AS (
  SELECT record_id, series, count(*) AS n, max(gauge) AS gauge,
         sum(CASE WHEN delta < 0 THEN counter ELSE coalesce(delta, 0) END) AS increase
  FROM steps GROUP BY 1, 2
),
measured AS (
  SELECT record_id, CAST(sum(CASE WHEN n >= 2 THEN increase END) AS BIGINT) AS cpu,
         CAST(sum(gauge) AS BIGINT) AS memory
  FROM per_series GROUP BY 1
)"""


@query(
    "s9_metric_samples",
    """SELECT site AS namespace, count(*) AS num, CAST(sum(k) AS DOUBLE) AS total FROM ev GROUP BY site""",
)
def samples(spark, sf_dir):
    folder = scratch_path(spark, "samples")
    metric_samples(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(
        folder
    )
    stored = read_samples(spark, folder).where(F.col("metric") == enrichment.CPU_METRIC)
    return stored.groupBy("namespace").agg(F.count("*").alias("num"), F.sum("value").alias("total"))


@query(
    "j8_range_join",
    f"WITH {POINTS_SQL} SELECT record_id, series, CAST(counter AS DOUBLE) AS value FROM points",
)
def range_join(spark, sf_dir):
    counters = metric_samples(spark, sf_dir).where(F.col("metric") == enrichment.CPU_METRIC)
    points = intervals.samples_within(pod_spans(spark, sf_dir), counters)
    return points.select("record_id", "series", "value")


@query(
    "a19_metric_reduction",
    f"WITH {POINTS_SQL} SELECT record_id, cpu, memory FROM measured",
)
def metric_reduction(spark, sf_dir):
    return enrichment.measured(pod_spans(spark, sf_dir), metric_samples(spark, sf_dir))


def _waiting_pods(spark, sf_dir):
    """Queue of the pods: some tried before, some just now, some complete."""
    spans = pod_spans(spark, sf_dir)
    records = spans.select(
        "record_id",
        F.create_map(
            F.lit("namespace"), F.array("namespace"), F.lit("podname"), F.array("pod")
        ).alias("meta"),
        F.array().cast("array<struct<name:string,amount:bigint,scores:"
                       "array<struct<name:string,value:double>>>>").alias("components"),
        F.col("start_time").cast("timestamp").alias("start_time"),
        F.col("stop_time").cast("timestamp").alias("stop_time"),
    )
    number = F.regexp_extract("rid", "([0-9]+)$", 1).cast("bigint")
    return enrichment.enqueue(records).withColumns(
        {
            "retry": (number % 4).cast("int"),
            "updated": number % 3 * 100,
            "complete": number % 5 == 0,
        }
    )


QUEUE_SQL = """
queue AS (SELECT 'pod-' || CAST(event_id AS VARCHAR) AS rid, event_id % 4 AS retry, event_id % 3 * 100 AS updated,
                 event_id % 5 = 0 AS complete FROM ev WHERE group_id = 'signup')"""


@query(
    "f22_queue_eligibility",
    f"""WITH {QUEUE_SQL} SELECT count(*) FILTER (retry <= 2 AND updated <= 100 AND NOT complete) AS due,
        count(*) FILTER (retry > 2 AND NOT complete) AS given_up, count(*) FILTER (complete) AS done FROM queue""",
)
def queue_eligibility(spark, sf_dir):
    queue = _waiting_pods(spark, sf_dir)
    return queue.agg(
        F.count_if(enrichment.due(200, 2, 100)).alias("due"),
        F.count_if(enrichment.given_up(2)).alias("given_up"),
        F.count_if("complete").alias("done"),
    )


_TRIED_SQL = f"""WITH {POINTS_SQL}, {QUEUE_SQL},
tried AS (
  SELECT rid, cpu, memory, retry, complete, retry <= 2 AND updated <= 100 AND NOT complete AS due
  FROM queue LEFT JOIN measured ON rid = record_id
),
after_step AS (
  SELECT rid, CASE WHEN due THEN cpu END AS cpu,
         CASE WHEN due AND cpu IS NOT NULL THEN memory END AS memory,
         CAST(CASE WHEN due AND (cpu IS NULL OR memory IS NULL) THEN retry + 1 ELSE retry END AS INTEGER) AS retry,
         complete OR (due AND cpu IS NOT NULL AND memory IS NOT NULL) AS complete
  FROM tried
)"""


def _after_step(spark, sf_dir):
    return enrichment.merge_step(
        _waiting_pods(spark, sf_dir), metric_samples(spark, sf_dir), 200, 2, 100
    )


def _amount(name):
    named = F.filter("record.components", lambda c: c["name"] == name)
    return F.try_element_at(named, F.lit(1))["amount"].alias(name)


@query("t4_merge_step", f"{_TRIED_SQL} SELECT rid, cpu, memory, retry, complete FROM after_step")
def merge_step(spark, sf_dir):
    return _after_step(spark, sf_dir).select(
        "rid", _amount("cpu"), _amount("memory"), "retry", "complete"
    )


@query(
    "u4_deliverable",
    f"""{_TRIED_SQL} SELECT rid AS record_id, cpu, memory FROM after_step
        WHERE complete OR (retry > 2 AND NOT complete)""",
)
def deliverable(spark, sf_dir):
    return enrichment.emitted(_after_step(spark, sf_dir), 2).select(
        "record_id", component_amount("cpu").alias("cpu"), component_amount("memory").alias("memory")
    )


@query(
    "t4_remaining",
    f"""{_TRIED_SQL} SELECT rid, retry FROM after_step
        WHERE NOT (complete OR (retry > 2 AND NOT complete))""",
)
def remaining(spark, sf_dir):
    return enrichment.remaining(_after_step(spark, sf_dir), 2).select("rid", "retry")

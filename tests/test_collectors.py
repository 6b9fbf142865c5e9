import json

import pytest
from conftest import at, ids
from pyspark.sql import functions as F

from usageledger.sources import htcondor, kubernetes, slurm, slurm_detail
from usageledger.sources.htcondor import CondorComponent, CondorConfig, Getter
from usageledger.sources.rules import ComponentRule, MetaRule, OnlyIf, ScoreRule, SiteRule


@pytest.fixture(scope="module")
def lines(spark):
    def build(*texts):
        return spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)

    return build


# -- Slurm ------------------------------------------------------------------------

GUEST = OnlyIf("Account", "^guest")
CONFIG = slurm.SlurmConfig(
    sites=(SiteRule("hall", OnlyIf("QOS", "^(day|night)$")), SiteRule("attic", GUEST)),
    meta=(MetaRule("Comment", "Comment", "Json", allow_empty=True), MetaRule("account", "Account")),
    components=(
        ComponentRule("Ram", "ReqMem", "IntegerMega"),
        ComponentRule("Kernel", "SystemCPU", "Time", only_if=OnlyIf("QOS", "^day$")),
        ComponentRule("Slots", "AllocCPUS", scores=(ScoreRule("grant", 8.0, GUEST), ScoreRule("points", 3.25))),
    ),
)


def line(**cells):
    """A line of the dump with some cells, in the order of the configured keys."""
    return "|".join(cells.get(key.name, "") for key in CONFIG.keys())


DAY = {
    "QOS": "day", "Account": "chemistry", "Comment": "{'project': 'blue', 'user_id': 'x'}", "AllocCPUS": "16",
    "ReqMem": "3000M", "JobID": "31", "Start": "2024-03-01T06:00:00", "End": "2024-03-01T09:30:00",
    "Group": "lab", "User": "mara", "State": "COMPLETED",
}
DAY_BATCH = {"AllocCPUS": "16", "SystemCPU": "01:05.750", "JobID": "31.batch", "State": "COMPLETED"}
GUEST_JOB = DAY | {"QOS": "weekend", "Account": "guest-7", "Comment": "", "ReqMem": "250M", "JobID": "32"}
JOB_1, BATCH_1, JOB_2 = line(**DAY), line(**DAY_BATCH), line(**GUEST_JOB)


def test_keys_of_a_configuration():
    names = [key.name for key in CONFIG.keys()]
    assert len(names) == len(set(names))
    assert set(names) == {*DAY, "SystemCPU"}
    assert names[-6:] == ["JobID", "Start", "End", "Group", "User", "State"]


def test_slurm_records(lines):
    steps = [line(**DAY_BATCH | {"JobID": f"31.{step}"}) for step in ("extern", "0", "")]
    rows = slurm.collect(lines(JOB_1, BATCH_1, *steps, JOB_2), CONFIG).orderBy("record_id").collect()
    first, second = rows
    assert first["record_id"] == "slurm-31"
    assert first["meta"] == {
        "project": ["blue"], "account": ["chemistry"], "site_id": ["hall"], "user_id": ["mara"], "group_id": ["lab"],
    }
    assert [(c["name"], c["amount"]) for c in first["components"]] == [("Ram", 3000), ("Kernel", 65), ("Slots", 16)]
    assert [tuple(score) for score in first["components"][2]["scores"]] == [("points", 3.25)]
    assert second["meta"]["site_id"] == ["attic"]
    assert [c["name"] for c in second["components"]] == ["Ram", "Slots"]
    assert [tuple(score) for score in second["components"][1]["scores"]] == [("grant", 8.0), ("points", 3.25)]


@pytest.mark.parametrize(
    ("job", "why"),
    [
        (line(**DAY | {"QOS": "week"}), "no site"),
        (JOB_1, "no kernel time without the batch step"),
        (line(**GUEST_JOB | {"AllocCPUS": "four"}), "amount that cannot be read"),
        (line(**GUEST_JOB | {"End": "Unknown"}), "no end"),
        (line(**GUEST_JOB | {"State": "FAILED"}), "state"),
        (line(**GUEST_JOB | {"Start": "None", "State": "CANCELLED by 1"}), "never started"),
        (JOB_2.rsplit("|", 8)[0], "short line"),
    ],
)
def test_jobs_left_out(lines, job, why):
    assert slurm.collect(lines(job), CONFIG).count() == 0, why


def test_cancelled_after_start_is_kept(lines):
    config = slurm.SlurmConfig(
        sites=CONFIG.sites, meta=CONFIG.meta, components=CONFIG.components,
        job_filter=slurm.JobFilter(status=()),
    )
    job = JOB_2.replace("COMPLETED", "CANCELLED by 1000")
    assert slurm.collect(lines(job), config).count() == 1


def test_default_value_and_last_line_wins(lines):
    config = slurm.SlurmConfig(
        components=(ComponentRule("Cores", "NCPUS"), ComponentRule("Disk", "Disk", default_value=7)),
    )
    one = "4||3|2023-11-07T10:00:00|2023-11-07T11:00:00|g|u|COMPLETED"
    rows = slurm.collect(lines(one, one.replace("4||", "5||")), config).collect()
    assert [(c["name"], c["amount"]) for c in rows[0]["components"]] == [("Cores", 5), ("Disk", 7)]
    assert rows[0]["meta"]["site_id"] == ["NOT_CONFIGURED"]


def test_empty_cells(lines):
    def parsed(allow_empty):
        config = slurm.SlurmConfig(
            components=(), meta=(MetaRule("c", "Comment", "Json", allow_empty=allow_empty),)
        )
        row = slurm.split_lines(lines("|100||||||"), config).first()
        return row["Comment"], row["JobID"], row["State"]

    assert parsed(True) == ("", "100", None)
    assert parsed(False) == (None, "100", None)


def test_typed_meta_and_guard(lines):
    rule = MetaRule("cores", "NCPUS", only_if=OnlyIf("User", "^nobody$"))
    job = "4|u|7|2023-11-07T10:00:00|2023-11-07T11:00:00|g|u|COMPLETED"
    for guard, expected in ((False, ["4"]), (True, None)):
        config = slurm.SlurmConfig(meta=(rule,), guard_meta=guard)
        assert slurm.collect(lines(job), config).first()["meta"].get("cores") == expected


def test_next_mark(lines):
    later = line(**GUEST_JOB | {"JobID": "30", "End": "2024-03-02T00:00:00"})
    records = slurm.collect(lines(JOB_1, BATCH_1, JOB_2, later), CONFIG)
    row = slurm.next_mark(records).first()
    assert row["last_id"] == "slurm-30"
    row = slurm.next_mark(records.limit(0), at("2020-01-01T00:00:00Z"), "slurm-0").first()
    assert row["last_id"] == "slurm-0" and row["last_check"] is not None


DETAIL = (
    "JobId=7 JobName=a=b\n   UserId=me(1000) GroupId=us(100)\n StartTime=2023-11-07T10:00:00 "
    "EndTime=2023-11-07T11:00:00 NumCPUs=2 NumCPUs=4 noise QOS=day"
)


def test_job_detail(lines):
    config = slurm_detail.DetailConfig(
        "here", components=(ComponentRule("Cores", "NumCPUs", scores=(ScoreRule("S", 1.5, OnlyIf("QOS", "day")),)),)
    )
    row = slurm_detail.to_records(lines(DETAIL), config).first()
    assert row["record_id"] == "slurm-7"
    assert row["meta"] == {"site_id": ["here"], "user_id": ["me"], "group_id": ["us"]}
    assert (row["components"][0]["amount"], row["components"][0]["scores"][0]["value"]) == (4, 1.5)
    words = lines(DETAIL).select(slurm_detail.details_map().alias("m")).first()["m"]
    assert words["JobName"] == "a=b" and words["NumCPUs"] == "4" and "noise" not in words
    assert slurm_detail.to_records(lines(DETAIL.replace("EndTime", "Endtime")), config).count() == 0


# -- HTCondor ---------------------------------------------------------------------

ADS = ("GlobalJobId", "LastMatchTime", "CompletionDate", "EnteredCurrentStatus", "Cpus", "Specs", "Host", "Flag")
CONDOR = CondorConfig(
    class_ads=ADS,
    meta={
        "host": [Getter(key="GlobalJobId", matches=r"^(.*)#\d+.\d+#\d+$")],
        "site": [Getter(name="test-site", key="Host", matches="^slot.+@execute$"), Getter(name="UNDEF")],
        "all": [Getter(key="Host"), Getter(key="Nope"), Getter(key="Flag"), Getter(factor=3)],
    },
    components=[
        CondorComponent(
            Getter("Cores", "Cpus"),
            (Getter("HS", "Specs", matches=r"HS\D+(\d+(\.\d+)?)", only_if=OnlyIf("Host", "execute$")),),
        )
    ],
)


def test_condor_record(lines):
    row = htcondor.collect(lines("a#1.0#5, 100, 0, 200, 8.9, HS: 1.5, slot1@execute, true"), CONDOR).first()
    assert row["record_id"] == "htcondor-a#1.0#5"
    assert row["meta"] == {"host": ["a"], "site": ["test-site"], "all": ["slot1@execute", "True", "3"]}
    assert row["components"][0]["amount"] == 8
    assert row["components"][0]["scores"][0]["value"] == 1.5
    assert (row["stop_time"].timestamp(), row["has_stop"]) == (200.0, True)


def test_condor_gaps(lines):
    text = "a#1.0#5, 100, undefined, 0, 1, none, elsewhere, undefined"
    row = htcondor.collect(lines(text), CONDOR).first()
    assert row["meta"] == {"host": ["a"], "site": ["UNDEF"], "all": ["elsewhere", "3"]}
    assert row["components"][0]["scores"][0]["value"] == 0.0
    assert (row["stop_time"].timestamp(), row["has_stop"]) == (0.0, False)


@pytest.mark.parametrize("text", [
    "a#1.0#5, undefined, 0, 200, 8, HS 1, h, true",
    "a#1.0#5, 100, 0, 200, undefined, HS 1, h, true",
    "a#1.0#5, 100, 0, 200, eight, HS 1, h, true",
    "",
])
def test_condor_rejects(lines, text):
    assert htcondor.collect(lines(text), CONDOR).count() == 0


# -- Kubernetes -------------------------------------------------------------------


def pod(phase="Succeeded", status_limits=None, spec_limits={"cpu": "1", "memory": "100"}, **changes):
    def times(start="2024-01-01T00:00:00Z", end="2024-01-01T00:10:00Z"):
        return {"terminated": {"startedAt": start, "finishedAt": end}}

    container = {"name": "c", "state": times()}
    if status_limits is not None:
        container["resources"] = {"limits": status_limits}
    body = {
        "metadata": {"name": "testpod", "namespace": "testns", "uid": "testuuid", "labels": {"app": "x"}},
        "spec": {"containers": [{"name": "c", "resources": {"limits": spec_limits}}]},
        "status": {
            "phase": phase,
            "startTime": "2024-01-01T00:00:00Z",
            "containerStatuses": [container, *changes.pop("more", [])],
        },
    }
    for path, value in changes.items():
        part, key = path.split("__")
        body[part][key] = value
    return json.dumps(body)


@pytest.fixture(scope="module")
def pods(lines):
    def build(*texts):
        return kubernetes.parse_pods(lines(*texts))

    return build


def amounts(df):
    return [{c["name"]: c["amount"] for c in r["components"]} for r in df.collect()]


def test_pod_record(pods):
    row = kubernetes.to_records(pods(pod())).first()
    assert row["record_id"] == "kubernetes-testns-testpod-testuuid"
    assert row["meta"] == {"podname": ["testpod"], "namespace": ["testns"], "status": ["Succeeded"]}
    assert {c["name"]: c["amount"] for c in row["components"]} == {"naive_cpu_time": 600, "memory_limit": 100}


def test_status_limits_come_first(pods):
    given = pods(pod(status_limits={"cpu": "1500m", "memory": "2Ki"}))
    assert amounts(kubernetes.to_records(given)) == [{"naive_cpu_time": 900, "memory_limit": 2048}]


def test_missing_pieces(pods):
    given = pods(
        pod(spec_limits={"cpu": "1"}),
        pod(spec_limits={"cpu": "x", "memory": "1"}),
        pod(status_limits={"cpu": "1", "memory": "1"}, spec__containers=[{"name": "other"}]),
    )
    assert amounts(kubernetes.to_records(given)) == [{}, {}, {}]


def test_running_containers_have_no_stop(pods):
    running = {"name": "c", "state": {"terminated": None}}
    assert kubernetes.to_records(pods(pod(more=[running]))).count() == 0


@pytest.mark.parametrize("phase", ["Pending", "running", "Unknown"])
def test_unfinished_pods(pods, phase):
    assert kubernetes.to_records(pods(pod(phase))).count() == 0


def test_pod_filters(pods):
    given = pods(pod())
    assert kubernetes.filter_pods(given, {"app": "x"}, ["testns"]).count() == 1
    assert kubernetes.filter_pods(given, {"app": "y"}).count() == 0
    assert kubernetes.to_records(given, last_check=at("2024-01-01T00:09:59Z")).count() == 1
    assert kubernetes.to_records(given, last_check=at("2024-01-01T00:10:00Z")).count() == 0


def test_latest_container_ends_the_pod(pods):
    later = {
        "name": "c",
        "state": {"terminated": {"startedAt": "2024-01-01T00:00:00Z", "finishedAt": "2024-01-01T00:20:00Z"}},
    }
    row = kubernetes.to_records(pods(pod(more=[later]))).select(
        F.unix_seconds("stop_time").alias("s")
    ).first()
    assert row["s"] == int(at("2024-01-01T00:20:00Z").timestamp())


def test_a_filter_without_its_column_is_an_error(spark):
    jobs = spark.createDataFrame([("1", "COMPLETED")], "JobID string, State string")
    with pytest.raises(ValueError, match="Partition"):
        slurm.filter_jobs(jobs, slurm.JobFilter(partition=("p1",)))


def test_filter_columns_are_part_of_the_dump():
    config = slurm.SlurmConfig(job_filter=slurm.JobFilter(partition=("p1",), account=("a",), user=("u",)))
    names = [key.name for key in config.keys()]
    assert names.count("Partition") == names.count("Account") == names.count("User") == 1

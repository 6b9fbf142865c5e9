from datetime import timedelta

import pytest
from conftest import at, ids
from pyspark.sql import functions as F

from usageledger.catalog import streams
from usageledger.plans import enrichment
from usageledger.plans.store import RecordStore
from usageledger.schema import RECORD_ADD
from usageledger.sources import slurm
from usageledger.streaming import backlog, ingest

CONFIG = slurm.SlurmConfig()


def job(number, cores=1):
    return f"{cores}|{number}|2023-11-07T10:00:00|2023-11-07T1{number % 10}:00:00|g|u|COMPLETED\n"


@pytest.fixture
def store(spark, tmp_path):
    return RecordStore(spark, str(tmp_path / "store"))


def test_two_drops_and_a_replay(spark, store, tmp_path):
    drops = tmp_path / "drops"
    drops.mkdir()

    def run(checkpoint):
        stream = ingest.text_stream(spark, str(drops))
        ingest.ingest(
            stream, lambda b: slurm.collect(b, CONFIG), store, str(tmp_path / checkpoint)
        ).awaitTermination()

    (drops / "a.txt").write_text(job(1) + job(2))
    run("one")
    assert ids(store.get()) == ["slurm-1", "slurm-2"]
    # A later drop repeats a job, and a job in it stopped long before.
    (drops / "b.txt").write_text(job(2, cores=9) + job(0))
    run("one")
    assert ids(store.get()) == ["slurm-0", "slurm-1", "slurm-2"]
    assert store.get_single_record("slurm-2").first()["components"][0]["amount"] == 1
    run("fresh")
    assert store.get().count() == 3


def test_earliest_time(spark, store, tmp_path):
    drops = tmp_path / "drops"
    drops.mkdir()
    (drops / "a.txt").write_text(job(1) + job(5))
    earliest = ingest.not_before(at("2023-11-07T12:00:00Z"), at("2020-01-01T00:00:00Z"))
    assert ingest.not_before(None, earliest) == earliest
    ingest.ingest(
        ingest.text_stream(spark, str(drops)), lambda b: slurm.collect(b, CONFIG), store,
        str(tmp_path / "checkpoint"), earliest=earliest,
    ).awaitTermination()
    assert ids(store.get()) == ["slurm-5"]


def test_updates_wait_for_their_record(spark, store, tmp_path):
    folder = str(tmp_path / "messages")
    start = at("2024-01-01T00:00:00Z")

    def drop(*messages):
        spark.createDataFrame(list(messages), ingest.MESSAGE).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = ingest.parquet_stream(spark, folder, ingest.MESSAGE, files_per_batch=1)
        ingest.deliver(
            stream, store, str(tmp_path / "pending"), str(tmp_path / "checkpoint")
        ).awaitTermination()

    def insert(record_id):
        return (ingest.INSERT, record_id, None, [], start, None)

    def update(record_id, hours):
        return (ingest.UPDATE, record_id, None, None, None, start + timedelta(hours=hours))

    drop(insert("a"), update("a", 1), update("b", 2))
    run()
    assert {r["record_id"]: r["runtime"] for r in store.get().collect()} == {"a": 3600}
    drop(insert("a"), insert("b"), update("a", 3))
    run()
    assert {r["record_id"]: r["runtime"] for r in store.get().collect()} == {"a": 10800, "b": 7200}


def test_backlog(spark, store, tmp_path):
    start = at("2024-01-01T00:00:00Z")
    folder, state = str(tmp_path / "pods"), {"samples": []}

    def pod(name):
        meta = {"namespace": ["ns"], "podname": [name]}
        return (f"r-{name}", meta, [], start, start + timedelta(hours=1))

    def drop(*pods):
        frame = spark.createDataFrame(list(pods), RECORD_ADD)
        frame.coalesce(1).write.mode("append").parquet(folder)

    def run():
        backlog.enrich(
            ingest.parquet_stream(spark, folder, RECORD_ADD, files_per_batch=1),
            lambda: spark.createDataFrame(state["samples"], enrichment.SAMPLES),
            store, str(tmp_path / "queue"), str(tmp_path / "checkpoint"),
            clock=lambda batch: 1000 * (batch + 1), max_retries=1, interval_seconds=60,
        ).awaitTermination()

    drop(pod("x"), pod("y"))
    run()
    assert store.get().count() == 0
    assert {r["rid"]: r["retry"] for r in backlog.waiting(store, str(tmp_path / "queue")).collect()} == {
        "r-x": 1, "r-y": 1,
    }
    state["samples"] = [
        ("ns", "x", "s", metric, start + timedelta(minutes=m), float(m))
        for m in (1, 5) for metric in (enrichment.CPU_METRIC, enrichment.MEMORY_METRIC)
    ]
    drop(pod("x"), pod("z"))
    run()
    done = {
        r["record_id"]: {c["name"]: c["amount"] for c in r["components"] or []}
        for r in store.get().collect()
    }
    # x was completed, y was tried twice and given up, z waits.
    assert done == {"r-x": {"cpu": 4, "memory": 5}, "r-y": {}}
    waiting = backlog.waiting(store, str(tmp_path / "queue")).select("rid", F.col("retry"))
    assert [tuple(r) for r in waiting.collect()] == [("r-z", 1)]


def test_lines_of_a_job_in_different_batches(spark, store, tmp_path):
    """The batch line alone knows the CPU time, and may come before or after its job."""
    config = slurm.SlurmConfig(components=(slurm.ComponentRule("TotalCPU", "TotalCPU", "Time"),))
    drops, pending = tmp_path / "drops", str(tmp_path / "pending")
    drops.mkdir()

    def lines(name, *rows):
        (drops / f"{name}.txt").write_text("".join(f"{r}\n" for r in rows))

    def main(number):
        return f"|{number}|2023-11-07T10:00:00|2023-11-07T11:00:00|g|u|COMPLETED"

    def batch(number):
        return f"00:10:00|{number}.batch|2023-11-07T10:00:00|2023-11-07T11:00:00|||COMPLETED"

    def run(checkpoint):
        stream = ingest.text_stream(spark, str(drops))
        ingest.ingest_jobs(stream, config, store, pending, str(tmp_path / checkpoint)).awaitTermination()

    lines("a", main(1), batch(2), main(3), batch(3))
    run("one")
    assert ids(store.get()) == ["slurm-3"]
    lines("b", batch(1))
    run("one")
    assert sorted(ids(store.get())) == ["slurm-1", "slurm-3"]
    # A new checkpoint finds what waits.
    for name in ("a", "b"):
        (drops / f"{name}.txt").unlink()
    lines("c", main(2))
    run("two")
    assert sorted(ids(store.get())) == ["slurm-1", "slurm-2", "slurm-3"]
    ingest.flush_jobs(config, store, pending)
    assert store.get().count() == 3


def test_rejects_are_kept(spark, store, tmp_path):
    folder, checkpoint = str(tmp_path / "messages"), str(tmp_path / "checkpoint")
    start = at("2024-01-01T00:00:00Z")
    rows = [(ingest.INSERT, "a", None, [], start, None), (ingest.INSERT, " ", None, [], start, None)]
    spark.createDataFrame(rows, ingest.MESSAGE).write.parquet(folder)
    stream = ingest.parquet_stream(spark, folder, ingest.MESSAGE)
    ingest.deliver(stream, store, str(tmp_path / "pending"), checkpoint).awaitTermination()
    assert [(r["record_id"], r["reasons"]) for r in ingest.rejected(spark, checkpoint).collect()] == [
        (" ", ["record_id"])
    ]


def test_updates_survive_a_new_checkpoint(spark, store, tmp_path):
    folder, pending = str(tmp_path / "messages"), str(tmp_path / "pending")
    start = at("2024-01-01T00:00:00Z")

    def run(message, checkpoint):
        spark.createDataFrame([message], ingest.MESSAGE).write.mode("overwrite").parquet(folder)
        stream = ingest.parquet_stream(spark, folder, ingest.MESSAGE)
        ingest.deliver(stream, store, pending, str(tmp_path / checkpoint)).awaitTermination()

    run((ingest.UPDATE, "a", None, None, None, start + timedelta(hours=2)), "one")
    run((ingest.INSERT, "a", None, [], start, None), "two")
    assert store.get().first()["runtime"] == 7200


def test_retry_without_new_records(spark, store, tmp_path):
    start, folder, queue = at("2024-01-01T00:00:00Z"), str(tmp_path / "pods"), str(tmp_path / "queue")
    meta = {"namespace": ["ns"], "podname": ["x"]}
    rows = [("r-x", meta, [], start, start + timedelta(hours=1))]
    spark.createDataFrame(rows, RECORD_ADD).write.parquet(folder)
    samples = lambda: spark.createDataFrame([], enrichment.SAMPLES)

    def tries():
        return [r["retry"] for r in backlog.waiting(store, queue).collect()]

    backlog.enrich(
        ingest.parquet_stream(spark, folder, RECORD_ADD), samples, store, queue, str(tmp_path / "checkpoint"),
        clock=lambda batch: 1000, max_retries=1, interval_seconds=60, reachable=lambda: False,
    ).awaitTermination()
    assert tries() == [0]
    backlog.retry(samples, store, queue, 2000, 1, 60, reachable=False)
    assert tries() == [0]
    backlog.retry(samples, store, queue, 3000, 1, 60)
    assert tries() == [1]
    backlog.retry(samples, store, queue, 4000, 1, 60)
    assert tries() == [] and store.get().count() == 1


def test_files_of_a_batch_are_several(spark, tmp_path):
    """Jobs of the drops come in three batches, of as many files as there are tasks to read them."""
    drops = str(tmp_path / "drops")
    spark.range(2400).selectExpr("CAST(id AS STRING) value").repartition(streams.DROPS * streams.DROP_FILES).write.text(drops)
    assert streams._share(spark, drops) == streams.DROP_FILES > 1
    assert streams._share(spark, str(tmp_path / "nothing")) == 1
    sizes = []
    lines = ingest.text_stream(spark, drops, files_per_batch=streams._share(spark, drops))
    ingest.start(lines, lambda batch, _: sizes.append(batch.count()), str(tmp_path / "checkpoint")).awaitTermination()
    assert len(sizes) == streams.DROPS and sum(sizes) == 2400


def test_waiting_entries_are_not_broadcast(spark):
    """What was measured for the queue may be as long as the queue."""
    queue = enrichment.enqueue(spark.createDataFrame([], RECORD_ADD))
    samples = spark.createDataFrame([], enrichment.SAMPLES)
    plan = enrichment.fill(queue, samples, 1)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint (strategy=merge)" in plan

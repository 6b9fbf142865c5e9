"""Session settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(
    app_name: str = "usageledger", master: str | None = None, **settings: str
) -> SparkSession:
    """A session with the runtime settings; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master is not None:
        builder = builder.master(master)
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else has built."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, **overrides: str) -> Iterator[None]:
    """Set session options for one block and put the old values back."""
    names = {key: key.replace("__", ".") for key in overrides}
    before = {name: spark.conf.get(name, None) for name in names.values()}
    for key, name in names.items():
        spark.conf.set(name, overrides[key])
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, else (local
    runs and tests only) a temporary folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="usageledger-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the scratch folder; nothing is created."""
    return f"{scratch_root(spark)}/usageledger/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the scratch folder and read it back: what is used several
    times is computed once, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Folders and small files through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def partition_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition folders directly below a path."""
    return [name for name in names_in(spark, path) if "=" in name]


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a path, none if it is not there."""
    system, where = _filesystem(spark, path)
    if not system.exists(where):
        return []
    return [status.getPath().getName() for status in system.listStatus(where)]


def folder_exists(spark: SparkSession, path: str) -> bool:
    system, where = _filesystem(spark, path)
    return system.exists(where)


def move_only_file(spark: SparkSession, folder: str, target: str) -> None:
    """Put the one part file of a written folder in place of ``target``."""
    system, where = _filesystem(spark, folder)
    names = [status.getPath() for status in system.listStatus(where)]
    (part,) = [name for name in names if name.getName().startswith("part-")]
    remove_folder(spark, target)
    system.rename(part, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target))
    remove_folder(spark, folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    system, where = _filesystem(spark, path)
    system.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if it is not there."""
    system, where = _filesystem(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and put it there in one step, so that a
    reader sees the old content or the new one."""
    jvm = spark.sparkContext._jvm
    system, beside = _filesystem(spark, f"{path}.new")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    where = jvm.org.apache.hadoop.fs.Path(path)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    uri, conf = system.makeQualified(where).toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf).rename(
        system.makeQualified(beside), system.makeQualified(where), options
    )

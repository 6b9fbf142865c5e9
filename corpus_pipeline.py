"""From raw documents to packed batches, in five stages.

A stage takes (spark, docs, sf_dir).  Its result is written as Parquet below the
folder that ``spark.checkpoint.dir`` names and read again as the next one's docs,
so that a lost executor repeats one stage at most.  Rows whose decision needs an id
keep their place without one: a null doc_id is never taken for a duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usageledger.llm import minhash_dedup, packing, quality_model, secret_scan, substring_dedup
from usageledger.session import materialize

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels)
    return quality_model.select_good(docs.select(*_COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id,
    and one row of it where its id and text are repeated.  Rows without an id all stay;
    so do different texts of one id, unless their id is a near-duplicate's."""
    found = minhash_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rest = docs.select(*_COLUMNS).join(found, "doc_id", "left_anti").select(*_COLUMNS)
    single = rest.join(repeated, "doc_id", "left_anti").select(*_COLUMNS)
    several = rest.join(repeated, "doc_id", "left_semi").select(*_COLUMNS)
    return single.unionByName(several.dropDuplicates(["doc_id", "text"]))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what repeats earlier text.  Bytes of a character that a cut has split go too."""
    marks = substring_dedup.find_repeats(docs)
    return substring_dedup.cut_text(docs.select(*_COLUMNS).join(marks, "doc_id", "left")).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found in a text."""
    clean = secret_scan.redact_secrets(docs.select(*_COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in length buckets and batches."""
    return packing.packing(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("secret scans", secrets),
    ("packing", pack),
]

#: The stages have no SQL form; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed batches of the documents below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

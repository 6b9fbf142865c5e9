"""Record conversions, the flat legacy model, and one-off corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageledger.functions.numbers import half_away
from usageledger.functions.records import has_component, make_component, runtime_seconds
from usageledger.functions.text import percent_decode
from usageledger.operators.lookup import BROADCAST_ROWS
from usageledger.schema import COMPONENTS_DDL, RECORD_COLUMNS, SCORES_DDL

# Parts into which a score is split that is joined and not broadcast.
SCORE_SALTS = 16


def to_record(added: DataFrame) -> DataFrame:
    """Derive the runtime; an empty component list becomes null."""
    return added.withColumn("runtime", runtime_seconds("start_time", "stop_time")).withColumn(
        "components", F.when(F.size("components") > 0, F.col("components"))
    )


def to_added(records: DataFrame) -> DataFrame:
    """The way back: no runtime, null components become an empty list."""
    return records.select(
        "record_id",
        "meta",
        F.coalesce("components", F.array().cast(COMPONENTS_DDL)).alias("components"),
        "start_time",
        "stop_time",
    )


def to_update(records: DataFrame) -> DataFrame:
    """Closed records as stop-time corrections."""
    return records.where(F.col("stop_time").isNotNull()).select("record_id", "stop_time")


# -- flat model ----------------------------------------------------------------


def to_flat_tables(records: DataFrame) -> dict[str, DataFrame]:
    """Six flat tables: accounting, meta, components, scores and two link tables.

    Keys are natural ones: a component is its record and position, a score its
    name and value.
    """
    accounting = records.select("record_id", "start_time", "stop_time", "runtime")
    meta = (
        records.select("record_id", F.explode("meta").alias("key", "values"))
        .select("record_id", "key", F.explode(F.array_distinct("values")).alias("value"))
    )
    placed = records.select(
        "record_id", F.posexplode("components").alias("position", "component")
    ).withColumn(
        "component_id",
        F.concat("record_id", F.lit("#"), F.lpad(F.col("position").cast("string"), 10, "0")),
    )
    scored = placed.select("component_id", F.explode("component.scores").alias("score")).select(
        "component_id",
        F.concat("score.name", F.lit("="), F.col("score.value").cast("string")).alias("score_id"),
        "score.name",
        "score.value",
    )
    return {
        "accounting": accounting,
        "meta": meta,
        "components": placed.select("component_id", "component.name", "component.amount"),
        "scores": scored.select("score_id", "name", "value").distinct(),
        "components_scores": scored.select("component_id", "score_id"),
        "records_components": placed.select("record_id", "component_id"),
    }


def _meta_map() -> Column:
    """Sorted (key, value) entries as one map of value lists."""
    keys = F.array_distinct(F.transform("entries", lambda e: e["key"]))
    return F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda k: F.transform(F.filter("entries", lambda e: e["key"] == k), lambda e: e["value"]),
        ),
    )


def meta_maps(meta: DataFrame) -> DataFrame:
    """(record_id, key, value) rows -> one map of sorted value lists per record."""
    entries = meta.groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("key", "value"))).alias("entries")
    )
    return entries.select("record_id", _meta_map().alias("meta"))


def scored_links(
    components_scores: DataFrame, scores: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """component_id with the name and value of each score.

    A score is shared by many components.  Scores up to a checked number are
    broadcast; more of them are joined under a salt, so that one that all components
    share is spread.
    """
    if scores.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return components_scores.join(F.broadcast(scores), "score_id").select("component_id", "name", "value")
    salts = F.array(*[F.lit(k) for k in range(SCORE_SALTS)])
    salted = scores.withColumn("_salt", F.explode(salts))
    link = components_scores.withColumn("_salt", F.pmod(F.xxhash64("component_id"), F.lit(SCORE_SALTS)).cast("int"))
    return link.join(salted, ["score_id", "_salt"]).select("component_id", "name", "value")


def _numbered_components(
    components: DataFrame,
    scores: DataFrame,
    components_scores: DataFrame,
    records_components: DataFrame,
) -> DataFrame:
    """record_id and one component each, with its id and its scores.

    Links, components and scores are one table under the component's id, which is
    dealt out once.
    """
    found = F.col("name").isNotNull() & F.col("value").isNotNull()
    no_record, no_component, no_score = (
        F.lit(None).cast(kind) for kind in ("string", "struct<name:string,amount:bigint>", "struct<name:string,value:double>")
    )
    link = records_components.select(
        "component_id", F.col("record_id"), no_component.alias("component"), no_score.alias("score")
    )
    own = components.select(
        "component_id", no_record.alias("record_id"), F.struct("name", F.col("amount").cast("bigint").alias("amount")), no_score
    )
    score = scored_links(components_scores, scores).select(
        "component_id", no_record, no_component, F.when(found, F.struct("name", F.col("value").cast("double").alias("value")))
    )
    return (
        link.union(own)
        .union(score)
        # Dealt out before lists are built: a list is not sent, and not built twice.
        .repartition("component_id")
        .groupBy("component_id")
        .agg(
            F.collect_list("record_id").alias("records"),
            F.first("component", ignorenulls=True).alias("component"),
            F.array_sort(F.collect_list("score")).alias("scores"),
        )
        .select(
            F.explode("records").alias("record_id"),
            F.struct(
                "component_id",
                F.col("component.name").alias("name"),
                F.col("component.amount").alias("amount"),
                F.col("scores").cast(SCORES_DDL).alias("scores"),
            ).alias("numbered"),
        )
    )


def _in_order(numbered: Column) -> Column:
    """The components of a record by their ids, without the ids."""
    return F.transform(
        F.array_sort(numbered),
        lambda c: F.struct(c["name"].alias("name"), c["amount"].alias("amount"), c["scores"].alias("scores")),
    )


def component_lists(
    components: DataFrame,
    scores: DataFrame,
    components_scores: DataFrame,
    records_components: DataFrame,
) -> DataFrame:
    """Link tables -> one component list per record, scores inside."""
    numbered = _numbered_components(components, scores, components_scores, records_components)
    return numbered.groupBy("record_id").agg(_in_order(F.collect_list("numbered")).alias("components"))


def from_flat_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Flat tables -> records; records without metadata or components keep null.

    Accounting rows, metadata and components are one table under the record's id,
    which is dealt out once.
    """
    numbered = _numbered_components(
        tables["components"],
        tables["scores"],
        tables["components_scores"],
        tables["records_components"],
    )
    times = F.struct("start_time", "stop_time", "runtime")
    accounting = tables["accounting"].select("record_id", times.alias("times"))
    none = {
        "times": F.lit(None).cast(accounting.schema["times"].dataType),
        "entry": F.lit(None).cast("struct<key:string,value:string>"),
        "numbered": F.lit(None).cast(numbered.schema["numbered"].dataType),
    }

    def widened(df: DataFrame, **there: Column) -> DataFrame:
        return df.select("record_id", *(there.get(name, empty).alias(name) for name, empty in none.items()))

    rows = (
        widened(accounting, times=F.col("times"))
        .unionByName(widened(tables["meta"], entry=F.struct("key", "value")))
        .unionByName(widened(numbered, numbered=F.col("numbered")))
    )
    gathered = rows.repartition("record_id").groupBy("record_id").agg(
        F.collect_list("times").alias("times"),
        F.array_sort(F.collect_list("entry")).alias("entries"),
        F.collect_list("numbered").alias("numbered"),
    )
    # Ids that only the other tables have are no records.
    return gathered.select(
        "record_id",
        F.when(F.size("entries") > 0, _meta_map()).alias("meta"),
        F.when(F.size("numbered") > 0, _in_order(F.col("numbered"))).alias("components"),
        F.explode("times").alias("times"),
    ).select("record_id", "meta", "components", "times.*").select(*RECORD_COLUMNS)


# -- corrections -----------------------------------------------------------------


def unconverted(name: str) -> Column:
    """Has the component in milli-units and was not converted before."""
    return has_component(name) & ~has_component(f"{name}_milli")


def milli_to_whole(records: DataFrame, name: str) -> DataFrame:
    """Divide a component by 1000 and append the old amount as ``<name>_milli``.

    Running it twice changes nothing.
    """
    old = F.try_element_at(
        F.filter("components", lambda c: c["name"] == name), F.lit(1)
    )["amount"]

    def converted(component: Column) -> Column:
        whole = half_away(component["amount"].cast("decimal(20,0)") / 1000)
        return F.when(
            component["name"] == name, component.withField("amount", whole)
        ).otherwise(component)

    changed = F.concat(
        F.transform("components", converted),
        F.array(make_component(f"{name}_milli", old)),
    )
    return records.withColumn(
        "components", F.when(unconverted(name), changed).otherwise(F.col("components"))
    )


def decode_names(records: DataFrame) -> DataFrame:
    """Percent-decode the record id and every metadata value."""
    return records.withColumn("record_id", percent_decode(F.col("record_id"))).withColumn(
        "meta",
        F.transform_values("meta", lambda _, values: F.transform(values, percent_decode)),
    )

"""Typed values out of scheduler text.  Unreadable text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usageledger.functions.records import once

# Clock formats MM:SS.f, HH:MM:SS and D-HH:MM:SS, and seconds per
# unit from the last number on.
CLOCK = r"^([0-9]{2}:[0-9]{2}\.[0-9]+|([0-9]{1,3}-)?[0-9]{2}:[0-9]{2}:[0-9]{2})$"
CLOCK_UNITS = (1, 60, 3600, 86400)

DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Milli-units per quantity suffix.
QUANTITY_FACTORS = {
    "": 1000,
    "m": 1,
    "k": 1000 * 1000,
    "Ki": 1000 * 1024,
    "M": 1000 * 1000**2,
    "Mi": 1000 * 1024**2,
    "G": 1000 * 1000**3,
    "Gi": 1000 * 1024**3,
    "T": 1000 * 1000**4,
    "Ti": 1000 * 1024**4,
}


def integer(text: Column) -> Column:
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def integer_mega(text: Column) -> Column:
    """Number followed by one unit character, which is dropped."""
    return integer(F.left(text, F.length(text) - 1))


def clock_seconds(text: Column) -> Column:
    """``MM:SS.f``, ``HH:MM:SS`` or ``D-HH:MM:SS`` in whole seconds."""

    numbers = F.reverse(F.split(F.substring_index(text, ".", 1), "[-:]"))
    units = F.array(*[F.lit(unit).cast("bigint") for unit in CLOCK_UNITS])
    seconds = F.zip_with(
        numbers, units, lambda n, unit: F.coalesce(n.cast("bigint"), F.lit(0)) * unit
    )
    total = F.aggregate(seconds, F.lit(0).cast("bigint"), lambda acc, part: acc + part)
    return F.when(text.rlike(CLOCK), total)


def local_datetime(text: Column, timezone: str = "UTC") -> Column:
    """``2023-11-07T10:14:01`` in the scheduler's time zone, as UTC."""
    return F.to_utc_timestamp(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), timezone
    )


def account_id(text: Column) -> Column:
    """``name(uid)`` -> ``name``."""
    return F.substring_index(text, "(", 1)


def json_map(text: Column) -> Column:
    """Flat string map in any of the dump's quoting styles; else empty.

    A text with a value that is no string is rejected as a whole.
    """
    bare = F.regexp_replace(text, r'^"|"\z', "")

    def quoted(plain: Column) -> Column:
        return F.when(plain.contains('"'), plain).otherwise(
            F.replace(plain, F.lit("'"), F.lit('"'))
        )

    def texts(values: Column) -> Column:
        only_text = F.forall(F.map_values(values), lambda v: F.schema_of_variant(v) == "STRING")
        return F.when(
            only_text, F.transform_values(values, lambda _, v: F.variant_get(v, "$", "string"))
        )

    typed = once(bare, lambda plain: F.from_json(quoted(plain), "map<string,variant>"))
    return F.coalesce(once(typed, texts), F.create_map().cast("map<string,string>"))


def quantity_milli(text: Column) -> Column:
    """Whole-number resource quantity (``2``, ``500m``, ``4Gi``) in milli-units."""
    digits = F.regexp_extract(text, "^[0-9]*", 0)
    factors = F.create_map(
        *[F.lit(item) for pair in QUANTITY_FACTORS.items() for item in pair]
    )

    def milli(number: Column) -> Column:
        suffix = F.substring(text, F.length(number) + 1, F.length(text))
        return F.try_multiply(
            number.try_cast("bigint"), F.try_element_at(factors, suffix).cast("bigint")
        )

    return once(digits, milli)


def _decimal(text: Column) -> Column:
    """A float; the pattern keeps texts away from the cast, which is slow to fail."""
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def loose_amount(text: Column) -> Column:
    """Whole number out of an integer, decimal or boolean cell."""
    truth = F.when(text == "true", F.lit(1)).when(text == "false", F.lit(0))
    return F.coalesce(
        integer(text), _decimal(text).try_cast("bigint"), truth.cast("bigint")
    )


def loose_text(text: Column) -> Column:
    """A cell as text after its number or boolean has been normalised."""
    truth = F.when(text == "true", "True").when(text == "false", "False")
    return F.coalesce(
        integer(text).cast("string"), _decimal(text).cast("string"), truth, text
    )

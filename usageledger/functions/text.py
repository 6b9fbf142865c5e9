"""String rules of the reports and migrations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "None"


def regex_or_none(value: Column, pattern: str) -> Column:
    """Text matched anywhere by the pattern, else the word ``None``."""
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 0)).otherwise(MISSING)


def vo_mapping(value: Column, prefixes: Mapping[str, str]) -> Column:
    """Value of the first prefix the text starts with, else ``None``."""
    hits = [F.when(value.startswith(prefix), F.lit(vo)) for prefix, vo in prefixes.items()]
    return F.coalesce(*hits, F.lit(MISSING))


FUNCTIONS: dict[str, Callable[[Column, Any], Column]] = {"vo_mapping": vo_mapping}


def named_function(name: str) -> Callable[[Column, Any], Column]:
    if name not in FUNCTIONS:
        raise KeyError(f"function {name!r} is not one of {sorted(FUNCTIONS)}")
    return FUNCTIONS[name]


def first_contained(value: Column, names: Sequence[str]) -> Column:
    """First listed name that occurs inside the text, else the text itself."""
    if not names:
        return value
    return F.coalesce(*[F.when(value.contains(name), F.lit(name)) for name in names], value)


def display_name(path: Column) -> Column:
    """``/vo/Role=x/...`` -> ``vo-x``; the role is left out when it is NULL.

    Texts without a slash, or with fewer than four parts, stay as they are.
    """
    parts = F.split(path, "/")
    vo, role = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    named = F.when(role.contains("NULL"), vo).otherwise(
        F.concat(vo, F.lit("-"), F.substring_index(role, "=", -1))
    )
    return F.when(F.size(parts) >= 4, named).otherwise(path)


def percent_decode(value: Column) -> Column:
    """Percent-decoding that keeps ``+`` and leaves broken escapes alone."""
    guarded = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    guarded = F.replace(guarded, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(guarded), value)

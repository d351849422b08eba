"""Text cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(col: Column) -> Column:
    """Trim every kind of blank on both ends; a missing value stays missing."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def strip_float_tail(col: Column) -> Column:
    """``20240110.0`` -> ``20240110``: one literal ``.0`` ending, nothing else."""
    return F.when(col.endswith(".0"), F.substr(col, F.lit(1), F.length(col) - 2)).otherwise(col)


def remove(col: Column, pattern: str) -> Column:
    return F.regexp_replace(col, pattern, "")


SEPARATOR = "\x1f"  # unit separator: does not occur in text


def extract_groups(col: Column, pattern: str, names: Sequence[str]) -> list[Column]:
    """One column per capture group of the first match; no match gives null.

    The groups are rewritten into one separated text first, a subexpression all columns
    share, so the pattern runs once per row instead of once per group. A separator before the first group
    tells a match from a text left as it was.
    """
    joined = "".join(f"{SEPARATOR}${i}" for i in range(1, len(names) + 1))
    parts = F.split(F.regexp_replace(col, rf"(?s)^.*?(?:{pattern}).*$", joined), SEPARATOR)
    matched = F.size(parts) == len(names) + 1
    return [
        F.when(matched, F.nullif(F.get(parts, F.lit(i)), F.lit(""))).alias(name)
        for i, name in enumerate(names, start=1)
    ]


def json_number(col: Column, path: str, default: float | None = None) -> Column:
    """Number under a JSON path, with a default for an absent or bad field."""
    value = F.get_json_object(col, path).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def json_text(col: Column, path: str, default: str | None = None) -> Column:
    value = F.get_json_object(col, path)
    return value if default is None else F.coalesce(value, F.lit(default))

"""Batch gates and constraint reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslake.operators.reshape import union_all


class BatchRejected(ValueError):
    """A batch broke a rule; nothing was written."""


def rule_counts(df: DataFrame, rules: Mapping[str, Column], minimum_rows: int = 1) -> DataFrame:
    """One row per rule with the number of violations, from a single pass.

    A rule is a condition that marks a bad row. ``too_few_rows`` is always reported.
    """
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count_if(condition).alias(f"_r{n}") for n, condition in enumerate(rules.values())),
    )
    short = F.when(F.col("_rows") < minimum_rows, F.lit(1)).otherwise(F.lit(0)).cast("long")
    pairs = [F.struct(F.lit("too_few_rows").alias("rule"), short.alias("violations"))]
    pairs += [
        F.struct(F.lit(name).alias("rule"), F.col(f"_r{n}").alias("violations"))
        for n, name in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*pairs)))


def refuse(broken: Mapping[str, int]) -> None:
    """Raise when any of the counted rules is broken."""
    found = {rule: count for rule, count in broken.items() if count}
    if found:
        raise BatchRejected(", ".join(f"{rule}: {count}" for rule, count in found.items()))


def require(df: DataFrame, rules: Mapping[str, Column], minimum_rows: int = 1) -> None:
    """Raise when any rule is broken (collects one small row per rule)."""
    refuse({r.rule: r.violations for r in rule_counts(df, rules, minimum_rows).collect()})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def constraint_report(
    tables: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]],
) -> DataFrame:
    """Violations per (table, constraint) for ``{name: (frame, key, not-null columns)}``."""
    parts = []
    for name, (df, key, not_null) in tables.items():
        label = f"primary key ({', '.join(key)})"
        parts.append(
            duplicate_keys(df, key)
            .agg(F.count(F.lit(1)).alias("violations"))
            .select(
                F.lit(name).alias("table_name"), F.lit(label).alias("constraint_name"), "violations"
            )
        )
        if not_null:
            parts.append(
                rule_counts(df, {f"not null ({c})": F.col(c).isNull() for c in not_null}, 0)
                .filter(F.col("rule") != "too_few_rows")
                .select(
                    F.lit(name).alias("table_name"), F.col("rule").alias("constraint_name"), "violations"
                )
            )
    return union_all(parts)

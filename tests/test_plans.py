"""Shapes of physical plans, and results that must not depend on the partition count."""

import re

import pytest

import __spark_entry__ as entry
from serieslake.plans import monetary
from standins import jobs, registered, sheets, stores

FOLDER = "/root/testdata/sf0.001"

# These write tables while being called; their plan is only the read-back.
WRITERS = {*stores.QUERIES, *jobs.QUERIES}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registered()) - WRITERS))
def test_no_unbounded_operators(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    # a window without partition keys would gather everything in one task
    for window in re.findall(r"Window \[.*", plan):
        assert not re.search(r"\], \[\](, \[\])?$", window), window
        assert not re.search(r"windowspecdefinition\(\w+#\d+L? ASC", window) or re.search(
            r"\], \[[^\]]+\], \[", window
        ), window


def exchanges(spark, name) -> list[str]:
    return re.findall(r"Exchange (\w+)", plan_of(entry.queries()[name](spark, FOLDER)))


def test_flagship_shuffles_twice(spark):
    """Once for the daily means, once for the series; the scalar end date is apart."""
    assert exchanges(spark, "w6_compound").count("hashpartitioning") == 2


def test_sheet_rows_need_no_shuffle(spark):
    for name in ("s1_sheet_rows", "q18_real_exchange", "q15_repo_sheet", "p6_ordinal_month"):
        assert exchanges(spark, name) == []


def test_sheet_cells_need_one_shuffle(spark):
    assert exchanges(spark, "s1_sheet_range").count("hashpartitioning") == 1


def test_only_needed_columns_are_read(spark):
    plan = plan_of(entry.queries()["w6_compound"](spark, FOLDER))
    assert "struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan


@pytest.mark.parametrize("name", ["w6_compound", "w3_long_scan", "w7_seasonal", "q3_price_observations"])
def test_independent_of_partition_count(spark, name):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for count in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            found.append(sorted(map(str, entry.queries()[name](spark, FOLDER).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_filters_on_deposit_rows_make_one_cell(spark):
    """A filter on a cell must not make all cells of a row, for the rows of every sheet."""
    rows = sheets.deposit_rows(spark, FOLDER)
    found = monetary.deposit_tables(rows, monetary.deposit_loads(rows, "dep"))["depUVA"]
    conditions = re.findall(r"Filter .*", plan_of(found))
    assert conditions and not any("transform(" in c for c in conditions)

"""Ordered-series operators: edge values, hand-computed results, plans."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from serieslake.operators import joins, load, reshape, series
from serieslake.plans import repo
from serieslake.session import scratch_path


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n - 1)


def frame(spark, rows, schema="s string, d date, x double"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def gappy(spark):
    """1, 2, null, 4, 0, 5 in one series and a leading null in another."""
    first = [("a", day(i), v) for i, v in enumerate([1.0, 2.0, None, 4.0, 0.0, 5.0], start=1)]
    second = [("b", day(i), v) for i, v in enumerate([None, 3.0, 6.0], start=1)]
    return frame(spark, first + second)


def column(df, name, by="s", order="d"):
    return [r[name] for r in df.orderBy(by, order).collect()]


@pytest.mark.parametrize("bucket", [None, "week", "day", "year"])
def test_changes_pad_and_avoid_zero(gappy, bucket):
    cut = F.date_trunc(bucket, "d") if bucket else None
    found = series.changes(gappy, ["s"], ["d"], {"v": "x"}, bucket=cut)
    assert column(found, "v") == [None, 1.0, 0.0, 1.0, -1.0, None, None, None, 1.0]


def test_changes_without_padding(gappy):
    found = series.changes(gappy, ["s"], ["d"], {"v": "x"}, fill=False)
    assert column(found, "v") == [None, 1.0, None, None, -1.0, None, None, None, 1.0]


@pytest.mark.parametrize("bucket", [None, "week", "day"])
def test_fill_and_product(gappy, bucket):
    cut = F.date_trunc(bucket, "d") if bucket else None
    found = series.running(
        gappy, ["s"], ["d"], fills={"f": "x"}, previous={"p": "x"}, products={"c": "x"}, bucket=cut
    )
    assert column(found, "f") == [1, 2, 2, 4, 0, 5, None, 3, 6]
    assert column(found, "p") == [None, 1, 2, 2, 4, 0, None, None, 3]
    assert column(found, "c") == [1, 2, None, 8, 0, 0, None, 3, 18]


def test_bucketed_scan_equals_plain_scan_on_random_data(spark):
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame(
        {
            # one series holds most of the rows
            "s": rng.choice(["hot", "b", "c"], n, p=[0.8, 0.1, 0.1]),
            "t": rng.integers(0, 400, n),
            "i": np.arange(n),
            "x": np.where(rng.random(n) < 0.3, np.nan, rng.random(n) + 0.5),
        }
    )
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    arguments = dict(fills={"f": "x"}, previous={"p": "x"}, products={"c": "x"})
    plain = series.running(df, ["s"], ["t", "i"], **arguments)
    cut = series.running(df, ["s"], ["t", "i"], **arguments, bucket=F.floor(F.col("t") / 16))
    keep = ["i", "f", "p", F.round("c", 6).alias("c")]
    assert sorted(map(str, plain.select(*keep).collect())) == sorted(
        map(str, cut.select(*keep).collect())
    )


def test_densified_calendar(spark):
    rows = [("a", day(1), 1.0), ("a", day(4), None), ("a", day(5), 7.0), ("b", day(3), 2.0)]
    df = frame(spark, rows)
    carried = series.densified(df, ["s"], "d", ["x"], end="2024-01-06")
    assert column(carried, "x") == [1, 1, 1, 1, 7, 7, 2, 2, 2, 2]
    plain = series.densified(df, ["s"], "d", ["x"], end="2024-01-06", carry=False)
    assert column(plain, "x") == [1, None, None, None, 7, None, 2, None, None, None]
    spine = joins.on_calendar(df, "d", ["s"], end="2024-01-06").select("s", "d", "x")
    assert sorted(map(str, spine.collect())) == sorted(map(str, plain.collect()))


def test_densified_end_before_data(spark):
    df = frame(spark, [("a", day(1), 1.0), ("a", day(9), 2.0), ("b", day(9), 3.0)])
    found = series.densified(df, ["s"], "d", ["x"], end="2024-01-03")
    assert column(found, "x") == [1, 1, 1]


def test_two_rows_for_a_date_fail(spark):
    df = frame(spark, [("a", day(1), 1.0), ("a", day(1), 2.0)])
    with pytest.raises(Exception, match="two rows for one date"):
        series.densified(df, ["s"], "d", ["x"]).collect()


def test_compounded_index_by_hand(spark):
    """Three days with a gap on the second, and a tenor of 0 on the last."""
    df = spark.createDataFrame(
        [("a", day(1), 0.4, 5), ("a", day(3), 0.6, 0)], "s string, date date, vwap double, n int"
    )
    found = series.compounded_index(df, ["s"], "date", "vwap", "n", end="2024-01-04")
    rows = found.orderBy("date").collect()
    r = (1 + 0.4 / 365 * 5) ** (1 / 5) - 1
    r3 = (1 + 0.45 / 365 * 5) ** (1 / 5) - 1
    assert [x.ted for x in rows] == pytest.approx([r, r, 0, 0])
    assert [x.factor for x in rows] == pytest.approx([1 + r, 1 + r, 1, 1])
    assert [x.cap for x in rows] == pytest.approx([1 + r, (1 + r) ** 2, (1 + r) ** 2, (1 + r) ** 2])
    assert [x.cap2 for x in rows][1] == pytest.approx((1 + r3) ** 2)
    assert found.columns == ["s", "date", "ted", "ted2", "ted3", "factor", "factor2", "factor3", "cap", "cap1", "cap2"]


def test_index_ratio_equals_factor(spark):
    rows = [("a", day(i), 0.1 * i, 1 + i % 3) for i in range(1, 20) if i % 4]
    df = spark.createDataFrame(rows, "s string, date date, vwap double, n int")
    pdf = series.compounded_index(df, ["s"], "date", "vwap", "n").orderBy("date").toPandas()
    ratios = pdf["cap"].iloc[1:].to_numpy() / pdf["cap"].iloc[:-1].to_numpy()
    assert ratios == pytest.approx(pdf["factor"].iloc[1:].to_numpy())


def test_year_over_year_leap_day_and_gaps(spark):
    rows = [
        ("a", dt.date(2023, 2, 28), 10.0),
        ("a", dt.date(2024, 2, 28), 20.0),
        ("a", dt.date(2024, 2, 29), 30.0),
        ("a", dt.date(2024, 3, 31), 40.0),
        ("b", dt.date(2023, 3, 31), 1.0),
        ("a", None, 5.0),
    ]
    found = series.year_over_year(frame(spark, rows), "d", ["x"], ["s"]).orderBy("d").collect()
    assert [(r.d.isoformat(), r.x) for r in found] == [("2024-02-28", 1.0), ("2024-02-29", 2.0)]


def test_seasonal_adjustment_recovers_a_multiplicative_pattern(spark):
    pattern = np.array([0.8, 0.9, 1.0, 1.1, 1.2, 1.0, 1.0, 0.9, 1.1, 1.05, 0.95, 1.0])
    pattern = pattern / pattern.mean()
    months = pd.date_range("2018-01-01", periods=48, freq="MS")
    rows = [("a", m.date(), float(100 * pattern[m.month - 1])) for m in months]
    found = series.seasonally_adjusted(frame(spark, rows), ["s"], "d", "x").orderBy("d").collect()
    assert [r.trend is None for r in found] == [True] * 6 + [False] * 36 + [True] * 6
    assert [r.seasonal for r in found] == pytest.approx([pattern[r.d.month - 1] for r in found])
    assert [r.adjusted for r in found] == pytest.approx([100.0] * 48)


def test_short_series_stays_unadjusted(spark):
    rows = [("a", dt.date(2020, m, 1), float(m)) for m in range(1, 11)]
    found = series.seasonally_adjusted(frame(spark, rows), ["s"], "d", "x").collect()
    assert {r.adjusted for r in found} == {None}


def test_combine_first(spark):
    a = frame(spark, [("k", day(1), 1.0), ("k", day(2), None)])
    b = frame(spark, [("k", day(2), 5.0), ("k", day(3), 6.0), ("k", day(1), 9.0)])
    found = joins.combine_first(a, b, ["s", "d"], ["x"])
    assert column(found, "x") == [1.0, 5.0, 6.0]


def test_null_dates_never_match(spark):
    a = spark.createDataFrame([(None, 1.0), (day(1), 2.0)], "date date, a double")
    b = spark.createDataFrame([(None, 3.0), (day(1), 4.0)], "date date, b double")
    assert [tuple(r) for r in joins.on_date(a, b).collect()] == [(day(1), 2.0, 4.0)]


def test_every_markup_has_its_columns(spark):
    rows = [("a", dt.date(2024, 1, n), 0.4, 1) for n in (1, 2, 4)]
    df = spark.createDataFrame(rows, "s string, date date, vwap double, daysToMaturity int")
    found = series.compounded_index(df, ["s"], "date", "vwap", "daysToMaturity", markups=(0.0, 0.03, 0.05, 0.1))
    assert {"ted", "ted2", "ted3", "ted4", "cap", "cap1", "cap2", "cap3"} <= set(found.columns)
    assert found.count() == 4


def test_repeated_positions_fail(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, 1), ("a", dt.date(2024, 1, 1), 2.0, 1)], "s string, date date, v double, t int")
    with pytest.raises(Exception, match="two rows"):
        series.ordinal(df, ["s"], ["date"], "n").collect()
    with pytest.raises(Exception, match="two rows"):
        series.compounded_index(df, ["s"], "date", "v", "t").count()


def test_pivot_refuses_unlisted_items_and_hidden_duplicates(spark):
    df = spark.createDataFrame([("d", "x", 1.0), ("d", "y", 2.0), ("d", "y", 3.0)], "d string, k string, v double")
    with pytest.raises(Exception, match="duplicate pivot cell"):
        reshape.pivot_unique(df, ["d"], "k", ["x", "y"], "v").select("d", "x").collect()
    with pytest.raises(Exception, match="not listed"):
        reshape.pivot_unique(df.filter("v < 3"), ["d"], "k", ["x"], "v").collect()


def test_a_repeated_date_fails_changes_and_year_ago(spark):
    rows = [("a", dt.date(2023, 1, 1), 1.0), ("a", dt.date(2024, 1, 1), 2.0), ("a", dt.date(2024, 1, 1), 3.0)]
    hour = F.year("d")
    for found in (
        lambda df: series.changes(df, ["s"], ["d"], {"c": "x"}),
        lambda df: series.changes(df, ["s"], ["d"], {"c": "x"}, fill=False),
        lambda df: series.changes(df, ["s"], ["d"], {"c": "x"}, bucket=hour),
        lambda df: series.year_over_year(df, "d", ["x"], ["s"]),
        lambda df: series.year_over_year(df, "d", ["x"]),
    ):
        assert found(frame(spark, rows[:2])).count() >= 1
        with pytest.raises(Exception, match="two rows for one"):
            found(frame(spark, rows)).collect()


def test_year_ago_needs_one_shuffle_and_no_join(spark):
    days = [dt.date(2023, 2, 28), dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2025, 2, 28), dt.date(2025, 3, 1), None]
    df = frame(spark, [("a", d, float(k + 1)) for k, d in enumerate(days)] + [(None, days[0], 9.0)])
    grown = series.year_over_year(df, "d", ["x"], ["s"])
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {(r.d, r.x) for r in grown.collect()} == {(days[1], 1.0), (days[2], 2.0), (days[3], 1.0)}


def test_index_goes_on_from_its_stored_end(spark):
    days = [dt.date(2024, 1, n) for n in (1, 3, 4, 8, 9, 12)]
    rows = [(s, d, 20.0 + n, n % 3) for s in ("a", "b", None) for n, d in enumerate(days) if s != "b" or n > 2]
    rates = spark.createDataFrame(rows, "s string, date date, vwap double, daysToMaturity int")
    whole = series.compounded_index(rates, ["s"], "date", "vwap", "daysToMaturity", "2024-01-15")
    path = scratch_path(spark, "index")
    for end in ("2024-01-05", "2024-01-10", "2024-01-10", "2024-01-15"):
        repo.extend_index(rates, path, ["s"], end)
    assert sorted(map(tuple, load.read(spark, path).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_as_of_takes_the_latest_vintage_known(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day, dt.date(2024, 2, v), float(v)) for v in (1, 5, 9)] + [("b", day, dt.date(2024, 2, 9), 1.0), ("c", day, None, 1.0)]
    df = spark.createDataFrame(rows, "s string, d date, v date, x double")
    got = series.as_of(df, ["s"], "d", "v", "2024-02-06", ["x"])
    assert list(map(tuple, got.collect())) == [("a", day, dt.date(2024, 2, 5), 5.0)]


def test_filters_find_a_known_season_beside_outliers(spark):
    season = [0.8, 0.9, 1.0, 1.1, 1.2, 1.1, 1.0, 0.9, 1.05, 1.15, 0.85, 0.95]
    months = [dt.date(2010 + k // 12, k % 12 + 1, 1) for k in range(144)]
    rng = np.random.default_rng(4)
    rows = []
    for name in ("clean", "spiked"):
        for k, m in enumerate(months):
            value = 100 * 1.004**k * season[k % 12] * (1 + 0.004 * rng.standard_normal())
            rows.append((name, m, value * (1.6 if name == "spiked" and k in (50, 51, 97) else 1.0)))
    found = series.filtered_adjustment(frame(spark, rows), ["s"], "d", "x").orderBy("s", "d").collect()
    for name in ("clean", "spiked"):
        own = [r for r in found if r.s == name]
        off = [abs(r.seasonal / season[k % 12] - 1) for k, r in enumerate(own)]
        assert max(off[12:-12]) < 0.02 and max(off) < 0.05  # filters are one-sided at the ends
        inner = [r for k, r in enumerate(own) if 8 < k < 135 and not any(abs(k - o) < 8 for o in (50, 51, 97))]
        assert max(abs(r.trend / (100 * 1.004 ** months.index(r.d)) - 1) for r in inner) < 0.01
    spiked = [r for r in found if r.s == "spiked"]
    assert all(spiked[k].weight == 0 for k in (50, 51, 97)) and spiked[97].irregular > 1.2
    assert abs(sum(series.henderson_weights().values()) - 1) < 1e-12
    with pytest.raises(Exception, match="two rows for one position"):
        series.filtered_adjustment(frame(spark, [*rows, rows[0]]), ["s"], "d", "x").collect()

"""Scalar functions on edge values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from serieslake.functions import dates, numbers, text
from serieslake.plans import exchange


def values(spark, inputs, expression, kind="string"):
    """Apply an expression of column ``x`` to each input, in one query."""
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_keeps_missing(spark):
    assert values(spark, ["  a b \n", "\t", None], text.strip) == ["a b", "", None]


def test_float_tail_removes_only_the_literal_ending(spark):
    found = values(spark, ["20240110", "20240110.0", "20240102.05", "100.00"], text.strip_float_tail)
    assert found == ["20240110", "20240110", "20240102.05", "100.00"]


def test_extract_groups_without_match(spark):
    df = spark.createDataFrame([("USD / ARS 000 150324",), ("nada",), (None,)], "t string")
    groups = text.extract_groups(
        F.col("t"), r"([A-Z]+)\s*/\s*([A-Z]+)\s*(\d+)\s*(\d{6})", ["a", "b", "c", "d"]
    )
    assert [tuple(r) for r in df.select(*groups).collect()] == [
        ("USD", "ARS", "000", "150324"),
        (None,) * 4,
        (None,) * 4,
    ]


def test_numbers(spark):
    assert values(spark, ["1.5", " 7 ", "x", "NaN", None, "-3e2"], numbers.to_number) == [
        1.5, 7.0, None, None, None, -300.0,
    ]
    assert values(spark, ["s/o", None, "S/O", "4"], numbers.placeholder_to_zero) == [0, 0, None, 4]
    assert values(spark, ["$1.234,56", "1500,000", "7", ""], numbers.point_thousands) == [
        1234.56, 1500.0, 7.0, None,
    ]
    assert values(spark, ["1,234.5", "12"], numbers.comma_thousands) == [1234.5, 12.0]
    assert values(spark, ["$1.234,56"], numbers.implied_cents) == [1234.56]
    assert values(spark, ["1.234 kg", "430"], numbers.digits_only) == [1234.0, 430.0]


def test_daily_effective_rate_by_hand(spark):
    df = spark.createDataFrame([(0.5, 7), (0.5, 0), (None, 3), (0.5, None)], "r double, n int")
    found = [
        tuple(r)
        for r in df.select(
            numbers.daily_effective_rate(F.col("r"), F.col("n")),
            numbers.daily_effective_rate(F.col("r"), F.col("n"), 0.03),
        ).collect()
    ]
    assert found[0] == pytest.approx(
        ((1 + 0.5 / 365 * 7) ** (1 / 7) - 1, (1 + 0.53 / 365 * 7) ** (1 / 7) - 1)
    )
    assert found[1:] == [(0.0, 0.0), (None, None), (None, None)]


def test_change_from_zero_is_null(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.change(F.col("a"), F.col("b"))).collect()] == [None, 0.25]


@pytest.mark.parametrize(
    "fmt, good, bad",
    [
        ("dd/MM/yyyy", "05/03/2024", "31/02/2024"),
        ("dd/MM/yy", "05/03/24", "5/3/24"),
        ("yyyyMMdd", "20240305", "2024035"),
        ("yyMMdd", "240305", "Fuente: x"),
        ("ddMMyy", "050324", "320324"),
        ("yyyy-MM-dd HH:mm:ss", "2024-03-05 10:11:12", "2024-03-05"),
    ],
)
def test_parse(spark, fmt, good, bad):
    found = values(spark, [good, bad, None], lambda x: dates.parse(x, fmt))
    assert found == [dt.date(2024, 3, 5), None, None]


def test_parse_iso_is_strict(spark):
    good = ["2024-02-29", "2024-02-29 23:59:59"]
    bad = ["2023-02-29", "2024-02-29 24:00:00", "2024-2-29", "45292", "2024", "2024-02-29x", None]
    found = values(spark, good + bad, dates.parse_iso)
    assert found == [dt.date(2024, 2, 29)] * 2 + [None] * len(bad)


def test_serial_or_text(spark):
    found = values(
        spark, ["45292", "45292.0", "45292.75", "1/1/2024", "01-01-2024", "2024-01-01", "x", None],
        dates.from_serial_or_text,
    )
    assert found == [dt.date(2024, 1, 1)] * 6 + [None, None]


def test_calendar(spark):
    day = [dt.date(2024, 2, 29)]
    assert values(spark, day, dates.year_before, "date") == [dt.date(2023, 2, 28)]
    assert values(spark, day, dates.next_day, "date") == [dt.date(2024, 3, 1)]
    assert values(spark, day, dates.first_of_year, "date") == [dt.date(2024, 1, 1)]
    assert values(spark, day, dates.last_of_year, "date") == [dt.date(2024, 12, 31)]
    assert values(spark, day, dates.vintage, "date") == ["02_24"]
    assert values(spark, [2], lambda x: dates.ordinal_month("2004-01-01", x), "int") == [
        dt.date(2004, 3, 1)
    ]


def test_epochs(spark):
    assert values(spark, [-9223372037, 86399], dates.from_epoch_seconds, "bigint")[1] == dt.date(1970, 1, 1)
    assert values(spark, [19723], dates.from_epoch_days, "int") == [dt.date(2024, 1, 1)]


def test_time_of_day(spark):
    assert values(spark, ["23:59:59", "24:00:00", "9:00:00", None], dates.time_of_day) == [
        "23:59:59", None, None, None,
    ]
    assert values(spark, ["01:02:03", "x"], dates.seconds_of_day) == [3723, None]


def test_days_between_backwards_is_empty(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 3), dt.date(2024, 1, 1))], "a date, b date")
    assert df.select(dates.days_between(F.col("a"), F.col("b"))).head()[0] == []


def test_odd_dates_serials_numbers_and_titles(spark):
    def one(column, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()))
        return row.select(column).first()[0]

    day = dt.date(2024, 1, 2)
    for text_, want in {
        "2024-01-02T00:00:00": day, "2024-01-02 00:00:00.000": day, "2024-01-02T10:20Z": day, "2024-01-02 25:00:00": None, "2024-01-02x": None
    }.items():
        assert one(dates.parse_iso(F.col("x")), x=text_) == want
    assert one(dates.from_serial(F.col("x")), x=99999999999.0) is None
    assert one(dates.from_serial(F.col("x")), x=20240110.0) is None
    assert one(dates.from_serial(F.col("x")), x=45293.5) == day
    for text_, want in {"1d": None, "2f": None, "Infinity": None, "-inf": None, "NaN": None, "0x1p3": None, " 1.5e3 ": 1500.0}.items():
        assert one(numbers.to_number(F.col("x")), x=text_) == want
    assert one(numbers.daily_effective_rate(F.col("x"), F.lit(400)), x=-1.0) is None
    assert one(text.extract_groups(F.col("x"), r"(\d+)", ["n"])[0], x="no digits here") is None
    assert one(text.extract_groups(F.col("x"), r"a(\d+)|b", ["n"])[0], x="xa12y") == "12"

    def parts(read, title):
        df = spark.createDataFrame([(title,)], "x string").select(*read(F.col("x")))
        return tuple(df.first())

    assert parts(exchange.title_parts, "USD / ARS 000 150324") == ("USD", "ARS", "000", "150324")
    assert parts(exchange.title_parts, "USD/ARS024150324 ") == ("USD", "ARS", "024", "150324")
    assert parts(exchange.title_parts, "sin formato") == (None,) * 4
    assert parts(exchange.screen_parts, "USD MEP / ARS A01 150324") == ("USD MEP", "ARS", "A01", "150324")
    assert parts(exchange.screen_parts, "DLR ARS 000 150324") == ("DLR", "ARS", "000", "150324")

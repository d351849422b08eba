"""Sheets, markup, payloads, text files, tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from serieslake.plans import activity, exchange, prices, trades
from serieslake.sources import delimited, layouts, markup, records, sheets, tables


def test_layout_widths_and_positions():
    widths = {
        "A3500": 2, "CER": 2, "UVA": 2, "EMAE": 6, "ITCRM": 16, "bmBCRA": 30, "reservas": 13,
        "depositos": 28, "prestamos": 20, "tasas": 22, "instrumentos": 46, "serieDiaria": 32,
        "pases": 22, "balance_cambiario": 9,
    }
    known = [*layouts.NARROW, layouts.EMAE, layouts.ITCRM, *layouts.MONETARY,
             layouts.SERIE_DIARIA, layouts.PASES, layouts.BALANCE_CAMBIARIO]
    assert {one.table: len(one.columns()) for one in known} == widths
    assert dict(layouts.MONETARY[0].columns())["tipoSerie"] == sheets.column_index("AG")
    assert dict(layouts.SERIE_DIARIA.columns())["date"] == 2
    assert len(layouts.DASHBOARD_BLOCKS) == 12
    assert len(layouts.price_columns()) == 126 and len(layouts.PRICE_ROWS) == 127
    assert layouts.variation_name("gbaSalud") == "varGbaSalud"


def test_arity_is_checked():
    wrong = sheets.SheetRange("t", "s", "A", "C", 1, ("date", "x"))
    with pytest.raises(ValueError, match="2 names for 3 columns"):
        wrong.columns()


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("b", "S", 1, ["title", None, None]),
        ("b", "S", 2, ["2024-01-01", "1.5", "D"]),
        ("b", "S", 3, ["45293", "s/o", "M"]),
        ("b", "S", 4, ["Fuente: x", "3", "D"]),
        ("b", "S", 5, [None, "4", "D"]),
        ("b", "S", 6, ["2024-01-05", None, "D"]),
        ("b", "other", 2, ["2024-01-01", "9", "D"]),
        ("b", "S", 7, ["2024-01-07"]),
    ]
    return spark.createDataFrame(data, "workbook string, sheet string, row bigint, cells array<string>")


LAYOUT = sheets.SheetRange(
    "t", "S", "A", "C", 2, ("date", "x", "tipoSerie"), text_columns=("tipoSerie",), required=("date",)
)
READ = [
    (dt.date(2024, 1, 1), 1.5, "D"),
    (dt.date(2024, 1, 2), None, "M"),
    (dt.date(2024, 1, 5), None, "D"),
    (dt.date(2024, 1, 7), None, None),
]


def test_range_from_rows_and_from_cells(rows):
    picked = lambda df: [tuple(r)[2:] for r in df.orderBy("row").collect()]
    assert picked(sheets.read_rows(rows, LAYOUT)) == READ
    assert picked(sheets.read_cells(sheets.rows_to_cells(rows), LAYOUT)) == READ


def test_placeholder_only_where_configured(rows):
    from dataclasses import replace

    zeroed = replace(LAYOUT, zero_markers={"x": "s/o"})
    expected = [1.5, 0.0, 0.0, 0.0]
    for df in (
        sheets.read_rows(rows, zeroed),
        sheets.read_cells(sheets.rows_to_cells(rows), zeroed),
    ):
        assert [r.x for r in df.orderBy("row").collect()] == expected


def test_observations(rows):
    found = sheets.read_observations(rows, [LAYOUT]).orderBy("obs_date").collect()
    # the short row has no cell for x: a null observation, as in the wide table
    assert [(r.series_id, r.obs_date, r.value, r.freq) for r in found] == [
        ("x", d, v, f) for d, v, f in READ
    ]


def test_until_blank(rows):
    inside = rows.filter("sheet = 'S' and row >= 2")
    kept = sheets.until_blank(inside, ["workbook"], "row", F.get("cells", F.lit(0)))
    assert sorted(r.row for r in kept.collect()) == [2, 3, 4]


def test_activity_months_are_given_before_rows_drop(spark):
    data = [("e", "0", 5 + i, ["", "", v, "1", "1", "1", "1", "1"]) for i, v in enumerate(["9", None, "7"])]
    df = spark.createDataFrame(data, "workbook string, sheet string, row bigint, cells array<string>")
    found = activity.activity_index(df).orderBy("date").collect()
    assert [(r.date, r.EMAE) for r in found] == [(dt.date(2004, 1, 1), 9.0), (dt.date(2004, 3, 1), 7.0)]


def test_price_sheet_read_sideways(spark):
    rows_of = layouts.PRICE_ROWS
    cells = []
    for col, (month, base) in enumerate([("2016-12-01", 100.0), ("2017-01-01", 110.0)], start=1):
        cells.append(("w", "2", rows_of[0], col, month))
        cells += [("w", "2", r, col, str(base + i)) for i, r in enumerate(rows_of[1:])]
        cells.append(("w", "2", 28, col, "note"))  # a row that is not read
    df = spark.createDataFrame(cells, "workbook string, sheet string, row bigint, col int, value string")
    wide = prices.price_index(df).orderBy("date").collect()
    assert len(wide) == 2 and len(wide[0]) == 2 + 252
    assert wide[1].nacionalNivelGeneral == 110.0
    assert wide[1].varPatagoniaServicios == pytest.approx(235 / 225 - 1)
    long = prices.price_observations(df).filter("series_id = 'patagoniaServicios'").orderBy("obs_date")
    assert [r.level for r in long.collect()] == [225.0, 235.0]


def test_two_records_for_one_cell_fail(spark):
    schema = "workbook string, sheet string, row bigint, col int, value string"
    layout = sheets.SheetRange("t", "S", "A", "B", 1, ("date", "x"))
    cells = [("w", "S", 1, 0, "2024-01-02T00:00:00"), ("w", "S", 1, 1, "5")]
    assert sheets.read_cells(spark.createDataFrame(cells, schema), layout).first()["date"] == dt.date(2024, 1, 2)
    with pytest.raises(Exception, match="two records for one cell"):
        sheets.read_cells(spark.createDataFrame([*cells, ("w", "S", 1, 1, "4")], schema), layout).collect()


def test_repeated_headers_keep_their_series(spark):
    assert sheets.unique_names(["date", "x", "x", None, "x"]) == ("date", "x", "x.1", "Unnamed: 3", "x.2")
    with pytest.raises(ValueError, match="stands twice"):
        sheets.SheetRange("t", "S", "A", "C", 1, ("date", "x", "x")).columns()


def test_one_landing_table_of_many_workbooks(spark):
    line = ["", "", "1", "2", "3", "4", "5", "6"]
    data = [("EMAE_06_24", "0", 5, line), ("EMAE_07_24", "0", 5, line), ("ITCRM", "0", 5, ["2024-01-02", *line[2:], *line[2:], "7", "8", "9"])]
    df = spark.createDataFrame(data, "workbook string, sheet string, row bigint, cells array<string>")
    assert {r.workbook for r in activity.activity_index(df, workbook="EMAE").collect()} == {"EMAE_06_24", "EMAE_07_24"}
    assert activity.activity_index(df, workbook="EMAE_06").count() == 1
    assert [r.workbook for r in activity.real_exchange_rate(df, workbook="ITCRM").collect()] == ["ITCRM"]


def test_lines_with_more_cells_than_names_fail(spark):
    page = "<table class='table-custom'><tr>" + "<td>1" * 10 + "</table>"
    df = spark.createDataFrame([("01/02/2024", page)], "date string, html string")
    with pytest.raises(Exception, match="more than 9 cells"):
        prices.livestock_prices(df, "html", "date").collect()


PAGE = """<html><table class="other"><tr><td>no</td></tr></table>
<TABLE id=x class='a table-custom b'><thead><tr><th>Uno</th><th>Dos</th></tr></thead>
<tr><td> <b>1</b> </td><td>x &amp; &lt;y&gt;</td></tr><tr><td>2<td>z</table></html>"""


def test_tables_by_class_and_by_heading(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "id int, html string")
    expected = [(1, 1, 1, ["1", "x & <y>"]), (1, 1, 2, ["2", "z"])]
    for found in (
        markup.table_rows(df, "html", ["id"], css_class="table-custom"),
        markup.table_rows(df, "html", ["id"], headers=["Dos", "Uno"]),
    ):
        assert [tuple(r) for r in found.orderBy("line").collect()] == expected
    assert markup.table_rows(df, "html", ["id"], headers=["Tres"]).isEmpty()
    parsed = markup.parsed_tables(df, "html", "id").filter("`table` = 1").orderBy("line")
    assert [tuple(r) for r in parsed.collect()] == expected


def test_both_readers_see_headings_spans_references_and_comments(spark):
    page = (
        "<table><tr><th>Uno<th>Dos<tr><th>Vaqu&iacute;a &#243;<td>1 &#x2014; &amp;lt;</tr><!-- <tr><td>old<td>2</tr> -->"
        "<tr><td colspan=2>both&nbsp;x<td>&copy; &unknown; &#128512;</table>"
    )
    df = spark.createDataFrame([(1, page)], "id int, html string")
    expected = [(1, 0, 1, ["Vaquía ó", "1 — &lt;"]), (1, 0, 2, ["both x", "both x", "© &unknown; 😀"])]
    for found in (markup.table_rows(df, "html", ["id"], headers=["Dos"]), markup.parsed_tables(df, "html", "id")):
        assert [tuple(r) for r in found.orderBy("line").collect()] == expected


def test_livestock_units(spark):
    cells = ["Vacas", "1500,000", "1.600,500", "1550,250", "1555,000", "1.234", "$1.234.567,89", "98.765", "430 kg"]
    line = "".join(f"<td>{c}</td>" for c in cells)
    blank = "".join(f"<td>{c}</td>" for c in [*cells[:-1], ""])
    html = f'<table class="table-custom"><tr>{line}</tr><tr>{blank}</tr></table>'
    df = spark.createDataFrame([("05/03/2024", html)], "d string, html string")
    (row,) = prices.livestock_prices(df, "html", "d").collect()
    assert tuple(row) == (
        "2024-03-05", "Vacas", 1500.0, 1600.5, 1550.25, 1555.0, 1234.0, 1234567.89, 98765.0, 430.0,
    )


def test_record_arrays(spark):
    bodies = [('{"data":[{"a":1,"b":"x","c":9},{"a":null}]}',), ("broken",), ('{"data":[]}',)]
    df = spark.createDataFrame(bodies, "body string")
    assert sorted(map(tuple, records.record_array(df, "body", "a int, b string").collect()), key=str) == [
        (1, "x"), (None, None),
    ]
    raw = records.record_array(df, "body", "a int", with_raw=True).filter("a = 1").head()
    assert raw.raw == '{"a":1,"b":"x","c":9}'
    flat = spark.createDataFrame([('[{"a":5}]',)], "body string")
    assert records.record_array(flat, "body", "a int", field=None).head().a == 5


def test_consolidated_rate_priority_and_duplicates(spark):
    quotes = [
        ("2024-01-01", "CCL", 10.0), ("2024-01-01", "CCL3", 11.0),
        ("2024-01-02", "CCL3", 12.0), ("2024-01-02", "CCL1", 13.0),
        ("2024-01-03", "CCL1", 14.0), ("2024-01-04", "MEP", 15.0),
    ]
    schema = "dateTime string, spot string, normalizedPrice double"
    df = spark.createDataFrame(quotes, schema)
    found = exchange.consolidated_rate(df).orderBy("date").collect()
    assert [(r.ccl, r.ccl3) for r in found] == [(10.0, 11.0), (12.0, 12.0), (14.0, None)]
    assert exchange.has_quotes(df) and not exchange.has_quotes(df.filter("spot = 'MEP'"))
    doubled = df.union(spark.createDataFrame([quotes[0]], schema))
    with pytest.raises(Exception, match="duplicate pivot cell"):
        exchange.consolidated_rate(doubled).collect()


def test_request_windows_with_empty_table(spark):
    empty = spark.createDataFrame([], "date date")
    window = exchange.request_window(empty, "2024-01-03").head()
    assert tuple(window) == (dt.date(2000, 1, 2), dt.date(2024, 1, 3))
    stored = spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date")
    assert [r.date_from.day for r in prices.daily_requests(stored, "2024-01-03").collect()] == [2, 3]
    assert prices.daily_requests(stored, "2023-12-01").isEmpty()


def test_trade_pages(spark):
    pages = [
        ("bonds", 1, '{"content":{"page_count":2},"data":[{"a":1}]}'),
        ("bonds", 2, '{"content":{"page_count":2},"data":[{"a":2}]}'),
        ("bills", 1, '{"content":{"page_count":3},"data":[{"b":"x"}]}'),
        ("notes", 1, '{"data":[]}'),
    ]
    df = spark.createDataFrame(pages, "endpoint string, page int, body string")
    assert [tuple(r) for r in trades.page_gaps(df, "body").collect()] == [("bills", 1, 3)]
    found = trades.trades(df, "body", "2024-06-03", {"bonds": "a int", "bills": "b string"})
    assert found.columns == ["date", "endpoint", "a", "b"]
    assert sorted(map(tuple, found.drop("date").collect()), key=str) == [
        ("bills", None, "x"), ("bonds", 1, None), ("bonds", 2, None),
    ]


def test_refresh_plan(spark):
    tickers = spark.createDataFrame(
        [("A", "x", "pricesArg"), ("B", "x", "pricesArg"), ("C", "x", "pricesArg"), ("D", "x", "z")],
        "ticker string, type string, nombre string",
    )
    day = lambda n: dt.date(2024, 1, n)
    stored = spark.createDataFrame(
        [("A", day(1), False), ("A", day(2), False), ("A", day(9), True), ("B", day(3), True), ("D", day(1), False)],
        "ticker string, date date, matured boolean",
    )
    assert [tuple(r) for r in prices.refresh_plan(tickers, stored).collect()] == [("A", "x", day(3))]


def test_delimited_reads_by_position(spark, tmp_path):
    (tmp_path / "f.csv").write_text("series_id   \tyear\tperiod\tvalue\tnotes\nCUUR0000SA0   \t2024\tM01\t 1.5\t\nOTHER\tx\tM02\t2\tn\n")
    df = delimited.read(spark, str(tmp_path / "f.csv"), prices.US_PRICE_SCHEMA, sep="\t")
    assert df.count() == 2
    found = prices.us_prices(spark, str(tmp_path / "f.csv")).collect()
    assert [(r.series_id, r.year, r.period) for r in found] == [("CUUR0000SA0", 2024, "M01")]


def test_get_table_unknown_name(spark):
    spark.createDataFrame([("x", "default")], "name string, db string").createOrReplaceTempView("known")
    assert tables.get_table(spark, "nope", catalog="known") is None


SPANS = [
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>",
    "<table class=big><tr><th rowspan='2'>h</th><th colspan=2>k</th></tr><tr><th>l</th><th>m</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>",
    "<TABLE><TR><TD>a<TD rowspan=3 colspan=2>b<TD>c<TR><TD>d<TD>e<TR><TR><TD>f</TABLE>",
    "<table><tr><td>a<td rowspan=0>b<tr><td>c<tr><td>d<td>e</table><table><tr><td>x</table>",
    "<table><tr><td>a<td>b<td rowspan=2>c<tr></table><table><tr><td colspan=4 rowspan=99999999999>z<tr><td>y</table>",
]


def test_row_spans_in_both_readers(spark):
    pages = spark.createDataFrame(list(enumerate(SPANS)), "id int, html string")
    quick = sorted(tuple(r) for r in markup.table_rows(pages, "html", ["id"]).collect())
    parsed = sorted(tuple(r) for r in markup.parsed_tables(pages, "html", "id").collect())
    assert [r[:3] for r in quick] == [r[:3] for r in parsed] and [list(r[3]) for r in quick] == [list(r[3]) for r in parsed]
    lines = {(r[0], r[1], r[2]): list(r[3]) for r in parsed}
    assert lines[0, 0, 0] == ["a", "b"] and lines[0, 0, 1] == ["a", "c"]
    assert lines[1, 0, 2] == ["1", "2", "3"] and (1, 0, 0) not in lines
    assert lines[2, 0, 1] == ["d", "b", "b", "e"] and lines[2, 0, 3] == ["f"]
    assert lines[3, 0, 1] == ["c", "b"] and lines[3, 0, 2] == ["d", "b", "e"] and lines[3, 1, 0] == ["x"]
    assert lines[4, 1, 1] == ["z"] * 4 + ["y"]


def test_classes_without_quotes(spark):
    pages = spark.createDataFrame([(1, "<table class=tabla><tr><td>x</table><table class='otra tabla'><tr><td>y</table><table class=no><tr><td>z</table>")], "id int, html string")
    assert [r.cells for r in markup.table_rows(pages, "html", ["id"], css_class="tabla").collect()] == [["x"], ["y"]]


def test_spans_of_cells_that_ask_for_none_are_not_cast(spark):
    """Each cast of an empty text raises and catches an error, which took most of the time of a page."""
    asked = ["", " colspan=0", " colspan=03", " colspan=''", " colspan=00000000", " colspan='2'", " colspan=x", ' rowspan="000"']
    body = "".join(f"<tr><td{a}>{k}" for k, a in enumerate(asked))
    pages = spark.createDataFrame([(1, f"<table><tr><td rowspan=1>a{body}</table>"), (2, None)], "id int, html string")
    lines = markup.table_rows(pages, "html", ["id"])
    assert "try_cast" not in lines._jdf.queryExecution().toString().lower()
    quick = sorted(tuple(r) for r in lines.collect())
    assert [len(r[3]) for r in quick] == [1, 1, 1, 3, 1, 1000, 2, 1, 1]
    assert quick[:5] + quick[6:] == [r for r in sorted(tuple(r) for r in markup.parsed_tables(pages, "html", "id").collect()) if r[2] != 5]

"""Rectangular ranges of landed workbook sheets.

Workbooks land in one of two shapes:

``rows``   workbook, sheet, row, cells ARRAY<STRING>   one record per sheet row
``cells``  workbook, sheet, row, col, value            one record per cell

``row`` is the 1-based row of the sheet and ``col`` the 0-based column, both written
by the landing job, so order is data and never recovered by sorting. Reading a range
from ``rows`` is a projection without any shuffle; reading it from ``cells`` needs one
shuffle on the row key, after a map-side merge. Landing tables partitioned by ``sheet`` let a
reader skip the other sheets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslake.functions import dates, numbers, text

KEY = ["workbook", "sheet", "row"]


def column_index(letters: str) -> int:
    """``A`` -> 0, ``Z`` -> 25, ``AA`` -> 26."""
    index = 0
    for letter in letters.upper():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _iso_or_serial(cell: Column) -> Column:
    """A date cell lands as ISO text or as its serial number."""
    return F.coalesce(dates.parse_iso(cell), dates.from_serial(numbers.to_number(cell)))


DATE_READERS: dict[str, Callable[[Column], Column]] = {
    "iso": dates.parse_iso,
    "iso_or_serial": _iso_or_serial,
    "dd/MM/yyyy": lambda cell: dates.parse(cell, "dd/MM/yyyy"),
    "yyyyMMdd": lambda cell: dates.parse(text.strip_float_tail(cell), "yyyyMMdd"),
    "serial_or_text": dates.from_serial_or_text,
}


@dataclass(frozen=True)
class SheetRange:
    """Where a table sits on a sheet and how its columns are typed."""

    table: str
    sheet: str
    first_col: str
    last_col: str
    first_row: int
    names: tuple[str, ...] = ()
    drop: tuple[int, ...] = ()
    date_reader: str = "iso_or_serial"
    date_column: str | None = "date"
    text_columns: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    drop_names: tuple[str, ...] = ()
    zero_markers: dict[str, str] = field(default_factory=dict)
    workbook: str | None = None  # name of the workbook, or its beginning before a vintage

    def of(self, workbook: str | None) -> "SheetRange":
        """The same range in one workbook of a landing table that holds many."""
        return self if workbook is None else replace(self, workbook=workbook)

    def positions(self) -> list[int]:
        """Sheet columns kept, after dropping positions counted within the range."""
        first, last = column_index(self.first_col), column_index(self.last_col)
        return [c for i, c in enumerate(range(first, last + 1)) if i not in self.drop]

    def columns(self) -> list[tuple[str, int]]:
        positions = self.positions()
        if len(positions) != len(self.names):
            raise ValueError(
                f"{self.table}: {len(self.names)} names for {len(positions)} columns"
            )
        if len(set(self.names)) != len(self.names):
            raise ValueError(f"{self.table}: a column name stands twice")
        return [(n, p) for n, p in zip(self.names, positions) if n not in self.drop_names]

    def typed(self, name: str, cell: Column) -> Column:
        if name == self.date_column:
            return DATE_READERS[self.date_reader](cell)
        if name in self.text_columns:
            return cell
        if name in self.zero_markers:
            return numbers.placeholder_to_zero(cell, self.zero_markers[name])
        return numbers.to_number(cell)


def of_workbook(df: DataFrame, workbook: str | None) -> DataFrame:
    """Rows of one workbook in all its vintages; sheet names alone do not tell workbooks apart."""
    return df if workbook is None else df.filter(F.col("workbook").startswith(workbook))


def _in_range(df: DataFrame, layout: SheetRange) -> DataFrame:
    inside = (F.col("sheet") == layout.sheet) & (F.col("row") >= layout.first_row)
    return of_workbook(df, layout.workbook).filter(inside)


def _finish(df: DataFrame, layout: SheetRange) -> DataFrame:
    return df.dropna(subset=list(layout.required)) if layout.required else df


def read_rows(rows: DataFrame, layout: SheetRange) -> DataFrame:
    """Range of a row-form landing table: filter and project, no shuffle."""
    picked = _in_range(rows, layout).select(
        "workbook",
        "row",
        *(
            layout.typed(name, F.get("cells", F.lit(pos))).alias(name)
            for name, pos in layout.columns()
        ),
    )
    return _finish(picked, layout)


def read_cells(cells: DataFrame, layout: SheetRange) -> DataFrame:
    """Range of a cell-form landing table.

    Values are typed before the grouping, so the aggregation buffers are fixed width
    and the cells of one row merge on the map side. Two records for one cell fail the job.
    """
    columns = layout.columns()
    wanted = _in_range(cells, layout).filter(F.col("col").isin([pos for _, pos in columns]))
    words = sorted({pos // 62 for _, pos in columns})
    picked = wanted.groupBy("workbook", "row").agg(
        F.count(F.lit(1)).alias("_cells"),
        *(_seen_columns(word).alias(f"_seen{word}") for word in words),
        *(
            F.max(F.when(F.col("col") == pos, layout.typed(name, F.col("value")))).alias(name)
            for name, pos in columns
            if name not in layout.zero_markers
        ),
        *(
            # An absent cell must read as missing too, so the marker rule runs afterwards.
            F.max(F.when(F.col("col") == pos, F.col("value"))).alias(name)
            for name, pos in columns
            if name in layout.zero_markers
        ),
    )
    distinct = reduce(add, (F.bit_count(f"_seen{word}") for word in words))
    repeated = F.raise_error(F.lit(f"{layout.table}: two records for one cell")).cast("string")
    picked = picked.select(
        F.when(F.col("_cells") > distinct, repeated).otherwise(F.col("workbook")).alias("workbook"),
        "row",
        *(
            layout.typed(name, F.col(name)).alias(name)
            if name in layout.zero_markers
            else F.col(name)
            for name, _ in columns
        ),
    )
    return _finish(picked, layout)


def _seen_columns(word: int) -> Column:
    """A bit for every column met among the ``word``-th 62 columns of a sheet."""
    bit = F.expr(f"shiftleft(1L, cast(col - {62 * word} as int))")
    return F.bit_or(F.when(F.floor(F.col("col") / 62) == word, bit).otherwise(F.lit(0).cast("long")))


def rows_to_cells(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, F.posexplode("cells").alias("col", "value"))


def transposed(cells: DataFrame) -> DataFrame:
    """Swap rows and columns of a cell table; ``read_cells`` then reads sideways.

    Row numbers are 1-based and column numbers 0-based on both sides of the swap.
    """
    return cells.select(
        "workbook",
        "sheet",
        (F.col("col") + 1).cast("long").alias("row"),
        (F.col("row") - 1).cast("int").alias("col"),
        "value",
    )


def header_names(rows: DataFrame, layouts: Sequence[SheetRange], workbook: str) -> dict[str, tuple[str, ...]]:
    """Per table the names in the header row above its range, kept columns only; one scan for all of them."""
    places = {(one.sheet, one.first_row - 1) for one in layouts}
    wanted = reduce(or_, ((F.col("sheet") == sheet) & (F.col("row") == row) for sheet, row in sorted(places)))
    lines = rows.filter((F.col("workbook") == workbook) & wanted).groupBy("sheet", "row").agg(F.min("cells").alias("cells"))
    found = {(line.sheet, line.row): line.cells for line in lines.collect()}  # a line per sheet of the layouts
    names = {}
    for one in layouts:
        cells = found.get((one.sheet, one.first_row - 1))
        if cells is None:
            raise ValueError(f"{one.table}: no header row in {workbook}")
        names[one.table] = unique_names([cells[pos] if pos < len(cells) else None for pos in one.positions()])
    return names


def unique_names(names: Sequence[str | None]) -> tuple[str, ...]:
    """Header names as a workbook reader makes them unique: a repeated name gets ``.1``, ``.2`` and
    so on, a blank one stands for its position."""
    out: list[str] = []
    for place, name in enumerate(names):
        name = name or f"Unnamed: {place}"
        taken, number = name, 0
        while taken in out:
            number += 1
            taken = f"{name}.{number}"
        out.append(taken)
    return tuple(out)


def until_blank(df: DataFrame, by: Sequence[str], order: str, key: Column) -> DataFrame:
    """Rows of each sheet before its first blank key (notes follow the blank).

    The cut per sheet is a plain minimum, merged on the map side, so one huge sheet is
    never gathered into a single task; with one row per sheet it is also the small side
    of the join back.
    """
    cuts = (
        df.filter(key.isNull())
        .groupBy(*by)
        .agg(F.min(order).alias("_cut"))
        .withColumnsRenamed({name: f"_cut_{name}" for name in by})
    )
    on = [F.col(name).eqNullSafe(F.col(f"_cut_{name}")) for name in by]
    joined = df.join(cuts, on, "left")
    return joined.filter(F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).select(
        *df.columns
    )


SHEETS = (
    "sheet string, blocks array<struct<workbook: string, `table`: string, first_row: bigint, date_pos: int, "
    "date_reader: string, freq_pos: int, required: array<int>, series: array<struct<pos: int, name: string, marker: string>>>>"
)


def _layout_table(layouts: Sequence[SheetRange]) -> list[tuple]:
    """The layouts as records: per sheet its blocks, each with the places of its series."""
    blocks: dict[str, list[tuple]] = {}
    for one in layouts:
        columns = dict(one.columns())
        series = [
            (pos, name, one.zero_markers.get(name))
            for name, pos in columns.items()
            if name != one.date_column and name not in one.text_columns
        ]
        required = [columns[name] for name in one.required]
        blocks.setdefault(one.sheet, []).append(
            (
                one.workbook, one.table, one.first_row, columns[one.date_column], one.date_reader,
                columns.get("tipoSerie"), required, series,
            )
        )
    return list(blocks.items())


def read_observations(rows: DataFrame, layouts: Sequence[SheetRange]) -> DataFrame:
    """All ranges at once, in long form: one scan of the landing table, no shuffle.

    The layouts become one small table: the blocks of a sheet with their series. A row meets the blocks
    of its sheet, those it lies in read their date once, and only the places of their series become
    records. Output: workbook, table, series_id, obs_date, freq, value; rows without a date are left out.
    """
    table = F.broadcast(rows.sparkSession.createDataFrame(_layout_table(layouts), SHEETS))
    readers = sorted({one.date_reader for one in layouts})
    inside = lambda block: (
        (F.col("row") >= block["first_row"])
        & F.coalesce(F.col("workbook").startswith(block["workbook"]), F.lit(True))
        & F.forall(block["required"], lambda pos: F.get("cells", pos).isNotNull())
    )
    met = rows.join(table, "sheet").select("workbook", "cells", F.explode(F.filter("blocks", inside)).alias("block"))
    cell = F.get("cells", F.col("block.date_pos"))
    obs_date = F.coalesce(*(F.when(F.col("block.date_reader") == name, DATE_READERS[name](cell)) for name in readers))
    dated = met.select("workbook", "cells", "block", obs_date.alias("obs_date")).filter(F.col("obs_date").isNotNull())
    found = dated.select(
        "workbook",
        F.col("block.table").alias("table"),
        "obs_date",
        F.get("cells", F.col("block.freq_pos")).alias("freq"),
        # blank cells at the end of a row may be missing; they are null observations
        F.inline(
            F.transform(
                "block.series",
                lambda one: F.struct(one["name"].alias("series_id"), one["marker"].alias("_marker"), F.get("cells", one["pos"]).alias("_cell")),
            )
        ),
    )
    cell, marker = F.col("_cell"), F.col("_marker")
    value = F.when(marker.isNotNull() & (cell.isNull() | (cell == marker)), F.lit(0.0)).otherwise(numbers.to_number(cell))
    return found.select("workbook", "table", "series_id", "obs_date", "freq", value.alias("value"))

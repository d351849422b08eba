"""Rows out of rendered HTML pages.

Markup is read with patterns inside the JVM; missing end tags do no harm, comments are skipped, and
character references of every kind are decoded. Heading cells of a body line are cells like the others, and a
cell that spans columns or lines stands once in each. Pages where tags stand in scripts or attributes
need ``parsed_tables``: the standard library's parser in Arrow batches, with the same rules; scripts are no text there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslake.session import ship

# The named entities that plain HTML text cannot do without; the ampersand goes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&amp;": "&"}

MOST_COLUMNS, MOST_LINES = 1000, 65534  # fixed values: what HTML allows a cell to span; 0 lines mean all the rest


def inner_text(col: Column, up_to: str | None = None) -> Column:
    """Text of a fragment: tags removed, entities decoded, outer blanks trimmed.

    ``up_to`` names the end tags (as ``td|tr``) behind which everything is left out.
    """
    tags = r"<[^>]*>" if up_to is None else rf"(?is)</(?:{up_to})\b.*$|<[^>]*>"
    out = F.regexp_replace(col, tags, "")
    return F.trim(F.when(out.contains("&"), _decoded(out)).otherwise(out))


def _decoded(col: Column) -> Column:
    """Named and numeric character references as characters, in one pass; others stay as they are."""
    named = {name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " "}
    table = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))

    def decoded(piece: Column) -> Column:
        name = F.substring_index(piece, ";", 1)
        code = F.when(name.rlike("^#[xX][0-9a-fA-F]{1,5}$"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(
            name.rlike("^#[0-9]{1,6}$"), F.substr(name, F.lit(2))
        ).cast("int")
        # beyond the first plane a character is a pair of code units
        high, low = 0xD800 + F.shiftright(code - 0x10000, 10), 0xDC00 + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        unit = lambda n: F.lpad(F.hex(n), 4, "0")
        units = F.when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))
        character = F.coalesce(F.try_element_at(table, name), F.decode(F.unhex(units), "UTF-16BE"))
        known = piece.contains(";") & character.isNotNull()
        return F.when(known, F.concat(character, F.substr(piece, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(col, "&")
    return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded), ""))


def repeated_items(
    pages: DataFrame, html: str, keep: Sequence[str], pattern: str, names: Sequence[str]
) -> DataFrame:
    """One row per match of ``pattern``, one column per group, with its position."""
    matches = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))))
    return matches.select(
        *keep,
        F.col("pos").alias("item"),
        *(
            inner_text(F.regexp_extract("col", pattern, i)).alias(name)
            for i, name in enumerate(names, start=1)
        ),
    )


def table_rows(
    pages: DataFrame,
    html: str,
    keep: Sequence[str],
    css_class: str | None = None,
    headers: Sequence[str] = (),
) -> DataFrame:
    """Rows of the tables with a class and/or with all given header texts.

    Output: ``keep``, table, line, cells ARRAY<STRING> (header lines left out). End tags
    of cells and lines may be missing.
    """
    # comments are no part of the page
    page = F.when(F.col(html).contains("<!--"), F.regexp_replace(html, r"(?s)<!--.*?(-->|$)", "")).otherwise(F.col(html))
    texts = _after(page, "table", keep_tag=True)
    tables = pages.select(*keep, F.posexplode(texts).alias("table", "_table"))
    if css_class:
        tables = tables.filter(
            F.col("_table").rlike(rf"(?i)^[^>]*\bclass\s*=\s*([\"'][^\"'>]*\b{css_class}\b|[^\s\"'>]*\b{css_class}\b)")
        )
    if headers:
        # a heading ends at its end tag or at whatever cell or line comes next
        heads = F.transform(
            _after(F.col("_table"), "th"), lambda head: inner_text(F.split(head, r"(?i)<t[rd]\b|</t", 2)[0])
        )
        wanted = F.array(*(F.lit(h) for h in headers))
        tables = tables.filter(F.size(F.array_except(wanted, heads)) == 0)
    # Lines and cells are cut in one nested expression below a single generator: filters
    # on cells stay above it, and every pattern runs once.
    pieces = _after(F.col("_table"), "tr")
    spanned = F.col("_table").rlike(r"(?i)\browspan\s*=")  # rare, and only there a line depends on those before it
    lines = F.when(spanned, _grid(pieces)).otherwise(F.transform(pieces, _line_cells))
    found = tables.select(*keep, "table", F.posexplode(lines).alias("line", "cells"))
    return found.filter(F.size("cells") > 0)


def named_cells(names: Sequence[str]) -> list[Column]:
    """The cells of a line under the given names; more cells than names fail the job."""
    checked = F.when(
        F.size("cells") > len(names), F.raise_error(F.lit(f"a line has more than {len(names)} cells")).cast("array<string>")
    ).otherwise(F.col("cells"))
    return [F.get(checked, F.lit(i)).alias(name) for i, name in enumerate(names)]


def _after(col: Column, tag: str, keep_tag: bool = False) -> Column:
    """Pieces of markup, each starting right behind one opening tag (or its name)."""
    rest = "" if keep_tag else "[^>]*>"
    pieces = F.split(col, rf"(?i)<{tag}\b{rest}")
    return F.slice(pieces, F.lit(2), F.size(pieces))


def _line_cells(line: Column) -> Column:
    """The cells of a line; one without any data cell is a line of headings and has none."""
    no_cells = F.array().cast("array<string>")
    cells = F.transform(_after(line, "t[dh]"), _cell_text)
    # rare, so the attributes are looked at only where one asks for it
    spanned = F.flatten(F.transform(_after(line, "t[dh]", keep_tag=True), _spanned_cell))
    return F.when(line.rlike(r"(?i)<td\b"), F.when(line.rlike(r"(?i)\bcolspan\s*="), spanned).otherwise(cells)).otherwise(no_cells)


def _span(piece: Column, attribute: str, most: int, zero: int = 1) -> Column:
    """How many columns or lines a cell asks for: at least 1, at most ``most``."""

    def asked(digits: Column) -> Column:
        # most cells ask for nothing; an empty text must not reach the cast, which raises and catches an error for each
        return (
            F.when(digits == "", 1).when(F.length(digits) > 6, most).when(F.ltrim(digits, F.lit("0")) == "", zero)
            .otherwise(F.least(digits.cast("int"), F.lit(most)))
        )

    digits = F.regexp_extract(piece, rf"(?i)^[^>]*\b{attribute}\s*=\s*[\"']?(\d+)", 1)
    return F.get(F.transform(F.array(digits), asked), F.lit(0))


def _spanned_cell(piece: Column) -> Column:
    """A cell as often as it spans columns."""
    return F.array_repeat(_cell_text(F.regexp_replace(piece, r"^[^>]*>", "")), _span(piece, "colspan", MOST_COLUMNS))


def _grid(lines: Column) -> Column:
    """The cells of all lines of a table in which cells span lines: a fold that carries what is still open in each column.

    A line takes its cells from left to right into the columns that no cell from above holds. Columns left
    free before one that is held are null. Lines of headings keep their columns held, but have no cells of their own.
    """
    held = "struct<text:string,lines:int>"

    def cells(line: Column) -> Column:
        return F.transform(
            _after(line, "t[dh]", keep_tag=True),
            lambda piece: F.struct(
                _cell_text(F.regexp_replace(piece, r"^[^>]*>", "")).alias("text"),
                _span(piece, "colspan", MOST_COLUMNS).alias("columns"),
                _span(piece, "rowspan", MOST_LINES, MOST_LINES).alias("lines"),
            ),
        )

    def one_less(open_: Column) -> Column:
        return F.transform(open_, lambda o: F.struct(o["text"].alias("text"), (o["lines"] - 1).alias("lines")))

    def placed(open_: Column, out: Column, cell: Column) -> Column:
        rest = F.slice(open_, F.size(out) + 1, F.greatest(F.size(open_) - F.size(out), F.lit(0)))
        free = F.array_position(F.transform(rest, lambda o: o["lines"] > 0), False).cast("int")
        run = F.when(free > 0, free - 1).otherwise(F.size(rest))
        own = F.struct(cell["text"].alias("text"), (cell["lines"] - 1).alias("lines"))
        return F.concat(out, one_less(F.slice(rest, F.lit(1), run)), F.array_repeat(own, cell["columns"]))

    def filled(open_: Column, line: Column) -> Column:
        out = F.aggregate(cells(line), F.array().cast(f"array<{held}>"), lambda out, cell: placed(open_, out, cell))

        def behind(out: Column) -> Column:
            rest = F.slice(open_, F.size(out) + 1, F.greatest(F.size(open_) - F.size(out), F.lit(0)))
            last = F.coalesce(F.array_max(F.transform(rest, lambda o, i: F.when(o["lines"] > 0, i + 1).otherwise(0))), F.lit(0))
            nothing = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("lines"))
            more = F.transform(
                F.slice(rest, F.lit(1), last),
                lambda o: F.when(o["lines"] > 0, F.struct(o["text"].alias("text"), (o["lines"] - 1).alias("lines"))).otherwise(nothing),
            )
            return F.concat(out, more)

        return F.get(F.transform(F.array(out), behind), F.lit(0))

    def step(state: Column, line: Column) -> Column:
        def next_state(row: Column) -> Column:
            data = F.when(line.rlike(r"(?i)<td\b"), F.transform(row, lambda c: c["text"])).otherwise(F.array().cast("array<string>"))
            return F.struct(row.alias("open"), F.concat(state["rows"], F.array(data)).alias("rows"))

        return F.get(F.transform(F.array(filled(state["open"], line)), next_state), F.lit(0))

    start = F.struct(F.array().cast(f"array<{held}>").alias("open"), F.array().cast("array<array<string>>").alias("rows"))
    return F.aggregate(lines, start, step, lambda state: state["rows"])


def _cell_text(col: Column) -> Column:
    """Text of a cell up to whichever end tag comes first.

    Most cells hold no markup of their own: there the text is what stands before the
    end tag, and no pattern is needed.
    """
    plain = F.substr(col, F.instr(col, "<"), F.lit(5)) == "</td>"
    bare = F.substring_index(col, "<", 1)
    return F.when(plain & ~bare.contains("&"), F.trim(bare)).otherwise(
        inner_text(col, up_to="td|th|tr|table")
    )


def _span_of(value: str | None, most: int, zero: int = 1) -> int:
    digits = re.match(r"\d+", value or "", re.ASCII)
    asked = int(digits[0]) if digits else 1
    return min(asked, most) if asked else zero


class _TableReader(HTMLParser):
    """Collects (table, line, cells); an opening tag closes whatever it must."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, int, list[str]]] = []
        self.table, self.line = -1, -1
        self.cells: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.held: list[tuple[str | None, int]] = []  # per column: the text from above and the lines it still covers
        self.line_open = self.code = False
        self.open = self.data = False  # within a cell; a data cell stands in the line

    def flush(self) -> None:
        if self.cells or self.line_open:
            row: list[tuple[str | None, int]] = []
            for text, (columns, lines) in zip(self.cells, self.spans):
                while len(row) < len(self.held) and self.held[len(row)][1]:
                    row.append((self.held[len(row)][0], self.held[len(row)][1] - 1))
                row += [(text.replace("\xa0", " ").strip(), lines - 1)] * columns
            rest = self.held[len(row) :]
            while rest and not rest[-1][1]:
                rest.pop()
            row += [(text, lines - 1) if lines else (None, 0) for text, lines in rest]
            self.held = row
            if self.data:
                self.found.append((self.table, self.line, [text for text, _ in row]))
        self.line_open = False
        self.cells, self.spans, self.open, self.data = [], [], False, False

    def handle_starttag(self, tag, attrs):
        self.code = tag in ("script", "style")
        if tag == "table":
            self.flush()
            self.table, self.line, self.held = self.table + 1, -1, []
        elif tag == "tr":
            self.flush()
            self.line += 1
            self.line_open = True
        elif tag in ("td", "th"):
            self.cells.append("")
            named = dict(attrs)
            lines = _span_of(named.get("rowspan"), MOST_LINES, MOST_LINES)
            self.spans.append((_span_of(named.get("colspan"), MOST_COLUMNS), lines))
            self.open = True
            self.data |= tag == "td"

    def handle_endtag(self, tag):
        self.code = False
        if tag in ("tr", "table"):
            self.flush()
        elif tag in ("td", "th"):
            self.open = False

    def handle_data(self, data):
        if self.open and self.cells and not self.code:
            self.cells[-1] += data


def parsed_tables(pages: DataFrame, html: str, key: str) -> DataFrame:
    """Rows of all tables, read by a real parser (``key``: page id)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, body in zip(batch[key], batch[html]):
                reader = _TableReader()
                reader.feed(body or "")
                reader.close()
                reader.flush()
                out.extend((page, *row) for row in reader.found)
            yield pd.DataFrame(out, columns=[key, "table", "line", "cells"])

    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(
        read, f"`{key}` {kind}, `table` int, line int, cells array<string>"
    )

"""Readers for landed files and tables."""

from serieslake.sources import delimited, layouts, markup, records, sheets, tables

__all__ = ["delimited", "layouts", "markup", "records", "sheets", "tables"]

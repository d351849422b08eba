"""Table operators: DataFrames in, DataFrames out."""

from serieslake.operators import filters, joins, load, project, quality, reshape, series

__all__ = ["filters", "joins", "load", "project", "quality", "reshape", "series"]

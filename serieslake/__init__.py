"""Economic and market time series as Spark jobs.

``functions``  column expressions: text, numbers, dates
``sources``    landed sheets, delimited text, markup, JSON payloads, tables
``operators``  projections, filters, joins, reshaping, ordered series, quality, loads
``streaming``  the recurring incremental load as a file stream
``plans``      complete jobs composed from the above
"""

"""The registered queries: each operator and job run over the given tables.

The given tables are not the published workbooks, so each module first shapes them into
landed sheets, payloads, pages or series, over whole tables, and then calls the library. The
SQL next to a query states the expected result straight from the tables.
"""

from standins import jobs, markup_payloads, scalars, series, sheets, stores, tabular

MODULES = (series, tabular, scalars, sheets, markup_payloads, stores, jobs)


def registered() -> dict:
    out = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = entry
    return out

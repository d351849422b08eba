"""Sinks: the load modes of a stored table.

A stored table is a Parquet table with a commit log (see ``versions``), optionally partitioned. Modes:

append           add the rows
append_new       add only rows dated after the newest stored row
append_pages     add the rows of landed pages that the table's ledger does not hold yet
overwrite        replace the table (the source restates its history)
truncate_append  like overwrite, but the batch must pass its rules first
replace_slice    replace all rows from a given year on
replace_day      replace the rows of one day

Every mode evaluates its batch once: the rows are written into a folder of their own, rows and broken rules are counted on the
way, and one published version makes the load visible, all its partitions together. A failed job, a lost executor
or a lost driver leaves the table as it was. Read tables with ``read``. Empty batches are refused unless asked
for. Each load, refused ones included, leaves a line in the table's load log.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from serieslake.operators import filters, quality, versions
from serieslake.operators.versions import Version, exists, read, vacuum  # noqa: F401

MARKS, LEDGER, LOADS = "_marks", "_ledger", "_loads"
MERGE = 8  # folders of marks or of a ledger that a version names; beyond, they are merged into one
COMMIT = "_commit"
STORED, MISSING = "stored", "missing"
LOAD_LOG = "job string, mode string, at timestamp, rows bigint, version bigint, broken map<string, bigint>, refused boolean"


@dataclass(frozen=True)
class LoadResult:
    """What a load did; ``rows`` is counted while writing, not by a second pass."""

    path: str
    mode: str
    rows: int
    version: int = 0


def _write(df: DataFrame, folder: str, partition_by: Sequence[str], counts: Mapping[str, Column] | None = None) -> dict[str, int]:
    """Write once; the row count and further counts are observed on the way."""
    if partition_by:
        # Few files per partition folder; the runtime splits whichever one is large.
        df = df.hint("rebalance", *partition_by)
    seen = Observation()
    watched = {"rows": F.count(F.lit(1))} | {n: F.count_if(c) for n, c in (counts or {}).items()}
    writer = df.observe(seen, *(c.alias(n) for n, c in watched.items())).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(folder)
    return seen.get


def store(
    df: DataFrame,
    path: str,
    mode: str,
    change: Callable[[Version | None, tuple[str, ...], int], Version],
    partition_by: Sequence[str] = (),
    rules: Mapping[str, Column] | None = None,
    minimum_rows: int = 0,
    base: Version | None = None,
    job: str | None = None,
    retry: bool = False,
) -> LoadResult:
    """Write the rows, then publish what ``change`` makes of (base version, new folders, rows).

    With ``retry`` a load that another one overtook is published on top of that.
    """
    spark, rules = df.sparkSession, dict(rules or {})
    folder = versions.new_load(path)
    try:
        seen = _write(df, folder, partition_by, {f"rule_{n}": c for n, c in enumerate(rules.values())})
        broken = {name: seen[f"rule_{n}"] for n, name in enumerate(rules)} | {"too_few_rows": int(seen["rows"] < minimum_rows)}
        try:
            quality.refuse(broken)
        except quality.BatchRejected:
            _note(spark, path, job, mode, seen["rows"], base.number if base else 0, broken, True)
            raise
        entries = versions.entries_of(spark, folder, partition_by)
        while True:
            try:
                version = versions.publish(spark, path, change(base, entries, seen["rows"]))
                break
            except versions.Conflict:
                if not retry:
                    raise
                base = versions.newest(spark, path)
    except BaseException:
        now = versions.newest(spark, path)  # an interruption may come when the load is published already
        if now is None or not any(f"{path}/{e}".startswith(folder) for e in now.entries):
            versions.remove(spark, folder)
        raise
    _note(spark, path, job, mode, seen["rows"], version.number, broken, False)
    return LoadResult(path, mode, seen["rows"], version.number)


def _note(spark: SparkSession, path: str, job: str | None, mode: str, rows: int, version: int, broken: Mapping[str, int], refused: bool) -> None:
    """A line in the table's load log; ``broken`` names the rules that were broken."""
    at = spark.sql("SELECT cast(current_timestamp() AS string)").first()[0]
    line = {"job": job, "mode": mode, "at": at, "rows": rows, "version": version, "refused": refused, "broken": {k: v for k, v in broken.items() if v}}
    versions.write_text(spark, f"{path}/{LOADS}/{uuid.uuid4().hex}.json", json.dumps(line))


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per load of the table: job, mode, when, rows, version, broken rules, whether it was refused.

    ``version`` is the version a load made, or that it met when it was refused.
    """
    if not exists(spark, f"{path}/{LOADS}"):
        return spark.createDataFrame([], LOAD_LOG)
    return spark.read.schema(LOAD_LOG).json(f"{path}/{LOADS}")


def _plain(mode: str, df: DataFrame, kept: Callable[[Version], Iterable[str]]) -> Callable[[Version | None, tuple[str, ...], int], Version]:
    """A change that keeps some folders of the base; rows that came in another way make its marks void."""

    def change(base: Version | None, entries: tuple[str, ...], rows: int) -> Version:
        before = tuple(kept(base)) if base else ()
        # a ledger counts on whatever comes; filters belong to folders, which never change
        kept_on = [side for side in (LEDGER, "_filters") if base and side in base.sides]
        sides, keys = {s: base.sides[s] for s in kept_on}, {s: base.keys[s] for s in kept_on}
        known = base.struct.fields if before else []
        fields = [*known, *(f for f in df.schema if f.name not in {k.name for k in known})]
        return Version(versions.following(base), mode, rows, StructType(fields).json(), before + entries, sides, keys)

    return change


def append(df: DataFrame, path: str, partition_by: Sequence[str] = (), job: str | None = None) -> LoadResult:
    base = versions.newest(df.sparkSession, path)
    return store(df, path, "append", _plain("append", df, lambda b: b.entries), partition_by, base=base, job=job, retry=True)


def _side(spark: SparkSession, path: str, folders: Sequence[str], schema: StructType) -> DataFrame:
    """A side table of a version, from its folders."""
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def keep_side(df: DataFrame, path: str, side: str) -> str:
    """Write a folder of a side table; its place as a version names it."""
    place = f"{side}/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{place}")
    return place


def _newest_dates(rows: DataFrame, by: Sequence[str], date: str, number: int) -> DataFrame:
    """(series, newest date, commit): one row per series, dealt out by the hash of the series."""
    return rows.groupBy(*by).agg(F.max(date).alias(date)).select(*by, date, F.lit(number).cast("long").alias(COMMIT))


def _marks_schema(schema: StructType, keys: Sequence[str]) -> StructType:
    return StructType([*(schema[k] for k in keys), StructField(COMMIT, LongType())])


def marks(spark: SparkSession, path: str, version: Version, by: Sequence[str], date: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The newest date of each series, a row per commit that moved it, and the folders that hold it.

    Without marks for these keys the table is read once, and the marks of that are written.
    """
    keys, folders = (*by, date), version.sides.get(MARKS, ())
    if not folders or version.keys.get(MARKS) != keys:
        stored = read(spark, path).select(*keys)
        folders = (keep_side(_newest_dates(stored, by, date, version.number), path, MARKS),)
    return _side(spark, path, folders, _marks_schema(version.struct, keys)), folders


def append_new(
    df: DataFrame,
    path: str,
    date: str = "date",
    by: Sequence[str] = (),
    floor: str | None = None,
    partition_by: Sequence[str] = (),
    job: str | None = None,
) -> LoadResult:
    """Rerunning the same batch adds nothing.

    The newest date of each series is kept in marks beside the data, so a round reads the batch and the marks, not the
    history. Each round adds a folder of marks made from the rows it has just written (the batch is not evaluated again);
    ``MERGE`` folders are merged into one. Marks belong to the version; a load in another mode makes them
    void, and the next round reads the table once.
    """
    spark = df.sparkSession
    base, keys, folders = versions.newest(spark, path), (*by, date), ()
    if base is None:
        fresh = filters.after_floor(df, date, floor)
    else:
        newest, folders = marks(spark, path, base, by, date)
        fresh = filters.newer_than(df, newest.select(*keys), date, by, floor)

    def change(base: Version | None, entries: tuple[str, ...], rows: int) -> Version:
        number = versions.following(base)
        held = folders
        if rows:
            added = versions.read_entries(spark, path, entries, df.schema).select(*keys)
            held = (*held, keep_side(_newest_dates(added, by, date, number), path, MARKS))
        if len(held) > MERGE:
            every = _side(spark, path, held, _marks_schema(df.schema, keys))
            held = (keep_side(every.groupBy(*by).agg(F.max(date).alias(date), F.max(COMMIT).alias(COMMIT)).select(*keys, COMMIT), path, MARKS),)
        plain = _plain("append_new", df, lambda b: b.entries)(base, entries, rows)
        return replace(plain, sides={**plain.sides, MARKS: held}, keys={**plain.keys, MARKS: keys})

    return store(fresh, path, "append_new", change, partition_by, base=base, job=job)


def _same_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[f"_key_{k}"]) for k in key])


def append_pages(
    pages: DataFrame,
    path: str,
    shape: Callable[[DataFrame], DataFrame],
    key: Sequence[str],
    status: Column,
    announced: Callable[[DataFrame], DataFrame] | None = None,
    partition_by: Sequence[str] = (),
    job: str | None = None,
) -> LoadResult:
    """Store the rows of landed pages, each page once; what could not be read is listed and taken when it lands whole.

    ``key`` identifies a page (run date, endpoint, page number). ``status`` is "stored" for a page whose body can be
    read, else the reason. ``announced`` gives the keys of the pages there should be; those not landed are listed as missing.
    ``shape`` makes rows of pages. The table's ledger holds (key, status, commit) and is published with
    the rows, so a page is taken whole or not at all, whatever its rows are dated. Of several copies of a page in one landing a
    readable one is taken. The landing is read once: pages that are not stored yet are written aside first.
    """
    spark, key = pages.sparkSession, list(key)
    base = versions.newest(spark, path)
    number, folders = versions.following(base), base.sides.get(LEDGER, ()) if base else ()
    schema = StructType([*(pages.schema[k] for k in key), *StructType.fromDDL(f"status string, {COMMIT} bigint")])
    if folders and base.keys[LEDGER] != tuple(key):
        raise ValueError(f"the ledger of {path} is kept by {', '.join(base.keys[LEDGER])}")
    marked = pages.select(*key, status.alias("_status"), F.struct("*").alias("_page"))
    kept = _side(spark, path, folders, schema) if folders else spark.createDataFrame([], schema)
    kept = kept.where(F.col("status") == STORED).select(*[F.col(k).alias(f"_key_{k}") for k in key]).distinct()
    open_pages = marked.join(kept, _same_key(marked, kept, key), "left_anti")
    first = F.min_by(F.struct("_status", "_page"), F.struct(F.col("_status") != STORED, F.xxhash64("_page")))
    aside = f"{path}/_pages-{uuid.uuid4().hex}"
    try:
        open_pages.groupBy(*key).agg(first.alias("_p")).select(*key, "_p.*").write.parquet(aside)
        found = spark.read.parquet(aside)
        if found.isEmpty() and base is not None:
            _note(spark, path, job, "append_pages", 0, base.number, {}, False)
            return LoadResult(path, "append_pages", 0, base.number)
        rows = shape(found.where(F.col("_status") == STORED).select("_page.*"))
        listed = found.select(*key, F.col("_status").alias("status"))
        if announced is not None:
            wanted = announced(found.select("_page.*")).select(*key).distinct()
            for known in (listed.select(*[F.col(k).alias(f"_key_{k}") for k in key]), kept):
                wanted = wanted.join(known, _same_key(wanted, known, key), "left_anti")
            listed = listed.unionByName(wanted.withColumn("status", F.lit(MISSING)))

        def change(base: Version | None, entries: tuple[str, ...], n: int) -> Version:
            held = (*folders, keep_side(listed.withColumn(COMMIT, F.lit(number).cast("long")), path, LEDGER))
            if len(held) > MERGE:
                held = (keep_side(_newest_status(_side(spark, path, held, schema), key), path, LEDGER),)
            plain = _plain("append_pages", rows, lambda b: b.entries)(base, entries, n)
            return replace(plain, sides={**plain.sides, LEDGER: held}, keys={**plain.keys, LEDGER: tuple(key)})

        return store(rows, path, "append_pages", change, partition_by, base=base, job=job)
    finally:
        versions.remove(spark, aside)


def _newest_status(entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per page; once stored, a page stays so."""
    last = F.max_by(F.struct("status", COMMIT), F.struct(F.col("status") == STORED, COMMIT))
    return entries.groupBy(*key).agg(last.alias("l")).select(*key, "l.*")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(key, status, commit) of every page that landed or was announced, as of the newest version."""
    version = versions.newest(spark, path)
    if version is None or LEDGER not in version.sides:
        raise FileNotFoundError(f"no ledger at {path}")
    entries = spark.read.parquet(*[f"{path}/{f}" for f in version.sides[LEDGER]])
    return _newest_status(entries, version.keys[LEDGER])


def to_repair(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the ledger whose rows are not in the table, with the reason."""
    return ledger(spark, path).where(F.col("status") != STORED).drop(COMMIT)


def overwrite(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    rules: Mapping[str, Column] | None = None,
    minimum_rows: int = 1,
    mode: str = "overwrite",
    job: str | None = None,
) -> LoadResult:
    """Rules are counted while the rows are written, so the plan runs once and nothing is read again.

    An empty batch is refused, as it would wipe the table; ``minimum_rows=0`` asks for just that.
    """
    base = versions.newest(df.sparkSession, path)
    return store(df, path, mode, _plain(mode, df, lambda b: ()), partition_by, rules, minimum_rows, base, job)


def truncate_append(
    df: DataFrame, path: str, rules: Mapping[str, Column], minimum_rows: int = 1, job: str | None = None
) -> LoadResult:
    return overwrite(df, path, (), rules, minimum_rows, "truncate_append", job)


def replace_slice(
    df: DataFrame, path: str, from_year: int, date: str = "date", year: str = "year", minimum_rows: int = 1, job: str | None = None
) -> LoadResult:
    """Replace every stored row dated in ``from_year`` or later by the rows of ``df``.

    The table is partitioned by year, so earlier years stay where they are, and all later ones change in one
    commit. Rows dated before the slice are refused: they would be added twice on a rerun. So is a batch
    of fewer than ``minimum_rows`` rows: an empty one would remove the stored years.
    """
    checked = F.when(F.year(date) >= from_year, F.year(date)).otherwise(
        F.raise_error(F.lit(f"row dated before {from_year} or without date")).cast("int")
    )
    yearly = df.withColumn(year, checked)

    def earlier(base: Version) -> list[str]:
        return [e for e in base.entries if int(versions.partition_value(e, year)) < from_year]

    base = versions.newest(df.sparkSession, path)
    return store(yearly, path, "replace_slice", _plain("replace_slice", yearly, earlier), [year], None, minimum_rows, base, job)


def replace_day(df: DataFrame, path: str, day: str, date: str = "date", job: str | None = None) -> LoadResult:
    """Replace the stored rows of one day by the rows of ``df``, which must all be dated that day.

    The table is partitioned by date: only that day's folder is rewritten, and a rerun changes nothing.
    An empty batch is refused.
    """
    wanted = F.lit(day).cast("date")
    checked = F.when(F.col(date) == wanted, F.col(date)).otherwise(
        F.raise_error(F.lit(f"row not dated {day}")).cast("date")
    )
    dated = df.withColumn(date, checked)

    def others(base: Version) -> list[str]:
        return [e for e in base.entries if versions.partition_value(e, date) != day]

    base = versions.newest(df.sparkSession, path)
    return store(dated, path, "replace_day", _plain("replace_day", dated, others), [date], None, 1, base, job)


def insert_many(df: DataFrame, path: str, replace: bool = False) -> LoadResult:
    """Bulk insert, emptying the table first when ``replace`` is set."""
    return overwrite(df, path) if replace else append(df, path)


MODES = {
    "append": append,
    "append_new": append_new,
    "append_pages": append_pages,
    "overwrite": overwrite,
    "truncate_append": truncate_append,
    "replace_slice": replace_slice,
    "replace_day": replace_day,
}


def load(df: DataFrame, path: str, mode: str, **options) -> LoadResult:
    """One entry point for every mode."""
    if mode not in MODES:
        raise ValueError(f"unknown load mode {mode!r}; one of {', '.join(MODES)}")
    return MODES[mode](df, path, **options)


def table_schema(df: DataFrame, date: str = "date", epoch: bool = False) -> StructType:
    """Schema of a series table made from a frame: a date key, doubles otherwise.

    ``epoch`` stores the date as epoch seconds, as older tables do.
    """
    return StructType(
        [
            StructField(c, (LongType() if epoch else DateType()) if c == date else DoubleType())
            for c in df.columns
        ]
    )


def create_if_absent(spark: SparkSession, path: str, schema: StructType) -> bool:
    """Create an empty table; True when it was not there."""
    if versions.newest(spark, path) is not None:
        return False
    try:
        versions.publish(spark, path, Version(1, "create", 0, schema.json(), ()))
    except versions.Conflict:  # another one was faster
        return False
    return True


def export_snapshot(
    df: DataFrame, folder: str, snapshot_date: str, name: str = "snapshot_date"
) -> str | None:
    """Dated CSV export with a header; nothing (and ``None``) for an empty table."""
    if df.isEmpty():
        return None
    path = f"{folder}/{name}={snapshot_date}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path

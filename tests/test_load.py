"""Load modes: edge cases, reruns, failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from serieslake.operators import filters, keys, load, quality, versions
from serieslake.plans import jobs
from serieslake.session import scratch_path
from serieslake.sources import layouts, records, sheets
from serieslake.streaming import stream_append_new


def day(n, year=2024):
    return dt.date(year, 1, n)


def batch(spark, rows):
    return spark.createDataFrame(rows, "s string, date date, x double")


def stored(spark, path, schema="s string, date date, x double"):
    names = [c.split()[0] for c in schema.split(", ")]
    return sorted(map(tuple, load.read(spark, path).select(*names).collect()), key=str)


@pytest.fixture
def path(spark):
    return scratch_path(spark, "test")


def test_append_new_is_strict_and_rerunnable(spark, path):
    first = [("a", day(1), 1.0), ("a", day(2), 2.0)]
    assert load.load(batch(spark, first), path, "append_new").rows == 2
    again = batch(spark, first + [("a", day(2), 9.0), ("a", day(1), 8.0), ("a", day(3), 3.0)])
    assert load.load(again, path, "append_new").rows == 1
    assert load.load(again, path, "append_new").rows == 0
    assert stored(spark, path) == first + [("a", day(3), 3.0)]


def test_second_round_reads_marks_and_no_history(spark, path):
    rows = [("a", day(1), 1.0), ("b", day(2), 2.0)]
    load.append_new(batch(spark, rows), path, by=["s"])

    def held():
        found, _ = load.marks(spark, path, versions.newest(spark, path), ["s"], "date")
        assert all("/_marks/" in name for name in found.inputFiles())
        return sorted(map(tuple, found.collect()))

    assert held() == [("a", day(1), 1), ("b", day(2), 1)]
    # rows added in another way make the marks void
    load.append(batch(spark, [("a", day(7), 7.0)]), path)
    assert load.MARKS not in versions.newest(spark, path).sides
    again = [("a", day(7), 9.0), ("a", day(8), 8.0), ("b", day(2), 0.0), ("c", day(1), 3.0)]
    assert load.append_new(batch(spark, again), path, by=["s"]).rows == 2
    assert load.append_new(batch(spark, again), path, by=["s"]).rows == 0
    assert held() == [("a", day(7), 2), ("a", day(8), 3), ("b", day(2), 2), ("c", day(1), 3)]
    assert len(stored(spark, path)) == 5


def test_marks_are_merged_and_series_keep_their_newest_date(spark, path):
    for n in range(1, 2 * load.MERGE + 3):
        assert load.append_new(batch(spark, [(f"s{n % 3}", day(n), 1.0), ("s0", day(1), 0.0)]), path, by=["s"]).rows == 1 + (n == 1)
        assert len(versions.newest(spark, path).sides[load.MARKS]) <= load.MERGE
    assert load.append_new(batch(spark, [(f"s{k}", day(k + 1), 1.0) for k in range(3)]), path, by=["s"]).rows == 0


def test_a_round_evaluates_its_batch_once(spark, path):
    load.append_new(batch(spark, [("a", day(1), 1.0)]), path, by=["s"])
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = batch(spark, [("a", day(2), 1.0), ("a", day(1), 1.0), ("b", day(1), 2.0)])
    assert load.append_new(rows.mapInPandas(counted, rows.schema), path, by=["s"]).rows == 2
    assert seen.value == 3
    yearly = f"{path}-yearly"
    assert load.replace_slice(rows.mapInPandas(counted, rows.schema), yearly, 2024).rows == 3
    assert seen.value == 6


def test_a_million_series(spark, path):
    rows = spark.range(1_000_000).select(F.col("id").alias("s"), F.lit("2024-01-01").cast("date").alias("date"), F.lit(1.0).alias("x"))
    load.append_new(rows, path, by=["s"])
    more = rows.withColumn("date", F.when(F.col("s") % 2 == 0, F.lit("2024-01-02").cast("date")).otherwise(F.col("date")))
    assert load.append_new(more, path, by=["s"]).rows == 500_000
    found, _ = load.marks(spark, path, versions.newest(spark, path), ["s"], "date")
    assert found.count() == 1_500_000


def test_append_new_per_series_with_empty_target_and_floor(spark, path):
    load.create_if_absent(spark, path, batch(spark, []).schema)
    rows = [("a", day(1), 1.0), ("a", day(5), 2.0), ("b", day(3), 3.0), (None, day(9), 4.0)]
    assert load.append_new(batch(spark, rows), path, by=["s"], floor="2024-01-02").rows == 3
    assert load.append_new(batch(spark, rows), path, by=["s"], floor="2024-01-02").rows == 0


def test_empty_target_without_floor(spark):
    empty = batch(spark, [])
    df = batch(spark, [("a", day(1), 1.0)])
    assert filters.newer_than(df, empty, "date").count() == 1
    assert filters.newer_than(df, empty, "date", ["s"]).count() == 1


def test_rejected_batch_leaves_the_table(spark, path):
    good = [("a", day(1), 1.0)]
    rules = {"no date": F.col("date").isNull()}
    load.load(batch(spark, good), path, "truncate_append", rules=rules)
    for bad in ([("a", None, 1.0), ("b", day(2), 2.0)], []):
        with pytest.raises(quality.BatchRejected):
            load.load(batch(spark, bad), path, "truncate_append", rules=rules)
    assert stored(spark, path) == good


def test_failing_write_leaves_the_table(spark, path):
    good = [("a", day(1), 1.0)]
    load.overwrite(batch(spark, good), path)
    broken = batch(spark, good).withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        load.overwrite(broken, path)
    assert stored(spark, path) == good


def test_overwrite_may_read_its_own_table(spark, path):
    load.overwrite(batch(spark, [("a", day(1), 1.0)]), path)
    own = load.read(spark, path)
    load.overwrite(own.unionByName(batch(spark, [("b", day(2), 2.0)])), path)
    assert stored(spark, path) == [("a", day(1), 1.0), ("b", day(2), 2.0)]


def test_replace_slice_is_idempotent_and_drops_stale_years(spark, path):
    schema = "s string, date date, x double, year int"
    old = [("a", day(1, y), float(y)) for y in (2021, 2022, 2023, 2024)]
    load.replace_slice(batch(spark, old), path, 2021)
    new = batch(spark, [("a", day(2, 2023), 1.0)])
    for _ in range(2):
        assert load.replace_slice(new, path, 2022).rows == 1
        assert stored(spark, path, schema) == [
            ("a", day(1, 2021), 2021.0, 2021), ("a", day(2, 2023), 1.0, 2023),
        ]
    with pytest.raises(quality.BatchRejected):  # an empty batch would wipe the years
        load.replace_slice(batch(spark, []), path, 2022)
    assert len(stored(spark, path, schema)) == 2
    assert load.replace_slice(batch(spark, []), path, 2022, minimum_rows=0).rows == 0
    assert stored(spark, path, schema) == [("a", day(1, 2021), 2021.0, 2021)]


def test_empty_batches_do_not_wipe_a_table(spark, path):
    load.overwrite(batch(spark, [("a", day(1), 1.0)]), path)
    with pytest.raises(quality.BatchRejected):
        load.overwrite(batch(spark, []), path)
    assert len(stored(spark, path)) == 1
    assert load.overwrite(batch(spark, []), path, minimum_rows=0).rows == 0
    assert stored(spark, path) == []


STEPS = ["_write", "keep_side", "_note", "entries_of", "publish", "write_text", "remove"]


def _loads(spark):
    """mode -> (options, base rows, batch, rows after)"""
    a, b, c = ("a", day(1, 2023), 1.0), ("b", day(2), 2.0), ("c", day(3), 3.0)
    return {
        "append_new": ({}, [a, b], [b, c], [a, b, c]),
        "overwrite": ({}, [a, b], [c], [c]),
        "replace_slice": ({"from_year": 2024}, [a, b], [c], [a, c]),
        "replace_day": ({"day": "2024-01-02"}, [a, b], [("d", day(2), 4.0)], [a, ("d", day(2), 4.0)]),
    }


@pytest.mark.parametrize("mode", ["append_new", "overwrite", "replace_slice", "replace_day"])
def test_a_driver_lost_at_any_step_leaves_the_old_or_the_new_table(spark, path, monkeypatch, mode):
    """Every call of a step that touches files is once the last one of the driver, before and after it ran."""
    options, old, rows, new = _loads(spark)[mode]
    partition = {"replace_slice": ["year"], "replace_day": ["date"]}.get(mode, [])
    calls, stop, lost_before = [0], [None], [True]

    def dying(module, name):
        run = getattr(module, name)

        def step(*args, **given):
            calls[0] += 1
            if calls[0] == stop[0] and lost_before[0]:
                raise KeyboardInterrupt
            out = run(*args, **given)
            if calls[0] == stop[0]:
                raise KeyboardInterrupt
            return out

        monkeypatch.setattr(module, name, step)

    for name in STEPS:
        for module in (load, versions):
            if name in vars(module):
                dying(module, name)
    seen = set()
    for number in range(1, 40):
        for lost_before[0] in (True, False):
            target, stop[0] = f"{path}-{number}-{lost_before[0]}", None
            base = batch(spark, old)
            load.append(base.withColumn("year", F.year("date")) if partition == ["year"] else base, target, partition)
            calls[0], stop[0] = 0, number
            try:
                load.load(batch(spark, rows), target, mode, **options)
                done = calls[0] < number
            except KeyboardInterrupt:
                done = False
            stop[0] = None
            left = stored(spark, target)
            assert left in (sorted(old, key=str), sorted(new, key=str)), (mode, number)
            seen.add(left == sorted(new, key=str))
            load.load(batch(spark, rows), target, mode, **options)  # whatever was left behind is in nobody's way
            assert stored(spark, target) == sorted(new, key=str)
        if done:
            break
    assert seen == {True, False} and number > 3


def test_only_one_of_two_loads_of_one_version_is_published(spark, path):
    load.append(batch(spark, [("a", day(1), 1.0)]), path)
    base = versions.newest(spark, path)
    load.overwrite(batch(spark, [("b", day(2), 2.0)]), path)
    with pytest.raises(versions.Conflict):
        load.store(batch(spark, [("c", day(3), 3.0)]), path, "overwrite", load._plain("overwrite", batch(spark, []), lambda b: ()), base=base)
    assert stored(spark, path) == [("b", day(2), 2.0)]
    # rows that are only added go on top of what came in between
    load.store(batch(spark, [("c", day(3), 3.0)]), path, "append", load._plain("append", batch(spark, []), lambda b: b.entries), base=base, retry=True)
    assert len(stored(spark, path)) == 2


def test_old_versions_stay_readable_until_they_are_vacuumed(spark, path):
    for n in range(1, 4):
        load.overwrite(batch(spark, [("a", day(n), float(n))]), path)
    assert [r.x for r in load.read(spark, path, 1).collect()] == [1.0]
    assert len(load.vacuum(spark, path, keep=2)) == 1
    assert [r.x for r in load.read(spark, path, 2).collect()] == [2.0] and stored(spark, path) == [("a", day(3), 3.0)]
    assert [v.number for v in versions.history(spark, path)] == [2, 3]


def test_a_plain_folder_is_taken_over(spark, path):
    batch(spark, [("a", day(1), 1.0)]).write.parquet(path)
    assert stored(spark, path) == [("a", day(1), 1.0)]
    assert load.append_new(batch(spark, [("a", day(1), 9.0), ("a", day(2), 2.0)]), path).rows == 1
    assert stored(spark, path) == [("a", day(1), 1.0), ("a", day(2), 2.0)]
    load.overwrite(batch(spark, [("b", day(1), 1.0)]), path)
    assert stored(spark, path) == [("b", day(1), 1.0)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "endpoint string, page int, body string")


def test_pages_are_stored_once_and_repaired(spark, path):
    def shape(found):
        return found.select("endpoint", "page", F.explode(F.from_json("body", "data array<int>").data).alias("x"))

    def run(rows):
        landed = pages(spark, rows)
        return load.append_pages(
            landed, path, shape, ["endpoint", "page"], records.status(F.col("body")),
            lambda p: p.select("endpoint").distinct().select("endpoint", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("page")),
        ).rows

    whole = [("a", 1, '{"data":[1,2]}'), ("a", 2, '{"data":[3]}'), ("a", 3, '{"data":[]}'), (None, 1, '{"data":[7]}')]
    assert run([whole[0], ("a", 2, '{"data":[3'), whole[0]]) == 2  # a page that landed twice counts once
    assert sorted(map(tuple, load.to_repair(spark, path).collect())) == [("a", 2, "no records"), ("a", 3, "missing")]
    assert run([whole[0], ("a", 2, None)]) == 0
    assert run([whole[0], ("a", 2, "{"), whole[1]]) == 1
    assert run(whole) == 1
    assert run(whole) == 0
    assert sorted(r.x for r in load.read(spark, path).collect()) == [1, 2, 3, 7]
    assert sorted(map(tuple, load.to_repair(spark, path).collect()), key=str) == [(None, 2, "missing"), (None, 3, "missing")]


def test_keys_of_a_batch_against_the_stored_ones(spark, path):
    rows = [(f"s{n}", day(n % 28 + 1, 2020 + n % 4), float(n)) for n in range(400)] + [(None, day(1, 2021), 0.0)]
    stored_rows = batch(spark, rows).withColumn("year", F.year("date"))
    load.append(stored_rows, path, ["year"])
    new = [("s1", day(2, 2021), 1.0), ("s1", day(3, 2021), 1.0), (None, day(1, 2021), 1.0), ("s9999", day(1, 2021), 1.0), ("s2", day(9, 2025), 1.0)]
    new = batch(spark, new).withColumn("year", F.year("date"))
    found = keys.stored_keys(new, path, ["s", "date"], "year")
    assert sorted(map(tuple, found.collect()), key=str) == [("s1", day(2, 2021)), (None, day(1, 2021))]
    scanned = [f for f in found.inputFiles() if "/_load=" in f]
    assert scanned and all("/year=2021/" in f for f in scanned)
    # without a partition column every folder's filters are asked, and the answer is the same
    assert keys.stored_keys(new, path, ["s", "date"]).count() == 2
    held = versions.newest(spark, path).sides[keys.FILTERS]
    with pytest.raises(quality.BatchRejected, match="stored key"):
        keys.append_unique(new, path, ["s", "date"], ["year"])
    good = new.filter("s = 's9999' OR year = 2025")
    assert keys.append_unique(good, path, ["s", "date"], ["year"]).rows == 2
    assert keys.stored_keys(good, path, ["s", "date"], "year").count() == 2
    assert versions.newest(spark, path).sides[keys.FILTERS][:1] == held  # folders that were known keep their filters
    assert keys.stored_keys(good, f"{path}-none", ["s", "date"]).count() == 0


def test_stream_and_refused_batches_are_logged(spark, path):
    landing = scratch_path(spark, "in")
    batch(spark, [("a", day(1), 1.0)]).write.parquet(landing)
    stream_append_new(spark, landing, batch(spark, []).schema, path, scratch_path(spark, "progress"), job="hourly")
    with pytest.raises(quality.BatchRejected):
        load.overwrite(batch(spark, []), path, job="restated")
    log = {tuple(r) for r in load.load_log(spark, path).select("job", "mode", "rows", "version", "refused").collect()}
    assert log == {("hourly", "append_new", 1, 1, False), ("restated", "overwrite", 0, 1, True)}
    assert [r.broken for r in load.load_log(spark, path).where("refused").collect()] == [{"too_few_rows": 1}]


def test_replace_day(spark, path):
    load.append(batch(spark, [("a", day(1), 1.0), ("a", day(2), 2.0)]), path, ["date"])
    schema = "s string, x double, date date"
    for _ in range(2):
        assert load.replace_day(batch(spark, [("b", day(2), 5.0)]), path, "2024-01-02").rows == 1
    assert stored(spark, path, schema) == [("a", 1.0, day(1)), ("b", 5.0, day(2))]
    with pytest.raises(quality.BatchRejected):
        load.replace_day(batch(spark, []), path, "2024-01-02")
    with pytest.raises(Exception, match="row not dated"):
        load.replace_day(batch(spark, [("b", day(3), 5.0)]), path, "2024-01-02")


@pytest.mark.parametrize("date", [day(1, 2020), None])
def test_replace_slice_refuses_rows_outside(spark, path, date):
    load.replace_slice(batch(spark, [("a", day(1), 1.0)]), path, 2024)
    with pytest.raises(Exception, match="row dated before 2024"):
        load.replace_slice(batch(spark, [("a", date, 2.0)]), path, 2024)
    assert len(stored(spark, path)) == 1


def test_unknown_mode(spark, path):
    with pytest.raises(ValueError, match="unknown load mode"):
        load.load(batch(spark, []), path, "merge")


def test_snapshot_of_nothing(spark, path):
    assert load.export_snapshot(batch(spark, []), path, "2024-05-31") is None
    assert not load.exists(spark, path)


def test_constraint_report(spark):
    df = batch(spark, [("a", day(1), 1.0), ("a", day(1), None), ("b", None, 2.0)])
    report = quality.constraint_report({"t": (df, ["s", "date"], ["date", "x"])})
    assert {r.constraint_name: r.violations for r in report.collect()} == {
        "primary key (s, date)": 1, "not null (date)": 1, "not null (x)": 1,
    }


def test_stream_equals_batch(spark):
    landing, target, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    one = batch(spark, [("a", day(1), 1.0), ("a", day(2), 2.0)])
    two = batch(spark, [("a", day(2), 7.0), ("a", day(3), 3.0), ("b", day(1), 4.0)])
    run = lambda: stream_append_new(spark, landing, one.schema, target, progress, by=["s"])
    one.write.parquet(landing)
    assert run() == 2
    assert run() == 0
    two.write.mode("append").parquet(landing)
    assert run() == 2
    direct = scratch_path(spark, "direct")
    load.append_new(one, direct, by=["s"])
    load.append_new(two, direct, by=["s"])
    assert stored(spark, target) == stored(spark, direct)


def test_dashboard_tables_are_checked_before_any_is_replaced(spark, path):
    width = sheets.column_index("BE") + 1
    days = {dict(b.columns())["date"] for b in layouts.DASHBOARD_BLOCKS}

    def landing(dates):
        lines = [("panel", "DATOS | DATA", 40 + n, [d if c in days else str(n) for c in range(width)]) for n, d in enumerate(dates)]
        return spark.createDataFrame(lines, "workbook string, sheet string, row bigint, cells array<string>")

    done = jobs.run("dashboard", landing(["2024-01-02", "2024-01-03"]), path)
    assert len(done) == 12 and {r.rows for r in done.values()} == {2}
    with pytest.raises(quality.BatchRejected, match="primary key"):
        jobs.run("dashboard", landing(["2024-01-02", "2024-01-02"]), path)
    assert load.read(spark, f"{path}/infomond_tipo_cambio").count() == 2

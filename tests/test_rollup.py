"""The rollup job: what it does, what a run that stops half-way leaves, and queries across the two tiers."""

import pytest
from pyspark.sql import functions as F

from tracefold.operators import metrics, rollup
from tracefold.sources import fixtures, rollup_job, sinks

SF = "/root/testdata/sf0.001"
START = 1_704_153_600_000_000


def _points(spark):
    columns = ["app_id", "ts_us", "name", "type", "value", "labels", "temporality", "count", "bucket_counts", "explicit_bounds"]
    out = None
    for read in (fixtures.gauges, fixtures.counters, fixtures.histograms):
        x = read(spark, SF).where(F.col("ts_us").between(START, START + 3 * fixtures.DAY - 1))
        x = x if "app_id" in x.columns else x.withColumn("app_id", F.lit("app-1"))
        for c, t in (("temporality", "string"), ("count", "long"), ("bucket_counts", "array<long>"), ("explicit_bounds", "array<double>")):
            x = x if c in x.columns else x.withColumn(c, F.lit(None).cast(t))
        out = x.select(*columns) if out is None else out.unionByName(x.select(*columns))
    return out


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("points"))
    sinks.write_signal(_points(spark), folder, "ts_us")
    return folder


def _rows(df):
    return sorted(map(str, df.select("tier", "app_id", "hour", "name", "series", "ts_us", F.round("value", 6), "min", "max", "count", "first", "last", "bucket_counts").collect()))


def test_only_ready_hours_are_rolled_up_and_each_once(spark, points, tmp_path):
    tier, done = str(tmp_path / "tier"), str(tmp_path / "done")
    first = rollup_job.run(spark, points, tier, done, START + 30 * fixtures.HOUR)
    assert first.agg(F.max("hour")).first()[0] == START + 27 * fixtures.HOUR  # ended two hours ago
    second = rollup_job.run(spark, points, tier, done, START + 80 * fixtures.HOUR)
    assert second.agg(F.min("hour"), F.max("hour")).first() == (START + 28 * fixtures.HOUR, START + 71 * fixtures.HOUR)
    assert rollup_job.run(spark, points, tier, done, START + 80 * fixtures.HOUR).count() == 0
    marks = {r["app_id"]: r["watermark"] for r in rollup_job.watermarks(spark, done).collect()}
    assert set(marks.values()) == {START + 72 * fixtures.HOUR} and len(marks) == 5
    whole = rollup_job.roll_up(spark.read.parquet(points))
    got = spark.read.parquet(tier)
    assert got.count() == whole.count()
    assert got.agg(F.sum("count")).first() == whole.agg(F.sum("count")).first()


def test_a_run_that_stops_between_its_writes_is_made_up_for(spark, points, tmp_path, monkeypatch):
    tier, done = str(tmp_path / "tier"), str(tmp_path / "done")
    write = sinks.write_rollup

    def then_stop(*args):
        write(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "write_rollup", then_stop)
    with pytest.raises(RuntimeError):
        rollup_job.run(spark, points, tier, done, START + 80 * fixtures.HOUR)
    assert rollup_job.progress(spark, done).count() == 0
    left = _rows(spark.read.parquet(tier))
    monkeypatch.setattr(sinks, "write_rollup", write)
    rollup_job.run(spark, points, tier, done, START + 80 * fixtures.HOUR)
    assert _rows(spark.read.parquet(tier)) == left and len(left) > 100
    assert rollup_job.progress(spark, done).count() == 5 * 72


def test_a_missing_hour_holds_the_watermark(spark):
    done = spark.createDataFrame([("a", h * fixtures.HOUR) for h in (3, 4, 6)] + [("b", 9 * fixtures.HOUR)], "app_id string, hour long")
    assert {r["app_id"]: r["watermark"] // fixtures.HOUR for r in rollup.watermark(done).collect()} == {"a": 4, "b": 9}


@pytest.mark.parametrize("split", [START, START + 31 * fixtures.HOUR, START + 3 * fixtures.DAY])
def test_steps_across_the_split_are_those_of_raw_rows(spark, split):
    raw = fixtures.gauges(spark, SF)
    rolled = rollup.rollup_gauge(raw, labels=True)
    functions = ("avg", "sum", "count", "min", "max")
    step, end = 6 * fixtures.HOUR, START + 3 * fixtures.DAY
    rows = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("event_type", "t", *functions).collect())
    got = rows(rollup.mixed_range(raw, rolled, START, end, step, split, *functions, by=("event_type",)))
    assert got == rows(metrics.range_aggregate(raw, START, end, step, *functions, by=("event_type",)))
    with pytest.raises(ValueError):
        rollup.mixed_range(raw, rolled, START, end, step, split, "p99")


def test_first_and_last_come_from_the_right_tier(spark):
    raw = fixtures.counters(spark, SF)
    rolled = rollup.rollup_counter(raw, labels=True)
    args = (START, START + 3 * fixtures.DAY, 6 * fixtures.HOUR)
    got = rollup.mixed_range(raw, rolled, *args, START + 31 * fixtures.HOUR, "first", "last", by=("event_type", "shard"))
    want = metrics.range_aggregate(raw, *args, "first", "last", by=("event_type", "shard"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert rollup.split_point(10 * fixtures.HOUR + 5) == 7 * fixtures.HOUR

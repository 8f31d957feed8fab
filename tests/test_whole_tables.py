"""Range queries reach every row of their tables."""

from pyspark.sql import functions as F

from tracefold.plans import registry
from tracefold.sources import fixtures

SF = "/root/testdata/sf0.001"


def _total(spark, name, column):
    return registry.queries()[name](spark, SF).agg(F.sum(column)).first()[0]


def test_every_row_is_in_range(spark):
    events = fixtures.read(spark, SF, "events").count()
    assert registry.queries()["m06_raw"](spark, SF).count() == events
    assert _total(spark, "m03_missing_labels", "count") == events
    assert _total(spark, "l06_rates", "n") == events
    served = fixtures.spans(spark, SF).where("kind = 'Server' and dur_us > 0").count()
    assert _total(spark, "t20_histogram", "n") == served


def test_every_series_is_filled(spark):
    series = fixtures.gauges(spark, SF).select("labels.event_type", "labels.shard").distinct().count()
    got = registry.queries()["m04_fill_zero"](spark, SF)
    assert got.select("event_type", "shard").distinct().count() == series
    assert got.agg(F.max("t") - F.min("t")).first()[0] > 29 * fixtures.DAY

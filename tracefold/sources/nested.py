"""OTLP-shaped rows made from the flat test tables; flattening is checked on them.

Rows stand as exporters send them: kinds and states in their long spelling, zero ids for missing ones, repeated keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
NO_SPAN, NO_TRACE = "0" * 16, "0" * 32


def _pairs(*items: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in items])


def _resource() -> Column:
    """Service, app and a repeated key, of which the last counts."""
    host = (("host", F.lit("old")), ("host", F.lit("new")))
    return F.struct(_pairs(("service.name", F.col("service")), ("app.id", F.concat("app_id", F.lit("/x"))), *host).alias("attributes"))


def _packed(rows: DataFrame, keys: list[str], signal: str, records: str, record: Column) -> DataFrame:
    """One row per ``keys``, service and app, with one scope."""
    scope = F.struct(F.struct(F.lit(f"lib.{signal}").alias("name")).alias("scope"), F.collect_list(record).alias(records))
    packed = rows.groupBy("service", "app_id", *keys).agg(scope.alias("scope"))
    return packed.select(_resource().alias("resource"), F.array("scope").alias(f"scope_{signal}"))


def traces(spans: DataFrame, *dealt_by: str) -> DataFrame:
    """(resource, scope_spans): a row per trace, service and app. ``dealt_by``: columns of one value in a trace by which ``spans`` is dealt
    already; then spans are packed where they are, and no shuffle holds them."""
    parent = F.when(F.col("parent_span_id") == "", NO_SPAN).otherwise(F.col("parent_span_id"))
    attributes = F.concat(F.map_entries("attributes"), _pairs(("a.b.c", F.col("kind"))))
    record = F.struct(
        "trace_id", "span_id", parent.alias("parent_span_id"), "name", F.concat(F.lit("SPAN_KIND_"), F.upper("kind")).alias("kind"),
        F.concat(F.lit("STATUS_CODE_"), F.upper("status_code")).alias("status"), "start_us", "end_us", attributes.alias("attributes"),
    )
    return _packed(spans, ["trace_id", *dealt_by], "spans", "spans", record)


def metrics(points: DataFrame, kind: str, monotonic: bool = False, temporality: str | None = None) -> DataFrame:
    """(resource, scope_metrics): a row per hour, metric, service and app. ``points``: ts_us, name, unit, value, labels, service,
    app_id, and count, bucket_counts and explicit_bounds where they have them."""
    lists = {"count": "bigint", "bucket_counts": "array<bigint>", "explicit_bounds": "array<double>"}
    x = points.select(*points.columns, *(F.lit(None).cast(t).alias(c) for c, t in lists.items() if c not in points.columns))
    summed = kind in ("histogram", "summary")
    nothing = F.lit(None).cast("double")
    point = F.struct(
        "ts_us", (nothing if summed else F.col("value")).alias("value"), (F.col("value") if summed else nothing).alias("sum"), "count", "bucket_counts", "explicit_bounds", F.map_entries("labels").alias("attributes")
    )
    x = x.groupBy("service", "app_id", "name", "unit", F.floor(F.col("ts_us") / HOUR).alias("hour")).agg(F.collect_list(point).alias("points"))
    metric = F.struct("name", "unit", F.lit(kind).alias("kind"), F.lit(monotonic).alias("monotonic"), F.lit(temporality).cast("string").alias("temporality"), "points")
    return _packed(x, ["hour"], "metrics", "metrics", metric)


def logs(records: DataFrame) -> DataFrame:
    """(resource, scope_logs): a row per minute, service and app; INFO records have no trace."""
    free = F.col("severity") == "INFO"
    record = F.struct(
        "ts_us", "severity_number", "severity", "body", F.when(free, NO_TRACE).otherwise(F.col("trace_id")).alias("trace_id"), F.when(free, NO_SPAN).otherwise(F.col("span_id")).alias("span_id"), F.map_entries("attributes").alias("attributes")
    )
    return _packed(records.withColumn("minute", F.floor(F.col("ts_us") / 60_000_000)), ["minute"], "logs", "records", record)

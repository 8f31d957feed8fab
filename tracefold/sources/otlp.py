"""Flattening of nested OTLP-shaped rows (resource -> scope -> record) into the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import app_id, latest, metric_labels, sanitize_attributes, sanitized_map, span_kind, span_status


def _map(pairs: Column) -> Column:
    """key/value entries to a map; of repeated keys the last counts."""
    keys = pairs["key"]
    entries = F.transform(pairs, lambda p, i: F.named_struct(F.lit("k"), p["key"], F.lit("o"), i, F.lit("v"), p["value"]))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, pairs["value"])).otherwise(latest(entries))


def _attributes(pairs: Column) -> Column:
    """key/value entries to a map with sanitised keys; where none become equal no other map is made before."""
    return sanitized_map(pairs["key"], pairs["value"], sanitize_attributes(_map(pairs)))


def _resource() -> list[Column]:
    """What a resource says of all its records, worked out before these are listed."""
    r = F.col("resource")
    service = F.coalesce(F.nullif(r["service.name"], F.lit("")), F.lit("unknown"))
    return [service.alias("service"), app_id(r).alias("app_id"), sanitize_attributes(r).alias("resource")]


def _records(df: DataFrame, scopes: str, records: str) -> DataFrame:
    x = df.select(_map(F.col("resource.attributes")).alias("resource"), scopes).select(*_resource(), F.explode(scopes).alias("scope"))
    return x.select("service", "app_id", "resource", F.col("scope.scope.name").alias("scope_name"), F.explode(F.col("scope")[records]).alias("r"))


def _id(value: Column) -> Column:
    """A zero id is none."""
    return F.when(value.isNull() | F.rlike(value, F.lit("^0*$")), "").otherwise(value)


def flatten_traces(df: DataFrame) -> DataFrame:
    """Spans from rows (resource, scope_spans)."""
    x = _records(df, "scope_spans", "spans")
    return x.select(
        F.col("r.trace_id").alias("trace_id"), F.col("r.span_id").alias("span_id"), _id(F.col("r.parent_span_id")).alias("parent_span_id"), F.col("r.name").alias("name"),
        span_kind(F.col("r.kind")).alias("kind"), span_status(F.col("r.status")).alias("status_code"), F.col("r.start_us").alias("start_us"), F.col("r.end_us").alias("end_us"), F.greatest(F.col("r.end_us") - F.col("r.start_us"), F.lit(0)).alias("dur_us"),
        "service", "app_id", _attributes(F.col("r.attributes")).alias("attributes"), "resource", "scope_name",
    )


def flatten_metrics(df: DataFrame) -> DataFrame:
    """Points from rows (resource, scope_metrics). Monotonic sums are counters, other sums gauges; histograms and summaries give their sum."""
    x = _records(df, "scope_metrics", "metrics")
    kind = F.when(F.col("r.kind") == "sum", F.when(F.col("r.monotonic"), "counter").otherwise("gauge")).otherwise(F.col("r.kind"))
    p = x.select("service", "app_id", F.col("r.name").alias("name"), F.col("r.unit").alias("unit"), kind.alias("type"), F.when(kind.isin("counter", "histogram"), F.coalesce("r.temporality", F.lit(""))).alias("temporality"), F.explode("r.points").alias("p"))
    return p.select(
        F.col("p.ts_us").alias("ts_us"), "name", "type", F.coalesce(F.when(F.col("type").isin("histogram", "summary"), F.col("p.sum")).otherwise(F.col("p.value")), F.lit(0.0)).alias("value"), metric_labels(_map(F.col("p.attributes"))).alias("labels"),
        "service", "app_id", "unit", F.col("p.bucket_counts").alias("bucket_counts"), F.col("p.explicit_bounds").alias("explicit_bounds"), F.col("p.count").alias("count"), "temporality",
    )


def flatten_logs(df: DataFrame) -> DataFrame:
    """Log records from rows (resource, scope_logs)."""
    x = _records(df, "scope_logs", "records")
    return x.select(
        F.col("r.ts_us").alias("ts_us"), F.col("r.severity_number").alias("severity_number"), F.col("r.severity").alias("severity"), F.col("r.body").alias("body"), _id(F.col("r.trace_id")).alias("trace_id"), _id(F.col("r.span_id")).alias("span_id"),
        "service", "app_id", _attributes(F.col("r.attributes")).alias("attributes"),
    )

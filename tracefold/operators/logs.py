"""Log search, statistics, metrics from logs, field extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.model import time_bucket
from .filters import time_range

_LOGFMT = r'([^\s=]+)=("(?:[^"\\]|\\.)*"|\S*)'


def search(logs: DataFrame, condition: Column, limit: int = 100, offset: int = 0, forward: bool = False) -> DataFrame:
    hits = logs.where(condition)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    order = ("ts_us", "log_id") if forward else (F.desc("ts_us"), F.desc("log_id"))
    return hits.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def any_search(*results: DataFrame, limit: int = 100) -> DataFrame:
    """Branches of an OR, without records of the same time and body."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.dropDuplicates(["ts_us", "body"]).orderBy(F.desc("ts_us"), "body").limit(limit)


#: Time around a record in which its neighbours are looked for first; it doubles up to the last value.
REACH, FARTHEST = 3_600_000_000, 200 * 366 * 86_400_000_000


def context(logs: DataFrame, log_id: int, before: int, after: int, day: str | None = None, reach_us: int = REACH) -> DataFrame:
    """Records of the same service around one.

    A time range around the record is doubled until it has enough records on either side, so only days near it are read where ``day`` names a
    partition column (days since 1970). An unknown record has no context.
    """
    one = logs.where(F.col("log_id") == log_id).select("service", "ts_us").first()
    if one is None:
        return logs.limit(0)
    service, at = one
    place = F.struct("ts_us", "log_id") < F.struct(F.lit(at).cast("long").alias("ts_us"), F.lit(log_id).cast("long").alias("log_id"))
    while True:
        near = time_range(logs.where(F.col("service") == service), "ts_us", at - reach_us, at + reach_us, day)
        earlier, later = near.agg(F.count_if(place), F.count_if(~place)).first()
        if (earlier >= before and later > after) or reach_us > FARTHEST:
            break
        reach_us *= 2
    return near.where(place).orderBy(F.desc("ts_us"), F.desc("log_id")).limit(before).unionByName(near.where(~place).orderBy("ts_us", "log_id").limit(after + 1))


def statistics(logs: DataFrame, step: int) -> DataFrame:
    """(facet, key, n): total, by severity, by service, by time bucket, from one pass over grouping sets."""
    x = logs.select("severity", "service", time_bucket(F.col("ts_us"), step).alias("t"))
    g = x.groupingSets([[], ["severity"], ["service"], ["t"]], "severity", "service", "t").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "severity").when(F.col("g") == 5, "service").otherwise("time")
    return g.select(facet.alias("facet"), F.coalesce("severity", "service", F.col("t").cast("string"), F.lit("")).alias("key"), "n")


def count_over_time(logs: DataFrame, start: int, end: int, step: int, *by: str, top: int | None = None) -> DataFrame:
    """Records per label set and interval; ``top`` keeps the label sets with most records."""
    x = logs.where((F.col("ts_us") >= start) & (F.col("ts_us") < end))
    n = x.groupBy(*by, time_bucket(F.col("ts_us"), step, start).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    if top is None or not by:
        return n
    best = n.groupBy(*by).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), *by).limit(top)
    return n.join(best, list(by), "left_semi")


def rates(logs: DataFrame, start: int, end: int, step: int, *by: str) -> DataFrame:
    """count, rate, bytes_over_time and bytes_rate per label set and interval."""
    x = logs.where((F.col("ts_us") >= start) & (F.col("ts_us") < end))
    g = x.groupBy(*by, time_bucket(F.col("ts_us"), step, start).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("body")).alias("n_bytes"))
    return g.select(*by, "t", "n", (F.col("n") / (step / 1e6)).alias("rate"), "n_bytes", (F.col("n_bytes") / (step / 1e6)).alias("bytes_rate"))


def instant_count(logs: DataFrame, at: int, look_back: int = 300_000_000, *by: str) -> DataFrame:
    return logs.where((F.col("ts_us") > at - look_back) & (F.col("ts_us") <= at)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def merge_results(*results: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Metric results of OR branches, added up at equal times."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.groupBy(*by, "t").agg(F.sum("n").alias("n"))


def volume(logs: DataFrame, label: str, limit: int) -> DataFrame:
    return logs.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(limit)


def label_values(logs: DataFrame, label: str) -> DataFrame:
    return logs.select(F.col(label).alias("value")).distinct()


def json_fields(body: Column) -> Column:
    """Top-level keys of a JSON object; nested values stay JSON text. Null for other text."""
    return F.from_json(body, "map<string,string>")


def logfmt_fields(body: Column) -> Column:
    """key=value pairs; of repeated keys the last counts."""
    keys = F.regexp_extract_all(body, F.lit(_LOGFMT), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(_LOGFMT), F.lit(2)), lambda v: F.when(F.startswith(v, F.lit('"')), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r'\\(.)', "$1")).otherwise(v))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    own = F.array_distinct(keys)
    return F.map_from_arrays(own, F.transform(own, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def unpack(body: Column) -> Column:
    return F.coalesce(F.when(F.startswith(F.ltrim(body), F.lit("{")), json_fields(body)), logfmt_fields(body))


def line_format(logs: DataFrame, template: str, fields: Column, body: str = "body") -> DataFrame:
    """{{.label}} and {{.body}} are put in; a row whose line becomes empty goes."""
    parts = []
    for i, piece in enumerate(re.split(r"\{\{\s*\.(\w+)\s*\}\}", template)):
        parts.append(F.lit(piece) if i % 2 == 0 else F.col(body) if piece == "body" else F.coalesce(fields[piece], F.lit("")))
    return logs.withColumn("line", F.concat(*parts)).where("line <> ''")


def contains_flag(logs: DataFrame, name: str, needle: str, body: str = "body") -> DataFrame:
    return logs.withColumn(name, F.contains(F.col(body), F.lit(needle)))


def detected_fields(logs: DataFrame, fields: str = "attributes") -> DataFrame:
    """Field names with the type all their values allow and their number of values."""
    x = logs.select(F.explode(fields).alias("field", "value"))
    number, boolean = F.bool_and(F.col("value").try_cast("double").isNotNull()), F.bool_and(F.lower("value").isin("true", "false"))
    return x.groupBy("field").agg(F.when(boolean, "boolean").when(number, "number").otherwise("string").alias("kind"), F.count_distinct("value").alias("cardinality"))


def field_counts(logs: DataFrame, *fields: str) -> DataFrame:
    x = logs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("s")).select("s.*")
    return x.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def streams(logs: DataFrame, limit_per_stream: int) -> DataFrame:
    """Newest records of each service and severity."""
    w = W.partitionBy("service", "severity").orderBy(F.desc("ts_us"), F.desc("log_id"))
    return logs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit_per_stream).select("service", "severity", "nth", "log_id", "ts_us", "body")


def of_spans(logs: DataFrame, spans: DataFrame, on: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    return logs.join(spans.select(*on).distinct(), list(on), "left_semi")

"""Filters: time ranges, label matchers, span conditions, log line filters. They return Columns or filtered frames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model import label_name, span_kind, span_status

_INTRINSICS = {"name": "name", "kind": "kind", "status": "status_code", "statusMessage": "status_message", "duration": "dur_us", "service": "service", "spanID": "span_id", "parentID": "parent_span_id", "traceID": "trace_id"}
_LOG_NAMES = {"service_name": "service", "severity": "severity", "level": "severity", "detected_level": "severity", "appId": "app_id", "traceID": "trace_id"}


def time_range(df: DataFrame, ts: str, start_us: int, end_us: int, day: str | None = None) -> DataFrame:
    """Rows in [start, end]; ``day`` names a partition column (days since 1970), pruned to the range and a day either side."""
    if day:
        df = df.where(F.col(day).between(start_us // 86_400_000_000 - 1, end_us // 86_400_000_000 + 1))
    return df.where(F.col(ts).between(start_us, end_us))


_SPECIAL = r"[\\^$.*+?()\[\]{}]"


def match(value: Column, op: str, wanted: str) -> Column:
    """=, !=, =~ and !~ (anchored). A missing value matches the negatives. Plain patterns become =, IN or a prefix."""
    if op in ("!=", "!~"):
        return ~F.coalesce(match(value, op.replace("!=", "=").replace("!~", "=~"), wanted), F.lit(False))
    if op == "=":
        return value == wanted
    if not re.search(_SPECIAL, wanted):
        parts = wanted.split("|")
        return value.isin(*parts) if len(parts) > 1 else value == wanted
    if wanted.endswith(".*") and not re.search(_SPECIAL + r"|\|", wanted[:-2]):
        return value.startswith(wanted[:-2])
    return F.rlike(value, F.lit(rf"\A(?:{wanted})\z"))


#: Labels whose wanted values may be spelled in several ways.
_SPELLED = {"span_kind": span_kind, "status_code": span_status}


def label_matchers(labels: Column, *matchers: tuple[str, str, str]) -> Column:
    """All of the matchers; names, and kinds and states that are named or listed, may be in any spelling."""

    def one(key: str, op: str, wanted: str) -> Column:
        name = label_name(key)
        if name in _SPELLED and op in ("=", "!="):
            same = F.coalesce(labels[name] == _SPELLED[name](F.lit(wanted)), F.lit(False))
            return same if op == "=" else ~same
        if name in _SPELLED and not re.search(_SPECIAL, wanted):  # a pattern that only lists values
            same = F.coalesce(labels[name].isin(*(_SPELLED[name](F.lit(w)) for w in wanted.split("|"))), F.lit(False))
            return same if op == "=~" else ~same
        return match(labels[name], op, wanted)

    return reduce(lambda a, b: a & b, (one(*m) for m in matchers), F.lit(True))


def metric_names(name: Column, *selectors: tuple[str, str]) -> Column:
    return any_of(*(match(name, op, v) for op, v in selectors))


def attribute(name: str) -> Column:
    """resource.x, span.x, event.x or .x (span attribute, else resource attribute)."""
    scope, _, key = name.partition(".")
    if scope == "resource":
        return F.col("resource")[key]
    if scope == "span":
        return F.col("attributes")[key]
    if scope == "event":
        return F.get(F.filter("events", lambda e: F.map_contains_key(e["attributes"], key)), F.lit(0))["attributes"][key]
    return F.coalesce(F.col("attributes")[key if scope == "" else name], F.col("resource")[key if scope == "" else name])


def span_condition(field: str, op: str, wanted) -> Column:
    """An intrinsic or attribute against a value; None asks for existence. Numbers compare as numbers."""
    value = F.col(_INTRINSICS[field]) if field in _INTRINSICS else attribute(field)
    if wanted is None:
        return value.isNotNull() if op == "!=" else value.isNull()
    if field == "kind":
        value, wanted = span_kind(value), {"1": "Internal", "2": "Server", "3": "Client", "4": "Producer", "5": "Consumer"}.get(str(wanted), str(wanted).removeprefix("SPAN_KIND_").capitalize())
    if field == "status":
        value, wanted = span_status(value), str(wanted).removeprefix("STATUS_CODE_").capitalize()
    if op in ("=~", "!~"):
        return match(value, op, wanted)
    if isinstance(wanted, (int, float)) and field not in _INTRINSICS:
        value = value.try_cast("double")
    return {"=": value == wanted, "!=": value != wanted, "<": value < wanted, ">": value > wanted, "<=": value <= wanted, ">=": value >= wanted}[op]


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_event(name: str | None = None, **attributes: str) -> Column:
    return F.exists("events", lambda e: all_of(*([e["name"] == name] if name else []), *(e["attributes"][k.replace("__", ".")] == v for k, v in attributes.items())))


def is_root() -> Column:
    return F.col("parent_span_id").isin("", "0" * 16)


def duration_between(low_us: int | None = None, high_us: int | None = None) -> Column:
    return all_of(*([F.col("dur_us") >= low_us] if low_us is not None else []), *([F.col("dur_us") <= high_us] if high_us is not None else []))


def trace_duration_between(spans: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """Spans of traces whose whole duration lies in the bounds."""
    whole = spans.groupBy("trace_id").agg((F.max("end_us") - F.min("start_us")).alias("d")).where(F.col("d").between(low_us, high_us))
    return spans.join(whole, "trace_id", "left_semi")


def stream_selector(*matchers: tuple[str, str, str]) -> Column:
    return all_of(*(match(F.col(_LOG_NAMES[k]) if k in _LOG_NAMES else F.col("attributes")[k], op, v) for k, op, v in matchers))


def line_filter(op: str, wanted: str, body: str = "body") -> Column:
    """|= contains, != lacks, |~ matches, !~ does not match. An empty pattern keeps every line."""
    if not wanted:
        return F.lit(True)
    line = F.col(body)
    return {"|=": F.contains(line, F.lit(wanted)), "!=": ~F.contains(line, F.lit(wanted)), "|~": F.rlike(line, F.lit(wanted)), "!~": ~F.rlike(line, F.lit(wanted))}[op]


def full_text(query: str, body: str = "body") -> Column:
    """Every word of the query is a word of the line, in any order."""
    words = F.split(F.lower(F.col(body)), r"\W+")
    return all_of(*(F.array_contains(words, w) for w in re.split(r"\W+", query.lower()) if w))


def extracted_filter(fields: Column, name: str, op: str, wanted: str) -> Column:
    return match(fields[name], op, wanted) if op in ("!=", "!~") else F.coalesce(match(fields[name], op, wanted), F.lit(False))

"""Column functions of the data model: keys, names, series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_key(key: Column) -> Column:
    """Keeps the first dot of a key; later dots become underscores."""
    head = F.substring_index(key, ".", 1)
    tail = F.substring(key, F.length(head) + 2, F.length(key))
    return F.when(F.instr(key, ".") == 0, key).otherwise(F.concat(head, F.lit("."), F.translate(tail, ".", "_")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row, however often ``use`` names it; a plain expression is copied to every place."""
    return F.transform(F.array(value), use)[0]


def latest(entries: Column) -> Column:
    """A map of entries (k, o, v); of equal k the one of the greatest o counts. One sort, in which each entry looks at its neighbour."""
    last = lambda e: lambda p, i: (i + 1 == F.size(e)) | (F.get(e, i + 1)["k"] != p["k"])
    kept = bound(F.sort_array(entries), lambda e: F.filter(e, last(e)))
    return bound(kept, lambda e: F.map_from_arrays(e["k"], e["v"]))


def sanitized_map(keys: Column, values: Column, otherwise: Column) -> Column:
    """A map of sanitised ``keys`` and ``values``; ``otherwise`` if keys become equal."""
    return bound(F.transform(keys, sanitize_key), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.map_from_arrays(k, values)).otherwise(otherwise))


def sanitize_attributes(attributes: Column) -> Column:
    """Sanitised keys; of keys that become equal the greatest original key wins."""

    def sanitized(given: Column) -> Column:
        entries = F.transform(F.map_entries(given), lambda e: F.named_struct(F.lit("k"), sanitize_key(e["key"]), F.lit("o"), e["key"], F.lit("v"), e["value"]))
        return sanitized_map(F.map_keys(given), F.map_values(given), latest(entries))

    return bound(attributes, sanitized)


def metric_labels(labels: Column) -> Column:
    """All dots of label names become underscores, all values text."""
    return F.transform_values(F.transform_keys(labels, lambda k, v: F.translate(k, ".", "_")), lambda k, v: v.cast("string"))


#: Characters of an app id that storage names cannot hold; those of the first group become a dash, the others go.
APP_ID_DASHED, APP_ID_DROPPED = " /\\*?|#,", "\"<>"


def sanitize_app_id(app: Column) -> Column:
    return F.translate(app, APP_ID_DASHED + APP_ID_DROPPED, "-" * len(APP_ID_DASHED))


def app_id(attributes: Column) -> Column:
    """app_id, else app.id, else empty; sanitised."""
    filled = [F.nullif(attributes[k], F.lit("")) for k in ("app_id", "app.id")]
    return sanitize_app_id(F.coalesce(*filled, F.lit("")))


def series_key(labels: Column) -> Column:
    """name=value of the labels in name order; maps themselves cannot be grouped on."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(labels)), lambda k: F.concat(k, F.lit("="), labels[k])), ",")


def _spelled(value: Column, prefix: str, names: tuple[str, ...], other: str) -> Column:
    bare = F.upper(F.trim(value))
    cases = [(n, [n.upper(), prefix + n.upper(), str(i)]) for i, n in enumerate(names, 1)]
    out = F.when(bare.isin(cases[0][1]), cases[0][0])
    for name, spellings in cases[1:]:
        out = out.when(bare.isin(spellings), name)
    return out.otherwise(other)


def span_kind(value: Column) -> Column:
    """Internal, Server, Client, Producer or Consumer from any common spelling, else Unspecified."""
    return _spelled(value, "SPAN_KIND_", ("Internal", "Server", "Client", "Producer", "Consumer"), "Unspecified")


def span_status(value: Column) -> Column:
    """Ok or Error from any common spelling, else Unset."""
    return _spelled(value, "STATUS_CODE_", ("Ok", "Error"), "Unset")


def time_bucket(ts_us: Column, step_us: int, origin_us: int = 0) -> Column:
    return F.floor((ts_us - origin_us) / step_us) * step_us + origin_us


def label_name(name: str) -> str:
    """camelCase and dotted names as they are stored."""
    import re

    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name).replace(".", "_")

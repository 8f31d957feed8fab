"""Keyed state of the streaming operators: a store of spans that wait for their other end, and admitted series with running totals."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .generators import FLUSH_US, _own_peer, _waits

PEERS = "trace_id string, span_id string, kind string, service string, start_us long, peer string, peer_source string"


def _due(handle: StatefulProcessorHandle, at_us: int | None) -> None:
    """One timer, for the first thing that is due."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
    if at_us is not None:
        handle.registerTimer(-(-at_us // 1000))


class PeerStore(StatefulProcessor):
    """Waiting spans by trace and id, oldest arrival first; at most ``most`` of them."""

    def __init__(self, within_us: int, most: int):
        self.within_us, self.most = within_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", "spans string")

    def _load(self) -> dict[tuple[str, str], list[Any]]:
        held = self.state.get()
        return {(s[0], s[5]): s for s in json.loads(held[0])} if held and held[0] else {}

    def _store(self, waiting: dict[tuple[str, str], list[Any]]) -> None:
        self.state.update((json.dumps(list(waiting.values())),))
        _due(self.handle, min(s[4] for s in waiting.values()) + self.within_us if waiting else None)

    @staticmethod
    def _table(out: list[tuple[Any, ...]]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["trace_id", "span_id", "kind", "service", "start_us", "peer", "peer_source"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting, out = self._load(), []
        arrived = pd.concat(list(rows)).sort_values(["start_us", "span_id"])
        for trace, span, kind, service, start, at, message in arrived[["trace_id", "span_id", "kind", "service", "start_us", "id", "message"]].itertuples(index=False):
            mine = [trace, span, kind, service, int(start), at, bool(message)]
            held = waiting.pop((trace, at), None)
            if held and held[2] != kind and abs(mine[4] - held[4]) < self.within_us:
                for one, other in ((held, mine), (mine, held)):
                    out.append((*one[:5], None, None) if one[6] else (*one[:5], other[3], "paired"))
                continue
            if held:
                out.append((*held[:5], None, "expired"))
            elif len(waiting) >= self.most:
                out.append((*waiting.pop(next(iter(waiting)))[:5], None, "expired"))
            waiting[trace, at] = mine
        self._store(waiting)
        yield from self._table(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, waiting = timerValues.getCurrentWatermarkInMs() * 1000, self._load()
        gone = [k for k, s in waiting.items() if s[4] + self.within_us <= now]
        out = [(*waiting.pop(k)[:5], None, "expired") for k in gone]
        self._store(waiting)
        yield from self._table(out)

    def close(self) -> None:
        pass


def pair_peers_stream(spans: DataFrame, late: str = "10 seconds", within_us: int = 10_000_000, most: int = 10_000, stores: int = 64) -> DataFrame:
    """The streaming form of ``pair_peers``: (trace_id, span_id, kind, service, start_us, peer, peer_source), each span once it is settled.

    Spans that wait are kept in ``stores`` stores by trace and id, which hold ``most`` spans together. A span leaves its store when its other end
    comes, when a span of its own kind takes its place, when the watermark is past its time to wait, or, if its store is full, as the oldest; but for
    the first it is then ``expired``. All other spans pass at once. Needs the RocksDB state store.
    """
    x = spans.withColumn("ts", F.timestamp_micros("start_us")).withWatermark("ts", late)
    peer, source = _own_peer()
    fields = ["trace_id", "span_id", "kind", "service", "start_us"]
    passing = x.where(~_waits()).select(*fields, peer.alias("peer"), source.alias("peer_source"))
    waits = x.where(_waits()).withColumn("id", F.when(F.col("kind") == "Client", F.col("span_id")).otherwise(F.col("parent_span_id")))
    waits = waits.select(*fields, "id", ((F.col("kind") == "Client") & F.col("attributes")["messaging.system"].isNotNull()).alias("message"), "ts", F.expr(f"pmod(xxhash64(trace_id, id), {stores})").alias("store"))
    settled = waits.groupBy("store").transformWithStateInPandas(PeerStore(within_us, max(1, most // stores)), PEERS, "Append", "EventTime")
    return passing.unionByName(settled)


class SeriesStore(StatefulProcessor):
    """Running totals of the admitted series of an app."""

    def __init__(self, names: list[str], most: int, idle_us: int):
        self.names, self.most, self.idle_us = names, most, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", "totals string, dropped long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        series = {tuple(k): v for k, v in json.loads(held[0])} if held and held[0] else {}
        dropped, out = int(held[1]) if held and held[1] is not None else 0, []
        deltas = pd.concat(list(rows)).sort_values(["t", *self.names])
        now = None
        for row in deltas[[*self.names, "t", "calls", "latency_us", "bucket_counts"]].itertuples(index=False):
            name, (t, calls, us, counts) = tuple(row[: len(self.names)]), row[len(self.names) :]
            if t != now:  # a new cycle: series that were idle too long make room
                now = t
                series = {k: v for k, v in series.items() if t - v[0] <= self.idle_us}
            total = series.get(name)
            if total is None:
                if len(series) >= self.most:
                    dropped += int(calls)
                    continue
                total = series[name] = [0, 0, 0, [0] * len(counts)]
            total[:] = [int(t), total[1] + int(calls), total[2] + int(us), [a + int(b) for a, b in zip(total[3], counts)]]
            out.append((key[0], *name, int(t), total[1], total[2], list(total[3]), dropped))
        self.state.update((json.dumps([[list(k), v] for k, v in series.items()]), dropped))
        if out:
            yield pd.DataFrame(out, columns=["app_id", *self.names, "t", "calls", "latency_us", "bucket_counts", "dropped"])

    def close(self) -> None:
        pass


def cumulative_red_stream(deltas: DataFrame, names: tuple[str, ...] = ("service", "name", "kind", "status_code"), most: int = 2000, cycles: int = 5, step_us: int = FLUSH_US) -> DataFrame:
    """Running totals from the closed windows of ``red_metrics_stream``, with the calls dropped so far.

    An app has at most ``most`` series at a time: further ones are dropped and their calls counted. A series without data for more than ``cycles``
    windows is forgotten, which makes room, and starts from nothing when it comes back. Needs the RocksDB state store.
    """
    schema = f"app_id string, {', '.join(f'{n} string' for n in names)}, t long, calls long, latency_us long, bucket_counts array<long>, dropped long"
    x = deltas.select("app_id", *names, "t", "calls", "latency_us", "bucket_counts", "ts")
    return x.groupBy("app_id").transformWithStateInPandas(SeriesStore(list(names), most, cycles * step_us), schema, "Append", "EventTime")

"""Numbers of the spans of a trace in the order of a walk around its tree.

A walk enters a span, goes around its children in order of start and id, and leaves it. Every entry and exit has one successor, known from the
span's first child, next sibling and parent, so the walk is a linked list, and places in it are found by pointer doubling: each round every event takes over
its successor's successor and what lies in between. A trace of up to ``LARGE`` spans is ranked within a task, many traces at a time; a larger one by
joins, a round at a time, so no task ever holds it. Depth and the number of marked ancestors are sums along the same list.

Spans whose parent is not in the trace are roots. Spans that no root reaches (parents in a loop) are numbered after all others, without parent, and say so.
Rows that share trace and span id count once, the one that starts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LARGE = 200_000
#: Rows that a task ranks together, whole traces: what its Python holds, whatever the input.
TOGETHER = 20_000
COLUMNS = "trace_id string, span_id string, lft long, rgt long, parent long, depth int, above long, marked boolean, looped boolean"


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once: checkpointed where the cluster names a shared folder, else kept by the executors."""
    context = df.sparkSession.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None and shared:
        context.setCheckpointDir(shared)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def _ranked(after: np.ndarray, *weights: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ends of linked lists of at most ``longest`` events, and the sums of weights from each event to its end; the last event is the end itself."""
    after, sums = after.copy(), [w.copy() for w in weights]
    for _ in range(max(1, int(longest).bit_length())):
        for s in sums:
            s += s[after]
        after = after[after]
    return after, sums


def _numbered(trace: np.ndarray, span: np.ndarray, parent: np.ndarray, mark: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers of spans in rows sorted by trace, start and span id; the three columns are codes, parents of roots -1."""
    width = int(max(span.max(initial=0), parent.max(initial=0))) + 1
    keys = trace * width + span
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    rows = np.sort(first)
    of = np.searchsorted(rows, first)[of]
    trace, span, parent, mark, keys = trace[rows], span[rows], parent[rows], mark[rows].astype(np.int64), keys[rows]
    n = len(rows)
    by_key = np.argsort(keys)
    wanted = trace * width + parent
    at = np.minimum(np.searchsorted(keys[by_key], wanted), n - 1)
    up = np.where((parent >= 0) & (parent != span) & (keys[by_key][at] == wanted), by_key[at], -1)
    family = np.where(up >= 0, up, -1 - trace)
    order = np.argsort(family, kind="stable")
    same = family[order][1:] == family[order][:-1]
    follows = np.full(n, -1)
    follows[order[:-1][same]] = order[1:][same]
    heads = order[np.concatenate(([True], ~same))]
    child = np.full(n, -1)
    heads = heads[up[heads] >= 0]
    child[up[heads]] = heads
    # event i enters span i, event n + i leaves it, event 2 n is the end of every walk
    after = np.empty(2 * n + 1, np.int64)
    after[:n] = np.where(child >= 0, child, np.arange(n) + n)
    after[n:-1] = np.where(follows >= 0, follows, np.where(up >= 0, up + n, 2 * n))
    after[-1] = 2 * n
    one = np.ones(n, np.int64)
    weights = [np.concatenate(w) for w in ((one, one, [0]), (one, -one, [0]), (mark, -mark, [0]))]
    starts = np.flatnonzero(np.concatenate(([True], trace[1:] != trace[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    end, (left, open_, marked) = _ranked(after, *weights, longest=2 * int(sizes.max()) + 1)
    reached = end[:n] == 2 * n
    group = np.repeat(np.arange(len(starts)), sizes)
    events = 2 * np.bincount(group, reached, len(starts)).astype(np.int64)
    lft, rgt = events[group] - left[:n] + 1, events[group] - left[n:-1] + 1
    lost = np.flatnonzero(~reached)
    if len(lost):
        nth = np.arange(len(lost)) - np.searchsorted(group[lost], group[lost])
        lft[lost] = events[group[lost]] + 2 * nth + 1
        rgt[lost] = lft[lost] + 1
    parent_number = np.where(reached & (up >= 0), lft[up], -1)
    return {"rows": rows, "of": of, "lft": lft, "rgt": rgt, "parent": parent_number, "depth": np.where(reached, -open_[:n], 0).astype(np.int32), "above": np.where(reached, -marked[:n], 0), "marked": mark > 0, "looped": ~reached}


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Columns of text as numbers, equal texts alike."""
    whole = pa.chunked_array([chunk for c in columns for chunk in c.chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    return np.split(whole.astype(np.int64), np.cumsum([len(c) for c in columns])[:-1])


def _in_tasks(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...] = (), flagged: bool = False) -> Iterator[pa.RecordBatch]:
    """Whole traces of a sorted partition, about ``TOGETHER`` rows at a time; with ``keep``, every row with these columns, else one row per span.
    With ``flagged``, whether any row of the span has a flag, and how many spans of its trace have a row with a mark."""

    def numbered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        (trace,) = _codes(table["trace_id"])
        span, parent = _codes(table["span_id"], table["parent_span_id"])
        none, mark = pc.equal(table["parent_span_id"], "").to_numpy(), table["mark"].to_numpy()
        got = _numbered(trace, span, np.where(none, -1, parent), mark)
        rows, of = got.pop("rows"), got.pop("of")
        if flagged:
            got["flagged"] = np.bincount(of, table["flag"].to_numpy(), len(rows)) > 0
            got["marks"] = np.bincount(trace[rows], np.bincount(of, mark, len(rows)) > 0)[trace[rows]].astype(np.int64)
        kept = table if keep else table.take(pa.array(rows))
        out = pa.table({"trace_id": kept["trace_id"], "span_id": kept["span_id"], **{k: pa.array(v[of] if keep else v) for k, v in got.items()}, **{k: kept[k] for k in keep}})
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            table = pa.Table.from_batches(held)
            trace = table["trace_id"].combine_chunks()
            if last := pc.index(trace, trace[n - 1]).as_py():  # the last trace may go on
                yield from numbered(table.slice(0, last))
                held, n = table.slice(last).to_batches(), n - last
    if n:
        yield from numbered(pa.Table.from_batches(held))


def _by_joins(spans: DataFrame) -> DataFrame:
    """The same for traces of any size: every round is a join of the list with itself."""
    key = ["trace_id", "span_id"]
    x = spans.groupBy(*key).agg(F.min(F.struct("start_us", "parent_span_id")).alias("s"), F.min_by("mark", F.struct("start_us", "parent_span_id")).alias("mark"))
    x = x.select(*key, "s.start_us", "s.parent_span_id", "mark")
    known = x.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known"))
    x = x.join(known, ["trace_id", "parent_span_id"], "left")
    x = settled(x.withColumn("up", F.when(F.col("known") & (F.col("parent_span_id") != "") & (F.col("parent_span_id") != F.col("span_id")), F.col("parent_span_id"))).drop("known", "parent_span_id"))
    family = W.partitionBy("trace_id", "up").orderBy("start_us", "span_id")
    x = x.withColumn("follows", F.lead("span_id").over(family))
    child = x.where("up is not null").groupBy("trace_id", F.col("up").alias("span_id")).agg(F.min(F.struct("start_us", "span_id")).alias("c"))
    x = settled(x.join(child.select(*key, F.col("c.span_id").alias("child")), key, "left"))
    event = lambda span, side: F.struct(span.alias("span"), F.lit(side).alias("side"))
    me, mark = F.col("span_id"), F.col("mark").cast("long")
    enters = x.select("trace_id", event(me, 0).alias("e"), F.when(F.col("child").isNotNull(), event(F.col("child"), 0)).otherwise(event(me, 1)).alias("after"), F.lit(1).cast("long").alias("left"), F.lit(1).cast("long").alias("open"), mark.alias("marks"))
    leaves = x.select("trace_id", event(me, 1).alias("e"), F.when(F.col("follows").isNotNull(), event(F.col("follows"), 0)).when(F.col("up").isNotNull(), event(F.col("up"), 1)).alias("after"), F.lit(1).cast("long"), F.lit(-1).cast("long"), -mark)
    lists = settled(enters.union(leaves))
    longest = lists.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(int(longest).bit_length()):
        on = lists.select("trace_id", F.col("e").alias("after"), F.col("after").alias("beyond"), *(F.col(c).alias(f"{c}_2") for c in ("left", "open", "marks")))
        going = lists.where("after is not null").join(on, ["trace_id", "after"]).select("trace_id", "e", F.col("beyond").alias("after"), *((F.col(c) + F.col(f"{c}_2")).alias(c) for c in ("left", "open", "marks")))
        lists = settled(lists.where("after is null").unionByName(going))
    done = lists.where("after is null").groupBy("trace_id", F.col("e.span").alias("span_id")).agg(
        F.max(F.when(F.col("e.side") == 0, F.struct("left", "open", "marks"))).alias("i"), F.max(F.when(F.col("e.side") == 1, F.col("left"))).alias("o")
    )
    total = done.groupBy("trace_id").agg((2 * F.count(F.lit(1))).alias("events"))
    y = x.select(*key, "up", "mark", "start_us").join(done, key, "left").join(total, "trace_id", "left")
    lost = F.sum(F.col("i").isNull().cast("long")).over(W.partitionBy("trace_id").orderBy(F.col("i").isNull().desc(), "start_us", "span_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    looped, events = F.col("i").isNull(), F.coalesce("events", F.lit(0))
    y = settled(y.withColumn("nth", F.when(looped, lost)) if not y.where(looped).isEmpty() else y.withColumn("nth", F.lit(None).cast("long")))
    y = y.select(
        *key, "up", F.when(looped, events + 2 * F.col("nth") - 1).otherwise(events - F.col("i.left") + 1).alias("lft"), F.when(looped, events + 2 * F.col("nth")).otherwise(events - F.col("o") + 1).alias("rgt"),
        F.when(looped, 0).otherwise(-F.col("i.open")).cast("int").alias("depth"), F.when(looped, 0).otherwise(-F.col("i.marks")).cast("long").alias("above"), F.col("mark").alias("marked"), looped.alias("looped"),
    )
    of_parent = y.where("not looped").select("trace_id", F.col("span_id").alias("up"), F.col("lft").alias("parent"))
    y = y.join(of_parent, ["trace_id", "up"], "left")
    return y.select(*key, "lft", "rgt", F.when(F.col("looped"), -1).otherwise(F.coalesce("parent", F.lit(-1))).cast("long").alias("parent"), "depth", "above", "marked", "looped")


def number_spans(spans: DataFrame, mark: str = "false", large: int = LARGE, keep: tuple[str, ...] = (), whole: dict[str, Column] | None = None, flag: str | None = None) -> DataFrame:
    """(trace_id, span_id, lft, rgt, parent, depth, above, marked, looped) of every span.

    ``lft`` and ``rgt`` count entries and exits of the walk from 1; ``parent`` is the parent's ``lft`` or -1; ``above`` counts the ancestors for which the
    condition ``mark`` holds. A span is below another if its ``lft`` lies between the other's two numbers.
    With ``keep``, a row comes for every row of ``spans``, with these columns of it and the aggregates ``whole`` of its trace: they move in the
    same shuffle as the ids, so nothing is joined afterwards but in traces of more than ``large`` spans.
    With ``flag``, a condition, come ``flagged`` (it holds for a row of the span) and ``marks`` (spans of the trace with a row for which ``mark`` holds) in the same way.
    """
    whole = whole or {}
    key = ["trace_id", "span_id"]
    own = [F.col(c) for c in keep if c != "start_us"] + ([F.coalesce(F.expr(flag), F.lit(False)).alias("flag")] if flag else [])
    x = spans.select(*key, F.coalesce("parent_span_id", F.lit("")).alias("parent_span_id"), "start_us", F.coalesce(F.expr(mark), F.lit(False)).alias("mark"), *own).where("trace_id is not null")
    giant = settled(x.groupBy("trace_id").count().where(F.col("count") > large).select("trace_id"))
    some = not giant.isEmpty()
    small = x.join(giant, "trace_id", "left_anti") if some else x
    small = small.repartition("trace_id").sortWithinPartitions("trace_id", "start_us", "span_id", "parent_span_id")
    small = small.select("trace_id", "span_id", "parent_span_id", "mark", *(["flag"] if flag else []), *keep, *(c.over(W.partitionBy("trace_id")).alias(n) for n, c in whole.items())).where("span_id is not null")
    kept = [f for f in small.schema.fields if f.name in (*keep, *whole)]
    out = small.mapInArrow(partial(_in_tasks, keep=(*keep, *whole), flagged=bool(flag)), ", ".join([COLUMNS, *(["flagged boolean, marks long"] if flag else []), *(f"{f.name} {f.dataType.simpleString()}" for f in kept)]))
    if not some:
        return out
    x = x.join(giant, "trace_id", "left_semi")
    named = x.where("span_id is not null")
    far = _by_joins(named)
    if flag:
        any_row = named.groupBy(*key).agg(F.bool_or("flag").alias("flagged"), F.bool_or("mark").alias("any_mark"))
        far = far.join(any_row.drop("any_mark"), key).join(any_row.groupBy("trace_id").agg(F.count_if("any_mark").alias("marks")), "trace_id")
    if keep:
        far = named.select(*key, *keep).join(far, key)
    if whole:
        far = far.join(x.groupBy("trace_id").agg(*(c.alias(n) for n, c in whole.items())), "trace_id")
    return out.unionByName(far)

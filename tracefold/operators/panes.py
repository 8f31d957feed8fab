"""Sliding windows over a grid of steps, put together from panes.

The ends of all windows cut time into panes: an instant that is an end of some window is a pane of its own (windows are closed), and so is what lies between
two such instants. Samples are aggregated once per series and pane, where a series of many samples is spread over tasks; after that a series has no
more rows than the grid has panes. A window is a fixed number of panes in a row, so it spans two blocks of that many panes: what it holds is the
running aggregate up to its last pane in the later block together with the running aggregate from its first pane to the end of the earlier one. Nothing is copied
to the windows that hold it, and any aggregate that merges will do; sums are never taken as differences of larger sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Windows [t - window, t] for t from ``start`` to ``end`` by ``step``."""

    start: int
    end: int
    step: int
    window: int

    @property
    def steps(self) -> int:
        return (self.end - self.start) // self.step

    @property
    def first(self) -> int:
        return self.start - self.window

    @property
    def last(self) -> int:
        return self.start + self.steps * self.step

    @property
    def per_step(self) -> int:
        """Panes of a step: windows whose length is no multiple of it begin within steps."""
        return 4 if self.window % self.step else 2

    @property
    def length(self) -> int:
        """Panes of a window."""
        return self.window // self.step * self.per_step + (3 if self.window % self.step else 1)

    def pane(self, ts: Column) -> Column:
        since, rest = ts - self.first, self.window % self.step
        cell = F.floor(since / self.step)
        into = since - cell * self.step
        inner = F.when(into == 0, 0).otherwise(1) if not rest else F.when(into == 0, 0).when(into < rest, 1).when(into == rest, 2).otherwise(3)
        return cell * self.per_step + inner

    def origin(self, block: Column) -> Column:
        """A time near the start of a block of panes."""
        return F.floor(block * self.length / self.per_step) * self.step + self.first

    def inside(self, ts: Column) -> Column:
        return ts.between(self.first, self.last)


_FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a + b, a, b)
    return (F.least if kind == "min" else F.greatest)(a, b)


def windows(panes: DataFrame, keys: list[str], grid: Grid, kinds: dict[str, str], first: tuple[str, ...] = (), last: tuple[str, ...] = (), apart: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, ...) of every window that holds a pane, from rows (keys, pane, ...).

    ``kinds`` are merged columns (sum, min or max); ``first`` and ``last`` are columns of the first and last pane of the window. Of the sums ``apart`` the
    shares of both blocks are given as well (``<name>_early`` and ``<name>_late``), with ``home``, the block in which the window begins.
    """
    length, per = grid.length, grid.per_step
    order = W.partitionBy(*keys).orderBy("pane")
    x = panes.withColumn("__next", F.lead("pane").over(order)).withColumn("__before", F.lag("pane").over(order)).withColumn("__block", F.floor(F.col("pane") / length))
    block = W.partitionBy(*keys, "__block")
    upto = block.orderBy("pane").rowsBetween(W.unboundedPreceding, W.currentRow)
    onward = block.orderBy("pane").rowsBetween(W.currentRow, W.unboundedFollowing)
    pane = F.col("pane")
    # windows k begin at pane k * per and end at pane k * per + length - 1
    least_k, most_k = F.greatest(F.ceil((pane - length + 1) / per), F.lit(0)), F.least(F.floor(pane / per), F.lit(grid.steps))
    x = x.withColumn("__from", F.greatest(least_k, F.floor(F.col("__before") / per) + 1)).withColumn("__to", F.least(most_k, F.floor((F.col("__next") - length) / per)))
    x = x.select("*", *(f(c).over(upto).alias(f"__u_{c}") for c, k in kinds.items() for f in (_FUNCTIONS[k],)), *(f(c).over(onward).alias(f"__o_{c}") for c, k in kinds.items() for f in (_FUNCTIONS[k],)))
    each = lambda lo, hi: F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))
    # a window's last pane is the one before which no later pane of it comes, its first pane likewise: each window is met once on either side
    ends = x.select(*keys, each(least_k, F.col("__to")).alias("__k"), F.col("__block").alias("__late"), *(f"__u_{c}" for c in kinds), *last)
    starts = x.select(*(F.col(k).alias(f"__key_{k}") for k in keys), each(F.col("__from"), most_k).alias("__j"), F.col("__block").alias("__early"), *(f"__o_{c}" for c in kinds), *first)
    on = F.col("__k") == F.col("__j")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    both = ends.join(starts, on)
    # the block in which the window begins
    home = F.floor(F.col("__k") * per / length)

    def merged(c: str, kind: str) -> Column:
        u, o = F.col(f"__u_{c}"), F.col(f"__o_{c}")
        return F.when(F.col("__late") == home, o).when(F.col("__early") > home, u).otherwise(_merge(kind, o, u)).alias(c)

    shares = [F.when(F.col("__early") == home, F.col(f"__o_{c}")).otherwise(0).alias(f"{c}_early") for c in apart] + [F.when(F.col("__late") > home, F.col(f"__u_{c}")).otherwise(0).alias(f"{c}_late") for c in apart]
    return both.select(*keys, (F.col("__k") * grid.step + grid.start).alias("t"), *(merged(c, k) for c, k in kinds.items()), *first, *last, *shares, *([home.alias("home")] if apart else []))


def slide(rows: DataFrame, keys: list[str], grid: Grid, **aggregates: tuple[str, str]) -> DataFrame:
    """(keys, t, ...) from rows with ``ts_us``: for each name a kind (sum, min or max) and a column."""
    x = rows.where(grid.inside(F.col("ts_us"))).withColumn("pane", grid.pane(F.col("ts_us")))
    x = x.groupBy(*keys, "pane").agg(*(_FUNCTIONS[kind](c).alias(name) for name, (kind, c) in aggregates.items()))
    return windows(x, keys, grid, {name: kind for name, (kind, _) in aggregates.items()})

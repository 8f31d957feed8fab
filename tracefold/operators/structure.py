"""Structural operators over the parent pointers of spans.

What is below what is read from the numbers of ``tree``: no table of all ancestors is built. Which spans match, without the pairs, is found by counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealing import dealt
from .tree import number_spans, settled


def closure(spans: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """(trace_id, ancestor, descendant, distance), for the spans ``below`` only if these are given.

    Each round doubles the distance covered: pairs are led on by a table of each span's ancestor that far up. Every
    pair is kept once, at its least distance, and no span is its own ancestor, so loops of parents end as trees do: when a round finds nothing new.
    """
    ids = spans.select("trace_id", "span_id", "parent_span_id")
    if below is not None:  # traces without any of these are left out
        below = settled(below.select("trace_id", "span_id").distinct())
        ids = ids.join(below.select("trace_id").distinct(), "trace_id", "left_semi")
    ids = settled(ids)
    named = ids.where("parent_span_id <> '' and parent_span_id <> span_id")
    up = settled(named.join(ids.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct(), ["trace_id", "parent_span_id"], "left_semi"))
    jump = up.select("trace_id", F.col("span_id").alias("ancestor"), F.col("parent_span_id").alias("further"))
    out = up if below is None else up.join(below, ["trace_id", "span_id"], "left_semi")
    out = out.select("trace_id", F.col("parent_span_id").alias("ancestor"), F.col("span_id").alias("descendant"), F.lit(1).alias("distance"))
    step = 1
    while True:
        led = out.join(jump, ["trace_id", "ancestor"]).where("further <> descendant")
        new = led.groupBy("trace_id", F.col("further").alias("ancestor"), "descendant").agg((F.min("distance") + step).alias("distance"))
        new = settled(new.join(out, ["trace_id", "ancestor", "descendant"], "left_anti"))
        if new.isEmpty():
            return out
        out = out.unionByName(new)
        on = jump.select("trace_id", F.col("ancestor").alias("further"), F.col("further").alias("beyond"))
        jump = settled(jump.join(on, ["trace_id", "further"]).select("trace_id", "ancestor", F.col("beyond").alias("further")))
        step *= 2


def _ids(df: DataFrame, name: str) -> DataFrame:
    return df.select("trace_id", F.col("span_id").alias(name)).distinct()


def _once(df: DataFrame) -> DataFrame:
    """(trace_id, span_id), each once."""
    return dealt(df.select("trace_id", "span_id"), "trace_id", "span_id").distinct()


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def _blocks(lo: Column, hi: Column) -> Column:
    """The numbers from lo up to hi (excluded) as blocks of 2 ** level numbers: at most two of each level."""
    def at(level):
        power = _power(level)
        first, end = F.floor((lo + power - 1) / power), F.floor(hi / power)
        block = lambda x, on: F.when((first < end) & on, F.struct(level.alias("level"), x.alias("block")))
        return F.array(block(first, first % 2 == 1), block(end - 1, end % 2 == 1))

    levels = F.sequence(F.lit(0), F.floor(F.log2(hi)).cast("int"))
    return F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull())


def descendants(spans: DataFrame, a: str, b: str, large: int | None = None) -> DataFrame:
    """(trace_id, a, b): spans for which condition ``b`` holds below spans for which ``a`` holds.

    A span of ``a`` asks for an interval of numbers, cut into blocks of powers of two; a span of ``b`` is in one block of each size. So they meet by equal
    blocks, each pair once and no other. Spans in loops of parents are paired by following the loops.
    """
    x = number_spans(spans, a, *([] if large is None else [large]))
    is_b = spans.where(b).select("trace_id", "span_id").distinct()
    x = settled(x.where("marked or above > 0 or looped"))
    over = x.where("marked and not looped and rgt - lft > 1").select("trace_id", F.col("span_id").alias("a"), F.explode(_blocks(F.col("lft") + 1, F.col("rgt"))).alias("at"))
    below = x.where("above > 0 and not looped").join(is_b, ["trace_id", "span_id"], "left_semi")
    levels = F.sequence(F.lit(0), F.floor(F.log2("lft")).cast("int"))
    below = below.select("trace_id", F.col("span_id").alias("b"), "lft", F.explode(levels).alias("level")).select("trace_id", "b", F.struct("level", F.floor(F.col("lft") / _power(F.col("level"))).alias("block")).alias("at"))
    pairs = over.join(below, ["trace_id", "at"]).select("trace_id", "a", "b")
    looped = x.where("looped")
    if looped.isEmpty():
        return pairs
    ring = spans.join(looped.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi")
    round_ = closure(ring).select("trace_id", F.col("ancestor").alias("a"), F.col("descendant").alias("b"))
    return pairs.unionByName(round_.join(_ids(spans.where(a), "a"), ["trace_id", "a"], "left_semi").join(is_b.withColumnRenamed("span_id", "b"), ["trace_id", "b"], "left_semi").select("trace_id", "a", "b"))


def descendant_spans(spans: DataFrame, a: str, b: str, large: int | None = None) -> DataFrame:
    """(trace_id, span_id) of spans of ``b`` that have an ancestor of ``a``, by the number of such ancestors."""
    x = number_spans(spans, a, *([] if large is None else [large]), flag=b)
    return x.where("above > 0 and flagged").select("trace_id", "span_id")


def not_descendant_spans(spans: DataFrame, a: str, b: str, large: int | None = None) -> DataFrame:
    """(trace_id, span_id) of spans of ``b`` in whose trace another span of ``a`` is not their ancestor: the trace has more of ``a`` than are above them.
    Both conditions move with the ids, so nothing is joined with the numbers."""
    x = number_spans(spans, a, *([] if large is None else [large]), flag=b)
    return x.where("flagged and marks - above - cast(marked as int) > 0").select("trace_id", "span_id")


def not_child_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """(trace_id, span_id) of spans of ``b`` in whose trace another span of ``a`` is not their parent, by counts."""
    marks = a.groupBy("trace_id").agg(F.countDistinct("span_id").alias("marks"))
    mine = a.select("trace_id", F.col("span_id").alias("id")).distinct()
    x = b.select("trace_id", "span_id", "parent_span_id").join(marks, "trace_id")
    near = x.select("trace_id", "span_id", F.explode(F.array_distinct(F.array("parent_span_id", "span_id"))).alias("id")).distinct().join(mine, ["trace_id", "id"], "left_semi")
    near = near.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("near"))
    return x.join(near, ["trace_id", "span_id"], "left").where(F.col("marks") > F.coalesce("near", F.lit(0))).select("trace_id", "span_id").distinct()


def sibling_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """(trace_id, span_id) of spans of ``b`` with a sibling of ``a``: their parent has one, not counting themselves."""
    family = ["trace_id", "parent_span_id"]
    some = dealt(a.select(*family, "span_id"), *family).groupBy(*family).agg(F.min("span_id").alias("one"), F.max("span_id").alias("other"))
    return _once(dealt(b.select(*family, "span_id"), *family).join(some, family).where("one <> span_id or other <> span_id"))


def child_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """(trace_id, span_id) of spans of ``b`` whose parent is in ``a``."""
    below = dealt(b.select("trace_id", "span_id", F.col("parent_span_id").alias("a")), "trace_id", "a")
    return _once(below.join(dealt(a.select("trace_id", F.col("span_id").alias("a")), "trace_id", "a"), ["trace_id", "a"], "left_semi"))


def children(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.select("trace_id", F.col("parent_span_id").alias("a"), F.col("span_id").alias("b")).join(_ids(a, "a"), ["trace_id", "a"], "left_semi").select("trace_id", "a", "b").distinct()


def siblings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spans with the same parent, two roots included, a span itself excluded."""
    x = a.select("trace_id", "parent_span_id", F.col("span_id").alias("a"))
    y = b.select("trace_id", "parent_span_id", F.col("span_id").alias("b"))
    return x.join(y, ["trace_id", "parent_span_id"]).where("a <> b").select("trace_id", "a", "b").distinct()


def not_related(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(trace_id, a, b) of one trace that are not in ``pairs``."""
    return _ids(a, "a").join(_ids(b, "b"), "trace_id").where("a <> b").join(pairs, ["trace_id", "a", "b"], "left_anti")


def any_structure(*matched: DataFrame) -> DataFrame:
    """Matched spans of several structural filters, joined by OR: (trace_id, span_id) of each, not pairs."""
    out = None
    for m in matched:
        x = m.select("trace_id", "span_id")
        out = x if out is None else out.unionByName(x)
    return _once(out)


def nested_sets(spans: DataFrame) -> DataFrame:
    """left, right and parent numbers; children in order of start, orphans are roots."""
    return number_spans(spans).select("trace_id", "span_id", "lft", "rgt", "parent")


def tree_rows(spans: DataFrame, large: int | None = None) -> DataFrame:
    """Depth, and offset and width in percent of the trace."""
    x = number_spans(spans, "false", *([] if large is None else [large]), keep=("start_us", "dur_us", "end_us"), whole={"lo": F.min("start_us"), "hi": F.max("end_us")})
    length = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    return x.select("trace_id", "span_id", ((F.col("start_us") - F.col("lo")) * 100 / length).alias("offset_pct"), (F.col("dur_us") * 100 / length).alias("width_pct"), "depth")

"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document first gets its certain whole copies: ``floor(target / source_size)``,
and one more if its chance of being drawn reaches one; what others' chances then lack is shared among the rest. The
chance of a document grows with the square root of its size. What is left of the target is filled by order sampling:
documents are ranked by their random odds divided by their inclusion odds (Pareto sampling), and taken in that order
while their words fit. The gap that is left is less than one document. Of two ways to close it the nearer one is
taken: documents after the cut are added; or the next document is taken and documents before the cut go for it.

The cut is found from sums per slice of the rank: only the one slice of a source in which the cut lies is sorted, so no source is
ever gathered in one task, and whether a document is taken is then a comparison with its source's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import sets_apart, settle, settle_table, word_count

#: Slices of the rank's range.
SLICES = 1 << 16
#: Documents per source and size class (power of two) looked at to close the gap after the cut.
CLOSERS = 16
#: Parts into which the rows of one source are dealt when they meet their source's row.
SALTS = 32
#: Alike rows numbered by one task.
ALIKE_BLOCK = 1 << 16


def source_key(source: Column) -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def source_targets(per: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``per`` (source, source_size, ...; one row per source) with ``target``.

    Sources in code-point order, null last, get the weights in turn. Targets are ``weight * level`` up to
    ``cap * source_size``; the level is raised until the targets add up to ``share`` of all sizes.
    """
    # the place of a source in the order: its place in a range partition after those of the partitions before
    parts = per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = settle(parts.withColumn("pos", F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"))
    nth = F.col("before") + F.col("pos") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    per = settle(parts.join(before, "part").withColumn("weight", weight).drop("part", "pos", "before"))
    # the level of the sources below their cap; raising it can only bring more of them to their cap
    capped_at, level = F.col("source_size") * cap, 0.0
    wanted = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        full = F.col("weight") * level >= capped_at
        held, weight_sum = per.agg(F.sum(F.when(full, capped_at).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not weight_sum or (now := (wanted - held) / weight_sum) <= level:
            break
        level = now
    return per.withColumn("target", F.round(F.least(F.col("weight") * level, capped_at).cast("double"), 6)).drop("weight")


def with_source(rows: DataFrame, per: DataFrame, by: str) -> DataFrame:
    """``rows`` with the columns of their source's row; a source's rows are dealt into SALTS parts by ``by``."""
    salted = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, ["source_key", "__salt"]).drop("__salt")


def _chances(sizes: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(source_key, source_size, target, certain, room, largest, factor, odds) per source, from words per (source_key, size).

    Documents above ``largest`` have a chance of one; ``factor`` times the root of its size is the chance of any other,
    ``odds`` the odds of the mean chance, ``room`` the words that are left to them.
    """
    t = targets.select("source_key", "source_size", "target")
    t = t.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("left", F.when(F.col("certain") >= cap, 0.0).otherwise(F.col("target") - F.col("certain") * F.col("source_size")))
    w = W.partitionBy("source_key").orderBy(F.col("size").desc())
    above, rest = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.currentRow, W.unboundedFollowing)
    x = sizes.where("size > 0").join(t.where("left > 0"), "source_key")
    words = F.col("size") * F.col("docs")
    x = x.withColumn("above", F.coalesce(F.sum(words).over(above), F.lit(0))).withColumn("below", F.sum(words).over(rest))
    x = x.withColumn("factor", (F.col("left") - F.col("above")) / F.sum(F.col("docs") * (F.col("size") * F.sqrt("size"))).over(rest))
    x = x.where(F.col("factor") * F.sqrt("size") < 1)
    best = x.groupBy("source_key").agg(F.max(F.struct("size", "factor", "above", "below", "left")).alias("b"))
    room, mean = F.floor(F.col("b.left") - F.col("b.above")).cast("long"), (F.col("b.left") - F.col("b.above")) / F.col("b.below")
    best = best.select("source_key", room.alias("room"), F.col("b.size").alias("largest"), F.col("b.factor").alias("factor"), (mean / (1 - mean)).alias("odds"))
    return t.drop("left").join(best, "source_key", "left")


def _place() -> Column:
    """A document's rank, brought into [0, 1) without changing its order; about even for documents of the mean chance."""
    u = (F.conv(F.substring("tie", 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    chance = F.least(F.greatest(F.col("factor") * F.sqrt("size"), F.lit(1e-12)), F.lit(1 - 1e-12))
    rank = (u / (1 - u)) / (chance / (1 - chance)) * F.col("odds")
    return F.least(rank / (1 + rank), F.lit(1 - 1e-12))


def _ranked() -> Column:
    """Whether a document's chance is below one and its source has room for some of these."""
    return F.coalesce((F.col("size") > 0) & (F.col("size") <= F.col("largest")) & (F.col("room") > 0), F.lit(False))


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.when(_ranked(), _place())).withColumn("slice", F.floor(F.col("place") * SLICES).cast("int"))


def _cuts(ranked: DataFrame) -> DataFrame:
    """(source_key, border, cut, closers, dropped): the slice in which the cut lies, the last (place, tie) taken in it, the ties taken after it and those left out before it."""
    sums = ranked.groupBy("source_key", "slice").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    upto = F.sum("words").over(W.partitionBy("source_key").orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow))
    over = sums.withColumn("upto", upto).where("upto > room")
    border = settle(over.groupBy("source_key").agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("b"), F.first("room").alias("room")).select("source_key", F.col("b.slice").alias("border"), F.col("b.before").alias("before"), F.col("room").alias("space")))
    inside = ranked.join(border.withColumnRenamed("border", "slice"), ["source_key", "slice"])
    w = W.partitionBy("source_key").orderBy("place", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(w)).where("upto <= space")
    last = inside.groupBy("source_key").agg(F.max(F.struct("place", "tie")).alias("cut"), F.max("upto").alias("taken"))
    cuts = border.join(last, "source_key", "left").withColumn("gap", F.col("space") - F.coalesce("taken", "before"))
    cuts = settle(cuts.select("source_key", "border", "cut", "gap"))
    over = with_source(ranked, cuts, "tie").where(~_taken()).groupBy("source_key").agg(F.min(F.struct("place", "tie", "size")).alias("next"))
    cuts = settle(cuts.join(over, "source_key", "left").withColumn("over", F.col("next.size") - F.col("gap")))
    near = with_source(ranked, cuts, "tie").withColumn("added", ~_taken())
    added, dropped = _closing(near.where("added and size <= gap"), "gap", True), _closing(near.where("not added and size <= over"), "over", False)
    both = cuts.join(added, "source_key", "left").join(dropped, "source_key", "left")
    below, above = F.coalesce("gap_left", "gap"), F.coalesce("over_left", "over")
    none = F.array().cast("array<string>")
    up = F.coalesce(above < below, F.lit(False))
    return both.select(
        "source_key", "border", "cut",
        F.when(up, F.array("next.tie")).otherwise(F.coalesce("gap_ties", none)).alias("closers"),
        F.when(up, F.coalesce("over_ties", none)).otherwise(none).alias("dropped"),
    )


def _closing(near: DataFrame, words: str, after: bool) -> DataFrame:
    """(source_key, ``words``_left, ``words``_ties): documents nearest to the cut that fit into ``words``, larger size classes first."""
    place = F.struct("place", "tie", "size")
    first = near.withColumn("class", F.char_length(F.bin("size"))).groupBy("source_key", "class", "slice").agg((F.min if after else F.max)(place).alias("d"), F.first(words).alias("words"))
    order = [F.col("d.place").asc(), F.col("d.tie").asc()] if after else [F.col("d.place").desc(), F.col("d.tie").desc()]
    first = first.withColumn("nth", F.row_number().over(W.partitionBy("source_key", "class").orderBy(*order))).where(F.col("nth") <= CLOSERS)
    docs = F.array_sort(F.collect_list(F.struct((-F.col("class")).alias("class"), "nth", F.col("d.tie").alias("tie"), F.col("d.size").alias("size"))))
    lists = first.groupBy("source_key").agg(docs.alias("docs"), F.first("words").alias("words"))
    start = F.struct(F.col("words").alias("left"), F.array().cast("array<string>").alias("ties"))
    step = lambda a, d: F.when(d["size"] <= a["left"], F.struct((a["left"] - d["size"]).alias("left"), F.concat(a["ties"], F.array(d["tie"])).alias("ties"))).otherwise(a)
    got = lists.select("source_key", "docs", F.aggregate("docs", start, step).alias("got"))
    # one more, if that comes nearer
    others = F.filter("docs", lambda d: ~F.array_contains("got.ties", d["tie"]))
    last = F.array_min(F.transform(others, lambda d: F.struct(F.abs(F.col("got.left") - d["size"]).alias("off"), d["tie"].alias("tie"))))
    got = got.withColumn("last", last).withColumn("more", F.coalesce(F.col("last.off") < F.col("got.left"), F.lit(False)))
    return got.select(
        "source_key",
        F.when(F.col("more"), F.col("last.off")).otherwise(F.col("got.left")).alias(f"{words}_left"),
        F.when(F.col("more"), F.concat("got.ties", F.array("last.tie"))).otherwise(F.col("got.ties")).alias(f"{words}_ties"),
    )


def _taken() -> Column:
    """Whether a ranked document is before its source's cut; sources without a border are taken whole."""
    in_border = (F.col("slice") == F.col("border")) & F.coalesce(F.struct("place", "tie") <= F.col("cut"), F.lit(False))
    return F.col("border").isNull() | (F.col("slice") < F.col("border")) | in_border


def _copied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source_key, size, tie, ...) with source_size, target, copies and taken."""
    x = _placed(with_source(rows, plan, "tie"))
    sure = F.coalesce(F.col("size") > F.col("largest"), F.lit(False))
    closes, goes = (F.coalesce(F.array_contains(c, F.col("tie")), F.lit(False)) for c in ("closers", "dropped"))
    x = x.withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("certain") + (sure | (_ranked() & ((_taken() & ~goes) | closes))).cast("long")))
    used = ["certain", "room", "largest", "factor", "odds", "border", "cut", "closers", "dropped", "place", "slice", "source_key"]
    return x.withColumn("taken", F.col("copies") * F.col("size")).drop(*used)


@sets_apart("__size", "__print", "__key")
def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 1,
    columns: bool = True,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (= copies * size).

    Rows are independent even if they repeat: a row's random number comes from its id, source and text, and from its number
    among rows alike in these, so reruns agree; of alike rows, which one is taken more often depends on the order of the files.
    A null source is a source of its own; a null or blank text has size 0 and is not taken; ties of the rank are broken by the same
    random number's later digits. An empty table gives no rows. Long texts are only counted. Columns named like an
    output are replaced. ``columns`` keeps the other columns of ``docs``.
    """
    outputs = ["size", "source_size", "target", "copies", "taken"]
    kept = docs.drop(*[c for c in outputs if c not in (text, source, key)])
    name, no_id = source_key(F.col(source)), F.coalesce(F.col(key).cast("string"), F.lit("-"))
    print_ = F.md5(F.concat(F.lit(f"{seed}|"), F.md5(no_id), F.md5(name), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    base = kept.withColumn("__size", word_count(F.col(text))).withColumn("__print", print_).withColumn("__key", name)
    light = base.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col("__key").alias("source_key"), F.col("__size").alias("size"), F.col("__print").alias("print"))
    # rows alike in everything are one entry with a count
    light = settle_table(light.groupBy("id", "source", "source_key", "size", "print").agg(F.count(F.lit(1)).alias("rows")))
    alike = light.where("rows > 1").withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(ALIKE_BLOCK).cast("long")))).repartition("print", "from")
    alike = alike.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("rows"), F.col("from") + ALIKE_BLOCK - 1)))).drop("from")
    each = light.where("rows = 1").withColumn("nth", F.lit(1).cast("long")).unionByName(alike)
    each = each.withColumn("tie", F.md5(F.concat_ws("|", "print", F.col("nth").cast("string")).cast("binary")))

    sizes = settle(light.groupBy("source", "source_key", "size").agg(F.sum("rows").alias("docs")))
    per = sizes.groupBy("source", "source_key").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    chances = settle_table(_chances(sizes.drop("source"), source_targets(per, weights, share, float(cap)), cap))
    ranked = settle_table(_placed(with_source(each, chances, "tie")).where(_ranked()).select("source_key", "tie", "size", "room", "place", "slice"))
    plan = settle_table(chances.join(_cuts(ranked), "source_key", "left"))
    if not columns:
        return _copied(each, plan).select(F.col("id").alias(key), F.col("source").alias(source), *outputs)

    rest = [c for c in kept.columns if c not in outputs]
    rows = base.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(rest)], F.col("__key").alias("source_key"), F.col("__size").alias("size"), F.col("__print").alias("print"))
    named = [F.col(f"__c{i}").alias(c) for i, c in enumerate(rest)]
    if alike.isEmpty():
        return _copied(rows.withColumn("tie", F.md5(F.concat("print", F.lit("|1")).cast("binary"))), plan).select(*named, *outputs)
    # alike rows share their outcomes by turns, numbered within the part of the table they were read from
    several = settle_table(_copied(each.where("rows > 1"), plan).groupBy("print").agg(F.first("rows").alias("rows"), F.sum("copies").alias("copies")))
    single = rows.join(several.select("print"), "print", "left_anti").withColumn("tie", F.md5(F.concat("print", F.lit("|1")).cast("binary")))
    many = settle_table(rows.join(several.select("print"), "print", "left_semi").withColumn("part", F.spark_partition_id()))
    ahead = W.partitionBy("print").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = many.groupBy("print", "part").agg(F.count(F.lit(1)).alias("here")).select("print", "part", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("before"))
    turn = F.row_number().over(W.partitionBy("print", "part").orderBy(F.lit(1)))
    many = many.withColumn("turn", turn).join(before, ["print", "part"]).join(several, "print").withColumn("turn", F.col("turn") + F.col("before"))
    share_of = F.floor(F.col("copies") / F.col("rows")) + (F.col("turn") <= F.col("copies") % F.col("rows")).cast("long")
    many = many.withColumn("share", share_of).join(chances.select("source_key", "source_size", "target"), "source_key")
    many = many.select(*named, "size", "source_size", "target", F.col("share").cast("long").alias("copies"), (F.col("share") * F.col("size")).alias("taken"))
    return _copied(single, plan).select(*named, *outputs).unionByName(many)

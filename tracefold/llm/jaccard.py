"""Exact n-gram Jaccard join with a token-group matrix.

1. A document's set are its distinct word shingles, as 64-bit hashes, put in one global order in which shingles met
   often come last. Documents with equal sets are one class.
2. If two sets reach the threshold, the first ``|x| - need(x) + depth`` tokens of both share at least ``depth`` tokens
   (need(x): the least overlap any partner of x has). Only those tokens are looked at from here on.
   A document with fewer tokens there that another document holds has no link; tokens that no other holds bound
   the overlaps of the rest.
3. Similar documents are partitioned into groups: every document is compared with the leading document of each
   token it holds, the one with the fewest tokens of its own, and what is linked becomes a group.
4. The matrix holds, per token, the groups whose union has it. A document's overlap with a group's union bounds its
   overlap with every member; a group is opened only if the bound reaches what a link needs. Its members that
   share one of the tokens that a link needs first are compared exactly, if their counts of tokens per bucket allow a link.
   Before that, each document asks one leading document of another group for a few rounds, and groups that link become one.
5. The links of all rounds give the components.

No step pairs up all members of a group: within a group nothing is left to find, because its members are connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import bounded_batches, kept_by, only, settle, settle_table
from .components import connected_components
from .wordhash import mix, shingle_pairs, shingle_rows

#: Bits of the table of frequent tokens: 2 ** 22, half a MB. It decides the order of tokens, never the result.
HOT_BITS = 22
#: A token seen this often in one task's rows is reported, and counts as frequent if reports add up to HOT_COUNT.
HOT_IN_TASK = 3
HOT_COUNT = 12
DEPTH = 12
#: The end of a head that is the whole set.
LAST = (1 << 63) - 1
#: Rounds in which documents ask one leading document of another group. They save comparisons; the last step compares all that is left.
MERGE_ROUNDS = 1
#: Rows of one batch of profiles.
PROFILE_ROWS = 1000
#: Texts compared with one document in one group.
GROUP = 256


def need(n, pct: int):
    """The least overlap with any partner of a set of ``n``: ceil(pct% of n)."""
    return (pct * n + 99) // 100


def hot_table(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Bits of the tokens met often, over all documents, packed 64 to a word."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("jaccard")
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= HOT_IN_TASK
            return pa.record_batch({"token": tokens[keep].view(np.int64), "n": counts[keep].astype(np.int64)})

        for batch in batches:
            for tokens in shingle_rows(batch.column(0), width):
                held.append(tokens)
                size += len(tokens)
                if size > 1_000_000:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    tokens = docs.select(text).mapInArrow(often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT)
    bit = F.shiftrightunsigned("token", 64 - HOT_BITS)
    words = tokens.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - HOT_BITS}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (HOT_BITS - 6), np.uint64)
    for r in words.collect():  # at most 2 ** 16 words
        out[r["word"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    return out


def profiles(docs: DataFrame, text: str, key: str, width: int, pct: int) -> DataFrame:
    """(id, n, s1, s2, head, stop, sketch): set size, two 64-bit prints of the set, first tokens in the global order, where in that order they end, counts per bucket."""
    table = docs.sparkSession.sparkContext.broadcast(hot_table(docs, text, width))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("jaccard")
        hot = table.value
        for batch in (b.slice(at, PROFILE_ROWS) for b in batches for at in range(0, b.num_rows, PROFILE_ROWS)):
            n, s1, s2, head, stop, sketches = [], [], [], [], [], []
            for tokens, others in shingle_pairs(batch.column(1), width):
                bit = tokens >> np.uint64(64 - HOT_BITS)
                late = (hot[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                size = len(tokens)
                first = min(size, size - need(size, pct) + DEPTH)
                places = tokens >> np.uint64(2)  # the global order as one number: late tokens have bit 62
                ordered = np.concatenate([places[~late], places[late] | np.uint64(1 << 62)])[:first].view(np.int64)
                head.append(ordered)
                stop.append(LAST if first == size else int(ordered[-1]))
                n.append(size)
                sketches.append(sketch(tokens))
                s1.append(int(mix(tokens).sum(dtype=np.uint64).view(np.int64)) if size else 0)
                s2.append(int(mix(others).sum(dtype=np.uint64).view(np.int64)) if size else 0)
            yield pa.record_batch({"id": batch.column(0), "n": pa.array(n, pa.int64()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "head": pa.array(head, pa.list_(pa.int64())), "stop": pa.array(stop, pa.int64()), "sketch": pa.array(sketches, pa.binary())})

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return settle_table(rows.mapInArrow(profile, "id long, n long, s1 long, s2 long, head array<bigint>, stop long, sketch binary"))


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of tokens per bucket, one byte each; two to four tokens a bucket. Empty (no bound) if a count is above 255."""
    buckets = 1 << max(0, len(tokens).bit_length() - 2)
    counts = np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def may_reach(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    """Whether two sketches allow a link: an overlap is at most the sum of the smaller counts per bucket."""
    if not len(a) or not len(b):
        return True
    buckets = min(len(a), len(b))
    a, b = (x.reshape(-1, buckets).sum(axis=0, dtype=np.int64) for x in (a, b))
    most = int(np.minimum(a, b).sum())
    return 100 * most >= pct * (int(a.sum()) + int(b.sum()) - most)


def promising(pairs: DataFrame, p: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link. Sketches are a small part of the texts, so few texts move after this."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3))
            keep = [may_reach(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8), pct) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = p.where("n > 0").select("id", "sketch")
    both = pairs.join(sides.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b").join(sides.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    return settle_table(both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(bounded, "a long, b long").distinct())


def verified(pairs: DataFrame, docs: DataFrame, text: str, key: str, width: int, pct: int) -> DataFrame:
    """The pairs (a, b) of document ids whose sets reach the threshold, compared exactly, by hashes of another seed than those that proposed them."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = only(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), ids).join(ids, "id", "left_semi")
    # a document of many pairs is compared in several groups, so a group has about GROUP texts, and its own text moves once per group
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("pairs") / GROUP)).alias("part")
    dealt = pairs.join(many, "a").select("a", "b", part)
    lead = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    other = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
    rows = lead.unionByName(other).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets = None, []
        for batch in batches:
            keep = []
            sides = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingle_rows(batch.column(3), width, seed=1))
            for a, part, b, found in sides:
                if group != (a, part):
                    group, sets = (a, part), []
                if b is None:  # rows that share an id all lead
                    sets.append(found)
                    keep.append(False)
                    continue
                both = [(len(x), len(np.intersect1d(x, found, assume_unique=True))) for x in sets]
                keep.append(any(k > 0 and 100 * k >= pct * (n + len(found) - k) for n, k in both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, pct: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, class_id, n_links) for every row of ``docs``.

    class_id is the smallest id with an equal set, component_id the smallest id reachable by links, n_links the
    classes found linked with this one while the groups were built and opened. A text without words has no set, is linked with nothing and is its own component.
    Rows that share an id are one node; a row without id gets its set's size and the component of its equals, if any has an id. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    p = profiles(docs, text, key, width, pct)
    classes = p.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    member = p.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select("id", "rep").distinct()
    several = member.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("id")
    by_id = member.join(several, "id").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # only a class's first document goes on: its copies are known to be linked with it
    leads = p.where("n > 0 and id is not null").select(F.col("id").alias("rep"), F.col("n").cast("int").alias("n"), "stop", "head").join(classes.select("rep").distinct(), "rep", "left_semi")
    # one exchange by token serves the count and the join
    held = leads.select("rep", "n", "stop", F.posexplode("head").alias("pos", "token")).repartition("token")
    twice = held.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    held = settle_table(reachable(settle_table(held.join(twice, "token")), pct))

    fits = lambda a, b: (100 * F.least(a, b) >= pct * F.greatest(a, b))  # noqa: E731  sizes alone allow a link
    step = float(np.log(100 / pct))
    held_by_size = held.withColumn("size_class", F.floor(F.log("n") / step))
    # the document with the fewest tokens of its own leads: the one that others are variants of
    own = F.floor(1000 * (F.col("n") - F.col("reach")) / F.col("n")).alias("own")
    firsts = held_by_size.groupBy("token", "size_class").agg(F.min(F.struct(own, "rep", "n", "stop", "reach")).alias("lead"))
    star = (
        held_by_size.join(firsts, ["token", "size_class"])
        .where((F.col("lead.rep") != F.col("rep")) & fits(F.col("lead.n"), F.col("n")) & can_meet("n", "stop", "reach", "lead.n", "lead.stop", "lead.stop", "lead.reach", pct))
        .select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )
    star = settle_table(star)
    links = settle(verified(promising(star, p, pct), docs, text, key, width, pct))
    groups = connected_components(links.unionByName(by_id), "a", "b")

    # near copies that fell into several groups become one first: each document asks the leading document of another group
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for _ in range(MERGE_ROUNDS):
        placed = with_groups(held, groups, pct)
        pairs = settle_table(leading_pairs(placed, tested, pct))
        if pairs.isEmpty():
            break
        found = settle(verified(promising(pairs, p, pct), docs, text, key, width, pct))
        tested = tested.unionByName(pairs)
        if found.isEmpty():
            break
        links = settle(links.unionByName(found))
        groups = connected_components(links.unionByName(by_id), "a", "b")
    else:
        placed = with_groups(held, groups, pct)
    # then all members of the groups that are still opened are compared
    pairs = member_pairs(placed, opened_groups(placed, pct), pct).join(tested, ["a", "b"], "left_anti")
    more = verified(promising(pairs, p, pct), docs, text, key, width, pct)
    links = settle(links.unionByName(more))
    final = connected_components(links.unionByName(by_id), "a", "b")
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    named = classes.join(final, classes["rep"] == final["node"], "left").drop("node").join(degree, F.col("rep") == F.col("node"), "left")
    # ids are nodes: rows that share an id also share a component
    named = named.select("n", "s1", "s2", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = p.select("id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def with_groups(held: DataFrame, groups: DataFrame, pct: int) -> DataFrame:
    """Head tokens (token, rep, n, stop, reach, grp, pos, tokens, docs) of documents that may have a link in another group."""
    placed = held.drop("reach").join(groups, held["rep"] == groups["node"], "left").select("token", "pos", "rep", "n", "stop", F.coalesce("component", "rep").alias("grp"))
    # only tokens that several groups hold matter, and only documents that can reach a document of another group with them
    placed = settle_table(reachable(shared_by_groups(placed), pct))
    placed = settle_table(reachable(shared_by_groups(placed.drop("reach")), pct))
    # small groups ask large ones, so that a large group's members are not each held against every small group
    sizes = placed.groupBy("grp").agg(F.countDistinct("rep").alias("docs"))
    return settle_table(merge_alike(placed).join(sizes, "grp"))


def leading_pairs(placed: DataFrame, tested: DataFrame, pct: int) -> DataFrame:
    """(a, b), at most one per document: the document and, of the leading documents of its tokens that are in another
    group, the one of the most tokens that was not compared with it. A token has a leading document and one of another group."""
    own = F.floor(1000 * (F.col("n") - F.col("reach")) / F.col("n")).alias("own")
    lead = F.min(F.struct(own, "rep", "n", "stop", "reach", "grp"))
    first = placed.groupBy("token").agg(lead.alias("first"))
    asked = placed.join(first, "token")
    second = asked.where("grp <> first.grp").groupBy("token").agg(lead.alias("second"))
    asked = asked.join(second, "token").withColumn("lead", F.when(F.col("grp") == F.col("first.grp"), F.col("second")).otherwise(F.col("first")))
    fits = (100 * F.least("lead.n", "n") >= pct * F.greatest("lead.n", "n")) & can_meet("n", "stop", "reach", "lead.n", "lead.stop", "lead.stop", "lead.reach", pct)
    counts = asked.where(fits).select("rep", F.col("lead.rep").alias("lead"), "tokens").groupBy("rep", "lead").agg(F.sum("tokens").alias("tokens"))
    counts = counts.withColumn("a", F.least("rep", "lead")).withColumn("b", F.greatest("rep", "lead")).join(tested, ["a", "b"], "left_anti")
    best = counts.groupBy("rep").agg(F.max(F.struct("tokens", "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def opened_groups(placed: DataFrame, pct: int) -> DataFrame:
    """(rep, token, g): the groups opened for a document, with the tokens asked for that it shares with their unions. Of a group of
    one document (``g_docs``), the union is that document's: ``g_first``, with ``n_min`` tokens and ``g_rest`` of them from the shared one on."""
    # the matrix: token -> groups whose union holds it, with the sizes, reaches and least place met
    met = [F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("stop").alias("stop_min"), F.max("stop").alias("stop_max"), F.max("reach").alias("g_reach"), F.max(F.col("n") - F.col("pos")).alias("g_rest"), F.min("rep").alias("g_first")]
    matrix = placed.groupBy("token", F.col("grp").alias("g"), F.col("docs").alias("g_docs")).agg(*met)
    # a document and a group that a link needs share ``enough`` tokens, so those of most holders need not be asked for
    enough = F.least(F.lit(DEPTH), need_column(F.col("n"), pct))
    commonest = W.partitionBy("rep").orderBy(F.col("holders").desc(), "token").rowsBetween(W.unboundedPreceding, W.currentRow)
    asked = placed.withColumn("upto", F.sum("tokens").over(commonest))
    asked = asked.withColumn("unasked", F.coalesce(F.max(F.when(F.col("upto") < enough, F.col("upto"))).over(W.partitionBy("rep")), F.lit(0))).where(F.col("upto") >= enough)
    hits = (
        asked.join(matrix, "token")
        .where(F.struct("docs", "grp") < F.struct("g_docs", "g"))
        .where((100 * F.col("n_max") >= pct * F.col("n")) & (100 * F.col("n") >= pct * F.col("n_min")) & can_meet("n", "stop", "reach", "n_min", "stop_min", "stop_max", "g_reach", pct))
        .where(early("n", "pos", "n_min", "g_rest", DEPTH, pct))
        .select("rep", "n", "stop", "reach", "pos", "token", "tokens", "g", "unasked", "g_docs", "g_first", "n_min", "g_rest")
    )
    hits = settle_table(hits)
    opened = hits.groupBy("rep", "n", "g", "unasked").agg(F.sum("tokens").alias("overlap"))
    opened = opened.where(F.col("overlap") + F.col("unasked") >= enough).select("rep", "g")
    return hits.join(opened, ["rep", "g"], "left_semi")


def merge_alike(placed: DataFrame) -> DataFrame:
    """Tokens that the same documents hold become one, at the least place of each document, with their number.

    Long near copies share thousands of tokens that say the same. Should holders with equal prints differ, their
    tokens merge too, which only adds candidates.
    """
    holders = placed.groupBy("token").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.count(F.lit(1)).alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    merged = placed.join(holders, "token").groupBy("x", "c", "lo", "hi", "rep", "n", "stop", "reach", "grp").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("tokens"))
    return merged.withColumn("token", F.xxhash64("x", "c", "lo", "hi")).withColumnRenamed("c", "holders").drop("x", "lo", "hi")


def member_pairs(placed: DataFrame, opened: DataFrame, pct: int) -> DataFrame:
    """(a, b): documents and members of the groups opened for them that share one of the tokens asked for of which a link of their sizes has at least one:
    of the first ``unasked`` + 1 tokens that a link shares, at least one is asked for."""
    n, m = F.col("n"), F.col("m")
    # a group of one document needs no join with its members, so families of texts just too different for a link meet in the matrix only
    alone = opened.where((F.col("g_docs") == 1) & early("n", "pos", "n_min", "g_rest", F.col("unasked") + 1, pct)).select(F.col("rep").alias("a"), F.col("g_first").alias("b")).distinct()
    query = opened.where("g_docs > 1").select("token", "pos", F.col("rep").alias("a"), "n", "stop", "reach", "unasked", "g")
    member = placed.where("docs > 1").select("token", (n - F.col("pos")).alias("m_rest"), F.col("rep").alias("b"), n.alias("m"), F.col("stop").alias("m_stop"), F.col("reach").alias("m_reach"), F.col("grp").alias("g"))
    return (
        query.join(member, ["token", "g"])
        .where((100 * F.least(n, m) >= pct * F.greatest(n, m)) & can_meet("n", "stop", "reach", "m", "m_stop", "m_stop", "m_reach", pct) & early("n", "pos", "m", "m_rest", F.col("unasked") + 1, pct))
        .select("a", "b")
        .unionByName(alone)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def reachable(rows: DataFrame, pct: int) -> DataFrame:
    """Head tokens (token, rep, n, stop, ...) of documents that may still have a link, with their reach.

    Two linked documents share DEPTH head tokens (or all that a link needs), so one with fewer rows here has no link.
    reach: the set's size less the head tokens that have no row here.
    """
    n = F.col("n")
    counts = rows.groupBy("rep", "n", "stop").agg(F.count(F.lit(1)).cast("int").alias("k"))
    head = F.least(n, n - need_column(n, pct) + DEPTH)
    kept = counts.where(F.col("k") >= F.least(F.lit(DEPTH), need_column(n, pct))).select("rep", "n", "stop", (n - head + F.col("k")).cast("int").alias("reach"))
    return rows.join(kept, ["rep", "n", "stop"])


def shared_by_groups(placed: DataFrame) -> DataFrame:
    """The rows of tokens that more than one group holds."""
    mixed = placed.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    return placed.join(mixed, "token")


def can_meet(n: str, stop: str, reach: str, m: str, stop_least: str, stop_most: str, m_reach: str, pct: int):
    """Whether reaches allow a link of sizes ``n`` and ``m``.

    Of two documents, the one whose head ends first has no token in common with the other but those in both heads and
    those after its head, so its reach bounds the overlap; if they end alike, both do. Of a group whose heads end before
    and after, the larger reach bounds it.
    """
    n, stop, reach, m, stop_least, stop_most, m_reach = (F.col(c) for c in (n, stop, reach, m, stop_least, stop_most, m_reach))
    larger = F.greatest(reach, m_reach)
    most = F.least(F.when(stop <= stop_least, reach).otherwise(larger), F.when(stop >= stop_most, m_reach).otherwise(larger))
    return (100 + pct) * most >= pct * (n + m)


def early(n: str, pos: str, m: str, m_rest: str, depth, pct: int):
    """Whether a shared token is among the first places of both sets that hold ``depth`` of a link's shared tokens: what
    follows it in either set, itself included, and ``depth`` - 1 before it reach the overlap that sizes ``n`` and ``m`` need."""
    needed = F.floor(((F.col(n) + F.col(m)) * pct + 99 + pct) / (100 + pct))
    return F.least(F.col(n) - F.col(pos), F.col(m_rest)) + (depth - 1) >= needed


def need_column(n, pct: int):
    return F.floor((n * pct + 99) / 100)

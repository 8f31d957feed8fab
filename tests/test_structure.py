"""Numbers of spans and what is read from them, against plain walks of small trees."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracefold.operators import structure, tree

SCHEMA = "trace_id string, span_id string, parent_span_id string, start_us long, end_us long, dur_us long, a boolean, b boolean"


def forest(seed, traces=40):
    """Rows with roots, orphans, equal starts, loops of parents, own parents and spans below a loop."""
    rnd = random.Random(seed)
    rows = []
    for t in range(traces):
        n = rnd.randint(1, 30)
        for i in range(n):
            k = rnd.random()
            parent = "" if k < 0.1 else "gone" if k < 0.15 else f"s{i}" if k < 0.18 else f"s{rnd.randrange(n)}" if k < 0.3 else f"s{rnd.randrange(max(i, 1))}"
            start = rnd.randint(0, 20)
            rows.append((f"t{t}", f"s{i}", parent, start, start + 5, 5, rnd.random() < 0.4, rnd.random() < 0.5))
    return rows


def walked(rows):
    """(trace, span) -> (lft, rgt, parent, depth), without the spans that no root reaches."""
    out = {}
    for t in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == t), key=lambda r: (r[3], r[1]))
        ids = {r[1] for r in mine}
        below = {}
        for r in mine:
            below.setdefault(r[2] if r[2] in ids and r[2] not in ("", r[1]) else None, []).append(r[1])
        number = 0

        def walk(span, parent, depth):
            nonlocal number
            number += 1
            lft = number
            for child in below.get(span, []):
                walk(child, lft, depth + 1)
            number += 1
            out[t, span] = (lft, number, parent, depth)

        for root in below.get(None, []):
            walk(root, -1, 0)
    return out


def pairs(rows):
    """(trace, ancestor, descendant), loops included."""
    parent = {(r[0], r[1]): r[2] for r in rows}
    out = set()
    for t, span in parent:
        at, seen = parent[t, span], {span}
        while (t, at) in parent and at not in seen:
            out.add((t, at, span))
            seen.add(at)
            at = parent[t, at]
    return out


@pytest.mark.parametrize("large", [tree.LARGE, 0, 12])
def test_numbers_are_those_of_a_walk(spark, large):
    rows = forest(1)
    want = walked(rows)
    got = tree.number_spans(spark.createDataFrame(rows, SCHEMA).repartition(3), "a", large).collect()
    assert len(got) == len(rows)
    assert {(r["trace_id"], r["span_id"]): (r["lft"], r["rgt"], r["parent"], r["depth"]) for r in got if not r["looped"]} == want
    marks = {(r[0], r[1]): r[6] for r in rows}
    above = {k: sum(marks[t, a] for t, a, d in pairs(rows) if (t, d) == k) for k in want}
    assert {(r["trace_id"], r["span_id"]): r["above"] for r in got if not r["looped"]} == above
    for t in {r[0] for r in rows}:
        numbers = [x for r in got if r["trace_id"] == t for x in (r["lft"], r["rgt"])]
        assert sorted(numbers) == list(range(1, len(numbers) + 1))


@pytest.mark.parametrize("large", [None, 0])
def test_descendants_follow_trees_and_loops(spark, large):
    rows = forest(2)
    df = spark.createDataFrame(rows, SCHEMA)
    a = {(r[0], r[1]) for r in rows if r[6]}
    b = {(r[0], r[1]) for r in rows if r[7]}
    want = sorted((t, x, y) for t, x, y in pairs(rows) if (t, x) in a and (t, y) in b)
    assert sorted(map(tuple, structure.descendants(df, "a", "b", large).collect())) == want


def test_spans_found_by_counts_are_those_of_the_pairs(spark):
    rows = [r for r in forest(3) if r[2] != r[1]]
    reached = walked(rows)
    rows = [r for r in rows if (r[0], r[1]) in reached]
    df = spark.createDataFrame(rows, SCHEMA)
    by_trace = {}
    for r in rows:
        by_trace.setdefault(r[0], []).append(r)
    up = pairs(rows)
    found = {"below": set(), "not_below": set(), "not_child": set(), "sibling": set()}
    for t, mine in by_trace.items():
        for y in (r for r in mine if r[7]):
            for x in (r for r in mine if r[6] and r[1] != y[1]):
                found["below" if (t, x[1], y[1]) in up else "not_below"].add((t, y[1]))
                if y[2] != x[1]:
                    found["not_child"].add((t, y[1]))
                if x[2] == y[2]:
                    found["sibling"].add((t, y[1]))
    a, b = df.where("a"), df.where("b")
    got = {"below": structure.descendant_spans(df, "a", "b"), "not_below": structure.not_descendant_spans(df, "a", "b"), "not_child": structure.not_child_spans(a, b), "sibling": structure.sibling_spans(a, b)}
    for k, want in found.items():
        assert sorted(map(tuple, got[k].select("trace_id", "span_id").collect())) == sorted(want), k
    for plan in (structure.sibling_spans(a, b), structure.any_structure(structure.child_spans(a, b), structure.sibling_spans(a, b))):
        assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()


def test_a_deep_trace_is_numbered(spark):
    """100,000 spans, 50,000 of them one below the other, each with a leaf."""
    n = 50_000
    chain = spark.range(n).selectExpr("'deep' as trace_id", "concat('c', id) as span_id", "if(id = 0, '', concat('c', id - 1)) as parent_span_id", "id * 2 as start_us", "id = 0 as a")
    leaves = spark.range(n).selectExpr("'deep' as trace_id", "concat('l', id) as span_id", "concat('c', id) as parent_span_id", "id * 2 + 1 as start_us", "false as a")
    got = {r["span_id"]: r for r in tree.number_spans(chain.unionByName(leaves).repartition(4), "a").where("span_id in ('c0', 'l0', 'c1', 'c49999', 'l49999')").collect()}
    assert (got["c0"]["lft"], got["c0"]["rgt"]) == (1, 4 * n)
    assert (got["l0"]["lft"], got["l0"]["rgt"], got["l0"]["depth"], got["l0"]["parent"]) == (2, 3, 1, 1)
    assert (got["c1"]["lft"], got["c49999"]["depth"], got["l49999"]["depth"], got["l49999"]["above"]) == (4, n - 1, n, 1)


def test_repeated_spans_count_once_and_empty_tables_stay_empty(spark):
    rows = [("t", "r", "", 1, 2, 1, True, False), ("t", "c", "r", 5, 6, 1, False, True), ("t", "c", "r", 3, 6, 3, False, True), (None, "x", "", 1, 2, 1, True, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    for large in (tree.LARGE, 0):
        assert sorted((r["span_id"], r["lft"], r["rgt"]) for r in tree.number_spans(df, "a", large).collect()) == [("c", 2, 3), ("r", 1, 4)]
        assert tree.number_spans(df.limit(0), "a", large).count() == 0


def test_conditions_move_with_the_ids(spark):
    """Repeated spans count once with the conditions of any of their rows, in tasks and by joins; in tasks nothing is joined with the numbers."""
    rows = [r for r in forest(5) if r[2] != r[1]]
    rows += [(*r[:3], r[3] + 100, *r[4:6], not r[6], not r[7]) for r in rows[::3]] + [(None, "x", "", 1, 2, 1, True, True), ("t1", None, "", 1, 2, 1, True, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = df.where("a").groupBy("trace_id").agg(F.countDistinct("span_id").alias("marks"))
    flagged = df.where("b").select("trace_id", "span_id").distinct()
    for found, when in ((structure.descendant_spans, "above > 0"), (structure.not_descendant_spans, "marks - above - cast(marked as int) > 0")):
        want = tree.number_spans(df, "a").join(marks, "trace_id", "left").where(when).join(flagged, ["trace_id", "span_id"], "left_semi").select("trace_id", "span_id").collect()
        for large in (tree.LARGE, 0, 12):
            assert want and sorted(map(tuple, found(df, "a", "b", large).collect())) == sorted(map(tuple, want)), large
        plan = found(df, "a", "b")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 1


def test_a_task_holds_few_rows(spark):
    """Rows come out soon after they went in, so what Python holds does not follow the size of a partition; longer traces stay whole."""
    taken, most, ends = 0, 0, []

    def batches():
        nonlocal taken
        for i in range(60):
            traces = [f"t{(i * 2500 + k) // 10:06}" if i < 40 else "u" for k in range(2500)]
            taken += 2500
            yield pa.RecordBatch.from_pydict({"trace_id": traces, "span_id": [f"s{i}_{k}" for k in range(2500)], "parent_span_id": [""] * 2500, "mark": [False] * 2500})

    given_back = 0
    for out in tree._in_tasks(batches()):
        if out["trace_id"][0].as_py() != "u":
            most = max(most, taken - given_back)
        given_back += out.num_rows
        ends.append(max(out["rgt"].to_pylist()))
    assert given_back == 150_000 and ends[-1] == 2 * 50_000
    assert most <= 30_000


@pytest.mark.parametrize("large", [200_000, 2])
def test_tree_rows_move_with_the_ids(spark, large):
    """Repeated spans keep their rows; rows without an id count for the extent; no join follows the numbering of small traces."""
    rows = [("t", "a", "", 1, 5, 6), ("t", "b", "a", 2, 5, 7), ("t", "b", "a", 3, 9, 12), ("t", None, "", 4, 17, 21), (None, "z", "", 1, 1, 2)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, start_us long, dur_us long, end_us long")
    out = structure.tree_rows(df, large)
    assert sorted(map(tuple, out.collect())) == [("t", "a", 0.0, 25.0, 0), ("t", "b", 5.0, 25.0, 1), ("t", "b", 10.0, 45.0, 1)]
    if large > 2:
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange") == 1 and "Join" not in plan

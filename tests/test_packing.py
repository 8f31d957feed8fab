"""Spans are packed into nested rows where their orders and lines were joined: only lines and orders are shuffled."""

import datetime as dt

import pytest

from tracefold.operators import dealing
from tracefold.plans import ingest
from tracefold.sources import fixtures, nested

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(r[0] for r in df.drop("ok").selectExpr("to_json(struct(*))").collect())


@pytest.mark.parametrize("task_bytes", [dealing.TASK_BYTES, 50_000])
def test_packing_moves_no_span(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(dealing, "TASK_BYTES", task_bytes)
    found = plan(ingest.flat_traces(spark, SF))
    # an aggregate by service and app over spans of no known order moved every span, with its attributes, once more
    assert found.count("Exchange hashpartitioning") == 2 and "hashpartitioning(service" not in found


def test_no_span_was_moved_after_the_run(spark):
    df = ingest.flat_traces(spark, SF)
    assert len(df.collect()) == 184_964 and "isFinalPlan=true" in plan(df) and "hashpartitioning(service" not in plan(df)


def odd(spark, folder):
    """Orders without lines, with a line, of one key twice and of none; lines of no order and of no key."""
    at = dt.datetime(1996, 1, 2, 3, 4, 5)
    orders = [(k, k, s, 100.5, at, "1-URGENT") for k, s in ((1, "P"), (2, "O"), (3, "O"), (3, "F"), (5, "F"))] + [(None, 4, "P", 7.0, at, "2-HIGH")]
    lines = [(1, 1, "A", "F"), (1, 2, "R", "O"), (1, 2, "R", "O"), (3, 3, "N", "F"), (3, 7, "A", "O"), (4, 1, "A", "F"), (5, None, "A", None), (None, 1, "A", "F")]
    found = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string")
    numbers = [f"cast(l_linenumber * {i} as {kind}) as {c}" for i, (c, kind) in enumerate({"l_partkey": "long", "l_suppkey": "long", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"}.items(), 1)]
    found.selectExpr("*", *numbers, "timestamp_ntz'1996-01-02' as l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_both_forms_have_the_same_spans(spark, tmp_path):
    for d in (odd(spark, tmp_path), SF):
        want = rows(fixtures.spans(spark, d))
        assert len(want) > 20 and rows(fixtures.spans_by_order(spark, d)) == want


def test_both_forms_are_packed_alike(spark, tmp_path):
    d = odd(spark, tmp_path)
    want = nested.traces(fixtures.spans(spark, d)).selectExpr("resource", "transform(scope_spans, s -> struct(s.scope, array_sort(transform(s.spans, x -> x.span_id)))) as s")
    got = nested.traces(fixtures.spans_by_order(spark, d), "ok").selectExpr("resource", "transform(scope_spans, s -> struct(s.scope, array_sort(transform(s.spans, x -> x.span_id)))) as s")
    assert rows(got) == rows(want)

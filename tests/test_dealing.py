"""Shuffles of larger inputs get more tasks, with the same rows."""

import re

from pyspark.sql import functions as F

from tracefold.operators import dealing, structure, traces
from tracefold.sources import fixtures
from tracefold.streaming import generators

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def any_of(s):
    sent = s.where("kind = 'Producer'")
    return structure.any_structure(structure.child_spans(s.where("kind = 'Server'"), sent), structure.sibling_spans(sent, s.where("name = 'SELECT part'")))


def test_tasks_follow_the_input(spark, monkeypatch):
    few = plan(fixtures.spans(spark, SF))
    assert "REPARTITION_BY_NUM" not in few
    monkeypatch.setattr(dealing, "TASK_BYTES", dealing.input_bytes(fixtures.read(spark, SF, "lineitem")) // 20)
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, 2[01]\), REPARTITION_BY_NUM", plan(fixtures.spans(spark, SF)))


def test_dealt_queries_have_the_same_rows(spark, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.select("trace_id", "span_id").collect()))
    forms = (lambda s: traces.spans_of_matching(s, F.col("dur_us") > 400_000), any_of)
    before = [rows(f(fixtures.spans(spark, SF))) for f in forms]
    monkeypatch.setattr(dealing, "TASK_BYTES", 50_000)
    after = [f(fixtures.spans(spark, SF)) for f in forms]
    assert all("REPARTITION_BY_NUM" in plan(x) and len(b) > 0 for x, b in zip(after, before))
    assert [rows(x) for x in after] == before


def test_any_structure_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_BYTES", 50_000)
    assert re.search(r"hashpartitioning\(trace_id#\d+, span_id#\d+, \d+\), REPARTITION_BY_NUM", plan(any_of(fixtures.spans(spark, SF))))


def test_spans_of_matching_derives_the_spans_once(spark):
    x = spark.createDataFrame([("t", "a", 1), ("t", "b", 9), ("u", "c", 1), (None, "d", 9), ("v", "e", None)], "trace_id string, span_id string, dur_us long")
    found = traces.spans_of_matching(x, F.col("dur_us") > 5)
    assert found.columns == x.columns and sorted(r.span_id for r in found.collect()) == ["a", "b"]
    whole = traces.spans_of_matching(fixtures.spans(spark, SF), F.col("dur_us") > 400_000).select("trace_id", "span_id")
    assert whole._jdf.queryExecution().sparkPlan().toString().count("explode(") == 1


def test_bucket_numbers(spark):
    bounds = (0.5, 1.0, 2.5)
    x = spark.createDataFrame([(None,), (-1.0,), (0.5,), (0.6,), (1.0,), (2.5,), (2.6,), (float("nan"),)], "v double")
    assert [r.b for r in x.select(generators._bucket(F.col("v"), bounds).alias("b")).collect()] == [None, 0, 0, 1, 1, 2, None, None]

"""Sliding windows from panes against windows that are looked through sample by sample."""

import random

import numpy as np
import pytest

from tracefold.operators import metrics, panes

S = 1_000_000


def samples(seed):
    rnd = random.Random(seed)
    out = []
    for key in ("a", "b", None):
        at = sorted(rnd.sample(range(0, 4000), 120 if key == "a" else 25))
        value = 0.0
        for t in at:
            value = 0.0 if rnd.random() < 0.1 else value + rnd.randint(0, 9)
            out.append((key, t * S, value))
    return out


def looked_through(rows, start, end, step, window):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((t, v) for k, t, v in rows if k == key)
        for t in range(start, end + 1, step):
            at = [i for i, (x, _) in enumerate(mine) if t - window <= x <= t]
            if not at:
                continue
            i, j = at[0], at[-1]
            if i == j:
                i, j = (i - 1, j) if i else (i, j + 1)
            grown = None
            if j < len(mine):
                grown = max(0.0, mine[j][1] - mine[i][1] + sum(mine[k - 1][1] for k in range(i + 1, j + 1) if mine[k][1] < mine[k - 1][1]))
                span = (mine[j][0] - mine[i][0]) / S
            values = [mine[k][1] for k in at]
            slope = None
            if len(at) > 1:
                x = np.array([mine[k][0] / S for k in at])
                slope = float(np.polyfit(x - x.mean(), values, 1)[0])
            two = len(at) > 1
            last = mine[at[-1]], mine[at[-2]] if two else None
            out[key, t] = (
                len(at), grown, grown and grown / span * max(1.0, window / S / span), (last[0][1] - last[1][1]) / ((last[0][0] - last[1][0]) / S) if two else None, values[-1] - values[0] if two else None,
                slope, sum(values), min(values), max(values), values[-1],
            )
    return out


@pytest.mark.parametrize("start, end, step, window", [(500, 3500, 60, 300), (500, 3490, 70, 300), (900, 2000, 300, 60), (0, 5000, 1000, 1000), (1500, 1500, 60, 400), (600, 3000, 7, 50)])
def test_rates_are_those_of_each_window(spark, start, end, step, window):
    rows = samples(step)
    df = spark.createDataFrame(rows, "series string, ts_us long, value double").repartition(3)
    got = metrics.rates(df, start * S, end * S, step * S, window * S)
    columns = ["n", "increase", "rate", "irate", "delta", "deriv", "sum_over_time", "min_over_time", "max_over_time", "last_over_time"]
    found = {(r["series"], r["t"]): tuple(r[c] for c in columns) for r in got.collect()}
    want = looked_through(rows, start * S, end * S, step * S, window * S)
    assert found.keys() == want.keys()
    for k, v in want.items():
        for got_one, want_one in zip(found[k], v):
            assert (got_one is None) == (want_one is None) and (want_one is None or got_one == pytest.approx(want_one, rel=1e-7, abs=1e-9)), k
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2  # windows are made from panes, never from samples
    assert metrics.rates(df.limit(0), start * S, end * S, step * S, window * S).count() == 0


def test_any_merging_aggregate_slides(spark):
    rows = [("k", t * S, float(t % 7), t % 5) for t in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "k string, ts_us long, v double, w long")
    grid = panes.Grid(50 * S, 150 * S, 10 * S, 25 * S)
    got = {r["t"] // S: (r["total"], r["least"], r["most"]) for r in panes.slide(df, ["k"], grid, total=("sum", "w"), least=("min", "v"), most=("max", "v")).collect()}
    want = {}
    for t in range(50, 151, 10):
        at = [r for r in rows if (t - 25) * S <= r[1] <= t * S]
        want[t] = (sum(r[3] for r in at), min(r[2] for r in at), max(r[2] for r in at))
    assert got == want

"""Cases that the derived tables do not have: loops of parents, late servers, both ends of a call, unequal bounds."""

import pytest
from tracefold.operators import histograms, structure
from tracefold.streaming import generators

SPAN = "trace_id string, span_id string, parent_span_id string, kind string, service string, start_us long, dur_us long, status_code string, app_id string, attributes map<string,string>, resource map<string,string>"


def _span(span_id, parent, kind, service, at=0, trace="t", status="Ok", **attributes):
    return (trace, span_id, parent, kind, service, at, 10, status, "app", {k.replace("__", "."): v for k, v in attributes.items()}, {})


def _pairs(df):
    return {(r["ancestor"], r["descendant"]): r["distance"] for r in df.collect()}


def test_closure_of_loops_ends(spark):
    rows = [_span("own", "own", "Internal", "a"), _span("below", "own", "Internal", "a"), _span("x", "y", "Internal", "a"), _span("y", "x", "Internal", "a"), _span("z", "y", "Internal", "a")]
    got = _pairs(structure.closure(spark.createDataFrame(rows, SPAN)))
    assert got == {("own", "below"): 1, ("y", "x"): 1, ("x", "y"): 1, ("y", "z"): 1, ("x", "z"): 2}


def test_closure_of_a_chain_and_of_chosen_spans(spark):
    chain = spark.createDataFrame([_span(f"s{i}", f"s{i - 1}" if i else "", "Internal", "a") for i in range(21)], SPAN)
    assert _pairs(structure.closure(chain)) == {(f"s{i}", f"s{j}"): j - i for j in range(21) for i in range(j)}
    assert _pairs(structure.closure(chain, chain.where("span_id = 's20'"))) == {(f"s{i}", "s20"): 20 - i for i in range(20)}


@pytest.fixture(scope="module")
def peers(spark):
    rows = [
        _span("root", "", "Server", "front"),
        _span("c1", "root", "Client", "front", 100),
        _span("far", "c1", "Server", "late", 60_000_000),
        _span("near", "c1", "Server", "back", 1_000_000, status="Error"),
        _span("c2", "root", "Client", "front", 100),
        _span("alone", "gone", "Server", "back", 100),
        _span("db", "near", "Client", "back", 100, db__name="orders", db__system="mysql"),
        _span("p", "near", "Producer", "back", 100, messaging__system="kafka", messaging__destination__name="jobs", server__address="broker", server__port="9092", messaging__message__body__size="7"),
        _span("q", "near", "Consumer", "work", 100, messaging__destination="jobs"),
        _span("r", "near", "Consumer", "work", 100, messaging__system="kafka"),
        _span("i", "near", "Internal", "back", 100),
    ]
    return generators.pair_peers(generators.edge_columns(spark.createDataFrame(rows, SPAN))).cache()


def test_peers(peers):
    assert {r["span_id"]: (r["peer"], r["peer_source"]) for r in peers.collect()} == {
        "root": (None, None), "c1": ("back", "paired"), "near": ("front", "paired"), "far": (None, "expired"), "c2": (None, "expired"), "alone": (None, "expired"),
        "db": ("orders", "db_attribute"), "p": ("kafka/broker:9092/jobs", "messaging_attribute"), "q": ("jobs", "messaging_attribute"), "r": (None, None), "i": (None, None),
    }


def test_both_ends_of_a_call_are_one_request(peers):
    got = {(r["client"], r["server"], r["connection"]): (r["requests"], r["failed"], r["client_us"], r["server_us"], r["message_us"], r["message_bytes"]) for r in generators.service_graph(generators.edges(peers), 10**12).collect()}
    assert got == {
        ("front", "back", "unset"): (1, 1, 10, 10, 0, 0),
        ("back", "orders", "database"): (0, 0, 10, 0, 0, 0),
        ("back", "kafka/broker:9092/jobs", "messaging_system"): (1, 0, 0, 0, 10, 7),
        ("jobs", "work", "unset"): (1, 0, 0, 10, 0, 0),
    }


def test_unequal_bounds_and_the_quantile_of_zero(spark):
    rows = [("k", [1, 1, 1], [5.0, 10.0], 30.0, 3), ("k", [0, 1, 1, 1], [5.0, 10.0, 25.0], 40.0, 3), ("e", [0, 2, 0], [5.0, 10.0], 14.0, 2)]
    points = spark.createDataFrame(rows, "key string, bucket_counts array<long>, explicit_bounds array<double>, value double, count long")
    got = {r["key"]: (r["bucket_counts"], r["explicit_bounds"]) for r in histograms.merge(points, "key").collect()}
    assert got["k"] == ([1, 2, 2, 1], [5.0, 10.0, 25.0])
    assert {r["key"]: r["value"] for r in histograms.quantile(points, 0.0, "key").collect()} == {"k": 0.0, "e": 0.0}
    assert {r["key"]: r["value"] for r in histograms.quantile(points, 0.5, "key").collect()} == {"k": 10.0, "e": 7.5}

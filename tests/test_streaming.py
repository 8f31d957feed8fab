"""Stream forms give what the batch forms give; sinks can be rerun."""

import os

import pytest
from pyspark.sql import functions as F

from tracefold.sources import fixtures, sinks
from tracefold.streaming import generators, state

SF = "/root/testdata/sf0.001"


def test_red_metrics_stream_equals_batch(spark, tmp_path):
    batch = fixtures.spans(spark, SF).where("trace_id in ('t1', 't2', 't3', 't4')")
    late = batch.limit(1).withColumn("start_us", F.lit(4_000_000_000_000_000)).withColumn("service", F.lit("late"))
    batch.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sinks.read_stream(spark, str(tmp_path / "in"), batch.schema)
    out = generators.red_metrics_stream(stream)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    keys = ["app_id", "service", "name", "kind", "status_code", "t", "calls", "latency_us"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*keys).collect())
    assert got == sorted(tuple(r) for r in generators.red_metrics(batch).select(*keys).collect())


def test_rollup_sink_can_be_rerun(spark, tmp_path):
    rows = fixtures.gauges(spark, SF).select("app_id", "ts_us", "value", F.lit("5m").alias("tier")).where("app_id = 'app-1'").limit(50)
    rows = rows.cache()
    for _ in range(2):
        sinks.write_rollup(rows, str(tmp_path / "rollup"))
    assert spark.read.parquet(str(tmp_path / "rollup")).count() == 50


def test_relational_table_round_trip(spark, tmp_path):
    rows = fixtures.logs(spark, SF).where("log_id < 300").select("log_id", "ts_us", "severity", "attributes")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    sinks.write_table(rows, url, "logs", 2, driver="org.apache.derby.jdbc.EmbeddedDriver")
    got = sinks.read_table(spark, url, "logs", "log_id", 0, 300, 3, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 3
    want = rows.withColumn("attributes", F.to_json("attributes"))
    key = ["log_id", "ts_us", "severity", "attributes"]
    assert sorted(map(tuple, got.toDF(*[c.lower() for c in got.columns]).select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_signal_folders_prune_by_day(spark, tmp_path):
    rows = fixtures.gauges(spark, SF).select("app_id", "ts_us", "value")
    sinks.write_signal(rows, str(tmp_path / "g"), "ts_us")
    day = spark.read.parquet(str(tmp_path / "g")).where("app_id = 'app-1' and day = date'2024-01-05'")
    assert {f.split("/day=")[1].split("/")[0] for f in day.inputFiles()} >= {"2024-01-05"}
    assert "PartitionFilters: [isnotnull(app_id" in day._jdf.queryExecution().toString()
    assert day.count() == rows.where("app_id = 'app-1' and to_date(timestamp_micros(ts_us)) = date'2024-01-05'").count() > 0


SPAN = "trace_id string, span_id string, parent_span_id string, kind string, service string, start_us long, dur_us long, status_code string, app_id string, name string, attributes map<string,string>, resource map<string,string>"


def _span(span_id, parent, kind, service, at_ms, trace="t", **attributes):
    return (trace, span_id, parent, kind, service, (at_ms + 1000) * 1000, 10, "Ok", "app", "n", {k.replace("__", "."): v for k, v in attributes.items()}, {})


def _run(spark, out, folder, mode="append"):
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode(mode).trigger(availableNow=True).start().awaitTermination(180)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _files(spark, folder, *batches):
    """A stream that reads one batch of spans after the other."""
    schema = spark.createDataFrame([], SPAN).schema
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SPAN).coalesce(1).write.parquet(f"{folder}/b{i}")
        part = next((folder / f"b{i}").glob("*.parquet"))
        (folder / "in").mkdir(exist_ok=True)
        part.rename(folder / "in" / f"{i}.parquet")
        os.utime(folder / "in" / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


KINDS = [
    [
        _span("c1", "r", "Client", "front", 0), _span("r", "", "Server", "front", 0), _span("db", "r", "Client", "front", 1, db__system="mysql", db__name="orders"), _span("named", "r", "Client", "front", 2, db__name="orders"),
        _span("p", "r", "Producer", "front", 3, messaging__system="kafka", messaging__destination__name="jobs"), _span("i", "r", "Internal", "front", 4), _span("m", "r", "Client", "front", 5, messaging__system="rabbit"), _span("q", "", "Consumer", "work", 5),
    ],
    [_span("s1", "c1", "Server", "back", 50), _span("s2", "named", "Server", "cache", 60), _span("s3", "m", "Server", "broker", 70), _span("lone", "gone", "Server", "back", 80), _span("c2", "r", "Client", "front", 90)],
    # a second server under c1 waits alone; two clients of one id: the older expires; a server that comes ten seconds late
    [_span("s4", "c1", "Server", "back", 100), _span("c3", "r", "Client", "front", 110), _span("c3", "r", "Client", "other", 120), _span("s5", "c3", "Server", "back", 130), _span("s6", "c2", "Server", "back", 10_090)],
    [_span("x", "", "Internal", "late", 40_000)],
    [_span("y", "", "Internal", "late", 80_000)],
]


def test_stream_pairs_every_kind_as_the_batch_does(spark, rocks, tmp_path):
    got = _run(spark, state.pair_peers_stream(_files(spark, tmp_path, *KINDS), stores=2), tmp_path)
    batch = generators.pair_peers(spark.createDataFrame([r for b in KINDS for r in b], SPAN))
    key = ["span_id", "service", "peer", "peer_source"]
    rows = {(r[0], r[1]): r[2:] for r in map(tuple, got.select(*key).collect())}
    assert rows == {(r[0], r[1]): r[2:] for r in map(tuple, batch.select(*key).collect())}
    assert got.count() == batch.count()
    assert rows["c1", "front"] == ("back", "paired") and rows["s4", "back"] == (None, "expired") and rows["m", "front"] == (None, None) and rows["s3", "broker"] == ("front", "paired")
    assert rows["named", "front"] == ("cache", "paired") and rows["c3", "front"] == (None, "expired") and rows["c3", "other"] == ("back", "paired") and rows["s6", "back"] == rows["c2", "front"] == (None, "expired")


def test_a_full_store_lets_the_oldest_go(spark, rocks, tmp_path):
    batches = [[_span("c1", "r", "Client", "a", 0)], [_span("c2", "r", "Client", "a", 10)], [_span("c3", "r", "Client", "a", 20)], [_span("s1", "c1", "Server", "b", 30), _span("s3", "c3", "Server", "b", 31)], [_span("x", "", "Internal", "late", 60_000)], [_span("y", "", "Internal", "late", 90_000)]]
    got = {r["span_id"]: r["peer_source"] for r in _run(spark, state.pair_peers_stream(_files(spark, tmp_path, *batches), most=2, stores=1), tmp_path).collect()}
    assert got["c1"] == "expired" and got["s1"] == "expired" and got["c3"] == got["s3"] == "paired" and got["c2"] == "expired"


def test_service_graph_stream_equals_batch(spark, tmp_path):
    spans = fixtures.spans(spark, SF).where("trace_id in ('t1', 't2', 't3', 't4', 't5', 't6', 't7')")
    # one late span of each kind, so that every branch's watermark passes
    late = spans.where("trace_id = 't1' and kind in ('Client', 'Server')").selectExpr("* except (start_us, trace_id)", "4000000000000000L as start_us", "concat('late', span_id) as trace_id").select(*spans.columns)
    spans.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = _run(spark, generators.service_graph_stream(sinks.read_stream(spark, str(tmp_path / "in"), spans.schema)), tmp_path)
    want = generators.service_graph(generators.edges(generators.pair_peers(generators.edge_columns(spans))))
    rows = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)
    assert rows(got) == rows(want) and got.count() > 10


def test_series_are_admitted_dropped_and_forgotten(spark, rocks, tmp_path):
    """2,001 series in the first window, then idle windows after which one comes back and a new one finds room."""
    minute = 60_000
    first = [(*_span(f"s{i}", "", "Server", f"svc{i:04d}", 0)[:9], "n", {}, {}) for i in range(2001)]
    batches = [first, [_span("a", "", "Server", "svc0001", minute // 4)], [_span("b", "", "Server", "svc0001", 3 * minute), _span("c", "", "Server", "zzz", 3 * minute)], [_span("d", "", "Server", "svc0002", 3 * minute + 15_000)], [_span("x", "", "Server", "end", 60 * minute)], [_span("y", "", "Server", "end", 120 * minute)]]
    deltas = generators.red_metrics_stream(_files(spark, tmp_path, *batches), late="1 second")
    got = _run(spark, state.cumulative_red_stream(deltas), tmp_path).where("service <> 'end'")
    rows = {(r["service"], r["t"] // 1_000_000): (r["calls"], r["dropped"]) for r in got.collect()}
    assert sum(t == 0 for _, t in rows) == 2000 and ("svc2000", 0) not in rows
    assert rows["svc0001", 15] == (2, 1) and rows["svc0001", 180] == (1, 1) and rows["zzz", 180] == (1, 1) and rows["svc0002", 195] == (1, 1)
    deltas = generators.red_metrics(spark.createDataFrame([r for b in batches[:4] for r in b], SPAN)).where("service <> 'svc2000'")
    batch = generators.cumulative(deltas, ["app_id", "service", "name", "kind", "status_code"], "calls", cycles=5, chunk_us=60_000_000)
    assert {(r["service"], r["t"] // 1_000_000): r["calls"] for r in batch.collect()} == {k: v[0] for k, v in rows.items()}


def test_red_stream_takes_dimensions(spark, tmp_path):
    rows = [_span("a", "", "Server", "s", 0, http__method="GET"), _span("b", "", "Server", "s", 1, http__method=""), _span("c", "", "Server", "s", 2, http__method="GET"), _span("x", "", "Server", "s", 900_000)]
    out = generators.red_metrics_stream(_files(spark, tmp_path, rows[:3], rows[3:], [_span("y", "", "Server", "s", 1_800_000)]), dimensions=generators.RED_DIMENSIONS)
    got = {r["http_method"]: r["calls"] for r in _run(spark, out, tmp_path).where("t = 0").collect()}
    assert got == {"GET": 2, None: 1} == {r["http_method"]: r["calls"] for r in generators.red_metrics(spark.createDataFrame(rows[:3], SPAN), dimensions=generators.RED_DIMENSIONS).collect()}

"""Metrics from spans, service graphs, peers and token enrichment. The same functions take batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.running import running

#: Upper bounds of the default histograms, span latency in ms, service-graph latency in seconds, message size in bytes.
RED_LATENCY_BOUNDS_MS = (2.0, 4.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0, 40.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 400.0, 500.0, 750.0, 1000.0, 1500.0, 2000.0, 3000.0, 4000.0, 5000.0, 7500.0, 10000.0)
GRAPH_LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
GRAPH_SIZE_BOUNDS = (128.0, 256.0, 512.0, 1024.0, 2048.0, 4096.0, 8192.0, 16384.0, 32768.0, 65536.0, 131072.0)
#: Dimensions of span metrics besides service, name, kind and status.
RED_DIMENSIONS = ("http.method", "http.status_code", "http.route", "rpc.method", "rpc.service", "peer.service")
FLUSH_US = 15_000_000
#: Running totals are added up within days first.
CHUNK_US = 86_400_000_000


def _window(step_us: int) -> Column:
    return (F.floor(F.col("start_us") / step_us) * step_us).alias("t")


def _bucket_counts(value: Column, bounds: tuple[float, ...]) -> Column:
    """A value counts in the first bound not below it; above the last bound it is in sum and count only."""
    edges = (float("-inf"), *bounds)
    return F.array(*[F.count(F.when((value > lo) & (value <= hi), 1)) for lo, hi in zip(edges, bounds)])


def _bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """The number of a value's bucket: the first bound not below it; null above the last one."""
    return F.coalesce(*[F.when(value <= b, i) for i, b in enumerate(bounds)])


def _dimensions(dimensions: tuple[str, ...]) -> list[Column]:
    """A span's attribute, else its resource's; empty ones count as missing."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return [F.coalesce(filled(F.col("attributes")[d]), filled(F.col("resource")[d])).alias(d.replace(".", "_")) for d in dimensions]


def _red_values(bounds: tuple[float, ...]) -> list[Column]:
    return [F.count(F.lit(1)).alias("calls"), F.sum("dur_us").alias("latency_us"), _bucket_counts(F.col("dur_us") / 1000, bounds).alias("bucket_counts")]


def red_metrics(spans: DataFrame, step_us: int = FLUSH_US, bounds: tuple[float, ...] = RED_LATENCY_BOUNDS_MS, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """Calls and latency histogram per app, service, name, kind, status and extra attributes, in windows (deltas)."""
    return spans.groupBy("app_id", "service", "name", "kind", "status_code", *_dimensions(dimensions), _window(step_us)).agg(*_red_values(bounds))


def red_metrics_stream(spans: DataFrame, step: str = "15 seconds", late: str = "1 minute", bounds: tuple[float, ...] = RED_LATENCY_BOUNDS_MS, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """The streaming form: event-time windows that close once the watermark has passed them; ``ts`` is the window's end."""
    x = spans.withColumn("ts", F.timestamp_micros("start_us")).withWatermark("ts", late)
    extra = [d.replace(".", "_") for d in dimensions]
    g = x.groupBy(F.window("ts", step).alias("w"), "app_id", "service", "name", "kind", "status_code", *_dimensions(dimensions)).agg(*_red_values(bounds))
    return g.select("app_id", "service", "name", "kind", "status_code", *extra, F.unix_micros("w.start").alias("t"), "calls", "latency_us", "bucket_counts", F.window_time("w").alias("ts"))


def edge_columns(spans: DataFrame) -> DataFrame:
    """``spans`` with ``connection`` and ``message_size``, so that attribute maps need not move when peers are found."""
    a, resource = F.col("attributes"), F.col("resource")
    filled = lambda c: F.nullif(c, F.lit(""))
    database = F.coalesce(*[filled(a[k]) for k in ("db.system", "db.name", "db.redis.database_index")], filled(resource["db.system"]))
    connection = F.when(filled(a["messaging.system"]).isNotNull(), "messaging_system").when(database.isNotNull(), "database").otherwise(F.coalesce(filled(a["rpc.system"]), F.lit("unset")))
    return spans.withColumn("connection", connection).withColumn("message_size", a["messaging.message.body.size"].try_cast("bigint"))


def edges(paired: DataFrame, peer: Column | None = None) -> DataFrame:
    """Service-graph edges of spans with ``edge_columns`` that have a peer: client and server by kind."""
    kind = F.col("kind")
    other = F.nullif(F.col("peer") if peer is None else peer, F.lit(""))
    x = paired.withColumn("other", other).where(kind.isin("Client", "Producer", "Server", "Consumer") & F.col("other").isNotNull() & (F.col("service") != ""))
    outgoing = kind.isin("Client", "Producer")
    return x.withColumn("client", F.when(outgoing, F.col("service")).otherwise(F.col("other"))).withColumn("server", F.when(outgoing, F.col("other")).otherwise(F.col("service"))).drop("other")


def _graph_buckets(rows: DataFrame, latency: tuple[float, ...], sizes: tuple[float, ...]) -> DataFrame:
    """``rows`` with the numbers of the buckets of their time and their size, worked out once a row, so that a group only counts equal numbers."""
    return rows.withColumn("__at", _bucket(F.col("dur_us") / 1e6, latency)).withColumn("__size_at", _bucket(F.col("message_size").cast("double"), sizes))


def _graph_values(latency: tuple[float, ...], sizes: tuple[float, ...]) -> list[Column]:
    """Of rows with ``_graph_buckets``. A call is seen from both ends: the server's end counts the request, the client's gives its time only. Producers count, because the
    way to the broker and the way from it are edges of their own; times of messaging spans are kept apart."""
    kind, us, size = F.col("kind"), F.col("dur_us"), F.col("message_size")
    counts = kind.isin("Server", "Consumer", "Producer")
    message = (kind == "Producer") | (counts & (F.col("connection") == "messaging_system"))
    filled = lambda at, when, bounds: F.array(*[F.count_if(when & (F.col(at) == i)) for i in range(len(bounds))])
    out = [F.count_if(counts).alias("requests"), F.count_if(counts & (F.col("status_code") == "Error")).alias("failed")]
    for name, when in (("client", kind == "Client"), ("server", counts & ~message), ("message", message)):
        value = F.when(when, us)
        out += [F.coalesce(F.sum(value), F.lit(0)).alias(f"{name}_us"), F.count(value).alias(f"{name}_n"), filled("__at", when, latency).alias(f"{name}_buckets")]
    size = F.when(counts, size)
    return [*out, F.coalesce(F.sum(size), F.lit(0)).alias("message_bytes"), F.count(size).alias("size_n"), filled("__size_at", counts, sizes).alias("size_buckets")]


def service_graph(edge_rows: DataFrame, step_us: int = FLUSH_US, latency: tuple[float, ...] = GRAPH_LATENCY_BOUNDS, sizes: tuple[float, ...] = GRAPH_SIZE_BOUNDS) -> DataFrame:
    """Requests, failures and the histograms (sum, count, buckets) of client, server and message seconds and of message sizes, per app, edge and window."""
    return _graph_buckets(edge_rows, latency, sizes).groupBy("app_id", "client", "server", "connection", _window(step_us)).agg(*_graph_values(latency, sizes))


def service_graph_stream(spans: DataFrame, step: str = "15 seconds", late: str = "1 minute", within: str = "10 seconds") -> DataFrame:
    """The streaming form: clients and servers meet in stream joins bounded in time, whose rows are counted in windows that close by the watermark.

    Either end of a call keeps its own time, so each is joined with the other's names on its own; spans with a peer of their own need no join. Every
    client is taken to have one server and every server one client, as in the spans of one call.
    """
    x = edge_columns(spans).withColumn("ts", F.timestamp_micros("start_us")).withWatermark("ts", late)
    columns = ["ts", "app_id", "kind", "service", "status_code", "dur_us", "connection", "message_size"]
    own = x.where(~_waits()).withColumn("peer", F.coalesce(*_own_peer()[:1])).select(*columns, "peer")
    client = x.where(_waits() & (F.col("kind") == "Client"))
    server = x.where(_waits() & (F.col("kind") == "Server"))
    near = f"o_trace = trace_id and o_span = id and o_ts between ts - interval {within} and ts + interval {within} and abs(unix_micros(o_ts) - unix_micros(ts)) < unix_micros(timestamp_seconds(0) + interval {within})"
    names = lambda df, span: df.select(F.col("trace_id").alias("o_trace"), F.col(span).alias("o_span"), F.col("ts").alias("o_ts"), F.col("service").alias("peer"))
    as_client = client.where(F.col("attributes")["messaging.system"].isNull()).withColumn("id", F.col("span_id")).join(names(server, "parent_span_id"), F.expr(near)).select(*columns, "peer")
    as_server = server.withColumn("id", F.col("parent_span_id")).join(names(client, "span_id"), F.expr(near)).select(*columns, "peer")
    rows = edges(own.unionByName(as_client).unionByName(as_server))
    g = _graph_buckets(rows, GRAPH_LATENCY_BOUNDS, GRAPH_SIZE_BOUNDS).groupBy(F.window("ts", step).alias("w"), "app_id", "client", "server", "connection").agg(*_graph_values(GRAPH_LATENCY_BOUNDS, GRAPH_SIZE_BOUNDS))
    return g.withColumn("t", F.unix_micros("w.start")).drop("w")


def cumulative(deltas: DataFrame, keys: list[str], *values: str, cycles: int | None = None, step_us: int = FLUSH_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """Running totals of windowed deltas; with ``cycles``, a series without data for more windows than that starts again from nothing.

    Totals run within days of a series and then over its days, so no task orders a whole series.
    """
    x = deltas.select(*keys, "t", *values)
    if cycles is not None:
        # the first row of each day needs the last one of an earlier day
        w = W.partitionBy(*keys, F.floor(F.col("t") / chunk_us)).orderBy("t")
        ends = x.groupBy(*keys, F.floor(F.col("t") / chunk_us).alias("__day")).agg(F.min("t").alias("__first"), F.max("t").alias("__last"))
        ends = ends.withColumn("__previous", F.lag("__last").over(W.partitionBy(*keys).orderBy("__day"))).select(*(F.col(k).alias(f"__key_{k}") for k in keys), "__first", "__previous")
        on = F.col("t") == F.col("__first")
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        x = x.join(ends, on, "left").withColumn("__since", F.coalesce("__previous", F.lag("t").over(w))).withColumn("__life", F.when(F.col("t") - F.col("__since") <= cycles * step_us, 0).otherwise(1).cast("long")).select(*keys, "t", *values, "__life")
        x = running(x, keys, "t", chunk_us, sums=("__life",))
        return running(x, [*keys, "__life"], "t", chunk_us, sums=values).select(*keys, "t", *values)
    return running(x, keys, "t", chunk_us, sums=values)


def evict_stale(deltas: DataFrame, keys: list[str], now_us: int, cycles: int = 5, step_us: int = FLUSH_US) -> DataFrame:
    """Series seen within the last ``cycles`` windows."""
    last = deltas.groupBy(*keys).agg(F.max("t").alias("last")).where(F.col("last") >= now_us - cycles * step_us)
    return deltas.join(last, keys, "left_semi")


def limit_series(deltas: DataFrame, keys: list[str], most: int = 2000) -> DataFrame:
    """The first ``most`` series by first window; later ones go. The list of admitted series has ``most`` rows at most."""
    first = deltas.groupBy(*keys).agg(F.min("t").alias("first")).orderBy("first", *keys).limit(most)
    return deltas.join(F.broadcast(first.select(*keys)), keys, "left_semi") if most <= 10_000 else deltas.join(first.select(*keys), keys, "left_semi")


def database_peer() -> Column:
    """The peer of a database span, which has db.system or db.type: the first filled key in order of priority."""
    keys = ("db.name", "db.instance", "db.system", "db.type", "server.address")
    named = F.coalesce(*[F.nullif(F.col("attributes")[k], F.lit("")) for k in keys])
    is_db = F.col("attributes")["db.system"].isNotNull() | F.col("attributes")["db.type"].isNotNull()
    return F.when(is_db, F.coalesce(named, F.lit("unknown")))


def messaging_peer() -> Column:
    """[system/][address[:port]/]destination; null without a destination."""
    first = lambda *keys: F.coalesce(*[F.nullif(F.col("attributes")[k], F.lit("")) for k in keys])
    destination = first("messaging.destination.name", "messaging.destination")
    address, port = first("server.address", "net.peer.name", "network.peer.address"), first("server.port")
    address = F.when(port.try_cast("int") > 0, F.concat(address, F.lit(":"), port)).otherwise(address)
    return F.when(destination.isNotNull(), F.concat_ws("/", first("messaging.system"), address, destination))


def _child() -> Column:
    return F.coalesce(F.col("parent_span_id"), F.lit("")) != ""


def _waits() -> Column:
    """Spans that wait for their other end: clients other than of databases, servers with a parent."""
    kind = F.col("kind")
    return F.coalesce(((kind == "Client") & database_peer().isNull()) | ((kind == "Server") & _child()), F.lit(False))


def _own_peer() -> tuple[Column, Column]:
    """Peer and its source of spans that do not wait."""
    kind = F.col("kind")
    message = F.when((kind == "Producer") | ((kind == "Consumer") & _child()), messaging_peer())
    database = F.when(kind == "Client", database_peer())
    return F.coalesce(database, message), F.when(database.isNotNull(), "db_attribute").when(message.isNotNull(), "messaging_attribute")


def pair_peers(spans: DataFrame, within_us: int = 10_000_000) -> DataFrame:
    """``spans`` with ``peer`` and ``peer_source``; every span stays.

    Database clients and messaging spans take their peer from their attributes. Another client waits for the server that names it as parent, in the same
    trace and within the time, and that server for it; what waits for nothing is ``expired``. A paired client of a messaging system gets no peer.
    Where several spans wait under one id, in order of start: a span of the other kind pairs with the one that waits, one of the same kind takes its
    place. So spans pair with the next one, from the first of each row of spans that could, two by two. Root servers and consumers and internal spans pass.

    Only waiting spans are shuffled, once, by trace and id, with the columns that are used later.
    """
    by = W.partitionBy("trace_id", "__id").orderBy("start_us", "span_id")
    mine = [*spans.columns, "peer", "peer_source"]
    kind = F.col("kind")
    peer, source = _own_peer()
    passing = spans.where(~_waits()).withColumn("__peer", peer).withColumn("peer_source", source).withColumn("peer", F.col("__peer")).select(*mine)
    x = spans.where(_waits()).withColumn("__id", F.when(kind == "Client", F.col("span_id")).otherwise(F.col("parent_span_id")))
    x = x.withColumn("__message", (kind == "Client") & F.col("attributes")["messaging.system"].isNotNull())
    upto = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    fits = (F.lag("kind").over(by) != kind) & (F.col("start_us") - F.lag("start_us").over(by) < within_us)
    # everything is seen in one order: where the row of spans began, and so whether a span is second in its pair
    x = x.withColumn("__fits", F.coalesce(fits, F.lit(False))).withColumn("__n", F.row_number().over(by))
    second = (F.col("__n") - F.max(F.when(~F.col("__fits"), F.col("__n"))).over(upto)) % 2 == 1
    met = second | F.coalesce(F.lead("__fits").over(by), F.lit(False))
    x = x.withColumn("__other", F.when(second, F.lag("service").over(by)).otherwise(F.lead("service").over(by))).withColumn("__met", met)
    met = F.col("__met")
    x = x.withColumn("peer", F.when(met & ~F.col("__message"), F.col("__other"))).withColumn("peer_source", F.when(~met, "expired").when(~F.col("__message"), "paired"))
    return passing.unionByName(x.select(*mine))


def enrich_by_token(rows: DataFrame, tokens: DataFrame, token: str = "token", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Adds the app of a token, drops rows of unknown tokens and the token itself. The token table is broadcast if it is small."""
    small = tokens.isStreaming is False and tokens.count() * 200 <= broadcast_bytes
    return rows.join(F.broadcast(tokens) if small else tokens, token).drop(token)

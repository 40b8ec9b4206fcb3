"""Usage facts, histories, rate limits, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.catalogue.registry import ORACLES, query, r6
from corvane.operators import usage
from corvane.session import shared_folder, table
from corvane.streaming import usage as streams


def calls(spark, sf_dir):
    """Clicks stand for chat calls, views for embedding calls, other events for cached chat calls."""
    kind = F.when(F.col("event_type") == "view", "embed").otherwise("chat")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", kind.alias("kind"), F.round("value", 4).alias("tokens"), (~F.col("event_type").isin("view", "click")).alias("cached"))


_CALLS = "c AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'view' THEN 'embed' ELSE 'chat' END AS kind, round(value, 4) AS tokens, event_type NOT IN ('view', 'click') AS cached FROM events)"
_SNAP = """CAST(count(*) FILTER (WHERE kind = 'chat') AS BIGINT) AS chat_calls, CAST(count(*) FILTER (WHERE kind = 'embed') AS BIGINT) AS embed_calls, CAST(count(*) FILTER (WHERE cached) AS BIGINT) AS cache_hits,
 coalesce(sum(tokens) FILTER (WHERE kind = 'chat' AND NOT cached), 0e0) AS chat_tokens, coalesce(sum(tokens) FILTER (WHERE kind = 'embed' AND NOT cached), 0e0) AS embed_tokens, coalesce(sum(tokens) FILTER (WHERE NOT cached), 0e0) AS all_tokens"""
_COUNTS, _SUMS = ("chat_calls", "embed_calls", "cache_hits"), ("chat_tokens", "embed_tokens", "all_tokens")
_ROUNDED = ", ".join([*_COUNTS, *[f"round({c}, 4) AS {c}" for c in _SUMS]])


def rounded(df, *keys):
    return df.select(*keys, *_COUNTS, *[F.round(c, 4).alias(c) for c in _SUMS])


@query("usage_snapshot", f"WITH {_CALLS}, s AS (SELECT user_id, {_SNAP} FROM c GROUP BY 1) SELECT user_id, {_ROUNDED} FROM s")
def usage_snapshot(spark, sf_dir):
    return rounded(usage.snapshot(calls(spark, sf_dir), "user_id"), "user_id")


@query(
    "usage_delta",
    f"""WITH {_CALLS}, x AS (SELECT user_id, {_SNAP} FROM c WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), y AS (SELECT user_id, {_SNAP} FROM c GROUP BY 1),
      d AS (SELECT user_id, {", ".join(f"coalesce(y.{f}, 0) - coalesce(x.{f}, 0) AS {f}" for f in (*_COUNTS, *_SUMS))} FROM y FULL JOIN x USING (user_id))
    SELECT user_id, {_ROUNDED} FROM d""",
)
def usage_delta(spark, sf_dir):
    c = calls(spark, sf_dir)
    before = usage.snapshot(c.filter("ts < timestamp_ntz '2024-01-16'"), "user_id")
    return rounded(usage.delta(before, usage.snapshot(c, "user_id"), "user_id", *_COUNTS, *_SUMS), "user_id")


@query(
    "usage_full_outer",
    """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 40 GROUP BY 1)
    SELECT user_id, CAST(coalesce(a.n, 0) AS BIGINT) AS views, CAST(coalesce(b.n, 0) AS BIGINT) AS purchases FROM a FULL JOIN b USING (user_id)""",
)
def usage_full_outer(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("views"))
    b = e.filter("event_type = 'purchase' and value > 40").groupBy("user_id").agg(F.count("*").alias("purchases"))
    return a.join(b, ["user_id"], "full_outer").select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("views", "purchases")])


@query(
    "comparison_table",
    f"""WITH {_CALLS}, s AS (SELECT kind, {_SNAP}, date_diff('second', min(ts), max(ts)) AS wall_s FROM c GROUP BY 1) SELECT kind, {_ROUNDED}, CAST(wall_s AS BIGINT) AS wall_s FROM s""",
)
def comparison_table(spark, sf_dir):
    c = calls(spark, sf_dir)
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    wall = c.groupBy("kind").agg((F.max(s) - F.min(s)).alias("wall_s"))
    return rounded(usage.snapshot(c, "kind"), "kind").join(wall, ["kind"])


@query(
    "history_window",
    "SELECT conv_id, turn, CAST(len(h) AS INTEGER) AS n, md5(coalesce(array_to_string(h, chr(10)), '')) AS history FROM (SELECT conv_id, turn, coalesce(list(role || ': ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)",
)
def history_window(spark, sf_dir):
    h = usage.history(table(spark, sf_dir, "conversations"))
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return h.select("conv_id", "turn", F.size("history").alias("n"), F.md5(F.array_join(lines, "\n")).alias("history"))


@query(
    "context_query",
    "SELECT conv_id, turn, md5(CASE WHEN lag(text) OVER w IS NULL THEN text ELSE lag(text) OVER w || ' ' || text END) AS query FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def context_query(spark, sf_dir):
    """The rewritten question where there is a history (here: the last message in front), else the raw one."""
    h = usage.history(table(spark, sf_dir, "conversations"))
    said = F.concat(F.element_at("history", -1)["text"], F.lit(" "), F.col("text"))
    return h.select("conv_id", "turn", F.md5(F.when(F.size("history") > 0, said).otherwise(F.col("text"))).alias("query"))


@query("session_listing", "SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY 1 ORDER BY conv_id DESC")
def session_listing(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return s.orderBy(F.col("conv_id").desc())


@query("sliding_rate", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events")
def sliding_rate(spark, sf_dir):
    return usage.sliding_count(table(spark, sf_dir, "events"), 3600).select("event_id", "n")


@query(
    "rate_admission",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
    SELECT user_id, event_id, round(max(t - 36000e0 * (i // 2)) OVER (PARTITION BY user_id, i % 2 ORDER BY i ROWS UNBOUNDED PRECEDING) + 36000e0 * (i // 2) - t, 3) AS wait FROM e""",
)
def rate_admission(spark, sf_dir):
    """Two calls in ten hours, so that the sparse events wait."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", at)
    return usage.admissions(e, 2, 36000.0).select("user_id", "event_id", F.round(F.col("admitted") - F.col("at"), 3).alias("wait"))


def stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(
    "stream_usage",
    "SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def stream_usage(spark, sf_dir):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    streams.run_complete(streams.windowed_usage(stream(spark, sf_dir)), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_admission", ORACLES["rate_admission"])
def stream_admission(spark, sf_dir):
    """The rate limiter as a stream with list state; its batch twin's rows."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        calls = stream(spark, sf_dir).select("user_id", "event_id", at)
        streams.run_to_files(streams.streamed_admissions(calls, 2, 36000.0), f"{base}/out", f"{base}/checkpoint")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", at)
    admitted = spark.read.parquet(f"{base}/out")
    return admitted.join(e, ["user_id", "event_id"]).select("user_id", "event_id", F.round(F.col("admitted") - F.col("at"), 3).alias("wait"))


@query("stream_append_log", "SELECT user_id, event_type, CAST(max(event_id) AS BIGINT) AS event_id FROM events GROUP BY 1, 2")
def stream_append_log(spark, sf_dir):
    """Events appended by a checkpointed stream that runs twice, read by the latest-wins view."""
    from corvane.sources import stores

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):  # the second run finds nothing new
        streams.run_to_files(stream(spark, sf_dir), f"{base}/out", f"{base}/checkpoint")
    return stores.latest(spark.read.parquet(f"{base}/out"), "user_id", "event_type", order="event_id").select("user_id", "event_type", "event_id")

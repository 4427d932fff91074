"""Queries that run streams over the tables, each with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as S
from .recall import CAPTURE_SQL
from .registry import query
from .views import EPOCH


def _messages(v):
    t = S.stream_table(v.spark, f"{v.sf_dir}/conversations.parquet")
    ts = (F.lit(EPOCH) + 7200 * F.col("conv_id") + 60 * F.col("turn")).cast("double")
    channel = F.when(F.col("conv_id") % 3 == 0, "terminal").when(F.col("conv_id") % 3 == 1, "chat").otherwise("web")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), ts.alias("ts"), channel.alias("channel")).withColumn("at", F.timestamp_seconds("ts"))


@query("stream_route", "SELECT id, channel, CASE WHEN channel IN ('chat', 'web') THEN channel ELSE 'rest' END AS sink FROM v_channel_log WHERE id > 10000")
def _(v):
    out = S.stream_route(_messages(v).select("id", "channel", "at"), ["chat", "web"], 10000)
    parts = [df.withColumn("sink", F.lit(k)) for k, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "channel", "sink")


@query("stream_incremental_sync", """SELECT min(id) AS id, channel, role, content FROM v_channel_log n WHERE id > 5000 AND role IN ('user', 'assistant') AND trim(content) <> ''
    AND NOT EXISTS (SELECT 1 FROM v_channel_log o WHERE o.id % 5 = 0 AND o.channel = n.channel AND o.role = n.role AND o.content = n.content) GROUP BY channel, role, content""")
def _(v):
    return S.stream_incremental_sync(_messages(v), v.v_channel_log.filter("id % 5 = 0"), 5000).select("id", "channel", "role", "content")


@query("stream_high_water", "SELECT channel, ts, min(id) AS id FROM v_channel_log GROUP BY channel, ts")
def _(v):
    return S.high_water_rows(_messages(v).select("channel", "id", "ts"), "channel")


@query("stream_content_dedupe", "SELECT DISTINCT md5(coalesce(content, '')) AS hash FROM v_messages")
def _(v):
    return S.drain(S.stream_content_dedupe(_messages(v).select("content", "at")).select("hash"), "dedupe")


@query("stream_live_turns", """SELECT session_id, string_agg(role || ':' || pos, ',' ORDER BY ts, pos) AS turns, max(ts) + 1800 > (SELECT max(ts) FROM v_messages) AS live
    FROM (SELECT * FROM v_messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, pos DESC) <= 10) x GROUP BY session_id""")
def _(v):
    out = S.drain(S.stream_live_turns(_messages(v).select("session_id", "pos", "role", "ts")), "turns", "update")
    last = F.max_by(F.struct("turns", "live"), F.struct("batch", ~F.col("live"))).alias("x")
    return out.groupBy("session_id").agg(last).select("session_id", "x.turns", "x.live")


@query("stream_cross_channel", "SELECT session_id, arg_max(channel, ts) AS channel, max(ts) AS last_ts, substr(arg_max(content, ts), 1, 100) AS content FROM (SELECT m.*, s.source AS channel FROM v_messages m JOIN v_sessions s USING (session_id)) x GROUP BY session_id ORDER BY last_ts DESC, session_id LIMIT 3")
def _(v):
    out = S.drain(S.stream_cross_channel(_messages(v)), "cross", "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").drop("batch").orderBy(F.col("last_ts").desc(), "session_id").limit(3)


@query("stream_topic_heat", """WITH s AS (SELECT topic, session_id, max(ts) AS last FROM v_mentions GROUP BY topic, session_id QUALIFY row_number() OVER (PARTITION BY topic ORDER BY max(ts) DESC, session_id DESC) <= 20)
    SELECT topic, n, round(last, 3) AS last, round((SELECT sum(20 * pow(0.5, (g.last - m.ts) / 43200.0)) FROM v_mentions m WHERE m.topic = g.topic), 4) AS heat,
    (SELECT string_agg(CAST(session_id AS STRING), ',' ORDER BY s.last, session_id) FROM s WHERE s.topic = g.topic) AS session_ids FROM (SELECT topic, count(*) AS n, max(ts) AS last FROM v_mentions GROUP BY topic) g""")
def _(v):
    t = S.stream_table(v.spark, f"{v.sf_dir}/events.parquet")
    m = t.select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string")).alias("topic"), F.col("user_id").alias("session_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"))
    out = S.drain(S.stream_topic_heat(m), "heat", "update").groupBy("topic").agg(F.max_by(F.struct("n", "last", "heat", "session_ids"), "batch").alias("x"))
    return out.select("topic", "x.n", F.round("x.last", 3).alias("last"), F.round("x.heat", 4).alias("heat"), F.array_join(F.col("x.session_ids").cast("array<string>"), ",").alias("session_ids"))


@query("stream_capture", "SELECT id, session_id, role, substr(content, 1, 500) AS content, 'capture' AS type FROM v_messages WHERE role IN ('user', 'assistant') AND NOT (length(trim(coalesce(content, ''))) <= 3 OR lower(trim(coalesce(content, ''))) LIKE 'the%')")
def _(v):
    return S.drain(S.stream_capture(_messages(v), ["the"]), "capture")


@query("stream_session_end", f"""WITH g AS (SELECT session_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) < 1800 THEN 0 ELSE 1 END AS b FROM v_messages), s AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
    w AS (SELECT session_id, min(ts) AS started, max(ts) + 1800 AS ended, count(*) AS turns FROM s GROUP BY session_id, k) SELECT * FROM w WHERE ended <= (SELECT max(ts) FROM v_messages) - 3600""")
def _(v):
    out = S.drain(S.stream_session_end(_messages(v).select("session_id", "at")), "sessions")
    return out.select("session_id", F.unix_timestamp("started").cast("double").alias("started"), F.unix_timestamp("ended").cast("double").alias("ended"), "turns")


FACTS_SQL = CAPTURE_SQL.strip()


@query("stream_session_summaries", f"""WITH e AS (SELECT session_id, min(ts) AS started, max(ts) + 1800 AS ended, count(*) AS turns FROM v_messages GROUP BY session_id),
    k AS (SELECT * FROM e WHERE ended <= (SELECT max(ts) FROM v_messages) - 3600 ORDER BY ended DESC, session_id DESC LIMIT 100), f AS (SELECT session_id, count(*) AS facts FROM ({FACTS_SQL}) c GROUP BY session_id)
    SELECT k.session_id, started, ended, turns, coalesce(facts, 0) AS facts FROM k LEFT JOIN f ON f.session_id = k.session_id""")
def _(v):
    _, out = S.end_sessions(_messages(v).select("session_id", "pos", "role", "content", "ts", "at"), ["ing"], ["tion"], [])
    return out.select("session_id", F.unix_timestamp("started").cast("double").alias("started"), F.unix_timestamp("ended").cast("double").alias("ended"), "turns", "facts")

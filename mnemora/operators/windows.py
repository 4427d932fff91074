"""Window functions, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_key


def keep_first(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def latest_hit_per_session(hits: DataFrame) -> DataFrame:
    return keep_first(hits, ["session_id"], [F.col("ts").desc(), F.col("id").desc()])


def best_score_per_content(hits: DataFrame, key_len: int = 50, by: list[str] | None = None) -> DataFrame:
    """Of hits that begin alike, the one with the best score; ties to the smaller id."""
    return keep_first(hits.withColumn("_k", content_key(F.col("content"), key_len)), [*(by or []), "_k"], [F.col("score").desc(), "id"]).drop("_k")


def last_turns(msg: DataFrame, asof: float, n: int = 10, idle_s: float = 1800) -> DataFrame:
    """The last n messages of each session that isn't idle at ``asof``."""
    live = msg.withColumn("_last", F.max("ts").over(W.partitionBy("session_id"))).filter(F.col("_last") >= asof - idle_s)
    return keep_first(live, ["session_id"], [F.col("ts").desc(), F.col("id").desc()], n).drop("_last")


def last_assistant_message(msg: DataFrame, ses: DataFrame, sessions: int = 3, width: int = 150) -> DataFrame:
    """``session_id, content`` of the latest sessions: each one's last assistant message of over ten
    characters, cut."""
    last = ses.orderBy(F.col("started_at").desc(), "session_id").limit(sessions).select("session_id")
    own = msg.filter((F.col("role") == "assistant") & (F.length("content") > 10)).join(last, "session_id", "left_semi")
    return own.groupBy("session_id").agg(F.substring(F.max_by("content", "pos"), 1, width).alias("content"))


def first_messages(msg: DataFrame, n: int) -> DataFrame:
    return keep_first(msg, ["session_id"], ["pos", "id"], n)


def first_messages_or_recent(msg: DataFrame, ses: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``asked_id`` with the first n messages of each asked session (session_id); where that has none, those of
    the session that started last among those with messages (ties: the greater id)."""
    has = msg.select("session_id").distinct()
    latest = ses.join(has, "session_id", "left_semi").agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("latest"))
    own = ids.select(F.col("session_id").alias("asked_id")).distinct().join(has.select(F.col("session_id").alias("own")), F.col("asked_id") == F.col("own"), "left")
    chosen = own.crossJoin(F.broadcast(latest)).select("asked_id", F.coalesce("own", "latest").alias("session_id"))  # one row
    return chosen.join(first_messages(msg, n), "session_id")


def metric_regression(hist: DataFrame, thresholds: dict[str, float], ts: str = "day") -> DataFrame:
    """``day, metric, prev, cur, delta, verdict`` of each run against the one before it."""
    long = hist.select(F.col(ts).alias("day"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("cur"), F.lit(float(t)).alias("t")) for m, t in thresholds.items()])).alias("x")).select("day", "x.*")
    w = W.partitionBy("metric").orderBy("day")
    d = long.withColumn("prev", F.lag("cur").over(w)).filter("prev is not null").withColumn("delta", F.round(F.col("cur") - F.col("prev"), 6))
    verdict = F.when(F.col("delta") > F.col("t"), "worse").when(F.col("delta") < -F.col("t"), "better").otherwise("stable")
    return d.select("day", "metric", "prev", "cur", "delta", verdict.alias("verdict"))


def metric_report(hist: DataFrame, thresholds: dict[str, float], ts: str = "day") -> DataFrame:
    """``metric, value, verdict`` of the latest run."""
    r = metric_regression(hist, thresholds, ts)
    return r.groupBy("metric").agg(F.max_by("cur", "day").alias("value"), F.max_by("verdict", "day").alias("verdict"))


def snapshot_retention(snaps: DataFrame, keep: int = 7, group: str | None = None) -> DataFrame:
    """``snap, action``: the newest are kept, the others expire, in each group."""
    part = [group] if group else [F.lit(0)]
    r = F.row_number().over(W.partitionBy(*part).orderBy(F.col("snap").desc()))
    return snaps.select(*([group] if group else []), "snap", F.when(r <= keep, "keep").otherwise("expire").alias("action"))


def last_session_ids(mentions: DataFrame, n: int = 20) -> DataFrame:
    """``topic, session_ids``: the n sessions that a topic saw last for the first time, as text."""
    seen = mentions.groupBy("topic", "session_id").agg(F.min("ts").alias("first"))
    kept = keep_first(seen, ["topic"], [F.col("first").desc(), F.col("session_id").desc()], n)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("first", "session_id"))), lambda x: x["session_id"].cast("string"))
    return kept.groupBy("topic").agg(F.array_join(ids, ",").alias("session_ids"))


def recent_unanswered(log: DataFrame, processed: DataFrame, channel: str, n: int = 10) -> DataFrame:
    last = log.filter((F.col("channel") == channel) & (F.col("role") == "user")).orderBy(F.col("id").desc()).limit(n)
    return last.join(processed.select("id"), "id", "left_anti").orderBy("id")


def first_wins_dedupe(df: DataFrame, keys: list, order: list) -> DataFrame:
    return keep_first(df, keys, order)


def top_counts(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), col).limit(n)


def hottest_topic(topics: DataFrame) -> DataFrame:
    """``name, heat`` of the hottest topic; ties to the smaller name."""
    return topics.orderBy(F.col("heat").desc(), "name").limit(1).select("name", "heat")


def union_strategies(*legs: DataFrame) -> DataFrame:
    out = legs[0]
    for x in legs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def new_entities(found: DataFrame, known: DataFrame) -> DataFrame:
    """Names that aren't known and aren't part of a known name that they share a token with."""
    fresh = found.select("name").distinct().join(known.select("name"), "name", "left_anti")
    tok = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), r"\s+")))
    a = fresh.select("name", tok(F.col("name")).alias("t"))
    b = known.select(F.col("name").alias("k"), tok(F.col("name")).alias("t"))
    inside = a.join(b, "t").filter(F.col("k").contains(F.col("name"))).select("name").distinct()
    return fresh.join(inside, "name", "left_anti")

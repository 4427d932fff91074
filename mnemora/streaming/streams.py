"""Streams of messages and mentions: routing, syncing, dedupe, live turns, heat, sessions.

Operators take a streaming DataFrame and return one, or a function for ``foreachBatch`` where
there are several sinks. State is per key and expires by watermark or by a bound. ``drain`` runs
a stream over what is there and returns the result as a table.

Live turns, topic heat and high-water marks are keyed processors (``keyed``) with their state in
RocksDB. What a key gets of a batch is cut down where it is read (the last turns of a session, sums
of a topic), so a key with a third of all rows sends a few rows for each Arrow batch to its task. A
stream that is started again on its checkpoint goes on with its state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.filters import important_sentences, is_trivial, topic_classify
from ..sources.paths import shared_path


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's setting comes back."""
    key, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drain(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all data that is there (``availableNow``) and read what it wrote. Results of
    update and complete mode are written per batch; a batch that is run again replaces its own.
    ``folder`` holds results and checkpoint (none: a new one); a stream that is drained again on its
    folder takes what is new and goes on with its state."""
    spark = stream.sparkSession
    folder = folder or shared_path(spark, name)
    out, check = f"{folder}/out", f"{folder}/checkpoint"
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", check).outputMode(mode)
    if mode == "append":
        w = w.format("parquet").option("path", out)
    else:
        w = w.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    with rocksdb_state(spark):
        w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(out)


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    check = f"{folder}/checkpoint" if folder else shared_path(stream.sparkSession, f"{name}-checkpoint")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", check).foreachBatch(each).start().awaitTermination()


def route(log: DataFrame, sinks: dict[str, str], default: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows of each channel go to the folder of its sink, others to the default;
    a batch that is run again replaces its own rows."""

    def each(df: DataFrame, i: int) -> None:
        df = df.persist()
        for channel, path in sinks.items():
            df.filter(F.col("channel") == channel).write.mode("overwrite").parquet(f"{path}/batch={i}")
        df.filter(~F.coalesce(F.col("channel").isin(list(sinks)), F.lit(False))).write.mode("overwrite").parquet(f"{default}/batch={i}")
        df.unpersist()

    return each


def stream_route(log: DataFrame, channels: list[str], last_id: int = 0, at: str | None = "at", watermark: str = "1 day") -> dict[str, DataFrame]:
    """Rows above ``last_id``, each id once, dealt to a table a channel, and one for the rest. Ids are
    remembered for ``watermark`` of the time column ``at`` (without one, for ever); rows without
    channel go to the rest."""
    spark = log.sparkSession
    paths = {c: shared_path(spark, f"route-{c}") for c in channels}
    rest = shared_path(spark, "route-rest")
    own = log.filter(F.col("id") > last_id)
    once = own.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["id"]) if at else own.dropDuplicates(["id"])
    run_batches(once, "route", route(log, paths, rest))
    return {c: spark.read.parquet(p).drop("batch") for c, p in [*paths.items(), ("rest", rest)]}


def _there(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]


def stream_incremental_sync(src: DataFrame, target: DataFrame, last_id: int = 0, folder: str | None = None, buckets: int = 64) -> DataFrame:
    """What is new in the source: user and assistant messages above ``last_id`` with content that the
    target, and earlier batches, don't hold. Returns the added rows.

    The keys of earlier batches are a table in ``buckets`` parts by hash: a batch reads the parts that
    its own keys fall in. A batch that is run again replaces what it wrote. ``folder`` holds rows, keys
    and checkpoint (none: a new one); a stream that is run again on it goes on."""
    spark, keys = src.sparkSession, ["channel", "role", "content"]
    folder = folder or shared_path(spark, "sync")
    rows, past = f"{folder}/rows", f"{folder}/keys"
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in keys]), 256)

    def each(df: DataFrame, i: int) -> None:
        new = df.filter(F.trim(F.coalesce("content", F.lit(""))) != "").groupBy(*keys).agg(F.min("id").alias("id"))
        new = new.join(target.select(*keys), keys, "left_anti").withColumn("key", digest).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
        new = new.persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        held = _there(spark, [f"{past}/bucket={b}" for b in touched])
        if held:
            known = spark.read.schema("key string, bucket int, batch long").option("basePath", past).parquet(*held).filter(F.col("batch") < i)
            new = new.join(known.select("key"), "key", "left_anti")
        new.drop("key", "bucket").write.mode("overwrite").parquet(f"{rows}/batch={i}")
        mine = new.select("key", "bucket", F.lit(i).cast("long").alias("batch")).repartition("bucket")
        mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(past)
        new.unpersist()

    run_batches(src.filter((F.col("id") > last_id) & F.col("role").isin("user", "assistant")), "sync", each, folder)
    return spark.read.parquet(rows).drop("batch")


def _each(schema: str, cut: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """What each Arrow batch of a stream is cut down to, before it is shuffled."""
    return lambda df: df.mapInPandas(lambda pdfs: (cut(p) for p in pdfs if len(p)), schema)


def _millis(text: str) -> int:
    n, unit = text.split()
    return int(float(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


class HighWater(StatefulProcessor):
    """The mark of a key, until the watermark has reached it."""

    def __init__(self, key: str, kind: str) -> None:
        self.key, self.kind = key, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "ts double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.mark.get()[0] if self.mark.exists() else -math.inf
        new: dict[float, int] = {}
        for part in rows:
            for ts, i in zip(part["ts"].tolist(), part["id"].tolist(), strict=True):
                if ts > held and i < new.get(ts, math.inf):
                    new[ts] = i
        order = sorted(new)
        if new:
            if held > -math.inf:
                self.handle.deleteTimer(math.ceil(held * 1000))
            self.mark.update((order[-1],))
            self.handle.registerTimer(math.ceil(order[-1] * 1000))
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(order), dtype=self.kind), "id": pd.Series([new[t] for t in order], dtype="int64"), "ts": order})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.mark.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_high_water(src: DataFrame, key: str, fields: str | None = None, ttl: str = "7 days") -> DataFrame:
    """Rows (key, id, ts) that are newer than all that their key has sent; late rows are dropped, and of
    ties the smallest id is sent. State: one number a key, which goes when it lies ``ttl`` behind the
    newest time of all keys; rows as old as that are dropped too, so nothing is sent twice. The times of
    a key in one batch meet in one task: for few keys with many rows take ``high_water_rows``. Rows
    without key or time are dropped. fields: the types of the result (none: those of the source, id long,
    ts double)."""
    kind = src.schema[key].dataType.simpleString()
    cut = _each(f"{key} {kind}, id long, ts double", lambda p: p.groupby([key, "ts"], as_index=False)["id"].min()[[key, "id", "ts"]])
    rows = cut(src.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.col("id").cast("long").alias("id"), F.col("ts").cast("double").alias("ts")))
    timed = rows.withColumn("at", F.timestamp_micros((F.col("ts") * 1000000).cast("long"))).withWatermark("at", ttl)
    return timed.groupBy(key).transformWithStateInPandas(HighWater(key, "object" if kind == "string" else "Int64"), fields or f"{key} {kind}, id long, ts double", "Append", "EventTime")


def _held(spark: SparkSession, path: str, i: int, schema: str) -> DataFrame:
    """The state that batch ``i`` begins with: what the batch before it wrote."""
    return spark.read.schema(schema).parquet(f"{path}/batch={i - 1}") if i else spark.createDataFrame([], schema)


def high_water_rows(src: DataFrame, key: str, folder: str | None = None, expire: float | None = None) -> DataFrame:
    """Rows (key, id, ts) that are newer than all that their key has sent in earlier batches: late rows
    are dropped, and of rows that tie in time that with the smallest id is sent. State: one number a
    key, in a written table; a batch that is run again reads the same marks and replaces its own rows.
    Returns the rows sent. Rows without key share a mark; rows without time are dropped. ``folder``
    holds rows, marks and checkpoint (none: a new one): run again on it, the stream goes on. Marks
    that lie more than ``expire`` seconds before the newest one are forgotten."""
    spark = src.sparkSession
    folder = folder or shared_path(spark, "high-water")
    path, marks = f"{folder}/rows", f"{folder}/marks"
    state = f"k {src.schema[key].dataType.simpleString()}, mark double"

    def each(df: DataFrame, i: int) -> None:
        held = _held(spark, marks, i, state)
        rows = df.filter("ts is not null").groupBy(key, "ts").agg(F.min("id").alias("id"))
        newer = rows.join(held, F.col(key).eqNullSafe(F.col("k")), "left").filter("mark is null or ts > mark").select(key, "id", "ts")
        newer.write.mode("overwrite").parquet(f"{path}/batch={i}")
        sent = spark.read.schema(newer.schema).parquet(f"{path}/batch={i}").select(F.col(key).alias("k"), F.col("ts").alias("mark"))
        now = held.unionByName(sent).groupBy("k").agg(F.max("mark").alias("mark"))
        if expire is not None:
            now = now.crossJoin(F.broadcast(now.agg(F.max("mark").alias("newest")))).filter(F.col("mark") >= F.col("newest") - float(expire)).drop("newest")
        now.write.mode("overwrite").parquet(f"{marks}/batch={i}")

    run_batches(src, "high-water", each, folder)
    return spark.read.parquet(path).drop("batch")


def stream_content_dedupe(src: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Rows whose content hasn't been seen within the watermark; at is a timestamp column."""
    return src.withColumn("hash", F.md5(F.coalesce("content", F.lit("")))).withWatermark("at", watermark).dropDuplicatesWithinWatermark(["hash"])


class LiveTurns(StatefulProcessor):
    """The last turns of a session, and a timer for when it has been idle long enough."""

    def __init__(self, n: int, idle: str) -> None:
        self.n, self.idle = n, _millis(idle)

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "ts double, pos long, role string")
        self.due = handle.getValueState("due", "at long")

    def _row(self, session, turns: list, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [session], "turns": [",".join(f"{r}:{p}" for _, p, r in turns)], "live": [live]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        for part in rows:
            held += [(float(t), int(p), r or "") for t, p, r in zip(part["ts"], part["pos"], part["role"], strict=True)]
            held = sorted(held)[-self.n :]
        self.turns.put(held)
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        due = math.ceil(held[-1][0] * 1000) + self.idle
        self.due.update((due,))
        self.handle.registerTimer(due)
        yield self._row(key[0], held, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()]
        self.turns.clear()
        self.due.clear()
        yield self._row(key[0], held, False)

    def close(self) -> None:
        pass


def stream_live_turns(src: DataFrame, n: int = 10, idle: str = "30 minutes", watermark: str = "0 minutes") -> DataFrame:
    """``session_id, turns, live``: the last n turns of each session (role:pos, comma separated) after
    each batch that touched it; once more, not live, when the watermark of ``ts`` has passed its last
    turn by ``idle``. Its state, n turns and a timer, goes then. Turns behind the watermark are
    dropped, as are those without session or time."""
    turns = src.filter("session_id is not null and ts is not null").select(F.col("session_id").cast("long").alias("session_id"), F.col("pos").cast("long").alias("pos"), "role", F.col("ts").cast("double").alias("ts"))
    cut = _each("session_id long, pos long, role string, ts double", lambda p: p.sort_values(["ts", "pos", "role"]).groupby("session_id").tail(n))
    timed = cut(turns).withColumn("at", F.timestamp_micros((F.col("ts") * 1000000).cast("long"))).withWatermark("at", watermark)
    return timed.groupBy("session_id").transformWithStateInPandas(LiveTurns(n, idle), "session_id long, turns string, live boolean", "Update", "EventTime")


def stream_cross_channel(src: DataFrame) -> DataFrame:
    """``session_id, channel, last_ts, content``: the latest turn of each session."""
    return src.groupBy("session_id").agg(F.max_by("channel", "ts").alias("channel"), F.max("ts").alias("last_ts"), F.substring(F.max_by("content", "ts"), 1, 100).alias("content"))


class TopicHeat(StatefulProcessor):
    """Count, last mention and heat of a topic, and the sessions that mentioned it last."""

    def __init__(self, life: float, keep: int) -> None:
        self.life, self.keep = life, keep

    def init(self, handle) -> None:
        self.sums = handle.getValueState("sums", "n long, last double, heat double")
        self.sessions = handle.getListState("sessions", "ts double, session long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last, heat = self.sums.get() if self.sums.exists() else (0, -math.inf, 0.0)
        met = {s: t for t, s in self.sessions.get()} if self.sessions.exists() else {}
        for part in rows:
            for m, at, h, recent in zip(part["n"], part["last"], part["heat"], part["sessions"], strict=True):
                end = max(last, at)
                heat = heat * 0.5 ** ((end - last) / self.life) + h * 0.5 ** ((end - at) / self.life) if n else float(h)
                n, last = n + int(m), float(end)
                for x in recent:
                    met[x["session"]] = max(x["ts"], met.get(x["session"], -math.inf))
            met = dict(sorted(met.items(), key=lambda x: (x[1], x[0]))[-self.keep :])
        recent = sorted((float(t), int(s)) for s, t in met.items())
        self.sums.update((n, last, heat))
        if recent:
            self.sessions.put(recent)
        yield pd.DataFrame({"topic": [key[0]], "n": [n], "last": [last], "heat": [heat], "session_ids": [[s for _, s in recent]]})

    def close(self) -> None:
        pass


def stream_topic_heat(src: DataFrame, half_life_h: float = 12, boost: float = 20, keep: int = 20) -> DataFrame:
    """``topic, n, last, heat, session_ids`` after each batch that touched the topic (topic, ts,
    session_id): each mention adds ``boost``, halved every half-life up to the last mention, in
    whatever order mentions come; and the ``keep`` sessions that mentioned it last, the newest at the
    end (ties: the greater id). State: three numbers and ``keep`` sessions a topic.

    Mentions are summed in each Arrow batch first, so a hot topic sends a row a batch. Mentions without
    topic or time are dropped; those without session, or without that column, count for the heat."""
    life = 3600.0 * half_life_h
    session = F.col("session_id") if "session_id" in src.columns else F.lit(None)
    own = src.filter("topic is not null and ts is not null").select("topic", F.col("ts").cast("double").alias("ts"), session.cast("long").alias("session"))

    def summed(p: pd.DataFrame) -> pd.DataFrame:
        last = p.groupby("topic")["ts"].transform("max")
        p = p.assign(last=last, heat=boost * 0.5 ** ((last - p["ts"]) / life))
        sums = p.groupby("topic", as_index=False).agg(n=("ts", "size"), last=("last", "first"), heat=("heat", "sum"))
        recent = p.dropna(subset=["session"]).groupby(["topic", "session"], as_index=False)["ts"].max().sort_values(["ts", "session"]).groupby("topic").tail(keep)
        lists = {t: [{"ts": x, "session": int(y)} for x, y in zip(g["ts"].tolist(), g["session"].tolist(), strict=True)] for t, g in recent.groupby("topic")}
        return sums.assign(sessions=[lists.get(t, []) for t in sums["topic"]])

    parts = _each("topic string, n long, last double, heat double, sessions array<struct<ts: double, session: long>>", summed)(own)
    schema = "topic string, n long, last double, heat double, session_ids array<long>"
    return parts.groupBy("topic").transformWithStateInPandas(TopicHeat(life, keep), schema, "Update", "None")


def topic_heat_table(src: DataFrame, half_life_h: float = 12, boost: float = 20) -> DataFrame:
    """``topic, n, last, heat``, with built-in aggregates only: each mention adds ``boost`` to what has halved since the one before; a
    mention older than what its topic had before the batch adds ``boost`` as it is. State: three
    numbers a topic, in a written table. Returns the state after the last batch.

    The heat at the last mention is the sum of what each mention has left by then. Mentions are
    summed by half-life first, in Spark's partial aggregates, then the sums of a topic: no topic's
    mentions meet in one task. Mentions without time are dropped."""
    spark, path, life = src.sparkSession, shared_path(src.sparkSession, "topic-heat"), 3600.0 * half_life_h
    state, last_batch = "topic string, n long, last double, heat double", [-1]

    def each(df: DataFrame, i: int) -> None:
        held = _held(spark, path, i, state)
        old = held.select(F.col("topic").alias("t"), F.col("last").alias("held"))
        at = df.filter("ts is not null").join(old, F.col("topic").eqNullSafe(F.col("t")), "left").select("topic", F.greatest("ts", "held").cast("double").alias("at"))
        span = F.floor(F.col("at") / F.lit(life))
        left = F.lit(float(boost)) * F.pow(F.lit(2.0), F.col("at") / F.lit(life) - F.col("span") - 1)
        sums = at.withColumn("span", span).groupBy("topic", "span").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"), F.sum(left).alias("heat"))
        # what each sum is worth at its own last mention, so that all rows of the union mean the same
        new = sums.select("topic", "n", "last", (F.col("heat") * F.pow(F.lit(2.0), F.col("span") + 1 - F.col("last") / F.lit(life))).alias("heat"))
        parts = held.unionByName(new)
        ends = parts.withColumn("end", F.max("last").over(W.partitionBy("topic")))  # one row a topic and half-life
        worth = F.col("heat") * F.pow(F.lit(2.0), (F.col("last") - F.col("end")) / F.lit(life))
        ends.groupBy("topic").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum(worth).alias("heat")).write.mode("overwrite").parquet(f"{path}/batch={i}")
        last_batch[0] = i

    run_batches(src, "topic-heat", each)
    return _held(spark, path, last_batch[0] + 1, state)


def stream_capture(src: DataFrame, phrases: list[str], max_chars: int = 500, flush: bool = False) -> DataFrame:
    """Turns that say something, cut and tagged; nothing is kept between rows. With ``flush``, as before
    a conversation is compressed, those of the user only, tagged so."""
    roles = ("user",) if flush else ("user", "assistant")
    said = src.filter(F.col("role").isin(*roles) & ~is_trivial(F.col("content"), phrases))
    return said.select("id", "session_id", "role", F.substring("content", 1, max_chars).alias("content"), F.lit("flush" if flush else "capture").alias("type"))


def stream_session_end(src: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """``session_id, started, ended, turns``: sessions by gaps in ``at``, once the watermark has passed
    their end."""
    w = src.withWatermark("at", watermark).groupBy("session_id", F.session_window("at", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("turns")).select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "turns")


def session_texts(src: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", last: int = 6, cut: int = 300) -> DataFrame:
    """``session_id, started, ended, turns, text`` as ``stream_session_end``, with the last turns that say
    something as lines ``role: content``, cut."""
    line = F.when(F.coalesce("content", F.lit("")) != "", F.struct("ts", "pos", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.substring("content", 1, cut)).alias("line")))
    w = src.withWatermark("at", watermark).groupBy("session_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(line)).alias("l"))
    lines = F.when(F.size("l") > last, F.slice("l", -last, last)).otherwise(F.col("l"))
    return w.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "turns", F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def end_sessions(src: DataFrame, verbs: list[str], tech: list[str], rules: list[tuple[list[str], str]], folder: str | None = None, keep: int = 100, least: int = 20, gap: str = "30 minutes", watermark: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """What is left of sessions when they end: facts (session_id, ended, kind, fact, topic), and a summary
    each (session_id, started, ended, turns, facts), of which the ``keep`` that ended last stay. Both are
    written by batch, and a batch that is run again replaces its own; ``folder`` as in ``drain``."""
    spark = src.sparkSession
    folder = folder or shared_path(spark, "session-end")
    facts_at, summaries_at, done = f"{folder}/facts", f"{folder}/summaries", [-1]
    kinds = "session_id long, started timestamp, ended timestamp, turns long, facts long"

    def each(df: DataFrame, i: int) -> None:
        df = df.persist()
        own = df.select(F.struct("session_id", "ended").alias("s"), "text").filter(F.length(F.trim("text")) >= least)
        found = important_sentences(own, verbs, tech, 5, "s", "text").select("doc_id.session_id", "doc_id.ended", "kind", F.col("sentence").alias("fact"), topic_classify(F.col("sentence"), rules).alias("topic"))
        found.write.mode("overwrite").parquet(f"{facts_at}/batch={i}")
        n = spark.read.schema(found.schema).parquet(f"{facts_at}/batch={i}").groupBy("session_id", "ended").agg(F.count(F.lit(1)).alias("facts"))
        new = df.select("session_id", "started", "ended", "turns").join(n, ["session_id", "ended"], "left").select("session_id", "started", "ended", "turns", F.coalesce("facts", F.lit(0)).cast("long").alias("facts"))
        before = _there(spark, [f"{summaries_at}/batch={i - 1}"])
        held = spark.read.schema(kinds).parquet(*before) if before else spark.createDataFrame([], kinds)
        held.unionByName(new).orderBy(F.col("ended").desc(), F.col("session_id").desc()).limit(keep).write.mode("overwrite").parquet(f"{summaries_at}/batch={i}")
        done[0] = i
        df.unpersist()

    run_batches(session_texts(src, gap, watermark), "session-end", each, folder)
    last = done[0] if done[0] >= 0 else max((int(p.rsplit("=", 1)[1]) for p in _listed(spark, summaries_at)), default=-1)
    summaries = spark.read.schema(kinds).parquet(f"{summaries_at}/batch={last}") if last >= 0 else spark.createDataFrame([], kinds)
    facts = spark.read.schema("session_id long, ended timestamp, kind string, fact string, topic string").parquet(facts_at) if last >= 0 else spark.createDataFrame([], "session_id long, ended timestamp, kind string, fact string, topic string")
    return facts, summaries


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder; none where it isn't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if not _there(spark, [path]):
        return []
    p = jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().toString() for x in p.getFileSystem(conf).listStatus(p) if x.isDirectory()]


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder or file of Parquet as a stream, with the schema that it has now. The path is read as
    a pattern, since streams take no plain file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path}*")

"""Aggregations: counts, profiles, health and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from .filters import is_trivial_exact


def dimension_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """``dim, value, n`` for each dimension on its own, in one pass."""
    s = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("d"))
    return s.groupBy("d.dim", "d.value").agg(F.count(F.lit(1)).alias("n"))


def forget_preview(mem: DataFrame, decisions: DataFrame, asof: float, top: int = 15) -> DataFrame:
    """``dim, value, n`` of the rows to forget: by source, type, band of age, and the top topics."""
    gone = mem.join(decisions.filter("decision = 'forget'").select("id"), "id", "left_semi")
    age = F.when(F.col("created_at").isNull(), "no timestamp").when(F.col("created_at") > asof - 7 * 86400, "recent").otherwise("old")
    gone = gone.withColumn("age", age)
    topics = dimension_counts(gone, ["topic"]).orderBy(F.col("n").desc(), "value").limit(top)
    return dimension_counts(gone, ["source", "type", "age"]).unionByName(topics)


def metadata_type_profile(eav: DataFrame) -> DataFrame:
    """``key, total, n_str, n_float, n_int, class``: what kinds of value a key has."""
    out = eav.groupBy("key").agg(
        F.count(F.lit(1)).alias("total"), F.count("string_value").alias("n_str"),
        F.count_if(F.col("string_value").isNull() & F.col("float_value").isNotNull()).alias("n_float"), F.count_if(F.col("string_value").isNull() & F.col("int_value").isNotNull()).alias("n_int"),
    )
    kind = F.when((F.col("n_str") > 0) & (F.col("n_float") > 0), "mixed").when(F.col("n_str") > 0, "string").when(F.col("n_float") > 0, "float").otherwise("int")
    return out.withColumn("class", kind)


def damage_ratio(eav: DataFrame) -> DataFrame:
    """``key, bad, total, ratio`` of keys of mixed kinds: rows that hold a float only."""
    m = metadata_type_profile(eav).filter("class = 'mixed'")
    return m.select("key", F.col("n_float").alias("bad"), "total", F.round(F.col("n_float") / F.col("total"), 4).alias("ratio"))


def relation_stats(rel: DataFrame) -> DataFrame:
    """``type, total, active``; a row with a null type holds the totals."""
    return rel.rollup("type").agg(F.count(F.lit(1)).alias("total"), F.count_if("active").alias("active"))


def graph_stats(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("node"))
    return ends.agg(F.count_distinct("node").alias("nodes"), F.expr("count(*) div 2").alias("edges"))


def corrections_summary(log: DataFrame, asof: float, days: int = 7) -> DataFrame:
    """``topic, n, unfixed, repeated`` of the last days."""
    near = log.filter((F.col("ts") >= asof - days * 86400) & (F.col("ts") <= asof))
    return near.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("fixed")).alias("unfixed")).withColumn("repeated", F.col("n") >= 2)


def experience_patterns(log: DataFrame, scene: str, least: int = 2) -> DataFrame:
    return log.groupBy(F.col(scene).alias("scene")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def zone_health(records: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``zone, n, alert``: items of each zone, and whether there are more than its limit, or none
    (an item that is null doesn't count)."""
    n = records.groupBy("zone").agg(F.count("item").alias("n"))
    alert = F.when(F.col("n") == 0, "empty")
    for zone, most in limits.items():
        alert = alert.when((F.col("zone") == zone) & (F.col("n") > most), "crowded")
    return n.withColumn("alert", alert)


def reflection_report(corrections: DataFrame, zones: DataFrame, pending: DataFrame) -> DataFrame:
    """``priority, alert``: repeated corrections, unfixed ones, zones, pending lines; or that all is well."""
    c = corrections.agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("repeated"), F.col("topic")))), ",").alias("topics"), F.coalesce(F.sum("unfixed"), F.lit(0)).alias("u"))
    a = c.filter("topics <> ''").select(F.lit(1).alias("priority"), F.concat(F.lit("repeated: "), "topics").alias("alert"))
    b = c.filter("u > 0").select(F.lit(2).alias("priority"), F.concat(F.col("u").cast("string"), F.lit(" unfixed")).alias("alert"))
    z = zones.filter("alert is not null").select(F.lit(3).alias("priority"), F.concat("zone", F.lit(": "), "alert").alias("alert"))
    p = pending.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(4).alias("priority"), F.concat(F.col("n").cast("string"), F.lit(" pending")).alias("alert"))
    found = a.unionByName(b).unionByName(z).unionByName(p)
    none = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(9).alias("priority"), F.lit("all well").alias("alert"))
    return found.unionByName(none)


def session_value_score(msg: DataFrame, substantive, important: list[str], least: float = 0.3) -> DataFrame:
    """``session_id, total, meaningful, score, keep`` of user and assistant messages; substantive: a
    Column. A message with an important term counts two more."""
    own = msg.filter(F.col("role").isin("user", "assistant"))
    points = F.when(substantive, 1).otherwise(0) + F.when(contains_any(F.col("content"), important), 2).otherwise(0)
    s = own.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), F.sum(points).cast("long").alias("meaningful"))
    return s.withColumn("score", F.round(F.col("meaningful") / F.col("total"), 4)).withColumn("keep", F.col("meaningful") / F.col("total") >= least)


def valuable_sessions(
    ses: DataFrame, msg: DataFrame, phrases: list[str] = (), important: list[str] = (), user_cut: int = 300, assistant_cut: int = 500, cut: int = 2000, least: int = 10
) -> DataFrame:
    """``session_id, title, user_text, assistant_text, user_count, assistant_count, skip_reason``: what
    each side said, in order, cut, and why a session isn't worth keeping, if so: of the source cron;
    empty, without messages; trivial, where neither side said anything; too short, where the user said
    nothing or under ``least`` characters. User messages count that aren't trivial (under four characters,
    or exactly a phrase), of the assistant those of 15 characters or more."""
    text = F.trim(F.coalesce("content", F.lit("")))
    user = (F.col("role") == "user") & ~is_trivial_exact(F.col("content"), list(phrases), list(important))
    other = (F.col("role") == "assistant") & (F.length(text) >= 15)

    def said(which, width: int):
        part = F.when(which, F.struct("pos", F.substring(text, 1, width).alias("t")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n")

    g = msg.groupBy("session_id").agg(
        said(user, user_cut).alias("u"), said(other, assistant_cut).alias("a"), F.count_if(user).alias("user_count"), F.count_if(other).alias("assistant_count"),
    )
    j = ses.select("session_id", "title", "source").join(g, "session_id", "left")
    reason = (
        F.when(F.col("source") == "cron", "cron").when(F.col("user_count").isNull(), "empty")
        .when((F.col("u") == "") & (F.col("a") == ""), "trivial").when(F.length("u") < least, "too_short")
    )
    return j.select("session_id", "title", F.substring("u", 1, cut).alias("user_text"), F.substring("a", 1, cut).alias("assistant_text"), "user_count", "assistant_count", reason.alias("skip_reason"))


def skip_reason_counts(valuable: DataFrame) -> DataFrame:
    return valuable.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def restore_preview(valuable: DataFrame, ses: DataFrame) -> DataFrame:
    """``day, sessions, chars, est_tokens`` of the sessions that are kept."""
    kept = valuable.filter("skip_reason is null").join(ses.select("session_id", "started_at"), "session_id")
    chars = F.coalesce(F.length("user_text"), F.lit(0)) + F.coalesce(F.length("assistant_text"), F.lit(0))
    day = F.date_format(F.timestamp_seconds("started_at"), "yyyy-MM-dd").alias("day")
    g = kept.groupBy(day).agg(F.count(F.lit(1)).alias("sessions"), F.sum(chars).cast("long").alias("chars"))
    return g.withColumn("est_tokens", F.floor(F.col("chars") * 1.5).cast("long"))


def findings_summary(f: DataFrame) -> DataFrame:
    """``dim, value, n``: in total, by severity, by tool."""
    g = f.groupingSets([[], ["severity"], ["tool"]], "severity", "tool").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("severity", "tool").alias("g"))
    dim = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "severity").otherwise("tool")
    return g.select(dim.alias("dim"), F.coalesce("severity", "tool").alias("value"), "n")


def quality_metrics(findings: DataFrame) -> DataFrame:
    """One row: issues, those whose code begins with E, W or S, mean and largest value, and how many
    are high."""
    code = F.substring("code", 1, 1)
    return findings.agg(
        F.count(F.lit(1)).alias("issues"), *[F.count_if(code == c).alias(n) for c, n in (("E", "errors"), ("W", "warnings"), ("S", "security"))],
        F.round(F.avg("value"), 2).alias("avg_complexity"), F.max("value").alias("max_complexity"), F.count_if(F.col("value") >= 11).alias("complex_funcs"), F.count_if(F.col("severity") == "high").alias("high"),
    )


def session_messages_nested(hits: DataFrame) -> DataFrame:
    """``session_id, title, messages``: the messages of a session as one array, in order."""
    m = F.struct("pos", "role", "content")
    return hits.groupBy("session_id", "title").agg(F.array_sort(F.collect_list(m)).alias("messages"))


def mean_pool_normalize(vec: DataFrame, group: str) -> DataFrame:
    """``group, pos, value``: the mean of a group's vectors, brought to length 1."""
    mean = vec.select(F.col(group).alias("group"), F.posexplode("v").alias("pos", "x")).groupBy("group", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norms = mean.groupBy("group").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norms, "group").select("group", "pos", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0).alias("value"))


def severity_rollup(changes: DataFrame) -> DataFrame:
    """``critical, warning, info, status``: counts and the worst of them."""
    c = changes.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    return c.withColumn("status", F.when(F.col("critical") > 0, "FAIL").when(F.col("warning") > 0, "WARN").when(F.col("info") > 0, "INFO").otherwise("PASS"))


def scalar_rows(spark, counts: dict[str, DataFrame]) -> DataFrame:
    """``name, n``: the number of rows of each table."""
    out = None
    for name, df in counts.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# Keys that hold times.
TIME_KEYS = ("created_at", "last_mentioned", "collected_at", "updated_at", "last_decay")


def store_health(eav: DataFrame, emb: DataFrame, queue: DataFrame | None = None, time_keys: tuple[str, ...] | list[str] = TIME_KEYS) -> DataFrame:
    """``check, value, status``: rows, orphans, keys whose values are of mixed kinds, times that are stored
    as text (any fails), and, where a queue is given, its depth (50 warns, 500 fails)."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("check"), "value")
    rows = count(eav, "metadata").unionByName(count(emb, "embeddings"))
    rows = rows.unionByName(count(eav.select("id").distinct().join(emb.select("id"), "id", "left_anti"), "orphans"))
    rows = rows.unionByName(count(metadata_type_profile(eav).filter("class = 'mixed'"), "mixed_keys"))
    rows = rows.unionByName(count(eav.filter(F.col("key").isin(list(time_keys)) & F.col("string_value").isNotNull()), "text_times"))
    rows = rows.unionByName(count(queue, "queue")) if queue is not None else rows
    bad, n = F.col("check").isin("orphans", "mixed_keys"), F.col("value")
    deep = F.col("check") == "queue"
    fail = bad & (n > 10) | (F.col("check") == "text_times") & (n > 0) | deep & (n >= 500)
    return rows.withColumn("status", F.when(fail, "fail").when(bad & (n > 0) | deep & (n >= 50), "warn").otherwise("ok"))


def node_mentions(mentions: DataFrame) -> DataFrame:
    """``name, type, attr, first_seen, last_seen, mention_count`` of mention rows (name, type, attr, ts)."""
    return mentions.groupBy("name").agg(
        F.min_by("type", "ts").alias("type"), F.min_by("attr", F.when(F.coalesce("attr", F.lit("")) != "", F.col("ts"))).alias("attr"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("mention_count"),
    )

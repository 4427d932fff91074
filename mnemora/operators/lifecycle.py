"""Life of memories: versions, expiry, merging, tiers, profiles. Tables are immutable; an operator
returns the new snapshot, or the rows that it adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .containment import matches
from .filters import important_sentences, is_trivial, topic_classify
from .joins import similar_topic
from .neighbours import connected, nearest_set


def deprecate(mem: DataFrame, changes: DataFrame, asof: float) -> DataFrame:
    """The snapshot in which the ids of ``changes`` (id, successor) are no longer latest. Columns
    superseded_by and changed_at are added. Of several changes of an id the smallest successor counts."""
    c = changes.groupBy("id").agg(F.min("successor").alias("superseded_by"), F.lit(True).alias("_hit"))
    j = mem.join(c, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return j.withColumn("is_latest", F.when(hit, F.lit(False)).otherwise(F.col("is_latest"))).withColumn("changed_at", F.when(hit, F.lit(float(asof)))).drop("_hit")


def versioned_update(mem: DataFrame, updates: DataFrame, asof: float) -> DataFrame:
    """Updates (id, new_id, content) as new latest rows with parent_id where the old row exists, and
    the old rows deprecated in favour of them."""
    known = updates.join(mem.select("id").distinct(), "id", "left_semi")
    old = deprecate(mem, known.select("id", F.col("new_id").alias("successor")), asof).withColumn("parent_id", F.lit(None).cast("long"))
    parent = known.select("id", F.lit(True).alias("had")).distinct()
    new = updates.join(parent, "id", "left").select(F.col("new_id").alias("id"), "content", F.lit(True).alias("is_latest"), F.lit(float(asof)).alias("created_at"), F.when(F.col("had"), F.col("id")).alias("parent_id"))
    return old.unionByName(new, allowMissingColumns=True)


def auto_forget(mem: DataFrame, asof: float, dry_run: bool = False) -> DataFrame:
    """Rows whose forget_after has come are no longer latest, with a reason; dry run: how many."""
    due = F.coalesce(F.col("is_latest") & (F.col("forget_after") <= asof), F.lit(False))
    if dry_run:
        return mem.agg(F.count_if(due).alias("forgotten"), F.count_if(~due).alias("skipped"), F.count(F.lit(1)).alias("scanned"))
    return mem.withColumn("forget_reason", F.when(due, "expired")).withColumn("is_latest", F.when(due, F.lit(False)).otherwise(F.col("is_latest")))


def retention_delete(mem: DataFrame, decisions: DataFrame, max_delete: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The snapshot without the rows to forget, and an audit row (deleted, kept, refused). Beyond
    ``max_delete`` rows nothing is deleted."""
    n = decisions.agg(F.count_if(F.col("decision") == "forget").alias("deleted"), F.count_if(F.col("decision") == "keep").alias("kept"))
    audit = n.withColumn("refused", F.lit(False) if max_delete is None else F.col("deleted") > max_delete)
    gone = decisions.filter("decision = 'forget'").select("id").crossJoin(F.broadcast(audit.filter("not refused").select(F.lit(1).alias("_one")))).select("id")
    return mem.join(gone, "id", "left_anti"), audit


def resolve_conflicts(mem: DataFrame, pairs: DataFrame, asof: float) -> DataFrame:
    """Losers of pairs (winner_id, loser_id) are superseded by their winners."""
    return deprecate(mem, pairs.select(F.col("loser_id").alias("id"), F.col("winner_id").alias("successor")), asof)


def merge_duplicates(mem: DataFrame, pairs: DataFrame, asof: float, dry_run: bool = False) -> DataFrame:
    """Near pairs (winner_id, loser_id) as sets, over any number of pairs: of each set the newest row
    (created_at; ties: the smallest id) stays, and all others are superseded by it. Dry run: ``winner_id,
    loser_id``. Pairs with ids that aren't in mem link their sets and are else left out."""
    sets = connected(pairs.select(F.col("winner_id").alias("a"), F.col("loser_id").alias("b")))
    member = sets.join(mem.select("id", "created_at"), "id")
    best = member.groupBy("root").agg(F.max(F.struct("created_at", F.negate("id").alias("less"))).alias("best"))
    lost = member.join(best, "root").select(F.negate("best.less").alias("winner_id"), F.col("id").alias("loser_id")).filter("winner_id <> loser_id")
    return lost if dry_run else resolve_conflicts(mem, lost, asof)


def topic_heat_tiers(mentions: DataFrame, asof: float, boost: float = 20, half_life_h: float = 12, hot: float = 10, idle_days: float = 7) -> DataFrame:
    """``topic, n, last, heat, tier``: boost for each mention, halved with the time since the last."""
    g = mentions.filter(F.col("ts") <= asof).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    heat = F.col("n") * boost * F.pow(F.lit(0.5), (F.lit(float(asof)) - F.col("last")) / (3600.0 * half_life_h))
    tier = F.when(F.col("heat") >= hot, "hot").when(F.lit(float(asof)) - F.col("last") > idle_days * 86400, "cold").otherwise("warm")
    return g.withColumn("heat", F.round(heat, 4)).withColumn("tier", tier)


def archive_topics(topics: DataFrame, asof: float) -> tuple[DataFrame, DataFrame]:
    """Topics (name, status, tier, ...) without the archived ones, done ones being warm; and archive
    records."""
    live = topics.filter(F.coalesce("status", F.lit("")) != "archived").withColumn("tier", F.when(F.col("status") == "done", "warm").otherwise(F.col("tier")))
    cold = topics.filter("status = 'archived'").select(F.col("name"), F.lit("archive").alias("type"), F.lit(float(asof)).alias("archived_at"))
    return live, cold


# Kinds of facts, with their part of the profile and their heat.
STATIC_FACTS, DYNAMIC_FACTS = ("preference", "fact"), ("task_status", "decision", "tech_find")


def profile_upsert(mem: DataFrame, facts: DataFrame, asof: float, near: float = 0.4, cut: int = 300) -> DataFrame:
    """``fact_id, kind, heat, category, content, action, target``: facts (fact_id, user_id, fact_type,
    content) of a preference or fact are static with heat 30; those of a task, decision or finding are
    dynamic with 25; others dynamic with 15 and of unknown category. A fact within a Jaccard distance of
    ``near`` (under 1) of a memory (id, user_id, kind, content) of its user and kind updates the
    nearest, ties to the smaller id; others are inserted. Facts under five characters are dropped."""
    static, dynamic = F.col("fact_type").isin(list(STATIC_FACTS)), F.col("fact_type").isin(list(DYNAMIC_FACTS))
    kind = F.when(static, "static").otherwise("dynamic")
    heat = F.when(static, 30.0).when(dynamic, 25.0).otherwise(15.0)
    category = F.when(static | dynamic, F.col("fact_type")).otherwise("unknown")
    f = facts.filter(F.length("content") >= 5).select("fact_id", "user_id", kind.alias("kind"), heat.alias("heat"), category.alias("category"), F.substring("content", 1, cut).alias("content"))
    own = f.select(F.col("fact_id").alias("id"), "user_id", "kind", tokenize(F.col("content")).alias("tokens"))
    best = nearest_set(own, mem.select("id", "user_id", "kind", tokenize(F.col("content")).alias("tokens")), 1 - near, ["user_id", "kind"])
    out = f.join(best.select(F.col("id").alias("fact_id"), "target"), "fact_id", "left")
    return out.select("fact_id", "kind", "heat", "category", "content", F.when(F.col("target").isNotNull(), "update").otherwise("insert").alias("action"), "target")


def profile_view(mem: DataFrame, n_static: int = 15, n_dynamic: int = 10) -> DataFrame:
    """``user_id, kind, rank, id, heat``: the hottest of each kind of each user."""
    r = F.row_number().over(W.partitionBy("user_id", "kind").orderBy(F.col("heat").desc(), "id"))
    most = F.when(F.col("kind") == "static", n_static).otherwise(n_dynamic)
    return mem.withColumn("rank", r).filter(F.col("rank") <= most).select("user_id", "kind", F.col("rank").cast("long").alias("rank"), "id", "heat")


def profile_text(view: DataFrame, mem: DataFrame, width: int = 80) -> DataFrame:
    """``user_id, profile, text``: each user's ``profile_view`` nested (kind, items of id, heat, content, the
    hottest first), and as lines."""
    rows = view.join(mem.select("id", F.substring(F.coalesce("content", F.lit("")), 1, width).alias("content")), "id")
    kinds = rows.groupBy("user_id", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "heat", "content"))).alias("items"))
    nested = kinds.groupBy("user_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("kind", "items")))).alias("profile"))  # static first
    line = lambda k: F.concat(k["kind"], F.lit(":\n"), F.array_join(F.transform(k["items"], lambda x: F.concat(F.lit("- "), x["content"])), "\n"))
    return nested.select("user_id", "profile", F.array_join(F.transform("profile", line), "\n").alias("text"))


def profile_decay(mem: DataFrame, asof: float, days: float = 7, least: float = 10, factor: float = 0.85) -> DataFrame:
    """``id, action, heat``: old cool rows are dropped, others get a new version with less heat, not
    under 1."""
    old = (F.lit(float(asof)) - F.col("created_at") > days * 86400) & (F.col("heat") < least)
    return mem.select("id", F.when(old, "deprecate").otherwise("decay").alias("action"), F.when(~old, F.round(F.greatest(F.lit(1.0), F.col("heat") * factor), 6)).alias("heat"))


def restore_sessions(valuable: DataFrame, ses: DataFrame) -> DataFrame:
    """``id, type, topic, content``: up to two records a session that is kept; the topic is its day."""
    kept = valuable.filter("skip_reason is null").join(ses.select("session_id", "started_at"), "session_id")
    topic = F.date_format(F.timestamp_seconds("started_at"), "yyyy-MM-dd")
    side = F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).alias("content")) for t, c in (("user", "user_text"), ("assistant", "assistant_text"))])
    rows = kept.select("session_id", topic.alias("topic"), F.explode(side).alias("s")).filter(F.coalesce("s.content", F.lit("")) != "")
    return rows.select(F.concat(F.lit("restore:"), F.col("session_id").cast("string"), F.lit(":"), "s.type").alias("id"), "s.type", "topic", "s.content")


def rebuild_store(eav: DataFrame, content: DataFrame, keys: list[str]) -> DataFrame:
    """A clean copy: records of the text values of EAV rows with their contents, under new ids."""
    rec = eav.filter(F.col("string_value").isNotNull()).groupBy("id").pivot("key", keys).agg(F.first("string_value"))
    j = content.select("id", "content").join(rec, "id", "left")
    return j.select(F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("content", F.lit(""))), 256), 1, 16).alias("id"), *keys, "content")


def rebuild_written(eav: DataFrame, content: DataFrame, keys: list[str], path: str) -> tuple[DataFrame, DataFrame]:
    """``rebuild_store`` written to a new folder, and its verdict, read back from there: ``expected,
    written, distinct_ids, ok``. The old store is not touched."""
    rebuild_store(eav, content, keys).write.mode("errorifexists").parquet(path)
    fresh = content.sparkSession.read.parquet(path)
    n = content.agg(F.count(F.lit(1)).alias("expected")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("written"), F.count_distinct("id").alias("distinct_ids")))  # a row each
    return fresh, n.withColumn("ok", (F.col("expected") == F.col("written")) & (F.col("written") == F.col("distinct_ids")))


def store_conversation(turns: DataFrame, topics: DataFrame, openings: list[str], asof: float, source: str = "conversation", label: str = "assistant: ", least_heat: float = 10, min_chars: int = 4) -> tuple[DataFrame, DataFrame]:
    """What turns (id, session_id, user_text, assistant_text) leave in the store, over topics (name, heat,
    status): memories (id, role, topic, content, source, tier, created_at) and mentions (topic,
    session_id, ts, summary).

    A turn's topic is the first by name that the user names; else, if the user says nothing (openings),
    one that the beginning of the reply is like (``similar_topic``), or the hottest active one of at
    least ``least_heat``; else the user's own first 30 characters, if they are enough. User texts of over
    two characters that aren't commands are stored, cut at 500, and replies of over five, cut at 200."""
    user, reply = F.trim(F.coalesce("user_text", F.lit(""))), F.trim(F.coalesce("assistant_text", F.lit("")))
    t = turns.select("id", "session_id", user.alias("u"), reply.alias("a"))
    hit = matches(t, topics.select(F.col("name").alias("query_id"), F.col("name").alias("q")), "u", ci=True).groupBy("id").agg(F.min("query_id").alias("hit"))
    like = similar_topic(t.select("id", F.substring("a", 1, 100).alias("content")), topics).withColumnRenamed("topic", "like")
    top = topics.filter((F.col("heat") >= least_heat) & (F.col("status") == "active")).agg(F.max_by("name", F.struct("heat", "name")).alias("top"))
    own = F.substring("u", 1, 30)
    trivial = is_trivial(F.col("u"), openings)
    topic = F.coalesce("hit", F.when(trivial, F.coalesce("like", "top")), F.when(~trivial & (F.length(own) >= min_chars), own))
    j = t.join(hit, "id", "left").join(like, "id", "left").crossJoin(F.broadcast(top)).withColumn("topic", topic)  # one row
    mentions = j.filter(F.col("topic").isNotNull()).select("topic", "session_id", F.lit(float(asof)).alias("ts"), F.concat(F.substring("u", 1, 50), F.lit(" -> "), F.substring("a", 1, 100)).alias("summary"))
    sides = F.array(
        F.when((F.length("u") > 2) & ~F.col("u").startswith("/"), F.struct(F.lit("user").alias("role"), F.substring("u", 1, 500).alias("content"))),
        F.when(F.length("a") > 5, F.struct(F.lit("assistant").alias("role"), F.concat(F.lit(label), F.substring("a", 1, 200)).alias("content"))),
    )
    rows = j.select("id", "topic", F.explode(F.array_compact(sides)).alias("s"))
    return rows.select("id", "s.role", "topic", "s.content", F.lit(source).alias("source"), F.lit("warm").alias("tier"), F.lit(float(asof)).alias("created_at")), mentions


def labelled_turns(turns: DataFrame, last: int = 6, cut: int = 300, least: int = 20) -> DataFrame:
    """``session_id, text``: the last turns of a session that say something, in order, as lines ``role:
    content``, cut; sessions with fewer than ``least`` characters in all are left out."""
    r = F.row_number().over(W.partitionBy("session_id").orderBy(F.col("pos").desc(), F.col("id").desc()))
    near = turns.filter(F.coalesce("content", F.lit("")) != "").withColumn("r", r).filter(F.col("r") <= last)
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.substring("content", 1, cut))
    text = near.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", line.alias("c")))), lambda x: x["c"]), "\n").alias("text"))
    return text.filter(F.length(F.trim("text")) >= least)


def capture_facts(turns: DataFrame, verbs: list[str], tech: list[str], rules: list[tuple[list[str], str]], last: int = 6, cut: int = 300, least: int = 20, most: int = 5) -> DataFrame:
    """``session_id, kind, fact, topic``: of the last turns of a session, as labelled lines, the sentences
    with a verb of decision, then those with a technical term (``important_sentences``), at most ``most``;
    each with the topic of the first rule that it fits."""
    text = labelled_turns(turns, last, cut, least)
    facts = important_sentences(text, verbs, tech, most, "session_id", "text")
    return facts.select(F.col("doc_id").alias("session_id"), "kind", F.col("sentence").alias("fact"), topic_classify(F.col("sentence"), rules).alias("topic"))


def capture_counts(turns: DataFrame, facts: DataFrame, entities: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """``session_id, captured, entities, relations``: how many facts (session_id), entities and relations
    (session_id, one row each) of each session that has turns were captured."""
    count = lambda df, name: df.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
    out = turns.select("session_id").distinct().join(count(facts, "captured"), "session_id", "left").join(count(entities, "entities"), "session_id", "left")
    out = out.join(count(relations, "relations"), "session_id", "left") if relations is not None else out.withColumn("relations", F.lit(0).cast("long"))
    return out.na.fill(0, ["captured", "entities", "relations"])


def correction_fix(log: DataFrame, keyword: str, note: str) -> DataFrame:
    """The log in which open entries whose topic contains the keyword are fixed, with a note."""
    hit = ~F.col("fixed") & F.col("topic").contains(keyword)
    return log.withColumn("note", F.when(hit, note)).withColumn("fixed", F.when(hit, F.lit(True)).otherwise(F.col("fixed")))


def fixed_count(log: DataFrame, keyword: str) -> DataFrame:
    """``fixed``: how many open entries ``correction_fix`` would close."""
    return log.agg(F.count_if(~F.col("fixed") & F.coalesce(F.col("topic").contains(keyword), F.lit(False))).alias("fixed"))


def content_history(versions: DataFrame, key: list[str]) -> DataFrame:
    """``key, n, history``: the contents of each chain of versions, oldest first, as text."""
    h = F.array_sort(F.collect_list(F.struct("created_at", "id", "content")))
    return versions.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(h, lambda x: x["content"]), ">").alias("history"))

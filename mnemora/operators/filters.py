"""Projections, predicates and scans over memories, messages and logs.

Every operator takes DataFrames and returns one; "now" is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .containment import matches

# Types that retention keeps, and columns that only records of the graph fill.
GRAPH_COLUMNS = ("rel_type", "entity_a", "entity_b")
PROTECTED_TYPES = ("decision", "preference", "project_log", "work_log", "resource_locator", "doc_index", "profile_static", "profile_dynamic", "arch_doc")
# Openings of messages that say nothing.
TRIVIAL_OPENINGS = ("测试", "test", "收到", "不回", "hello", "hi", "在吗", "嗯", "哦", "好", "ok", "好的", "是的", "不", "没", "试试", "再试", "啊", "呀", "哈")


def recent_memories(mem: DataFrame, n: int = 10) -> DataFrame:
    """The newest n, ties by id. A top-n, so no full sort."""
    return mem.select("id", "content", "created_at").orderBy(F.col("created_at").desc(), "id").limit(n)


def memory_by_id(mem: DataFrame, ids: DataFrame) -> DataFrame:
    return mem.join(ids.select("id").distinct(), "id", "left_semi")


def append_memory(mem: DataFrame, new: DataFrame, asof: float) -> DataFrame:
    """The snapshot with new rows added: latest, created now, with an id made from the content
    where none is given. Columns that the new rows lack are null."""
    filled = new
    for name, value in (("is_latest", F.lit(True)), ("created_at", F.lit(float(asof)))):
        filled = filled.withColumn(name, F.coalesce(F.col(name), value) if name in new.columns else value)
    if "id" not in new.columns:
        filled = filled.withColumn("id", F.xxhash64("content", F.lit(asof)))
    return mem.unionByName(filled.select(*[c for c in filled.columns if c in mem.columns]), allowMissingColumns=True)


def delete_memories(mem: DataFrame, ids: DataFrame | None = None, user_id: int | None = None) -> DataFrame:
    """The snapshot without the rows of the ids, or of one user."""
    out = mem.join(ids.select("id").distinct(), "id", "left_anti") if ids is not None else mem
    return out if user_id is None else out.filter(~F.coalesce(F.col("user_id") == user_id, F.lit(False)))


def normalize_timestamps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Text columns that hold epoch seconds or ISO times become epoch seconds; what is neither is
    null and stays readable in ``<key>_bad``."""
    for k in keys:
        value = F.coalesce(F.col(k).try_cast("double"), F.unix_micros(F.try_to_timestamp(F.col(k).cast("string"))) / F.lit(1e6))
        bad = F.when(value.isNull() & F.col(k).isNotNull(), F.col(k).cast("string"))
        df = df.withColumn(f"{k}_bad", bad).withColumn(k, value)
    return df


def where_column(where: dict) -> Column:
    """A filter dictionary as a Column: equality, ``$and``, ``$or``, ``$gte``, ``$gt``, ``$lte``,
    ``$lt``, ``$ne``, ``$in``."""
    ops = {"$gte": "__ge__", "$gt": "__gt__", "$lte": "__le__", "$lt": "__lt__", "$ne": "__ne__", "$eq": "__eq__"}
    out = F.lit(True)
    for key, value in where.items():
        if key in ("$and", "$or"):
            part = F.lit(key == "$and")
            for x in value:
                part = part & where_column(x) if key == "$and" else part | where_column(x)
        elif isinstance(value, dict):
            part = F.lit(True)
            for op, v in value.items():
                part = part & (F.col(key).isin(list(v)) if op == "$in" else getattr(F.col(key), ops[op])(v))
        else:
            part = F.col(key) == value
        out = out & part
    return out


def metadata_where(df: DataFrame, where: dict) -> DataFrame:
    return df.filter(where_column(where))


def latest_only(df: DataFrame) -> DataFrame:
    """Rows that aren't superseded; a missing flag counts as latest."""
    return df.filter(F.coalesce(F.col("is_latest"), F.lit(True)))


def user_topic_filter(df: DataFrame, user_id: int, topic: str) -> DataFrame:
    return df.filter((F.col("user_id").isNull() | (F.col("user_id") == user_id)) & (F.col("topic") == topic))


def is_trivial(text: Column, openings=TRIVIAL_OPENINGS) -> Column:
    """Up to three characters, or an opening that says nothing."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.length(t) <= 3
    for p in openings:
        out = out | t.startswith(p.lower())
    return out


def is_trivial_exact(text: Column, phrases: list[str], important: list[str]) -> Column:
    """Under four characters, or exactly a phrase (a full stop may follow) without an important term."""
    from ..functions.text import contains_any

    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    same = t.isin([p.lower() + s for p in phrases for s in ("", "。", ".")])
    return (F.length(t) < 4) | (same & ~contains_any(t, important))


def has_substance(content: Column, role: Column, phrases: list[str], important: list[str], min_len: int = 15) -> Column:
    from ..functions.text import contains_any

    text = F.trim(F.coalesce(content, F.lit("")))
    short = (F.length(text) < min_len) & ~contains_any(text, important)
    return (text != "") & ~((role == "user") & is_trivial_exact(text, phrases, important)) & ~((role == "assistant") & short)


def retention_decisions(mem: DataFrame, asof: float, max_days: int = 30, max_days_no_ts: int = 7, sources: tuple[str, ...] | list[str] = (), types=PROTECTED_TYPES) -> DataFrame:
    """``id, decision, reason`` by the first rule that holds: protected source (those given), protected type,
    record of the graph (any of ``GRAPH_COLUMNS`` filled, of those that mem has), hot or warm with
    content, last mention, creation, else forget."""
    mention, created = F.coalesce("last_mentioned", F.lit(0.0)), F.coalesce("created_at", F.lit(0.0))
    graph = F.lit(False)
    for c in GRAPH_COLUMNS:
        if c in mem.columns:
            graph = graph | (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    rules = [
        (F.col("source").isin(list(sources)), "keep", "protected source"),
        (F.col("type").isin(list(types)), "keep", "protected type"),
        (graph, "keep", "graph record"),
        (F.col("tier").isin("hot", "warm") & (F.coalesce("content", F.lit("")) != ""), "keep", "tier"),
        ((mention > 0) & (mention > asof - max_days * 86400), "keep", "recent mention"),
        (mention > 0, "forget", "old mention"),
        ((created > 0) & (created > asof - max_days_no_ts * 86400), "keep", "recent creation"),
        (created > 0, "forget", "old creation"),
    ]
    decision, reason = F.lit("forget"), F.lit("no timestamp")
    for cond, d, r in reversed(rules):
        hit = F.coalesce(cond, F.lit(False))
        decision, reason = F.when(hit, d).otherwise(decision), F.when(hit, r).otherwise(reason)
    return mem.select("id", decision.alias("decision"), reason.alias("reason"))


def message_predicate(msg: DataFrame, ses: DataFrame, asof: float, horizon_s: float = 2592000, min_messages: int = 2) -> DataFrame:
    """User and assistant messages of the last ``horizon_s`` seconds in sessions that have enough."""
    near = msg.filter(F.col("role").isin("user", "assistant") & (F.col("ts") >= asof - horizon_s))
    return near.join(ses.filter(F.col("message_count") >= min_messages).select("session_id"), "session_id", "left_semi")


def substring_match(df: DataFrame, queries: DataFrame, text: str = "content", ci: bool = False, id_col: str = "id") -> DataFrame:
    """Rows of df with each query (query_id, q) that their text contains. Queries may be many; empty and
    null ones are not found."""
    hits = matches(df, queries, text, ci, id_col).withColumnRenamed("id", "_id")
    return df.join(hits, F.col(id_col) == F.col("_id")).drop("_id").join(queries, "query_id")


def strip_channel_prefix(log: DataFrame) -> DataFrame:
    return log.withColumn("content", F.regexp_replace("content", r"^\[[^\]]*\]\s*", ""))


def classify_channel(session_id: Column, rules: list[tuple[str, str, str]], default: str = "unknown") -> Column:
    """Channel by the first rule (how, text, channel); how: starts or contains."""
    out = F.lit(default)
    for how, text, channel in reversed(rules):
        hit = session_id.startswith(text) if how == "starts" else F.lower(session_id).contains(text)
        out = F.when(hit, channel).otherwise(out)
    return out


def heat_label(heat: Column, tier: Column, hot: float = 30, warm: float = 10, cold: float = 3) -> Column:
    return F.when(heat >= hot, "burning").when(heat >= warm, "warm").when(heat >= cold, "dormant").when(tier == "cold", "cold zone").otherwise("warm zone")


def topic_classify(text: Column, rules: list[tuple[list[str], str]], default: str = "general") -> Column:
    """Topic of the first rule of which the text contains a term."""
    out = F.lit(default)
    for terms, topic in reversed(rules):
        hit = F.lit(False)
        for t in terms:
            hit = hit | text.contains(t)
        out = F.when(F.coalesce(hit, F.lit(False)), topic).otherwise(out)
    return out


def route_by_domain(urls: DataFrame, direct: list[str], proxied: list[str], url: str = "url") -> DataFrame:
    """``url, domain, route``: the last two labels of the host, and direct, proxy or unknown."""
    host = F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.col(url)))
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    ends = lambda names: F.coalesce(F.array_contains(F.array(*[F.col("domain").endswith(x) for x in names]), True), F.lit(False)) if names else F.lit(False)
    return urls.select(F.col(url).alias("url"), domain.alias("domain")).withColumn("route", F.when(ends(direct), "direct").when(ends(proxied), "proxy").otherwise("unknown"))


def clean_payload(raw: Column) -> Column:
    """Bare JSON of a model's answer: without code fences and thinking."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    t = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")).otherwise(t)
    t = F.when(t.contains("</think>"), F.regexp_replace(t, r"(?s)^.*?</think>", "")).when(t.contains("<think>"), F.substring_index(t, "<think>", 1)).otherwise(t)
    return F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))


def extraction_payload_clean(raw: DataFrame, blacklist: list[str], cap: int = 10) -> DataFrame:
    """``id, kind, name, type, attr, src, dst, relation`` of payloads (id, raw): entities that have a
    name that isn't blacklisted, and relations with both ends, under either naming; at most cap
    of each kind. A payload that isn't JSON gives none."""
    schema = "entities array<struct<name:string,type:string,attr:string>>, relations array<struct<`from`:string,`to`:string,source:string,target:string,relation:string>>"
    parsed = raw.select("id", F.from_json(clean_payload(F.col("raw")), schema).alias("j"))
    null = F.lit(None).cast("string")
    ents = F.slice(F.filter(F.coalesce("j.entities", F.array()), lambda e: e["name"].isNotNull() & (F.trim(e["name"]) != "") & ~F.trim(e["name"]).isin(blacklist)), 1, cap)
    pair = F.transform(F.coalesce("j.relations", F.array()), lambda r: F.struct(F.coalesce(r["from"], r["source"]).alias("src"), F.coalesce(r["to"], r["target"]).alias("dst"), r["relation"].alias("relation")))
    rels = F.slice(F.filter(pair, lambda r: r["src"].isNotNull() & r["dst"].isNotNull() & r["relation"].isNotNull()), 1, cap)
    a = parsed.select("id", F.explode(ents).alias("e")).select("id", F.lit("entity").alias("kind"), "e.name", "e.type", "e.attr", null.alias("src"), null.alias("dst"), null.alias("relation"))
    b = parsed.select("id", F.explode(rels).alias("r")).select("id", F.lit("relation").alias("kind"), null.alias("name"), null.alias("type"), null.alias("attr"), "r.src", "r.dst", "r.relation")
    return a.unionByName(b)


def important_sentences(docs: DataFrame, verbs: list[str], tech: list[str], per_doc: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kind, sentence``: sentences with a verb of decision, then those with a technical
    term that don't repeat the first 20 characters of a decision; first five, distinct by 50."""
    from ..functions.text import contains_any

    s = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "[。！？\n.!?]")).alias("pos", "raw"))
    s = s.withColumn("raw", F.trim("raw")).filter((F.length("raw") >= 8) & (F.length("raw") <= 300))
    s = s.withColumn("sentence", F.regexp_replace("raw", "^(user|assistant)[:：]?\\s*", "")).filter(F.length("sentence") > 10)
    decisions = s.filter(contains_any(F.col("sentence"), verbs)).select("doc_id", F.lit(0).alias("k"), "pos", "sentence")
    heads = decisions.select("doc_id", F.substring("sentence", 1, 20).alias("head")).distinct()
    techs = s.filter((F.length("raw") >= 12) & contains_any(F.col("sentence"), tech)).withColumn("head", F.substring("sentence", 1, 20)).join(heads, ["doc_id", "head"], "left_anti")
    both = decisions.unionByName(techs.select("doc_id", F.lit(1).alias("k"), "pos", "sentence"))
    first = F.row_number().over(W.partitionBy("doc_id", "k", F.substring("sentence", 1, 50)).orderBy("pos"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("k", "pos"))
    kept = both.withColumn("f", first).filter("f = 1").withColumn("r", rank).filter(F.col("r") <= per_doc)
    return kept.select("doc_id", F.when(F.col("k") == 0, "decision").otherwise("tech").alias("kind"), "sentence")


def preview_columns(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    return df.select(*[F.substring(F.col(c), 1, widths[c]).alias(c) if c in widths else F.col(c) for c in df.columns])


def placeholder_records(mem: DataFrame) -> DataFrame:
    """Records that a repair left behind: few metadata keys, a repair note, and content (columns
    id, content, extra map)."""
    return mem.filter((F.size("extra") <= 2) & (F.try_element_at("extra", F.lit("note")) == "repair") & (F.length("content") > 5)).select("id", "content")


def clean_metadata(mem: DataFrame, internal: str = "_") -> DataFrame:
    """``id, extra, type``: the map without values that are numbers or empty, and without keys that begin with ``internal``; where
    nothing is left, a type is inferred from the content."""
    kept = F.map_filter("extra", lambda k, v: v.isNotNull() & (v != "") & v.try_cast("double").isNull() & ~k.startswith(internal))
    doc = F.coalesce("content", F.lit(""))
    guess = F.when(doc.startswith("topic:"), "topic").when(doc.contains("->"), "conversation").when(doc != "", "text").otherwise("unknown")
    repaired = F.create_map(F.lit("type"), guess, F.lit("note"), F.lit("repair"))
    out = mem.withColumn("k", kept).withColumn("extra", F.when(F.size("k") == 0, repaired).otherwise(F.col("k")))
    return out.select("id", "extra", F.try_element_at("extra", F.lit("type")).alias("type"))

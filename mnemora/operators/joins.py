"""Joins: lookups, repairs, diffs, duplicates, dictionaries and range lookups.

Sides are broadcast only where they are stated lists (rules, tiers); the rest is left to the
optimiser, which may broadcast by size and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import LATIN_WORD, tokenize
from .containment import containments, matches
from .neighbours import near_pairs


def message_session_join(msg: DataFrame, ses: DataFrame) -> DataFrame:
    return msg.join(ses.select("session_id", "title", "source"), "session_id")


def fulltext_join(msg: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id``: messages that contain a query (query_id, q), whatever the case. Empty and
    null queries are not found."""
    return matches(msg, queries, "content", ci=True)


def orphan_metadata(meta: DataFrame, emb: DataFrame) -> DataFrame:
    return meta.select("id").distinct().join(emb.select("id"), "id", "left_anti")


def complete_records(eav: DataFrame, keys: list[str]) -> DataFrame:
    """Ids that have a row for every key."""
    return eav.filter(F.col("key").isin(keys)).groupBy("id").agg(F.count_distinct("key").alias("n")).filter(F.col("n") == len(keys)).select("id")


def content_by_rowid(eav: DataFrame, content: DataFrame) -> DataFrame:
    value = F.coalesce("string_value", F.col("int_value").cast("string"))
    return eav.select("id", "key", value.alias("value")).join(content.select("id", "content"), "id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def repair_by_lookup(mem: DataFrame, msg: DataFrame, ses: DataFrame, probe: int = 40) -> DataFrame:
    """``id, session_id, source, type``: for each record the first message that contains its first
    ``probe`` characters at any place, and that session's source (unknown without one). Records
    that begin alike are looked up once."""
    p = mem.select("id", F.substring("content", 1, probe).alias("probe"))
    found = containments(msg.select("id", F.col("content").alias("text")), p).groupBy("probe").agg(F.min("id").alias("mid"))
    first = found.join(msg.select(F.col("id").alias("mid"), "session_id"), "mid").groupBy("probe").agg(F.min("session_id").alias("session_id"))
    hit = p.join(first, "probe").select("id", "session_id")
    s = ses.select("session_id", F.coalesce("source", F.lit("cli")).alias("source"))
    out = mem.select("id").join(hit, "id", "left").join(s, "session_id", "left")
    return out.select("id", "session_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.when(F.col("session_id").isNotNull(), "conversation").otherwise("text").alias("type"))


def unprocessed_rows(log: DataFrame, processed: DataFrame, last_id: int) -> DataFrame:
    return log.filter(F.col("id") > last_id).join(processed.select("id"), "id", "left_anti")


def sync_dedupe(log: DataFrame, new: DataFrame) -> DataFrame:
    """New rows to insert: with content, once each, and not in the log by channel, role and content."""
    keys = ["channel", "role", "content"]
    return new.filter(F.trim(F.coalesce("content", F.lit(""))) != "").dropDuplicates(keys).join(log.select(*keys), keys, "left_anti")


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``item, change, severity``: new, missing, content or size between two manifests."""
    x = a.select("item", F.struct("checksum", "size").alias("old"), F.col("severity").alias("s1"))
    y = b.select("item", F.struct("checksum", "size").alias("new"), F.col("severity").alias("s2"))
    j = x.join(y, "item", "full_outer")
    change = (
        F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing")
        .when(~F.col("old.checksum").eqNullSafe(F.col("new.checksum")), "content").when(~F.col("old.size").eqNullSafe(F.col("new.size")), "size")
    )
    return j.select("item", change.alias("change"), F.coalesce("s1", "s2").alias("severity")).filter("change is not null")


def changed_items(cur: DataFrame, cached: DataFrame, listed: DataFrame) -> DataFrame:
    """``item, status``: changed if the hash differs from the cached one, there is none, or the item
    is listed; else skipped."""
    c = cached.select("item", F.col("checksum").alias("was"))
    ls = listed.select("item").distinct().withColumn("listed", F.lit(True))
    j = cur.select("item", "checksum").join(c, "item", "left").join(ls, "item", "left")
    hit = F.coalesce("listed", F.lit(False)) | ~F.col("checksum").eqNullSafe(F.col("was"))
    return j.select("item", F.when(hit, "changed").otherwise("skipped").alias("status"))


def near_duplicate_pairs(vec: DataFrame, meta: DataFrame, threshold: float = 0.08) -> DataFrame:
    """``winner_id, loser_id, distance``: the newer row of a near pair wins, the smaller id at a tie."""
    m = meta.select("id", "created_at")
    if m.filter("created_at is null").isEmpty() and m.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty():
        p = near_pairs(vec.select("id", "v").join(m, "id"), threshold).withColumnsRenamed({"created_at_a": "ca", "created_at_b": "cb"})  # pairs aren't joined
    else:
        p = near_pairs(vec.select("id", "v"), threshold).join(m.select(F.col("id").alias("a"), F.col("created_at").alias("ca")), "a").join(m.select(F.col("id").alias("b"), F.col("created_at").alias("cb")), "b")
    first = F.col("ca") >= F.col("cb")
    return p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner_id"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser_id"), "distance")


def conflict_pairs(vec: DataFrame, threshold: float = 0.15, k: int | None = None) -> DataFrame:
    """``a, b, distance`` of rows of one type (vec: id, v, type), the nearest first."""
    p = near_pairs(vec.select("id", "v", "type"), threshold, key="type").orderBy("distance", "a", "b")
    return p.limit(k) if k else p


def term_hits(docs: DataFrame, terms: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc_id`` with the rows of terms (term in lower case, and more columns) that occur in it. A
    term that is one latin word must be a token of the document; any other (several words, CJK) may
    stand anywhere in the text. The dictionary is asked first whether it has terms of the second
    kind: texts are posted only then. It may be of any size."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokenize(F.col(text))).alias("term"))
    word = F.col("term").rlike(f"^{LATIN_WORD}$")
    own, phrases = t.join(terms.filter(word), "term"), terms.filter(~word & (F.col("term") != ""))
    if phrases.isEmpty():
        return own
    found = containments(docs.select(F.col(id_col).alias("id"), F.lower(text).alias("text")), phrases.select(F.col("term").alias("probe")))
    return own.unionByName(found.select(F.col("id").alias("doc_id"), F.col("probe").alias("term")).join(phrases, "term"))


def dictionary_match(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, term``: documents that hold a term of the dictionary (column term, lower case)."""
    return term_hits(docs, terms.select("term").distinct(), id_col, text).select("doc_id", "term")


def topic_detect(docs: DataFrame, topics: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, topic``: topics (topic, terms array: name and tags) of which a term occurs."""
    terms = topics.select("topic", F.explode("terms").alias("term")).withColumn("term", F.lower("term"))
    return term_hits(docs, terms, id_col, text).select("doc_id", "topic").distinct()


def similar_topic(docs: DataFrame, topics: DataFrame, top: int = 5, id_col: str = "id", text: str = "content") -> DataFrame:
    """``id, topic``: of the ``top`` hottest topics (name, heat), the first whose name is in the text
    or holds a word of it of two characters or more."""
    hot = topics.orderBy(F.col("heat").desc(), "name").limit(top)
    ranked = hot.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("heat").desc(), "name")))  # top rows only
    low = F.lower(F.col(text))
    words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 2)
    pairs = docs.select(F.col(id_col).alias("id"), low.alias("t"), F.array_distinct(words).alias("w")).crossJoin(F.broadcast(ranked))
    name = F.lower("name")
    hit = F.col("t").contains(name) | F.exists("w", lambda x: name.contains(x))
    return pairs.filter(hit).groupBy("id").agg(F.min_by("name", "rank").alias("topic"))


def tier_lookup(value: Column, tiers: list[tuple[float, float]], last: float) -> Column:
    """The threshold of the first tier (max, threshold) that a value fits; null for null or 0."""
    out = F.lit(float(last))
    for top, threshold in sorted(tiers, reverse=True):
        out = F.when(value <= top, float(threshold)).otherwise(out)
    return F.when(value.isNull() | (value == 0), None).otherwise(out)


def edge_exists(new: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges that aren't stored yet, once each."""
    keys = ["from_id", "to_id", "rel_type"]
    return new.dropDuplicates(keys).join(edges.select(*keys), keys, "left_anti")


def cooccurrence_pairs(doc_terms: DataFrame) -> DataFrame:
    """``doc_id, a, b``: pairs a < b of the distinct terms of one document, made inside its row."""
    sets = doc_terms.groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("t"))
    a = sets.select("doc_id", "t", F.posexplode("t").alias("i", "a"))
    return a.select("doc_id", "a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b"))

"""Queries of joins, aggregations, windows, top-k and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import windows as X
from .registry import query
from .views import ASOF, ASOF_EVT, ASOF_MSG

#: Distance below which test vectors count as near (their nearest pairs lie at about 0.5).
NEAR = 0.62
TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[a-z][a-z0-9#+._-]+'))"
DIST = "1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("message_session_join", "SELECT m.id, m.session_id, s.title, s.source FROM v_messages m JOIN v_sessions s ON m.session_id = s.session_id")
def _(v):
    return J.message_session_join(v.v_messages, v.v_sessions).select("id", "session_id", "title", "source")


@query("fulltext_join", "SELECT q.n_nationkey AS query_id, m.id FROM v_messages m JOIN nation q ON contains(lower(m.content), lower(substr(q.n_name, 1, 4)))")
def _(v):
    return J.fulltext_join(v.v_messages, v.nation.select(F.col("n_nationkey").alias("query_id"), F.substring("n_name", 1, 4).alias("q")))


@query("orphan_metadata", "SELECT DISTINCT id FROM v_eav WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def _(v):
    return J.orphan_metadata(v.v_eav, v.embeddings.select(F.col("vec_id").alias("id")))


@query("complete_records", "SELECT DISTINCT a.id FROM v_eav a JOIN v_eav b ON a.id = b.id JOIN v_eav c ON a.id = c.id WHERE a.key = 'source' AND b.key = 'type' AND c.key = 'user_id'")
def _(v):
    return J.complete_records(v.v_eav, ["source", "type", "user_id"])


@query("content_by_rowid", "SELECT e.id, e.key, coalesce(e.string_value, CAST(e.int_value AS STRING)) AS value, coalesce(m.content, '') AS content FROM v_eav e LEFT JOIN v_memories m ON e.id = m.id AND m.id % 5 <> 0 WHERE e.key = 'topic'")
def _(v):
    return J.content_by_rowid(v.v_eav.filter("key = 'topic'"), v.v_memories.filter("id % 5 <> 0"))


@query("repair_by_lookup", """WITH p AS (SELECT id, substr(content, 1, 40) AS probe FROM v_memories), h AS (SELECT p.id, arg_min(m.session_id, m.id) AS session_id FROM p JOIN v_messages m ON contains(m.content, p.probe) WHERE p.probe <> '' GROUP BY p.id)
    SELECT m.id, h.session_id, coalesce(s.source, 'unknown') AS source, CASE WHEN h.session_id IS NOT NULL THEN 'conversation' ELSE 'text' END AS type FROM v_memories m LEFT JOIN h ON h.id = m.id LEFT JOIN v_sessions s ON s.session_id = h.session_id""")
def _(v):
    return J.repair_by_lookup(v.v_memories, v.v_messages, v.v_sessions)


@query("unprocessed_rows", "SELECT id, channel FROM v_channel_log WHERE id > 20000 AND id % 3 <> 0")
def _(v):
    return J.unprocessed_rows(v.v_channel_log, v.v_channel_log.filter("id % 3 = 0"), 20000).select("id", "channel")


@query("sync_dedupe", "SELECT DISTINCT channel, role, content FROM v_channel_log n WHERE trim(content) <> '' AND NOT EXISTS (SELECT 1 FROM v_channel_log o WHERE o.id % 2 = 0 AND o.channel = n.channel AND o.role = n.role AND o.content = n.content)")
def _(v):
    return J.sync_dedupe(v.v_channel_log.filter("id % 2 = 0"), v.v_channel_log).select("channel", "role", "content")


@query("snapshot_diff", """SELECT item, change, severity FROM (SELECT coalesce(a.item, b.item) AS item, coalesce(a.severity, b.severity) AS severity,
    CASE WHEN a.item IS NULL THEN 'new' WHEN b.item IS NULL THEN 'missing' WHEN a.checksum <> b.checksum THEN 'content' WHEN a.size <> b.size THEN 'size' END AS change FROM v_manifest_a a FULL JOIN v_manifest_b b ON a.item = b.item) x WHERE change IS NOT NULL""")
def _(v):
    return J.snapshot_diff(v.v_manifest_a, v.v_manifest_b)


@query("changed_items", "SELECT a.item, CASE WHEN b.item IS NULL OR a.checksum <> b.checksum OR a.item % 29 = 0 THEN 'changed' ELSE 'skipped' END AS status FROM v_manifest_a a LEFT JOIN v_manifest_b b ON a.item = b.item")
def _(v):
    return J.changed_items(v.v_manifest_a, v.v_manifest_b, v.v_manifest_a.filter("item % 29 = 0"))


@query("near_duplicate_pairs", f"""SELECT CASE WHEN ca >= cb THEN a ELSE b END AS winner_id, CASE WHEN ca >= cb THEN b ELSE a END AS loser_id, round(d, 6) AS distance FROM
    (SELECT a.vec_id AS a, b.vec_id AS b, {DIST} AS d, a.vec_id * 37 % 101 AS ca, b.vec_id * 37 % 101 AS cb FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) x WHERE d < {NEAR}""")
def _(v):
    vec = v.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    p = J.near_duplicate_pairs(vec, vec.select("id", (F.col("id") * 37 % 101).alias("created_at")), NEAR)
    return p.withColumn("distance", F.round("distance", 6))


@query("conflict_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({DIST}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label WHERE {DIST} < {NEAR + 0.08}")
def _(v):
    vec = v.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("type"))
    return J.conflict_pairs(vec, NEAR + 0.08).withColumn("distance", F.round("distance", 6))


TERMS_SQL = f"SELECT unnest({TOKENS.format('text')}) AS term FROM benchmark"


def _terms(v):
    """Words of five letters or more of the benchmark texts."""
    return v.benchmark.select(F.explode(T.tokenize(F.col("text"))).alias("term")).filter("length(term) >= 5").distinct()


@query("dictionary_match", f"WITH t AS (SELECT DISTINCT term FROM ({TERMS_SQL}) x WHERE length(term) >= 5), d AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT doc_id, term FROM d JOIN t USING (term)")
def _(v):
    return J.dictionary_match(v.documents, _terms(v))


@query("topic_detect", f"""WITH k AS (SELECT item_id AS topic, unnest({TOKENS.format('text')}) AS term FROM benchmark), d AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents)
    SELECT DISTINCT d.doc_id, CAST(k.topic AS STRING) AS topic FROM d JOIN k USING (term)""")
def _(v):
    topics = v.benchmark.select(F.col("item_id").cast("string").alias("topic"), T.tokenize(F.col("text")).alias("terms"))
    return J.topic_detect(v.documents, topics)


@query("similar_topic", """WITH t AS (SELECT n_name AS name, n_nationkey AS heat, row_number() OVER (ORDER BY n_nationkey DESC, n_name) AS r FROM nation QUALIFY r <= 5),
    w AS (SELECT id, lower(content) AS c, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: length(x) >= 2) AS w FROM v_messages)
    SELECT w.id, arg_min(t.name, t.r) AS topic FROM w, t WHERE contains(w.c, lower(t.name)) OR len(list_filter(w.w, lambda x: contains(lower(t.name), x))) > 0 GROUP BY w.id""".replace("\\\\", "\\"))
def _(v):
    return J.similar_topic(v.v_messages, v.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("heat")))


@query("tier_lookup", "SELECT doc_id, CASE WHEN n_chars = 0 THEN NULL WHEN n_chars <= 500 THEN 0.8 WHEN n_chars <= 2000 THEN 0.65 WHEN n_chars <= 8000 THEN 0.5 ELSE 0.3 END::DOUBLE AS threshold FROM documents")
def _(v):
    return v.documents.select("doc_id", J.tier_lookup(F.col("n_chars"), [(500, 0.8), (2000, 0.65), (8000, 0.5)], 0.3).alias("threshold"))


@query("edge_exists", "SELECT from_id, to_id, rel_type FROM v_edges WHERE length(to_id) % 2 = 0")
def _(v):
    return J.edge_exists(v.v_edges.unionByName(v.v_edges), v.v_edges.filter("length(to_id) % 2 = 1"))


@query("cooccurrence_pairs", f"""WITH t AS (SELECT DISTINCT term FROM ({TERMS_SQL}) x WHERE length(term) >= 5), d AS (SELECT doc_id, term FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) y WHERE term IN (SELECT term FROM t))
    SELECT x.doc_id, x.term AS a, y.term AS b FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.term < y.term""")
def _(v):
    return J.cooccurrence_pairs(J.dictionary_match(v.documents, _terms(v)))


# ---- aggregations


@query("memory_count", "SELECT count(*) AS n FROM v_memories")
def _(v):
    return v.v_memories.agg(F.count(F.lit(1)).alias("n"))


@query("forget_preview", f"""WITH g AS (SELECT * FROM v_memories WHERE NOT (source IN ('src0', 'src1') OR type = 'decision' OR (tier IN ('hot', 'warm') AND coalesce(content, '') <> ''))
      AND CASE WHEN coalesce(last_mentioned, 0) > 0 THEN last_mentioned <= {ASOF - 30 * 86400} ELSE created_at <= {ASOF - 7 * 86400} END)
    SELECT 'source' AS dim, source AS value, count(*) AS n FROM g GROUP BY source UNION ALL SELECT 'type', type, count(*) FROM g GROUP BY type
    UNION ALL SELECT 'age', CASE WHEN created_at > {ASOF - 7 * 86400} THEN 'recent' ELSE 'old' END AS x, count(*) FROM g GROUP BY x
    UNION ALL SELECT * FROM (SELECT 'topic', topic, count(*) AS c FROM g GROUP BY topic ORDER BY c DESC, topic LIMIT 15) t""")
def _(v):
    return A.forget_preview(v.v_memories, P.retention_decisions(v.v_memories, ASOF, sources=("src0", "src1")), ASOF)


@query("type_source_distribution", "SELECT 'type' AS dim, type AS value, count(*) AS n FROM v_memories GROUP BY type UNION ALL SELECT 'source', source, count(*) FROM v_memories GROUP BY source")
def _(v):
    return A.dimension_counts(v.v_memories, ["type", "source"])


PROFILE_SQL = """SELECT key, count(*) AS total, count(string_value) AS n_str, count(*) FILTER (string_value IS NULL AND float_value IS NOT NULL) AS n_float, count(*) FILTER (string_value IS NULL AND int_value IS NOT NULL) AS n_int FROM v_eav GROUP BY key"""


@query("metadata_type_profile", f"SELECT *, CASE WHEN n_str > 0 AND n_float > 0 THEN 'mixed' WHEN n_str > 0 THEN 'string' WHEN n_float > 0 THEN 'float' ELSE 'int' END AS class FROM ({PROFILE_SQL}) p")
def _(v):
    return A.metadata_type_profile(v.v_eav)


@query("damage_ratio", f"SELECT key, n_float AS bad, total, round(n_float / total, 4) AS ratio FROM ({PROFILE_SQL}) p WHERE n_str > 0 AND n_float > 0")
def _(v):
    return A.damage_ratio(v.v_eav)


@query("relation_stats", "SELECT type, count(*) AS total, count(*) FILTER (active) AS active FROM v_relations GROUP BY ROLLUP (type)")
def _(v):
    return A.relation_stats(v.v_relations)


@query("graph_stats", "SELECT (SELECT count(*) FROM (SELECT from_id FROM v_edges UNION SELECT to_id FROM v_edges) n) AS nodes, (SELECT count(*) FROM v_edges) AS edges")
def _(v):
    return A.graph_stats(v.v_edges)


CORR_SQL = f"SELECT topic, count(*) AS n, count(*) FILTER (NOT fixed) AS unfixed, count(*) >= 2 AS repeated FROM v_corrections WHERE ts >= {ASOF_EVT - 7 * 86400} AND ts <= {ASOF_EVT} GROUP BY topic"


@query("corrections_summary", CORR_SQL)
def _(v):
    return A.corrections_summary(v.v_corrections, ASOF_EVT)


@query("experience_patterns", "SELECT topic AS scene, count(*) AS n FROM v_corrections GROUP BY topic HAVING count(*) >= 50")
def _(v):
    return A.experience_patterns(v.v_corrections, "topic", 50)


ZONE_SQL = "SELECT p_brand AS zone, count(CASE WHEN p_size > 10 AND p_brand <> 'Brand#11' THEN p_partkey END) AS n FROM part GROUP BY p_brand"


def _zones(v):
    items = v.part.select(F.col("p_brand").alias("zone"), F.when((F.col("p_size") > 10) & (F.col("p_brand") != "Brand#11"), F.col("p_partkey")).alias("item"))
    return A.zone_health(items, {"Brand#12": 5, "Brand#13": 20})


@query("zone_health", f"SELECT zone, n, CASE WHEN n = 0 THEN 'empty' WHEN zone = 'Brand#12' AND n > 5 OR zone = 'Brand#13' AND n > 20 THEN 'crowded' END AS alert FROM ({ZONE_SQL}) z")
def _(v):
    return _zones(v)


@query("reflection_report", f"""WITH c AS ({CORR_SQL}), z AS (SELECT zone, CASE WHEN n = 0 THEN 'empty' WHEN zone = 'Brand#12' AND n > 5 OR zone = 'Brand#13' AND n > 20 THEN 'crowded' END AS alert FROM ({ZONE_SQL}) y),
    p AS (SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) l WHERE contains(line, 'reserved') AND length(trim(line)) > 3)
    SELECT 1 AS priority, 'repeated: ' || string_agg(topic, ',' ORDER BY topic) AS alert FROM c WHERE repeated UNION ALL SELECT 2, CAST(sum(unfixed) AS BIGINT) || ' unfixed' FROM c
    UNION ALL SELECT 3, zone || ': ' || alert FROM z WHERE alert IS NOT NULL UNION ALL SELECT 4, n || ' pending' FROM p WHERE n > 0""")
def _(v):
    from ..sources.ingest import scan_pending_lines

    return A.reflection_report(A.corrections_summary(v.v_corrections, ASOF_EVT), _zones(v), scan_pending_lines(v.documents, ["reserved"]))


IMPORTANT = ["ungkeit", "tionth"]
SUB_SQL = """(t <> '' AND NOT (role = 'user' AND (length(t) < 4 OR (t IN ('ok', 'ok.', 'ok。') AND NOT imp))) AND NOT (role = 'assistant' AND length(t) < 15 AND NOT imp))"""
SCORE_SQL = f"""SELECT session_id, count(*) AS total, sum(CASE WHEN {SUB_SQL} THEN 1 ELSE 0 END + CASE WHEN imp THEN 2 ELSE 0 END)::BIGINT AS meaningful FROM
    (SELECT session_id, role, lower(trim(coalesce(content, ''))) AS t, contains(lower(coalesce(content, '')), 'ungkeit') OR contains(lower(coalesce(content, '')), 'tionth') AS imp FROM v_messages WHERE role IN ('user', 'assistant')) m GROUP BY session_id"""


@query("session_value_score", f"SELECT *, round(meaningful / total, 4) AS score, meaningful / total >= 0.3 AS keep FROM ({SCORE_SQL}) s")
def _(v):
    return A.session_value_score(v.v_messages, P.has_substance(F.col("content"), F.col("role"), ["ok"], IMPORTANT), IMPORTANT)


# the list is a fixed value; in the SQL it is spelt out, with a full stop or not
SAID = "role = 'user' AND NOT (length(trim(coalesce(content, ''))) < 4 OR lower(trim(content)) IN ('thanks', 'thanks.', 'thanks。', 'okay then', 'okay then.', 'okay then。') AND NOT contains(lower(content), 'license'))"
VALUABLE_SQL = f"""SELECT s.session_id, s.title, substr(g.u, 1, 2000) AS user_text, substr(g.a, 1, 2000) AS assistant_text, g.user_count, g.assistant_count,
    CASE WHEN s.source = 'cron' THEN 'cron' WHEN g.user_count IS NULL THEN 'empty' WHEN g.u = '' AND g.a = '' THEN 'trivial' WHEN length(g.u) < 10 THEN 'too_short' END AS skip_reason
    FROM v_sessions s LEFT JOIN (SELECT session_id,
      coalesce(string_agg(substr(trim(content), 1, 300), chr(10) ORDER BY pos) FILTER ({SAID}), '') AS u,
      coalesce(string_agg(substr(trim(content), 1, 500), chr(10) ORDER BY pos) FILTER (role = 'assistant' AND length(trim(content)) >= 15), '') AS a,
      count(*) FILTER ({SAID}) AS user_count, count(*) FILTER (role = 'assistant' AND length(trim(content)) >= 15) AS assistant_count
      FROM v_messages GROUP BY session_id) g ON s.session_id = g.session_id"""


def _valuable(v):
    return A.valuable_sessions(v.v_sessions, v.v_messages, ["thanks", "okay then"], ["license"])


@query("valuable_sessions", VALUABLE_SQL)
def _(v):
    return _valuable(v)


@query("skip_reason_counts", f"SELECT coalesce(skip_reason, 'kept') AS reason, count(*) AS n FROM ({VALUABLE_SQL}) x GROUP BY reason")
def _(v):
    return A.skip_reason_counts(_valuable(v))


@query("restore_preview", f"""SELECT day, sessions, chars, floor(chars * 1.5)::BIGINT AS est_tokens FROM (SELECT strftime(to_timestamp(s.started_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS sessions, sum(length(user_text) + length(assistant_text))::BIGINT AS chars
    FROM ({VALUABLE_SQL}) x JOIN v_sessions s ON s.session_id = x.session_id WHERE skip_reason IS NULL GROUP BY day) y""")
def _(v):
    return A.restore_preview(_valuable(v), v.v_sessions)


@query("findings_summary", "SELECT 'total' AS dim, NULL::VARCHAR AS value, count(*) AS n FROM v_findings UNION ALL SELECT 'severity', severity, count(*) FROM v_findings GROUP BY severity UNION ALL SELECT 'tool', tool, count(*) FROM v_findings GROUP BY tool")
def _(v):
    return A.findings_summary(v.v_findings)


@query("quality_metrics", """SELECT count(*) AS issues, count(*) FILTER (code LIKE 'E%') AS errors, count(*) FILTER (code LIKE 'W%') AS warnings, count(*) FILTER (code LIKE 'S%') AS security,
    round(avg(value), 2) AS avg_complexity, max(value) AS max_complexity, count(*) FILTER (value >= 11) AS complex_funcs, count(*) FILTER (severity = 'high') AS high FROM v_findings""")
def _(v):
    return A.quality_metrics(v.v_findings)


@query("distinct_topics", "SELECT DISTINCT 'topic' AS dim, topic AS value FROM v_memories UNION ALL SELECT DISTINCT 'tier', tier FROM v_memories UNION ALL SELECT DISTINCT 'source', source FROM v_memories")
def _(v):
    return A.dimension_counts(v.v_memories, ["topic", "tier", "source"]).select("dim", "value")


@query("session_messages_nested", "SELECT session_id, title, string_agg(role || ':' || length(content), ',' ORDER BY pos) AS messages FROM (SELECT m.*, s.title FROM v_messages m JOIN v_sessions s ON m.session_id = s.session_id WHERE contains(m.content, 'the')) x GROUP BY session_id, title")
def _(v):
    hits = J.message_session_join(v.v_messages.filter("contains(content, 'the')"), v.v_sessions)
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",")
    return A.session_messages_nested(hits).select("session_id", "title", flat.alias("messages"))


@query("mean_pool_normalize", """WITH m AS (SELECT label AS "group", i - 1 AS pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e GROUP BY ALL)
    SELECT "group", pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY "group")), 6) AS value FROM m""")
def _(v):
    return A.mean_pool_normalize(v.embeddings.withColumnRenamed("embedding", "v"), "label").select("group", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("severity_rollup", """WITH c AS (SELECT coalesce(a.severity, b.severity) AS severity FROM v_manifest_a a FULL JOIN v_manifest_b b ON a.item = b.item WHERE a.item IS NULL OR b.item IS NULL OR a.checksum <> b.checksum OR a.size <> b.size)
    SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, 'FAIL' AS status FROM c""")
def _(v):
    return A.severity_rollup(J.snapshot_diff(v.v_manifest_a, v.v_manifest_b))


@query("tier_stats", "SELECT tier AS name, count(*) AS n FROM v_memories GROUP BY tier UNION ALL SELECT 'memories', count(*) FROM v_memories")
def _(v):
    return v.v_memories.groupBy(F.col("tier").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(A.scalar_rows(v.spark, {"memories": v.v_memories}))


@query("status_overview", "SELECT 'memories' AS name, count(*) AS n FROM v_memories UNION ALL SELECT 'edges', count(*) FROM v_edges UNION ALL SELECT 'messages', count(*) FROM v_messages UNION ALL SELECT 'nodes', count(*) FROM (SELECT from_id FROM v_edges UNION SELECT to_id FROM v_edges) n")
def _(v):
    nodes = v.v_edges.select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct()
    return A.scalar_rows(v.spark, {"memories": v.v_memories, "nodes": nodes, "edges": v.v_edges, "messages": v.v_messages})


@query("store_health", """WITH r AS (SELECT 'metadata' AS "check", count(*) AS value FROM v_eav UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'orphans', count(DISTINCT id) FROM v_eav WHERE id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'mixed_keys', 1
      UNION ALL SELECT 'text_times', count(*) FILTER (key IN ('created_at', 'source') AND string_value IS NOT NULL) FROM v_eav UNION ALL SELECT 'queue', count(*) FILTER (NOT fixed) FROM v_corrections)
    SELECT *, CASE WHEN "check" IN ('orphans', 'mixed_keys') AND value > 10 OR "check" = 'text_times' AND value > 0 OR "check" = 'queue' AND value >= 500 THEN 'fail' WHEN "check" = 'queue' AND value >= 50 THEN 'warn' WHEN "check" IN ('orphans', 'mixed_keys') AND value > 0 THEN 'warn' ELSE 'ok' END AS status FROM r""")
def _(v):
    return A.store_health(v.v_eav, v.embeddings.select(F.col("vec_id").alias("id")), v.v_corrections.filter("not fixed"), ["created_at", "source"])


@query("node_mentions", "SELECT topic AS name, arg_min(CAST(session_id AS STRING), id) AS type, arg_min(CAST(id AS STRING), id) FILTER (id % 4 = 0) AS attr, min(id) AS first_seen, max(id) AS last_seen, count(*) AS mention_count FROM v_mentions GROUP BY topic")
def _(v):
    m = v.v_mentions.select(F.col("topic").alias("name"), F.col("session_id").cast("string").alias("type"), F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).otherwise("").alias("attr"), F.col("id").alias("ts"))
    return A.node_mentions(m)


THRESHOLDS = {"issues": 5.0, "avg_complexity": 0.3, "high_severity": 1.0}
REGRESSION_SQL = """WITH l AS (SELECT day, 'issues' AS metric, issues AS cur, 5.0 AS t FROM v_metrics UNION ALL SELECT day, 'avg_complexity', avg_complexity, 0.3 FROM v_metrics UNION ALL SELECT day, 'high_severity', high_severity, 1.0 FROM v_metrics),
    p AS (SELECT *, lag(cur) OVER (PARTITION BY metric ORDER BY day) AS prev FROM l), d AS (SELECT *, round(cur - prev, 6) AS delta FROM p WHERE prev IS NOT NULL)
    SELECT day, metric, prev, cur, delta, CASE WHEN delta > t THEN 'worse' WHEN delta < -t THEN 'better' ELSE 'stable' END AS verdict FROM d"""


@query("metric_report", REGRESSION_SQL.replace("SELECT day, metric, prev, cur, delta, CASE", "SELECT metric, cur AS value, CASE") + " QUALIFY row_number() OVER (PARTITION BY metric ORDER BY day DESC) = 1")
def _(v):
    return X.metric_report(v.v_metrics, THRESHOLDS)


@query("metric_regression", REGRESSION_SQL)
def _(v):
    return X.metric_regression(v.v_metrics, THRESHOLDS)


# ---- windows


@query("latest_hit_per_session", "SELECT id, session_id FROM v_messages WHERE contains(content, 'the') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) = 1")
def _(v):
    return X.latest_hit_per_session(v.v_messages.filter("contains(content, 'the')")).select("id", "session_id")


@query("best_score_per_content", "SELECT id, heat AS score FROM v_memories QUALIFY row_number() OVER (PARTITION BY substr(coalesce(content, ''), 1, 50) ORDER BY heat DESC, id) = 1")
def _(v):
    return X.best_score_per_content(v.v_memories.withColumn("score", F.col("heat"))).select("id", "score")


@query("last_turns", f"SELECT id, session_id FROM (SELECT *, max(ts) OVER (PARTITION BY session_id) AS l FROM v_messages) x WHERE l >= {ASOF_MSG - 400000} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) <= 3")
def _(v):
    return X.last_turns(v.v_messages, ASOF_MSG, 3, 400000).select("id", "session_id")


@query("last_assistant_message", "SELECT session_id, substr(arg_max(content, pos), 1, 150) AS content FROM v_messages WHERE role = 'assistant' AND length(content) > 10 AND session_id IN (SELECT session_id FROM v_sessions ORDER BY started_at DESC, session_id LIMIT 3) GROUP BY session_id")
def _(v):
    return X.last_assistant_message(v.v_messages, v.v_sessions)


@query("first_messages", "SELECT id, session_id FROM v_messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos, id) <= 2")
def _(v):
    return X.first_messages(v.v_messages, 2).select("id", "session_id")


@query("first_messages_or_recent", """WITH a AS (SELECT DISTINCT doc_id AS asked_id FROM documents WHERE doc_id % 20 = 0), h AS (SELECT DISTINCT session_id FROM v_messages),
    c AS (SELECT asked_id, coalesce(h.session_id, (SELECT arg_max(session_id, started_at) FROM v_sessions)) AS session_id FROM a LEFT JOIN h ON h.session_id = asked_id)
    SELECT asked_id, m.id, m.session_id FROM c JOIN (SELECT * FROM v_messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos, id) <= 2) m ON m.session_id = c.session_id""")
def _(v):
    ids = v.documents.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("session_id"))
    return X.first_messages_or_recent(v.v_messages, v.v_sessions, ids, 2).select("asked_id", "id", "session_id")


@query("snapshot_retention", "SELECT day AS snap, CASE WHEN row_number() OVER (ORDER BY day DESC) <= 7 THEN 'keep' ELSE 'expire' END AS action FROM v_metrics")
def _(v):
    return X.snapshot_retention(v.v_metrics.select(F.col("day").alias("snap")))


@query("last_session_ids", """WITH f AS (SELECT topic, session_id, min(ts) AS first FROM v_mentions GROUP BY ALL), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY topic ORDER BY first DESC, session_id DESC) <= 20)
    SELECT topic, string_agg(CAST(session_id AS STRING), ',' ORDER BY first, session_id) AS session_ids FROM k GROUP BY topic""")
def _(v):
    return X.last_session_ids(v.v_mentions)


@query("recent_unanswered", "SELECT id FROM (SELECT id FROM v_channel_log WHERE channel = 'chat' AND role = 'user' ORDER BY id DESC LIMIT 10) x WHERE id % 2 = 0")
def _(v):
    return X.recent_unanswered(v.v_channel_log, v.v_channel_log.filter("id % 2 = 1"), "chat").select("id")


@query("first_wins_dedupe", "SELECT source, topic, min(id) AS id FROM v_memories GROUP BY source, topic")
def _(v):
    return X.first_wins_dedupe(v.v_memories, ["source", "topic"], ["id"]).select("source", "topic", "id")


# ---- top-k and sets


@query("hot_topics", "SELECT id, heat FROM v_memories WHERE tier = 'hot' AND is_latest")
def _(v):
    return P.latest_only(v.v_memories).filter("tier = 'hot'").select("id", "heat").orderBy(F.col("heat").desc(), "id")


@query("hottest_topic", "SELECT topic AS name, count(*)::DOUBLE AS heat FROM v_mentions GROUP BY topic ORDER BY heat DESC, name LIMIT 1")
def _(v):
    return X.hottest_topic(v.v_mentions.groupBy(F.col("topic").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("heat")))


@query("top_counts", "SELECT source, count(*) AS n FROM v_memories GROUP BY source ORDER BY n DESC, source LIMIT 15")
def _(v):
    return X.top_counts(v.v_memories, "source", 15)


@query("union_strategies", "SELECT id, heat AS score, 'a' AS leg FROM v_memories WHERE tier = 'hot' UNION ALL SELECT id, NULL, 'b' FROM v_memories WHERE type = 'text'")
def _(v):
    a = v.v_memories.filter("tier = 'hot'").select("id", F.col("heat").alias("score"), F.lit("a").alias("leg"))
    return X.union_strategies(a, v.v_memories.filter("type = 'text'").select("id", F.lit("b").alias("leg")))


@query("union_sources", "SELECT CAST(session_id AS STRING) AS session_id, role, content AS text FROM v_messages UNION ALL SELECT 'doc', source, substr(text, 1, 20) FROM documents")
def _(v):
    a = v.v_messages.select(F.col("session_id").cast("string").alias("session_id"), "role", F.col("content").alias("text"))
    return X.union_strategies(a, v.documents.select(F.lit("doc").alias("session_id"), F.col("source").alias("role"), F.substring("text", 1, 20).alias("text")))


@query("token_intersect_union", f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) SELECT a.doc_id, len(list_intersect(a.t, b.t))::BIGINT AS shared, len(list_distinct(a.t || b.t))::BIGINT AS total FROM t a JOIN t b ON b.doc_id = a.doc_id + 7""")
def _(v):
    t = v.documents.select("doc_id", T.tokenize(F.col("text")).alias("t"))
    j = t.join(t.select((F.col("doc_id") - 7).alias("doc_id"), F.col("t").alias("u")), "doc_id")
    return j.select("doc_id", F.size(F.array_intersect("t", "u")).cast("long").alias("shared"), F.size(F.array_union("t", "u")).cast("long").alias("total"))


@query("new_entities", "SELECT DISTINCT p_name AS name FROM part p WHERE p_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM part k WHERE k.p_partkey % 50 = 1 AND contains(k.p_name, p.p_name))")
def _(v):
    name = v.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))
    return X.new_entities(name.filter("k % 2 = 0"), name.filter("k % 50 = 1").distinct())


@query("merge_distinct", "SELECT from_id, to_id FROM v_edges UNION SELECT to_id, from_id FROM v_edges")
def _(v):
    a = v.v_edges.select("from_id", "to_id")
    return a.unionByName(a.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).distinct()

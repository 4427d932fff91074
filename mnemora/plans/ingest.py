"""Queries of sources, sinks, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as P
from ..operators.lifecycle import retention_delete
from ..sources import ingest as S
from ..sources.paths import shared_path
from .registry import query
from .views import ASOF, ASOF_MSG, EPOCH

PHRASES, IMPORTANT = ["ok", "the", "la"], ["ungkeit", "tionth", "ción"]
#: One digit of width for the SQL twins of lists.
PHRASE_SQL = "('ok','the','la','ok.','the.','la.')"


@query("scan_memories", "SELECT id, topic, source, type, tier, heat, created_at FROM v_memories")
def _(v):
    return v.v_memories.select("id", "topic", "source", "type", "tier", "heat", "created_at")


@query("recent_memories", "SELECT id, content, created_at FROM v_memories ORDER BY created_at DESC, id LIMIT 10")
def _(v):
    return P.recent_memories(v.v_memories, 10)


@query("memory_by_id", "SELECT id, content FROM v_memories WHERE id IN (SELECT item_id FROM benchmark)")
def _(v):
    return P.memory_by_id(v.v_memories, v.benchmark.select(F.col("item_id").alias("id"))).select("id", "content")


@query("append_memory", f"""SELECT id, content, is_latest, created_at, type FROM v_memories UNION ALL
    SELECT item_id + 1000000000, text, true, {ASOF}.0::DOUBLE, 'benchmark' FROM benchmark""")
def _(v):
    new = v.benchmark.select((F.col("item_id") + 1000000000).alias("id"), F.col("text").alias("content"), F.lit("benchmark").alias("type"))
    return P.append_memory(v.v_memories, new, ASOF).select("id", "content", "is_latest", "created_at", "type")


@query("delete_memories", "SELECT id, user_id FROM v_memories WHERE id NOT IN (SELECT item_id FROM benchmark) AND user_id <> 3")
def _(v):
    return P.delete_memories(v.v_memories, v.benchmark.select(F.col("item_id").alias("id")), user_id=3).select("id", "user_id")


@query("sessions_messages", "SELECT session_id, count(*) AS message_count, min(ts) AS started_at FROM v_messages GROUP BY session_id")
def _(v):
    return S.sessions_messages(v.v_messages)[0]


@query("transcripts_jsonl", """SELECT session_id, role, content AS text, CAST(CAST(ts AS BIGINT) AS STRING) AS ts FROM v_messages WHERE pos % 7 <> 6 AND length(content) > 0""")
def _(v):
    half = F.floor(F.length("content") / 2).cast("int")
    block = lambda a: F.struct(F.lit("text").alias("type"), a.alias("text"))
    blocks = F.array(block(F.substring("content", F.lit(1), half)), block(F.substring("content", half + 1, F.length("content"))))
    data = F.when(F.col("pos") % 2 == 0, F.struct(blocks.alias("content"), F.lit(None).cast("struct<content:array<struct<type:string,text:string>>>").alias("message"))).otherwise(
        F.struct(F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"), F.struct(blocks.alias("content")).alias("message"))
    )
    line = F.to_json(F.struct(F.col("role").alias("type"), F.col("ts").cast("long").cast("string").alias("time"), data.alias("data")))
    lines = v.v_messages.select("session_id", F.when(F.col("pos") % 7 == 6, F.lit("{broken")).otherwise(line).alias("line"))
    return S.transcripts_jsonl(lines)


@query("channel_log_recent", "SELECT * FROM (SELECT id, channel, role, ts FROM v_channel_log WHERE channel IN ('chat', 'web') ORDER BY id DESC LIMIT 80) x")
def _(v):
    return S.channel_log_recent(v.v_channel_log, 80, ["chat", "web"]).select("id", "channel", "role", "ts")


@query("channel_log_append", f"""SELECT id, channel, role, content, ts FROM v_channel_log UNION ALL
    SELECT (SELECT max(id) FROM v_channel_log) + row_number() OVER (ORDER BY text), 'import', 'user', substr(text, 1, 100), {ASOF_MSG}.0::DOUBLE FROM benchmark""")
def _(v):
    new = v.benchmark.select(F.lit("import").alias("channel"), F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(None).cast("double").alias("ts"))
    return S.channel_log_append(v.v_channel_log, new, ASOF_MSG, max_chars=100)


@query("eav_to_rows", """SELECT id, max(CASE WHEN key = 'type' THEN x END) AS type, max(CASE WHEN key = 'source' THEN x END) AS source, max(CASE WHEN key = 'user_id' THEN x END) AS user_id
    FROM (SELECT id, key, coalesce(string_value, CAST(int_value AS STRING), CAST(float_value AS STRING)) AS x FROM v_eav) e GROUP BY id""")
def _(v):
    return S.eav_to_rows(v.v_eav.filter("key in ('type', 'source', 'user_id')"), ["type", "source", "user_id"])


@query("merge_graph_batches", """WITH e AS (SELECT DISTINCT from_id AS source, to_id AS target, rel_type AS type FROM v_edges),
    n AS (SELECT to_id AS id, min(from_id) AS name FROM v_edges GROUP BY to_id),
    d AS (SELECT DISTINCT source AS id FROM e WHERE source NOT IN (SELECT id FROM n))
    SELECT 'node' AS kind, id, name, NULL::VARCHAR AS type FROM n UNION ALL SELECT 'node', id, 'root', NULL FROM d UNION ALL SELECT 'edge', source, target, type FROM e""")
def _(v):
    nodes = v.v_edges.select(F.col("from_id").alias("file"), F.col("to_id").alias("pos"), F.col("to_id").alias("id"), F.col("from_id").alias("name"))
    n, e = S.merge_graph_batches(nodes, v.v_edges.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.col("rel_type").alias("type")))
    return n.select(F.lit("node").alias("kind"), "id", "name", F.lit(None).cast("string").alias("type")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), F.col("target").alias("name"), "type"))


@query("metric_history_append", """SELECT * FROM v_metrics WHERE day <> '2024-01-15' UNION ALL SELECT '2024-01-15', 1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE
    UNION ALL SELECT '2024-02-15', 4.0, 5.0, 6.0""")
def _(v):
    new = v.v_metrics.limit(1).select(F.explode(F.expr("array(named_struct('day', '2024-01-15', 'issues', 1D, 'avg_complexity', 2D, 'high_severity', 3D), named_struct('day', '2024-02-15', 'issues', 4D, 'avg_complexity', 5D, 'high_severity', 6D))")).alias("r")).select("r.*")
    return S.metric_history_append(v.v_metrics, new)


@query("zones_to_records", """SELECT p_size AS desk, p_brand AS zone, p_name AS project, p_type AS status, p_name || ' ' || p_type || ' ' || p_name || ' | ' || p_brand AS content FROM part""")
def _(v):
    item = F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("status"), F.array("p_name", "p_brand").alias("points"))
    zones = v.part.groupBy("p_size", "p_brand").agg(F.collect_list(item).alias("items")).groupBy(F.col("p_size").alias("desk")).agg(F.collect_list(F.struct(F.col("p_brand").alias("zone"), "items")).alias("zones"))
    return S.zones_to_records(zones)


@query("registry_fanout", """WITH p AS (SELECT CAST(s_suppkey AS STRING) AS project, s_name AS title FROM supplier),
    r AS (SELECT 'reg:' || project AS id, title AS content, 'registry' AS type, project FROM p
      UNION ALL SELECT 'doc:' || project || ':' || i, title || ' doc ' || i, 'doc_index', project FROM p, range(2) t(i)
      UNION ALL SELECT 'log:' || project || ':0', title || ' log', 'work_log', project FROM p
      UNION ALL SELECT 'reg:', count(*) || ' projects, ' || 2 * count(*) || ' documents, ' || count(*) || ' logs', 'registry', NULL FROM p)
    SELECT id, content, type, project FROM r WHERE id NOT IN (SELECT 'reg:' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 3 = 0)
    UNION ALL SELECT id, 'reg:' || project, 'edge', 'related' FROM r WHERE type = 'work_log'""")
def _(v):
    p = v.supplier.select(F.col("s_suppkey").cast("string").alias("project"), F.col("s_name").alias("title"), F.transform(F.array(F.lit("0"), F.lit("1")), lambda i: F.concat("s_name", F.lit(" doc "), i)).alias("docs"), F.array(F.concat("s_name", F.lit(" log"))).alias("logs"))
    old = v.supplier.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("reg:"), F.col("s_suppkey").cast("string")).alias("id"))
    new, edges = S.registry_fanout(p, old)
    return new.unionByName(edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("content"), F.lit("edge").alias("type"), F.col("rel_type").alias("project")))


@query("scan_pending_lines", """SELECT doc_id AS file, trim(line) AS line, m AS keyword FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l,
    (VALUES ('TODO'), ('license'), ('reserved'), ('token')) k(m) WHERE length(trim(line)) > 3 AND contains(line, m)""")
def _(v):
    return S.scan_pending_lines(v.documents, ["TODO", "license", "reserved", "token"])


@query("reflection_history", """SELECT day, issues AS total, CASE WHEN issues > 60 THEN 'many issues' END AS issue FROM v_metrics WHERE day BETWEEN '2024-01-12' AND '2024-01-15'""")
def _(v):
    refl = v.v_metrics.select("day", F.col("issues").alias("total"), F.when(F.col("issues") > 60, F.array(F.lit("many issues"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    return S.reflection_history(refl, "2024-01-15", 3)


@query("page_body_extract", r"""WITH b AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
      trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '\s+', ' ', 'g')) AS body FROM pages)
    SELECT page_id, title, body, length(body) AS n_chars FROM b WHERE length(body) > 100""")
def _(v):
    return S.page_body_extract(v.pages)


@query("page_markdown", r"""WITH b AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
      trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '\s+', ' ', 'g')) AS body FROM pages)
    SELECT page_id, '# ' || title || chr(10) || chr(10) || body AS markdown FROM b WHERE length(body) > 200""")
def _(v):
    return S.page_markdown(S.page_body_extract(v.pages, min_chars=200))


@query("assign_batches", """SELECT (row_number() OVER (ORDER BY path) - 1) // 3 AS batch, path FROM
    (SELECT p_brand || '/' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || CASE p_partkey % 2 WHEN 0 THEN '.py' ELSE '.md' END AS path FROM part) f WHERE path LIKE '%.py'""")
def _(v):
    files = v.part.select(F.concat("p_brand", F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.when(F.col("p_partkey") % 2 == 0, ".py").otherwise(".md")).alias("path"))
    return S.assign_batches(files, size=3, prefix=9)


@query("append_corrections", f"""SELECT topic, detail, ts, fixed, NULL::VARCHAR AS note FROM v_corrections UNION ALL
    SELECT CAST(item_id AS STRING), substr(text, 1, 20), {ASOF}.0::DOUBLE, false, '[' || CAST(item_id AS STRING) || '] ' || substr(text, 1, 20) FROM benchmark""")
def _(v):
    new = v.benchmark.select(F.col("item_id").cast("string").alias("topic"), F.substring("text", 1, 20).alias("detail"))
    return S.append_corrections(v.v_corrections.select("topic", "detail", "ts", "fixed"), new, ASOF)


MANIFEST_SQL = ", '-', ".join(f"lower(to_base(sum(('0x' || d[{1 + 8 * i}:{8 + 8 * i}])::BIGINT)::BIGINT, 16))" for i in range(4))


@query("snapshot_manifest", f"""SELECT source AS item, concat({MANIFEST_SQL}) AS checksum, count(*) AS n_rows, CASE source WHEN 'src0' THEN 'critical' ELSE 'info' END AS severity FROM
    (SELECT source, md5(coalesce(length(CAST(doc_id AS STRING)) || ':' || CAST(doc_id AS STRING), '~') || coalesce(length(lang) || ':' || lang, '~') || coalesce(length(source) || ':' || source, '~')) AS d FROM documents) x GROUP BY source""")
def _(v):
    return S.snapshot_manifest(v.documents.select("doc_id", "lang", "source"), "source", {"src0": "critical"})


@query("normalize_timestamps", """SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE floor({EPOCH_TS}) END AS at, CASE event_id % 3 WHEN 2 THEN 'soon' END AS at_bad FROM events""")
def _(v):
    ts = F.col("ts").cast("timestamp")
    at = F.when(F.col("event_id") % 3 == 0, F.unix_timestamp(ts).cast("string")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return P.normalize_timestamps(v.events.select("event_id", at.alias("at")), ["at"])


@query("metadata_where", f"SELECT id FROM v_memories WHERE type = 'text' AND created_at >= {EPOCH + 86400 * 30} AND tier IN ('hot', 'warm') AND (topic = 'en' OR heat > 40)")
def _(v):
    where = {"$and": [{"type": "text"}, {"created_at": {"$gte": float(EPOCH + 86400 * 30)}}, {"tier": {"$in": ["hot", "warm"]}}], "$or": [{"topic": "en"}, {"heat": {"$gt": 40.0}}]}
    return P.metadata_where(v.v_memories, where).select("id")


@query("latest_only", "SELECT id FROM v_memories WHERE is_latest")
def _(v):
    return P.latest_only(v.v_memories).select("id")


@query("user_topic_filter", "SELECT id, user_id FROM v_memories WHERE (user_id IS NULL OR user_id = 4) AND topic = 'en'")
def _(v):
    return P.user_topic_filter(v.v_memories, 4, "en").select("id", "user_id")


OPENINGS = ["test", "hello", "the", "la ", "ok"]


@query("trivial_message", """SELECT id, length(t) <= 3 OR t LIKE 'test%' OR t LIKE 'hello%' OR t LIKE 'the%' OR t LIKE 'la %' OR t LIKE 'ok%' AS is_trivial FROM
    (SELECT id, lower(trim(coalesce(content, ''))) AS t FROM v_messages) m""")
def _(v):
    return v.v_messages.select("id", P.is_trivial(F.col("content"), OPENINGS).alias("is_trivial"))


@query("has_substance", f"""SELECT id, t <> '' AND NOT (role = 'user' AND (length(t) < 4 OR (t IN {PHRASE_SQL} AND NOT imp))) AND NOT (role = 'assistant' AND length(t) < 15 AND NOT imp) AS substantive FROM
    (SELECT id, role, lower(trim(coalesce(content, ''))) AS t, contains(lower(coalesce(content, '')), 'ungkeit') OR contains(lower(coalesce(content, '')), 'tionth') OR contains(lower(coalesce(content, '')), 'ción') AS imp FROM v_messages) m""")
def _(v):
    return v.v_messages.select("id", P.has_substance(F.col("content"), F.col("role"), PHRASES, IMPORTANT).alias("substantive"))


@query("placeholder_records", "SELECT id, content FROM v_memories WHERE id % 4 <> 1 AND id % 3 = 0 AND length(content) > 5")
def _(v):
    extra = F.when(F.col("id") % 4 == 1, F.create_map(*[F.lit(x) for x in ("note", "repair", "a", "1", "b", "2")])).otherwise(F.create_map(F.lit("note"), F.when(F.col("id") % 3 == 0, "repair").otherwise("none")))
    return P.placeholder_records(v.v_memories.withColumn("extra", extra))


@query("clean_metadata", """SELECT id, CASE WHEN id % 2 = 0 THEN type WHEN coalesce(content, '') LIKE 'topic:%' THEN 'topic' WHEN contains(coalesce(content, ''), '->') THEN 'conversation' WHEN coalesce(content, '') <> '' THEN 'text' ELSE 'unknown' END AS type,
    CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n_keys FROM v_memories""")
def _(v):
    extra = F.create_map(F.lit("type"), F.when(F.col("id") % 2 == 0, F.col("type")), F.lit("heat"), F.col("heat").cast("string"), F.lit("_document"), F.lit("x"))
    out = P.clean_metadata(v.v_memories.withColumn("extra", extra))
    return out.select("id", "type", F.size("extra").cast("long").alias("n_keys"))


@query("retention_candidates", f"""SELECT id, CASE WHEN source IN ('src0', 'src1') OR type = 'decision' OR (tier IN ('hot', 'warm') AND coalesce(content, '') <> '') THEN 'keep'
      WHEN coalesce(last_mentioned, 0) > 0 THEN CASE WHEN last_mentioned > {ASOF - 30 * 86400} THEN 'keep' ELSE 'forget' END
      WHEN created_at > {ASOF - 7 * 86400} THEN 'keep' ELSE 'forget' END AS decision,
    CASE WHEN source IN ('src0', 'src1') THEN 'protected source' WHEN type = 'decision' THEN 'protected type' WHEN tier IN ('hot', 'warm') AND coalesce(content, '') <> '' THEN 'tier'
      WHEN coalesce(last_mentioned, 0) > 0 THEN CASE WHEN last_mentioned > {ASOF - 30 * 86400} THEN 'recent mention' ELSE 'old mention' END
      WHEN created_at > {ASOF - 7 * 86400} THEN 'recent creation' ELSE 'old creation' END AS reason FROM v_memories""")
def _(v):
    return P.retention_decisions(v.v_memories, ASOF, sources=("src0", "src1"))


@query("message_predicate", f"SELECT m.id FROM v_messages m JOIN v_sessions s ON m.session_id = s.session_id WHERE m.role IN ('user', 'assistant') AND m.ts >= {ASOF_MSG - 432000} AND s.message_count >= 3")
def _(v):
    return P.message_predicate(v.v_messages, v.v_sessions, ASOF_MSG, 432000, 3).select("id")


@query("substring_match", "SELECT q.n_nationkey AS query_id, m.id FROM v_messages m, nation q WHERE contains(lower(m.content), lower(substr(q.n_name, 1, 3)))")
def _(v):
    q = v.nation.select(F.col("n_nationkey").alias("query_id"), F.substring("n_name", 1, 3).alias("q"))
    return P.substring_match(v.v_messages, q, ci=True).select("query_id", "id")


@query("strip_channel_prefix", "SELECT id, content FROM v_channel_log")
def _(v):
    log = v.v_channel_log.select("id", F.concat(F.lit("["), "channel", F.lit("] "), "content").alias("content"))
    return P.strip_channel_prefix(log)


@query("classify_channel", "SELECT session_id, CASE WHEN source = 'terminal' THEN 'console' WHEN source = 'chat' THEN 'messenger' ELSE 'unknown' END AS channel FROM v_sessions")
def _(v):
    sid = F.concat(F.when(F.col("source") == "terminal", "cli-").otherwise("x-"), F.col("source"), F.col("session_id").cast("string"))
    return v.v_sessions.select("session_id", P.classify_channel(sid, [("starts", "cli-", "console"), ("contains", "chat", "messenger")]).alias("channel"))


@query("heat_label", "SELECT id, CASE WHEN heat >= 30 THEN 'burning' WHEN heat >= 10 THEN 'warm' WHEN heat >= 3 THEN 'dormant' WHEN tier = 'cold' THEN 'cold zone' ELSE 'warm zone' END AS label FROM v_memories")
def _(v):
    return v.v_memories.select("id", P.heat_label(F.col("heat"), F.col("tier")).alias("label"))


@query("topic_classify", "SELECT id, CASE WHEN contains(content, 'ungkeit') OR contains(content, 'keitung') THEN 'german' WHEN contains(content, 'ción') THEN 'spanish' ELSE 'general' END AS topic FROM v_memories")
def _(v):
    return v.v_memories.select("id", P.topic_classify(F.col("content"), [(["ungkeit", "keitung"], "german"), (["ción"], "spanish")]).alias("topic"))


@query("route_by_domain", r"""WITH h AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), d AS (SELECT url, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM h)
    SELECT url, domain, CASE WHEN domain LIKE '%example.net' THEN 'direct' WHEN domain LIKE '%example.org' THEN 'proxy' ELSE 'unknown' END AS route FROM d""")
def _(v):
    return P.route_by_domain(v.pages, ["example.net"], ["example.org"])


@query("extraction_payload_clean", """SELECT id, 'entity' AS kind, source AS name, type, topic AS attr, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, NULL::VARCHAR AS relation FROM v_memories WHERE source <> 'src3'
    UNION ALL SELECT id, 'relation', NULL, NULL, NULL, source, topic, 'in' FROM v_memories""")
def _(v):
    ent = F.array(F.struct(F.col("source").alias("name"), F.col("type"), F.col("topic").alias("attr")), F.struct(F.lit(" ").alias("name"), F.lit("x").alias("type"), F.lit("y").alias("attr")))
    old = F.struct(F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"), F.col("source"), F.col("topic").alias("target"), F.lit("in").alias("relation"))
    js = F.to_json(F.struct(ent.alias("entities"), F.array(old).alias("relations")))
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).when(F.col("id") % 3 == 1, F.concat(F.lit("<think>hm {</think>\n"), js)).otherwise(js)
    return P.extraction_payload_clean(v.v_memories.select("id", raw.alias("raw")), ["src3"])


SENTENCES_SQL = r"""WITH s AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS r FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[。！？\n.!?]') AS p FROM documents) x),
    t AS (SELECT doc_id, pos, trim(r) AS raw, regexp_replace(trim(r), '^(user|assistant)[:：]?\s*', '') AS sentence FROM s WHERE length(trim(r)) BETWEEN 8 AND 300),
    u AS (SELECT *, contains(lower(sentence), 'ing') AS dec, contains(lower(sentence), 'tion') AS tec FROM t WHERE length(sentence) > 10),
    d AS (SELECT doc_id, 0 AS k, pos, sentence FROM u WHERE dec),
    a AS (SELECT * FROM d UNION ALL SELECT doc_id, 1, pos, sentence FROM u WHERE tec AND length(raw) >= 12 AND NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = u.doc_id AND substr(d.sentence, 1, 20) = substr(u.sentence, 1, 20))),
    f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, k, substr(sentence, 1, 50) ORDER BY pos) = 1)
    SELECT doc_id, CASE WHEN k = 0 THEN 'decision' ELSE 'tech' END AS kind, sentence FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, pos) <= 5"""


@query("important_sentences", SENTENCES_SQL)
def _(v):
    return P.important_sentences(v.documents, ["ing"], ["tion"])


@query("preview_columns", "SELECT id, substr(content, 1, 40) AS content, substr(source, 1, 3) AS source FROM v_memories")
def _(v):
    return P.preview_columns(v.v_memories.select("id", "content", "source"), {"content": 40, "source": 3})


@query("document_status_filter", "SELECT id, source, topic FROM v_memories WHERE type = 'decision'")
def _(v):
    return v.v_memories.filter("type = 'decision'").select("id", "source", "topic").orderBy("source", "id")


@query("fn_tokenize", r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9#+._-]+')))::BIGINT AS n FROM documents")
def _(v):
    return v.documents.select("doc_id", F.size(T.tokenize(F.col("text"))).cast("long").alias("n"))


@query("fn_cosine_distance", "SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(v):
    a = v.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = v.embeddings.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(T.cosine_distance(F.col("x"), F.col("y")), 6).alias("distance"))


@query("fn_jaccard", r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9#+._-]+')) AS t FROM documents)
    SELECT a.doc_id, round(CASE WHEN len(list_distinct(a.t || b.t)) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) ELSE 0 END, 6) AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def _(v):
    t = v.documents.select("doc_id", T.tokenize(F.col("text")).alias("t"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return t.join(b, "doc_id").select("doc_id", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query("fn_heat_decay", f"SELECT id, round(heat * pow(0.5, greatest(0, {ASOF} - created_at) / 43200.0), 6) AS heat FROM v_memories")
def _(v):
    return v.v_memories.select("id", F.round(T.heat_decay(F.col("heat"), F.col("created_at"), ASOF), 6).alias("heat"))


@query("fn_content_key", "SELECT id, substr(coalesce(content, ''), 1, 50) AS k FROM v_memories")
def _(v):
    return v.v_memories.select("id", T.content_key(F.col("content")).alias("k"))


@query("fn_content_hash", "SELECT id, substr(sha256(coalesce(content, '')), 1, 16) AS h FROM v_memories")
def _(v):
    return v.v_memories.select("id", T.content_hash(F.col("content")).alias("h"))


@query("fn_sanitize_name", r"""SELECT url, substr(trim(regexp_replace(url, '[\\/:*?"<>|\n\r\t]', '_', 'g')), 1, 60) AS name FROM pages""")
def _(v):
    return v.pages.select("url", T.sanitize_name(F.col("url")).alias("name"))


@query("bulk_append", "SELECT id, type FROM v_memories WHERE length(content) > 0")
def _(v):
    path = shared_path(v.spark, "bulk")
    S.bulk_append(v.v_memories.select("id", "content", "type"), path)
    return v.spark.read.parquet(path).select("id", "type")


@query("append_audit_log", f"""SELECT count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS deleted FROM (SELECT source IN ('src0', 'src1') OR type = 'decision' OR (tier IN ('hot', 'warm') AND coalesce(content, '') <> '')
    OR CASE WHEN coalesce(last_mentioned, 0) > 0 THEN last_mentioned > {ASOF - 30 * 86400} ELSE created_at > {ASOF - 7 * 86400} END AS k FROM v_memories) m""")
def _(v):
    path = shared_path(v.spark, "audit")
    audit = retention_delete(v.v_memories, P.retention_decisions(v.v_memories, ASOF, sources=("src0", "src1")))[1]
    S.append_audit_log(audit.select("deleted", "kept", F.lit(float(ASOF)).alias("at")), path)
    return v.spark.read.schema("deleted long, kept long").json(path).select("deleted", "kept")

"""Queries of retrieval, lifecycle and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as P
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import retrieval as R
from .ingest import SENTENCES_SQL
from .registry import query
from .relational import TERMS_SQL, TOKENS, VALUABLE_SQL, _terms, _valuable
from .views import ASOF, ASOF_EVT, ASOF_MSG

COS = "list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
VECTOR_SQL = f"""SELECT q.vec_id AS query_id, m.id, m.content, round(1 - (1 - {COS}), 4) AS score FROM v_memories m JOIN embeddings v ON v.vec_id = m.id JOIN embeddings q ON q.vec_id % 20 = 0"""
RANKED = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {}"
KEYWORD_SQL = f"""WITH q AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS t FROM benchmark WHERE item_id % 20 = 0), d AS (SELECT id, {TOKENS.format('content')} AS t FROM v_memories),
    p AS (SELECT id, len(t) AS n, unnest(t) AS w FROM d), qq AS (SELECT query_id, len(t) AS n, unnest(t) AS w FROM q)
    SELECT query_id, id, round(count(*) / (p.n + qq.n - count(*)), 4) AS score FROM p JOIN qq ON p.w = qq.w GROUP BY query_id, id, p.n, qq.n"""


def _vectors(v):
    return v.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _probes(v):
    """The vectors of every id that is divisible by 20 as queries."""
    return v.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def _texts(v):
    return v.benchmark.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def _names(v):
    """Names of every part whose id is divisible by 20 as queries."""
    return v.part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("q"))


@query("vector_search", f"SELECT query_id, id, score FROM ({VECTOR_SQL} WHERE m.is_latest AND m.topic = 'en') x {RANKED.format(5)}")
def _(v):
    return R.vector_search(v.v_memories, _vectors(v), _probes(v), 5, {"topic": "en"}).select("query_id", "id", "score")


@query("topk_similar", f"SELECT query_id, id, score FROM ({VECTOR_SQL}) x {RANKED.format(20)}")
def _(v):
    return R.vector_search(v.v_memories, _vectors(v), _probes(v), 50, all_versions=True).select("query_id", "id", "score")


@query("threshold_topk", f"SELECT query_id, id, score FROM ({VECTOR_SQL} WHERE 1 - {COS} <= 0.75) x {RANKED.format(5)}")
def _(v):
    return R.vector_search(v.v_memories, _vectors(v), _probes(v), 5, all_versions=True, max_dist=0.75).select("query_id", "id", "score")


@query("keyword_search", f"SELECT * FROM ({KEYWORD_SQL}) x {RANKED.format(5)}")
def _(v):
    return R.keyword_search(v.v_memories, _texts(v), 5).select("query_id", "id", "score")


FULL_SQL = f"""WITH h AS (SELECT q.n_nationkey AS query_id, m.* FROM v_messages m JOIN nation q ON contains(lower(m.content), lower(substr(q.n_name, 1, 3))) WHERE m.role IN ('user', 'assistant') AND m.ts >= {ASOF_MSG - 2592000}),
    o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, session_id ORDER BY ts DESC, id DESC) = 1), t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, id DESC) <= 5)
    SELECT t.query_id, t.session_id, s.source, s.title, substr(t.content, 1, 200) AS snippet, t.ts FROM t JOIN v_sessions s ON s.session_id = t.session_id"""


def _phrases(v):
    return v.nation.select(F.col("n_nationkey").alias("query_id"), F.substring("n_name", 1, 3).alias("q"))


@query("fulltext_sessions", FULL_SQL)
def _(v):
    return R.fulltext_sessions(v.v_messages, v.v_sessions, _phrases(v), 5, ASOF_MSG)


@query("hybrid_search", f"SELECT 'memory' AS kind, query_id, CAST(id AS STRING) AS id FROM ({VECTOR_SQL} WHERE m.is_latest) x {RANKED.format(5)} UNION ALL SELECT 'session', query_id, CAST(session_id AS STRING) FROM ({FULL_SQL}) y")
def _(v):
    a = R.vector_search(v.v_memories, _vectors(v), _probes(v), 5).select(F.lit("memory").alias("kind"), "query_id", F.col("id").cast("string").alias("id"))
    b = R.fulltext_sessions(v.v_messages, v.v_sessions, _phrases(v), 5, ASOF_MSG).select(F.lit("session").alias("kind"), "query_id", F.col("session_id").cast("string").alias("id"))
    return a.unionByName(b)


ENTITY_SQL = """SELECT query_id, name FROM (SELECT DISTINCT from_id AS name FROM v_edges UNION SELECT to_id FROM v_edges) n, (SELECT p_partkey AS query_id, 'p' || CAST(p_partkey AS STRING) AS q FROM part WHERE p_partkey % 20 = 0) q
    WHERE contains(lower(name), q) OR contains(q, lower(name)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY name) <= {}"""
BOTH_SQL = "(SELECT from_id AS a, to_id AS b FROM v_edges UNION ALL SELECT to_id, from_id FROM v_edges)"
GRAPH_SQL = f"""WITH e AS ({ENTITY_SQL.format(3)}), h AS (SELECT query_id, name AS id, 0.7 AS score FROM e UNION ALL SELECT e.query_id, x.b, 0.5 FROM e JOIN {BOTH_SQL} x ON x.a = e.name),
    g AS (SELECT query_id, id, max(score)::DOUBLE AS score FROM h GROUP BY ALL) SELECT query_id, id, score FROM g {RANKED.format(6)}"""


@query("entity_search", ENTITY_SQL.format(5))
def _(v):
    return R.entity_search(v.v_edges, _names(v), 5)


@query("graph_search", GRAPH_SQL.replace("<= 6", "<= 3"))
def _(v):
    return R.graph_search(v.v_edges, _names(v), 3).select("query_id", "id", "score")


def _fused_sql(legs: list[str], k: int) -> str:
    body = " UNION ALL ".join(legs)
    return f"""WITH a AS ({body}), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, substr(content, 1, 50) ORDER BY score DESC, id) = 1)
    SELECT query_id, id, score, source FROM b {RANKED.format(k)}"""


VEC_LEG = f"SELECT query_id, CAST(id AS STRING) AS id, content, score, 'vector' AS source FROM ({VECTOR_SQL} WHERE m.is_latest) x {RANKED.format('{k}')}"
GRAPH_LEG = f"SELECT query_id, id, id, score, 'graph' FROM ({GRAPH_SQL.replace('<= 6', '<= 3')}) g"
KEY_LEG = f"SELECT k.query_id, CAST(k.id AS STRING), m.content, k.score, 'keyword' FROM (SELECT * FROM ({KEYWORD_SQL}) x {RANKED.format(5)}) k JOIN v_memories m ON m.id = k.id"


#: Characters by which a fusion tells contents apart; its vector leg needs no more of a text.
BEGINS = 50


def _fused(v, k: int = 5):
    return R.fuse([R.vector_search(v.cut(BEGINS).v_memories, _vectors(v), _probes(v), 5), R.graph_search(v.v_edges, _names(v), 3)], k)


FUSED_SQL = _fused_sql([VEC_LEG.replace("{k}", "5"), GRAPH_LEG], 5)


@query("fused_search", FUSED_SQL)
def fused_search(v):
    return _fused(v).select("query_id", "id", "score", "source")


@query("fused_source_counts", f"SELECT query_id, source, count(*) AS n FROM ({FUSED_SQL}) x GROUP BY ALL")
def _(v):
    return R.source_counts(_fused(v))


@query("three_way_search", _fused_sql([VEC_LEG.replace("{k}", "5"), KEY_LEG, GRAPH_LEG], 8))
def three_way_search(v):
    legs = [R.vector_search(v.cut(BEGINS).v_memories, _vectors(v), _probes(v), 5), R.keyword_search(v.v_memories, _texts(v), 5), R.graph_search(v.v_edges, _names(v), 3)]
    return R.fuse(legs, 8).select("query_id", "id", "score", "source")


BFS_SQL = f"""RECURSIVE w AS (SELECT seed, node, 0 AS d FROM ({{seeds}}) s UNION SELECT w.seed, x.b, w.d + 1 FROM w JOIN {BOTH_SQL} x ON x.a = w.node WHERE w.d < 2)"""


@query("multi_search", f"""WITH {BFS_SQL.format(seeds=f"SELECT CAST(query_id AS STRING) || '|' || name AS seed, name AS node FROM ({ENTITY_SQL.format(5)}) e")},
    g AS (SELECT CAST(split_part(seed, '|', 1) AS BIGINT) AS query_id, node AS id, max(CASE WHEN d = 0 THEN 0.7 ELSE 0.5 END)::DOUBLE AS score FROM w GROUP BY ALL),
    a AS ({VEC_LEG.replace('{k}', '10')} UNION ALL SELECT query_id, id, id, score, 'graph' FROM g),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, substr(content, 1, 50) ORDER BY score DESC, id) = 1) SELECT query_id, id, score, source FROM b {RANKED.format(5)}""")
def _(v):
    return R.multi_search(v.cut(BEGINS).v_memories, _vectors(v), v.v_edges, _probes(v), _names(v)).select("query_id", "id", "score", "source")


@query("cold_search", f"""WITH c AS (SELECT p_partkey AS id, lower(p_name) AS name, list_distinct([lower(p_brand), lower(p_type)]) AS tags, lower(p_type || ' ' || p_name) AS summary FROM part), q AS (SELECT p_partkey AS query_id, lower(split_part(p_name, ' ', 1)) AS q FROM part WHERE p_partkey % 20 = 0)
    SELECT query_id, id, score FROM (SELECT query_id, id, round(CASE WHEN contains(name, q) THEN 0.8 ELSE 0 END + 0.5 * len(list_filter(tags, lambda t: contains(t, q))) + CASE WHEN contains(summary, q) THEN 0.3 ELSE 0 END, 4)::DOUBLE AS score FROM c, q) x WHERE score > 0 {RANKED.format(5)}""")
def _(v):
    cold = v.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array_distinct(F.array("p_brand", "p_type")).alias("tags"), F.concat("p_type", F.lit(" "), "p_name").alias("summary"))
    q = v.part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.substring_index("p_name", " ", 1).alias("q"))
    return R.cold_search(cold, q).select("query_id", "id", "score")


@query("cold_excavate", """WITH h AS (SELECT q.n_nationkey AS query_id, m.session_id, m.pos, m.role, s.started_at FROM v_messages m JOIN nation q ON contains(m.content, lower(substr(q.n_name, 1, 3))) JOIN v_sessions s ON s.session_id = m.session_id QUALIFY row_number() OVER (PARTITION BY q.n_nationkey ORDER BY s.started_at DESC, m.session_id, m.pos) <= 20)
    SELECT query_id, session_id, string_agg(role || CAST(pos AS STRING), ',' ORDER BY pos) AS messages FROM h GROUP BY ALL""")
def _(v):
    q = v.nation.select(F.col("n_nationkey").alias("query_id"), F.lower(F.substring("n_name", 1, 3)).alias("q"))
    out = R.cold_excavate(v.v_messages, v.v_sessions, q, 20)
    return out.select("query_id", "session_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["pos"].cast("string"))), ",").alias("messages"))


@query("excavate_sessions", """WITH m AS (SELECT * FROM v_messages WHERE session_id % 20 = 0 ORDER BY id LIMIT 500)
    SELECT session_id, 'session ' || session_id AS title, string_agg(role || CAST(pos AS STRING), ',' ORDER BY pos) AS messages FROM m GROUP BY session_id""")
def _(v):
    out = R.excavate_sessions(v.v_messages, v.v_sessions, v.v_sessions.filter("session_id % 20 = 0"))
    return out.select("session_id", "title", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["pos"].cast("string"))), ",").alias("messages"))


@query("multi_source_search", f"""WITH s AS (SELECT source, CAST(id AS STRING) AS id, lower(content) AS text, created_at AS ts FROM v_memories UNION ALL SELECT 'log', CAST(id AS STRING), lower(content), ts FROM v_channel_log)
    SELECT q.n_nationkey AS query_id, s.source, s.id FROM s JOIN nation q ON contains(s.text, lower(substr(q.n_name, 1, 3))) QUALIFY row_number() OVER (PARTITION BY q.n_nationkey ORDER BY s.ts DESC, s.source, s.id) <= 20""")
def _(v):
    s = v.v_memories.select("source", F.col("id").cast("string").alias("id"), F.col("content").alias("text"), F.col("created_at").alias("ts"))
    s = s.unionByName(v.v_channel_log.select(F.lit("log").alias("source"), F.col("id").cast("string").alias("id"), F.col("content").alias("text"), "ts"))
    return R.multi_source_search(s, _phrases(v)).select("query_id", "source", "id")


@query("prefetch_context", f"""WITH k AS (SELECT x.query_id, x.id, x.score, m.content, row_number() OVER (PARTITION BY x.query_id ORDER BY x.score DESC, x.id) AS r FROM ({KEYWORD_SQL}) x JOIN v_memories m ON m.id = x.id QUALIFY r <= 5)
    SELECT query_id, string_agg('- [' || CAST(score AS STRING) || '|keyword] ' || substr(content, 1, 120), chr(10) ORDER BY r) AS text FROM k GROUP BY query_id""")
def _(v):
    return R.prefetch_context(R.keyword_search(v.v_memories, _texts(v), 5))


@query("session_brief", f"""WITH k AS (SELECT x.query_id, x.id, m.content, row_number() OVER (PARTITION BY x.query_id ORDER BY x.score DESC, x.id) AS r FROM ({KEYWORD_SQL}) x JOIN v_memories m ON m.id = x.id QUALIFY r <= 3), q AS (SELECT item_id AS query_id FROM benchmark WHERE item_id % 20 = 0)
    SELECT q.query_id, 0::BIGINT AS line_no, 'topic: ' || topic AS text FROM q, (SELECT topic FROM v_mentions GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 1) t UNION ALL SELECT query_id, r, substr(content, 1, 80) FROM k UNION ALL SELECT q.query_id, 99, 'memories: ' || n FROM q, (SELECT count(*) AS n FROM v_memories) c""")
def _(v):
    from ..operators.windows import hottest_topic

    hot = hottest_topic(v.v_mentions.groupBy(F.col("topic").alias("name")).agg(F.count(F.lit(1)).alias("heat")))
    return R.session_brief(hot, R.keyword_search(v.v_memories, _texts(v), 3), v.v_memories, _texts(v))


@query("context_injection", f"""WITH k AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM ({GRAPH_SQL.replace('<= 6', '<= 3')}) y) x),
    hot AS (SELECT topic AS name, row_number() OVER (ORDER BY count(*) DESC, topic) AS r FROM v_mentions GROUP BY topic QUALIFY r <= 3),
    l AS (SELECT DISTINCT node, text FROM (SELECT from_id AS node, from_id || ' -' || rel_type || '-> ' || to_id AS text FROM v_edges UNION ALL SELECT to_id, from_id || ' -' || rel_type || '-> ' || to_id FROM v_edges) z),
    g AS (SELECT node, text, row_number() OVER (PARTITION BY node ORDER BY text) AS n FROM l QUALIFY n <= 10)
    SELECT q.query_id, hot.r AS line_no, hot.name AS text FROM (SELECT DISTINCT query_id FROM k) q, hot UNION ALL SELECT query_id, r + 100, substr(id, 1, 80) FROM k UNION ALL SELECT k.query_id, g.n + 200, g.text FROM k JOIN g ON g.node = k.id WHERE k.r = 1""")
def _(v):
    hot = v.v_mentions.groupBy(F.col("topic").alias("name")).agg(F.count(F.lit(1)).alias("heat")).orderBy(F.col("heat").desc(), "name").limit(3)
    hits = R.graph_search(v.v_edges, _names(v), 3)
    return R.context_injection(hot, hits, G.graph_context(v.v_edges, hits.filter("rank = 1").select("id").distinct()))


RECOVER_SQL = """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos, id) AS line_no, CASE WHEN role = 'user' THEN 'U: ' || substr(content, 1, 500) ELSE 'A: ' || substr(content, 1, 200) || CASE WHEN length(content) > 200 THEN '...' ELSE '' END END AS text
    FROM v_messages WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos, id) <= 15"""


@query("recover_conversation", RECOVER_SQL)
def _(v):
    return R.recover_conversation(v.v_messages)


@query("recover_compressed", """SELECT 'topic' AS kind, topic AS text FROM (SELECT topic FROM v_mentions GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 3) t
    UNION ALL SELECT 'conclusion', substr(arg_max(content, pos), 1, 150) FROM v_messages WHERE role = 'assistant' AND length(content) > 10 AND session_id IN (SELECT session_id FROM v_sessions ORDER BY started_at DESC, session_id LIMIT 3) GROUP BY session_id""")
def _(v):
    from ..operators.windows import last_assistant_message

    hot = v.v_mentions.groupBy(F.col("topic").alias("name")).agg(F.count(F.lit(1)).alias("heat")).orderBy(F.col("heat").desc(), "name").limit(3)
    return R.recover_compressed(hot, last_assistant_message(v.v_messages, v.v_sessions), R.recover_conversation(v.v_messages, 10))


# ---- lifecycle


@query("deprecate", f"SELECT id, CASE WHEN id % 13 = 0 THEN false ELSE is_latest END AS is_latest, CASE WHEN id % 13 = 0 THEN id + 1 END AS superseded_by, CASE WHEN id % 13 = 0 THEN {ASOF}.0::DOUBLE END AS changed_at FROM v_memories")
def _(v):
    ch = v.v_memories.filter("id % 13 = 0").select("id", (F.col("id") + 1).alias("successor"))
    return L.deprecate(v.v_memories, ch, ASOF).select("id", "is_latest", "superseded_by", "changed_at")


@query("versioned_update", """WITH u AS (SELECT item_id * 2 AS id, item_id + 5000000 AS new_id, text FROM benchmark)
    SELECT m.id, CASE WHEN u.id IS NOT NULL THEN false ELSE is_latest END AS is_latest, u.new_id AS superseded_by, NULL::BIGINT AS parent_id FROM v_memories m LEFT JOIN u ON u.id = m.id
    UNION ALL SELECT u.new_id, true, NULL, m.id FROM u LEFT JOIN v_memories m ON m.id = u.id""")
def _(v):
    u = v.benchmark.select((F.col("item_id") * 2).alias("id"), (F.col("item_id") + 5000000).alias("new_id"), F.col("text").alias("content"))
    return L.versioned_update(v.v_memories, u, ASOF).select("id", "is_latest", "superseded_by", "parent_id")


@query("auto_forget", f"SELECT id, CASE WHEN is_latest AND forget_after <= {ASOF} THEN false ELSE is_latest END AS is_latest, CASE WHEN is_latest AND forget_after <= {ASOF} THEN 'expired' END AS forget_reason FROM v_memories")
def _(v):
    return L.auto_forget(v.v_memories, ASOF).select("id", "is_latest", "forget_reason")


@query("auto_forget_counts", f"SELECT count(*) FILTER (is_latest AND forget_after <= {ASOF}) AS forgotten, count(*) FILTER (NOT coalesce(is_latest AND forget_after <= {ASOF}, false)) AS skipped, count(*) AS scanned FROM v_memories")
def _(v):
    return L.auto_forget(v.v_memories, ASOF, dry_run=True)


@query("retention_delete", f"""SELECT id FROM v_memories WHERE source IN ('src0', 'src1') OR type = 'decision' OR (tier IN ('hot', 'warm') AND coalesce(content, '') <> '')
    OR CASE WHEN coalesce(last_mentioned, 0) > 0 THEN last_mentioned > {ASOF - 30 * 86400} ELSE created_at > {ASOF - 7 * 86400} END""")
def _(v):
    return L.retention_delete(v.v_memories, P.retention_decisions(v.v_memories, ASOF, sources=("src0", "src1")))[0].select("id")


@query("resolve_conflicts", "SELECT id, CASE WHEN id % 10 = 1 THEN false ELSE is_latest END AS is_latest, CASE WHEN id % 10 = 1 THEN id - 1 END AS superseded_by FROM v_memories")
def _(v):
    pairs = v.v_memories.filter("id % 10 = 1").select((F.col("id") - 1).alias("winner_id"), F.col("id").alias("loser_id"))
    return L.resolve_conflicts(v.v_memories, pairs, ASOF).select("id", "is_latest", "superseded_by")


@query("merge_duplicates", """WITH RECURSIVE p AS (SELECT a.id AS x, b.id AS y FROM v_memories a JOIN v_memories b ON a.id <> b.id JOIN embeddings x ON x.vec_id = a.id JOIN embeddings y ON y.vec_id = b.id
      WHERE 1 - list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) < 0.62),
    r AS (SELECT x, x AS y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y),
    w AS (SELECT r.x AS id, arg_max(m.id, m.created_at * 1000000 - m.id) AS winner FROM r JOIN v_memories m ON m.id = r.y GROUP BY r.x)
    SELECT m.id, is_latest AND coalesce(w.winner = m.id, true) AS is_latest, CASE WHEN w.winner <> m.id THEN w.winner END AS superseded_by FROM v_memories m LEFT JOIN w ON w.id = m.id""")
def _(v):
    from ..operators.neighbours import near_links

    # any pairs that link the same sets: the winner is chosen by created_at among the whole set
    links = near_links(_vectors(v).join(v.v_memories.select("id"), "id"), 0.62)
    pairs = links.select(F.col("a").alias("winner_id"), F.col("b").alias("loser_id"))
    return L.merge_duplicates(v.v_memories, pairs, ASOF).select("id", "is_latest", "superseded_by")


HEAT_SQL = f"""SELECT topic, n, last, round(h, 4) AS heat, CASE WHEN h >= 10 THEN 'hot' WHEN {ASOF_EVT} - last > 604800 THEN 'cold' ELSE 'warm' END AS tier FROM
    (SELECT topic, count(*) AS n, max(ts) AS last, count(*) * 20 * pow(0.5, ({ASOF_EVT} - max(ts)) / 43200.0) AS h FROM v_mentions WHERE ts <= {ASOF_EVT} GROUP BY topic) x"""


@query("topic_heat_tiers", HEAT_SQL)
def _(v):
    return L.topic_heat_tiers(v.v_mentions, ASOF_EVT)


@query("archive_topics", "SELECT p_name AS name, p_partkey AS id, CASE WHEN p_size % 5 = 1 THEN 'warm' ELSE 'hot' END AS tier, 'live' AS what FROM part WHERE p_size % 5 <> 0 UNION ALL SELECT p_name, NULL, NULL, 'archive' FROM part WHERE p_size % 5 = 0")
def _(v):
    st = F.when(F.col("p_size") % 5 == 0, "archived").when(F.col("p_size") % 5 == 1, "done")
    live, cold = L.archive_topics(v.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), st.alias("status"), F.lit("hot").alias("tier")), ASOF)
    return live.select("name", "id", "tier", F.lit("live").alias("what")).unionByName(cold.select("name", F.col("type").alias("what")), allowMissingColumns=True)


FACT_TYPE = "CASE id % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'fact' WHEN 2 THEN 'decision' WHEN 3 THEN 'task_status' ELSE 'event' END"


@query("profile_upsert", f"""WITH m AS (SELECT id, user_id, CASE WHEN id % 3 = 0 THEN 'static' ELSE 'dynamic' END AS kind, {TOKENS.format('content')} AS t FROM v_memories WHERE id % 2 = 0),
    f AS (SELECT fact_id, user_id, CASE WHEN ty IN ('preference', 'fact') THEN 'static' ELSE 'dynamic' END AS kind, t, CASE WHEN ty IN ('preference', 'fact') THEN 30.0 WHEN ty IN ('decision', 'task_status') THEN 25.0 ELSE 15.0 END::DOUBLE AS heat, CASE WHEN ty = 'event' THEN 'unknown' ELSE ty END AS category
      FROM (SELECT id AS fact_id, user_id - user_id % 2 AS user_id, {FACT_TYPE} AS ty, {TOKENS.format('substr(content, 1, 300)')} AS t FROM v_memories WHERE id % 2 = 1 AND length(content) >= 5) x),
    d AS (SELECT fact_id, id, len(list_intersect(f.t, m.t)) / len(list_distinct(f.t || m.t)) AS s FROM f JOIN m USING (user_id, kind) WHERE len(f.t) > 0 AND len(m.t) > 0),
    b AS (SELECT fact_id, id FROM d WHERE s >= 0.1 - 1e-12 QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY s DESC, id) = 1)
    SELECT f.fact_id, f.kind, f.heat, f.category, CASE WHEN b.id IS NOT NULL THEN 'update' ELSE 'insert' END AS action, b.id AS target FROM f LEFT JOIN b ON b.fact_id = f.fact_id""")
def _(v):
    mem = v.v_memories.filter("id % 2 = 0").select("id", "user_id", F.when(F.col("id") % 3 == 0, "static").otherwise("dynamic").alias("kind"), "content")
    facts = v.v_memories.filter("id % 2 = 1").select(F.col("id").alias("fact_id"), (F.col("user_id") - F.col("user_id") % 2).alias("user_id"), F.expr(FACT_TYPE).alias("fact_type"), "content")
    return L.profile_upsert(mem, facts, ASOF, near=0.9).drop("content")


@query("profile_view", """SELECT user_id, kind, rank, id, heat FROM (SELECT user_id, CASE WHEN type = 'decision' THEN 'static' ELSE 'dynamic' END AS kind, id, heat, row_number() OVER (PARTITION BY user_id, type = 'decision' ORDER BY heat DESC, id) AS rank FROM v_memories) x WHERE rank <= CASE WHEN kind = 'static' THEN 15 ELSE 10 END""")
def _(v):
    return L.profile_view(v.v_memories.withColumn("kind", F.when(F.col("type") == "decision", "static").otherwise("dynamic")))


@query("profile_decay", f"SELECT id, CASE WHEN {ASOF} - created_at > 604800 AND heat < 10 THEN 'deprecate' ELSE 'decay' END AS action, CASE WHEN NOT ({ASOF} - created_at > 604800 AND heat < 10) THEN round(greatest(1.0, heat * 0.85), 6) END AS heat FROM v_memories")
def _(v):
    return L.profile_decay(v.v_memories, ASOF)


@query("restore_sessions", f"""SELECT 'restore:' || x.session_id || ':' || s.type AS id, s.type, strftime(to_timestamp(started_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS topic, CASE s.type WHEN 'user' THEN user_text ELSE assistant_text END AS content
    FROM ({VALUABLE_SQL}) x JOIN v_sessions y ON y.session_id = x.session_id, (VALUES ('user'), ('assistant')) s(type) WHERE skip_reason IS NULL AND CASE s.type WHEN 'user' THEN user_text ELSE assistant_text END <> ''""")
def _(v):
    return L.restore_sessions(_valuable(v), v.v_sessions)


@query("rebuild_store", """SELECT substr(sha256(CAST(m.id AS STRING) || '|' || coalesce(content, '')), 1, 16) AS id, e.type, e.source, content FROM v_memories m LEFT JOIN
    (SELECT id, max(string_value) FILTER (key = 'type') AS type, max(string_value) FILTER (key = 'source') AS source FROM v_eav GROUP BY id) e ON e.id = m.id""")
def _(v):
    return L.rebuild_store(v.v_eav, v.v_memories, ["type", "source"])


TURNS_SQL = "SELECT u.id, u.session_id, trim(coalesce(u.content, '')) AS u, trim(coalesce(a.content, '')) AS a FROM v_messages u LEFT JOIN v_messages a ON a.session_id = u.session_id AND a.pos = u.pos + 1 AND a.role = 'assistant' WHERE u.role = 'user'"
STORED_SQL = rf"""WITH n AS (SELECT n_name AS name, n_nationkey AS heat, CASE WHEN n_nationkey % 4 = 0 THEN 'done' ELSE 'active' END AS status FROM nation), t AS ({TURNS_SQL}),
    h AS (SELECT t.id, min(n.name) AS hit FROM t JOIN n ON contains(lower(t.u), lower(n.name)) GROUP BY t.id),
    k AS (SELECT name, row_number() OVER (ORDER BY heat DESC, name) AS r FROM n QUALIFY r <= 5),
    w AS (SELECT id, lower(substr(a, 1, 100)) AS c, list_filter(regexp_split_to_array(lower(substr(a, 1, 100)), '\s+'), lambda x: length(x) >= 2) AS w FROM t),
    l AS (SELECT w.id, arg_min(k.name, k.r) AS sim FROM w, k WHERE contains(w.c, lower(k.name)) OR len(list_filter(w.w, lambda x: contains(lower(k.name), x))) > 0 GROUP BY w.id),
    s AS (SELECT t.*, length(t.u) <= 3 OR lower(t.u) LIKE 'the%' OR lower(t.u) LIKE 'so%' AS trivial, h.hit, l.sim FROM t LEFT JOIN h ON h.id = t.id LEFT JOIN l ON l.id = t.id),
    z AS (SELECT *, coalesce(hit, CASE WHEN trivial THEN coalesce(sim, (SELECT arg_max(name, heat) FROM n WHERE heat >= 10 AND status = 'active')) WHEN length(substr(u, 1, 30)) >= 4 THEN substr(u, 1, 30) END) AS topic FROM s)"""


def _stored(v):
    u, a = v.v_messages.filter("role = 'user'"), v.v_messages.filter("role = 'assistant'")
    reply = a.select("session_id", (F.col("pos") - 1).alias("pos"), F.col("content").alias("assistant_text"))
    turns = u.join(reply, ["session_id", "pos"], "left").select("id", "session_id", F.col("content").alias("user_text"), "assistant_text")
    topics = v.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("heat"), F.when(F.col("n_nationkey") % 4 == 0, "done").otherwise("active").alias("status"))
    return L.store_conversation(turns, topics, ["the", "so"], ASOF)


@query("store_conversation", STORED_SQL + " SELECT id, 'user' AS role, topic, substr(u, 1, 500) AS content FROM z WHERE length(u) > 2 AND u NOT LIKE '/%' UNION ALL SELECT id, 'assistant', topic, 'assistant: ' || substr(a, 1, 200) FROM z WHERE length(a) > 5")
def _(v):
    return _stored(v)[0].select("id", "role", "topic", "content")


@query("conversation_mentions", STORED_SQL + " SELECT topic, session_id, substr(u, 1, 50) || ' -> ' || substr(a, 1, 100) AS summary FROM z WHERE topic IS NOT NULL")
def _(v):
    return _stored(v)[1].drop("ts")


CAPTURE_SQL = """WITH n AS (SELECT session_id AS doc_id, string_agg(role || ': ' || substr(content, 1, 300), chr(10) ORDER BY pos, id) AS text FROM
      (SELECT * FROM v_messages WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC, id DESC) <= 6) x GROUP BY session_id HAVING length(trim(string_agg(role || ': ' || substr(content, 1, 300), chr(10)))) >= 20), """ + SENTENCES_SQL[len("WITH ") :].replace("FROM documents", "FROM n").replace(
    "SELECT doc_id, CASE WHEN k = 0 THEN 'decision' ELSE 'tech' END AS kind, sentence FROM f",
    "SELECT doc_id AS session_id, CASE WHEN k = 0 THEN 'decision' ELSE 'tech' END AS kind, sentence AS fact, CASE WHEN contains(sentence, 'ein') THEN 'A' WHEN contains(sentence, 'the') OR contains(sentence, 'los') THEN 'B' ELSE 'general' END AS topic FROM f",
)


@query("capture_facts", CAPTURE_SQL)
def _(v):
    return L.capture_facts(v.v_messages, ["ing"], ["tion"], [(["ein"], "A"), (["the", "los"], "B")])


@query("correction_fix", "SELECT id, fixed OR contains(topic, '2') AS fixed, CASE WHEN NOT fixed AND contains(topic, '2') THEN 'done' END AS note FROM v_corrections")
def _(v):
    return L.correction_fix(v.v_corrections, "2", "done").select("id", "fixed", "note")


@query("content_history", "SELECT user_id, event_type, count(*) AS n, string_agg(CAST(id AS STRING), '>' ORDER BY created_at, id) AS history FROM v_versions GROUP BY ALL")
def _(v):
    return L.content_history(v.v_versions.withColumn("content", F.col("id").cast("string")), ["user_id", "event_type"])


# ---- graph


@query("add_relations", """SELECT from_id, to_id, rel_type, NULL::VARCHAR AS label, NULL::VARCHAR AS reason FROM v_edges WHERE length(to_id) > 3 UNION ALL
    SELECT from_id, to_id, CASE WHEN rel_type = 'derives' THEN 'related' ELSE rel_type END AS k, CASE WHEN rel_type = 'derives' THEN 'comes from' ELSE rel_type END, 'why ' || to_id FROM v_edges WHERE length(to_id) <= 3 OR rel_type = 'derives'""")
def _(v):
    stored = v.v_edges.filter("length(to_id) > 3")
    new = v.v_edges.select("from_id", "to_id", F.when(F.col("rel_type") == "derives", "comes from").otherwise(F.col("rel_type")).alias("rel_type"), F.concat(F.lit("why "), "to_id").alias("reason"))
    return G.add_relations(stored, new)


@query("relations_of", "SELECT 's' || s_suppkey AS id, src, dst, type, active FROM supplier JOIN v_relations ON src = 's' || s_suppkey WHERE active UNION ALL SELECT 'p' || s_suppkey, src, dst, type, active FROM supplier JOIN v_relations ON dst = 'p' || s_suppkey WHERE active")
def _(v):
    n = v.supplier.select(F.explode(F.array(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("p"), F.col("s_suppkey").cast("string")))).alias("id"))
    return G.relations_of(v.v_relations, n)


@query("update_chain_mark", "SELECT src, dst, created_at, row_number() OVER (PARTITION BY dst ORDER BY created_at DESC, src) = 1 AS active FROM v_relations WHERE type = 'updates'")
def _(v):
    return G.update_chain_mark(v.v_relations).withColumn("created_at", F.col("created_at").cast("long"))


@query("version_chain", """WITH RECURSIVE c AS (SELECT id AS start_id, 0 AS depth, id FROM v_versions UNION ALL SELECT c.start_id, c.depth + 1, v.parent_id FROM c JOIN v_versions v ON v.id = c.id WHERE v.parent_id IS NOT NULL AND c.depth < 20) SELECT start_id, depth::BIGINT AS depth, id FROM c""")
def _(v):
    return G.version_chain(v.v_versions).withColumn("depth", F.col("depth").cast("long"))


SEEDS_SQL = "SELECT 'p' || p_partkey AS seed, 'p' || p_partkey AS node FROM part WHERE p_partkey % 20 = 0"


def _seeds(v):
    s = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    return v.part.filter("p_partkey % 20 = 0").select(s.alias("seed"), s.alias("node"))


@query("bfs_subgraph", f"WITH {BFS_SQL.format(seeds=SEEDS_SQL)} SELECT seed, node, min(d)::BIGINT AS depth FROM w GROUP BY ALL")
def _(v):
    return G.bfs_subgraph(v.v_edges, _seeds(v)).withColumn("depth", F.col("depth").cast("long"))


@query("induced_edges", f"WITH {BFS_SQL.format(seeds=SEEDS_SQL)}, r AS (SELECT DISTINCT seed, node FROM w) SELECT a.seed, e.from_id, e.to_id, e.rel_type FROM v_edges e JOIN r a ON a.node = e.from_id JOIN r b ON b.seed = a.seed AND b.node = e.to_id")
def _(v):
    return G.walked_edges(v.v_edges, _seeds(v))


@query("extensions_of", "SELECT src, dst FROM v_relations WHERE active AND type = 'extends'")
def _(v):
    return v.v_relations.filter("active and type = 'extends'").select("src", "dst")


@query("derived_facts", "SELECT 'fact' AS kind, id, topic AS other FROM v_memories WHERE heat >= 30 UNION ALL SELECT 'edge', id, s FROM v_memories, (VALUES ('source'), ('type')) t(c), LATERAL (SELECT CASE c WHEN 'source' THEN source ELSE type END AS s) WHERE heat >= 30")
def _(v):
    f, e = G.derived_facts(v.v_memories.select("id", F.col("topic").alias("content"), (F.col("heat") / 50).alias("confidence"), F.array("source", "type").alias("sources")), 0.6)
    return f.select(F.lit("fact").alias("kind"), "id", F.col("content").alias("other")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("from_id").alias("id"), F.col("to_id").alias("other")))


@query("graph_context", """WITH l AS (SELECT DISTINCT node, text FROM (SELECT from_id AS node, from_id || ' -' || rel_type || '-> ' || to_id AS text FROM v_edges UNION ALL SELECT to_id, from_id || ' -' || rel_type || '-> ' || to_id FROM v_edges) z WHERE node IN (SELECT 's' || s_suppkey FROM supplier))
    SELECT node, row_number() OVER (PARTITION BY node ORDER BY text) AS line_no, text FROM l QUALIFY line_no <= 10""")
def _(v):
    return G.graph_context(v.v_edges, v.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")))


@query("learn_entities", r"""WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:^|[^A-Za-z0-9])([A-Z][A-Za-z0-9_.\-]{2,})', 1)) AS name FROM documents),
    c AS (SELECT DISTINCT doc_id, regexp_replace(name, '[^A-Za-z0-9]+$', '') AS name FROM n)
    SELECT name, count(DISTINCT doc_id) AS n_docs FROM c WHERE length(name) >= 3 AND lower(name) NOT IN ('the', 'and') AND NOT regexp_matches(name, '^[A-Z][a-z]{1,3}$') AND NOT regexp_matches(name, '^[A-Z]{2,6}$') AND name NOT IN (SELECT n_name FROM nation) GROUP BY name HAVING count(DISTINCT doc_id) >= 2""")
def _(v):
    # names that end in a mark count without it, as in SQL, which has no look-ahead
    docs = v.documents.select("doc_id", F.regexp_replace("text", r"[_.\-]+(?![A-Za-z0-9_.\-])", " ").alias("text"))
    return G.learn_entities(docs, v.nation.select(F.col("n_name").alias("name")), ["the", "and"], [], more_words=0, endings="")


@query("rule_entities", r"""WITH r AS (SELECT doc_id, 0 AS k, d.n AS name, d.t AS type FROM documents, (VALUES ('ing the', 'tool'), ('ungkeit', 'framework')) d(n, t) WHERE contains(lower(coalesce(text, '')), d.n)
      UNION ALL SELECT DISTINCT doc_id, 1, unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\P{L}\x00-\x7F]|[^\P{N}\x00-\x7F]', 'x', 'g'), '\b[A-Z][A-Z0-9_\-]+\b')), 'project' FROM documents)
    SELECT doc_id, name, type FROM r WHERE NOT (k = 1 AND lower(name) IN ('http', 'https', 'www', 'api', 'ing the', 'ungkeit')) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, name) <= 10""")
def _(v):
    return G.rule_entities(v.documents, {"ing the": ("tool", ""), "ungkeit": ("framework", "")})


LINK_SQL = f"""WITH t AS (SELECT DISTINCT term FROM ({TERMS_SQL}) x WHERE length(term) >= 5), d AS (SELECT doc_id, term FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) y JOIN t USING (term)),
    p AS (SELECT x.doc_id, x.term AS a, y.term AS b FROM d x JOIN d y ON x.doc_id = y.doc_id AND x.term < y.term)
    SELECT a AS from_id, b AS to_id, CASE WHEN contains(lower(text), 'license') THEN 'derives' WHEN contains(lower(text), 'reserved') THEN 'updates' ELSE 'related' END AS rel_type, count(*) AS n FROM p JOIN documents USING (doc_id) GROUP BY ALL"""


@query("auto_link", LINK_SQL)
def _(v):
    return G.auto_link(v.documents, _terms(v), [("derives", ["license"]), ("updates", ["reserved"])], v.v_edges)


@query("alias_merge", """WITH n AS (SELECT p_name AS name, count(*) AS c FROM part GROUP BY p_name UNION ALL SELECT w, count(*) FROM (SELECT split_part(p_name, ' ', 1) AS w FROM part) x WHERE w NOT IN (SELECT p_name FROM part) GROUP BY w),
    b AS (SELECT s.name, l.name AS long FROM n s JOIN n l ON length(l.name) > length(s.name) AND contains(lower(l.name), lower(s.name)) QUALIFY row_number() OVER (PARTITION BY s.name ORDER BY length(l.name) DESC, l.name) = 1)
    SELECT coalesce(b.long, n.name) AS name, sum(n.c)::BIGINT AS mention_count FROM n LEFT JOIN b ON b.name = n.name GROUP BY 1""")
def _(v):
    full = v.part.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("mention_count"))
    short = v.part.groupBy(F.substring_index("p_name", " ", 1).alias("name")).agg(F.count(F.lit(1)).alias("mention_count")).join(full.select("name"), "name", "left_anti")
    return G.alias_merge(full.unionByName(short), v.v_edges.select("from_id", "to_id"))[0]


@query("node_listing", "SELECT row_number() OVER (ORDER BY node) AS line_no, node || ' ' || n AS text FROM (SELECT node, count(*) AS n FROM (SELECT from_id AS node FROM v_edges UNION ALL SELECT to_id FROM v_edges) x GROUP BY node ORDER BY node LIMIT 10) y")
def _(v):
    return G.node_listing(v.v_edges)


@query("assemble_layers", "SELECT substr(node, 1, 1) AS layer, count(*) AS n, min(node) AS first FROM (SELECT from_id AS node FROM v_edges UNION SELECT to_id FROM v_edges) x GROUP BY 1")
def _(v):
    return G.assemble_layers(v.v_edges, F.substring("node", 1, 1))


@query("query_smoke_stats", f"""SELECT query_id, count(*) AS hits, max(y.score) AS best, count(*) FILTER (CASE WHEN coalesce(m.topic, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(m.source, '') <> '' THEN 1 ELSE 0 END > 1) AS with_metadata
    FROM (SELECT * FROM ({KEYWORD_SQL}) x {RANKED.format(5)}) y JOIN v_memories m ON m.id = y.id GROUP BY query_id""")
def _(v):
    return R.smoke_stats(R.keyword_search(v.v_memories, _texts(v), 5), v.v_memories, ["topic", "source"])


@query("chain_lines", """WITH RECURSIVE u AS (SELECT id AS s, 0 AS d, id FROM v_versions WHERE id % 20 = 0 UNION ALL SELECT u.s, u.d + 1, v.parent_id FROM u JOIN v_versions v ON v.id = u.id WHERE v.parent_id IS NOT NULL AND u.d < 5),
    w AS (SELECT id AS s, 0 AS d, id FROM v_versions WHERE id % 20 = 0 UNION ALL SELECT w.s, w.d + 1, v.id FROM w JOIN v_versions v ON v.parent_id = w.id WHERE w.d < 5),
    c AS (SELECT s, d, id FROM u UNION SELECT s, -d, id FROM w)
    SELECT c.s AS node, row_number() OVER (PARTITION BY c.s ORDER BY c.d DESC, c.id) AS line_no, '[' || CASE WHEN c.d = 0 THEN 'current' WHEN c.d > 0 THEN 'ancestor' ELSE 'descendant' END || '] ' || v.event_type AS text
    FROM c JOIN v_versions v ON v.id = c.id QUALIFY count(*) OVER (PARTITION BY c.s) > 1""")
def _(v):
    return G.chain_lines(v.v_versions.select("id", "parent_id", F.col("event_type").alias("content")), v.v_versions.filter("id % 20 = 0"))

"""Input views: memories, messages, mentions, edges and so on, derived from the tables by plain
arithmetic. Each is one SQL text that Spark and DuckDB both run, so that the operators, and not
the inputs, are what a comparison tests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200
#: "Now" for memories, messages and events.
ASOF, ASOF_MSG, ASOF_EVT = EPOCH + 90 * 86400, EPOCH + 10 * 86400, EPOCH + 30 * 86400

# Where the two dialects differ: (Spark, DuckDB).
DIALECT = {
    "EPOCH_TS": ("(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000D)", "(epoch_us(ts::TIMESTAMP) / 1000000.0::DOUBLE)"),
    "DAY_TS": ("date_format(CAST(ts AS TIMESTAMP), 'yyyy-MM-dd')", "strftime(ts::TIMESTAMP, '%Y-%m-%d')"),
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_memories": f"""SELECT d.doc_id AS id, d.text AS content, d.lang AS topic, d.source AS source,
        CASE WHEN l.quality = 1 THEN 'decision' WHEN l.quality = 0 THEN 'text' ELSE 'conversation' END AS type,
        CASE d.doc_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier,
        CAST(d.doc_id % 50 AS DOUBLE) AS heat, CAST({EPOCH} + 7200 * d.doc_id AS DOUBLE) AS created_at,
        CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE CAST({EPOCH} + 7200 * d.doc_id + 86400 * (d.doc_id % 20) AS DOUBLE) END AS last_mentioned,
        CASE WHEN d.doc_id % 5 <> 0 THEN NULL ELSE CAST({EPOCH} + 7200 * d.doc_id + 86400 * (d.doc_id % 30) AS DOUBLE) END AS forget_after,
        d.doc_id % 7 <> 0 AS is_latest, d.doc_id % 10 AS user_id
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_messages": f"""SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn AS pos, role, text AS content,
        CAST({EPOCH} + 7200 * conv_id + 60 * turn AS DOUBLE) AS ts FROM conversations""",
    "v_sessions": """SELECT session_id, concat('session ', CAST(session_id AS STRING)) AS title,
        CASE session_id % 3 WHEN 0 THEN 'terminal' WHEN 1 THEN 'chat' ELSE 'web' END AS source,
        count(*) AS message_count, min(ts) AS started_at FROM v_messages GROUP BY session_id""",
    "v_channel_log": """SELECT m.id, s.source AS channel, m.role, m.content, m.ts
        FROM v_messages m JOIN v_sessions s ON m.session_id = s.session_id""",
    "v_mentions": """SELECT event_id AS id, concat(event_type, '-', CAST(user_id % 20 AS STRING)) AS topic, user_id AS session_id, {EPOCH_TS} AS ts FROM events""",
    "v_versions": """SELECT event_id AS id, user_id, event_type, CAST(value AS STRING) AS content, {EPOCH_TS} AS created_at,
        lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS parent_id,
        lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NULL AS is_latest FROM events""",
    "v_edges": """SELECT a AS from_id, b AS to_id, CASE k WHEN 0 THEN 'updates' WHEN 1 THEN 'extends' WHEN 2 THEN 'derives' ELSE 'related' END AS rel_type FROM
        (SELECT DISTINCT concat('s', CAST(l_suppkey AS STRING)) AS a, concat('p', CAST(l_partkey AS STRING)) AS b, l_partkey % 4 AS k FROM lineitem) e""",
    "v_relations": """SELECT from_id AS src, to_id AS dst, rel_type AS type, concat(from_id, ' ', rel_type, ' ', to_id) AS label,
        length(to_id) % 3 <> 0 AS active, CAST(substr(from_id, 2) AS BIGINT) * 1000000 + CAST(substr(to_id, 2) AS BIGINT) AS created_at FROM v_edges""",
    "v_eav": """SELECT id, 'type' AS key, CASE WHEN id % 9 = 0 THEN NULL ELSE type END AS string_value, CASE WHEN id % 9 = 0 THEN 1.5 END AS float_value, CAST(NULL AS BIGINT) AS int_value FROM v_memories
        UNION ALL SELECT id, 'source', source, NULL, NULL FROM v_memories WHERE id % 6 <> 0
        UNION ALL SELECT id, 'topic', topic, NULL, NULL FROM v_memories
        UNION ALL SELECT id, 'heat', NULL, heat, NULL FROM v_memories
        UNION ALL SELECT id, 'user_id', NULL, NULL, user_id FROM v_memories WHERE id % 8 <> 0""",
    "v_manifest_a": """SELECT p_partkey AS item, md5(p_name) AS checksum, CAST(p_size AS BIGINT) AS size, CASE p_partkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM part""",
    "v_manifest_b": """SELECT CASE WHEN item % 17 = 0 THEN item + 1000000 ELSE item END AS item, CASE WHEN item % 13 = 0 THEN md5(checksum) ELSE checksum END AS checksum,
        CASE WHEN item % 19 = 0 THEN size + 1 ELSE size END AS size, severity FROM v_manifest_a WHERE item % 11 <> 0""",
    "v_metrics": """SELECT {DAY_TS} AS day, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) AS issues, round(avg(value), 6) AS avg_complexity,
        CAST(sum(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS DOUBLE) AS high_severity FROM events GROUP BY {DAY_TS}""",
    "v_findings": """SELECT event_id AS id, event_type AS tool, CASE WHEN value > 200 THEN 'high' WHEN value > 100 THEN 'medium' ELSE 'low' END AS severity,
        concat(CASE event_id % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'W' WHEN 2 THEN 'S' ELSE 'C' END, CAST(event_id % 100 AS STRING)) AS code, value FROM events""",
    "v_corrections": """SELECT event_id AS id, CAST(user_id % 30 AS STRING) AS topic, event_type AS detail, {EPOCH_TS} AS ts, event_id % 3 = 0 AS fixed FROM events WHERE event_type = 'error'""",
}


def _needs(sql: str) -> list[str]:
    """The views that a text uses, each behind those it needs."""
    out: list[str] = []
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in out:
            for x in [*_needs(VIEWS[name]), name]:
                if x not in out:
                    out.append(x)
    return out


def _in_dialect(sql: str, which: int) -> str:
    for k, v in DIALECT.items():
        sql = sql.replace("{" + k + "}", v[which])
    return sql


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it uses in front."""
    sql = sql.strip()
    parts = [f"{n} AS ({VIEWS[n]})" for n in _needs(sql)]
    if re.match(r"WITH RECURSIVE\b", sql, re.I):
        sql = sql[len("WITH RECURSIVE") :]
        tail = ", " + sql if parts else sql
    elif re.match(r"WITH\b", sql, re.I):
        tail = ", " + sql[4:] if parts else sql[4:]
    else:
        tail = " " + sql
        if not parts:
            return _in_dialect(sql, 1)
    return _in_dialect("WITH RECURSIVE " + ", ".join(parts) + tail, 1)


class Views:
    """The tables and views of a folder, as DataFrames: ``views.documents``, ``views.v_memories``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def cut(self, width: int) -> Views:
        """The same views over texts of documents cut to ``width`` characters where they are read: for
        results that need no more of them, so that no join shuffles whole texts."""
        out = Views(self.spark, self.sf_dir)
        out.documents = self.documents.withColumn("text", F.substring("text", 1, width))
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEWS:
            sql = VIEWS[name]
            used = {x for x in re.findall(r"\b\w+\b", sql) if x in TABLES or x in VIEWS}
            used = {x for x in used if re.search(rf"\b(?:FROM|JOIN)\s+{x}\b", sql)}
            for x in used:
                sql = re.sub(rf"\b(FROM|JOIN)\s+{x}\b", rf"\1 {{{x}}}", sql)
            sql = _in_dialect(sql, 0)
            df = self.spark.sql(sql, **{x: getattr(self, x) for x in used})
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df

"""Small cases with known results, edge cases and properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import filters as P
from mnemora.operators import graph as G
from mnemora.operators import joins as J
from mnemora.operators import lifecycle as L
from mnemora.operators import retrieval as R
from mnemora.operators import windows as X
from mnemora.sources import ingest as S
from mnemora.streaming import streams


def vals(df):
    return sorted(tuple(r) for r in df.collect())


def test_fusion_keeps_the_best_of_equal_contents(spark):
    hits = spark.createDataFrame([(1, "a", "A", 0.6, "x"), (1, "b", "B", 0.7, "x"), (1, "c", "A", 0.5, "y")], "query_id long, id string, content string, score double, source string")
    assert [(r["content"], r["score"]) for r in R.fuse([hits]).orderBy("rank").collect()] == [("B", 0.7), ("A", 0.6)]


def test_payloads(spark):
    raw = spark.createDataFrame([(1, '```json\n{"entities": [{"name": "Zed", "type": "tool"}, {"name": "thing"}]}\n```'), (2, '<think>no</think>{"relations": [{"source": "a", "target": "b", "relation": "uses"}]}'), (3, "not json"), (4, None)], "id int, raw string")
    got = P.extraction_payload_clean(raw, ["thing"])
    assert vals(got.select("id", "kind", "name", "src", "dst")) == [(1, "entity", "Zed", None, None), (2, "relation", None, "a", "b")]


def test_two_steps_reach_three_nodes(spark):
    e = spark.createDataFrame([("P", "U", "r"), ("P", "W", "r")], "from_id string, to_id string, rel_type string")
    s = spark.createDataFrame([("U", "U")], "seed string, node string")
    assert vals(G.bfs_subgraph(e, s, 2).select("node", "depth")) == [("P", 1), ("U", 0), ("W", 2)]
    one, two = ({r["node"] for r in G.bfs_subgraph(e, s, d).collect()} for d in (1, 2))
    assert one <= two


def test_version_chain(spark):
    v = spark.createDataFrame([(i, i - 1 if i else None) for i in range(30)], "id long, parent_id long")
    got = {(r["start_id"], r["depth"], r["id"]) for r in G.version_chain(v, 20).collect()}
    assert got == {(s, d, s - d) for s in range(30) for d in range(0, 21) if s - d >= 0}


def test_alias(spark):
    n = spark.createDataFrame([("Deep Thought", 2), ("deep", 1), ("Other", 5)], "name string, mention_count long")
    e = spark.createDataFrame([("deep", "Other")], "from_id string, to_id string")
    nodes, edges = G.alias_merge(n, e)
    assert vals(nodes) == [("Deep Thought", 3), ("Other", 5)] and vals(edges) == [("Deep Thought", "Other")]


def test_tiers(spark):
    df = spark.createDataFrame([(x,) for x in (32768, 32769, 500000, 0)], "v long")
    tiers = [(32768, 0.8), (131072, 0.65), (409600, 0.5)]
    assert [r[0] for r in df.select(J.tier_lookup(F.col("v"), tiers, 0.3)).collect()] == [0.8, 0.65, 0.3, None]


def test_tokens_of_mixed_text(spark):
    df = spark.createDataFrame([("使用 Spark3 和数据库 a of",), (None,)], "t string")
    assert [sorted(r[0]) for r in df.select(T.tokenize(F.col("t"))).collect()] == [sorted(["使用", "和数据库", "spark3", "of"]), []]


def test_timestamps(spark):
    df = spark.createDataFrame([("12.5",), ("2024-01-01T00:00:00",), ("soon",), (None,)], "at string")
    assert [tuple(r) for r in P.normalize_timestamps(df, ["at"]).select("at", "at_bad").collect()] == [(12.5, None), (1704067200.0, None), (None, "soon"), (None, None)]


def test_edge_is_added_once_and_unknown_kinds_become_related(spark):
    old = spark.createDataFrame([("a", "b", "extends")], "from_id string, to_id string, rel_type string")
    new = spark.createDataFrame([("a", "b", "extends", "r"), ("a", "c", "likes", "r"), ("a", "c", "likes", "r")], "from_id string, to_id string, rel_type string, reason string")
    assert vals(G.add_relations(old, new).select("from_id", "to_id", "rel_type", "label")) == [("a", "b", "extends", None), ("a", "c", "related", "likes")]


def test_dedupe_is_idempotent(spark):
    log = spark.createDataFrame([("x", "user", "hi there"), ("x", "user", "hi there"), ("x", "user", " ")], "channel string, role string, content string")
    first = J.sync_dedupe(log.limit(0), log)
    assert first.count() == 1 and J.sync_dedupe(first, log).count() == 0


def test_near_pairs_are_all_found(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if 1 - x[i] @ x[j] < 0.12}
    assert {(r["a"], r["b"]) for r in J.near_pairs(df, 0.12, pivots=7).collect()} == want and want


def test_expiry_counts_add_up(spark):
    mem = spark.createDataFrame([(1, True, 5.0), (2, True, None), (3, False, 1.0), (4, True, 50.0)], "id long, is_latest boolean, forget_after double")
    assert tuple(L.auto_forget(mem, 10.0, dry_run=True).first()) == (1, 3, 4)


def test_retention_gate(spark):
    mem = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    dec = spark.createDataFrame([(1, "forget"), (2, "keep")], "id long, decision string")
    assert L.retention_delete(mem, dec, 1)[0].count() == 1 and L.retention_delete(mem, dec, 0)[0].count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(h=st.floats(0, 1e3), a=st.floats(0, 1e6), b=st.floats(0, 1e6))
def test_decay_is_monotone(spark, h, a, b):
    lo, hi = sorted((a, b))
    r = spark.range(1).select(T.heat_decay(F.lit(h), F.lit(0.0), lo), T.heat_decay(F.lit(h), F.lit(0.0), hi)).first()
    assert r[0] >= r[1] >= 0


@pytest.mark.parametrize("op", [lambda m: P.recent_memories(m), lambda m: P.retention_decisions(m, 1.0), lambda m: X.top_counts(m, "source"), lambda m: L.auto_forget(m, 1.0)])
def test_empty_tables(spark, op):
    mem = spark.createDataFrame([], "id long, content string, source string, type string, tier string, created_at double, last_mentioned double, forget_after double, is_latest boolean")
    assert op(mem).count() == 0


def test_bulk_append_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "", "x"), (3, None, "y")], "id long, content string, type string")
    assert S.bulk_append(df, str(tmp_path / "t")) == {"added": 1, "failed": 2}
    assert S.scan_memories(spark, str(tmp_path / "t")).count() == 1


def test_audit_log(spark, tmp_path):
    S.append_audit_log(spark.createDataFrame([(0.0, 3)], "at double, deleted long"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).first()["deleted"] == 3


def test_transcript_files(spark, tmp_path):
    d = tmp_path / "s1"
    d.mkdir()
    (d / "t.jsonl").write_text('{"type": "user", "time": "1", "data": {"content": [{"type": "text", "text": "he"}, {"type": "text", "text": "llo"}]}}\n{bad\n')
    got = S.transcripts_jsonl(S.read_transcripts(spark, str(tmp_path / "*" / "*.jsonl")))
    assert vals(got) == [("s1", "user", "hello", "1")]


def test_stream_in_many_batches_equals_one(spark, tmp_path):
    rows = [(k, i, float(i * 7 % 40)) for i in range(40) for k in ("a", "b")]
    for i in range(4):
        spark.createDataFrame(rows[i * 20 : (i + 1) * 20], "channel string, id long, ts double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = streams.stream_table(spark, str(tmp_path / "in"), 1)
    got = streams.drain(streams.stream_topic_heat(src.select(F.col("channel").alias("topic"), "ts")), "h", "update")
    assert {r["topic"]: r["n"] for r in got.groupBy("topic").agg(F.max("n").alias("n")).collect()} == {"a": 40, "b": 40}
    live = streams.drain(streams.stream_live_turns(src.select(F.hash("channel").cast("long").alias("session_id"), F.col("id").alias("pos"), F.lit("u").alias("role"), "ts"), 3), "l", "update")
    assert live.groupBy("session_id").agg(F.max_by("turns", "batch").alias("t")).select("t").distinct().count() == 1
    marks = streams.drain(streams.stream_high_water(src.select("channel", "id", "ts"), "channel", "channel string, id long, ts double"), "m")
    assert marks.groupBy("channel", "ts").count().filter("count > 1").count() == 0

"""Hooks, session sources and the eight verbs, through the public functions."""

import json
import math
import sqlite3

import pytest

from mnemora import memory as M
from mnemora.functions import hooks as H
from mnemora.sources import sessions as X


def test_encoder_is_made_once_and_gets_bounded_batches(spark):
    def make():
        import numpy as np

        calls = []

        def encode(texts):
            calls.append(len(texts))
            assert len(texts) <= 7 and all(len(t) <= 5 for t in texts)
            return np.stack([[len(t), len(calls), 0.0] for t in texts])

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 40)] + [(0, None), (40, "")], "id long, content string").coalesce(1)
    rows = {r["id"]: r["v"] for r in H.embedded(df, make, batch=7, max_chars=5).collect()}
    assert rows[0] is None and all(abs(sum(x * x for x in v) - 1) < 1e-9 for i, v in rows.items() if i)
    assert max(round(v[1] / v[0] * 5) for i, v in rows.items() if i >= 5 and v[0]) == 6  # six calls of one encoder


def test_states_of_tokens_are_pooled():
    import numpy as np

    states, mask = np.array([[[3.0, 0.0], [5.0, 8.0], [99.0, 99.0]], [[0.0, 0.0]] * 3]), np.array([[1, 1, 0], [0, 0, 0]])
    assert H.pooled((states, mask)).tolist() == [[1 / math.sqrt(2), 1 / math.sqrt(2)], [0.0, 0.0]]


def test_extractor_answers_are_cleaned(spark):
    docs = spark.createDataFrame([(1, "we use spark on HDFS and the API"), (2, None), (3, " "), (4, "boom"), (5, "nothing")], "id long, content string")
    got = {tuple(r)[:4] for r in H.extracted(docs, H.rule_extractor({"spark": ("tool", "fast")})).collect()}
    assert got == {(1, "entity", "HDFS", "project"), (1, "entity", "spark", "tool")}

    def make():
        def extract(text):
            if text == "boom":
                raise ValueError(text)
            return '```json\n{"entities": [{"name": "A", "type": "t"}, {"name": "skip"}], "relations": [{"source": "A", "target": "B", "relation": "uses"}]}\n```' if text.startswith("we") else "no json"

        return extract

    rows = H.extracted(docs, make, blacklist=["skip"]).collect()
    assert {(r["id"], r["kind"], r["name"], r["src"], r["relation"]) for r in rows} == {(1, "entity", "A", None, None), (1, "relation", None, "A", "uses")}


def test_two_stores_of_sessions_as_one(spark, tmp_path):
    import zstandard

    lines = [json.dumps({"role": "user", "content": "hello", "timestamp": 1.7e9}), "{broken", json.dumps({"message": {"role": "assistant", "content": [{"text": "a"}, {"type": "image"}, {"text": "b"}]}, "timestamp": "2024-01-01T00:00:00Z"}), "", json.dumps([1]), json.dumps({"role": "user"})]
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/one.jsonl").write_text("\n".join(lines))
    raw = ("\n".join(json.dumps({"role": "user", "content": f"line {i}", "sessionId": "z"}) for i in range(5000))).encode()
    packed = zstandard.ZstdCompressor().compress(raw[:100_000]) + zstandard.ZstdCompressor().compress(raw[100_000:])
    (tmp_path / "t/sub/two.jsonl.zst").write_bytes(packed)
    (tmp_path / "t/cut.jsonl.zstd").write_bytes(packed[: len(packed) // 3])
    (tmp_path / "t/other.txt").write_text("not read")
    db = sqlite3.connect(tmp_path / "state.db")
    db.executescript("CREATE TABLE sessions (id TEXT, source TEXT); CREATE TABLE messages (session_id TEXT, role TEXT, content TEXT, timestamp REAL);")
    db.executemany("INSERT INTO sessions VALUES (?, ?)", [("s1", "web"), ("s2", None)])
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [("s2", "user", "hi", 5.0), ("s1", "user", "q", 1.0), ("s1", "assistant", "a", 2.0), ("s1", "tool", None, 3.0)])
    db.commit()
    db.close()
    a, b = X.session_source(spark, "transcripts", str(tmp_path / "t"), "files"), X.session_source(spark, "sqlite_sessions", str(tmp_path / "state.db"), "db")
    assert a.rdd.getNumPartitions() == 3
    rows, bad = X.union_sessions(a, b)
    got = {(r["source"], r["session_id"], r["pos"]): (r["role"], r["content"], r["ts"]) for r in rows.collect()}
    assert got["files", "one", 0] == ("user", "hello", 1.7e9) and got["files", "one", 2] == ("assistant", "a\nb", 1704067200.0)
    assert sum(k[:2] == ("files", "z") for k in got) == 5000 and got["files", "z", 4999][1] == "line 4999"
    assert {k: v for k, v in got.items() if k[0] != "files"} == {("db", "s2", 0): ("user", "hi", 5.0), ("web", "s1", 0): ("user", "q", 1.0), ("web", "s1", 1): ("assistant", "a", 2.0)}
    counts = {r["source"]: r["bad"] for r in bad.collect()}
    assert counts["files"] in (3, 4, 5) and counts["web"] == 1


def store(spark):
    texts = ["spark joins large tables", "cats sleep all day", "large joins in spark need keys", None]
    mem = spark.createDataFrame([(i, t, "t", "s", "text", "hot", float(i), 100.0 + i, i != 1) for i, t in enumerate(texts)], "id long, content string, topic string, source string, type string, tier string, heat double, created_at double, is_latest boolean")
    edges = spark.createDataFrame([("spark", "joins", "extends"), ("joins", "keys", "derives")], "from_id string, to_id string, rel_type string")
    return M.Store(mem, edges, encoder=H.hashing_encoder())


def test_verbs(spark):
    s = store(spark)
    q = spark.createDataFrame([(1, "spark joins"), (2, "cats sleep")], "query_id long, q string")
    hits = {k: [(r["query_id"], r["id"], r["source"]) for r in M.search(s, q, 3, k).orderBy("query_id", "rank").collect()] for k in ("vector", "hybrid", "graph", "all")}
    assert hits["vector"][0] == (1, "0", "vector") and not any(i == "1" for _, i, _ in hits["vector"])  # 1 isn't the latest
    assert {x for _, x, _ in hits["graph"]} == {"joins", "spark", "keys"} and {x for *_, x in hits["all"]} >= {"vector", "graph"} and hits["hybrid"]
    with pytest.raises(ValueError):
        M.search(s, q, source="cold")
    more = M.save(s, spark.createDataFrame([(9, "cats sleep on keys")], "id long, content string"), 500.0)
    new = {r["id"]: (r["topic"], r["created_at"], r["is_latest"]) for r in more.memories.collect()}
    assert new[9] == ("external", 500.0, True) and len(new) == 5
    assert [r["id"] for r in M.search(more, q, 1, "vector").filter("query_id = 2").collect()] == ["9"]
    assert [r["id"] for r in M.recent(more, 2).collect()] == [9, 3]
    assert {r["id"] for r in M.delete(more, spark.createDataFrame([(9,), (0,), (77,)], "id long")).memories.collect()} == {1, 2, 3}
    reach, between = M.graph(s, spark.createDataFrame([("spark",)], "name string"))
    assert {(r["node"], r["depth"]) for r in reach.collect()} == {("spark", 0), ("joins", 1), ("keys", 2)} and between.count() == 2
    grown = M.graph_add(s, spark.createDataFrame([("keys", "hash", "made of", "why"), ("spark", "joins", "extends", "")], "from_id string, to_id string, rel_type string, reason string"))
    assert {tuple(r) for r in grown.edges.collect()} - {tuple(r) for r in s.edges.collect()} == {("keys", "hash", "related")}
    assert tuple(M.status(grown).first()) == (4, 4, 3)
    assert [r["text"] for r in M.profile(more, latest=1).collect()] == ["hot: t", "memories: 5", "recent: cats sleep on keys"]

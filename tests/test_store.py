"""Stored turns, chains in context, learned names, health, rebuilding and listings, by their cases."""

import pytest

from mnemora.operators import aggregates as A
from mnemora.operators import graph as G
from mnemora.operators import lifecycle as L
from mnemora.operators import retrieval as R
from mnemora.operators import windows as X
from mnemora.sources import ingest as S


def test_what_turns_leave(spark):
    turns = [(1, 10, "Tell me about PCG tools", "They build scenes"), (2, 10, "ok", "the UE5 engine is fine"), (3, 11, "ok", "!"), (4, 11, "/status now please", "all is well here"), (5, 12, "a new thing entirely that is rather long", None), (6, 12, None, None), (7, 13, "hm", "long enough reply")]
    t = spark.createDataFrame(turns, "id long, session_id long, user_text string, assistant_text string")
    topics = spark.createDataFrame([("pcg", 1.0, "active"), ("UE5", 5.0, "active"), ("hot", 30.0, "active"), ("hotter", 90.0, "done")], "name string, heat double, status string")
    rows, mentions = L.store_conversation(t, topics, ["ok"], 7.0)
    assert {(r["topic"], r["session_id"], r["summary"]) for r in mentions.collect()} == {
        ("pcg", 10, "Tell me about PCG tools -> They build scenes"), ("UE5", 10, "ok -> the UE5 engine is fine"), ("hot", 11, "ok -> !"), ("/status now please", 11, "/status now please -> all is well here"),
        ("a new thing entirely that is r", 12, "a new thing entirely that is rather long -> "), ("hot", 12, " -> "), ("hot", 13, "hm -> long enough reply"),
    }
    got = {(r["id"], r["role"]): (r["topic"], r["content"]) for r in rows.collect()}
    assert set(got) == {(1, "user"), (1, "assistant"), (2, "assistant"), (4, "assistant"), (5, "user"), (7, "assistant")}
    assert got[1, "assistant"] == ("pcg", "assistant: They build scenes") and {r["tier"] for r in rows.collect()} == {"warm"}


def test_context_has_the_chain_first(spark):
    v = spark.createDataFrame([(1, None, "one"), (2, 1, "two"), (3, 2, "three"), (9, None, "alone")], "id long, parent_id long, content string")
    edges = spark.createDataFrame([(2, 9, "extends")], "from_id long, to_id long, rel_type string")
    ids = spark.createDataFrame([(2,), (9,)], "id long")
    got = [(r["node"], r["text"]) for r in G.graph_context(edges, ids, versions=v).orderBy("node", "line_no").collect()]
    assert got == [(2, "[ancestor] one"), (2, "[current] two"), (2, "[descendant] three"), (2, "2 -extends-> 9"), (9, "2 -extends-> 9")]


def test_names_of_several_words_and_with_endings(spark):
    text = "We run RTX 2080 Ti and ComfyUI. The Board was the one. 我们用记忆系统和图像处理模型 CPU ACP 《长名》"
    docs = spark.createDataFrame([(i, t) for i in range(2) for t in (text,)] + [(5, None)], "doc_id long, text string")
    known = spark.createDataFrame([("记忆系统",)], "name string")
    got = {r["name"] for r in G.learn_entities(docs, known, ["the"], ["CPU"]).collect()}
    assert {"RTX 2080 Ti", "长名"} <= got and not {"记忆系统", "ACP", "The"} & got
    assert not any("was" in n or "记忆系统" in n for n in got)
    plain = {r["name"] for r in G.learn_entities(docs, known, ["the"], ["CPU"], more_words=0, endings="").collect()}
    assert plain == {"ComfyUI.", "Board", "CPU", "长名"} or plain == {"ComfyUI", "Board", "CPU", "长名"}


def test_nodes_are_listed_with_type_and_attr(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "from_id string, to_id string")
    nodes = spark.createDataFrame([("a", "tool", "fast"), ("z", None, "")], "name string, type string, attr string")
    assert [r["text"] for r in G.node_listing(edges, 3, nodes).orderBy("line_no").collect()] == ["a [tool] 2 fast", "b 1", "c 1"]


def test_health_of_queue_and_times(spark):
    eav = spark.createDataFrame([(1, "created_at", "2024", None, None), (1, "type", "x", None, None)], "id long, key string, string_value string, float_value double, int_value long")
    for depth, want in ((0, "ok"), (50, "warn"), (500, "fail")):
        got = {r["check"]: (r["value"], r["status"]) for r in A.store_health(eav, eav.select("id"), spark.range(depth)).collect()}
        assert got["queue"] == (depth, want) and got["text_times"] == (1, "fail") and got["orphans"] == (0, "ok")
    assert "queue" not in {r["check"] for r in A.store_health(eav, eav.select("id")).collect()}


def test_a_store_is_rebuilt_and_verified(spark, tmp_path):
    eav = spark.createDataFrame([(1, "type", "x", None, None), (2, "type", None, 1.0, None)], "id long, key string, string_value string, float_value double, int_value long")
    content = spark.createDataFrame([(1, "one"), (2, None), (3, "three")], "id long, content string")
    fresh, verdict = L.rebuild_written(eav, content, ["type"], str(tmp_path / "new"))
    assert tuple(verdict.first()) == (3, 3, 3, True) and {(r["type"], r["content"]) for r in fresh.collect()} == {("x", "one"), (None, None), (None, "three")}
    with pytest.raises(Exception, match="(?i)exists"):
        L.rebuild_written(eav, content, ["type"], str(tmp_path / "new"))


def test_sessions_are_excavated_by_id_and_messages_fall_back(spark):
    msg = spark.createDataFrame([(i, s, p, "user", f"m{i}") for i, s, p in ((1, 1, 0), (2, 1, 1), (3, 2, 0), (4, 1, 2))], "id long, session_id long, pos long, role string, content string")
    ses = spark.createDataFrame([(1, "t1", 5.0), (2, "t2", 9.0), (3, "t3", 99.0)], "session_id long, title string, started_at double")
    ids = spark.createDataFrame([(1,), (1,), (3,)], "session_id long")
    got = {r["session_id"]: (r["title"], [m["content"] for m in r["messages"]]) for r in R.excavate_sessions(msg, ses, ids, 2).collect()}
    assert got == {1: ("t1", ["m1", "m2"])}
    got = sorted((r["asked_id"], r["session_id"], r["id"]) for r in X.first_messages_or_recent(msg, ses, ids, 2).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (3, 2, 3)]


def test_profiles_as_text_and_small_counts(spark):
    mem = spark.createDataFrame([(1, 7, "static", 30.0, "likes tea"), (2, 7, "dynamic", 15.0, "is busy"), (3, 7, "static", 40.0, "lives here"), (4, 8, "dynamic", 1.0, None)], "id long, user_id long, kind string, heat double, content string")
    got = {r["user_id"]: r["text"] for r in L.profile_text(L.profile_view(mem), mem).collect()}
    assert got == {7: "static:\n- lives here\n- likes tea\ndynamic:\n- is busy", 8: "dynamic:\n- "}
    log = spark.createDataFrame([(1, "ab", False), (2, "xb", True), (3, None, False)], "id long, topic string, fixed boolean")
    assert L.fixed_count(log, "b").first()["fixed"] == 1
    new = spark.createDataFrame([("t", "d")], "topic string, detail string")
    old = spark.createDataFrame([], "topic string, detail string, ts double, fixed boolean")
    assert [(r["fixed"], r["note"]) for k in ("correction", "success", "rule") for r in S.append_corrections(old, new, 1.0, k).collect()] == [(False, "[t] d"), (True, "success: [t] d"), (True, "rule: [t] d")]

"""Streams over several batches against plain Python, and short full-text queries."""

from mnemora.operators import joins as J
from mnemora.streaming import streams as S


def batches(spark, tmp_path, parts, schema):
    import os
    import time

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("*.parquet"):
            if not (tmp_path / f.name).exists():
                (tmp_path / f.name).touch()
                os.utime(f, (time.time() - 100 + i, time.time() - 100 + i))
    return S.stream_table(spark, str(tmp_path / "in"), 1)


def test_high_water_drops_late_rows_and_ties(spark, tmp_path):
    parts = [[("a", 3, 1.0), ("a", 2, 1.0), ("b", 1, 5.0)], [("a", 4, 0.5), ("a", 5, 2.0), ("b", 6, 5.0), ("c", 7, None), (None, 8, 1.0)], [("a", 9, 2.0), ("b", 10, 6.0), (None, 11, 0.5)]]
    src = batches(spark, tmp_path, parts, "channel string, id long, ts double")
    got = S.high_water_rows(src, "channel").collect()
    assert sorted(r["id"] for r in got) == [1, 2, 5, 8, 10]


def test_topic_heat_over_batches(spark, tmp_path):
    parts = [[("a", 1e6 + 9000.0 * i) for i in range(20)] + [("b", 5.0)], [("a", 1e6), ("a", 2e6), ("a", 2.1e6)], [("c", 7.0), ("b", 8.0), ("a", None)]]
    src = batches(spark, tmp_path, parts, "topic string, ts double")
    want = {}
    for rows in parts:
        for topic, ts in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
            n, last, h = want.get(topic, (0, ts, 0.0))
            want[topic] = (n + 1, max(last, ts), h * 0.5 ** (max(0.0, ts - last) / 43200) + 20)
    got = {r["topic"]: (r["n"], r["last"], r["heat"]) for r in S.topic_heat_table(src).collect()}
    assert got.keys() == want.keys()
    for t in want:
        assert got[t][:2] == want[t][:2] and abs(got[t][2] - want[t][2]) < 1e-9


def test_short_queries_are_found(spark):
    msg = spark.createDataFrame([(1, "An ox"), (2, "a cat"), (3, None), (4, "x")], "id long, content string")
    qs = spark.createDataFrame([(1, "OX"), (2, "x"), (3, "cat"), (4, ""), (5, None), (6, "a c")], "query_id long, q string")
    got = sorted((r["query_id"], r["id"]) for r in J.fulltext_join(msg, qs).collect())
    assert got == [(1, 1), (2, 1), (2, 4), (3, 2), (6, 2)]


def more(spark, tmp_path, rows, schema):
    """One more file for a stream that ``batches`` began."""
    import time

    time.sleep(1.1)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def latest(df, *columns):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["batch"], not r["live"] if "live" in r else True)):
        out[r[columns[0]]] = tuple(r[c] for c in columns[1:])
    return out


def test_live_turns_expire_and_survive_a_restart(spark, tmp_path):
    schema, folder = "session_id long, pos long, role string, ts double", str(tmp_path / "state")
    parts = [[(1, i, "user", 60.0 * i) for i in range(15)] + [(2, 0, "user", 100.0), (None, 0, "user", 1.0), (3, 1, None, None)], [(1, 15, "assistant", 960.0), (4, 0, "user", 2000.0)]]
    src = batches(spark, tmp_path, parts, schema)
    got = latest(S.drain(S.stream_live_turns(src), "turns", "update", folder), "session_id", "turns", "live")
    ten = ",".join(f"user:{i}" for i in range(6, 15)) + ",assistant:15"
    assert got == {1: (ten, True), 2: ("user:0", False), 4: ("user:0", True)}
    # started again: session 1 goes on with its turns, then goes when it is idle for 30 minutes
    more(spark, tmp_path, [(1, 16, "user", 2500.0)], schema)
    got = latest(S.drain(S.stream_live_turns(src), "turns", "update", folder), "session_id", "turns", "live")
    assert got[1] == (",".join(f"user:{i}" for i in range(7, 15)) + ",assistant:15,user:16", True)
    more(spark, tmp_path, [(5, 0, "user", 2500.0 + 1800)], schema)
    got = latest(S.drain(S.stream_live_turns(src), "turns", "update", folder), "session_id", "turns", "live")
    assert not got[1][1] and not got[4][1] and got[5] == ("user:0", True)
    more(spark, tmp_path, [(1, 17, "user", 5000.0)], schema)
    got = latest(S.drain(S.stream_live_turns(src), "turns", "update", folder), "session_id", "turns", "live")
    assert got[1] == ("user:17", True)  # its state had gone


def test_topic_heat_keeps_sessions_and_survives_a_restart(spark, tmp_path):
    schema, folder = "topic string, session_id long, ts double", str(tmp_path / "state")
    first = [("a", i % 9, 1e6 + 5000.0 * i) for i in range(40)] + [("b", None, 5.0), (None, 1, 5.0), ("b", 1, None)]
    second = [("a", 3, 1.1e6), ("a", 77, 1.5e6), ("c", 1, 7.0), ("a", 5, 1e6 + 1.0)]
    src = batches(spark, tmp_path, [first], schema)
    S.drain(S.stream_topic_heat(src, keep=4), "heat", "update", folder)
    more(spark, tmp_path, second, schema)
    got = latest(S.drain(S.stream_topic_heat(src, keep=4), "heat", "update", folder), "topic", "n", "last", "heat", "session_ids")
    rows = [r for r in first + second if r[0] and r[2] is not None]
    for topic in "abc":
        own = [r for r in rows if r[0] == topic]
        last = max(r[2] for r in own)
        n, at, heat, sessions = got[topic]
        assert (n, at) == (len(own), last) and abs(heat - sum(20 * 0.5 ** ((last - r[2]) / 43200) for r in own)) < 1e-9
        met = {}
        for _, s, ts in own:
            if s is not None:
                met[s] = max(ts, met.get(s, 0))
        assert sessions == sorted(met, key=lambda s: (met[s], s))[-4:]


def test_high_water_marks_survive_a_restart_and_expire(spark, tmp_path):
    schema = "channel string, id long, ts double"
    src = batches(spark, tmp_path, [[("a", 3, 1.0), ("a", 2, 1.0), ("b", 1, 5.0), ("a", 9, None)], [("a", 4, 0.5), ("a", 5, 2.0), ("c", 6, 5.0)]], schema)
    run = {
        "keyed": lambda: S.drain(S.stream_high_water(src, "channel"), "marks", "append", str(tmp_path / "keyed")),
        "table": lambda: S.high_water_rows(src, "channel", str(tmp_path / "table"), expire=50.0),
        "short": lambda: S.drain(S.stream_high_water(src, "channel", ttl="50 seconds"), "marks", "append", str(tmp_path / "short")),
    }
    for f in run.values():
        assert sorted(r["id"] for r in f().collect()) == [1, 2, 5, 6]
    more(spark, tmp_path, [("a", 7, 1.5), ("a", 8, 3.0), ("b", 10, 100.0)], schema)
    for f in run.values():
        assert sorted(r["id"] for r in f().collect()) == [1, 2, 5, 6, 8, 10]
    more(spark, tmp_path, [("a", 11, 2.5), ("c", 12, 1.0), ("a", 13, 60.0), ("b", 14, 90.0)], schema)
    for name, also in (("keyed", [13]), ("table", [11, 12, 13]), ("short", [13])):  # the marks of a and c lay 97 and 95 behind
        assert sorted(r["id"] for r in run[name]().collect()) == sorted([1, 2, 5, 6, 8, 10, *also])


def test_sync_reads_the_key_parts_that_it_touches(spark, tmp_path):
    schema, folder = "id long, channel string, role string, content string", str(tmp_path / "sync")
    rows = lambda *xs: [(i, "c", "user", t) for i, t in xs]
    src = batches(spark, tmp_path, [rows((1, "a"), (2, "b"), (3, "a"), (4, " ")) + [(9, None, "user", "n")], rows((5, "b"), (6, "d"), (7, "t")) + [(8, "c", "tool", "x")]], schema)
    target = spark.createDataFrame(rows((0, "t")), schema)
    run = lambda: sorted(r["id"] for r in S.stream_incremental_sync(src, target, 0, folder, buckets=4).collect())
    assert run() == [1, 2, 6, 9]
    more(spark, tmp_path, rows((10, "a"), (11, "e"), (12, "d")), schema)
    assert run() == [1, 2, 6, 9, 11]
    parts = spark.read.parquet(f"{folder}/keys")
    assert {"bucket", "batch"} <= set(parts.columns) and parts.count() == 5 and parts.select("key").distinct().count() == 5


def test_a_sync_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """The last batch is made uncommitted, as by a crash behind its writes, and is run again."""
    schema, folder = "id long, channel string, role string, content string", tmp_path / "sync"
    src = batches(spark, tmp_path, [[(1, "c", "user", "a")], [(2, "c", "user", "b"), (3, "c", "user", "a")]], schema)
    run = lambda: sorted(r["id"] for r in S.stream_incremental_sync(src, spark.createDataFrame([], schema), 0, str(folder)).collect())
    assert run() == [1, 2]
    for f in (folder / "checkpoint/commits").iterdir():
        if f.name.strip(".").startswith("1"):
            f.unlink()
    assert run() == [1, 2] and spark.read.parquet(f"{folder}/keys").count() == 2


def test_sessions_leave_facts_and_the_last_summaries(spark, tmp_path):
    schema, folder = "session_id long, pos long, role string, content string, ts double", str(tmp_path / "end")
    first = [(s, p, "user" if p % 2 else "assistant", "we decided to keep number %d of it" % s if p == 1 else "small talk, nothing more", 10_000.0 * s + p) for s in range(1, 6) for p in range(3)] + [(2, 9, "user", None, 20_005.0)]
    src = batches(spark, tmp_path, [first], schema).selectExpr("*", "timestamp_seconds(ts) as at")
    run = lambda: S.end_sessions(src, ["decided"], [], [(["keep"], "kept")], folder, keep=3)
    facts, summaries = run()
    assert {(r["session_id"], r["kind"], r["fact"], r["topic"]) for r in facts.collect()} == {(s, "decision", f"we decided to keep number {s} of it", "kept") for s in range(1, 5)}
    assert {(r["session_id"], r["turns"], r["facts"]) for r in summaries.collect()} == {(2, 4, 1), (3, 3, 1), (4, 3, 1)}
    more(spark, tmp_path, [(7, 0, "user", "hi", 90_000.0)], schema)
    facts, summaries = run()
    assert facts.count() == 5 and {r["session_id"] for r in summaries.collect()} == {3, 4, 5}


def test_routes_take_an_id_once(spark, tmp_path):
    schema = "id long, channel string, ts double"
    src = batches(spark, tmp_path, [[(1, "chat", 1.0), (2, None, 2.0)], [(1, "chat", 1.0), (3, "x", 3.0), (4, "chat", 4.0)]], schema).selectExpr("*", "timestamp_seconds(ts) as at")
    out = {k: sorted(r["id"] for r in df.collect()) for k, df in S.stream_route(src, ["chat"]).items()}
    assert out == {"chat": [1, 4], "rest": [2, 3]}

"""Rules of sessions, facts, pages, manifests and retention, by their cases."""

from mnemora.operators import aggregates as A
from mnemora.operators import filters as P
from mnemora.operators import joins as J
from mnemora.operators import lifecycle as L
from mnemora.sources import ingest as S


def test_why_sessions_are_skipped(spark):
    ses = spark.createDataFrame([(i, f"t{i}", "cron" if i == 7 else "web") for i in range(1, 9)], "session_id long, title string, source string")
    long = "an answer of some length"
    said = {1: [("user", "hello"), ("assistant", long)], 2: [("user", "ok"), ("assistant", long)], 3: [("user", "ok"), ("assistant", "short")], 4: [("user", "a question that is long"), ("assistant", "no")], 6: [("user", None), ("assistant", None)], 7: [("user", "a question that is long")], 8: [("user", "thanks。"), ("user", "  a question that is long  ")]}
    rows = [(k, n, role, text) for k, turns in said.items() for n, (role, text) in enumerate(turns)]
    msg = spark.createDataFrame(rows, "session_id long, pos long, role string, content string")
    got = {r["session_id"]: (r["skip_reason"], r["user_text"], r["user_count"]) for r in A.valuable_sessions(ses, msg, ["thanks"], []).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "too_short", 2: "too_short", 3: "trivial", 4: None, 5: "empty", 6: "trivial", 7: "cron", 8: None}
    assert got[8][1:] == ("a question that is long", 1)


def test_captured_facts_have_kind_and_topic(spark):
    turns = [(1, 1, "user", "We decided to use the new index. Nothing else."), (1, 2, "assistant", "user: The framework has a version for it\nand the model is large enough"), (1, 3, "user", None), (2, 1, "user", "tiny"), (3, 1, None, "we decided to keep all of it here")]
    t = spark.createDataFrame([(s * 10 + p, s, p, r, c) for s, p, r, c in turns], "id long, session_id long, pos long, role string, content string")
    facts = L.capture_facts(t, ["decided"], ["framework", "model"], [(["index"], "search"), (["framework"], "code")])
    assert sorted(map(tuple, facts.collect())) == [
        (1, "decision", "We decided to use the new index", "search"),
        (1, "tech", "and the model is large enough", "general"),
        (1, "tech", "user: The framework has a version for it", "code"),
        (3, "decision", ": we decided to keep all of it here", "general"),
    ]
    ents = spark.createDataFrame([(1, "x"), (1, "y")], "session_id long, name string")
    assert {tuple(r) for r in L.capture_counts(t, facts, ents).collect()} == {(1, 3, 2, 0), (2, 0, 0, 0), (3, 1, 0, 0)}


def test_tags_are_removed_from_bodies(spark):
    html = "<title>T</title><article><p>" + "a <b>bo</b>ld word&nbsp;and more. " * 8 + "</p></article>"
    r = S.page_body_extract(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert r["body"].startswith("a bold word and more.")


def test_files_that_changed_are_told_apart(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("sub/b.txt", "two"), ("c.txt", "three"), ("d.txt", "")):  # Spark's reader leaves empty files out
        (tmp_path / "x" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "x" / name).write_text(text)
    listed = spark.createDataFrame([("a.txt",), ("gone.txt",)], "item string")
    one = spark.createDataFrame(S.file_manifest(spark, str(tmp_path / "x"), listed).collect(), "item string, exists boolean, size long, mtime timestamp, checksum string")
    assert {(r["item"], r["exists"], r["size"]) for r in one.collect()} == {("a.txt", True, 3), ("sub/b.txt", True, 3), ("c.txt", True, 5), ("gone.txt", False, None)}
    (tmp_path / "x/a.txt").write_text("onE")
    (tmp_path / "x/c.txt").write_text("threes")
    (tmp_path / "x/sub/b.txt").unlink()
    two = S.file_manifest(spark, str(tmp_path / "x"))
    side = lambda df: df.filter("exists").selectExpr("item", "checksum", "size", "'info' as severity")
    assert {(r["item"], r["change"]) for r in J.snapshot_diff(side(one), side(two)).collect()} == {("a.txt", "content"), ("c.txt", "content"), ("sub/b.txt", "missing")}


def test_checksums_tell_rows_apart(spark):
    sums = lambda rows: {r["checksum"] for r in S.snapshot_manifest(spark.createDataFrame(rows, "k string, a string, b string"), "k").collect()}
    base = [("k", "x", "yz"), ("k", None, "~")]
    assert sums(base) == sums(base[::-1])
    assert len({tuple(sums(r)) for r in (base, base + base[:1], [("k", "xy", "z"), base[1]], [base[0], ("k", "~", None)])}) == 4


def test_protected_sources_are_the_callers(spark):
    mem = spark.createDataFrame([(1, "mine", "y", "cold", "c", None, 1.0), (2, "x", "y", "cold", "c", None, 1.0)], "id long, source string, type string, tier string, content string, last_mentioned double, created_at double")
    assert {r["id"]: r["decision"] for r in P.retention_decisions(mem, 1e9, sources=["mine"]).collect()} == {1: "keep", 2: "forget"}

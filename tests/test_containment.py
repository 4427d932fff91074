"""Probes at any place of a text, terms of several words, graph records, chains in both directions."""

import random

from mnemora.operators import filters as P
from mnemora.operators import graph as G
from mnemora.operators import joins as J


def test_containments_equal_brute_force(spark):
    r = random.Random(7)
    word = lambda a, b: "".join(r.choice("ab 中é\n") for _ in range(r.randint(a, b)))
    texts = [(i, word(0, 60)) for i in range(60)] + [(60, word(1500, 1500)), (61, None), (62, ""), (None, "aaaa")]
    probes = [word(1, n) for n in (1, 2, 3, 5, 6) for _ in range(8)] + [texts[60][1][i : i + 40] for i in (0, 495, 505, 1000, 1460)] + ["", None, "ab", "ab"]
    t = spark.createDataFrame(texts, "id long, text string").repartition(4)
    got = J.containments(t, spark.createDataFrame([(p,) for p in probes], "probe string")).collect()
    want = {(i, p) for i, x in texts for p in probes if i is not None and x is not None and p and p in x}
    assert len(got) == len(want) and {(x["id"], x["probe"]) for x in got} == want


def test_fulltext_join_ignores_case_and_finds_short_queries(spark):
    msg = spark.createDataFrame([(1, "An Apple"), (2, "no"), (3, None)], "id long, content string")
    q = spark.createDataFrame([(1, "apple"), (2, "O"), (3, ""), (4, None), (5, "APPLE")], "query_id long, q string")
    assert sorted(map(tuple, J.fulltext_join(msg, q).collect())) == [(1, 1), (2, 2), (5, 1)]


def test_repair_finds_the_first_forty_characters_anywhere(spark):
    long = "the quarterly figures were sent to everybody"
    mem = spark.createDataFrame([(1, long + " today"), (2, long + " again"), (3, "short one"), (4, "nowhere at all"), (5, ""), (6, None)], "id long, content string")
    msg = spark.createDataFrame([(9, "s2", f"x({long}!)"), (8, "s1", f"<b>{long[:39]}"), (10, "s3", f"{long}"), (11, "s4", "ashort ones")], "id long, session_id string, content string")
    ses = spark.createDataFrame([("s2", "web"), ("s4", None)], "session_id string, source string")
    got = {r["id"]: (r["session_id"], r["source"], r["type"]) for r in J.repair_by_lookup(mem, msg, ses).collect()}
    none = (None, "unknown", "text")
    assert got == {1: ("s2", "web", "conversation"), 2: ("s2", "web", "conversation"), 3: ("s4", "cli", "conversation"), 4: none, 5: none, 6: none}


def test_terms_of_several_words_and_inside_cjk_runs(spark):
    docs = spark.createDataFrame([(1, "We use Solar Agent daily"), (2, "solar and an agent"), (3, "我们在用小明工具"), (4, "小明"), (5, "reagents"), (6, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("solar agent",), ("小明",), ("agent",), ("agent",), ("",), (None,)], "term string")
    got = sorted(map(tuple, J.dictionary_match(docs, terms).collect()))
    assert got == [(1, "agent"), (1, "solar agent"), (2, "agent"), (3, "小明"), (4, "小明")]
    topics = spark.createDataFrame([("A", ["Solar Agent", "solar"]), ("B", ["小明"]), ("C", None)], "topic string, terms array<string>")
    assert sorted(map(tuple, J.topic_detect(docs, topics).collect())) == [(1, "A"), (2, "A"), (3, "B"), (4, "B")]


def test_retention_keeps_records_of_the_graph(spark):
    cols = "id long, source string, type string, tier string, content string, last_mentioned double, created_at double"
    rows = [(1, "x", "y", "cold", "c", None, 1.0, "extends"), (2, "x", "y", "cold", "c", None, 1.0, ""), (3, "x", "y", "cold", "c", None, 1.0, None), (4, "x", "decision", "cold", "c", None, 1.0, "extends")]
    mem = spark.createDataFrame(rows, cols + ", rel_type string")
    got = {r["id"]: (r["decision"], r["reason"]) for r in P.retention_decisions(mem, 1e9).collect()}
    assert got == {1: ("keep", "graph record"), 2: ("forget", "old creation"), 3: ("forget", "old creation"), 4: ("keep", "protected type")}


def test_chain_in_both_directions_and_round_a_cycle(spark):
    v = spark.createDataFrame([(1, None), (2, 1), (3, 2), (7, 8), (8, 7), (9, 9)], "id long, parent_id long")
    down = {tuple(r) for r in G.version_chain(v, 20, "descendants").filter("start_id < 7").collect()}
    assert down == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (1, 1, 2), (1, 2, 3), (2, 1, 3)}
    both = {tuple(r) for r in G.version_chain(v, 20, "both").filter("start_id = 2").collect()}
    assert both == {(2, 0, 2), (2, 1, 1), (2, -1, 3)}
    ring = {tuple(r) for r in G.version_chain(v).filter("start_id >= 7").collect()}
    assert ring == {(7, 0, 7), (8, 0, 8), (9, 0, 9), (7, 1, 8), (8, 1, 7)}


def test_shards_and_blocks_give_the_same_rows(spark):
    from mnemora.operators import containment as C

    r = random.Random(3)
    word = lambda a, b: "".join(r.choice("ab 中é\n") for _ in range(r.randint(a, b)))
    texts = [(i // 2, word(0, 90)) for i in range(80)] + [(70, "z" * 3000 + word(40, 40)), (71, None), (None, "ab")]
    probes = list({word(1, n) for n in (1, 2, 4, 9, 14) for _ in range(12)}) + ["zz", "z" * 50, texts[80][1][-15:]]
    t = spark.createDataFrame(texts, "id long, text string").repartition(3)
    p = spark.createDataFrame([(x,) for x in probes + [None, ""]], "probe string")
    want = {(i, x) for i, text in texts for x in probes if i is not None and text is not None and x in text}
    for chars, most in ((1 << 18, 16), (60, 1000), (60, 1)):
        got = C.containments(t, p, chars, most).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert C.containments(t, p.limit(0)).count() == 0 and C.containments(t.limit(0), p).count() == 0


def test_a_scan_shuffles_hits_and_not_places(spark):
    from mnemora.operators import containment as C

    t = spark.range(50).selectExpr("id", "concat('the quick brown fox ', id, ' ', repeat('jumps over the lazy dog ', 400)) as text")
    plan = C.containments(t, spark.createDataFrame([("fox 7 ",), ("no such text",)], "probe string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_entities_by_parts_of_names(spark):
    from mnemora.operators import retrieval as R

    edges = spark.createDataFrame([("PCG", "pcg tools"), ("UE5", "x")], "from_id string, to_id string")
    q = spark.createDataFrame([(1, "pcg"), (2, "the UE5 engine"), (3, ""), (4, "none")], "query_id long, q string")
    got = sorted(map(tuple, R.entity_search(edges, q, 3).collect()))
    assert got == [(1, "PCG"), (1, "pcg tools"), (2, "UE5"), (3, "PCG"), (3, "UE5"), (3, "pcg tools")]

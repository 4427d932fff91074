"""The metric tree, linked sets, nearest sets, merging, profiles and aliases against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.operators import graph as G
from mnemora.operators import joins as J
from mnemora.operators import lifecycle as L
from mnemora.operators import neighbours as N


def vectors(seed, n, copies=0, width=8, spread=0.1):
    """Unit vectors; of the last ones, each is near an earlier one."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, width))
    if copies:
        m[-copies:] = m[rng.integers(0, n - copies, copies)] + spread * rng.normal(size=(copies, width))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def table(spark, m, more=()):
    rows = [(i, [float(x) for x in v], "t" if i % 3 else "u") for i, v in enumerate(m)] + list(more)
    return spark.createDataFrame(rows, "id long, v array<double>, kind string").repartition(4)


def brute(m, threshold):
    far = 1 - m @ m.T
    return {(a, b) for a in range(len(m)) for b in range(a + 1, len(m)) if far[a, b] < threshold}


@pytest.mark.parametrize("leaf, pivots, key", [(1024, 16, None), (20, 4, None), (12, 5, "kind")])
def test_tree_finds_all_pairs(spark, leaf, pivots, key):
    m = vectors(1, 240, 60)
    m[200:220] = m[3]  # a dense group that no cut parts
    want = {(a, b) for a, b in brute(m, 0.08) if not key or (a % 3 > 0) == (b % 3 > 0)}
    got = N.near_pairs(table(spark, m, [(900, None, "t"), (None, [1.0] + [0.0] * 7, "t"), (901, [0.0] * 7 + [1.0], None)]), 0.08, key, leaf, pivots).collect()
    pairs = [(r["a"], r["b"]) for r in got]
    extra = {p for p in pairs if 901 in p}  # without a key, the row without kind takes part
    assert len(pairs) == len(set(pairs)) and set(pairs) - extra == want and (key is None or not extra)


@pytest.mark.parametrize("threshold", [0.08, 0.15])
def test_candidates_grow_less_than_rows(spark, threshold):
    """Pairs to look at per row, at ten times the rows in the same space (so ten times as dense)."""
    per_row = []
    for n in (400, 4000):
        m = vectors(2, n, n // 10, width=4, spread=0.05)
        leaves = N.cells(table(spark, m).select(F.lit("c").alias("cell"), "id", "v"), (2 * threshold) ** 0.5 / 4, leaf=40, pivots=8)
        work = leaves.groupBy("cell").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("n")).selectExpr("sum(h * n) as w", "sum(h) as rows").first()
        assert work["rows"] == n
        per_row.append(work["w"] / n)
    assert per_row[1] < 5 * per_row[0]


def test_empty_and_single_tables(spark):
    for n in (0, 1):
        assert N.near_pairs(table(spark, vectors(1, max(n, 1))).limit(n), 0.2).count() == 0


def test_connected_sets(spark):
    rng = random.Random(5)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(150)] + [(300, 300), (None, 5)]
    want = {x: x for e in links if None not in e for x in e}
    for _ in range(300):
        for a, b in links:
            if a is not None:
                want[a] = want[b] = min(want[a], want[b])
    got = {r["id"]: r["root"] for r in N.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert N.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_set_has_one_winner(spark):
    mem = spark.createDataFrame([(i, True, float(c)) for i, c in ((1, 5), (2, 9), (3, 9), (4, 1), (5, 3), (6, 2))], "id long, is_latest boolean, created_at double")
    pairs = spark.createDataFrame([(1, 4), (2, 1), (3, 4), (5, 6), (5, 99)], "winner_id long, loser_id long")
    got = {r["id"]: (r["is_latest"], r["superseded_by"]) for r in L.merge_duplicates(mem, pairs, 1.0).collect()}
    assert got == {1: (False, 2), 2: (True, None), 3: (False, 2), 4: (False, 2), 5: (True, None), 6: (False, 5)}
    assert L.merge_duplicates(mem, pairs, 1.0, dry_run=True).count() == 4


@pytest.mark.parametrize("least", [0.1, 0.6, 1.0])
def test_nearest_set_matches_all_pairs(spark, least):
    rng = random.Random(9)
    row = lambda i: (i, rng.choice("ab"), [f"w{int(rng.random() ** 3 * 40)}" for _ in range(rng.randint(0, 12))])
    x, y = [row(i) for i in range(90)] + [(90, "a", None), (91, None, ["w1"])], [row(i) for i in range(120)]
    schema = "id long, u string, tokens array<string>"
    got = {r["id"]: (r["target"], round(r["similarity"], 9)) for r in N.nearest_set(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema), least, ["u"]).collect()}
    want = {}
    for i, u, t in x:
        best = [(-len(set(t) & set(o)) / len(set(t) | set(o)), j) for j, k, o in y if k == u and t and o]
        best = [b for b in best if -b[0] >= least - 1e-12]
        if best:
            want[i] = (min(best)[1], round(-min(best)[0], 9))
    assert got == want and want


def test_kinds_of_facts(spark):
    kinds = ["preference", "fact", "task_status", "decision", "tech_find", "identity", None]
    facts = spark.createDataFrame([(i, 1, k, f"likes number {i} most") for i, k in enumerate(kinds)] + [(8, 1, "fact", "tiny")], "fact_id long, user_id long, fact_type string, content string")
    mem = spark.createDataFrame([(70, 1, "static", "likes number 1 most"), (71, 1, "static", "likes number 1 most"), (72, 2, "dynamic", "likes number 3 most")], "id long, user_id long, kind string, content string")
    got = {r["fact_id"]: (r["kind"], r["heat"], r["category"], r["action"], r["target"]) for r in L.profile_upsert(mem, facts, 1.0).collect()}
    new = ("insert", None)
    assert got == {
        0: ("static", 30.0, "preference", "update", 70), 1: ("static", 30.0, "fact", "update", 70), 2: ("dynamic", 25.0, "task_status", *new), 3: ("dynamic", 25.0, "decision", *new),
        4: ("dynamic", 25.0, "tech_find", *new), 5: ("dynamic", 15.0, "unknown", *new), 6: ("dynamic", 15.0, "unknown", *new),
    }


def test_aliases_merge_into_the_longer_name(spark):
    edges = spark.createDataFrame([("PCG", "UE5", "x"), ("PCG框架", "UE5", "x"), ("UE5", "PCG", "y")], "from_id string, to_id string, rel string")
    nodes = spark.createDataFrame([("PCG框架", 1), ("PCG", 1), ("UE5", 2), ("u", 1)], "name string, mention_count long")
    n, e = G.alias_merge(nodes, edges)
    assert {tuple(r) for r in n.collect()} == {("PCG框架", 2), ("UE5", 2), ("u", 1)}  # kept the longer; unrelated and one-letter names stay
    assert sorted(map(tuple, e.collect())) == [("PCG框架", "UE5", "x"), ("UE5", "PCG框架", "y")]
    n, _ = G.alias_merge(spark.createDataFrame([("框架", 1), ("the PCG框架 tool", 1), ("pcg框架", 3)], "name string, mention_count long"), edges)
    assert {tuple(r) for r in n.collect()} == {("the PCG框架 tool", 5)}

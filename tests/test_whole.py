"""Queries that do the whole job: neither they nor their SQL hold a cut of ids, days, words or rows."""

import re

import duckdb
import pytest

from mnemora.operators import retrieval as R
from mnemora.plans import catalog
from mnemora.plans.views import TABLES
from tests.test_oracle import rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", ["vector_search", "topk_similar", "threshold_topk", "keyword_search", "hybrid_search", "fused_search", "three_way_search"])
def test_searches_take_every_twentieth_id(spark, duck, sf_dir, key):
    sql = catalog.ORACLE_SQL[key]
    assert "vec_id < " not in sql and "item_id < " not in sql and "% 20 = 0" in sql
    assert rows(catalog.QUERIES[key](spark, sf_dir).toPandas()) == rows(duck.execute(sql).fetchdf())


def test_blocks_of_queries_meet_blocks_of_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "MAX_HELD", 40)
    vecs = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None)]
    mem = spark.createDataFrame([(i, f"m{i}", True) for i, _ in vecs], "id long, content string, is_latest boolean")
    vec = spark.createDataFrame(vecs, "id long, v array<double>").repartition(3)
    got = R.vector_search(mem, vec, vec.selectExpr("id as query_id", "v as qv"), 4).collect()
    unit = {i: [x / (sum(y * y for y in v or []) ** 0.5 or 1) for x in v or [0.0] * 3] for i, v in vecs}
    for q in unit:
        want = sorted((-round(sum(a * b for a, b in zip(unit[q], unit[i], strict=True)), 4), i) for i in unit)[:4]
        assert [(r["score"], r["id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(-s, i) for s, i in want]


def test_heat_decays_for_all_memories(spark):
    small = "/root/testdata/sf0.1"
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = catalog.QUERIES["fn_heat_decay"](spark, small).toPandas()
    sql = catalog.ORACLE_SQL["fn_heat_decay"]
    assert len(got) == c.execute("SELECT count(*) FROM documents").fetchone()[0] and (got["heat"] > 0).any()
    assert rows(got) == rows(c.execute(sql).fetchdf())


@pytest.mark.parametrize("key, cuts", [("cooccurrence_pairs", ["length(x.term) >= 9"]), ("auto_link", ["length(term) >= 9"]), *((k, ["session_id % 10 <> 0"]) for k in ("valuable_sessions", "skip_reason_counts", "restore_preview", "restore_sessions"))])
def test_no_rows_or_terms_are_left_out(spark, duck, sf_dir, key, cuts):
    assert not any(old in catalog.ORACLE_SQL[key] for old in cuts)
    assert rows(catalog.QUERIES[key](spark, sf_dir).toPandas()) == rows(duck.execute(catalog.ORACLE_SQL[key]).fetchdf())


def test_sessions_without_messages_are_empty(spark):
    from mnemora.operators import aggregates as A

    ses = spark.createDataFrame([(1, "a", "web"), (2, "b", "web")], "session_id long, title string, source string")
    msg = spark.createDataFrame([(1, 1, 1, "user", "a question of some length"), (2, 1, 2, "assistant", "an answer of some length")], "id long, session_id long, pos long, role string, content string")
    got = {r["session_id"]: r["skip_reason"] for r in A.valuable_sessions(ses, msg).collect()}
    assert got == {1: None, 2: "empty"}


def test_rule_entities_reads_documents_of_every_language(spark, duck, sf_dir):
    """Against Python's re: DuckDB sees a word end before a letter that isn't ASCII."""
    want = []
    for doc_id, text in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        terms = [(t, k) for t, k in (("ing the", "tool"), ("ungkeit", "framework")) if t in text.lower()]
        names = {n for n in re.findall(r"\b[A-Z][A-Z0-9_\-]+\b", text) if n.lower() not in ("http", "https", "www", "api", "ing the", "ungkeit")}
        want += [(doc_id, *e) for e in (terms + [(n, "project") for n in sorted(names)])[:10]]
    got = catalog.QUERIES["rule_entities"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["name"], r["type"]) for r in got) == sorted(want)

"""The eight verbs of a memory store as functions over its tables, with their defaults.

A store is three tables: memories (id, content, topic, source, type, tier, heat, created_at, is_latest,
...), vectors (id, v) and edges (from_id, to_id, rel_type). Nothing is changed in place: a verb that
adds or removes gives the store that follows, whose tables the caller writes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.hooks import embedded
from .operators import filters as P
from .operators import graph as G
from .operators import retrieval as R
from .operators.aggregates import graph_stats
from .operators.windows import top_counts


@dataclass(frozen=True)
class Store:
    memories: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    encoder: Callable | None = None  # gives an encoder, see functions.hooks

    def _vectors_of(self, rows: DataFrame) -> DataFrame:
        if self.encoder is None:
            raise ValueError("a store without an encoder can't make vectors of texts")
        return embedded(rows, self.encoder).select("id", "v")


def search(store: Store, queries: DataFrame, top_k: int = 5, source: str = "all") -> DataFrame:
    """Hits of queries (query_id, q): ``vector`` by meaning, ``hybrid`` also by words, ``graph`` by
    entities, ``all`` fused. Columns: query_id, id, content, score, source, rank."""
    if source not in ("all", "vector", "hybrid", "graph"):
        raise ValueError(f"no strategy {source!r}")
    legs = []
    if source != "graph":
        vectors = store.vectors if store.vectors is not None else store._vectors_of(store.memories)
        asked = store._vectors_of(queries.select(F.col("query_id").alias("id"), F.col("q").alias("content"))).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
        legs.append(R.vector_search(store.memories, vectors, asked, top_k))
    if source in ("all", "hybrid"):
        legs.append(R.keyword_search(P.latest_only(store.memories), queries, top_k))
    if source in ("all", "graph"):
        legs.append(R.graph_search(store.edges, queries, top_k))
    return R.fuse(legs, top_k)


def save(store: Store, rows: DataFrame, asof: float, topic: str = "external") -> Store:
    """The store with rows (id, content, and any metadata columns) as latest memories, of ``topic``
    where they have none; their vectors are added where the store keeps vectors."""
    known = rows.withColumn("topic", F.coalesce(F.col("topic"), F.lit(topic)) if "topic" in rows.columns else F.lit(topic))
    vectors = store.vectors
    if vectors is not None:
        vectors = vectors.select("id", "v").unionByName(store._vectors_of(known))
    return replace(store, memories=P.append_memory(store.memories, known, asof), vectors=vectors)


def delete(store: Store, ids: DataFrame) -> Store:
    """The store without the memories (id) and their vectors."""
    gone = ids.select("id").distinct()
    vectors = store.vectors.join(gone, "id", "left_anti") if store.vectors is not None else None
    return replace(store, memories=store.memories.join(gone, "id", "left_anti"), vectors=vectors)


def status(store: Store) -> DataFrame:
    """``memories, nodes, edges``: how many there are."""
    return store.memories.agg(F.count(F.lit(1)).alias("memories")).crossJoin(graph_stats(store.edges))  # a row each


def profile(store: Store, topics: int = 5, latest: int = 5) -> DataFrame:
    """``line_no, text``: the topics with most hot memories, how many memories there are, the latest."""
    hot = top_counts(P.latest_only(store.memories).filter("tier = 'hot'"), "topic", topics)
    a = hot.select(F.lit(0).alias("part"), F.negate("n").alias("o"), F.concat(F.lit("hot: "), F.coalesce("topic", F.lit("-"))).alias("text"))
    b = store.memories.agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("o"), F.concat(F.lit("memories: "), F.col("n").cast("string")).alias("text"))
    c = recent(store, latest).select(F.lit(2).alias("part"), F.negate(F.col("created_at").cast("long")).alias("o"), F.concat(F.lit("recent: "), F.substring(F.coalesce("content", F.lit("")), 1, 80)).alias("text"))
    rows = a.unionByName(b).unionByName(c)  # topics + 1 + latest rows
    return rows.agg(F.array_sort(F.collect_list(F.struct("part", "o", "text"))).alias("l")).select(F.posexplode("l").alias("line_no", "x")).select("line_no", "x.text")


def graph(store: Store, entities: DataFrame, max_depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """From entities (name): ``seed, node, depth`` within ``max_depth`` steps, and the edges between."""
    reach = G.bfs_subgraph(store.edges, entities.select(F.col("name").alias("seed"), F.col("name").alias("node")), max_depth)
    return reach, G.induced_edges(store.edges, reach)


def graph_add(store: Store, edges: DataFrame) -> Store:
    """The store with edges (from_id, to_id, rel_type, reason) added; an edge between known names of an
    unknown kind is ``related``. Nodes stand in their edges."""
    return replace(store, edges=G.add_relations(store.edges, edges).select("from_id", "to_id", "rel_type"))


def recent(store: Store, n: int = 10) -> DataFrame:
    """The latest memories, the newest first."""
    return P.recent_memories(store.memories, n)

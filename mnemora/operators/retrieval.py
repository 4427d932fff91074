"""Recall: vector, keyword, full-text and graph search, and their fusion.

Queries are tables, so one job serves many: ``query_id`` with ``qv`` (a vector) or ``q`` (text).
Results have ``query_id, rank, id, content, score, source``. Query vectors may be as many as the
data: blocks of them meet blocks of the data. Texts to find are looked for by ``containment``. Per query only k rows leave a task before the last shuffle (in vector search, k each time
``MAX_HELD`` rows are held).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.paths import written
from .containment import containments, matches
from .filters import latest_only, where_column
from .windows import best_score_per_content, keep_first

#: Vectors of a block, and rows that a task holds before it hands on the best of each query.
BLOCK, MAX_HELD = 1024, 2_000_000


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id."""
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", r).filter(F.col("rank") <= k)


def vector_search(mem: DataFrame, vec: DataFrame, queries: DataFrame, k: int = 5, where: dict | None = None, all_versions: bool = False, cap: int = 20, max_dist: float | None = None) -> DataFrame:
    """Nearest memories by cosine; filters go before distances. score: 1 - distance, 4 digits."""
    own = mem if all_versions else latest_only(mem)
    own = own.filter(where_column(where)) if where else own
    rows = own.select("id").join(vec.select("id", "v"), "id")
    hits = nearest(rows, queries.select(F.col("query_id").alias("id"), F.col("qv").alias("v")), min(k, cap), max_dist)
    top = ranked(hits, min(k, cap)).withColumn("source", F.lit("vector"))
    return top.join(own.select("id", "content"), "id").select("query_id", "id", "content", "score", "source", "rank")


def blocks(vec: DataFrame, prefix: str) -> DataFrame:
    """Vectors (id, v) as rows of up to ``BLOCK``: ``<prefix>_ids`` and ``<prefix>_m``, the unit
    vectors as float64. A null vector, or one with a null, has no length."""
    kind = vec.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def block() -> pa.RecordBatch:
            width = max((len(v) for v in held if v is not None), default=0)
            m = np.array([v if v is not None and None not in v else [0.0] * width for v in held], dtype=np.float64)
            norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
            unit = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_type)), pa.array([unit.tobytes()], pa.binary())], [f"{prefix}_ids", f"{prefix}_m"])

        for b in batches:
            id_type = b.column(0).type
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append(v)
                if len(ids) == BLOCK:
                    yield block()
                    ids, held = [], []
        if ids:
            yield block()

    return vec.select("id", "v").mapInArrow(pack, f"{prefix}_ids array<{kind}>, {prefix}_m binary")


def nearest(vec: DataFrame, queries: DataFrame, k: int, max_dist: float | None = None) -> DataFrame:
    """``query_id, id, score``: of each query (id, v), at least the k best rows (id, v) that a task
    has seen, ties to the smaller id. Vectors have one length. Blocks of queries meet blocks of rows."""
    q_kind, kind = queries.schema["id"].dataType.simpleString(), vec.schema["id"].dataType.simpleString()

    def best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], dtype=int)
        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
        return q[place < k], i[place < k], s[place < k]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def hand_on() -> pa.RecordBatch:
            q, i, s = held[0]
            return pa.RecordBatch.from_arrays([pa.array(q, types[0]), pa.array(i, types[1]), pa.array(s, pa.float64())], ["query_id", "id", "score"])

        for b in batches:
            types = [b.column(c).type.value_type for c in (0, 2)]
            for r in range(b.num_rows):
                q, qm, i, m = (b.column(c)[r] for c in range(4))
                q, i = (x.values.to_numpy(zero_copy_only=False) for x in (q, i))
                qm, m = (np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(len(y), -1) for x, y in ((qm, q), (m, i)))
                cos = qm @ m.T if qm.shape[1] and m.shape[1] else np.zeros((len(q), len(i)))
                score = np.floor(cos * 1e4 + 0.5) / 1e4
                if max_dist is not None:
                    score[1 - cos > max_dist] = -np.inf
                # whatever equals the k-th score stays until ids decide
                least = np.partition(score, len(i) - k, axis=1)[:, len(i) - k, None] if len(i) > k else -np.inf
                x, y = np.nonzero((score >= least) & (score > -np.inf))
                held.append(best([(q[x], i[y], score[x, y])]))
                n += len(held[-1][0])
                if n > MAX_HELD:
                    held = [best(held)]
                    n = len(held[0][0])
                    if 2 * n > MAX_HELD:
                        yield hand_on()
                        held, n = [], 0
        if held:
            held = [best(held)]
            yield hand_on()

    pairs = blocks(queries, "q").crossJoin(blocks(vec, "d"))
    return pairs.mapInArrow(meet, f"query_id {q_kind}, id {kind}, score double")


def keyword_search(mem: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Memories by Jaccard of tokens, over all rows: tokens meet in an equi join, and only pairs that
    share one are counted; the union follows from the sizes."""
    d = mem.select("id", "content", tokenize(F.col("content")).alias("t"))
    q = queries.select("query_id", tokenize(F.col("q")).alias("qt")).withColumn("nq", F.size("qt"))
    posted = d.select("id", F.size("t").alias("nd"), F.explode("t").alias("token"))
    shared = posted.join(q.select("query_id", "nq", F.explode("qt").alias("token")), "token").groupBy("query_id", "id", "nd", "nq").agg(F.count(F.lit(1)).alias("o"))
    scored = shared.select("query_id", "id", F.round(F.col("o") / (F.col("nd") + F.col("nq") - F.col("o")), 4).alias("score"))
    return ranked(scored, k).join(mem.select("id", "content"), "id").select("query_id", "id", "content", "score", F.lit("keyword").alias("source"), "rank")


def entity_search(edges: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, name``: nodes that contain the query or are contained in it, whatever the case, by
    name; an empty query gives the first k."""
    # written, since every shard of probes below would read the edges again
    nodes = written(edges.select(F.explode(F.array("from_id", "to_id")).alias("name")).distinct(), "nodes").select("name", F.lower("name").alias("n"))
    asked = queries.select("query_id", F.lower("q").alias("q"))
    low = nodes.select("n").distinct()
    # each side is the text once and the probe once; an empty query is in every name
    holds = containments(low.select(F.col("n").alias("id"), F.col("n").alias("text")), asked.select(F.col("q").alias("probe"))).select(F.col("id").alias("n"), F.col("probe").alias("q"))
    held = containments(asked.select(F.col("q").alias("id"), F.col("q").alias("text")), low.select(F.col("n").alias("probe"))).select(F.col("probe").alias("n"), F.col("id").alias("q"))
    met = asked.join(holds.unionByName(held).distinct(), "q").join(nodes, "n").select("query_id", "name")
    first = nodes.select("name").orderBy("name").limit(k)
    every = asked.filter("q = ''").select("query_id").crossJoin(F.broadcast(first))  # k rows
    return keep_first(met.unionByName(every), ["query_id"], ["name"], k).select("query_id", "name")


def graph_search(edges: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Matching entities with score 0.7 and their neighbours with 0.5."""
    return ranked(walk_search(edges, queries, k, 1, None), k)


def fulltext_sessions(msg: DataFrame, ses: DataFrame, queries: DataFrame, k: int = 5, asof: float = 0.0, horizon_s: float = 2592000, width: int = 200) -> DataFrame:
    """``query_id, session_id, source, title, snippet, ts``: the newest message of each session that
    contains the query, the newest sessions first."""
    near = msg.filter(F.col("role").isin("user", "assistant") & (F.col("ts") >= asof - horizon_s))
    hits = near.join(matches(near, queries, "content", ci=True), "id")
    one = keep_first(hits, ["query_id", "session_id"], [F.col("ts").desc(), F.col("id").desc()])
    top = keep_first(one, ["query_id"], [F.col("ts").desc(), F.col("id").desc()], k)
    return top.join(ses.select("session_id", "source", "title"), "session_id").select("query_id", "session_id", "source", "title", F.substring("content", 1, width).alias("snippet"), "ts")


def smoke_stats(hits: DataFrame, mem: DataFrame, keys: list[str]) -> DataFrame:
    """``query_id, hits, best, with_metadata``: how many hits each query has, the best score, and how many hits
    have more than one of the metadata columns ``keys`` filled."""
    filled = sum((F.when(F.col(k).isNotNull() & (F.col(k).cast("string") != ""), 1).otherwise(0) for k in keys), F.lit(0))
    j = hits.join(mem.select("id", filled.alias("filled")), "id", "left")
    return j.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"), F.count_if(F.col("filled") > 1).alias("with_metadata"))


def fuse(legs: list[DataFrame], k: int = 5, key_len: int = 50) -> DataFrame:
    """Legs as one list: of results that begin alike the best stays, then the k best of a query."""
    cols = ["query_id", "id", "content", "score", "source"]
    out = None
    for leg in legs:
        part = leg.select("query_id", F.col("id").cast("string").alias("id"), *cols[2:])
        out = part if out is None else out.unionByName(part)
    return ranked(best_score_per_content(out, key_len, ["query_id"]), k).select(*cols, "rank")


def source_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"))


def multi_search(mem: DataFrame, vec: DataFrame, edges: DataFrame, vectors: DataFrame, texts: DataFrame, k: int = 5, depth: int = 2) -> DataFrame:
    """Vector hits (2k), entities of the text with 0.7 and all within ``depth`` steps with 0.5, fused."""
    return fuse([vector_search(mem, vec, vectors, 2 * k), walk_search(edges, texts, k, depth)], k)


def walk_search(edges: DataFrame, queries: DataFrame, k: int = 5, depth: int = 2, key_len: int | None = 50) -> DataFrame:
    """Hits for ``fuse``: up to k entities of each query with 0.7, and nodes within ``depth`` steps of them with
    0.5; of these at least all that can be among the k best of a fusion by the first ``key_len`` characters
    (None: of whole names), whatever the other legs hold.

    All nodes of one score are ordered by name, so of the neighbours that a node has in the last step only
    the first 2k with different beginnings count: k may be entities, which score higher."""
    from .adjacency import either_way
    from .graph import bfs_subgraph

    hit = written(entity_search(edges, queries, k), "entities")
    seeds = hit.select(F.col("query_id").cast("string").alias("seed"), F.col("name").alias("node"))
    found = hit.select("query_id", F.col("name").alias("id"), F.lit(0.7).alias("score"))
    if depth:
        before = written(bfs_subgraph(edges, seeds, depth - 1).select(F.col("seed").cast(hit.schema["query_id"].dataType).alias("query_id"), "node").distinct(), "passed")
        begins = F.substring("next", 1, key_len) if key_len else F.col("next")
        far = either_way(edges.select("from_id", "to_id")).select("node", "next").join(before.select("node").distinct(), "node", "left_semi")
        far = far.withColumn("begins", begins).withColumn("r", F.dense_rank().over(W.partitionBy("node").orderBy("begins"))).filter(F.col("r") <= 2 * k)
        first = far.groupBy("node", "begins").agg(F.min("next").alias("id")).select("node", "id")
        near = before.select("query_id", F.col("node").alias("id")).unionByName(before.join(first, "node").select("query_id", "id"))
        found = found.unionByName(near.withColumn("score", F.lit(0.5)))
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("content", F.col("id")).withColumn("source", F.lit("graph"))


def cold_search(cold: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, id, score, rank``: 0.8 for the name, 0.5 for each tag and 0.3 for the summary that contains
    the query (id, name, tags array, summary). Each is looked through once for all queries; queries with
    one text (in lower case) are scored and ranked once, so hits grow with the texts to find and not with
    the queries. A hit carries its part and id in one key, so nothing is joined to learn its weight. Rows without id are left out."""
    part = lambda n, text: F.struct(F.lit(n).alias("n"), text.alias("text"))
    each = F.concat(F.array(part("n", F.col("name")), part("s", F.col("summary"))), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t, i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("n"), t.alias("text"))))
    parts = cold.select("id", F.explode(each).alias("p")).select(F.concat("p.n", F.lit("|"), F.col("id").cast("string")).alias("id"), F.lower("p.text").alias("text"))
    asked = queries.select("query_id", F.lower("q").alias("probe"))
    weight = F.when(F.col("id").startswith("n"), 0.8).when(F.col("id").startswith("s"), 0.3).otherwise(0.5)
    own = F.expr("substring(id, locate('|', id) + 1)").cast(cold.schema["id"].dataType)
    hits = containments(parts, asked.select("probe")).select(F.col("probe").alias("query_id"), own.alias("id"), weight.alias("weight"))
    best = ranked(hits.groupBy("query_id", "id").agg(F.round(F.sum("weight"), 4).alias("score")), k).withColumnRenamed("query_id", "probe")
    return asked.join(best, "probe").select("query_id", "id", "score", "rank")


def cold_excavate(msg: DataFrame, ses: DataFrame, queries: DataFrame, limit: int = 200) -> DataFrame:
    """``query_id, session_id, messages``: messages that contain the query, of the sessions that started
    last, nested in order; at most ``limit`` messages a query."""
    hits = msg.join(matches(msg, queries, "content"), "id").join(ses.select("session_id", "started_at"), "session_id")
    top = keep_first(hits, ["query_id"], [F.col("started_at").desc(), "session_id", "pos"], limit)
    return top.groupBy("query_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("messages"))


def excavate_sessions(msg: DataFrame, ses: DataFrame, ids: DataFrame, limit: int = 500) -> DataFrame:
    """``session_id, title, messages``: the messages of given sessions (session_id), nested in order; of all
    together the first ``limit`` by id."""
    own = msg.join(ids.select("session_id").distinct(), "session_id", "left_semi").orderBy("id").limit(limit)
    nested = own.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("messages"))
    return nested.join(ses.select("session_id", "title"), "session_id").select("session_id", "title", "messages")


def multi_source_search(sources: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Rows of any source (source, id, text, ts) that contain the query, the newest first."""
    named = sources.withColumn("_key", F.concat_ws("|", "source", "id"))
    hits = named.join(matches(named, queries, "text", ci=True, id_col="_key").withColumnRenamed("id", "_key"), "_key").drop("_key")
    return keep_first(hits, ["query_id"], [F.col("ts").desc(), "source", "id"], limit)


def lines(df: DataFrame, by: str, order: list[str], line) -> DataFrame:
    """``by, text``: the lines of each group, in order, as one text."""
    item = F.struct(*[F.col(c) for c in order], line.alias("line"))
    return df.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("text"))


def prefetch_context(hits: DataFrame, width: int = 120) -> DataFrame:
    """``query_id, text``: hits as a list of lines ``- [score|source] content``."""
    line = F.concat(F.lit("- ["), F.col("score").cast("string"), F.lit("|"), F.col("source"), F.lit("] "), F.substring("content", 1, width))
    return lines(hits, "query_id", ["rank"], line)


def session_brief(hottest: DataFrame, hits: DataFrame, mem: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, line_no, text``: for each query (query_id), the hottest topic, related memories, and how many
    there are in all."""
    q = queries.select("query_id").distinct()
    a = q.crossJoin(F.broadcast(hottest.limit(1))).select("query_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("topic: "), "name").alias("text"))
    b = hits.select("query_id", F.col("rank").cast("long").alias("line_no"), F.substring("content", 1, 80).alias("text"))
    c = q.crossJoin(F.broadcast(mem.agg(F.count(F.lit(1)).alias("n")))).select("query_id", F.lit(99).cast("long").alias("line_no"), F.concat(F.lit("memories: "), F.col("n").cast("string")).alias("text"))
    return a.unionByName(b).unionByName(c)


def context_injection(hot: DataFrame, hits: DataFrame, graph_lines: DataFrame) -> DataFrame:
    """``query_id, line_no, text``: hot topics (name, heat), hits, and lines of the top hit's graph."""
    q = hits.select("query_id").distinct()
    h = q.crossJoin(F.broadcast(hot.select("name", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("heat").desc(), "name")).alias("r")))).select("query_id", F.col("r").cast("long").alias("line_no"), F.col("name").alias("text"))
    b = hits.select("query_id", (F.col("rank") + 100).cast("long").alias("line_no"), F.substring("content", 1, 80).alias("text"))
    top = hits.filter("rank = 1").select("query_id", F.col("id").alias("node"))
    g = graph_lines.join(top, "node").select("query_id", (F.col("line_no") + 200).cast("long").alias("line_no"), "text")
    return h.unionByName(b).unionByName(g)


def recover_conversation(msg: DataFrame, max_turns: int = 15, user_cut: int = 500, other_cut: int = 200) -> DataFrame:
    """``session_id, line_no, text``: the first turns of each session with role labels, cut."""
    from .windows import first_messages

    own = first_messages(msg.filter(F.col("role").isin("user", "assistant")), max_turns)
    no = F.row_number().over(W.partitionBy("session_id").orderBy("pos", "id")).cast("long")
    label = F.when(F.col("role") == "user", "U: ").otherwise("A: ")
    body = F.when(F.col("role") == "user", F.substring("content", 1, user_cut)).otherwise(F.concat(F.substring("content", 1, other_cut), F.when(F.length("content") > other_cut, "...").otherwise("")))
    return own.select("session_id", no.alias("line_no"), F.concat(label, body).alias("text"))


def recover_compressed(hot: DataFrame, conclusions: DataFrame, fallback: DataFrame) -> DataFrame:
    """``kind, text``: hot topics and the last conclusions; the lines of the fallback if there are none."""
    a = hot.select(F.lit("topic").alias("kind"), F.col("name").alias("text"))
    b = conclusions.select(F.lit("conclusion").alias("kind"), F.col("content").alias("text"))
    some = conclusions.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    c = fallback.select(F.lit("turn").alias("kind"), "text").crossJoin(F.broadcast(some)).select("kind", "text")
    return a.unionByName(b).unionByName(c)

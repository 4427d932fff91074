"""Graphs of typed edges: adding, walking, chains, learned entities, aliases.

Walks are loops of joins with a bound on their depth; each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..sources.paths import written
from .adjacency import either_way, neighbour_lists, walk_edges, walk_step
from .containment import containments
from .joins import cooccurrence_pairs, dictionary_match

# Kinds of edges.
RELATIONS = ("updates", "extends", "derives", "related")


def add_relations(edges: DataFrame, new: DataFrame, cut: int = 500) -> DataFrame:
    """Stored edges and new ones (from_id, to_id, rel_type, reason): an unknown kind is ``related`` and
    stays readable as label; what is stored isn't added."""
    kind = F.when(F.col("rel_type").isin(list(RELATIONS)), F.col("rel_type")).otherwise("related")
    n = new.select("from_id", "to_id", kind.alias("rel_type"), F.col("rel_type").alias("label"), F.substring("reason", 1, cut).alias("reason"))
    n = n.groupBy("from_id", "to_id", "rel_type").agg(F.min("label").alias("label"), F.min("reason").alias("reason"))
    fresh = n.join(edges.select("from_id", "to_id", "rel_type"), ["from_id", "to_id", "rel_type"], "left_anti")
    return edges.select("from_id", "to_id", "rel_type").unionByName(fresh, allowMissingColumns=True)


def relations_of(rel: DataFrame, ids: DataFrame, kind: str | None = None, include_inactive: bool = False) -> DataFrame:
    """``id`` with every relation (src, dst, type, active) that it takes part in."""
    own = rel if include_inactive else rel.filter("active")
    own = own.filter(F.col("type") == kind) if kind else own
    a = own.join(ids.select(F.col("id").alias("src")), "src").withColumn("id", F.col("src"))
    b = own.join(ids.select(F.col("id").alias("dst")), "dst").withColumn("id", F.col("dst")).filter("src <> dst")
    return a.select("id", "src", "dst", "type", "active").unionByName(b.select("id", "src", "dst", "type", "active"))


def update_chain_mark(rel: DataFrame) -> DataFrame:
    """``src, dst, created_at, active``: of the updates to one target only the newest is active."""
    newest = F.row_number().over(W.partitionBy("dst").orderBy(F.col("created_at").desc(), "src")) == 1
    return rel.filter("type = 'updates'").select("src", "dst", "created_at", newest.alias("active"))


def version_chain(versions: DataFrame, max_depth: int = 20, direction: str = "ancestors") -> DataFrame:
    """``start_id, depth, id``: for every version (id, parent_id) itself and its ancestors up to max_depth
    steps, its descendants, or both, descendants then with a depth below 0. By pointer doubling:
    each round joins all known stretches with each other. A chain that leads back to itself ends there."""
    known = written(versions.filter("parent_id is not null").select(F.col("id").alias("s"), F.col("parent_id").alias("e"), F.lit(1).alias("d")), "chain")
    reach = 1
    jump = known
    while reach < max_depth:
        far = known.alias("x").join(jump.alias("y"), F.col("x.e") == F.col("y.s")).select("x.s", "y.e", (F.col("x.d") + F.col("y.d")).alias("d")).filter((F.col("d") > reach) & (F.col("d") <= max_depth) & (F.col("s") != F.col("e")))
        known = written(known.unionByName(far).groupBy("s", "e").agg(F.min("d").alias("d")), "chain")
        reach *= 2
        jump = known.filter(F.col("d") == reach)
    own = versions.select(F.col("id").alias("start_id"), F.lit(0).alias("depth"), F.col("id"))
    known = known.filter("s <> e")
    up = known.select(F.col("s").alias("start_id"), F.col("d").alias("depth"), F.col("e").alias("id"))
    down = known.select(F.col("e").alias("start_id"), (F.negate("d") if direction == "both" else F.col("d")).alias("depth"), F.col("s").alias("id"))
    for name, part in (("descendants", down), ("ancestors", up)):
        if direction in (name, "both"):
            own = own.unionByName(part)
    return own


def bfs_subgraph(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """``seed, node, depth``: nodes within max_depth steps of each seed (seed, node), in any direction.
    Steps go by ``adjacency``: neighbours travel as packed lists, once for each block of seeds, and the
    last step, most of the result, is made in the tasks that return it and not written."""
    seen = seeds.select("seed", "node", F.lit(0).alias("depth")).distinct()
    if not max_depth:
        return seen
    seen = written(seen, "front")
    lists = neighbour_lists(either_way(edges).select("node", "next"))
    for d in range(1, max_depth + 1):
        step = walk_step(lists, seen, d).withColumn("depth", F.lit(d))
        seen = seen.unionByName(step if d == max_depth else written(step, "front"))
    return seen


def walked_edges(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """``induced_edges`` of ``bfs_subgraph`` without a table of the nodes of the last step. All edges of
    nodes that the walk reached before its last step belong to the result, since it reached their other
    ends too. Edges between two nodes of the last step close an odd circle; there is none, and no join
    for them, where no node has edges of both directions."""
    kinds = [c for c in edges.columns if c not in ("from_id", "to_id")]
    lists = neighbour_lists(either_way(edges), repeats=True)
    inner = written(seeds.select("seed", "node", F.lit(0).alias("depth")).distinct(), "front")
    for d in range(1, max_depth):
        inner = inner.unionByName(written(walk_step(lists, inner, d).withColumn("depth", F.lit(d)), "front"))
    if max_depth:
        out = walk_edges(lists, inner, kinds)
        mixed = lists.select("node", "out").distinct().groupBy("node").count().filter("count > 1")
        if mixed.isEmpty():
            return out
        last = written(walk_step(lists, inner, max_depth), "front")
        return out.unionByName(induced_edges(edges, last).select(*out.columns))
    return induced_edges(edges, inner).select("seed", "from_id", "to_id", *kinds)


def induced_edges(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """``seed`` with every edge between two nodes that its walk reached."""
    r = reach.select("seed", "node")
    return edges.join(r.withColumnRenamed("node", "from_id"), "from_id").join(r.withColumnRenamed("node", "to_id"), ["seed", "to_id"]).select("seed", "from_id", "to_id", "rel_type")


def derived_facts(facts: DataFrame, min_conf: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Facts (id, content, confidence, sources array) that are sure enough, and an edge to each source."""
    own = facts.filter(F.col("confidence") >= min_conf)
    return own.select("id", "content", F.lit("derived").alias("type")), own.select(F.col("id").alias("from_id"), F.explode("sources").alias("to_id")).withColumn("rel_type", F.lit("derives"))


def chain_lines(versions: DataFrame, ids: DataFrame, max_depth: int = 5, width: int = 80) -> DataFrame:
    """``node, line_no, text``: the version chain of each id (versions: id, parent_id, content), where it has
    more than one version: ancestors from the oldest, itself, descendants, as ``[direction] content``."""
    chain = version_chain(versions, max_depth, "both").join(ids.select(F.col("id").alias("start_id")).distinct(), "start_id", "left_semi")
    named = chain.withColumnRenamed("id", "vid").join(versions.select(F.col("id").alias("vid"), "content"), "vid")
    longer = F.count(F.lit(1)).over(W.partitionBy("start_id"))
    no = F.row_number().over(W.partitionBy("start_id").orderBy(F.col("depth").desc(), "vid")).cast("long")
    way = F.when(F.col("depth") == 0, "current").when(F.col("depth") > 0, "ancestor").otherwise("descendant")
    text = F.concat(F.lit("["), way, F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, width))
    return named.select(F.col("start_id").alias("node"), no.alias("line_no"), text.alias("text"), longer.alias("n")).filter("n > 1").drop("n")


def graph_context(edges: DataFrame, ids: DataFrame, most: int = 10, versions: DataFrame | None = None) -> DataFrame:
    """``node, line_no, text``: up to ten relations of each id, as lines; before them (numbers from -1000
    up) the lines of its version chain, where versions are given (ids of both kinds alike)."""
    if versions is not None:
        chain = chain_lines(versions, ids).withColumn("line_no", F.col("line_no") - 1000)
        return chain.unionByName(graph_context(edges, ids, most))
    a = edges.join(ids.select(F.col("id").alias("from_id")), "from_id").withColumn("node", F.col("from_id"))
    b = edges.join(ids.select(F.col("id").alias("to_id")), "to_id").withColumn("node", F.col("to_id"))
    text = F.concat("from_id", F.lit(" -"), "rel_type", F.lit("-> "), "to_id")
    t = a.select("node", text.alias("text")).unionByName(b.select("node", text.alias("text"))).distinct()
    no = F.row_number().over(W.partitionBy("node").orderBy("text"))
    return t.withColumn("line_no", no.cast("long")).filter(F.col("line_no") <= most)


# Endings of CJK names, and words that no name of several words has inside it.
NAME_ENDINGS = "系统|模型|引擎|工具|库|站|平台|框架|项目|技能|插件"
INNER_WORDS = "was|is|are|the|of|in|on|to|for|and|with|a|an"


def learn_entities(
    docs: DataFrame, known: DataFrame, stop: list[str], keep: list[str], least: int = 2, id_col: str = "doc_id", text: str = "text", more_words: int = 2, endings: str = NAME_ENDINGS
) -> DataFrame:
    """``name, n_docs``: capitalised words, with up to ``more_words`` words behind them, titles in 《》, and
    CJK runs with an ending of names, that aren't known: not common words, not short, no acronyms but
    those to keep, no runs with function words inside; CJK runs and names of several words that hold a
    known name aren't new. In at least some documents."""
    t = F.coalesce(F.col(text), F.lit(""))
    further = rf"(?:\s+[A-Za-z0-9_.\-]{{2,}}){{0,{more_words}}}" if more_words else ""
    names = F.concat(F.regexp_extract_all(t, F.lit(rf"(?<![A-Za-z0-9])[A-Z][A-Za-z0-9_.\-]{{2,}}{further}(?![A-Za-z0-9])"), F.lit(0)), F.regexp_extract_all(t, F.lit("《([^》]{2,20})》"), F.lit(1)))
    if endings:
        names = F.concat(names, F.regexp_extract_all(t, F.lit(f"[\\u4e00-\\u9fa5]{{2,6}}(?:{endings})"), F.lit(0)))
    n = docs.select(F.col(id_col).alias("d"), F.explode(F.array_distinct(names)).alias("name"))
    n = n.filter(~F.col("name").rlike(rf"(?i)\s+({INNER_WORDS})\s+"))
    if more_words or endings:
        found = n.select("name").distinct()
        holds = containments(found.select(F.col("name").alias("id"), F.col("name").alias("text")), known.select(F.col("name").alias("probe"))).filter("id <> probe")
        n = n.join(holds.select(F.col("id").alias("name")).distinct(), "name", "left_anti")
    n = n.filter(~F.lower("name").isin([s.lower() for s in stop]) & ~F.col("name").rlike(r"^[A-Z][a-z]{1,3}$") & (~F.col("name").rlike(r"^[A-Z]{2,6}$") | F.col("name").isin(keep)))
    return n.groupBy("name").agg(F.count_distinct("d").alias("n_docs")).filter(F.col("n_docs") >= least).join(known.select("name"), "name", "left_anti")


def rule_entities(docs: DataFrame, dictionary: dict[str, tuple[str, str]], cap: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, name, type``: dictionary terms that occur, then acronyms that aren't such a term; at most
    ``cap`` a document."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = F.filter(F.array(*[F.struct(F.lit(0).alias("k"), F.lit(n).alias("name"), F.lit(t).alias("type")) for n, (t, _) in sorted(dictionary.items())]), lambda s: low.contains(s["name"]))
    acr = F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\b[A-Z][A-Z0-9_\-]+\b"), F.lit(0))), lambda a: ~F.lower(a).isin([*dictionary, "http", "https", "www", "api"]))
    more = F.transform(F.array_sort(acr), lambda a: F.struct(F.lit(1).alias("k"), a.alias("name"), F.lit("project").alias("type")))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.slice(F.concat(rows, more), 1, cap)).alias("e")).select("doc_id", "e.name", "e.type")


def auto_link(docs: DataFrame, terms: DataFrame, cues: list[tuple[str, list[str]]], edges: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``from_id, to_id, rel_type, n``: pairs of terms in one document; the kind is that of the first cue
    list of which the document has a word, else related. Stored edges aren't repeated."""
    pairs = cooccurrence_pairs(dictionary_match(docs, terms, id_col, text))
    kind = F.lit("related")
    for name, words in reversed(cues):
        kind = F.when(contains_any(F.col(text), words), name).otherwise(kind)
    k = docs.select(F.col(id_col).alias("doc_id"), kind.alias("rel_type"))
    new = pairs.join(k, "doc_id").groupBy(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "rel_type").agg(F.count(F.lit(1)).alias("n"))
    return new.join(edges.select("from_id", "to_id", "rel_type"), ["from_id", "to_id", "rel_type"], "left_anti")


def alias_merge(nodes: DataFrame, edges: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, mention_count) whose name of at least ``least`` characters begins or is part of a
    longer name, whatever the case, merge into the longest such name (the smallest of several), counts
    adding up; edges (from_id, to_id) follow, and each stands once. A longest name has no longer one, so
    one step is enough."""
    names = nodes.select("name").distinct()
    low = names.filter(F.length("name") >= least).select("name", F.lower("name").alias("probe"))
    inside = containments(names.select(F.col("name").alias("id"), F.lower("name").alias("text")), low).withColumnRenamed("id", "long")
    m = low.join(inside, "probe").filter(F.length("long") > F.length("name"))
    best = m.groupBy("name").agg(F.min(F.struct(F.negate(F.length("long")).alias("l"), F.col("long"))).alias("b")).select("name", F.col("b.long").alias("to"))
    n = nodes.join(best, "name", "left").groupBy(F.coalesce("to", "name").alias("name")).agg(F.sum("mention_count").alias("mention_count"))
    e = edges.join(best.select(F.col("name").alias("from_id"), F.col("to").alias("f")), "from_id", "left").join(best.select(F.col("name").alias("to_id"), F.col("to").alias("t")), "to_id", "left")
    return n, e.select(F.coalesce("f", "from_id").alias("from_id"), F.coalesce("t", "to_id").alias("to_id"), *[c for c in edges.columns if c not in ("from_id", "to_id")]).distinct()


def node_listing(edges: DataFrame, n: int = 10, nodes: DataFrame | None = None) -> DataFrame:
    """``line_no, text`` of the first nodes by name, with the number of their edges; where nodes (name, type,
    attr) are given, with these: ``name [type] n attr``."""
    if nodes is not None:
        d = edges.select(F.explode(F.array("from_id", "to_id")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        first = nodes.groupBy("name").agg(F.min("type").alias("type"), F.min("attr").alias("attr")).join(d, "name", "full_outer").orderBy("name").limit(n)
        part = lambda c, a, b: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(a), c, F.lit(b)))
        text = F.concat_ws(" ", "name", part("type", "[", "]"), F.coalesce("n", F.lit(0)).cast("string"), part("attr", "", ""))
        return first.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("name")).cast("long").alias("line_no"), text.alias("text"))
    d = edges.select(F.explode(F.array("from_id", "to_id")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy("node").limit(n)
    return d.select(F.row_number().over(W.partitionBy(F.lit(0)).orderBy("node")).cast("long").alias("line_no"), F.concat_ws(" ", "node", F.col("n").cast("string")).alias("text"))


def assemble_layers(edges: DataFrame, layer_of) -> DataFrame:
    """``layer, n, first``: nodes by layer; layer_of: Column over ``node``."""
    nodes = edges.select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct()
    return nodes.groupBy(layer_of.alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))



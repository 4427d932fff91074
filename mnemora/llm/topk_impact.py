"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors are dealt by the hash of their id to shards of about ``shard_rows`` rows. A shard keeps,
for each dimension, its rows ordered by descending impact (the size of the component) and cut
into segments at quantised impact levels. A query walks all dimensions together in descending
order of |weight| x impact: first every segment above one threshold, then those above the next.
A row that has met ``c`` of the ``d`` dimensions has the score it has gathered, give or take
``(d - c)`` times the largest product still to come. The walk stops only when this proves that
all but a few rows are out; those that may be in are scored again from their full vectors, so
the result is exact. Without such a proof the walk goes through to the end.

A shard's index is built once, in one task, and blocks of about ``block_rows`` queries stream past
it; only k rows for each query and shard come out. A first pass lets each query meet one shard;
the k-th score that it finds there is a floor that the query takes along to the other shards, so
that more of a shard is out early. No task holds more than one shard and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

#: Impact levels of a dimension in a shard.
LEVELS = 32
#: Thresholds of the walk, as parts of the largest product; behind the last comes everything.
STEPS = (0.4, 0.25, 0.16, 0.1, 0.06, 0.035, 0.02)
#: A score below all.
LOWEST = -(1 << 62)


class Shard:
    """Postings of a shard: per dimension, rows by descending impact, and level boundaries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.first = np.zeros(len(ids), bool)  # the first row of each id
        self.first[np.unique(ids, return_index=True)[1]] = True
        size = np.abs(vectors)
        self.order = np.argsort(-size, axis=0, kind="stable").T.copy()  # d x n
        self.values = np.take_along_axis(vectors.T, self.order, 1)
        impact = np.abs(self.values)
        top = max(1, int(impact.max(initial=0)))
        level = impact * LEVELS // (top + 1)
        # where each level's segment ends, from the highest level down
        self.ends = np.stack([np.searchsorted(-row, np.arange(-(LEVELS - 1), 1), side="right") for row in level])
        padded = np.concatenate([impact, np.zeros((len(impact), 1), impact.dtype)], axis=1)
        starts = np.concatenate([np.zeros((len(impact), 1), int), self.ends[:, :-1]], axis=1)
        self.peaks = np.take_along_axis(padded, starts, 1)  # the largest impact of a segment, or of what follows

    def search(self, query_id: int, q: np.ndarray, k: int, floor: int = LOWEST) -> list[tuple[int, int]]:
        """The k best (id, score) of those with at least the score ``floor``, best first, ties to
        smaller ids; rows of the query's own id take no part, and an id that has several rows has
        its best score."""
        n, d = self.vectors.shape
        acc, met = np.zeros(n, np.int64), np.zeros(n, np.int64)
        weight = np.abs(q)
        bound = weight[:, None] * self.peaks  # d x levels, descending in a row
        done = np.zeros(d, int)
        alive = np.nonzero(self.ids != query_id)[0]
        if len(alive) > k and d:
            largest = int(bound[:, 0].max())
            for step in STEPS:
                theta = largest * step
                upto = (bound > theta).sum(1)  # segments of each dimension above the threshold
                for i in np.nonzero(upto)[0]:
                    stop = self.ends[i, upto[i] - 1]
                    if stop > done[i]:
                        at = self.order[i, done[i] : stop]
                        acc[at] += q[i] * self.values[i, done[i] : stop]
                        met[at] += 1
                        done[i] = stop
                rest = np.where(upto < LEVELS, bound[np.arange(d), np.minimum(upto, LEVELS - 1)], 0).max()
                slack = (d - met[alive]) * rest
                low = (acc[alive] - slack)[self.first[alive]]
                if len(low) >= k:  # so many different ids reach this score
                    floor = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]))
                alive = alive[acc[alive] + slack >= floor]  # a row that is out stays out
                if len(alive) <= max(8 * k, n // 64):
                    break
        scores = self.vectors[alive] @ q
        best: dict[int, int] = {}
        for i in np.lexsort((self.ids[alive], -scores)).tolist():
            if len(best) == k or scores[i] < floor:
                break
            best.setdefault(int(self.ids[alive[i]]), int(scores[i]))
        return list(best.items())


def _vectors(flat: bytes, n: int) -> np.ndarray:
    return np.frombuffer(flat, "<i8").reshape(n, -1)


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``id, v``: components as floor(scale * x). Rows without id, vectors that are null or empty
    or hold a null or non-finite component are left out."""
    v = F.col(vec_col)
    good = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def top_k(items: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, block_rows: int = 512) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best ids of ``items`` (id, v) for each id of
    ``queries`` (id, v), by integer inner product; ties go to the smaller id.

    An item of the query's own id is no candidate. Only vectors of the same length are compared.
    The score of two ids is the greatest that rows of them have, so repeated rows change nothing.
    Components must stay below 2^28 in size, so that scores fit 64 bits; larger ones are an error.
    Empty inputs give no rows; extra columns are left out.
    """
    items, queries = (x.select("id", F.expr(f"if(forall(v, c -> abs(c) < {1 << 28}), v, raise_error('a component is too large'))").alias("v")).dropDuplicates(["id", "v"]) for x in (items, queries))
    n_items, n_queries = (x.count() for x in (items, queries))
    n_shards, n_blocks = max(1, -(-n_items // shard_rows)), max(1, -(-n_queries // block_rows))
    dealt = lambda n: F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(n)).cast("int")

    def packed(df: DataFrame, keys: list[str]) -> DataFrame:
        """One row for each of ``keys`` and vector length: ids, floors and vectors as bytes."""
        names = [*keys, "width"]

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            flat = np.concatenate([np.asarray(x, "<i8") for x in pdf["v"]])
            return pd.DataFrame({**{c: [x] for c, x in zip(names, key, strict=True)}, "ids": [pdf["id"].to_numpy("<i8").tobytes()], "floors": [pdf["floor"].to_numpy("<i8").tobytes()], "flat": [flat.tobytes()]})

        return df.select("id", "v", "floor", *keys, F.size("v").alias("width")).groupBy(*names).applyInPandas(pack, ", ".join(f"{c} int" for c in names) + ", ids binary, floors binary, flat binary")

    shards = packed(items.select("id", "v", F.lit(0).cast("long").alias("floor"), dealt(n_shards).alias("shard")), ["shard"]).withColumn("block", F.lit(-1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(i)[r].as_py() for i, c in enumerate(b.schema.names)}
                ids = np.frombuffer(row["ids"], "<i8")
                vectors = _vectors(row["flat"], len(ids))
                if row["block"] < 0:
                    held, shard = (row["shard"], row["width"]), Shard(ids, vectors)
                elif held == (row["shard"], row["width"]):
                    floors = np.frombuffer(row["floors"], "<i8").tolist()
                    out = [(i, *x) for i, q, floor in zip(ids.tolist(), vectors, floors, strict=True) for x in shard.search(i, q, k, floor)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    def meet(blocks: DataFrame) -> DataFrame:
        """Each shard in one task, before its blocks: built once, then they stream past."""
        both = shards.unionByName(blocks).repartition(n_shards, "shard").sortWithinPartitions("shard", "width", "block")
        return both.mapInArrow(search, "query_id long, vec_id long, score long")

    home = F.pmod(F.xxhash64(F.lit("own"), "id"), F.lit(n_shards)).cast("int")
    start = queries.withColumn("floor", F.lit(LOWEST).cast("long"))
    near = stash(meet(packed(start.withColumn("shard", home).withColumn("block", dealt(n_blocks)), ["shard", "block"])), "near")
    floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("floor")).filter(F.col("c") == k).select(F.col("query_id").alias("id"), "floor")
    # an id that has several query vectors has no floor of its own in one of them: it goes without
    single = queries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("id")
    floored = queries.join(floors.join(single, "id"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
    away = packed(floored.withColumn("home", home).withColumn("block", dealt(n_blocks)), ["home", "block"])
    away = away.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).filter("shard <> home").drop("home")
    found = near.unionByName(meet(away)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

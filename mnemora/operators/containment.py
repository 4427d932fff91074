"""Which texts contain which of many probes, exactly, at any place.

Probes are dealt by hash to shards of a bounded number of code points. A shard is an automaton that
finds all of its probes in one scan of a text; texts are scanned where they are read, once a shard,
and only hits leave the task. Up to ``MAX_SHARDS`` shards are broadcast, one scan each; their bound is
checked by a sum over the probes first. More probes than that meet the texts by a join on hashes of
blocks, and of the places of a text only those go into the shuffle that a bitmap of the probes'
blocks (of fixed size) lets through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of the probes of a shard (an automaton takes some 100 bytes for each), and shards up to
#: which texts are scanned.
SHARD_CHARS, MAX_SHARDS = 1 << 18, 16
#: Characters of the blocks on which probes meet texts in the join, the longest first, and of a piece
#: of a text.
BLOCKS, PIECE = (12, 4, 1), 512
#: Bits of the bitmap of the probes' blocks.
BITMAP_BITS = 1 << 23
#: Rows of a batch that a task scans at once.
ROWS = 500


def containments(texts: DataFrame, probes: DataFrame, shard_chars: int = SHARD_CHARS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """``id, probe``: each text (id, text) with every probe that it contains, case as given, once. Empty and
    null probes are in no text; null texts hold none; rows without id give nothing."""
    p = probes.filter(F.length("probe") > 0).select("probe").distinct()
    chars = p.agg(F.sum(F.length("probe"))).first()[0] or 0
    shards = -(-chars // shard_chars)
    own = texts.filter(F.col("id").isNotNull() & (F.length("text") > 0)).select("id", "text")
    if shards > max_shards:
        return _by_blocks(own, p)
    if not shards:
        return own.crossJoin(p).select("id", "probe").limit(0)
    dealt = p.withColumn("shard", F.pmod(F.xxhash64("probe"), F.lit(shards)))
    found = (_scan(own, [r["probe"] for r in dealt.filter(F.col("shard") == k).collect()]) for k in range(shards))
    return reduce(DataFrame.unionByName, found).distinct()  # hits alone are shuffled: an id may stand in several rows


def _scan(texts: DataFrame, probes: list[str]) -> DataFrame:
    """Texts against the automaton of one shard, which a task makes once."""
    held = texts.sparkSession.sparkContext.broadcast(probes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        find = ahocorasick.Automaton()
        for probe in held.value:
            find.add_word(probe, probe)
        if held.value:
            find.make_automaton()
        for whole in parts:
            for at in range(0, len(whole), ROWS):
                part = whole.iloc[at : at + ROWS]
                ids: list = []
                hits: list[str] = []
                for i, text in zip(part["id"].tolist(), part["text"].tolist(), strict=True):
                    found = {probe for _, probe in find.iter(text)} if held.value else set()
                    ids += [i] * len(found)
                    hits += found
                yield pd.DataFrame({"id": pd.Series(ids, dtype=whole["id"].dtype), "probe": pd.Series(hits, dtype="object")})

    return texts.mapInPandas(run, T.StructType([texts.schema["id"], T.StructField("probe", T.StringType())]))


def _by_blocks(texts: DataFrame, probes: DataFrame) -> DataFrame:
    """By hashes of blocks: a probe stands under its first characters, the longest of ``BLOCKS`` that
    fits it; of a text those places are posted, piece by piece, whose hash is among the probes' in the
    bitmap. Texts follow for the pairs that met."""
    size = F.lit(BLOCKS[-1])
    for k in reversed(BLOCKS):
        size = F.when(F.length("probe") >= k, k).otherwise(size)
    sized = probes.withColumn("size", size)
    asked = [r["size"] for r in sized.select("size").distinct().collect()]  # at most one for each of BLOCKS
    keyed = sized.select("probe", F.xxhash64(F.substring(F.col("probe"), F.lit(1), F.col("size")), "size").alias("block"))
    bit = F.pmod(F.col("block"), F.lit(BITMAP_BITS))
    bitmap = keyed.select(F.shiftright(bit, 6).cast("int").alias("word"), (bit % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))

    starts = F.sequence(F.lit(1), F.length("text"), F.lit(PIECE))
    pieces = texts.select("id", F.explode(F.transform(starts, lambda s: F.substring(F.col("text"), s, F.lit(PIECE + max(BLOCKS) - 1)))).alias("piece"))

    def hashes(k: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("piece") - k + 1))
        return F.transform(places, lambda i: F.xxhash64(F.substring(F.col("piece"), i, F.lit(k)), F.lit(k)))

    posted = pieces.select("id", F.explode(F.array_distinct(F.concat(*[hashes(k) for k in asked]))).alias("block"))
    near = posted.withColumns({"word": F.shiftright(bit, 6).cast("int"), "bit": (bit % 64).cast("int")}).join(F.broadcast(bitmap), "word")  # 2^17 rows at most
    met = near.filter(F.expr("(shiftright(bits, bit) & 1) = 1")).select("id", "block").join(keyed, "block").select("id", "probe").distinct()
    held = texts.select(F.col("id").alias("text_id"), "text")
    return met.join(held, (F.col("id") == F.col("text_id")) & F.col("text").contains(F.col("probe")), "left_semi")


def matches(df: DataFrame, queries: DataFrame, text: str, ci: bool = False, id_col: str = "id") -> DataFrame:
    """``query_id, id``: rows of df whose text contains the query (query_id, q), whatever the case if
    ``ci``. Empty and null queries are not found."""
    low = F.lower if ci else (lambda c: c)
    q = queries.select("query_id", low(F.col("q")).alias("probe"))
    return containments(df.select(F.col(id_col).alias("id"), low(F.col(text)).alias("text")), q).join(q, "probe").select("query_id", "id").distinct()

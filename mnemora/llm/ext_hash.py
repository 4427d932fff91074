"""Sharding by extendible hashing.

A directory is indexed by the first bits of a row's hash. A bucket that holds more bytes than
the limit is split on its next bit, and only that bucket, until each fits. Here the splits are
found from a histogram: bytes are summed by the first ``step`` bits, rolled up to every shorter
prefix, and a bucket is the shortest prefix that fits while its parent does not. From these the
directory is made, as deep as the deepest bucket, and every row finds its bucket by looking up its
entry. Only bins that are too large at ``step`` bits are counted again with ``next_step`` more
bits, and get a directory of their own. Rows are dealt by hash, so no key is hot; the text itself
is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

#: Bits of the hash that are used.
BITS = 60
#: Lanes in which rows that agree in all bits are put on pages.
LANES = 64


def row_hash(id_col: str, text_col: str) -> Column:
    """60 bits of the id as text; of rows without id, of the digest of their text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def buckets(bins: DataFrame, low: int, high: int, limit_bytes: int) -> DataFrame:
    """``depth, node, shard_bytes, shard_docs``: the prefixes of ``low`` (0 if it is 0) to ``high``
    bits that fit the limit while their parents don't. ``bins``: ``bin`` of ``high`` bits, ``bytes``,
    ``docs``. Sums are made per task before they meet, so no prefix is a hot key."""
    depths = F.explode(F.sequence(F.lit(low + 1 if low else 0), F.lit(high))).alias("depth")
    nodes = bins.select("bin", "bytes", "docs", depths).withColumn("node", F.expr(f"shiftright(bin, {high} - depth)"))
    fits = nodes.groupBy("depth", "node").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).filter(F.col("shard_bytes") <= limit_bytes)
    below = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"))
    return fits.join(below, ["depth", "node"], "left_anti")


def directory(found: DataFrame, deepest: int) -> DataFrame:
    """The directory of ``deepest`` bits: the columns of ``found`` (depth, node, ...) and ``entry``,
    one for each value of that many bits that belongs to a bucket. About as many rows as buckets,
    when hashes are even."""
    first = F.expr(f"shiftleft(node, {deepest} - depth)")
    return found.withColumn("entry", F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {deepest} - depth) - 1"))))


def extendible_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 64 << 20, step: int = 20, next_step: int = 8, carry: list[str] | None = None) -> DataFrame:
    """``<id_col>, shard, depth, bytes, shard_bytes, shard_docs, overflow`` for every row, and the
    columns ``carry`` of ``docs``.

    A row's bytes are those of its text in UTF-8 (null: 0); its hash is made from its id as text,
    or, where that is null, from its text. shard: the bits of the bucket's prefix, followed by
    ``+l.p`` for page p of lane l. Rows that agree in all 60 bits (repeated ids) and together exceed
    the limit can't be split by bits; they go to overflow pages of at most the limit each, in lanes
    by hashes of their texts (rows equal in id and text meet in one lane). overflow tells whether a
    shard is over the limit, which only a single row of over the limit can cause. Repeated rows are
    rows of their own. An empty table gives no rows. Extra columns that aren't carried are left out.
    """
    carry = carry or []
    sized = docs.select(F.col(id_col).alias("_id"), row_hash(id_col, text_col).alias("_h"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("_bytes"), F.pmod(F.xxhash64(text_col), F.lit(LANES)).alias("_lane"), *[F.col(c).alias(f"c_{c}") for c in carry])
    own = [c for c in sized.columns if c != "_lane"]
    left = stash(sized, "hashes")
    parts, low = [], 0
    while True:
        high = min(BITS, low + (next_step if low else step))
        bins = left.groupBy(F.shiftright("_h", BITS - high).alias("bin")).agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        bins = stash(bins, "bins")
        found = stash(buckets(bins, low, high, limit_bytes), "buckets")
        full = bins.filter(F.col("bytes") > limit_bytes).limit(1).count() > 0
        deepest = high if full else found.agg(F.max("depth")).first()[0] or low
        at = directory(found, deepest)
        placed = left.withColumn("entry", F.shiftright("_h", BITS - deepest) if deepest else F.lit(0).cast("long")).join(at, "entry", "left")
        parts.append(placed.filter("depth is not null").select(*own, "depth", "node", "shard_bytes", "shard_docs", F.lit("").alias("page")))
        if not full:
            break
        left = stash(placed.filter("depth is null").select(*left.columns), "oversize")
        if high == BITS:
            # pages of half the limit by running bytes never exceed the limit unless one row does
            lane = W.partitionBy("_h", "_lane")
            run = F.coalesce(F.sum("_bytes").over(lane.orderBy("_bytes").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            alone = F.col("_bytes") * 2 > limit_bytes
            page = F.when(alone, F.row_number().over(lane.orderBy("_bytes")) + F.lit(1 << 40)).otherwise(F.floor(run / F.lit(max(1, limit_bytes // 2))))
            paged = left.withColumn("page", F.concat(F.lit("+"), "_lane", F.lit("."), page.cast("long")))
            sums = paged.groupBy("_h", "page").agg(F.sum("_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
            paged = paged.join(sums, ["_h", "page"])
            parts.append(paged.select(*own, F.lit(BITS).alias("depth"), F.col("_h").alias("node"), "shard_bytes", "shard_docs", "page"))
            break
        low = high
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bits = F.expr("if(depth = 0, '', lpad(conv(node, 10, 2), depth, '0'))")
    return out.select(
        F.col("_id").alias(id_col),
        F.concat(bits, "page").alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        F.col("_bytes").alias("bytes"),
        "shard_bytes",
        "shard_docs",
        (F.col("shard_bytes") > limit_bytes).alias("overflow"),
        *[F.col(f"c_{c}").alias(c) for c in carry],
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> None:
    """Write ``docs`` as Parquet, one folder a shard. The columns travel with their row, so each row,
    without id or repeated too, is written once; a column named shard is replaced. A shard is at most
    the limit, and one task writes it whole."""
    docs = docs.drop("shard")
    rows = docs.select(id_col, text_col, F.struct(*docs.columns).alias("_row"))
    placed = extendible_shards(rows, id_col, text_col, carry=["_row"], **limits)
    placed.select("_row.*", F.concat(F.lit("b"), "shard").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)

"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of equally many rows. A source with weight ``w`` progresses in
the ideal (fluid) mix at rate ``w``; the j-th block of it may start when the fluid mix starts
it (its release) and must be done when the fluid mix has finished it (its deadline).
Earliest-deadline-first over these windows fills every slot and meets every deadline, so each
source stays less than one block from its target at every slot. When a source runs out, the
fluid mix shares its rate among the others by their weights, and so do the windows.

Rows never meet in one task: a row's block follows from its rank inside its source, taken in
``lanes`` hash lanes with offsets, so a source with a third of all rows is ranked by many
tasks. Only the schedule is made in one place, and its size is fixed: ``total_blocks`` (the
block size grows with the table) plus one short block for each source. Its windows come from one
sort; the fold over its slots looks at each source once a slot, so it suits up to some thousands
of sources. More of them (hosts, say) should be mixed as groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

#: Parts of a hash that make a fraction.
_HASH_SPAN = 1 << 30
#: Rows up to which the tables of lanes and blocks are broadcast (some 5 MB); with more sources
#: than fit, they are joined by a shuffle, to the same result.
BROADCAST_ROWS = 1 << 16


def _keyed(docs: DataFrame, id_col: str, lanes: int) -> DataFrame:
    """Adds ``_lane`` and ``_key``: the order of rows inside a source is that of the key, and lanes
    are ranges of it. Rows that repeat share a key."""
    h = F.xxhash64(F.lit("mix"), F.col(id_col))
    place = F.pmod(h, F.lit(_HASH_SPAN))
    key = F.struct(place.alias("place"), h.alias("h"), F.xxhash64(*[F.col(c) for c in docs.columns]).alias("row"))
    return docs.withColumn("_lane", F.floor(place * F.lit(lanes) / F.lit(_HASH_SPAN)).cast("int")).withColumn("_key", key)


def _near(n_sources: int, lanes: int, total_blocks: int):
    """The hint for tables of lanes and blocks: broadcast, up to a checked number of rows."""
    return F.broadcast if n_sources * (lanes + 1) + total_blocks <= BROADCAST_ROWS else (lambda df: df)


def source_stats(docs: DataFrame, source: str, weights: dict[str, float] | None, power: float) -> DataFrame:
    """One row a source: ``source, n, weight``. A source without a positive target weight gets
    its share of the rows as its weight."""
    stats = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    natural = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    if not weights:
        return stats.withColumn("weight", natural)
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    given = F.try_element_at(F.create_map(*pairs), F.coalesce(F.col("source"), F.lit("")))
    total = F.sum("n").over(W.partitionBy())
    return stats.withColumn("weight", F.when(given > 0, given).otherwise(F.col("n") / total))


def block_windows(stats: DataFrame, total_blocks: int) -> DataFrame:
    """``source, k, block, block_rows, n, release, deadline`` for each block; k: the source's
    place in the list of sources.

    A source of weight w (of 1) has done x of its b blocks at virtual time x / w, and the fluid mix
    has then reached slot F(t) = sum of min(w t, b) over all sources: the blocks of those that have
    run out, and t times the weight of the others. Both are running sums over all block ends in
    order of t."""
    whole = W.partitionBy()
    sized = stats.select("source", "n", (F.col("weight") / F.sum("weight").over(whole)).alias("w"), F.greatest(F.lit(1), F.ceil(F.sum("n").over(whole) / F.lit(total_blocks))).cast("long").alias("block_rows"))
    sized = sized.withColumn("b", F.ceil(F.col("n") / F.col("block_rows")).cast("int")).withColumn("k", F.row_number().over(whole.orderBy("source")) - 1)
    ends = sized.withColumn("block", F.explode(F.expr("sequence(0, b)"))).withColumn("t", F.col("block") / F.col("w"))
    upto = whole.orderBy("t")  # up to t, all that ties with it
    out_of_rows = F.col("block") == F.col("b")
    done = F.sum(F.when(out_of_rows, F.col("b")).otherwise(0)).over(upto)
    rate = F.greatest(1 - F.sum(F.when(out_of_rows, F.col("w")).otherwise(0.0)).over(upto), F.lit(0.0))
    fluid = ends.withColumn("slot", done + F.col("t") * rate)
    from_ = F.lag("slot").over(W.partitionBy("k").orderBy("block"))
    return fluid.withColumn("from", from_).filter("block > 0").select(
        "k", "source", "n", "block", "block_rows", F.floor(F.col("from") + 1e-7).cast("int").alias("release"), F.ceil(F.col("slot") - 1e-7).cast("int").alias("deadline")
    )


def edf_slots(windows: DataFrame) -> DataFrame:
    """``k, block, slot``: earliest deadline first, one block a slot. The whole schedule is one
    row of arrays; its size is bounded by the number of blocks."""
    lists = (
        windows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("block", "release", "deadline"))).alias("b"))
        .agg(F.array_sort(F.collect_list(F.struct("k", "b"))).alias("q"))
        .filter(F.size("q") > 0)
    )
    # a source's key at a slot: the deadline of its next block, or null if that isn't released
    key = "if(at[i] < size(q[i].b) and q[i].b[at[i]].release <= slot, struct(q[i].b[at[i]].deadline as d, i as i), null)"
    pick = f"array_min(transform(sequence(0, size(q) - 1), i -> {key.replace('at[', 'acc.at[')})).i"
    step = f"""transform(array({pick}), p -> named_struct(
        'at', transform(acc.at, (a, i) -> if(i = p, a + 1, a)), 'out', array_append(acc.out, p)))[0]"""
    run = f"""aggregate(sequence(0, cast(aggregate(q, 0, (a, x) -> a + size(x.b)) as int) - 1),
        named_struct('at', transform(q, x -> 0), 'out', cast(array() as array<int>)),
        (acc, slot) -> {step}, acc -> acc.out)"""
    slots = lists.select(F.posexplode(F.expr(run)).alias("slot", "k"))
    return slots.select("k", F.row_number().over(W.partitionBy("k").orderBy("slot")).alias("block"), "slot")


def pfair_schedule(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total_blocks: int = 4096) -> DataFrame:
    """The block schedule: ``source, block, slot, release, deadline, block_rows, start``; start
    is the position of the block's first row in the mix."""
    windows = block_windows(source_stats(docs, source, weights, power), total_blocks)
    size = F.least(F.col("block_rows"), F.col("n") - (F.col("block") - 1) * F.col("block_rows"))
    plan = windows.join(edf_slots(windows), ["k", "block"])
    before = F.sum(size).over(W.partitionBy().orderBy("slot").rowsBetween(W.unboundedPreceding, -1))  # bounded by total_blocks
    return plan.select("source", "block", "slot", "release", "deadline", "block_rows", F.coalesce(before, F.lit(0)).cast("long").alias("start"))


def pfair_mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total_blocks: int = 4096, lanes: int = 1024) -> DataFrame:
    """Add ``mix_block, mix_slot, mix_release, mix_deadline, mix_position`` (from 0, without gaps)
    to every row of ``docs``; ordered by mix_position, the rows are the mix.

    weights: target weight by source; None: rows of the source to the power ``power``. A null
    source is a source like the others. Inside a source, rows come in an order drawn from their
    ids (rows that repeat an id keep together in the order of their hashes); null ids are ids.
    Other columns pass through; columns of the added names are replaced. Every row comes out once. An empty table gives no rows.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position")
    hashed = docs.withColumn("_h", F.xxhash64(F.lit("mix"), F.col(id_col))).withColumn(
        "_lane", F.floor(F.pmod(F.col("_h"), F.lit(_HASH_SPAN)) * F.lit(lanes) / F.lit(_HASH_SPAN)).cast("int")
    )
    own = [F.col("_h"), F.col(id_col), F.xxhash64(*[F.col(c) for c in docs.columns])]
    ranked = hashed.withColumn("_rank", F.row_number().over(W.partitionBy(source, "_lane").orderBy(F.pmod(F.col("_h"), F.lit(_HASH_SPAN)), *own)))
    lane_sizes = hashed.groupBy(F.col(source).alias("_source"), F.col("_lane").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy("_source").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    offsets = lane_sizes.select("_source", "_at", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    plan = pfair_schedule(docs, source, weights, power, total_blocks).select(*[F.col(c).alias(f"_p_{c}") for c in ("source", "block", "slot", "release", "deadline", "block_rows", "start")])

    # rows are shuffled once, for their ranks; lanes and blocks come to them where that is small
    near = _near(docs.select(source).distinct().count(), lanes, total_blocks)
    spans = offsets.join(plan.select("_p_source", "_p_block_rows").distinct(), F.col("_source").eqNullSafe(F.col("_p_source"))).drop("_p_source")
    placed = (
        ranked.join(near(spans), F.col(source).eqNullSafe(F.col("_source")) & (F.col("_lane") == F.col("_at")))
        .withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
        .withColumn("_block", (F.expr("_rank div _p_block_rows") + 1).cast("int"))
        .drop("_p_block_rows")
    )
    out = placed.join(near(plan), F.col(source).eqNullSafe(F.col("_p_source")) & (F.col("_block") == F.col("_p_block")))
    position: Column = F.col("_p_start") + F.col("_rank") % F.col("_p_block_rows")
    return out.select(
        *[F.col(c) for c in docs.columns],
        F.col("_block").alias("mix_block"),
        F.col("_p_slot").alias("mix_slot"),
        F.col("_p_release").alias("mix_release"),
        F.col("_p_deadline").alias("mix_deadline"),
        position.cast("long").alias("mix_position"),
    )


def pfair_sorted(docs: DataFrame, files: int, id_col: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total_blocks: int = 4096, lanes: int = 1024) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, as ``files`` partitions of about equally many
    blocks; no columns are added. The schedule is that of ``pfair_mix``, and inside a block rows
    come in the order of a hash of their id.

    Whole rows are shuffled once, straight to their file. The keys at which blocks begin are found
    first, on keys and counts alone; a row then finds its block among the few that begin in its lane.
    Rows that repeat more often than a block has rows are counted and dealt out to its blocks by
    their numbers. Null sources are a source, null ids are ids, an empty table gives no rows. The
    columns must be of types that can be grouped.
    """
    columns = docs.columns
    keyed = _keyed(docs, id_col, lanes)
    plan = pfair_schedule(docs, source, weights, power, total_blocks)
    total = F.max("slot").over(W.partitionBy()) + 1  # bounded by total_blocks
    plan = plan.select(F.col("source").alias("_s"), "block", "slot", "block_rows", total.alias("slots")).withColumn("file", F.expr(f"cast(slot * {files}L div slots as int)"))

    counts = keyed.groupBy(F.col(source).alias("_source"), "_lane", "_key").agg(F.count(F.lit(1)).alias("m"))
    lane = W.partitionBy("_source", "_lane")
    inside = counts.withColumn("_at", F.sum("m").over(lane.orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("m"))
    sizes = counts.groupBy("_source", "_lane").agg(F.sum("m").alias("n"))
    upto = W.partitionBy("_source").orderBy("_lane").rowsBetween(W.unboundedPreceding, -1)  # lanes of a source
    offsets = sizes.select(F.col("_source").alias("_o"), F.col("_lane").alias("_l"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    rows_of = plan.select("_s", "block_rows").distinct()
    near = _near(docs.select(source).distinct().count(), lanes, total_blocks)
    spans = offsets.join(rows_of, F.col("_o").eqNullSafe(F.col("_s"))).drop("_s")
    ranked = inside.join(near(spans), F.col("_source").eqNullSafe(F.col("_o")) & (F.col("_lane") == F.col("_l"))).withColumn("_rank", F.col("_at") + F.col("_before"))
    # the blocks that begin at one of the copies of a key; copy: at which
    first = F.expr("(_rank + block_rows - 1) div block_rows")
    last = F.expr("(_rank + m - 1) div block_rows")
    begin = ranked.withColumn("b", F.explode(F.when(first <= last, F.sequence(first, last)))).select("_source", "_lane", F.struct(F.col("_key").alias("key"), F.expr("b * block_rows - _rank").alias("copy")).alias("at"), (F.col("m") > 1).alias("tied"), (F.col("b") + 1).alias("_b"))
    # the block in which a lane begins
    least = F.struct(F.struct(F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("row")).alias("key"), F.lit(0).cast("long").alias("copy"))
    head = spans.select(F.col("_o").alias("_source"), F.col("_l").alias("_lane"), least.alias("at"), F.lit(False).alias("tied"), (F.expr("_before div block_rows") + 1).alias("_b"))
    marks = head.unionByName(begin).join(near(plan), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("block")))
    cuts = stash(marks.groupBy("_source", "_lane").agg(F.sort_array(F.collect_list(F.struct("at", "tied", "slot", "file"))).alias("_cuts")).withColumnRenamed("_lane", "_l"), "mix-cuts")

    def with_cuts(df: DataFrame) -> DataFrame:
        return df.join(near(cuts), F.col(source).eqNullSafe(F.col("_source")) & (F.col("_lane") == F.col("_l"))).drop("_source", "_l")

    def at(copy: str) -> Column:
        return F.expr(f"element_at(filter(_cuts, c -> c.at.key < _key or (c.at.key = _key and c.at.copy <= {copy})), -1)")

    met, out = with_cuts(keyed), [*columns, "_key", "_mark"]
    if cuts.filter("exists(_cuts, c -> c.tied)").limit(1).count() == 0:
        placed = met.withColumn("_mark", at("0L")).select(*out)
    else:
        tied = F.expr("exists(_cuts, c -> c.tied and c.at.key = _key)")
        some = met.filter(tied).groupBy(*columns, "_lane", "_key").agg(F.count(F.lit(1)).alias("_m"))
        copies = with_cuts(some.withColumn("_copy", F.explode(F.expr("sequence(0L, _m - 1)"))))
        placed = met.filter(~tied).withColumn("_mark", at("0L")).select(*out).unionByName(copies.withColumn("_mark", at("_copy")).select(*out))
    return placed.repartitionById(files, F.col("_mark.file")).sortWithinPartitions("_mark.slot", "_key").select(*columns)

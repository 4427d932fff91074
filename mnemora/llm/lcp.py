"""Document fingerprints by locally consistent parsing.

A text is a string of code points. At each level, deterministic coin tossing turns the string
into small labels that differ between neighbours (each round keeps the lowest bit in which a
symbol differs from the one on its left, with its place); strict local minima of the labels begin
phrases, and a phrase's name is a hash of its symbols, the string of the next level. Runs of one
symbol become one symbol first. A cut depends only on a few symbols around it, so equal
substrings are parsed alike but near their ends, wherever they stand.

The fingerprint holds the ``KEEP`` smallest names of the highest level up to ``LEVEL`` at which the
text has ``ENOUGH`` phrases (a short text: of the first level), and half as many of the level below,
as hex, with the levels in front. So texts of unlike length have a level in common unless one is
many times as long. The likeness of two fingerprints estimates the share of the phrases of both
that are common (Jaccard), at the highest level that both have. A fingerprint of a text depends on
that text alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from .common import bounded_batches

#: Highest level whose names are kept (phrases of some 30 code points), phrases that a text must have
#: there, names kept, coin-tossing rounds.
LEVEL, ENOUGH, KEEP, TOSSES = 4, 8, 64, 3
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
#: Factors by place in a phrase (a longer phrase goes round).
_PLACES = 256


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= _A
    h ^= h >> np.uint32(13)
    h *= _B
    h ^= h >> np.uint32(16)
    return h


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The label of (symbol, left symbol) for symbols below 256, and the factors by place."""
    sym, left = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    differ = sym ^ left
    differ[differ == 0] = 1  # only after a border or a collision of names
    place = np.log2(differ & -differ).astype(int)
    return (place * 2 + ((sym >> place) & 1)).astype(np.uint8).reshape(-1), _mix(np.arange(1, _PLACES + 1, dtype=np.uint32) * _C) | np.uint32(1)


_TOSS, _FACTOR = _tables()


def next_level(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and owners (the text that a symbol belongs to) of the next level. Texts stand one
    behind the other; nothing reaches over the border of two."""
    n = len(symbols)
    border = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    # runs of one symbol become one symbol, named with the run's length
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[border] = True
    at = np.flatnonzero(new)
    if len(at) < n:
        length = np.diff(at, append=n)
        runs = np.flatnonzero(length > 1)
        border = np.searchsorted(at, border)
        symbols, owner = symbols[at], owner[at]
        symbols[runs] = _mix(symbols[runs] + length[runs].astype(np.uint32) * _C)
        n = len(symbols)
    # coin tossing: 64 labels after the first round, then at most 12, then 8
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[0] = ~symbols[0]
    left[border] = ~symbols[border]
    left ^= symbols
    left[left == 0] = 1
    left &= ~left + np.uint32(1)  # the lowest bit that differs
    place = (left.astype(np.float32).view(np.uint32) >> np.uint32(23)) - np.uint32(127)
    label = (place * np.uint32(2) + ((symbols & left) != 0)).astype(np.uint8)
    for _ in range(TOSSES - 1):
        pair = label.astype(np.uint16) << np.uint16(8)
        pair[1:] |= label[:-1]
        pair[0] |= np.uint16(255) ^ label[0]
        pair[border] = (label[border].astype(np.uint16) << np.uint16(8)) | (np.uint16(255) ^ label[border])
        label = _TOSS[pair]
    # a phrase begins at a text's first symbol and at every strict local minimum inside it
    below = label[1:] < label[:-1]  # at i: the one behind i is less
    start = np.zeros(n, bool)
    above = label[:-1] < label[1:]
    above[border - 1] = False
    start[1:-1] = below[:-1] & above[1:]
    start[0] = True
    start[border] = True
    starts = np.flatnonzero(start)
    # names: a sum of the phrase's symbols times factors by place
    step = np.arange(n, dtype=np.int32)
    step -= np.repeat(starts.astype(np.int32), np.diff(starts, append=n))
    if n and int(step.max()) >= _PLACES:
        step %= _PLACES
    return _mix(np.add.reduceat(_FACTOR[step] * (symbols + _C), starts, dtype=np.uint32)), owner[starts]


def _fingerprints(texts: list[str]) -> list[str]:
    sizes = np.array([len(t) for t in texts])
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    best: list[str] = [""] * len(texts)
    last: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # level, hashed names, ends and counts by text, of two levels

    def kept(i: int) -> str:
        out = []
        for (level, hashed, ends, counts), keep in zip(reversed(last), (KEEP, KEEP // 2)):
            names = np.unique(hashed[ends[i] - counts[i] : ends[i]])[:keep]
            out.append(f"{level:x}:" + names.astype(">u4").tobytes().hex())
        return "|".join(out)

    level = 0
    while len(symbols):
        symbols, owner = next_level(symbols, owner)
        level += 1
        counts = np.bincount(owner, minlength=len(texts))
        if level > 1:  # what has too few phrases here is named by the levels before
            short = np.flatnonzero((counts > 0) & (counts < ENOUGH))
            for i in short.tolist():
                best[i] = kept(i)
            keep = ~np.isin(owner, short)
            symbols, owner = symbols[keep], owner[keep]
            counts[short] = 0
        last = [*last[-1:], (level, _mix(symbols + _B), np.cumsum(counts), counts)]
        if level == LEVEL:
            for i in np.flatnonzero(counts).tolist():
                best[i] = kept(i)
            break
    return best


def fingerprints(texts: list[str], chunk: int = 1 << 18) -> Iterator[str]:
    """Fingerprints of texts, in order; texts are parsed together up to ``chunk`` code points at
    once (a longer text alone), so memory grows with the longest text only. Empty text: ''."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > chunk:
            yield from _fingerprints(part)
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield from _fingerprints(part)


def names_of(fingerprint: str) -> dict[str, list[str]]:
    """Names by level, in ascending order."""
    out = {}
    for part in fingerprint.split("|") if fingerprint else ():
        level, _, raw = part.partition(":")
        out[level] = [raw[i : i + 8] for i in range(0, len(raw), 8)]
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1. Both empty: 1; fingerprints without a common level share nothing. The estimate is
    taken over the smallest names of both, as many as both keep."""
    if a == b:
        return 1.0
    x, y = names_of(a), names_of(b)
    both = x.keys() & y.keys()
    if not both:
        return 0.0
    level = max(both)
    keep = min(KEEP if level == max(n) else KEEP // 2 for n in (x, y))
    p, q = set(x[level][:keep]), set(y[level][:keep])
    smallest = sorted(p | q)[:keep]
    return sum(v in p and v in q for v in smallest) / len(smallest)


def fingerprint(docs, text_col: str = "text", out_col: str = "fingerprint"):
    """Add the fingerprint of every whole text (null: as empty, ``''``). Rows are handled where they
    are read, repeated rows alike; an empty table stays empty; other columns pass through, and a
    column named ``out_col`` is replaced."""
    import pyarrow as pa
    from pyspark.sql import types as T

    docs = docs.drop(out_col)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(fingerprints(texts)), pa.string())], [*part.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType())]))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following text."""
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None):
    """For every row, its fingerprint, that of its edited text (``edited`` with the next row's
    text, in descending order of ids, the first after the last), and the likeness to both.

    Ids are cut into ranges by quantiles, about four for each of ``parts`` tasks; an id that repeats
    so often that it spans quantiles, and the rows without id, are cut again by hashes of their
    texts. The rows of a range meet in order in one task, with a copy of the row that follows the
    range; so the text is shuffled once, and no task sees more than its ranges. Rows that repeat an
    id follow each other by the hash of their texts; rows without id come last, in the same order.
    A single row follows itself. Extra columns are left out; an empty table gives no rows.
    """
    import hashlib

    import pyarrow as pa
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    bounded_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / (4 * parts) for i in range(1, 4 * parts)], 20_000)).first()[0]
    cuts, uses = np.unique(np.array(cuts or [], dtype=np.int64), return_counts=True)
    hot = cuts[uses > 1]  # at most half of the quantiles

    def range_of(c: str):
        """How many cuts lie below an id, plus 1 (null: 0): first among every g-th cut, then among
        the g behind it."""
        if not len(cuts):
            return F.when(F.col(c).isNull(), 0).otherwise(1)
        g = math.isqrt(len(cuts)) + 1
        array = lambda xs: "array(" + ", ".join(f"{int(x)}L" for x in xs) + ")"
        coarse = f"size(filter({array(cuts[g - 1 :: g])}, x -> x < {c}))" if len(cuts) >= g else "0"
        fine = f"size(filter(slice({array(cuts)}, {coarse} * {g} + 1, {g}), x -> x < {c}))"
        return F.expr(f"if({c} is null, 0, {coarse} * {g} + {fine} + 1)")

    # within a range of one hot id, or of none, parts go by the hash, from the greatest down as parts go up
    again = F.col("doc_id").isNull()
    if len(hot):
        again = again | F.col("doc_id").isin([int(x) for x in hot])
    sub = F.when(again, F.lit(4 * parts - 1) - F.floor((F.shiftright("order", 1) / F.lit(float(1 << 63)) + 0.5) * (4 * parts))).otherwise(0)
    part = (range_of("doc_id").cast("long") * F.lit(1 << 20) + F.least(F.greatest(sub, F.lit(0)), F.lit((1 << 20) - 1))).cast("long")
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = ranged.withColumn("order", F.xxhash64("text")).withColumn("part", part)
    # one row a range: the row that begins it, and the range before it, which needs a copy
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head"), F.min(F.when(again, F.col("order"))).alias("low"))
    order = W.partitionBy(F.lit(0)).orderBy("part")
    heads = heads.withColumn("for", F.coalesce(F.lead("part").over(order), F.min("part").over(W.partitionBy(F.lit(0)))))
    heads = heads.select(F.col("part").alias("_part"), F.col("head").alias("_head"), F.col("low").alias("_low"), F.col("for").alias("_for"))
    met = ranged.join(F.broadcast(heads), (ranged["part"] == heads["_part"]) & ranged["doc_id"].eqNullSafe(heads["_head"]) & (~again | (ranged["order"] == heads["_low"])), "left")
    to = F.when(F.col("_part").isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("copy")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("copy")), F.struct(F.col("_for").alias("part"), F.lit(1).alias("copy")))
    )
    sent = met.select("doc_id", "order", "text", F.explode(to).alias("to")).select("to.part", "to.copy", "doc_id", "text", "order")
    ordered = sent.repartition(parts, "part").sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "order").drop("order")

    def run(batches):
        held = None  # the row that still lacks its next one: part, id, text, fingerprint

        def compared(rows):
            texts = [edited(a[2], b[2]) for a, b in rows]
            for (a, b), text, fp in zip(rows, texts, fingerprints(texts), strict=True):
                yield a[1], len(a[2]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), a[3], fp, likeness(a[3], fp), likeness(a[3], b[3])

        for batch in batches:
            for b in (batch.slice(i, 250) for i in range(0, batch.num_rows, 250)):
                part, copy, doc, text = (b.column(i).to_pylist() for i in range(4))
                rows = []
                for here in zip(part, doc, text, fingerprints(text), copy, strict=True):
                    if held is not None and held[0] == here[0] and not held[4]:
                        rows.append((held, here))
                    held = here
                out = list(compared(rows))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in EDITED.split(", ")])

    return ordered.mapInArrow(run, EDITED)

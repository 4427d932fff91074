"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is split by a pattern, and each pre-token is merged on its own. The parts of a pre-token
are a linked list. A pair of neighbours that can merge waits in the bucket of its merge rank; a
two-level bitmap over the ranks tells by find-first-set which bucket is the lowest, so the next
merge costs the same however long the pre-token is. Entries whose pair has changed since are
stale and skipped. Within a bucket the leftmost position goes first.

Rows are encoded where they are read: no shuffle. Memory in a task is one Arrow batch plus a
word cache of at most ``CACHE_WORDS`` short words, which a Python worker keeps from task to task.

Null texts and null ids are as empty ones; an empty table gives an empty table; repeated rows
give equal rows; texts of any length are encoded whole; other columns pass through, and a column
of an added name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, give_back

#: Entries of a worker's word cache (some 150 bytes each), in two halves: when the new half is full, it
#: becomes the old one, of which words that occur again move on. Longer pre-tokens than ``CACHE_BYTES``
#: aren't kept.
CACHE_WORDS, CACHE_BYTES = 800_000, 64
#: Ranks in a word of the lower bitmap.
WORD = 256


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token.

    ``buckets`` holds the waiting positions by rank, ``low`` a bitmap of the ranks of each word
    of ``WORD`` ranks, ``top`` a bitmap of the words: the queue of two levels. It is written
    out here, since calls would cost more than the work for short pre-tokens.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    want: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]  # the rank with which the part that starts here merges with the next
    want.append(None)
    end = list(range(1, n + 1))  # where the part that starts here ends; the next one starts there
    before = list(range(-1, n - 1))
    top, low, buckets = 0, {}, {}
    for i, r in enumerate(want):
        if r is not None:
            if r in buckets:
                buckets[r].append(i)  # ascending, so a heap
            else:
                buckets[r] = [i]
                word = r // WORD
                low[word] = low.get(word, 0) | 1 << r % WORD
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = word * WORD + (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        i = heapq.heappop(bucket)
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            low[word] = bits
            if not bits:
                top &= top - 1
        if want[i] != rank:
            continue  # stale
        j = end[i]
        stop = end[i] = end[j]
        want[j] = None
        h = before[i]
        fresh = []
        if stop < n:
            before[stop] = i
            want[i] = r = get(piece[i : end[stop]])
            if r is not None:
                fresh.append((r, i))
        else:
            want[i] = None
        if h >= 0:
            r = get(piece[h:stop])
            if r is not None and r != want[h]:
                fresh.append((r, h))
            want[h] = r
        for r, at in fresh:
            if r in buckets:
                heapq.heappush(buckets[r], at)
            else:
                buckets[r] = [at]
                word = r // WORD
                low[word] = low.get(word, 0) | 1 << r % WORD
                top |= 1 << word
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a line has a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Encoder:
    def __init__(self, raw_ranks: bytes, pattern: str, cache_words: int = CACHE_WORDS) -> None:
        import regex

        self.ranks = parse_ranks(raw_ranks)
        self.split = regex.compile(pattern).findall
        self.half = max(1, cache_words // 2)
        # words outlast a task: a worker that serves several tasks has one cache for a vocabulary
        kept = sys.modules.setdefault("_mnemora_words", types.ModuleType("_mnemora_words")).__dict__
        #: the new half of the cache and the old one
        self.halves: list[dict[str, bytes]] = kept.setdefault(hashlib.sha256(raw_ranks + pattern.encode()).hexdigest(), [{}, {}])

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        (new, old), out = self.halves, []
        for word in self.split(text):
            ids = new.get(word)
            if ids is None:
                ids = old.pop(word, None)
                if ids is None:
                    raw = word.encode()
                    found = merge(raw, self.ranks)
                    ids = struct.pack(f"<{len(found)}I", *found)
                    kept = len(raw) <= CACHE_BYTES
                else:
                    kept = True
                if kept:
                    if len(new) >= self.half:
                        self.halves[:] = new, old = {}, new
                    new[word] = ids
            out.append(ids)
        return b"".join(out)


def read_ranks(spark: SparkSession, path: str):
    """A broadcast of a rank file's bytes (about a megabyte; a vocabulary doesn't grow with the data)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class Decoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = {r: t for t, r in ranks.items()}

    def unpacked(self, packed: bytes) -> bytes | None:
        """The bytes that ids stand for; None if one of them isn't in the vocabulary."""
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        except KeyError:
            return None


def _added(df: DataFrame, names: list[str], run, without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with binary columns ``names``, which ``run`` makes of slices of its batches; the
    columns ``without`` end here."""
    rest = df.drop(*names)
    kept = [c for c in rest.columns if c not in without]
    bounded_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = run()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                made = [pa.array(x, pa.binary()) for x in work(part)]
                yield pa.RecordBatch.from_arrays([*(_values(part, c) for c in kept), *made], [*kept, *names])
        del work
        give_back()

    return rest.mapInArrow(each, T.StructType([*(rest.schema[c] for c in kept), *(T.StructField(n, T.BinaryType()) for n in names)]))


def _values(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def encode(docs: DataFrame, ranks, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``, the ids as packed little-endian unsigned 32-bit integers; null or empty
    text has none (an empty binary). Texts that look like special tokens are ordinary text."""

    def run():
        packed = Encoder(ranks.value, pattern).packed
        return lambda part: [[packed(x.as_py() or "") for x in _values(part, text_col)]]

    return _added(docs, [ids_col], run)


def decode(tokens: DataFrame, ranks, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the bytes that the packed ids of ``ids_col`` stand for (null: none). Ids of
    which one isn't in the vocabulary can't be decoded: null."""

    def run():
        unpacked = Decoder(parse_ranks(ranks.value)).unpacked
        return lambda part: [[unpacked(x.as_py() or b"") for x in _values(part, ids_col)]]

    return _added(tokens, [out_col], run)


def round_trip(docs: DataFrame, ranks, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", cache_words: int = CACHE_WORDS) -> DataFrame:
    """``encode`` and ``decode`` of what it gave, in one pass of one Python worker a task. The text
    isn't passed on. ``cache_words`` bounds a worker's word cache; no result depends on it."""

    def run():
        encoder = Encoder(ranks.value, pattern, cache_words)
        unpacked = Decoder(encoder.ranks).unpacked

        def work(part: pa.RecordBatch) -> list[list[bytes | None]]:
            ids = [encoder.packed(x.as_py() or "") for x in _values(part, text_col)]
            return [ids, [unpacked(x) for x in ids]]

        return work

    return _added(docs, [ids_col, out_col], run, without=(text_col,))


def ids_array(packed: np.ndarray | bytes) -> list[int]:
    """Packed ids as a list."""
    return np.frombuffer(packed, "<u4").tolist()


def token_count(ids_col: str = "ids"):
    return F.expr(f"octet_length({ids_col}) div 4")

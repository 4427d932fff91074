"""Runs of words that repeat with a period, by internal pattern matching.

Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period q (words q apart
are identical) of at least ``EXPONENT`` q and ``LEAST`` words that no neighbouring word extends.

A run of period q holds, for the power of two m with (2m - 1) / 3 <= q, a block of m words at a
multiple of m whose next occurrence lies q words on and inside the run. So for each level m, every
aligned block asks for its occurrences in the window of the periods of that level, which is no wider
than m: they form an arithmetic progression. Refining the classes of equal blocks from level to level
gives each block its interval of the suffix array, and a wavelet matrix over that array answers
"smallest position of at least p in this interval" (range successor). One or two occurrences are
candidates by themselves. Of three or more, at the distance r of two, the block has period r, and
only the one can be a period that carries the end of the stretch of period r around the block to
the end of the one around the occurrence. Candidates are extended to whole stretches, and each
stretch is extended once.

Rows are handled where they are read, without a shuffle. Texts are worked on together up to
``CHUNK`` words (a longer text alone), so memory grows with the longest text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

EXPONENT, LEAST = 4, 6
#: Words of texts that are worked on together.
CHUNK = 1 << 16

Runs = list[tuple[int, int, int]]


class WaveletMatrix:
    """Range successor over an array of numbers from 0 to below 2^bits, for many queries at once."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []  # how many ones stand before each place, by bit from the highest
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            set_ = bit.astype(bool)
            self.ones.append(before)
            self.zeros.append(len(values) - int(before[-1]))
            values = np.concatenate([values[~set_], values[set_]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at places ``lo`` to below ``hi`` are less than ``bound`` (below 2^bits)."""
        lo, hi, out = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64)
        for i, (before, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            a, b = before[lo], before[hi]
            one = ((bound >> (self.bits - 1 - i)) & 1).astype(bool)
            out += np.where(one, (hi - lo) - (b - a), 0)
            lo, hi = np.where(one, a + zeros, lo - a), np.where(one, b + zeros, hi - b)
        return out

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) at places ``lo`` to below ``hi``, which has more than k."""
        lo, hi, k, out = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), np.int64)
        for i, (before, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            a, b = before[lo], before[hi]
            left = (hi - lo) - (b - a)
            one = k >= left
            k -= np.where(one, left, 0)
            out |= one.astype(np.int64) << (self.bits - 1 - i)
            lo, hi = np.where(one, a + zeros, lo - a), np.where(one, b + zeros, hi - b)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``bound`` at places ``lo`` to below ``hi``; none: -1."""
        k = self.below(lo, hi, bound)
        out = np.full(len(lo), -1, np.int64)
        some = np.flatnonzero(k < hi - lo)
        out[some] = self.smallest(lo[some], hi[some], k[some])
        return out


def _levels(symbols: np.ndarray, least: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array, sorted as far as blocks repeat, and for each level m the aligned blocks that
    occur more than once: m, positions, and the intervals of the array that begin with them.

    symbols: numbers from 0, different ones for different texts, and one that is used once behind each
    text; least: the position of the first word of each position's text; longest: words of the longest
    text."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(symbols[order][1:], symbols[order][:-1], out=fresh[1:])
    firsts = np.flatnonzero(fresh)
    size = np.diff(firsts, append=n)
    group = np.repeat(np.arange(len(firsts)), size)
    rank = np.empty(n, np.int64)  # the first place of the array that holds the class of a position
    rank[order] = firsts[group]
    repeats = size[group] > 1
    slots, at = np.flatnonzero(repeats), order[repeats]  # what is still to be sorted: places, and the positions there
    width, found = 1, []
    while len(at) and 2 * width * 2 <= longest:
        # at ascends by rank; inside a class by the rank of what follows
        key = rank[at] * np.int64(n + 1) + rank[at + width]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        firsts = np.flatnonzero(fresh)
        size = np.diff(firsts, append=len(at))
        group = np.repeat(np.arange(len(firsts)), size)
        begin = slots[firsts][group]
        rank[at] = begin
        repeats = size[group] > 1
        width *= 2
        slots, at, begin, end = slots[repeats], at[repeats], begin[repeats], (begin + size[group])[repeats]
        aligned = (at - least[at]) % width == 0
        found.append((width, at[aligned], begin[aligned], end[aligned]))
    return order, found


def _periods(m: int) -> tuple[int, int]:
    """The least and the greatest period that blocks of m words answer for."""
    return (1 if m == 2 else -(-(2 * m - 1) // 3)), -(-(4 * m - 1) // 3) - 1


def _stretches(symbols: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The beginning and end of the longest stretch of each period around words ``at`` and ``at +
    period``, which are the same. Each stretch is walked once."""
    first, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    order = np.lexsort((at, period))
    n, i = len(symbols), 0
    while i < len(order):
        p, q = int(at[order[i]]), int(period[order[i]])
        a, b, step = p, p + q + 1, 64
        while b < n:
            stop = min(n, b + step)
            differ = np.flatnonzero(symbols[b:stop] != symbols[b - q : stop - q])
            if len(differ):
                b += int(differ[0])
                break
            b, step = stop, step * 2
        step = 64
        while a > 0:
            stop = max(0, a - step)
            differ = np.flatnonzero(symbols[stop:a] != symbols[stop + q : a + q])
            if len(differ):
                a = stop + int(differ[-1]) + 1
                break
            a, step = stop, step * 2
        j = i
        while j < len(order) and int(period[order[j]]) == q and int(at[order[j]]) + q < b:
            j += 1
        first[order[i:j]], last[order[i:j]] = a, b
        i = j
    return first, last


def _candidates(symbols: np.ndarray, matrix: WaveletMatrix, m: int, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods that the blocks of a level propose."""
    low, high = _periods(m)
    limit = len(symbols) - 1
    inside = at + low <= limit
    at, lo, hi = at[inside], lo[inside], hi[inside]
    occurs = []  # the first, second and third occurrence in the window, or -1
    bound = at + low
    for _ in range(3):
        p = np.full(len(at), -1, np.int64)
        ask = np.flatnonzero(bound <= np.minimum(at + high, limit))
        p[ask] = matrix.successor(lo[ask], hi[ask], bound[ask])
        p[p > at + high] = -1
        occurs.append(p)
        bound = np.where(p >= 0, p + 1, limit + 1)
    one, two, three = occurs
    single = three < 0
    where = [at[single & (one >= 0)], at[single & (two >= 0)]]
    apart = [(one - at)[single & (one >= 0)], (two - at)[single & (two >= 0)]]
    many = np.flatnonzero(~single)
    if len(many):
        r = (two - one)[many]
        _, here = _stretches(symbols, at[many], r)
        _, there = _stretches(symbols, one[many], r)
        d = there - here
        fits = (d >= low) & (d <= high) & ((d - (one - at)[many]) % r == 0)
        fits &= symbols[np.minimum(at[many] + np.maximum(d, 0), limit)] == symbols[at[many]]
        where.append(at[many][fits])
        apart.append(d[fits])
    return np.concatenate(where), np.concatenate(apart)


def _runs(texts: list[list[int]]) -> list[Runs]:
    """The runs of texts of word numbers; a number says nothing across texts."""
    out: list[Runs] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(starts[-1])
    symbols, least, base = np.empty(n, np.int64), np.empty(n, np.int64), 0
    for i, t in enumerate(texts):
        a, b = int(starts[i]), int(starts[i + 1])
        own = np.array(t, np.int64)
        symbols[a : b - 1] = own + base
        base += int(own.max()) + 1 if len(own) else 0
        symbols[b - 1] = base
        base += 1
        least[a:b] = a
    order, levels = _levels(symbols, least, int(sizes.max(initial=0)))
    levels = [x for x in levels if len(x[1])]
    if not levels:
        return out
    matrix = WaveletMatrix(order, max(1, int(n).bit_length()))
    found = [_candidates(symbols, matrix, *level) for level in levels]
    at, period = (np.concatenate([f[i] for f in found]) for i in range(2))
    first, last = _stretches(symbols, at, period)
    long = last - first >= np.maximum(LEAST, EXPONENT * period)
    best: dict[tuple[int, int], int] = {}
    for a, b, q in np.unique(np.stack([first[long], last[long], period[long]], axis=1), axis=0).tolist() if long.any() else ():
        best.setdefault((a, b), q)  # ascending: the least period of a stretch comes first
    for (a, b), q in best.items():
        i = int(np.searchsorted(starts, a, side="right")) - 1
        out[i].append((a - int(starts[i]), b - a, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def runs_of(texts: list[list[bytes]]) -> Iterator[Runs]:
    """The runs (start, length, period) of texts of words, by start, then period."""
    part: list[list[int]] = []
    size = 0
    for words in texts:
        if part and size + len(words) > CHUNK:
            yield from _runs(part)
            part, size = [], 0
        numbers: dict[bytes, int] = {}
        part.append([numbers.setdefault(w, len(numbers)) for w in words])
        size += len(words)
    if part:
        yield from _runs(part)


def collapse(words: list[bytes], runs: Runs) -> list[bytes]:
    """The words, of each run only its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


ADDED = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``n_words``, ``runs`` (start, length and period in words, by start, then period) and
    ``collapsed``: the words joined by one space, without those that a run has after its first period.

    Null and empty texts and texts without words have no runs and an empty ``collapsed``. Rows don't
    depend on each other, so repeated rows give equal rows; an empty table stays empty. Other columns
    pass through; those named as added ones are replaced."""
    added = T._parse_datatype_string(ADDED)
    docs = docs.drop(*added.names)
    bounded_batches(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                # bytes.split() cuts at just the white space that words don't have
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                found = list(runs_of(words))
                new = [
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], run_type),
                    pa.array([b" ".join(collapse(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, found, strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *added.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def longest_run(runs: Column) -> Column:
    """``length, start, period`` of the longest run; ties: the smallest start, then period. None: null."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), (-best["start"]).alias("start"), (-best["period"]).alias("period")))


def plant_period(text: Column, doc_id: Column) -> Column:
    """The text in which every tenth document (by the CRC-32 of its id) repeats from some word on with
    some period; words of such a text are joined by one space. Rows without id stay as they are."""
    h = F.crc32(doc_id.cast("string"))

    def bound(value: Column, use) -> Column:
        """``use(value)``, with ``value`` computed once a row."""
        return F.transform(F.array(value), use)[0]

    def planned(x: Column) -> Column:
        n, g = F.size(x["w"]), x["g"]
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.when(n > 0, bound(F.struct(x["w"].alias("w"), a.alias("a"), p.alias("p")), repeated)).otherwise(F.lit(""))

    def repeated(x: Column) -> Column:
        w, a, p = x["w"], x["a"], x["p"]
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: w[F.when(i < a, i).otherwise(a + (i - a) % p)]), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), bound(F.struct(words.alias("w"), F.floor(h / 10).alias("g")), planned)).otherwise(text)

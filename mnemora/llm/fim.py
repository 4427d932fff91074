"""Fill-in-middle: texts are cut at two token places and rearranged, so that a model learns to fill.

Tokens are runs of ASCII letters, and every other code point on its own. Where the cuts fall depends
on the number of tokens, and that is counted over chunks that texts share: a rolling hash over
``WINDOW`` code points ends a chunk where its low bits are zero, so that a passage that stands in
many texts is cut alike in all of them. What a chunk adds is known from a summary: the number of
tokens that it has alone, and whether it begins and ends with a letter (then a token may reach over
the border, and is counted once). Summaries are kept by the content of the chunk, compared whole, so
a collision can't give a wrong count. Sums over the summaries of a text locate the chunk that holds a
cut, and only that chunk is looked at again.

Rows are handled where they are read, without a shuffle; memory in a task is an Arrow batch, the
chunks of one text and a cache of at most ``CACHE_CHARS`` code points, which ends with the task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of the rolling window; a chunk ends with a chance of 1 in 2^CUT_BITS at each place, and
#: has at least LEAST and at most MOST code points.
WINDOW, CUT_BITS, LEAST, MOST = 16, 8, 64, 2048
#: Code points of the chunks whose summaries a task keeps; the cache is emptied when it is full.
CACHE_CHARS = 1 << 22
#: Code points that are hashed at once.
BLOCK = 1 << 20
_FACTOR = np.uint32(0x01000193)
_TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
_LETTERS = re.compile(r"[A-Za-z]+")


def _places(codes: np.ndarray) -> np.ndarray:
    """Where the rolling hash allows a chunk to end (numbers of code points before the cut)."""
    h, power, width = codes * np.uint32(0x9E3779B1), _FACTOR, 1
    while width < WINDOW:  # the hash of a window from those of its halves
        longer = h.copy()
        longer[width:] += h[:-width] * power
        h, power, width = longer, power * power, width * 2
    h ^= h >> np.uint32(15)
    return np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1


def chunk_ends(text: str) -> list[int]:
    """The ends of the chunks of a text that isn't empty, in order; the last is its length. Whether a
    chunk may end at a place depends on the ``WINDOW`` code points before it alone."""
    n = len(text)
    if n <= LEAST:
        return [n]
    ends, begin = [], 0
    for at in range(0, n, BLOCK):
        left = max(0, at - WINDOW + 1)
        codes = np.frombuffer(text[left : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        with np.errstate(over="ignore"):
            found = _places(codes)
        for p in (found[found > at - left] + left).tolist():
            while p - begin > MOST:
                begin += MOST
                ends.append(begin)
            if p - begin >= LEAST:
                begin = p
                ends.append(p)
    while n - begin > MOST:
        begin += MOST
        ends.append(begin)
    if begin < n:
        ends.append(n)
    return ends


def summary(chunk: str) -> tuple[int, bool, bool]:
    """The number of tokens of a chunk that isn't empty, whether it begins with a letter, and whether
    it ends with one."""
    runs = letters = 0
    for m in _LETTERS.finditer(chunk):
        runs += 1
        letters += m.end() - m.start()
    first, last = chunk[0], chunk[-1]
    return len(chunk) - letters + runs, first.isascii() and first.isalpha(), last.isascii() and last.isalpha()


class Counter:
    """Counts and locates tokens over chunks, with the summaries of the chunks it has seen."""

    def __init__(self, cache_chars: int = CACHE_CHARS) -> None:
        self.known: dict[str, tuple[int, bool, bool]] = {}
        self.room = self.cache_chars = cache_chars
        self.hits = self.misses = 0

    def of(self, chunk: str) -> tuple[int, bool, bool]:
        found = self.known.get(chunk)  # found by hash, then compared whole
        if found is not None:
            self.hits += 1
            return found
        self.misses += 1
        if self.room < len(chunk):
            self.known.clear()
            self.room = self.cache_chars
        self.room -= len(chunk)
        found = self.known[chunk] = summary(chunk)
        return found

    def index(self, text: str) -> TokenIndex:
        return TokenIndex(text, self)


class TokenIndex:
    """Where the tokens of a text begin, by chunk."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text = text
        self.ends = chunk_ends(text) if text else []
        self.starts = [0, *self.ends[:-1]]
        counts, joined, self.joined = [], False, []
        for a, b in zip(self.starts, self.ends, strict=False):
            n, begins, ends = counter.of(text[a:b])
            self.joined.append(joined and begins)  # its first letters belong to a token of the chunk before
            counts.append(n - (joined and begins))
            joined = ends
        self.upto = list(accumulate(counts, initial=0))
        self.n = self.upto[-1]

    def place(self, k: int) -> int:
        """The number of code points of the first ``k`` tokens."""
        if k <= 0:
            return 0
        if k >= self.n:
            return len(self.text)
        i = bisect_right(self.upto, k) - 1  # the chunk in which token k (from 0) begins
        skip = k - self.upto[i] + self.joined[i]
        for j, m in enumerate(_TOKEN.finditer(self.text, self.starts[i], self.ends[i])):
            if j == skip:
                return m.start()
        raise AssertionError("a token lies outside its chunk")


def transform(text: str, index: TokenIndex, draws: tuple[int, int, int, int], plain_from: int, spm_below: int) -> tuple[str, str, int | None, int | None]:
    """``output, form, prefix_chars, middle_chars`` of a text by its four draws."""
    h1, h2, h3, h4 = draws
    if not text or h3 % 100 >= plain_from or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return text, "plain", None, None
    x, y = h1 % (index.n + 1), h2 % (index.n + 1)
    a, b = index.place(min(x, y)), index.place(max(x, y))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", a, b - a


def restore(output: str, form: str) -> str:
    """The text from its output. The markers stand in no part of it, and none can arise across the
    border of a part and a marker."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"no {form} output")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def draws(key: Column) -> list[Column]:
    """Four numbers of 32 bits from a key, the first groups of its SHA-256."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


ADDED = "n_tokens long, fim_form string, fim_text string, prefix_chars long, middle_chars long"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """Adds ``n_tokens``, ``fim_form`` (plain, psm or spm), ``fim_text``, and ``prefix_chars`` and
    ``middle_chars`` (code points; null for plain).

    ``fim_percent`` of 100 texts are rearranged, of these ``spm_percent`` of 100 with the suffix in
    front; which ones, and where they are cut, follows from the SHA-256 of ``seed:id`` (no id: ``seed:``)
    alone. Texts that are null (as empty) or empty, or hold a marker, stay as they are. Repeated rows
    give equal rows; rows that share an id share their draws. An empty table stays empty. Other columns
    pass through; those named as added ones, or ``_fim_draw1`` to ``_fim_draw4``, are replaced."""
    added = T._parse_datatype_string(ADDED)
    names = [f"_fim_draw{i}" for i in range(1, 5)]
    docs = docs.drop(*added.names, *names)
    bounded_batches(docs.sparkSession)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    drawn = docs.withColumns(dict(zip(names, draws(key), strict=True)))
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                at = b.schema.get_field_index(text_col)
                drawn_here = zip(*(b.column(width + i).to_pylist() for i in range(4)), strict=True)
                out: list[tuple] = []
                for text, four in zip(b.column(at).to_pylist(), drawn_here, strict=True):
                    index = counter.index(text or "")
                    changed, form, prefix, middle = transform(text or "", index, four, fim_percent, spm_percent)
                    out.append((index.n, form, changed, prefix, middle))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                new = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *new], [*b.schema.names[:width], *added.names])

    return drawn.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def restored(docs: DataFrame, output_col: str = "fim_text", form_col: str = "fim_form", out_col: str = "restored") -> DataFrame:
    """Adds the text that an output was made of, from the output and its form alone. Null outputs or
    forms give null."""
    docs = docs.drop(out_col)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                output, form = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (output_col, form_col))
                back = [None if o is None or f is None else restore(o, f) for o, f in zip(output, form, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], [*b.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType())]))

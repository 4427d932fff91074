"""Column functions on text, time and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of tokens.
CJK_RUN = "[\\u4e00-\\u9fff]{2,}"
LATIN_WORD = "[a-z][a-z0-9#+._-]+"


def tokenize(text: Column) -> Column:
    """Distinct tokens: CJK runs of two or more, and latin words of two or more in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.concat(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CJK_RUN), F.lit(0)), F.regexp_extract_all(low, F.lit(LATIN_WORD), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of two arrays of distinct tokens; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where either vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.lit(1.0) - dot(a, b) / norms).otherwise(F.lit(1.0))


def heat_decay(heat: Column, since: Column, asof, half_life_h: float = 12.0) -> Column:
    """Heat after halving every ``half_life_h`` hours from ``since`` to ``asof`` (epoch seconds);
    unchanged if ``since`` is later."""
    return F.when(since >= asof, heat).otherwise(heat * F.pow(F.lit(0.5), (F.lit(asof) - since) / F.lit(3600.0 * half_life_h)))


def content_key(text: Column, length: int = 50) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def content_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, length)


def sanitize_name(text: Column, length: int = 60) -> Column:
    """A file name: characters that file systems refuse become underscores; cut to length."""
    return F.substring(F.trim(F.regexp_replace(text, r'[\\/:*?"<>|\n\r\t]', "_")), 1, length)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether the text contains any term, whatever the case; null text: false."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t.lower())
    return out

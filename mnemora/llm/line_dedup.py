"""Line dedup: lines that many documents share go, but in one of them.

Texts are cut at ``\\n``. A line's key is the line without the white space ``[\\x20\\x09-\\x0D]``
at its ends, with A-Z in lower case. Keys of at least ``min_chars`` code points that stand in at
least ``min_docs`` documents lose all their lines, except in the document with the largest id.

Keys move as 16-byte digests. Documents are counted by key after (key, document) pairs have been
made one, both steps summed before they are shuffled, so a line that a third of all documents
share arrives as one row a task. Lines meet the keys to drop by a join that leaves a row a dropped
line (document and position). A text moves only if it may have such a line, which a bitmap of
fixed size tells; it is then put together from the positions that stay.

Only DataFrame functions: no Python worker runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .ngram_join import split_by_keys

#: The white space that a key has none of at its ends.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped, and lower case for A-Z."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _held(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` loops over it."""
    return F.transform(F.array(value), use)[0]


def _kept(text: Column, gone: Column) -> Column:
    """The text without the lines at the (ascending) positions ``gone``; linear in both."""

    def put_together(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: lines[i]), "\n")

    return _held(_lines(text), put_together)


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept_text") -> DataFrame:
    """Adds ``n_lines`` (long, before dropping), ``n_dropped`` (long) and ``out_col``, the text
    without the dropped lines.

    A document is all rows of one id; rows without id are a document for each text, smaller than all
    with an id (among them, the one with the greatest digest counts as largest). Null and empty texts
    have one empty line, and stay empty. Repeated rows give equal rows. A text all of whose lines go
    is empty. An empty table stays empty. Other columns pass through; those named as added ones are
    replaced. Columns ``_dedup_row`` and ``_dedup_gone`` must not be there."""
    docs = docs.drop("n_lines", "n_dropped", out_col)
    text, own = F.col(text_col), F.col(id_col).cast("long")
    body = F.coalesce(text, F.lit(""))
    # a row's name; rows that share it have the same id and text
    named = docs.withColumn("_dedup_row", F.unhex(F.md5(F.concat_ws(":", F.coalesce(own.cast("string"), F.lit("-")), body))))
    doc = F.struct(own.alias("id"), F.when(own.isNull(), F.md5(body)).alias("anon"))
    keyed = named.select(doc.alias("doc"), "_dedup_row", F.posexplode(F.transform(_lines(text), line_key)).alias("pos", "key"))
    long = keyed.filter(F.length("key") >= min_chars).select("doc", "_dedup_row", "pos", F.unhex(F.md5("key")).alias("h"))

    shared = long.select("h", "doc").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))
    shared = stash(shared.filter(F.col("docs") >= min_docs).select("h", "keeper"), "shared-lines")
    _, maybe = split_by_keys(long, "h", shared.select("h"))
    lost = maybe.join(shared, "h").filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    gone = stash(lost.groupBy("_dedup_row").agg(F.sort_array(F.collect_set("pos")).alias("_dedup_gone")), "dropped-lines")

    apart, rest = split_by_keys(named, "_dedup_row", gone.select("_dedup_row"))
    met = rest.join(gone, "_dedup_row", "left").unionByName(apart.withColumn("_dedup_gone", F.lit(None).cast("array<int>")))
    return met.select(
        *[F.col(c) for c in docs.columns],
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.when(F.col("_dedup_gone").isNull(), 0).otherwise(F.size("_dedup_gone")).cast("long").alias("n_dropped"),
        F.when(F.col("_dedup_gone").isNull(), body).otherwise(_kept(text, F.col("_dedup_gone"))).alias(out_col),
    )

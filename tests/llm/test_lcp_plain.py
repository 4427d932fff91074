"""Fingerprints against a parse that goes symbol by symbol, and the registered query against it."""

import hashlib

import pytest

from mnemora.llm import lcp, queries

M = 0xFFFFFFFF


def mix(h):
    h ^= h >> 15
    h = h * 0x9E3779B1 & M
    h ^= h >> 13
    h = h * 0x85EBCA77 & M
    return h ^ h >> 16


def toss(x, left):
    differ = x ^ left or 1
    bit = (differ & -differ).bit_length() - 1
    return 2 * bit + (x >> bit & 1)


def parse(symbols):
    """The names of the next level, one phrase after the other."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    s = [x if n == 1 else mix((x + n * 0xC2B2AE3D) & M) for x, n in runs]
    labels = [toss(x, s[i - 1] if i else ~x & M) for i, x in enumerate(s)]
    for _ in range(lcp.TOSSES - 1):
        labels = [toss(x, labels[i - 1] if i else 255 ^ x) for i, x in enumerate(labels)]
    starts = [i for i in range(len(s)) if i == 0 or (i + 1 < len(s) and labels[i - 1] > labels[i] < labels[i + 1])]
    names = []
    for a, b in zip(starts, starts[1:] + [len(s)], strict=True):
        names.append(mix(sum((mix((i % 256 + 1) * 0xC2B2AE3D & M) | 1) * (x + 0xC2B2AE3D) for i, x in enumerate(s[a:b])) & M))
    return names


def plain(text):
    if not text:
        return ""
    levels, names = [], [ord(c) for c in text]
    for level in range(1, lcp.LEVEL + 1):
        names = parse(names)
        if level > 1 and len(names) < lcp.ENOUGH:
            break
        levels.append((level, sorted({mix((x + int(lcp._B)) & M) for x in names})))
    return "|".join(f"{lv:x}:" + "".join(f"{n:08x}" for n in ns[:keep]) for (lv, ns), keep in zip(reversed(levels[-2:]), (lcp.KEEP, lcp.KEEP // 2)))


@pytest.mark.parametrize("text", ["", "a", "aa", "ab", "The cat sat on the mat.", "aaaa bbbb " * 30, "Löwe 日本 😀 " * 9, "x" * 700, "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))])
def test_fingerprint_matches_the_plain_parse(text):
    assert next(lcp.fingerprints([text])) == plain(text)


def test_query_matches_the_plain_parse(spark, sf_dir):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in queries.op7_lcp_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1], strict=True):
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        if len(t) < 3000:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (plain(t), plain(e))
            assert (r["near_edited"], r["near_next"]) == (lcp.likeness(plain(t), plain(e)), lcp.likeness(plain(t), plain(n)))


def test_short_texts_keep_a_likeness_to_their_edited_text(spark, sf_dir):
    near = [lcp.likeness(*lcp.fingerprints([t, lcp.edited(t, "Quite another line, of some length, that has nothing to do with it.")])) for t in (f"A short line number {i} of words that end soon{'.' * (i % 3)}" for i in range(200))]
    assert sum(x > 0 for x in near) > 190 and 0.15 < sum(near) / len(near) < 0.6


def test_rows_of_one_id_and_without_id_follow_by_hash(spark):
    from pyspark.sql import functions as F

    rows = [(5 if i % 3 else None if i % 2 else i, f"text {i} " + "w" * (i % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [(r["doc_id"], r["text"]) for r in df.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()]
    want = sorted((str(i), hashlib.sha256(lcp.edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in lcp.compare_with_next(df, parts=3).collect()) == want

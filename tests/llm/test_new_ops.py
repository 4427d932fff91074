"""Runs, fill-in-middle and line dedup against brute-force versions, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mnemora.llm import fim, line_dedup, periodic, queries

from .test_llm import empty_docs, odd_docs, table

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def documents(spark, folder, rows):
    """A folder with a documents table of these (doc_id, text) rows."""
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (4, "one"), (None, "one two one two"), (5, "x" * 50000 + " " + "y z " * 9000), (6, "日本 <P> a"), (7, "\n\n"), (None, None), (70, "né\x1cé a\x85b c\xa0d")]


# ---- 11 runs


def brute_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, depth):
    """Words with runs inside runs."""
    if depth == 0:
        return [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randint(0, 8))]
    x = repetitive(rng, depth - 1)
    return (x * rng.randint(1, 7) + repetitive(rng, depth - 1) + x[: rng.randint(0, len(x))] * rng.randint(1, 5))[:1500]


def test_runs_match_brute_force():
    rng = random.Random(7)
    for _ in range(120):
        texts = [repetitive(rng, rng.randint(0, 4)) for _ in range(rng.randint(1, 6))]
        assert list(periodic.runs_of(texts)) == [brute_runs(t) for t in texts]


def test_runs_of_very_long_texts():
    assert list(periodic.runs_of([[b"a"] * 300_000])) == [[(0, 300_000, 1)]]
    block = [b"%d" % i for i in range(20_000)]
    assert list(periodic.runs_of([[b"x"], block * 5 + [b"0", b"y"], []])) == [[], [(0, 100_001, 20_000)], []]


def test_range_successor():
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.permutation(700)
    matrix = periodic.WaveletMatrix(values, 10)
    lo = rng.integers(0, 700, 500)
    hi = np.minimum(700, lo + rng.integers(0, 80, 500))
    bound = rng.integers(0, 700, 500)
    want = [min((v for v in values[a:b] if v >= p), default=-1) for a, b, p in zip(lo, hi, bound, strict=True)]
    assert matrix.successor(lo, hi, bound).tolist() == want


def plain_op11(doc_id, text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone).decode()),
    )


def check_op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = queries.op11_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [plain_op11(r["doc_id"], r["text"]) for r in docs]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    return want


def test_op11_matches_brute_force(spark, sf_dir):
    want = check_op11(spark, sf_dir)
    assert sum(r[1] > 0 for r in want) > 3


def test_op11_on_odd_rows(spark, tmp_path):
    planted = [i for i in range(200, 500) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = ODD + [(i, " ".join(f"w{k}" for k in range(i))) for i in planted[:8]] + [(planted[9], "  "), (planted[9], None)]
    check_op11(spark, documents(spark, tmp_path / "a", rows))
    assert queries.op11_periodic_runs(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_runs_keep_other_columns(spark):
    docs = table(spark, [(1, "a a a a a a b", "en", "s", 1)]).withColumn("runs", F.lit("old")).withColumn("collapsed", F.lit(1))
    r = periodic.periodic_runs(docs).first()
    assert (r["lang"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == ("en", 7, [(0, 6, 1)], "a b")
    assert periodic.periodic_runs(empty_docs(spark)).count() == 0 and periodic.periodic_runs(odd_docs(spark)).count() == 7


# ---- 12 fill in middle


def test_counts_and_places_match_a_plain_scan():
    rng = random.Random(4)
    counter = fim.Counter(cache_chars=50_000)
    passage = "".join(rng.choices("abc de.\n", k=4000))
    for k in range(400):
        s = "".join(rng.choices(["ab", "C", "é", "1", " ", "word", "\n", "日", "<P", ">"], k=rng.randint(0, rng.choice([5, 50, 800]))))
        s = s + passage[rng.randrange(300) :] + "q" * rng.randint(0, 5000) + s if k % 3 == 0 else s
        index, tokens = counter.index(s), re.findall(r"[A-Za-z]+|[^A-Za-z]", s)
        assert index.n == len(tokens) and (not s or index.ends[-1] == len(s))
        assert all(index.place(i) == len("".join(tokens[:i])) for i in {0, len(tokens), *(rng.randint(0, len(tokens)) for _ in range(5))})
    assert counter.hits > counter.misses  # passages that texts share are cut alike


def test_chunks_dont_depend_on_blocks(monkeypatch):
    s = "".join(random.Random(1).choices("abcdefgh ", k=30_000)) + "z" * 9000
    whole = fim.chunk_ends(s)
    monkeypatch.setattr(fim, "BLOCK", 1000)
    assert fim.chunk_ends(s) == whole and max(b - a for a, b in zip([0, *whole], whole, strict=False)) <= fim.MOST


@pytest.mark.parametrize("text", ["", "a", "<", "<<S", "M><P", "x<S y>z", "日本"])
def test_restores_at_every_cut(text):
    index = fim.Counter().index(text)
    for h4 in (0, 99):
        for x in range(index.n + 1):
            for y in range(index.n + 1):
                out, form, prefix, middle = fim.transform(text, index, (x, y, 0, h4), 90, 20)
                assert fim.restore(out, form) == text and (form == "plain") == (text == "")


def plain_op12(doc_id, text):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(w), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, len(w), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_op12_on_odd_rows(spark, tmp_path):
    rows = ODD + [(i, f"doc {i}, with <b>text</b>\nand more {i * 'x'}") for i in range(100, 160)]
    got = queries.op12_fill_in_middle(spark, documents(spark, tmp_path / "a", rows))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_op12(*r) for r in rows), key=str)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert queries.op12_fill_in_middle(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_fim_keeps_other_columns(spark):
    docs = odd_docs(spark).withColumn("fim_form", F.lit("old")).withColumn("_fim_draw1", F.lit("old"))
    rows = fim.restored(fim.fill_in_middle(docs, fim_percent=100, spm_percent=50)).collect()
    assert len(rows) == 7 and all(r["restored"] == (r["text"] or "") for r in rows) and rows[0].asDict().keys() >= {"lang", "source", "mix_slot", "n_tokens"}


# ---- 13 line dedup


def plain_op13(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held: dict[str, set] = {}
    name = lambda i, t: (0, hashlib.md5((t or "").encode()).hexdigest()) if i is None else (1, i)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(name(i, t))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 40 or len(held[key(x)]) < 5 or name(i, t) == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return out


def shared_lines(seed):
    rng = random.Random(seed)
    common = [f"{'  ' * (k % 2)}Line {k} that many documents share, licence and all of it{'É' * (k % 3)}" for k in range(12)] + ["x" * 39, "y" * 40, "日" * 40]
    rows = []
    for i in range(120):
        lines = [rng.choice([lambda: f"own line {rng.random()} of a document, long enough to count", lambda: rng.choice(common), lambda: rng.choice(common).upper() + "\t\r", lambda: ""])() for _ in range(rng.randint(0, 14))]
        rows.append((i // 2 if i < 20 else None if i < 40 else i, "\n".join(lines)))
    return rows + rows[:25]


def test_op13_matches_plain_version(spark, tmp_path):
    rows = ODD + shared_lines(3) + [(1000 + i, "\n".join(["the same line in all of these documents, long"] * (1 + i % 3))) for i in range(40)]
    got = queries.op13_line_dedup(spark, documents(spark, tmp_path / "a", rows))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = plain_op13(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 100
    assert queries.op13_line_dedup(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_line_dedup_is_linear_in_long_texts(spark):
    lines = [f"line number {k} that all five documents have in common" for k in range(60_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines), "x") for i in range(5)], "doc_id long, text string, n_dropped string")
    rows = {r["doc_id"]: (r["n_lines"], r["n_dropped"], len(r["kept_text"])) for r in line_dedup.drop_shared_lines(docs).collect()}
    assert rows[4] == (60_000, 0, len("\n".join(lines))) and all(rows[i] == (60_000, 60_000, 0) for i in range(4))


def test_line_dedup_uses_no_python_worker(spark, sf_dir):
    plan = queries.op13_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)


# ---- language ID: letters, and messages over blocks


def test_letters_by_category():
    from mnemora.llm.langid_crf import letters

    assert [letters(w) for w in ("Ab1c", "½", "²", "①", "Ⅷ", "_", "क्", "é", "éx", "́", "12", "don't")] == ["abc", "", "", "", "", "", "क्", "é", "éx", "", "", "dont"]


def test_texts_without_letters_are_und(spark):
    from mnemora.llm import langid_crf

    model = langid_crf.train(table(spark, [(i, ["the cat is here", "die katze ist hier"][i % 2], ["en", "de"][i % 2], "s", 1) for i in range(40)]))
    got = langid_crf.predict(table(spark, [(1, "½ ² ①", None, None, 0), (2, "½ cat", None, None, 0), (3, "́ _", None, None, 0)]), model).collect()
    assert {r["doc_id"]: r["lang_found"]["lang"] for r in got} == {1: "und", 2: "en", 3: "und"}


def test_blocks_of_a_long_text_see_each_other(monkeypatch):
    import numpy as np

    from mnemora.llm import langid_crf

    rng = random.Random(8)
    vocab = {"en": ["the", "cat", "is", "here", "now"], "de": ["die", "katze", "ist", "hier", "jetzt"]}
    model = langid_crf.fit([" ".join(rng.choices(vocab[k], k=12)) for k in ("en", "de") * 60], ["en", "de"] * 60)
    texts = [" ".join(rng.choices(vocab["en"] + ["x"], k=n) + rng.choices(vocab["de"], k=n)) for n in (1, 4, 9, 30, 64, 65, 333)]
    whole, parts = [], []
    for chain, out in ((10**6, whole), (7, parts)):
        monkeypatch.setattr(langid_crf, "CHAIN", chain)
        out += [p for _, p in langid_crf.Tagger(model).tag(texts)]
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(whole, parts, strict=True))

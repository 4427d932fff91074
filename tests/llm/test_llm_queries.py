"""The registered queries: their SQL twins, and the pipeline against plain Python."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from mnemora.llm import langid_crf, queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(None if v is None or str(v) in ("<NA>", "nan") else (int(v) if isinstance(v, float) and v == int(v) else v) for v in r) for r in pdf.values.tolist()), key=str)


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, key):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[key](spark, sf_dir).toPandas(), c.execute(queries.ORACLE_SQL[key]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names


def test_pipeline(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    from mnemora.llm import byte_bpe, pfair

    from .test_llm import brute_classes

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {i for i, (_, c) in brute_classes(docs, 5, 80, 100).items() if i == c and any(ch.isalpha() for ch in docs[i])}
    raw = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(raw), special_tokens={})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(tk.encode_ordinary(docs[i])) for i in kept}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in rows:
        ids = tk.encode_ordinary(docs[r["doc_id"]])
        assert r["ids_sha256"] == digest(np.array(ids, "<u4").tobytes()) and r["text_sha256"] == digest(docs[r["doc_id"]].encode())
    # the rows keep the order of the mix of what the stages before left
    left = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id").isin(list(kept))).select(*corpus_pipeline.COLUMNS)
    slot = {r["doc_id"]: r["mix_slot"] for r in pfair.pfair_mix(left).collect()}
    assert sorted(r["mix_position"] for r in rows) == list(range(len(rows)))
    order = [slot[r["doc_id"]] for r in sorted(rows, key=lambda r: r["mix_position"])]
    assert order == sorted(order) and len(set(order)) > 5


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, junk and columns that clash with those that stages add."""
    words = "the cat is here and it was not seen by any of them until now".split()
    texts = [(i, " ".join(words[i % 5 :] + words[: i % 7] + [chr(97 + k) * (1 + i % 4) for k in range(i % 11)]), "en") for i in range(30)]
    junk = [(100, "½ ² ① 123 !!", "en"), (101, None, "en"), (102, "", None), (None, "  \n", None)]
    rows = [(i, t, lang, "s" if i % 3 else None, 1, 7, "x", "y") for i, t, lang in texts] + [(i, t, lang, "s", None, None, None, None) for i, t, lang in junk]
    rows += rows[:3] + [(None, "a text of its own without an id, so it stays", None, "s", 1, 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mix_position int, ids string, class string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got]
    assert not {100, 101, 102} & set(ids) and None in ids and len(ids) == len(set(ids)) and sorted(r["mix_position"] for r in got) == list(range(len(got)))
    spark.createDataFrame([], docs.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_language_threshold_comes_from_all_rows(spark):
    """The least certain text that is rightly labelled sets the threshold, whatever its id; another like it stays."""
    en, de = "the cat and the dog ran with this".split(), "der hund und die katze nicht mit das".split()
    rows = [(i, " ".join((en, de)[i % 2][i % 3 :]), ("en", "de")[i % 2], "s", 1) for i in range(240)]
    mixed = [(1001 + i, " ".join(en + de[:6]), "en", "s", 1) for i in range(2)] + [(2000, " ".join(en[::-1] + de[5::-1]), None, "s", 1)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()} == {r[0] for r in rows + mixed}


def test_language_model_learns_every_word(spark):
    """All words of all labelled rows are counted, however long texts are, and in any layout the model is the same."""
    rng = random.Random(5)
    stems = {"en": "the cat and dog ran with this".split(), "de": "der hund und die katze nicht".split()}
    rows = [(i, " ".join(rng.choices(stems[x], k=rng.choice([1, 50, 900]))) + f" only{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} 12 d'é-1", x) for i in range(300) for x in (("en", "de")[i % 2],)]
    rows += [(None, "ohne", "de"), (900, None, "de"), (901, "12", "fr"), (902, "unlabelled", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {(r["form"], r["lang"]): r["n"] for r in langid_crf.count_words(docs, "text", "lang").groupBy("form", "lang").agg(F.sum("n").alias("n")).collect()}
    assert counts == Counter((f, x) for _, t, x in rows if t and x for f in map(langid_crf.letters, t.split()) if f)
    a, b = langid_crf.train_whole(docs.repartition(1), epochs=3), langid_crf.train_whole(docs.orderBy(F.desc("text")).repartition(5), epochs=3)
    assert a.langs == b.langs == ["de", "en"] and np.array_equal(a.grams, b.grams) and np.array_equal(a.lexical, b.lexical) and np.array_equal(a.trans, b.trans)
    # words that one text has, at its end, are known by their languages
    seen = langid_crf.predict(docs.filter("doc_id < 300").withColumn("text", F.regexp_extract("text", "only[a-z]+", 0)), langid_crf.train_whole(docs)).collect()
    assert sum(r["lang_found"]["lang"] == r["lang"] for r in seen) == 300
    assert langid_crf.train_whole(docs.filter("lang is null")) is None


def test_gradient_of_whole_training(spark):
    """Against a plain logistic regression."""
    forms = {("cat", "en"): 5, ("cat", "de"): 1, ("hund", "de"): 3, ("a", "en"): 2}
    counts = spark.createDataFrame([(f, x, n) for (f, x), n in forms.items()] + [("cat", "en", 2)], "form string, lang string, n long")
    words = langid_crf.vocabulary(counts, ["de", "en"]).cache()
    theta = np.random.default_rng(3).normal(size=(2 << langid_crf.HASH_BITS, 2)).astype(np.float32).astype(np.float64)
    got = langid_crf.gradient(words, theta)
    want = np.zeros_like(theta)
    for f, uses in (("cat", [1, 7]), ("hund", [3, 0]), ("a", [0, 2])):
        gram, _, whole = langid_crf._features([f])
        at = [*gram.tolist(), (1 << langid_crf.HASH_BITS) + int(langid_crf._bucket(whole)[0])]
        p = np.exp(theta[at].sum(0))
        for i in at:
            want[i] += p / p.sum() * sum(uses) - uses
    assert np.abs(want).max() > 0.1 and np.allclose(got, want, atol=1e-4)


def test_op2_matches_the_library(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    from mnemora.llm import byte_bpe

    raw = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(raw), special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tk.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_counts_leave_a_worker_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from mnemora.llm import common

    docs = spark.createDataFrame([("a", "en")], "text string, lang string")
    held = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: held.append(run))
    langid_crf.count_words(docs, "text", "lang")
    names = ["w" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(names), names[7], names[7]]), pa.array(["en", "en", "de"])], ["text", "lang"])
    out = list(held[0](iter([batch])))
    assert max(b.num_rows for b in out) <= common.BATCH_ROWS
    rows = [(r["form"], r["lang"], r["n"]) for b in out for r in b.to_pylist()]
    assert sorted(rows) == sorted([*((w, "en", 1 + (w == names[7])) for w in names), (names[7], "de", 1)])
    other = spark.newSession()
    common.bounded_batches(other)
    assert int(other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20


def test_word_cache_is_bounded_and_keeps_frequent_words():
    import base64

    from mnemora.llm import byte_bpe

    raw = b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256))
    small = byte_bpe.Encoder(raw, r"\w+|\W", cache_words=40)
    for i in range(1000):
        text = f"often w{i} often"
        assert np.frombuffer(small.packed(text), "<u4").tolist() == list(text.encode())
        new, old = small.halves
        assert len(new) + len(old) <= 40 and "often" in new | old

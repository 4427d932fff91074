"""The ten operators against brute-force versions, round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import byte_bpe, chat_format, ext_hash, html_mss, langid_crf, lcp, ngram_join, pfair, queries, topk_impact, warc
from mnemora.llm.common import shared_path
from mnemora.llm.graph import components

P = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mix_slot int, ids string"


def table(spark, rows, schema=DOCS):
    """Documents with two more columns whose names clash with those that operators add."""
    return spark.createDataFrame([(*r, None, None)[:7] if len(r) == 5 else r for r in rows], schema)


def odd_docs(spark):
    return table(spark, [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n", "en", None, 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "one", "de", "b", 3), (5, "x" * 50000 + " " + "y z " * 3000, "en", "b", 1)])


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 n-gram join


def words_of(text):
    return (text or "").encode().lower().split()


def brute_classes(docs, q, num, den):
    """By all pairs; docs: {id: text}."""
    sets = {}
    for i, t in docs.items():
        w = words_of(t)
        sets[i] = {tuple(w[k : k + q]) for k in range(len(w) - q + 1)} if len(w) >= q else ({tuple(w)} if w else set())
    comp = {i: i for i in docs}
    change = True
    ids = sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while change:
        change = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                change = True
    return {i: (len(sets[i]), comp[i]) for i in docs}


def near_copies(seed, bases=6, copies=18):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs, n = {}, 0
    passage = rng.choices(vocab, k=30)
    for _ in range(bases):
        base = rng.choices(vocab, k=rng.choice([2, 8, 25, 60, 120])) + (passage if rng.random() < 0.5 else [])
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs[n] = " ".join(w)
            n += 1
    return docs


@pytest.mark.parametrize("q,num,den,seed", [(3, 90, 100, 1), (5, 80, 100, 2)])
def test_join_matches_all_pairs(spark, q, num, den, seed):
    docs = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(table(spark, [(i, t, "en", "s", 1) for i, t in docs.items()]), q, num, den).collect()}
    assert got == brute_classes(docs, q, num, den)
    assert len({c for _, c in got.values()}) < len(docs)


def test_join_edge_cases(spark):
    got = ngram_join.jaccard_classes(odd_docs(spark), 3, 90, 100).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] != 5) == [(-1, 1, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4)]
    assert ngram_join.jaccard_classes(empty_docs(spark)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200)]
    comp = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in comp.items() if k != 200}


# ---- 2 BPE


def test_bpe_matches_the_library(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    raw = open(path, "rb").read()
    ranks = byte_bpe.parse_ranks(raw)
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    bits = ["a", "aa", " ", "the", "\n", "  ", "é", "日本", "123", "'s", "ing", "ñ", "!!", "<|endoftext|>", " ", "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(150)] + ["ab" * 20000, None, ""]
    held = byte_bpe.read_ranks(spark, path)
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = byte_bpe.decode(byte_bpe.encode(df, held, P.PATTERN), held).collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert byte_bpe.ids_array(bytes(r["ids"])) == tk.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    assert len(rows) == len(texts) and byte_bpe.encode(empty_docs(spark), held, P.PATTERN).count() == 0


# ---- 3 top-k


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) / 4
    x[50:80] = x[50]  # ties
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] * 16, 1), (None, [0.0] * 16, 1), (1004, [], 1), (1050, [0.5, 0.5], 1)]
    items = topk_impact.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"))
    got = topk_impact.top_k(items, items.filter("id % 50 = 0"), 5, shard_rows=100, block_rows=4).collect()
    v = np.floor(256 * x).astype(int)
    want = set()
    for q in range(0, 600, 50):
        s = v @ v[q]
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:5]
        want |= {(q, k + 1, i, int(s[i])) for k, i in enumerate(order)}
    assert sorted(tuple(r) for r in got) == sorted(want)
    twice = items.unionByName(items.filter("id % 100 = 0")).unionByName(items.filter("id = 100").selectExpr("id", "transform(v, x -> -x) as v"))
    again = topk_impact.top_k(twice, items.filter("id % 50 = 0 and id <> 100").unionByName(items.filter("id = 0")), 5, shard_rows=100).filter("vec_id <> 100").collect()
    assert {tuple(r)[:1] + tuple(r)[2:] for r in again} <= {(q, i, int(v[i] @ v[q])) for q in range(0, 600, 50) for i in range(600)}
    assert len({(r["query_id"], r["rank"]) for r in again}) == len(again) == len({(r["query_id"], r["vec_id"]) for r in again})
    assert topk_impact.top_k(items.limit(0), items.limit(0)).count() == 0


# ---- 4 WARC


def test_warc_round_trip_and_lookup(spark):
    rng = random.Random(3)
    long_ = "".join(rng.choices("abc <>\r\n", k=400))
    rows = [(i, f"https://www.Site{i % 7}.example.com/p?q={i % 5}", long_ + str(i % 9) if i % 3 else f"short{i % 2}") for i in range(120)] + [(500, None, None), (501, "no url\nhere", "é" * 60), (502, "", "é" * 60), (None, "http://a.b/c", "z" * 300)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = shared_path(spark, "warc")
    captures = warc.write_archives(pages, folder)
    directory = warc.write_index(captures, folder, parts=3)
    got = warc.read_records(captures, folder).collect()
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for r in got:
        h = next(h for i, _, h in rows if i == r["page_id"]) or ""
        raw = h.encode()
        revisit = r["page_id"] is not None and len(raw) >= 100 and first[h] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h]) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    keys = spark.createDataFrame([("https://www.site3.example.com/p?q=1",), ("https://nowhere.org/",)], "url string").select(warc.url_key(F.col("url")).alias("urlkey"))
    found = {r["page_id"] for r in warc.read_records(warc.lookup(directory, folder, keys), folder).collect()}
    assert found == {i for i, u, _ in rows if u and u.lower() == "https://www.site3.example.com/p?q=1"} and found
    none = pages.limit(0)
    assert warc.read_records(warc.lookup(warc.write_index(warc.write_archives(none, folder), folder, 2), folder, keys), folder).count() == 0


# ---- 5 language


def test_language_on_held_out_documents(spark, sf_dir):
    got = queries.op5_langid_crf(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").filter("held_out and length(text) > 60")
    n, ok = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 20 and ok / n > 0.95


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    scores, trans, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, pairs, _ = langid_crf.forward_backward(scores, np.ones((1, 4), bool), trans, start)
    z, want, want_pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(start[path[0]] + sum(scores[0, i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        z += w
        for i, y in enumerate(path):
            want[i, y] += w
        for a, b in zip(path, path[1:]):
            want_pairs[a, b] += w
    assert np.allclose(p[0], want / z) and np.allclose(pairs, want_pairs / z)


def test_words_of_switched_text(spark):
    en, de = "the cat and the dog ran with this", "der hund und die katze nicht mit das"
    rows = [(i, " ".join(random.Random(i).choices((en if i % 2 else de).split(), k=30)), "en" if i % 2 else "de", "s", 1) for i in range(200)]
    model = langid_crf.train(table(spark, rows))
    got = langid_crf.label_words(table(spark, [(1, f"{en} 123 {de}", None, None, 0), (2, None, None, None, 0), (3, "12 !", None, None, 0)]), model)
    words = {r["doc_id"]: r["words"] for r in got.collect()}
    assert [w["lang"] for w in words[1]] == ["en"] * 8 + ["de"] * 8 and words[2] == [] and words[3] == []
    out = {r["doc_id"]: r["lang_found"] for r in langid_crf.predict(odd_docs(spark).filter("doc_id is not null"), model).collect()}
    assert out[1]["lang"] == "und" and out[2]["score"] == 0.0 and out[5]["lang"] in ("en", "de")
    assert langid_crf.train(empty_docs(spark)) is None and langid_crf.predict(empty_docs(spark), None).count() == 0


# ---- 6 chat


def test_chat_round_trip(spark):
    odd = ["", None, "a", "\\b \\l <turn>### x: y</turn>\n", "#" * 3, "\\", "née 😀 " * 400, "a: b"]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", "a:b#<", None])]
    conv = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    got = {r["conv_id"]: r for r in chat_format.parse(chat_format.format_conversations(conv)).collect()}
    for c in range(12):
        own = [(r or "", t or "") for cc, _, r, t in rows if cc == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == own
        assert got[c]["loss_text"] == "".join(t for r, t in own if r == "assistant")
    assert chat_format.format_conversations(conv.limit(0)).count() == 0
    log = chat_format.conversation_events(conv)
    kinds = {r["kind"]: r["n"] for r in log.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["edit"] and kinds["regenerate"] == 12 and log.count() > log.dropDuplicates(["conv_id", "seq"]).count()
    lone = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "assistant", None), (None, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert sorted(len(r["turns"]) for r in chat_format.parse(chat_format.format_conversations(lone)).collect()) == [1, 1, 2]


def test_events_are_folded(spark):
    ev = [
        (1, 1, "open", 0, "user", "hi"), (1, 2, "open", 1, "assistant", ""), (1, 3, "delta", 1, None, "bad "), (1, 4, "delta", 1, None, "answer"),
        (1, 5, "open", 2, "user", "hm"), (1, 6, "regenerate", 1, None, None), (1, 7, "delta", 1, None, "good "), (1, 8, "delta", 1, None, "answer"),
        (1, 9, "edit", 0, None, "hello"), (1, 10, "delta", 0, None, "!"), (1, 10, "delta", 0, None, "!"), (1, 8, "delta", 1, None, "answer"), (1, 11, "open", 3, "user", "thanks"),
    ]
    df = spark.createDataFrame(ev, "conv_id long, seq long, kind string, pos long, role string, text string")
    got = [(r["pos"], r["role"], r["text"]) for r in chat_format.fold_events(df).orderBy("pos").collect()]
    assert got == [(0, "user", "hello!"), (1, "assistant", "good answer"), (3, "user", "thanks")]


# ---- 7 fingerprints


def test_fingerprints_do_not_depend_on_neighbours_or_offset():
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdefgh ", k=rng.choice([0, 1, 2, 30, 900]))) for _ in range(60)] + ["a" * 5000, "ab" * 2500]
    together = list(lcp.fingerprints(texts))
    assert together == [next(lcp.fingerprints([t])) for t in texts]
    t = "".join(rng.choices("abcdefghij", k=4000))
    a, b, c = lcp.fingerprints([t, "zz" + t + "yyy", "".join(rng.choices("abcdefghij", k=4000))])
    assert lcp.likeness(a, b) > 0.8 and lcp.likeness(a, c) < 0.1 and lcp.likeness(a, a) == 1.0


def test_edited_texts_follow_the_next_document(spark):
    docs = [(7, "abc" * 30), (3, "de" * 41), (9, ""), (5, None), (1, "x"), (20, "long text " * 500)]
    got = {r["doc_id"]: r for r in lcp.compare_with_next(table(spark, [(i, t, "en", "s", 1) for i, t in docs])).collect()}
    order = sorted(docs, reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = lcp.edited(t or "", n or "")
        assert got[i]["n_chars"] == len(t or "") and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["edited_fingerprint"] == next(lcp.fingerprints([e]))
    assert lcp.compare_with_next(empty_docs(spark)).count() == 0
    assert lcp.compare_with_next(odd_docs(spark)).count() == 7
    assert lcp.fingerprint(odd_docs(spark), out_col="ids").filter("ids is null").count() == 0


# ---- 8 HTML


def test_pages(spark):
    body = "<article><h1>Title &amp; more</h1><p>First <b>bo</b>ld&nbsp;text<br>and\n more.</p><p>Second paragraph of it.</p></article>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><div class='ad'>Buy this thing now please</div>{body}<div id='comments'><p>I liked it very much indeed</p></div><footer>c</footer></body></html>"
    pages = spark.createDataFrame([(i, "u", page, 1) for i in range(20)] + [(50, None, None, 1), (51, "u", "", 1), (52, "u", "<p", 1), (53, "u", "<script>x", 1), (54, "u", "plain words", 1)], "page_id long, url string, html string, text int")
    w = html_mss.learn(pages)
    got = {r["page_id"]: r["text"] for r in html_mss.extract_text(pages, w).collect()}
    assert got[0] == "Title & more First bold text and more. Second paragraph of it."
    assert [got[i] for i in range(50, 55)] == ["", "", "", "", "plain words"]
    assert html_mss.learn(pages.limit(0)) == {} and html_mss.extract_text(pages.limit(0), {}).count() == 0


def test_best_stretch_is_the_best():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-3, -1, 1, 2]) for _ in range(rng.randint(0, 12))]
        a, b = html_mss.best_stretch(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best


# ---- 9 sharding


@pytest.mark.parametrize("limit", [100, 700, 100000])
def test_shards_match_plain_splitting(spark, limit):
    rng = random.Random(limit)
    docs = [(i, "x" * rng.randint(0, 60)) for i in range(300)] + [(1000, "y" * 150)]
    got = ext_hash.extendible_shards(table(spark, [(i, t, "en", "s", 1) for i, t in docs]), limit_bytes=limit, step=20)
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in docs}
    sizes = dict((i, len(t)) for i, t in docs)

    def split(ids, prefix):
        if sum(sizes[i] for i in ids) <= limit or len(prefix) == 60:
            return {i: prefix for i in ids}
        out = {}
        for b in "01":
            out |= split([i for i in ids if bits[i][len(prefix)] == b], prefix + b)
        return out

    rows = got.collect()
    want = split(list(bits), "")
    assert {r["doc_id"]: r["shard"].split("+")[0] for r in rows} == want and len(rows) == len(docs)
    assert all(r["shard_bytes"] <= limit or r["bytes"] > limit for r in rows)
    if limit == 700:
        deep = max(r["depth"] for r in rows)
        found = got.select("depth", F.expr("if(depth = 0, 0L, cast(conv(shard, 2, 10) as bigint))").alias("node")).distinct()
        entries = [r["entry"] for r in ext_hash.directory(found, deep).collect()]
        assert len(entries) == len(set(entries)) <= 2**deep and set(entries) >= {int(bits[i][:deep], 2) for i in bits}


def test_shards_of_odd_tables(spark):
    same = table(spark, [(1, "x" * 40, "en", "s", 1)] * 20)
    rows = ext_hash.extendible_shards(same, limit_bytes=100).collect()
    assert len(rows) == 20 and all(r["shard_bytes"] <= 100 and not r["overflow"] for r in rows)
    assert ext_hash.extendible_shards(odd_docs(spark)).count() == 7 and ext_hash.extendible_shards(empty_docs(spark)).count() == 0


def test_shards_are_written(spark, tmp_path):
    docs = table(spark, [(i, "x" * 30, "en", "s", 1) for i in range(50)] + [(None, "y" * 30, "en", "s", 1), (3, "z" * 30, None, None, 1), (3, "z" * 30, None, None, 1)])
    ext_hash.write_shards(docs, str(tmp_path / "out"), limit_bytes=400)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect())) and back.select("shard").distinct().count() > 3


# ---- 10 mixing


def plain_edf(windows):
    """Slots by earliest deadline among released blocks; windows: {source: [(release, deadline)]}."""
    at, out = dict.fromkeys(windows, 0), []
    for slot in range(sum(map(len, windows.values()))):
        ready = [(windows[s][at[s]][1], s) for s in sorted(windows, key=lambda x: (x is not None, x)) if at[s] < len(windows[s]) and windows[s][at[s]][0] <= slot]
        s = min(ready, key=lambda x: (x[0], x[1] is not None, x[1] or ""))[1]
        out.append(s)
        at[s] += 1
    return out


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "c": 1.0}])
def test_mix_keeps_to_its_targets(spark, weights):
    n = {"a": 300, "b": 200, "c": 37, None: 11}
    rows = [(i * 10 + k, "t", "en", s, 1) for k, (s, m) in enumerate(n.items()) for i in range(m)]
    got = pfair.pfair_mix(table(spark, rows), weights=weights, total_blocks=100).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(len(rows)))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    wins = {s: sorted({(r["mix_block"], r["mix_release"], r["mix_deadline"]) for r in got if r["source"] == s}) for s in n}
    slots = {r["mix_slot"]: r["source"] for r in got}
    assert [slots[i] for i in range(len(slots))] == plain_edf({s: [w[1:] for w in ws] for s, ws in wins.items()})
    # less than one block from the fluid mix, as long as no source has run out
    total = sum(n.values())
    w = {s: (n[s] ** 0.5 if weights is None else weights.get(s, n[s] / total)) for s in n}
    share = {s: x / sum(w.values()) for s, x in w.items()}
    first_end = min(len(wins[s]) / share[s] for s in n)
    done = dict.fromkeys(n, 0)
    for i in range(int(first_end)):
        done[slots[i]] += 1
        assert all(abs(done[s] - share[s] * (i + 1)) < 1 + 1e-6 for s in n)


def test_mix_of_odd_tables(spark):
    docs = odd_docs(spark)
    got = pfair.pfair_mix(docs.drop("mix_slot"), total_blocks=3)
    assert sorted(r["mix_position"] for r in got.collect()) == list(range(7))
    assert pfair.pfair_mix(empty_docs(spark).drop("mix_slot")).count() == 0


@pytest.mark.parametrize("total_blocks", [7, 100])
def test_sorted_mix_has_the_order_of_the_blocks(spark, total_blocks):
    n = {"a": 300, "b": 200, "c": 37, None: 11}
    rows = [(i * 10 + k, "t", "en", s, 1) for k, (s, m) in enumerate(n.items()) for i in range(m)]
    docs = table(spark, rows)
    want = [r["doc_id"] for r in pfair.pfair_mix(docs, total_blocks=total_blocks).orderBy("mix_position").collect()]
    got = pfair.pfair_sorted(docs, 5, total_blocks=total_blocks)
    assert [r["doc_id"] for r in got.collect()] == want and got.columns == docs.columns
    assert got.rdd.getNumPartitions() == 5


def test_sorted_mix_deals_repeated_rows_to_their_blocks(spark):
    rows = [(1, "same", "en", "a", 4)] * 150 + [(None, None, "en", "a", None)] * 60 + [(2 + i, "t", "en", "b", 1) for i in range(150)]
    docs = table(spark, rows)
    want = [r["source"] for r in pfair.pfair_mix(docs, total_blocks=36).orderBy("mix_position").collect()]
    got = pfair.pfair_sorted(docs, 4, total_blocks=36).collect()
    assert [r["source"] for r in got] == want
    assert sorted(map(str, got)) == sorted(map(str, docs.collect()))


def test_sorted_mix_of_odd_tables(spark):
    docs = odd_docs(spark)
    cut = docs.drop("mix_slot")
    assert sorted(map(str, pfair.pfair_sorted(cut, 3, total_blocks=3).collect())) == sorted(map(str, cut.collect()))
    assert pfair.pfair_sorted(empty_docs(spark).drop("mix_slot"), 3).count() == 0

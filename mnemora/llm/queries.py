"""The queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, ext_hash, fim, html_mss, langid_crf, lcp, line_dedup, ngram_join, periodic, pfair, topk_impact, warc
from .common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of 3-word n-grams have a Jaccard of 0.9 or more are linked."""
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"), q=3, num=90, den=100).drop("class")


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM words, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 1))) AS i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(reach.r) AS component_id
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids, and digests both."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", byte_bpe.token_count().cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every 50th vector."""
    items = topk_impact.quantise(_table(spark, sf_dir, "embeddings"))
    return topk_impact.top_k(items, items.filter("id % 50 = 0"), k=5)


OP3_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), items AS (
  SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d, len(v) AS width FROM (SELECT *, row_number() OVER () AS r FROM good)
), pairs AS (
  SELECT q.vec_id AS query_id, i.vec_id, sum(q.x * i.x)::BIGINT AS score
  FROM items q JOIN items i ON q.d = i.d AND q.width = i.width AND q.vec_id <> i.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY q.r, i.r, q.vec_id, i.vec_id
), scored AS (
  SELECT query_id, vec_id, max(score) AS score FROM pairs GROUP BY ALL
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, indexes the archives, and reads all records back by URL."""
    folder = shared_path(spark, "warc")
    pages = _table(spark, sf_dir, "pages")
    captures = warc.write_archives(pages, folder)
    directory = warc.write_index(captures, folder)
    keys = pages.select(warc.url_key(F.col("url"), F.col("page_id")).alias("urlkey"))
    return warc.read_records(warc.lookup(directory, folder, keys), folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(octet_length(encode(html)), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op5_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from documents outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid_crf.train(docs.filter(~held_out))
    found = langid_crf.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("lang_found.lang").alias("lang_pred"), F.col("lang_found.score").alias("score"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one more, then reads turns and loss text back."""
    said = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("e"),
    ).select("conv_id", "e.*")
    back = chat_format.parse(chat_format.format_conversations(rows.unionByName(extra)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS e,
         replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS er FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn>### ' || er || ': ' || e || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id, CASE WHEN conv_id IS NULL THEN md5(concat(coalesce(turn::VARCHAR, '-'), '|', role, '|', text)) END
"""


def op7_lcp_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness."""
    return lcp.compare_with_next(_table(spark, sf_dir, "documents"))


def op8_html_mss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, with weights learned from labelled pages."""
    pages = _table(spark, sf_dir, "pages")
    found = html_mss.extract_text(pages, html_mss.learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_ext_hash_shards(spark: SparkSession, sf_dir: str, limit_bytes: int = 1 << 20) -> DataFrame:
    """The shard of every document, shards of at most 1 MiB of text (so that small tables split too)."""
    return ext_hash.extendible_shards(_table(spark, sf_dir, "documents"), limit_bytes=limit_bytes)


OP9_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS h FROM documents
), nodes AS (
  SELECT d AS depth, h >> (60 - d) AS node, sum(bytes) AS shard_bytes, count(*) AS shard_docs
  FROM h, range(0, 25) t(d) GROUP BY ALL HAVING sum(bytes) <= 1048576
), placed AS (
  SELECT h.doc_id, h.bytes, min(n.depth) AS depth, any_value(h.h) AS h
  FROM h JOIN nodes n ON h.h >> (60 - n.depth) = n.node GROUP BY h.doc_id, h.bytes
)
SELECT p.doc_id, CASE WHEN p.depth = 0 THEN '' ELSE right(to_base(p.h >> (60 - p.depth), 2, 60), p.depth::INT) END AS shard,
       p.depth::INT AS depth, p.bytes, n.shard_bytes::BIGINT AS shard_bytes, n.shard_docs, false AS overflow
FROM placed p JOIN nodes n ON n.depth = p.depth AND n.node = p.h >> (60 - p.depth)
"""


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix of its sources, weighted by the root of their sizes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.pfair_mix(docs)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of words of every text, a period planted in each tenth, and the texts without them."""
    docs = _table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periodic.plant_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.periodic_runs(planted).select("doc_id", "runs", "collapsed", periodic.longest_run(F.col("runs")).alias("best"))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rearranges every text, then restores it from the output."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    back = fim.restored(fim.fill_in_middle(docs).drop("text"))
    return back.select(
        "doc_id",
        F.col("n_tokens").alias("n"),
        F.col("fim_form").alias("form"),
        "prefix_chars",
        "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), p AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:least(x, y)], '') AS pre, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(w[greatest(x, y) + 1:n], '') AS suf FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops lines of 40 code points or more that five documents share, but in the last of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS anon, string_split(coalesce(text, ''), chr(10)) AS w FROM documents
), lines AS (
  SELECT r, doc_id, anon, unnest(w) AS line, generate_subscripts(w, 1) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper, max(anon) AS anon_keeper FROM (SELECT DISTINCT key, doc_id, anon FROM keyed WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND CASE WHEN s.keeper IS NULL THEN k.anon <> s.anon_keeper ELSE k.doc_id IS DISTINCT FROM s.keeper END AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_topk_search": op3_topk_search,
    "op4_warc": op4_warc,
    "op5_langid_crf": op5_langid_crf,
    "op6_chat_format": op6_chat_format,
    "op7_lcp_fingerprints": op7_lcp_fingerprints,
    "op8_html_mss": op8_html_mss,
    "op9_ext_hash_shards": op9_ext_hash_shards,
    "op10_pfair_mix": op10_pfair_mix,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL = {
    "op1_ngram_join": OP1_SQL,
    "op3_topk_search": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_chat_format": OP6_SQL,
    "op9_ext_hash_shards": OP9_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}

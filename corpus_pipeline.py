"""The corpus pipeline: language, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. It belongs to ``mnemora.llm``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.llm import byte_bpe, langid_crf, ngram_join, pfair
from mnemora.llm.common import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words that a worker of the last stage keeps: fewer than `byte_bpe` does alone, since executors still
#: hold the memory that they took in the stages before.
CACHE_WORDS = 500_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is found: those with letters and a score that stands out.

    The model is trained on the whole texts of all rows with a language. Then all rows are labelled
    once, and over all those with a language the smallest score of a rightly labelled text is taken; a document
    is rejected whose score is less than half as far above chance. Null and empty texts and texts
    without letters are rejected; repeated rows are judged alike; where no row has a language, all
    texts with letters stay; an empty table stays empty. A row without a language leaves with the one that
    was found, the others with their own. Extra columns are left out."""
    model = langid_crf.train_whole(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    chance = 1 / len(model.langs)
    found = stash(langid_crf.predict(docs.select(*COLUMNS), model), "judged")
    named = found.filter(F.col("lang_found.lang") != langid_crf.UND)
    sure = named.filter(F.col("lang_found.lang") == F.col("lang").cast("string")).agg(F.min("lang_found.score")).first()[0]
    floor = chance if sure is None else min(sure, (chance + sure) / 2)
    own = F.coalesce("lang", F.col("lang_found.lang").cast(docs.schema["lang"].dataType))
    return named.filter(F.col("lang_found.score") >= floor - 1e-9).withColumn("lang", own).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class that 5-word shingles with a Jaccard of 0.8 or more link: that with
    the smallest id, of those the one with the smallest hash of its text; a row that is repeated
    with its text is kept once. Rows without id are compared like others and stay only where no row with an
    id is in their class. Null, empty and wordless texts are in no class and stay, repeats too.
    Where an id stands over different texts, each is judged on its own. Extra columns are left out.

    Texts are not shuffled, but for rows that a small bitmap can't tell from dropped ones."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    classes = ngram_join.jaccard_classes(keyed, q=5, num=80, den=100, carry=["_row"])
    members = classes.filter("class is not null").groupBy("class", "doc_id", "_row").agg(F.count(F.lit(1)).alias("copies"))
    best = members.groupBy("class").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row")).alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    stays = F.isnull("best") | F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("_row") == F.col("best._row"))
    judged = members.join(best, "class", "left").select(F.col("doc_id").alias("_d"), "_row", stays.alias("stays"), (F.col("copies") > 1).alias("repeated"))
    touched = stash(judged.filter("not stays or repeated"), "touched")
    apart, rest = ngram_join.split_by_keys(keyed, "_row", touched.select("_row"))
    same = (rest["_row"] == touched["_row"]) & rest["doc_id"].eqNullSafe(touched["_d"])
    clear = rest.join(touched, same, "left_anti")
    others = [c for c in COLUMNS if c != "doc_id"]
    once = rest.join(touched.filter("stays"), same, "left_semi").groupBy("doc_id", "_row").agg(F.min(F.struct(*others)).alias("r")).select("doc_id", "r.*")
    return apart.select(*COLUMNS).unionByName(clear.select(*COLUMNS)).unionByName(once.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of their sources by the roots of their sizes: files
    hold ranges of the mix. Texts are shuffled once, to their file. Null sources are a source; rows without id and repeated rows all stay;
    an empty table stays empty. Extra columns are left out."""
    return pfair.pfair_sorted(docs.select(*COLUMNS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The language, the place in the mix (from 0, without gaps), the number and digest of the ids of every text,
    and the digest of what they decode to. Null texts are empty; every row gives a row. Extra columns
    are left out. Rows that don't come from files have no place (null)."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    back = byte_bpe.round_trip(in_file_order(docs.select("doc_id", "lang", "source", "text")), ranks, public_tokenizers.PATTERN, cache_words=CACHE_WORDS)
    return back.select("doc_id", "lang", "source", "mix_position", byte_bpe.token_count().cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("text_sha256"))


def in_file_order(docs: DataFrame) -> DataFrame:
    """Adds ``mix_position``: the number of rows before a row in its file, and in the files before it
    by name. A reader deals out files in any order, so the order of the mix, which the files hold, is
    read from their names and the places of their rows. Only rows are counted, a number a file."""
    try:
        file, row = (docs.metadataColumn("_metadata")[c] for c in ("file_name", "row_index"))
        placed = docs.withColumns({"_file": file, "_at": row})
        sizes = docs.select(file.alias("_name")).groupBy("_name").agg(F.count(F.lit(1)).alias("n"))
    except AnalysisException:  # not from files
        return docs.withColumn("mix_position", F.lit(None).cast("long"))
    before = F.sum("n").over(W.orderBy("_name").rowsBetween(W.unboundedPreceding, -1))  # a row a file
    offsets = sizes.select("_name", F.coalesce(before, F.lit(0)).alias("_before"))
    met = placed.join(F.broadcast(offsets), F.col("_file") == F.col("_name"))  # as many rows as the mix has files
    return met.withColumn("mix_position", F.col("_before") + F.col("_at")).drop("_file", "_at", "_name", "_before")


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", tokens)]

#: SQL has no language model and no BPE; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"stage{i + 1}")
    return docs

"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Every stage but the last returns the columns of documents; each is written as
Parquet and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm import bpe, decontaminate, jaccard, language, pii, shared

#: Documents below this mean probability of their language are rejected, as are those without one.
LEAST_SCORE = 0.5
VOCABULARY = "byte_bpe_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; lang becomes what the model says."""
    out = language.identify(docs, language.trained(docs), keep=["text", "source", "n_chars"])
    return out.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, a hash of doc_id and text: decisions are taken by it, as ids may be null or repeat."""
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), "text"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return keyed(docs).join(keys, "_key", "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of similar documents: that with the least doc_id, or any if none has one.

    Rows that are equal in doc_id and text are one document.  Documents without words are similar to none.
    """
    found = jaccard.jaccard_components(keyed(docs), doc_id="_key").select("_key", "component_id")
    ids = keyed(docs).select("_key", "doc_id").distinct()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))
    kept = found.distinct().join(ids, "_key").groupBy("component_id").agg(best.alias("m")).select("m._key")
    gone = shared.stored(found.select("_key").distinct().join(kept, "_key", "left_anti"), "near-duplicates")
    again = shared.stored(found.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"), "repeated-rows")
    out = without(docs, gone)
    if not again.isEmpty():
        out = out.join(again, "_key", "left_anti").unionByName(out.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return out.select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate.decontaminate(keyed(docs), shared.table(spark, sf_dir, "benchmark"), doc_id="_key").where("n_hit > 0").select("_key").distinct()
    return without(docs, found).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts labels for personal data and revealing terms."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) of every document, checked against its text by decoding."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    done = bpe.decode(bpe.encode(docs, path), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("PII", without_personal_data),
    ("byte-level BPE", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir; each stage's table is deleted once its successor is written.

    Null and empty texts end in the first stage, as they have no language; extra columns are left out there.
    """
    docs = shared.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        last, docs = docs, shared.stored(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            shared.drop(last)
    return docs

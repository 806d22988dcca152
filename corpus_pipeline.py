"""The corpus pipeline: five stages, each on all rows that its predecessor kept.

Every stage is written as Parquet in the shared folder and read again, so a lost executor
costs one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.llm import bpe, langid, minhash, mixing, sadedup
from plotwright.llm.common import checkpoint_dir, crc_mod, cut, drop_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose most probable language has less than this is rejected, as is one without letters.
LEAST_SCORE = 0.3
#: Passages of so many words (over 50) are not to repeat, whatever their length in bytes.
PASSAGE_WORDS = 51


def shaped(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is known; ``lang`` becomes what was predicted."""
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs.where(~held_out)))
    return shaped(found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-duplicates: that of least id, nulls last.

    Rows are told apart by a hash of id and text, so texts that share an id, or have none, are
    rows of their own. Of rows that repeat both, one is left before classes are formed.
    """
    columns = [F.col(c) for c in COLUMNS]
    keyed = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), *columns)
    rows = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")))
    repeated = rows.where("rows > 1").select("key")
    if repeated.limit(1).count():
        first = picked(keyed, repeated, "left_semi").groupBy("key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
        keyed = picked(keyed, repeated, "left_anti").unionByName(cut(first).select("key", *[F.col(f"row.{c}").alias(c) for c in COLUMNS]))
    found = cut(minhash.classes(keyed, id_col="key").select("key", "class_id").join(rows.select("key", "doc_id"), "key"))
    kept = found.groupBy("class_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    gone = cut(found.select("key").join(kept, "key", "left_anti"))
    return picked(keyed, gone, "left_anti").select(*COLUMNS)


def picked(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join by key; texts move only where the keys are too many to broadcast."""
    few = keys.limit(minhash.BROADCAST_IDS + 1).count() <= minhash.BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, "key", how)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 400 bytes, and passages of over 50 words, that start more than once; characters cut apart go too, and texts of which nothing but white space is left."""
    found = sadedup.removed(docs.select(*COLUMNS), as_text=True, least_words=PASSAGE_WORDS).where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    return shaped(found.withColumn("text", F.col("kept")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says, not at all included."""
    return shaped(mixing.repeat(mixing.mix(docs.select(*COLUMNS)), "mix_copies"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the mix: its tokens, counted and hashed, and the bytes that they decode to."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: SQL cannot express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            drop_folder(spark, f"{base}/{k - 1}")
    return docs

"""One query per corpus operator, with the parameters that production uses, over whole tables."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.llm import ann, bpe, extract, langid, merkle, minhash, mixing, negatives, sadedup, sharding, topk, toxicity, warc
from plotwright.llm.common import checkpoint_dir, crc_mod, cut, drop_folder, table
from plotwright.llm.oracles import ORACLES as ORACLES

#: The fields of a document that a Merkle leaf hashes, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sadedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    scanned = cut(warc.scan(spark, path))
    drop_folder(spark, path)
    read = warc.resolve(warc.reassemble(scanned))
    return read.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"), "target_uri", "n_segments", "intact")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), fractions=True)
    return mixed.select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size") + F.col("mix_part")).alias("taken"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], [f"shard-{k:04d}" for k in range(1024)])


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model, keep=[docs["doc_id"], held_out.alias("held_out")])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified against a copy in which the texts of some documents are in lower case."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    seen = [F.when(crc_mod(F.col("doc_id"), 5) == 0, lowered).otherwise(F.col("text")) if c == "text" else F.col(c) for c in LEAF]
    return merkle.manifest(docs, LEAF, "doc_id", "source", seen)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs.where(~held_out), labels)
    found = toxicity.predict(docs, model, keep=[docs["doc_id"], held_out.alias("held_out")])
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


QUERIES = {
    "op1_extract": op1_extract,
    "op2_suffix": op2_suffix,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_minhash": op5_minhash,
    "op6_ann": op6_ann,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_topk": op9_topk,
    "op10_language_id": op10_language_id,
    "op11_merkle": op11_merkle,
    "op12_toxicity": op12_toxicity,
    "op13_hard_negatives": op13_hard_negatives,
}

"""Documents from raw text to tokens: five stages, each written and read again.

Every stage works on all documents that its predecessor kept, and its decisions take effect: toxic
documents go, of near copies one stays, secrets are masked, documents are taken as often as the mix
asks, and what remains is encoded. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, jaccard, mixing, secrets, toxicity
from siftwell.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from the labels that aren't held out, is under 0.3."""
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).where("toxic_score < 0.3").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity of 0.8 or more) the document of the smallest id.

    Each row is judged by its own text, whatever rows share its id or have none: rows are told apart by
    a hash of all their columns, so equal rows are one. Rows with an id go before those without; of
    equal ids the smallest hash stays.
    """
    keyed = docs.withColumn("_key", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]))
    keyed = keyed.dropDuplicates(["_key"])
    found = jaccard.classes(keyed.select(F.col("_key").alias("doc_id"), "text"), words=5, percent=80)
    rows = found.select(F.col("doc_id").alias("_key"), "component_id").join(keyed.select("_key", "doc_id"), "_key")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first"))
    kept = keyed.join(first.select(F.col("first._key").alias("_kept")), F.col("_key") == F.col("_kept"), "left_semi")
    return kept.select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret of a text replaced by its kind in angle brackets; n_chars follows."""
    scanned = written(secrets.scan(docs.select("text")).drop("text"), "pipeline-secrets")
    clean = secrets.redact(docs, secrets.fit(scanned))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, or up to three times."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    taken = mixing.mix(rows, row_col="_row").where("copies > 0").select(F.col("row").alias("_row"), "copies")
    return rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to its bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Not expressible in SQL (a trained classifier, inferred grammars, random rounding, BPE); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
    return docs

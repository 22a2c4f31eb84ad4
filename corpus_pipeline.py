"""A corpus from raw documents to packed token sequences, stage by stage.

Each stage gets everything its predecessor kept and decides on it: language drops documents
without a recognisable language, deduplication keeps one document of each group, the secret
scan masks secrets in place, and packing cuts the texts into token windows.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasonwise.llm import language, minhash, packing, secrets
from seasonwise.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; ``lang`` becomes the predicted one.

    Rejected: texts that are null, without a letter, or at odds with every language (the two
    nearest codewords are about equally near). Repeated rows are judged alike.
    """
    return language.recognised(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    Kept is the smallest ``doc_id``; of rows that repeat it, one. Rows without ``doc_id`` stay.
    """
    verdict = minhash.near_duplicates(docs, width=5, percent=80)
    gone = verdict.filter(~F.col("kept")).select(
        F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_none")).distinct()
    # Rows without id are spread by their text; none of them is a repetition. The document is one
    # column meanwhile, so that its columns may have any name.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
                        F.col("doc_id").alias("i"), spread.alias("spread"))
    kept = keyed.join(gone, (keyed["i"] == gone["_id"]) & (keyed["spread"] == gone["_none"]),
                      "left_anti")
    first = F.row_number().over(Window.partitionBy("i", "spread").orderBy("d.text"))
    return kept.withColumn("n", first).filter((F.col("n") == 1) | F.col("i").isNull()).select("d.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and ``n_chars`` counted anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) \
        if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048."""
    return packing.pack(docs, "byte_bpe_50k.json", window=2048, end_id=1)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates),
          ("secrets", mask_secrets), ("packing", pack_sequences)]

# Trained models and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each on what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

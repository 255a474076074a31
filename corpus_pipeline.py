"""The corpus pipeline: stages of the training-data operators over `documents`.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns the
pieces of packed sequences. run() writes each stage's result below the shared folder and reads it again for the next;
what a stage made on its way is deleted then.
Rows with null text or null id, repeated rows and extra columns follow the operators' own definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.llm import jaccard, languages, packing, queries, substrings, suffixes
from arealis.llm.batches import MADE, release, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go; lang becomes the predicted language."""
    docs = docs.select(*COLUMNS)
    dictionaries = languages.learn(docs.where(languages.trains()))
    found = languages.identify(docs, dictionaries)
    return found.where(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, each of its texts once. Rows without id stay."""
    kept = jaccard.links(docs).where("doc_id = component_id").select("doc_id").distinct()
    chosen = docs.join(stored(kept, "kept"), "doc_id", "left_semi")
    # a row repeated under one id is one document; another text under the same id stays
    chosen = chosen.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r")).select("doc_id", "text", "r.*")
    return chosen.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document with a smaller id has are cut out; documents left without words go."""
    cut = substrings.repeats(docs).where("doc_id is not null and size(repeats) > 0").select(F.col("doc_id").alias("of"), "kept_text")
    cut = stored(cut, "cut")
    text = F.when(F.col("of").isNotNull(), F.col("kept_text")).otherwise(F.col("text"))
    joined = docs.join(cut, docs["doc_id"] == cut["of"], "left").where("of is null or kept_text <> ''")
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = suffixes.decontaminate(docs, benchmark, keep=["lang", "source", "n_chars"])
    return hits.where(suffixes.n_hit() == 0).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    pieces = packing.pack(docs, queries.tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("packed", packed),
]
#: Compression, tokenisation and packing aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = len(MADE)
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, keep=1)  # what the stage made on its way; its result, made last, stays
    return STAGES[-1][1](spark, docs, sf_dir)

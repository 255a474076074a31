"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.llm import ann, divergence, html_text, jaccard, languages, oracle, packing, ranking, scoring, substrings, suffixes, urls, warc, wavelet

#: Where the vocabulary of op3 lies; None: as the public_tokenizers package gives it.
TOKENIZER: str | None = None
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, path = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.read_bundles(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.coalesce(F.aggregate("repeats", F.lit(0).cast("long"), lambda a, x: a + x["length"]), F.lit(0).cast("long"))
    return substrings.repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = suffixes.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = languages.learn(docs.where(languages.trains()))
    found = languages.identify(docs, dictionaries, keep=["doc_id"])
    return found.select("doc_id", (~languages.trains()).alias("held_out"), "lang_pred", "score", "rejected")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(ranking.index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, path = wavelet.archive(_table(spark, sf_dir, "documents"), tokenizer())
    return wavelet.read(index, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundles": op1_warc_bundles,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_decontaminate": op6_decontaminate,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_html_text": op8_html_text,
    "op9_lm_score": op9_lm_score,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_matrix": op13_token_matrix,
}
SQL: dict[str, str] = {
    "op1_warc_bundles": oracle.OP1,
    "op2_substring_dedup": oracle.OP2,
    "op4_jaccard_join": oracle.OP4,
    "op6_decontaminate": oracle.OP6,
    "op7_vector_dedup": oracle.OP7,
    "op11_ranked_search": oracle.OP11,
    "op12_source_divergence": oracle.OP12,
}

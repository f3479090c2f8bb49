"""The registered query of each numbered operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, langid, licenses, mixing, packing, periodic, quality, resample, simhash, token_counts, topk, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_tokenizer() -> str:
    """Path of the tokenizer file that the packing query names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    """Path of the byte-level vocabulary that the token counts use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over 3-word shingles and components of links at up to 3 bits."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3, distance=3)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and labels of licence phrases and notices in every document."""
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its personal data are replaced by marks."""
    return token_counts.count_redacted(_read(spark, sf_dir, "documents"), byte_vocabulary())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of five nested rules on the url of every page."""
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), url_filter.RULES)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), word_tokenizer(), capacity=2048, end_id=0)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each vector whose id 20 divides, against all others."""
    rows = _read(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where("vec_id % 20 = 0"), rows, k=20, scale=64.0)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in a mix of 150 % of all words, sources weighing 5, 2, 1 in turn."""
    mix = mixing.mix_sources(_read(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group of equal texts that stays: the largest id."""
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"), keep="max")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents weighed towards the benchmark's distribution of 1- to 3-grams, and 5 % of them drawn."""
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), percent=5, least_words=20)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of which have a repeated end planted, and what is left without repeats."""
    return periodic.planted_runs(_read(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that are not held out."""
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), least=0.3)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_toxicity,
        op3_license_scan,
        op4_token_counts,
        op5_url_filter,
        op6_best_fit_packing,
        op7_exact_top_k,
        op8_mix_sources,
        op9_exact_dedup,
        op10_language_id,
        op11_importance_resample,
        op12_periodic_runs,
        op13_quality,
    )
}
ORACLE_SQL = {
    "op5_url_filter": url_filter.ORACLE,
    "op7_exact_top_k": topk.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_importance_resample": resample.ORACLE,
    "op12_periodic_runs": periodic.ORACLE,
}

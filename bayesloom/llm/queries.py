"""The operators' queries for the driver's entry file, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folder of the public vocabulary files; set BAYESLOOM_TOKENIZERS to use another.
TOKENIZERS = os.environ.get("BAYESLOOM_TOKENIZERS", "")


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sst import digests, token_shards

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(token_shards(docs, vocabulary("word_bpe_49k.json"), end_id=2))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import classify

    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import removal_digests

    return removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=400)


def op10_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import removal_digests

    return removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=50)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import compare

    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .tokencounts import section_counts, thirds

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return section_counts(docs, vocabulary("byte_bpe_50k.json"), thirds(F.col("text")), rule="most")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_repeated_words": op10_repeated_words,
    "op4_fingerprints": op4_fingerprints,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op5_token_shards": op5_token_shards,
}

#: What SQL can express; the tests compare the others with brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_repeated_words": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT r, o, i, array_to_string(list_slice(w, i, i + 49), ' ') AS t FROM (SELECT r, o, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
bad AS (SELECT r, i, i AS start FROM (SELECT r, o, i, min(o) OVER (PARTITION BY t) AS least FROM h) WHERE least < o),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (SELECT r, i, word, max(start) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN bad USING (r, i)),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
}

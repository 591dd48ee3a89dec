"""A corpus pipeline of five of the operators; counted as part of ``bayesloom.llm``.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of ``documents``; the
last gives the tokens' digests. Between stages the documents are written as Parquet in the shared folder and read again.

1. Language: texts without a letter, and those whose language is less likely than MIN_SCORE, go.
2. SimHash: of each group of near-duplicates (similarity of 0.8 or more over five-word shingles) the document of the
   smallest id stays (of equal ids or null ids one row).
3. Suffix sampling: bytes of strings of REPEATED bytes that occur elsewhere too are taken out of the texts.
4. Decontamination: documents that overlap with a benchmark item go.
5. SentencePiece: the kept texts are encoded and decoded.

Nulls: null texts go in stage 1; null ids are kept. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayesloom.llm import common, decontaminate, langid, pieces, queries, simhash, suffixes

MIN_SCORE = 0.5
#: Nine of ten passages of 50 words have 270 bytes or more.
REPEATED = 250


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    lang, sure = common.unused(docs, "lang_pred", "score")
    said = langid.predict(docs, model, keep=tuple(docs.columns), names=(lang, sure))
    return said.where((F.col(lang) != langid.UNKNOWN) & (F.col(sure) >= MIN_SCORE)).drop(lang, sure)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = common.checkpointed(simhash.similar(docs))
    ids = docs.select(F.xxhash64("text").alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("own"))
    first = F.min_by("own", F.struct(F.col("doc_id").isNull(), "doc_id", "own"))
    (name,) = common.unused(docs, "kept")
    kept = ids.join(groups, "row").groupBy("component").agg(first.alias(name)).select(name)
    chosen = docs.join(kept, F.xxhash64(docs["doc_id"], docs["text"]) == F.col(name))
    return chosen.dropDuplicates([name]).drop(name)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(docs, REPEATED)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.compare(docs, queries.vocabulary("piece_bpe_32k.model"), parity=False).drop("same_ids")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: No stage can be put in SQL: the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = common.fresh_dir(spark, f"stage-{k + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

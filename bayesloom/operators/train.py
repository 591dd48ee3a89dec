"""Sufficient statistics: a training log (seq, category, tokens, sign) folded into cells and categories.

A document with sign -1 withdraws one that was trained; the statistics are those of the log without both.
Documents without tokens count. A log must withdraw only what it has trained; ``replay`` is exact for any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BayesError


def training_log(docs: DataFrame, category: Column, tokens: Column, seq: str = "doc_id", sign: int = 1) -> DataFrame:
    return docs.select(F.col(seq).cast("bigint").alias("seq"), category.cast("string").alias("category"), tokens.alias("tokens"), F.lit(sign).alias("sign"))


def train_test(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training, held-out, test) by id modulo 5, for calibration and metrics."""
    part = F.pmod(F.col("doc_id"), F.lit(5))
    return docs.where(part >= 2), docs.where(part == 1), docs.where(part == 0)


def category_documents(log: DataFrame, category: str) -> DataFrame:
    """The rows of one category, in order of training; an unknown category has none."""
    return log.where(F.col("category") == category).orderBy("seq")


def category_names(log: DataFrame) -> DataFrame:
    """(category, documents): every category of a log with its rows, in order of first training."""
    return log.groupBy("category").agg(F.count(F.lit(1)).alias("documents"), F.min("seq").alias("first")).orderBy("first", "category").select("category", "documents")


def require_rows(log: DataFrame) -> DataFrame:
    if log.isEmpty():
        raise BayesError("training_empty")
    return log


def counted(rows: DataFrame, *keep: str, outer: bool = False, whole: bool = False) -> DataFrame:
    """(keep..., token, f): how often each token of ``tokens`` occurs in its row.

    The runs of the sorted array are counted in place, so that nothing is shuffled and a row gives its distinct tokens only.
    ``outer`` gives a row without tokens a null token with f 0; ``whole`` gives every row a null token with f its size.
    """
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    laid = rows.select(*keep, F.sort_array(tokens).alias("_sorted"))
    n, zero = F.size("_sorted"), F.array().cast("array<int>")
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    runs = laid.withColumn("_runs", F.when(n > 0, begins).otherwise(zero))
    each = F.transform("_runs", lambda at, k: F.struct(F.get("_sorted", at).alias("token"), (F.coalesce(F.get("_runs", k + 1), n) - at).cast("bigint").alias("f")))
    extra = F.array(F.struct(F.lit(None).cast("string").alias("token"), n.cast("bigint").alias("f")))
    if whole:
        each = F.concat(each, extra)
    elif outer:
        each = F.when(n > 0, each).otherwise(extra)
    return runs.select(*keep, F.explode(each).alias("_d")).select(*keep, "_d.token", "_d.f")


def deltas(log: DataFrame, *keep: str) -> DataFrame:
    """(category, token, n, docs) contributions: each distinct token of each document once."""
    each = counted(log, "category", "sign", *keep)
    return each.select("category", *keep, "token", (F.col("f") * F.col("sign")).alias("n"), F.col("sign").cast("bigint").alias("docs"))


def fold(log: DataFrame) -> DataFrame:
    """(category, token, cnt, doc_cnt, first): cells and, under a null token, categories of one pass and one shuffle."""
    each = counted(log, "category", "sign", "seq", whole=True)
    first = F.min(F.when(F.col("token").isNull() & (F.col("sign") > 0), F.col("seq")))
    return each.groupBy("category", "token").agg(F.sum(F.col("f") * F.col("sign")).alias("cnt"), F.sum("sign").cast("bigint").alias("doc_cnt"), first.alias("first"))


def cells_of(folded: DataFrame) -> DataFrame:
    return folded.where("token is not null and cnt > 0").select("category", "token", "cnt", "doc_cnt")


def categories_of(folded: DataFrame) -> DataFrame:
    order = Window.orderBy("first", "category")  # one row a category
    zero = F.lit(0).cast("bigint")
    return folded.where("token is null and doc_cnt > 0").select("category", F.row_number().over(order).alias("cat_order"), F.col("doc_cnt").alias("doc_count"), F.greatest("cnt", zero).alias("total_tokens"))


def cells(log: DataFrame) -> DataFrame:
    """(category, token, cnt, doc_cnt), one shuffle with map-side sums."""
    return deltas(log).groupBy("category", "token").agg(F.sum("n").alias("cnt"), F.sum("docs").alias("doc_cnt")).where("cnt > 0")


def categories(log: DataFrame) -> DataFrame:
    """(category, cat_order, doc_count, total_tokens); order is that of first training."""
    size = F.size(F.coalesce("tokens", F.array().cast("array<string>"))) * F.col("sign")
    first = F.min(F.when(F.col("sign") > 0, F.col("seq")))
    sums = log.groupBy("category").agg(F.lit(None).cast("string").alias("token"), F.sum(size).cast("bigint").alias("cnt"), F.sum("sign").cast("bigint").alias("doc_cnt"), first.alias("first"))
    return categories_of(sums)


def replay(log: DataFrame, blocks: int = 1024) -> DataFrame:
    """Cells of a log that may withdraw more than it has: each write is clamped at zero, in order of ``seq``.

    A walk clamped at zero ends at its sum less the least prefix sum (or 0). Sums and least prefixes of consecutive blocks
    of ``seq`` put together give those of the whole, so that a token of all documents is split over its blocks.
    """
    span = log.agg(F.min("seq").alias("low"), ((F.max("seq") - F.min("seq")) / blocks + 1).cast("bigint").alias("width"))
    rows = deltas(log, "seq").groupBy("category", "token", "seq").agg(F.sum("n").alias("cnt"), F.sum("docs").alias("doc_cnt"))
    placed = rows.crossJoin(F.broadcast(span)).withColumn("block", F.floor((F.col("seq") - F.col("low")) / F.col("width")))
    names, cell = ("cnt", "doc_cnt"), ["category", "token"]
    inside = Window.partitionBy(*cell, "block").orderBy("seq")
    walked = placed.withColumns({f"{c}_at": F.sum(c).over(inside) for c in names})
    parts = walked.groupBy(*cell, "block").agg(*(F.sum(c).alias(c) for c in names), *(F.min(f"{c}_at").alias(f"{c}_low") for c in names))
    along = Window.partitionBy(*cell).orderBy("block")
    low = parts.withColumns({f"{c}_low": F.sum(c).over(along) - F.col(c) + F.col(f"{c}_low") for c in names})
    whole = low.groupBy(*cell).agg(*((F.sum(c) - F.least(F.min(f"{c}_low"), F.lit(0))).cast("bigint").alias(c) for c in names))
    return whole.where("cnt > 0")

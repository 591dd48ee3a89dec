"""Views derived from cells and categories: vocabulary, scalars and counts of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary(cells: DataFrame) -> DataFrame:
    """(token, df, g) of tokens that some document holds."""
    return cells.groupBy("token").agg(F.sum("doc_cnt").alias("df"), F.sum("cnt").alias("g")).where("df > 0")


def wide(cells: DataFrame) -> DataFrame:
    """(token, df, g, cells): one row for each token of the vocabulary, with the (category, cnt, doc_cnt) that it has."""
    own = F.collect_list(F.struct("category", "cnt", "doc_cnt")).alias("cells")  # one for each category
    return cells.groupBy("token").agg(F.sum("doc_cnt").alias("df"), F.sum("cnt").alias("g"), own).where("df > 0")


def scalars(words: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: documents, vocabulary size and tokens of the model; ``words`` has a row a token."""
    size = words.agg(F.count(F.lit(1)).alias("v"))
    return categories.agg(F.coalesce(F.sum("doc_count"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("g_total")).crossJoin(size)


def category_sizes(cells: DataFrame) -> DataFrame:
    return cells.where("cnt > 0").groupBy("category").agg(F.count(F.lit(1)).alias("vocabulary_size"))


FAMILIES = ("d", "g", "a", "k")


def histogram(cells: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(fam, category, val, cnt): how many tokens have each value. Only the families asked for are planned.

    d: documents of a category; g: count over all categories (category ''); a: that count for tokens of a category;
    k: that count less the category's own.
    """
    parts = []
    if "d" in families:
        parts.append(cells.where("doc_cnt > 0").groupBy("category", F.col("doc_cnt").alias("val")).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("d").alias("fam"), "category", "val", "cnt"))
    if "g" in families:
        parts.append(vocabulary(cells).groupBy(F.col("g").alias("val")).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit("g").alias("fam"), F.lit("").alias("category"), "val", "cnt"))
    if {"a", "k"} & set(families):
        both = cells.where("cnt > 0").join(vocabulary(cells).select("token", "g"), "token")
        for fam, val in (("a", F.col("g")), ("k", F.col("g") - F.col("cnt"))):
            if fam in families:
                parts.append(both.groupBy("category", val.alias("val")).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(fam).alias("fam"), "category", "val", "cnt"))
    return reduce(DataFrame.unionByName, parts)


def complement_counts(hist: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, val, cnt): for each category how many tokens have each count outside it (g - a + k of a histogram)."""
    names = F.broadcast(categories.select("category"))
    every = hist.where("fam = 'g'").select("val", "cnt").crossJoin(names).select("category", "val", "cnt")
    own = hist.where("fam in ('a', 'k')").select("category", "val", F.when(F.col("fam") == "a", -F.col("cnt")).otherwise(F.col("cnt")).alias("cnt"))
    return every.unionByName(own).groupBy("category", "val").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def histogram_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changes between the histograms of two sets of cells, as signed counts."""
    minus = histogram(before).withColumn("cnt", -F.col("cnt"))
    return histogram(after).unionByName(minus).groupBy("fam", "category", "val").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def encode_key(fam: str = "fam", val: str = "val", category: str = "category"):
    """The flat text key of a histogram cell: family, value, and the category after a colon."""
    return F.concat(F.col(fam), F.col(val).cast("string"), F.when(F.col(category) == "", "").otherwise(F.concat(F.lit(":"), F.col(category))))


def flatten(hist: DataFrame) -> DataFrame:
    """(key, cnt) rows of a histogram, under flat text keys."""
    return hist.select(encode_key().alias("key"), "cnt")


def expand(flat: DataFrame) -> DataFrame:
    """(fam, category, val, cnt) of flat rows; keys that aren't histogram cells and negative counts are left out."""
    return flat.select(decode_key().alias("k"), "cnt").where("k is not null and cnt >= 0").select("k.*", "cnt")


def decode_key(key: str = "key"):
    part = lambda i: F.regexp_extract(key, r"^([dgak])(\d+)(?::(.*))?$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("fam"), part(3).alias("category"), part(2).cast("bigint").alias("val")))

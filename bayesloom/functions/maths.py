"""Log-space arithmetic and TF-IDF as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 50.0


def inf(sign: int = 1) -> Column:
    return F.lit(float("inf") * sign)


def log0(x: Column) -> Column:
    """Natural logarithm with ln(0) = -infinity."""
    return F.when(x == 0, inf(-1)).otherwise(F.log(x))


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b); over a gap of 50 the larger one."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when((high == inf()) | (low == inf(-1)) | (high - low > GAP), high).otherwise(high + F.log1p(F.exp(low - high)))


def log_sum(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys..., log_sum): ln of the sum of e^x by group; -infinity of nothing, infinity if one is.

    The largest value of each group comes first, then the sum of what is left beside it: two sums with map-side combine.
    """
    tops = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    if keys:
        joined = df.select(*keys, F.col(value).alias("_x")).join(tops.select(*(F.col(k).alias(f"_{k}") for k in keys), "_top"), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)))
    else:
        joined = df.select(F.col(value).alias("_x")).crossJoin(F.broadcast(tops))
    finite = F.abs("_top") < float("inf")
    sums = joined.groupBy(*keys).agg(F.max("_top").alias("_top"), F.sum(F.when(finite, F.exp(F.col("_x") - F.col("_top")))).alias("_sum"))
    top = F.col("_top")
    return sums.select(*keys, F.when(top.isNull(), inf(-1)).when(F.abs(top) == float("inf"), top).otherwise(top + F.log("_sum")).alias("log_sum"))


def log_complement(v: Column) -> Column:
    """ln(1 - e^v); -infinity from 0 on."""
    return F.when(v >= 0, inf(-1)).otherwise(F.log1p(-F.exp(v)))


def sigmoid(x: Column) -> Column:
    """The logistic function in the form that doesn't overflow for the sign at hand."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def term_factor(f: Column) -> Column:
    return F.when(f > 0, 1 + F.log(f.cast("double"))).otherwise(0.0)


def idf(n: Column, df: Column) -> Column:
    return F.when(n <= 0, 1.0).when(df < 0, 0.0).otherwise(F.log((n + 1) / (df + 1)) + 1)


def tfidf(f: Column, n: Column, df: Column) -> Column:
    return F.when(f <= 0, 0.0).otherwise(term_factor(f) * idf(n, df))

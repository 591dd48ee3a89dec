"""Metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BayesError
from ..sources import scratch

NAN = float("nan")


def confusion(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(expected, predicted, n) for every pair of labels, zeros included; unknown labels stop it."""
    counts = scratch.kept(pairs.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n")))  # the pairs are read once
    seen = counts.select(F.col("expected").alias("label")).unionAll(counts.select("predicted"))
    if labels is None:
        labels = seen.distinct()
    else:
        unknown = seen.join(labels, "label", "left_anti").first()
        if unknown:
            raise BayesError("label_unknown", unknown[0])
    few = F.broadcast(labels.select("label"))
    grid = labels.select(F.col("label").alias("expected")).crossJoin(few.withColumnRenamed("label", "predicted"))
    return grid.join(counts, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _ratio(a: Column, b: Column, none: float = NAN) -> Column:
    return F.when(b == 0, none).otherwise(a / b)


def per_label(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1); NaN where undefined, F1 0 where both are 0."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit(1).alias("side")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("side")))).alias("s"), "expected", "predicted", "n")
    hit = (F.col("expected") == F.col("predicted")) & (F.col("s.side") == 1)
    sums = sides.groupBy(F.col("s.label").alias("label")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s.side") == 1, F.col("n")).otherwise(0)).alias("exp"), F.sum(F.when(F.col("s.side") == 0, F.col("n")).otherwise(0)).alias("pred"))
    pr = sums.select("label", _ratio(F.col("tp"), F.col("pred")).alias("precision"), _ratio(F.col("tp"), F.col("exp")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(F.isnan("precision") | F.isnan("recall"), NAN).when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both)
    return pr.withColumn("f1", f1)


def overall(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro averages (undefined counts as 0, over all labels) and micro averages."""
    hits = matrix.agg(_ratio(F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)), F.coalesce(F.sum("n"), F.lit(0)), 0.0).alias("accuracy"))
    mean = lambda c: F.coalesce(F.avg(F.nanvl(c, F.lit(0.0))), F.lit(0.0))
    macro = per_label(matrix).agg(mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"))
    return hits.crossJoin(macro).select("accuracy", "macro_precision", "macro_recall", "macro_f1", *(F.coalesce("accuracy", F.lit(0.0)).alias(f"micro_{m}") for m in ("precision", "recall", "f1")))


def _clamped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def binary_log_loss(p: Column, y: Column) -> Column:
    """Aggregate: mean of -ln of the probability of what happened."""
    c = _clamped(p)
    return F.coalesce(F.avg(-F.log(F.greatest(F.when(y, c).otherwise(1 - c), F.lit(1e-300)))), F.lit(0.0))


def brier(p: Column, y: Column) -> Column:
    return F.coalesce(F.avg(F.pow(_clamped(p) - y.cast("double"), 2)), F.lit(0.0))


def calibration_error(outcomes: DataFrame, bins: int = 10) -> DataFrame:
    """One row ``ece`` of ``outcomes(p, y)``: equal-width bins, gaps weighted by size."""
    b = max(1, bins)
    p = _clamped(F.col("p"))
    at = F.least(F.lit(b - 1), F.greatest(F.lit(0), F.floor(p * b)))
    each = outcomes.select(p.alias("p"), F.col("y").cast("double").alias("y"), at.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return each.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def distribution_log_loss(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``log_loss`` of ``scored(doc_id, category, score)`` against ``truth(doc_id, label)``."""
    own = truth.join(scored, (truth["doc_id"] == scored["doc_id"]) & (truth["label"] == scored["category"]), "left")
    return own.agg(F.coalesce(F.avg(-F.log(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(1e-300)))), F.lit(0.0)).alias("log_loss"))


def confidences(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(p, y): the top score and whether it is right; a document without scores is a sure miss at 0."""
    from .score import best

    return truth.join(best(scored), "doc_id", "left").select(F.coalesce("score", F.lit(0.0)).alias("p"), F.coalesce(F.col("category") == F.col("label"), F.lit(False)).alias("y"))


def distribution_calibration_error(scored: DataFrame, truth: DataFrame, bins: int = 10) -> DataFrame:
    return calibration_error(confidences(scored, truth), bins)

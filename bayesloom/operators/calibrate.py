"""Calibration: a temperature for softmax scores, and Platt scaling for each label.

A loss is a sum over the held-out rows, so a fit over any number of rows is a few aggregations: the search for a
temperature evaluates many temperatures in one pass and narrows the range; a Newton step needs five sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BayesError
from ..functions.maths import sigmoid

#: Range of the search, and what is taken as no probability.
LOW, HIGH, TINY = 0.01, 100.0, 1e-300


@dataclass(frozen=True)
class Temperature:
    value: float
    samples: int = 0

    def __post_init__(self) -> None:
        if not (math.isfinite(self.value) and self.value > 0):
            raise BayesError("calibration_invalid", self.value)

    def export(self) -> dict:
        return {"temperature": self.value, "samples": self.samples}

    @staticmethod
    def restore(state: dict) -> Temperature:
        return Temperature(float(state.get("temperature", 1.0)), int(state.get("samples", 0)))


def vectors(log_scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(own, top, all): one row for each document whose true label has a finite score, its scores as an array (one a category)."""
    joined = log_scores.join(truth.select("doc_id", "label"), "doc_id")
    own = F.max(F.when(F.col("category") == F.col("label"), F.col("log_score")))
    rows = joined.groupBy("doc_id").agg(own.alias("own"), F.max("log_score").alias("top"), F.collect_list("log_score").alias("all"))
    return rows.where(F.col("own").isNotNull() & (F.abs("own") < float("inf")))


def nll(t: Column) -> Column:
    """Negative log likelihood of one row of ``vectors`` at a temperature."""
    total = F.aggregate("all", F.lit(0.0), lambda acc, v: acc + F.when(v == float("-inf"), 0.0).otherwise(F.exp((v - F.col("top")) / t)))
    return F.least(F.log(total) - (F.col("own") - F.col("top")) / t, F.lit(-math.log(TINY)))


def grid_nll(held: DataFrame, temperatures: list[float]) -> DataFrame:
    """(temperature, nll): the mean loss at each temperature, one pass over ``vectors``."""
    ts = F.explode(F.array(*(F.lit(float(t)) for t in temperatures))).alias("temperature")
    return held.select("own", "top", "all", ts).groupBy("temperature").agg(F.avg(nll(F.col("temperature"))).alias("nll"))


def fit_temperature(log_scores: DataFrame, truth: DataFrame, points: int = 17, width: float = 1e-6) -> Temperature:
    """The temperature of least loss: each pass evaluates ``points`` of them and keeps the two gaps around the least.

    The loss has one minimum over ln T, so narrowing keeps it.
    """
    return fit_vectors(vectors(log_scores, truth), points, width)


def fit_vectors(held: DataFrame, points: int = 17, width: float = 1e-6) -> Temperature:
    """``fit_temperature`` of rows of ``vectors``."""
    held = held.persist()
    try:
        n = held.count()
        if not n:
            raise BayesError("calibration_empty")
        a, b = math.log(LOW), math.log(HIGH)
        while b - a > width:
            grid = [a + (b - a) * k / (points - 1) for k in range(points)]
            sums = held.agg(*(F.avg(nll(F.lit(math.exp(t)))).alias(f"t{k}") for k, t in enumerate(grid))).first()
            k = min(range(points), key=lambda i: sums[i])
            a, b = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
        return Temperature(math.exp((a + b) / 2), n)
    finally:
        held.unpersist()


def fit_platt(values: DataFrame, steps: int = 100) -> DataFrame:
    """(label, slope, intercept, samples) of ``values(label, value, positive)``: Newton's method on smoothed targets.

    All labels take a step in the same pass; only the sums, a row a label, come to the driver.
    """
    rows = values.where(F.col("value").isNotNull() & (F.abs("value") < float("inf"))).select("label", "value", "positive").persist()
    try:
        start = rows.groupBy("label").agg(F.sum(F.col("positive").cast("int")).alias("up"), F.count(F.lit(1)).alias("n")).collect()
        spark = values.sparkSession
        state = {}
        for r in start:
            up, down = r["up"], r["n"] - r["up"]
            state[r["label"]] = {"hi": (up + 1) / (up + 2), "lo": 1 / (down + 2), "a": 0.0, "b": -math.log((down + 1) / (up + 1)), "n": r["n"], "ridge": 1e-12, "done": False, "loss": None, "try": None}
        for _ in range(steps):
            active = {k: s for k, s in state.items() if not s["done"]}
            if not active:
                break
            at = spark.createDataFrame([(k, s["hi"], s["lo"], *(s["try"] or (s["a"], s["b"]))) for k, s in active.items()], "label string, hi double, lo double, a double, b double")
            z = F.col("a") * F.col("value") + F.col("b")
            t, p = F.when(F.col("positive"), F.col("hi")).otherwise(F.col("lo")), sigmoid(z)
            loss = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
            v, w = F.col("value"), p * (1 - p)
            sums = rows.join(F.broadcast(at), "label").groupBy("label").agg(F.sum(loss), F.sum((p - t) * v), F.sum(p - t), F.sum(w * v * v), F.sum(w * v), F.sum(w)).collect()
            for label, lost, ga, gb, haa, hab, hbb in sums:
                s = state[label]
                a, b = s["try"] or (s["a"], s["b"])
                if s["loss"] is not None and lost > s["loss"] + 1e-10 * abs(s["loss"]):  # step back halfway
                    s["try"] = ((a + s["a"]) / 2, (b + s["b"]) / 2)
                    s["done"] = abs(a - s["a"]) + abs(b - s["b"]) < 1e-10
                    continue
                s |= {"a": a, "b": b, "loss": lost}
                if abs(ga) < 1e-5 and abs(gb) < 1e-5:
                    s["done"] = True
                    continue
                haa, hbb = haa + 1e-12, hbb + 1e-12
                det = haa * hbb - hab * hab
                if det <= 0:
                    s["done"] = True
                    continue
                s["try"] = (a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det)
        return spark.createDataFrame([(k, s["a"], s["b"], s["n"]) for k, s in state.items()], "label string, slope double, intercept double, samples bigint")
    finally:
        rows.unpersist()


def platt_losses(values: DataFrame, at: DataFrame) -> DataFrame:
    """``at(label, slope, intercept, ...)`` with the ``loss`` on smoothed targets of ``values(label, value, positive)`` there."""
    sides = values.groupBy("label").agg(F.sum(F.col("positive").cast("int")).alias("up"), F.sum(1 - F.col("positive").cast("int")).alias("down"))
    t = F.when(F.col("positive"), (F.col("up") + 1) / (F.col("up") + 2)).otherwise(1 / (F.col("down") + 2))
    z = F.col("slope") * F.col("value") + F.col("intercept")
    loss = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
    return values.join(sides, "label").join(at, "label").groupBy(*at.columns).agg(F.sum(loss).alias("loss"))


def platt_gradient(values: DataFrame, slope: float, intercept: float) -> DataFrame:
    """(label, loss, g_slope, g_intercept) at fixed parameters on smoothed targets."""
    sides = values.groupBy("label").agg(F.sum(F.col("positive").cast("int")).alias("up"), F.sum(1 - F.col("positive").cast("int")).alias("down"))
    t = F.when(F.col("positive"), (F.col("up") + 1) / (F.col("up") + 2)).otherwise(1 / (F.col("down") + 2))
    z = slope * F.col("value") + intercept
    rows = values.join(sides, "label").select("label", "value", t.alias("t"), z.alias("z"))
    loss = F.greatest(F.col("z"), F.lit(0.0)) - F.col("z") * F.col("t") + F.log1p(F.exp(-F.abs("z")))
    return rows.groupBy("label").agg(F.sum(loss).alias("loss"), F.sum((sigmoid(F.col("z")) - F.col("t")) * F.col("value")).alias("g_slope"), F.sum(sigmoid(F.col("z")) - F.col("t")).alias("g_intercept"))


def export_platt(fitted: DataFrame) -> dict[str, dict]:
    """A fit's parameters by label (a row a label), as plain values."""
    return {r["label"]: {"slope": r["slope"], "intercept": r["intercept"], "samples": r["samples"]} for r in fitted.collect()}


def restore_platt(spark: SparkSession, state: dict[str, dict]) -> DataFrame:
    """The fit of ``export_platt``'s values; labels whose parameters aren't finite numbers are left out."""
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)
    rows = [(label, float(p["slope"]), float(p["intercept"]), int(p.get("samples", 0))) for label, p in state.items() if number(p.get("slope")) and number(p.get("intercept"))]
    return spark.createDataFrame(rows, "label string, slope double, intercept double, samples bigint")


def apply_platt(value: Column, slope: float, intercept: float) -> Column:
    if not (math.isfinite(slope) and math.isfinite(intercept)):
        raise BayesError("calibration_invalid", (slope, intercept))
    return sigmoid(F.lit(slope) * value + F.lit(intercept))


def calibrate(model, held: DataFrame, truth: DataFrame):
    """``model`` with the temperature fitted on ``held(doc_id, tokens)``, which must not have been trained on."""
    from .score import log_scores

    t = fit_temperature(log_scores(model, held), truth)
    return model.with_(temperature=t.value, temperature_samples=t.samples)


def calibrate_tagger(tagger, held: DataFrame, labels: str = "labels"):
    """``tagger`` with each label's fit over all of ``held(doc_id, tokens, labels)``; labels not seen keep theirs."""
    odds = tagger.log_odds(held.select("doc_id", "tokens"))
    values = odds.join(held.select("doc_id", labels), "doc_id").select("label", F.col("log_odds").alias("value"), F.array_contains(labels, F.col("label")).alias("positive"))
    seen = held.select(F.explode(labels).alias("label")).distinct()
    fitted = fit_platt(values.join(seen, "label", "left_semi"))
    if tagger.calibration is not None:
        fitted = fitted.unionByName(tagger.calibration.join(fitted, "label", "left_anti"), allowMissingColumns=True)
    return type(tagger)(tagger.model, tagger.settings, fitted)

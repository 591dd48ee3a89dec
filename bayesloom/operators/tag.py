"""Multi-label tagging: each label against all other documents, by log-odds.

A document is trained under each of its labels and once under the background category. What isn't a label is the
background less the label, so a label costs one pass and no label reads another. N and df come from the background.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import BayesError
from ..functions.maths import idf, sigmoid, term_factor
from . import score
from .model import Model

BACKGROUND = "*"
ODDS = "array<struct<label:string,label_order:int,log_odds:double>>"


@dataclass
class TagSettings:
    threshold: float = 0.5
    max_tags: int = 0
    background: str = BACKGROUND

    def __post_init__(self) -> None:
        self.threshold = 0.5 if math.isnan(self.threshold) else min(1.0, max(0.0, self.threshold))
        self.max_tags = max(0, int(self.max_tags))
        if not self.background:
            raise BayesError("background_empty")


@dataclass
class Tagger:
    model: Model
    settings: TagSettings = field(default_factory=TagSettings)
    calibration: DataFrame | None = None  # label, slope, intercept

    @staticmethod
    def log(docs: DataFrame, labels: Column, tokens: Column, sign: int = 1, background: str = BACKGROUND, seq: str = "doc_id") -> DataFrame:
        """The training log: one row for each distinct label and one for the background. Bad labels stop the job."""
        bad = F.exists(labels, lambda x: x.isNull() | (x == "") | (x == background))
        checked = F.when(bad, F.raise_error(F.lit(str(BayesError("label_invalid", background))))).otherwise(F.array_distinct(labels))
        under = F.concat(F.array(F.lit(background)), F.coalesce(checked, F.array().cast("array<string>")))
        return docs.select(F.col(seq).cast("bigint").alias("seq"), F.explode(under).alias("category"), tokens.alias("tokens"), F.lit(sign).alias("sign"))

    @staticmethod
    def fit(log: DataFrame, settings: TagSettings | None = None, **model_settings) -> Tagger:
        return Tagger(Model.fit(log, **model_settings), settings or TagSettings())

    def labels(self) -> DataFrame:
        return self.model.categories.where((F.col("category") != self.settings.background) & (F.col("doc_count") > 0))

    @property
    def is_trained(self) -> bool:
        return not self.labels().isEmpty()

    def grid(self) -> list[Row]:
        """The labels in order, a row each, with the background's counts and the vocabulary's size beside them."""
        size = self.model.words().agg(F.count(F.lit(1)).alias("v"))
        rest = self.model.categories.where(F.col("category") == self.settings.background).select(F.col("doc_count").alias("n"), F.col("total_tokens").alias("t_all"))
        return sorted(self.labels().crossJoin(rest).crossJoin(size).collect(), key=lambda r: r["cat_order"])

    def vectors(self, docs: DataFrame) -> DataFrame:
        """(doc_id, odds) of ``docs(doc_id, tokens)``: (label, label_order, log_odds) of every label, in order."""
        grid, step = self.grid(), score.CATEGORIES_AT_ONCE
        parts = [self._part(docs, grid[k : k + step]) for k in range(0, len(grid), step)] or [docs.select("doc_id", F.array().cast(ODDS).alias("odds"))]
        return reduce(lambda a, b: a.join(b.withColumnRenamed("odds", "more"), "doc_id").select("doc_id", F.concat("odds", "more").alias("odds")), parts)

    def _part(self, docs: DataFrame, grid: list[Row]) -> DataFrame:
        a, tfidf, back = self.model.alpha, self.model.use_tfidf, self.settings.background
        words = self.model.words().withColumn("back", F.get(F.filter("cells", lambda c: c["category"] == back), F.lit(0))).where("back.doc_cnt > 0")
        words = words.withColumns({"df": F.col("back.doc_cnt"), "all": F.col("back.cnt")})
        counts = score.pivoted(words, [r["category"] for r in grid], "cnt", "all")

        def weight(i: int, r: Row) -> Column:
            below, below_rest = r["total_tokens"] + a * r["v"], max(r["t_all"] - r["total_tokens"], 0) + a * r["v"]
            if below <= 0 or below_rest <= 0:
                return F.lit(0.0)
            cnt = F.col(f"c{i}")
            ratio = F.log((cnt + a) / below) - F.log((F.greatest(F.col("all") - cnt, F.lit(0)) + a) / below_rest)
            return ratio * idf(F.lit(r["n"]), F.col("df")) if tfidf else ratio

        weights = counts.select("token", *(weight(i, r).cast("double").alias(f"w{i}") for i, r in enumerate(grid)))
        sums = score.weighted_sums(docs, weights, len(grid), term_factor if tfidf else lambda f: f.cast("double"))
        start = [math.log((r["doc_count"] + 1) / (max(r["n"] - r["doc_count"], 0) + 1)) for r in grid]
        made = (F.struct(F.lit(r["category"]).alias("label"), F.lit(r["cat_order"]).alias("label_order"), (F.lit(start[i]) + F.col("sums")[i]).alias("log_odds")) for i, r in enumerate(grid))
        return sums.select("doc_id", F.array(*made).cast(ODDS).alias("odds"))

    def log_odds(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, label_order, log_odds) of ``docs(doc_id, tokens)`` for every label."""
        return self.vectors(docs).select("doc_id", F.explode("odds").alias("o")).select("doc_id", "o.*")

    def probabilities(self, docs: DataFrame) -> DataFrame:
        odds = self.log_odds(docs)
        if self.calibration is None:
            return odds.select("doc_id", "label", "label_order", sigmoid(F.col("log_odds")).alias("probability"))
        fitted = odds.join(F.broadcast(self.calibration.select("label", "slope", "intercept")), "label", "left")
        value = F.coalesce("slope", F.lit(1.0)) * F.col("log_odds") + F.coalesce("intercept", F.lit(0.0))
        return fitted.select("doc_id", "label", "label_order", sigmoid(value).alias("probability"))

    def tag(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, probability, rank): labels over the threshold, best first, label order among equals."""
        order = Window.partitionBy("doc_id").orderBy(F.desc("probability"), "label_order")
        ranked = self.probabilities(docs).where(F.col("probability") >= self.settings.threshold).withColumn("rank", F.row_number().over(order))
        kept = ranked.where(F.col("rank") <= self.settings.max_tags) if self.settings.max_tags else ranked
        return kept.select("doc_id", "label", "probability", "rank")



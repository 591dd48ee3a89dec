"""A trained model: parameters and the statistics that scoring needs, as DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BayesError
from ..functions.tokenizers import WordTokenizer
from ..sources import scratch
from . import train, views

#: Kinds of models, and which of them may be loaded as which (fixed names); ``score.register_kind`` adds others.
KINDS = {
    "naive-bayes": {"naive-bayes", "multinomial-naive-bayes"},
    "multinomial-naive-bayes": {"naive-bayes", "multinomial-naive-bayes"},
    "bernoulli-naive-bayes": {"bernoulli-naive-bayes"},
    "complement-naive-bayes": {"complement-naive-bayes"},
}
FORMAT_VERSION = 1


@dataclass
class Model:
    cells: DataFrame
    categories: DataFrame
    kind: str = "multinomial-naive-bayes"
    name: str | None = None
    alpha: float = 1.0
    use_tfidf: bool = True
    spam_category: str = "spam"
    tokenizer: object = field(default_factory=WordTokenizer)
    temperature: float | None = None
    temperature_samples: int = 0
    extra: dict = field(default_factory=dict)
    histogram: DataFrame | None = None  # counts of counts (fam, category, val, cnt) that were stored with the model
    wide: DataFrame | None = None  # ``views.wide``, once it was asked for

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise BayesError("kind_mismatch", f"{self.kind}, one of {sorted(KINDS)}")
        if not (isinstance(self.alpha, int | float) and math.isfinite(self.alpha) and self.alpha > 0):
            raise BayesError("alpha_invalid", self.alpha)
        if self.temperature is not None and not (math.isfinite(self.temperature) and self.temperature > 0):
            raise BayesError("calibration_invalid", self.temperature)
        self.name = self.name or None

    @staticmethod
    def fit(log: DataFrame, **settings) -> Model:
        """The model of a training log (seq, category, tokens, sign): read once, its counts written to the shared folder."""
        return Model.of(scratch.kept(train.fold(log)), **settings)

    @staticmethod
    def of(folded: DataFrame, **settings) -> Model:
        """The model of ``train.fold``'s rows."""
        return Model(train.cells_of(folded), train.categories_of(folded), **settings)

    def with_(self, **settings) -> Model:
        return replace(self, **({"wide": None} if {"cells", "categories"} & set(settings) else {}) | settings)

    def words(self) -> DataFrame:
        """(token, df, g, cells): one row a token; written once and read by all that scores."""
        if self.wide is None:
            self.wide = scratch.kept(views.wide(self.cells))
        return self.wide

    def counts(self, *families: str) -> DataFrame:
        """The counts of counts of some families: the stored ones if the model has them all, else counted."""
        stored = (self.extra.get("histogram") or {}).get("families", [])
        if self.histogram is not None and set(families) <= set(stored):
            return self.histogram.where(F.col("fam").isin(*families))
        return views.histogram(self.cells, families)

    def as_kind(self, kind: str) -> Model:
        if kind not in KINDS[self.kind]:
            raise BayesError("kind_mismatch", f"{self.kind}, {kind}")
        return replace(self, kind=kind)

    @property
    def is_trained(self) -> bool:
        return not self.categories.isEmpty()

    @property
    def is_calibrated(self) -> bool:
        return self.temperature is not None

    def scalars(self) -> DataFrame:
        return views.scalars(self.words(), self.categories)

    def grid(self) -> DataFrame:
        """The categories with the scalars beside them: a few rows, one a category."""
        return self.categories.where("doc_count > 0").crossJoin(F.broadcast(self.scalars()))

    def tokenize(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        return docs.select(F.col(key).alias("doc_id"), self.tokenizer.column(F.col(text)).alias("tokens"))

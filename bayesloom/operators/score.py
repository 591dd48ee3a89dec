"""Scoring: every document against every category, one row a document.

A token's row holds its weight for each category. Documents' distinct tokens are counted within the row, joined once with
those rows by token, and summed by document: two exchanges, and nothing is multiplied by the categories. The model's grid
(a row a category) is small and becomes constants of the plan. A token that most documents hold makes one large join key,
which adaptive execution splits. The document's scores are an array, so that softmax and the best category need no window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import BayesError
from ..functions.maths import idf, inf, term_factor
from . import views
from .model import KINDS, Model
from .train import counted

#: Categories that are summed in one pass; more take several passes over the documents' tokens.
CATEGORIES_AT_ONCE = 100
MINUS = float("-inf")
SCORES = "array<struct<category:string,cat_order:int,log_score:double>>"


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, token, f) of ``docs(doc_id, tokens)``; a document without tokens has one row with a null token, f 0."""
    return counted(docs, "doc_id", outer=True)


def weighted_sums(docs: DataFrame, weights: DataFrame, n: int, factor: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, sums): for each document the sums over its tokens of factor(f) times each of the weights w0, w1, ... by token."""
    joined = term_counts(docs).join(weights, "token", "left")
    sums = [F.sum(F.coalesce(factor(F.col("f")) * F.col(f"w{i}"), F.lit(0.0))) for i in range(n)]
    return joined.groupBy("doc_id").agg(F.array(*sums).alias("sums"))


def prior(row: Row) -> Column:
    return F.log(F.lit(float(row["doc_count"])) / F.lit(float(row["n"]))) if row["doc_count"] > 0 and row["n"] > 0 else inf(-1)


def by_token(model: Model, grid: list[Row], count: str, weight: Callable[[Row, Column], Column]) -> DataFrame:
    """(token, w0, w1, ...): one row a token with a weight for each category of the grid."""
    return pivoted(model.words(), [r["category"] for r in grid], count).select("token", *(weight(r, F.col(f"c{i}")).cast("double").alias(f"w{i}") for i, r in enumerate(grid)))


def pivoted(words: DataFrame, categories: list[str], count: str, *more: str) -> DataFrame:
    """(token, df, g, more..., c0, c1, ...): the counts of some categories as columns of a token's row, 0 where it has none."""
    by = words.select("token", "df", "g", *more, F.map_from_entries(F.transform("cells", lambda c: F.struct(c["category"], c[count]))).alias("by"))
    return by.select("token", "df", "g", *more, *(F.coalesce(F.col("by")[c], F.lit(0)).alias(f"c{i}") for i, c in enumerate(categories)))


def _tf(model: Model) -> Callable[[Column], Column]:
    return term_factor if model.use_tfidf else lambda f: f.cast("double")


def multinomial(model: Model, docs: DataFrame, grid: list[Row]) -> DataFrame:
    def below(r: Row) -> float:
        return r["total_tokens"] + model.alpha * r["v"]

    def weight(r: Row, cnt: Column) -> Column:
        w = F.log((cnt + model.alpha) / below(r)) if below(r) > 0 else F.lit(0.0)
        return w * idf(F.lit(r["n"]), F.col("df")) if model.use_tfidf else w

    sums = weighted_sums(docs, by_token(model, grid, "cnt", weight), len(grid), _tf(model))
    return _rows(sums, grid, lambda i, r: prior(r) + F.col("sums")[i] if below(r) > 0 else inf(-1))


def absent_mass(model: Model) -> DataFrame:
    """(category, mass): the sum over the vocabulary of ln(1 - p), from counts of counts and the cells that are zero."""
    hist = model.counts("d").select("category", "val", "cnt")
    grid = F.broadcast(model.grid())
    held = hist.groupBy("category").agg(F.sum("cnt").alias("held"))
    zero = grid.join(held, "category", "left").select("category", F.lit(0).cast("bigint").alias("val"), (F.col("v") - F.coalesce("held", F.lit(0))).alias("cnt"))
    p = _presence(model, F.col("doc_count"), F.col("val"))
    mass = F.when((p > 0) & (p < 1), F.col("cnt") * F.log(1 - p)).otherwise(0.0)
    return hist.unionByName(zero).join(grid.select("category", "doc_count"), "category").groupBy("category").agg(F.sum(mass).alias("mass"))


def _presence(model: Model, doc_count: Column, doc_cnt: Column) -> Column:
    below = doc_count + 2 * model.alpha
    return F.when(below > 0, (doc_cnt + model.alpha) / below).otherwise(0.0)


def bernoulli(model: Model, docs: DataFrame, grid: list[Row]) -> DataFrame:
    mass = {r["category"]: r["mass"] for r in absent_mass(model).collect()}  # a row a category

    def weight(r: Row, doc_cnt: Column) -> Column:
        p = _presence(model, F.lit(r["doc_count"]), doc_cnt)
        return F.when((p > 0) & (p < 1), F.log(p) - F.log(1 - p)).otherwise(0.0)

    sums = weighted_sums(docs, by_token(model, grid, "doc_cnt", weight), len(grid), lambda f: (f > 0).cast("double"))
    return _rows(sums, grid, lambda i, r: prior(r) + F.lit(mass.get(r["category"], 0.0)) + F.col("sums")[i])


def complement_norms(model: Model) -> DataFrame:
    """(category, norm): the sum over the vocabulary of the absolute complement weights, from counts of counts."""
    below = F.col("g_total") - F.col("total_tokens") + model.alpha * F.col("v")
    counts = views.complement_counts(model.counts("g", "a", "k"), model.categories).join(F.broadcast(model.grid()), "category")
    weight = F.when(below > 0, F.col("cnt") * F.abs(F.log((F.col("val") + model.alpha) / below))).otherwise(0.0)
    return counts.groupBy("category").agg(F.sum(weight).alias("norm"))


def complement(model: Model, docs: DataFrame, grid: list[Row]) -> DataFrame:
    norms = {r["category"]: r["norm"] or 0.0 for r in complement_norms(model).collect()}  # a row a category

    def below(r: Row) -> float:
        return r["g_total"] - r["total_tokens"] + model.alpha * r["v"]

    def weight(r: Row, cnt: Column) -> Column:
        return F.log((F.greatest(F.col("g") - cnt, F.lit(0)) + model.alpha) / below(r)) if below(r) > 0 else F.lit(0.0)

    def score(i: int, r: Row) -> Column:
        if r["doc_count"] <= 0 or below(r) <= 0:
            return inf(-1)
        norm = norms.get(r["category"], 0.0)
        return -F.col("sums")[i] / norm if norm > 0 else F.lit(0.0)

    sums = weighted_sums(docs, by_token(model, grid, "cnt", weight), len(grid), lambda f: f.cast("double"))
    return _rows(sums, grid, score)


def _rows(sums: DataFrame, grid: list[Row], score: Callable[[int, Row], Column]) -> DataFrame:
    made = (F.struct(F.lit(r["category"]).alias("category"), F.lit(r["cat_order"]).alias("cat_order"), score(i, r).alias("log_score")) for i, r in enumerate(grid))
    return sums.select("doc_id", F.array(*made).cast(SCORES).alias("scores"))


#: How each kind scores; ``register_kind`` adds another.
LIKELIHOODS: dict[str, Callable[[Model, DataFrame, list[Row]], DataFrame]] = {"naive-bayes": multinomial, "multinomial-naive-bayes": multinomial, "bernoulli-naive-bayes": bernoulli, "complement-naive-bayes": complement}


def register_kind(kind: str, likelihood: Callable[[Model, DataFrame, list[Row]], DataFrame], loads_as: tuple[str, ...] = ()) -> None:
    """Add a kind of model with its own scoring; it loads as itself and as ``loads_as``."""
    unknown = set(loads_as) - set(KINDS)
    if not kind or not callable(likelihood) or unknown:
        raise BayesError("kind_unknown", kind if not unknown else sorted(unknown))
    KINDS[kind] = {kind, *loads_as}
    LIKELIHOODS[kind] = likelihood


def vectors(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, scores): one row for each id of ``docs(doc_id, tokens)``, ids being unique; the scores' elements are
    (category, cat_order, log_score) in the categories' order. An untrained model gives empty arrays."""
    if model.kind not in LIKELIHOODS:
        raise BayesError("kind_unknown", model.kind)
    grid = sorted(model.grid().collect(), key=lambda r: r["cat_order"])
    if not grid:
        return docs.select("doc_id", F.array().cast(SCORES).alias("scores"))
    parts = [LIKELIHOODS[model.kind](model, docs, grid[k : k + CATEGORIES_AT_ONCE]) for k in range(0, len(grid), CATEGORIES_AT_ONCE)]
    return reduce(lambda a, b: a.join(b.withColumnRenamed("scores", "more"), "doc_id").select("doc_id", F.concat("scores", "more").alias("scores")), parts)


def log_scores(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, category, cat_order, log_score) of ``docs(doc_id, tokens)``; no rows of an untrained model."""
    return vectors(model, docs).select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.*")


def softmax(found: DataFrame, temperature: float = 1.0) -> DataFrame:
    """``vectors`` with (category, cat_order, score) elements that sum to 1; none where all scores are -infinity. NaN never counts."""
    t = F.lit(float(temperature))
    good = found.withColumn("scores", F.filter("scores", lambda s: ~F.isnan(s["log_score"])))
    scaled = good.withColumn("top", F.array_max(F.transform("scores", lambda s: s["log_score"] / t)))
    e = scaled.withColumn("e", F.transform("scores", lambda s: F.exp(s["log_score"] / t - F.col("top"))))
    total = e.withColumn("total", F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x))
    shares = F.transform("scores", lambda s, i: F.struct(s["category"].alias("category"), s["cat_order"].alias("cat_order"), (F.get("e", i) / F.col("total")).alias("score")))
    none = F.array().cast("array<struct<category:string,cat_order:int,score:double>>")
    return total.select("doc_id", F.when(F.col("top") > MINUS, shares).otherwise(none).alias("scores"))


def distributions(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, scores) with (category, cat_order, score) elements, at the model's temperature."""
    return softmax(vectors(model, docs), model.temperature or 1.0)


def scores(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, category, cat_order, score) that sum to 1 by document."""
    return distributions(model, docs).select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.*")


def first_best(found: str = "scores") -> Column:
    """The (score, category) of the highest score, the first category in order among equals; null of none."""
    return F.array_max(F.transform(found, lambda s: F.struct(s["score"].alias("score"), (-s["cat_order"]).alias("order"), s["category"].alias("category"))))


def best(scored: DataFrame, value: str = "score") -> DataFrame:
    """(doc_id, category, value) of the highest value of a long table, the first category in order among equals, NaN never."""
    top = F.max_by(F.struct("category", value), F.struct(value, -F.col("cat_order")))
    return scored.where(~F.isnan(value)).groupBy("doc_id").agg(top.alias("b")).select("doc_id", "b.*")


def classify(model: Model, docs: DataFrame) -> DataFrame:
    """(doc_id, category, score, error): where no category can score a document, category and score are null and the error
    says ``untrained`` or ``unscorable``."""
    top = distributions(model, docs).select("doc_id", first_best().alias("b"))
    why = "unscorable" if model.is_trained else "untrained"
    return top.select("doc_id", "b.category", "b.score", F.when(F.col("b").isNull(), why).alias("error"))


def is_spam(model: Model, docs: DataFrame) -> DataFrame:
    return classify(model, docs).select("doc_id", F.coalesce(F.col("category") == model.spam_category, F.lit(False)).alias("is_spam"))

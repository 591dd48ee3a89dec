"""Ranking of candidates: the probability that context and candidate together belong to the positive category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BayesError
from . import score
from .model import Model

POSITIVE = "liked"


#: What trimming takes off at both ends (fixed values).
BLANKS = " \t\n\r\0\x0b"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def probes(contexts: DataFrame) -> DataFrame:
    """(ctx_id, candidate, position, text) of ``contexts(ctx_id, context, candidates)``: trimmed, blanks and repeats dropped.

    Each row's own list is made distinct in place, so that nothing is shuffled.
    """
    own = F.array_distinct(F.filter(F.transform("candidates", trimmed), lambda c: c != ""))
    each = contexts.select("ctx_id", "context", F.posexplode(own).alias("position", "candidate"))
    context = trimmed(F.array_join(F.coalesce("context", F.array().cast("array<string>")), " "))
    return each.select("ctx_id", "candidate", "position", trimmed(F.concat_ws(" ", context, "candidate")).alias("text"))


def check(model: Model, contexts: DataFrame, positive: str) -> None:
    """The errors in the order that callers see them: no candidate, no training, unknown category, only blank ones."""
    if contexts.where(F.coalesce(F.size("candidates"), F.lit(0)) <= 0).limit(1).count():
        raise BayesError("candidates_empty")
    if not model.is_trained:
        raise BayesError("untrained")
    if model.categories.where(F.col("category") == positive).isEmpty():
        raise BayesError("category_unknown", positive)
    if contexts.where(~F.exists("candidates", lambda c: trimmed(c) != "")).limit(1).count():
        raise BayesError("candidates_blank")


def recommend(model: Model, contexts: DataFrame, positive: str = POSITIVE, checked: bool = True) -> DataFrame:
    """(ctx_id, candidate, score, rank), best first, given order among equals."""
    if checked:
        check(model, contexts, positive)
    probe = probes(contexts)
    docs = probe.select(F.struct("ctx_id", "position", "candidate").alias("doc_id"), model.tokenizer.column(F.col("text")).alias("tokens"))
    own = F.get(F.filter("scores", lambda s: s["category"] == positive), F.lit(0))["score"]
    found = score.distributions(model, docs).select("doc_id.*", F.coalesce(own, F.lit(0.0)).alias("score"))
    order = Window.partitionBy("ctx_id").orderBy(F.desc("score"), "position")
    return found.select("ctx_id", "candidate", "score", F.row_number().over(order).alias("rank"))

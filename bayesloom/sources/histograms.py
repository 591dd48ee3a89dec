"""Counts of counts that are stored with a model and follow its cells.

    immediate   every batch takes the cells of its tokens out as they were and puts them in as they are
    deferred    a batch only journals its tokens, with their cells as they were last counted; ``maintain`` folds some or all
    periodic    nothing follows; ``maintain`` counts anew

The mode belongs to the model. No families, or that of documents alone, are cheap to follow and always immediate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BayesError
from ..operators import views
from ..operators.model import Model
from .registry import CELLS, Registry

MODES = ("immediate", "deferred", "periodic")


def mode_of(model: Model) -> tuple[str, tuple[str, ...]] | None:
    """(mode in effect, families) of a model that stores counts of counts."""
    state = model.extra.get("histogram")
    if state is None:
        return None
    families = tuple(state["families"])
    return ("immediate" if families in ((), ("d",)) else state["mode"]), families


def start(registry: Registry, name: str, mode: str = "immediate", families: tuple[str, ...] = views.FAMILIES) -> int:
    """Store the counts of a model from now on, in a mode; the next generation has them counted anew."""
    if mode not in MODES or set(families) - set(views.FAMILIES):
        raise BayesError("parameter_invalid", f"{mode}, {families}")
    at, model = registry.generation(name), registry.load(name)
    if model is None:
        raise BayesError("model_missing", name)
    state = {"mode": mode, "families": [f for f in views.FAMILIES if f in families]}
    return _save(registry, model.with_(extra=model.extra | {"histogram": state}), at, counted(model.cells, tuple(state["families"])), nothing(model.cells))


def counted(cells: DataFrame, families: tuple[str, ...]) -> DataFrame:
    return views.histogram(cells, families) if families else views.histogram(cells, ("d",)).limit(0)


def nothing(cells: DataFrame) -> DataFrame:
    return cells.select("category", "token", "cnt", "doc_cnt").limit(0)


def _save(registry: Registry, model: Model, at: int, histogram: DataFrame, pending: DataFrame) -> int:
    return registry.save(model, at, histogram=histogram.select("fam", "category", F.col("val").cast("bigint").alias("val"), F.col("cnt").cast("bigint").alias("cnt")), pending=pending.select("category", "token", "cnt", "doc_cnt"))


def pending(registry: Registry, name: str) -> DataFrame | None:
    """The journal: cells of touched tokens as they were last counted; a token without cells has a row without a category."""
    return registry._table(name, "pending", CELLS) if registry.generation(name) and registry.has_table(name, "pending") else None


def pending_tokens(registry: Registry, name: str) -> int:
    rows = pending(registry, name)
    return rows.select("token").distinct().count() if rows is not None else 0


def change(before: DataFrame, after: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Signed counts between two states of the cells of some tokens; a token's part in the counts is its own."""
    return counted(after, families).unionByName(counted(before, families).withColumn("cnt", -F.col("cnt")))


def applied(histogram: DataFrame, *changes: DataFrame) -> DataFrame:
    for c in changes:
        histogram = histogram.unionByName(c)
    return histogram.groupBy("fam", "category", "val").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def follow(registry: Registry, old: Model, new: Model, tokens: DataFrame) -> dict[str, DataFrame]:
    """The tables to save with ``new``, which a batch that touches ``tokens(token)`` made of ``old``."""
    found = mode_of(old)
    histogram, journal = registry.histogram(old.name), pending(registry, old.name)
    if found is None or histogram is None:
        return {}
    mode, families = found
    own = tokens.distinct()
    touched = lambda cells: cells.join(own, "token", "left_semi").select("category", "token", "cnt", "doc_cnt")
    if mode == "immediate":
        return {"histogram": applied(histogram, change(touched(old.cells), touched(new.cells), families)), "pending": nothing(new.cells)}
    if mode == "periodic":
        return {"histogram": histogram, "pending": nothing(new.cells)}
    fresh = own.join(journal.select("token"), "token", "left_anti")
    as_counted = fresh.join(old.cells, "token", "left").select("category", "token", "cnt", "doc_cnt")
    return {"histogram": histogram, "pending": journal.unionByName(as_counted)}


def maintain(registry: Registry, name: str, limit: int = 0) -> int:
    """Bring the stored counts up to date, all at once or for at most ``limit`` journalled tokens; how many are still to do."""
    at, model = registry.generation(name), registry.load(name)
    found = mode_of(model) if model else None
    if found is None:
        raise BayesError("model_missing", name)
    mode, families = found
    if mode == "immediate":
        return 0
    if mode == "periodic":
        _save(registry, model, at, counted(model.cells, families), nothing(model.cells))
        return 0
    journal = pending(registry, name)
    tokens = journal.select("token").distinct()
    some = tokens.orderBy("token").limit(limit) if limit else tokens
    before = journal.join(some, "token", "left_semi").where("category is not null")
    after = model.cells.join(some, "token", "left_semi").select("category", "token", "cnt", "doc_cnt")
    left = journal.join(some, "token", "left_anti")
    _save(registry, model, at, applied(registry.histogram(name), change(before, after, families)), left)
    return pending_tokens(registry, name)

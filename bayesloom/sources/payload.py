"""A model as one JSON document, and back: the portable form of a model of moderate size.

The document holds maps of tokens, so its size is that of the vocabulary; large models stay in the registry's tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BayesError
from ..functions import tokenizers
from ..operators.model import FORMAT_VERSION, KINDS, Model
from .registry import Registry, check_name

#: Cells of a model that may become one document.
MOST_CELLS = 5_000_000
CATEGORY = "struct<name:string,documentCount:bigint,tokenCounts:map<string,bigint>,tokenDocumentCounts:map<string,bigint>,totalTokens:bigint>"
SCHEMA = f"formatVersion int, kind string, name string, alpha double, useTfidf boolean, spamCategory string, tokenizer struct<class:string,config:string>, categories array<{CATEGORY}>, documentFrequency map<string,bigint>, totalDocuments bigint, calibration struct<temperature:double,samples:bigint>, extra string, tokenMode boolean"


def categories_of(model: Model) -> DataFrame:
    """(cat_order, category) rows with a category's counts as maps."""
    maps = model.cells.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("token", "cnt"))).alias("tokenCounts"), F.map_from_entries(F.collect_list(F.struct("token", "doc_cnt"))).alias("tokenDocumentCounts"))
    none = F.create_map().cast("map<string,bigint>")
    c = model.categories.join(maps, "category", "left")
    own = F.struct(F.col("category").alias("name"), F.col("doc_count").alias("documentCount"), F.coalesce("tokenCounts", none).alias("tokenCounts"), F.coalesce("tokenDocumentCounts", none).alias("tokenDocumentCounts"), F.col("total_tokens").alias("totalTokens"))
    return c.select("cat_order", own.alias("category"))


def export(model: Model, most: int = MOST_CELLS) -> DataFrame:
    """One row ``payload``: the JSON document. A model of more than ``most`` cells is refused: it would be one huge row."""
    n = model.cells.count()
    if n > most:
        raise BayesError("payload_too_large", f"{n}, at most {most}")
    state = tokenizers.export(model.tokenizer)
    calibration = F.struct(F.lit(model.temperature).alias("temperature"), F.lit(model.temperature_samples).alias("samples")) if model.temperature else F.lit(None).cast("struct<temperature:double,samples:bigint>")
    cats = categories_of(model).agg(F.transform(F.array_sort(F.collect_list(F.struct("cat_order", "category")), lambda a, b: a["cat_order"] - b["cat_order"]), lambda c: c["category"]).alias("categories"))
    df = model.cells.groupBy("token").agg(F.sum("doc_cnt").alias("df")).agg(F.map_from_entries(F.collect_list(F.struct("token", "df"))).alias("documentFrequency"))
    n = model.categories.agg(F.coalesce(F.sum("doc_count"), F.lit(0)).alias("totalDocuments"))
    lits = {"formatVersion": FORMAT_VERSION, "kind": model.kind, "name": model.name, "alpha": float(model.alpha), "useTfidf": model.use_tfidf, "spamCategory": model.spam_category}
    token = F.struct(F.lit(state["class"]).alias("class"), F.lit(state["config"]).alias("config"))
    doc = F.struct(*(F.lit(v).alias(k) for k, v in lits.items()), token.alias("tokenizer"), "categories", "documentFrequency", "totalDocuments", calibration.alias("calibration"), F.lit(json.dumps(model.extra)).alias("extra"))
    return cats.crossJoin(df).crossJoin(n).select(F.to_json(doc).alias("payload"))


def parse(payloads: DataFrame) -> DataFrame:
    """(p, ...) parsed documents; rows that aren't models have a null ``p``."""
    return payloads.withColumn("p", F.from_json("payload", SCHEMA))


def cells_of(payloads: DataFrame, key: str = "payload") -> DataFrame:
    """(category, token, cnt, doc_cnt) of the documents, negatives clamped to 0."""
    each = parse(payloads).select(F.explode("p.categories").alias("c"))
    rows = each.select(F.col("c.name").alias("category"), F.explode("c.tokenCounts").alias("token", "cnt"), F.col("c.tokenDocumentCounts").alias("d"))
    return rows.select("category", "token", F.greatest("cnt", F.lit(0)).alias("cnt"), F.greatest(F.coalesce(F.element_at("d", F.col("token")), F.lit(0)), F.lit(0)).cast("bigint").alias("doc_cnt"))


def load(payloads: DataFrame, kind: str | None = None) -> Model:
    """The model of one document; refuses other formats, other kinds and models of the token layout."""
    head = parse(payloads).select("p.formatVersion", "p.kind", "p.name", "p.alpha", "p.useTfidf", "p.spamCategory", "p.tokenizer", "p.calibration", "p.extra", "p.tokenMode", F.col("p.categories").isNotNull().alias("ok")).first()
    if head is None or head["kind"] not in KINDS or not (head["ok"] or head["tokenMode"]):
        raise BayesError("format_invalid", head and head["kind"])
    if (head["formatVersion"] or 1) > FORMAT_VERSION:
        raise BayesError("format_newer", head["formatVersion"])
    if head["tokenMode"]:
        raise BayesError("mode_mismatch", head["name"])
    cats = parse(payloads).select(F.posexplode("p.categories").alias("i", "c")).select(F.col("c.name").alias("category"), (F.col("i") + 1).cast("int").alias("cat_order"), F.greatest(F.col("c.documentCount"), F.lit(0)).cast("bigint").alias("doc_count"), F.greatest(F.coalesce("c.totalTokens", F.lit(0)), F.lit(0)).cast("bigint").alias("total_tokens"))
    calibration = head["calibration"]
    tokenizer = tokenizers.restore(head["tokenizer"].asDict()) if head["tokenizer"] else tokenizers.WordTokenizer()
    alpha = head["alpha"] if head["alpha"] and head["alpha"] > 0 else 1.0
    model = Model(cells_of(payloads), cats, head["kind"], head["name"], alpha, head["useTfidf"] is not False, head["spamCategory"] or "spam", tokenizer, calibration and calibration["temperature"], (calibration and calibration["samples"]) or 0, json.loads(head["extra"] or "{}"))
    return model.as_kind(kind) if kind else model


def read(spark: SparkSession, path: str) -> DataFrame:
    """(payload) of JSON files, a whole file each."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))


def convert_all(payloads: DataFrame, registry: Registry) -> list[str]:
    """Save every document's model in the registry under its own name; the names, in order. Documents without a name are refused."""
    named = parse(payloads).select("payload", F.col("p.name").alias("name"))
    names = sorted(r["name"] or "" for r in named.select("name").distinct().collect())  # a row a model
    for name in names:
        convert(named.where(F.col("name") == name).select("payload").limit(1), registry, check_name(name or None))
    return names


def convert(payloads: DataFrame, registry: Registry, name: str) -> int:
    """Save a document's model in the registry's tables."""
    return registry.save(load(payloads).with_(name=name))

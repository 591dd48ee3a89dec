"""Many models over one registry, and requests answered as a table: classify, recommend, tag."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import STATUS, BayesError
from ..operators import recommend as rec
from ..operators import score
from ..operators.model import Model
from ..operators.tag import Tagger
from ..sources.registry import Storage

REQUEST = "req_id bigint, action string, text string, category string, context array<string>, candidates array<string>"


@dataclass
class Engine:
    """Models by name; the first one asked for, or ``default``, answers unnamed requests."""

    spark: SparkSession
    registry: Storage | None = None
    default: str | None = None
    models: dict[str, Model] = field(default_factory=dict)

    def model(self, name: str | None = None) -> Model:
        name = name or self.default or next(iter(self.models), None)
        if name is None:
            raise BayesError("model_missing", name)
        if name not in self.models:
            found = self.registry.load(name) if self.registry else None
            if found is None:
                raise BayesError("model_missing", name)
            self.models[name] = found
        return self.models[name]

    def refresh(self, name: str | None = None) -> Engine:
        """Forget models that came from the registry, so that the next use reads their current generation."""
        for n in [name] if name else list(self.models):
            if self.registry is not None and self.registry.exists(n):
                self.models.pop(n, None)
        return self

    def add(self, model: Model) -> Engine:
        self.models[model.name or "default"] = model
        return self

    def load_all(self) -> Engine:
        for name in self.registry.list() if self.registry else []:
            self.model(name)
        return self

    def score_all(self, docs: DataFrame) -> DataFrame:
        """(model, doc_id, category, score) of ``docs(doc_id, text)`` by every model held."""
        parts = [score.scores(m, m.tokenize(docs)).withColumn("model", F.lit(n)).select("model", "doc_id", "category", "score") for n, m in self.models.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def parse(bodies: DataFrame) -> DataFrame:
    """Requests of ``bodies(req_id, body)`` JSON documents, with ``malformed``: a list may be one scalar; text, category and
    action must be scalars, and lists of lists or objects are refused."""
    rows = bodies.select("req_id", F.try_parse_json("body").alias("v"))
    part = lambda c, kind: F.try_variant_get("v", f"$.{c}", kind)
    shape = lambda c: F.coalesce(F.schema_of_variant(part(c, "variant")), F.lit("VOID"))
    many = lambda c: F.when(shape(c).startswith("ARRAY"), part(c, "array<string>")).when(shape(c) != "VOID", F.array(part(c, "string")))
    bad = F.col("v").isNull()
    for c in ("action", "text", "category"):
        bad = bad | shape(c).rlike("^(ARRAY|OBJECT)")
    for c in ("context", "candidates"):
        bad = bad | shape(c).rlike("OBJECT|^ARRAY<ARRAY")
    singles = (part(c, "string").alias(c) for c in ("action", "text", "category"))
    return rows.select("req_id", *singles, many("context").alias("context"), many("candidates").alias("candidates"), F.coalesce(bad, F.lit(True)).alias("malformed"))


@dataclass
class Service:
    """Answers a table of requests with a table of responses: (req_id, status, error, response JSON)."""

    model: Model
    tagger: Tagger | None = None
    positive: str = rec.POSITIVE
    max_text_bytes: int = 65_536
    max_candidates: int = 100

    def respond(self, requests: DataFrame) -> DataFrame:
        malformed = F.col("malformed") if "malformed" in requests.columns else F.lit(False)
        r = requests.withColumn("action", F.coalesce("action", F.lit("classify")))
        too_long = F.octet_length(F.coalesce("text", F.lit(""))) > self.max_text_bytes if self.max_text_bytes else F.lit(False)
        size = F.coalesce(F.size("candidates"), F.lit(0))
        usable = F.exists(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: rec.trimmed(c) != "")
        ranks = F.col("action") == "recommend"
        known = ["classify", "recommend", *(["tag"] if self.tagger else [])]
        error = (
            F.when(malformed, "parameter_invalid")
            .when(~F.col("action").isin(known), "action_unknown")
            .when(F.lit(not self.model.is_trained) & (F.col("action") != "tag") | F.lit(self.tagger is not None and not self.tagger.is_trained) & (F.col("action") == "tag"), "untrained")
            .when(~ranks & F.col("text").isNull(), "parameter_invalid")
            .when(~ranks & too_long, "text_too_long")
            .when(ranks & (size <= 0), "candidates_empty")
            .when(ranks & (size > self.max_candidates) if self.max_candidates else F.lit(False), "candidates_too_many")
            .when(ranks & ~usable, "candidates_blank")
        )
        checked = r.withColumn("error", error)
        status = F.when(F.col("error").isNull(), 200)
        for code, number in STATUS.items():
            status = status.when(F.col("error") == code, number)
        status = status.otherwise(400)
        good = checked.where(F.col("error").isNull())
        parts = [self._classify(good.where("action = 'classify'")), self._recommend(good.where("action = 'recommend'"))]
        if self.tagger:
            parts.append(self._tag(good.where("action = 'tag'")))
        answers = parts[0]
        for p in parts[1:]:
            answers = answers.unionByName(p)
        return checked.select("req_id", status.alias("status"), "error").join(answers, "req_id", "left").select("req_id", "status", "error", "response")

    def _classify(self, requests: DataFrame) -> DataFrame:
        docs = requests.select(F.col("req_id").alias("doc_id"), self.model.tokenizer.column(F.col("text")).alias("tokens"))
        found = score.distributions(self.model, docs).where(F.size("scores") > 0)
        each = found.select("doc_id", F.transform("scores", lambda s: F.struct(s["category"], F.round(s["score"], 6))).alias("pairs"), score.first_best()["category"].alias("category"))
        body = F.struct("category", F.map_from_entries("pairs").alias("scores"), F.lit(self.model.is_calibrated).alias("calibrated"), (F.col("category") == self.model.spam_category).alias("isSpam"))
        return each.select(F.col("doc_id").alias("req_id"), F.to_json(body).alias("response"))

    def _recommend(self, requests: DataFrame) -> DataFrame:
        ranked = rec.recommend(self.model, requests.select(F.col("req_id").alias("ctx_id"), "context", "candidates"), self.positive, checked=False)
        each = ranked.groupBy("ctx_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate", "score"))), lambda s: F.struct(s["candidate"], F.round(s["score"], 6))).alias("pairs"))
        return each.select(F.col("ctx_id").alias("req_id"), F.to_json(F.struct(F.map_from_entries("pairs").alias("scores"))).alias("response"))

    def _tag(self, requests: DataFrame) -> DataFrame:
        docs = requests.select(F.col("req_id").alias("doc_id"), self.tagger.model.tokenizer.column(F.col("text")).alias("tokens"))
        each = self.tagger.tag(docs).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "probability"))), lambda s: F.struct(s["label"], F.round(s["probability"], 6))).alias("pairs"))
        with_none = docs.select("doc_id").join(each, "doc_id", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<label:string,col2:double>>")))
        body = F.struct(F.map_from_entries("pairs").alias("tags"), F.lit(self.tagger.calibration is not None).alias("calibrated"))
        return with_none.select(F.col("doc_id").alias("req_id"), F.to_json(body).alias("response"))

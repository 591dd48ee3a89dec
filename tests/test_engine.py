"""Hand-computed numbers, equivalences and rules of the engine."""

from __future__ import annotations

import json
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark
import pytest
from conftest import ROOT, SF
from pyspark.sql import functions as F

from bayesloom.catalog import CATALOG
from bayesloom.errors import BayesError
from bayesloom.functions import maths, tokenizers
from bayesloom.functions.tokenizers import ChainTokenizer, NGramTokenizer, RegexTokenizer, WordTokenizer
from bayesloom.operators import calibrate, metrics, recommend, score, train, views
from bayesloom.operators.model import Model
from bayesloom.operators.tag import Tagger, TagSettings
from bayesloom.plans.engine import Engine, Service
from bayesloom.sources import histograms, jdbc, payload
from bayesloom.sources.jdbc import JdbcRegistry, encode_token
from bayesloom.sources.registry import MemoryRegistry, Registry
from bayesloom.streaming import trainer

SPAM = [
    ("spam", "cheap pills buy now cheap watches"),
    ("spam", "lowest prices order now limited offer"),
    ("spam", "free money fast click here"),
    ("ham", "project meeting agenda tomorrow morning"),
    ("ham", "please review the quarterly report"),
    ("ham", "deployment finished staging looks healthy"),
]
KINDS = ["multinomial-naive-bayes", "bernoulli-naive-bayes", "complement-naive-bayes"]


def log_of(spark, rows, sign=1):
    rows = [(i, c, t if isinstance(t, list) else t.lower().split(), sign) for i, (c, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "seq bigint, category string, tokens array<string>, sign int")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t if isinstance(t, list) else t.lower().split()) for i, t in enumerate(rows)], "doc_id bigint, tokens array<string>")


def scores_of(model, docs):
    return {(r["doc_id"], r["category"]): r["score"] for r in score.scores(model, docs).collect()}


def tokens(spark, tokenizer, text):
    return spark.createDataFrame([(text,)], "t string").select(tokenizer.column(F.col("t")).alias("t")).first()[0]


def test_tokenizers(spark):
    assert tokens(spark, WordTokenizer(), "Free viagra, A b2 x!") == ["free", "viagra", "b2"]
    assert tokens(spark, WordTokenizer(1, ["the"]), "The Cat a") == ["cat", "a"]
    assert tokens(spark, RegexTokenizer(r"#(\w+)", False), "#Ab c #d") == ["Ab", "d"]
    assert tokens(spark, RegexTokenizer(r"\w+"), "Ab c") == ["ab", "c"]
    assert tokens(spark, NGramTokenizer(3), "hi") == ["hi "]
    assert tokens(spark, NGramTokenizer(3, pad=False), "hi") == []
    assert tokens(spark, NGramTokenizer(3, pad=False), "hello") == ["hel", "ell", "llo"]
    assert tokens(spark, NGramTokenizer(1), "abc") == ["a", "b", "c"]
    assert tokens(spark, NGramTokenizer(3), "abc") == ["a  ", "ab ", "abc", " bc", "  c"]
    assert tokens(spark, NGramTokenizer(2, characters=False), "one two three") == ["one two", "two three"]
    assert tokens(spark, NGramTokenizer(2, characters=False), "one") == []
    chain = ChainTokenizer([WordTokenizer(), NGramTokenizer(2, pad=False)])
    assert tokens(spark, chain, "ab cd") == ["ab", "cd", "ab", "b ", " c", "cd"]
    for t in (WordTokenizer(), chain, RegexTokenizer()):
        for text in (None, "", " "):
            assert [x for x in tokens(spark, t, text) if x.strip()] == []
    assert tokenizers.restore(tokenizers.export(chain)) == chain
    with pytest.raises(BayesError):
        tokenizers.restore({"class": "other"})
    with pytest.raises(BayesError):
        WordTokenizer(pattern="[")
    tokenizers.register_sql(spark)
    assert spark.sql("select bayes_words('Ab c de')").first()[0] == ["ab", "de"]


def test_a_tokenizer_of_ones_own(spark, tmp_path):
    from dataclasses import dataclass

    @dataclass
    class Lines:
        mark: str = "\n"

        def column(self, text):
            return F.split(text, self.mark)

    tokenizers.register("lines", Lines)
    reg = Registry(spark, f"file://{tmp_path}")
    reg.save(Model.fit(log_of(spark, SPAM), name="m", tokenizer=Lines(";")))
    back = reg.load("m")
    assert back.tokenizer == Lines(";") and tokens(spark, back.tokenizer, "a;b") == ["a", "b"]
    plan = back.words()._jdf.queryExecution().executedPlan().toString()
    assert all("/words/" in f for f in back.words().inputFiles()) and "Exchange" not in plan  # stored a row a token: nothing is counted again
    for bad in (("word", Lines), ("x", dict), ("", Lines)):
        with pytest.raises(BayesError):
            tokenizers.register(*bad)


def test_multinomial_number(spark):
    m = Model.fit(log_of(spark, [("spam", ["a", "a", "b"]), ("ham", ["b", "c"])]), use_tfidf=False)
    got = scores_of(m, docs_of(spark, [["a"]]))
    a, b = 0.5 * 3 / 6, 0.5 * 1 / 5
    assert got[0, "spam"] == pytest.approx(a / (a + b), abs=1e-9)


def test_bernoulli_number(spark):
    m = Model.fit(log_of(spark, [("spam", ["a", "b"]), ("ham", ["b", "c"])]), kind="bernoulli-naive-bayes")
    assert scores_of(m, docs_of(spark, [["a"]]))[0, "spam"] == pytest.approx(0.8, abs=1e-9)


def test_complement_symmetry_and_ties(spark):
    m = Model.fit(log_of(spark, [("spam", ["a"]), ("ham", ["b"])]), kind="complement-naive-bayes", use_tfidf=False)
    got = scores_of(m, docs_of(spark, [["a"], ["b"], ["zzz"], []]))
    assert got[0, "spam"] == pytest.approx(got[1, "ham"], abs=1e-12) and got[0, "spam"] > got[0, "ham"]
    assert got[2, "spam"] == pytest.approx(0.5) and got[3, "ham"] == pytest.approx(0.5)
    first = {r["doc_id"]: r["category"] for r in score.classify(m, docs_of(spark, [["zzz"]])).collect()}
    assert first == {0: "spam"}  # the first trained category wins a tie


def test_bernoulli_equals_the_literal_sum(spark):
    rows = [("a", "alpha beta gamma delta epsilon"), ("a", "alpha beta zeta"), ("b", "eta theta iota kappa"), ("b", "eta theta lambda mu")]
    m = Model.fit(log_of(spark, rows), kind="bernoulli-naive-bayes", alpha=0.7)
    got = {r["category"]: r["log_score"] for r in score.log_scores(m, docs_of(spark, [["alpha", "beta", "eta", "unseen"]])).collect()}
    vocab = {w for _, t in rows for w in t.split()}
    for c in "ab":
        own = [set(t.split()) for k, t in rows if k == c]
        total = math.log(0.5)
        for w in vocab:
            p = (sum(w in d for d in own) + 0.7) / (len(own) + 1.4)
            total += math.log(p if w in ("alpha", "beta", "eta") else 1 - p)
        assert got[c] == pytest.approx(total, abs=1e-12)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("tfidf", [False, True])
def test_untrained_equals_never_trained(spark, kind, tfidf):
    more = log_of(spark, [*SPAM, ("news", "election results tomorrow morning")]).withColumn("seq", F.col("seq"))
    undo = log_of(spark, [("news", "election results tomorrow morning")], -1).withColumn("seq", F.lit(99).cast("bigint"))
    docs = docs_of(spark, ["cheap prices now", "review the election results", "words nobody trained"])
    a = scores_of(Model.fit(more.unionByName(undo), kind=kind, alpha=0.7, use_tfidf=tfidf), docs)
    b = scores_of(Model.fit(log_of(spark, SPAM), kind=kind, alpha=0.7, use_tfidf=tfidf), docs)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_replay_clamps_in_order(spark):
    log = spark.createDataFrame([(1, "s", ["a"], -1), (2, "s", ["a"], 1)], "seq bigint, category string, tokens array<string>, sign int")
    assert [tuple(r) for r in train.replay(log).collect()] == [("s", "a", 1, 1)]
    assert train.cells(log).collect() == []


def test_histograms(spark):
    cells = spark.createDataFrame([("spam", "cheap", 3, 2), ("ham", "cheap", 1, 1), ("spam", "pills", 1, 1), ("ham", "team", 2, 2)], "category string, token string, cnt bigint, doc_cnt bigint")
    keys = {r[0]: r[1] for r in views.histogram(cells).select(views.encode_key(), "cnt").collect()}
    assert keys == dict.fromkeys(["d2:spam", "d1:spam", "d1:ham", "d2:ham", "g4", "g1", "g2", "a4:spam", "a1:spam", "a4:ham", "a2:ham", "k1:spam", "k0:spam", "k3:ham", "k0:ham"], 1)
    cats = spark.createDataFrame([("spam",), ("ham",), ("new",)], "category string")
    got = {}
    for r in views.complement_counts(views.histogram(cells), cats).collect():
        got.setdefault(r["category"], {})[r["val"]] = r["cnt"]
    assert got == {"spam": {0: 1, 1: 1, 2: 1}, "ham": {0: 1, 1: 1, 3: 1}, "new": {1: 1, 2: 1, 4: 1}}
    after = cells.where("token <> 'cheap' or category <> 'spam'").unionAll(spark.createDataFrame([("spam", "cheap", 4, 3), ("spam", "new", 1, 1)], cells.schema))
    delta = {r[0]: r[1] for r in views.histogram_delta(cells, after).select(views.encode_key(), "cnt").collect()}
    assert delta == {"d2:spam": -1, "d3:spam": 1, "d1:spam": 1, "g4": -1, "g5": 1, "g1": 1, "a4:spam": -1, "a5:spam": 1, "a1:spam": 1, "k0:spam": 1, "a4:ham": -1, "a5:ham": 1, "k3:ham": -1, "k4:ham": 1}


def test_metrics(spark):
    pairs = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b")], "expected string, predicted string")
    assert metrics.overall(metrics.confusion(pairs)).first()["macro_precision"] == pytest.approx(0.75)
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    two = spark.createDataFrame([("a", "a"), ("b", "b")], "expected string, predicted string")
    row = metrics.overall(metrics.confusion(two, labels)).first()
    assert row["macro_f1"] == pytest.approx(2 / 3) and row["accuracy"] == 1
    with pytest.raises(BayesError):
        metrics.confusion(two, labels.where("label = 'a'"))
    half = spark.createDataFrame([(0.5, True), (0.5, False)], "p double, y boolean")
    r = half.agg(metrics.binary_log_loss(F.col("p"), F.col("y")), metrics.brier(F.col("p"), F.col("y"))).first()
    assert r[0] == pytest.approx(-math.log(0.5)) and r[1] == pytest.approx(0.25)
    ten = spark.createDataFrame([(0.9, i < 5) for i in range(10)], "p double, y boolean")
    assert metrics.calibration_error(ten).first()[0] == pytest.approx(0.4)
    assert metrics.calibration_error(ten.limit(0)).first()[0] == 0
    empty = metrics.overall(metrics.confusion(two.limit(0), labels)).first()
    assert empty["accuracy"] == 0 and empty["macro_f1"] == 0


def test_temperature_fit(spark):
    rows = [(i, c, 0.0 if c == win else -6.0) for i in range(200) for win in [("a", "b")[i % 2]] for c in ("a", "b")]
    scores = spark.createDataFrame(rows, "doc_id bigint, category string, log_score double")
    truth = spark.createDataFrame([(i, ("a", "b")[(i % 2) ^ (i // 2 % 5 == 0)]) for i in range(200)], "doc_id bigint, label string")
    t = calibrate.fit_temperature(scores, truth)
    assert t.value == pytest.approx(6 / math.log(4), abs=1e-4) and t.samples == 200
    with pytest.raises(BayesError):
        calibrate.fit_temperature(scores, truth.limit(0))


def test_platt_fit(spark):
    v = spark.createDataFrame([("x", (i - 50) / 10, i >= 50) for i in range(100)] + [("y", 8.0 if i % 2 else -8.0, (i // 2 % 5 != 0) == bool(i % 2)) for i in range(200)], "label string, value double, positive boolean")
    fit = {r["label"]: r for r in calibrate.fit_platt(v).collect()}
    apply = lambda label, x: 1 / (1 + math.exp(-(fit[label]["slope"] * x + fit[label]["intercept"])))
    assert fit["x"]["slope"] > 0 and apply("x", 3) > 0.9 and apply("x", -3) < 0.1 and abs(apply("x", 0) - 0.5) < 0.1
    assert fit["y"]["slope"] < 1 and abs(apply("y", 8) - 0.8) < 0.05 and abs(apply("y", -8) - 0.2) < 0.05


TAGGED = [
    (["php", "security"], "validate every request parameter before it reaches the sql query"),
    (["php"], "composer autoloads the classes of the namespace"),
    (["security"], "rotate the password and revoke the leaked token"),
    (["cooking"], "simmer the tomato sauce for twenty minutes"),
    (["cooking"], "whisk the eggs and fold in the flour"),
    ([], "the meeting moved to tuesday afternoon"),
]


def tagger_of(spark, **settings):
    docs = spark.createDataFrame([(i, ls, t.split()) for i, (ls, t) in enumerate(TAGGED)], "doc_id bigint, labels array<string>, tokens array<string>")
    return Tagger.fit(Tagger.log(docs, F.col("labels"), F.col("tokens")), TagSettings(**settings))


def test_tagger(spark):
    t = tagger_of(spark)
    p = {(r["doc_id"], r["label"]): r["probability"] for r in t.probabilities(docs_of(spark, ["xx yy", "escape the parameters of every sql query"])).collect()}
    assert p[0, "php"] == pytest.approx(1 / (1 + math.exp(-math.log(3 / 5))), abs=1e-12)
    assert p[1, "cooking"] < 0.5
    tags = [(r["label"], r["rank"]) for r in t.tag(docs_of(spark, ["escape the parameters of every sql query"])).orderBy("rank").collect()]
    assert tags == [("php", 1), ("security", 2)]
    assert tagger_of(spark, max_tags=1).tag(docs_of(spark, ["sql query request parameter"])).count() == 1
    held = spark.createDataFrame([(0, ["php"], "the sql query".split()), (1, ["cooking"], "fold the flour".split()), (2, [], ["tuesday"])], "doc_id bigint, labels array<string>, tokens array<string>")
    fitted = calibrate.calibrate_tagger(t, held)
    assert {r["label"] for r in fitted.calibration.collect()} == {"php", "cooking"}
    assert fitted.tag(held).count() >= 0
    assert TagSettings(float("nan")).threshold == 0.5 and TagSettings(9).threshold == 1
    with pytest.raises(Exception, match="labels must be"):
        Tagger.log(held, F.array(F.lit("*")), F.col("tokens")).collect()


def test_recommend(spark):
    rows = [("liked", "red shoes"), ("liked", "blue sneakers"), ("liked", "leather boots"), ("ignored", "red hat"), ("ignored", "blue scarf"), ("ignored", "leather belt")]
    m = Model.fit(log_of(spark, rows))
    ask = spark.createDataFrame([(1, ["red shoes", "leather belt"], ["red sneakers", "blue sneakers", " ", "red hat", "red hat", "leather wallet"])], "ctx_id bigint, context array<string>, candidates array<string>")
    got = [(r["candidate"], round(r["score"], 2)) for r in recommend.recommend(m, ask).orderBy("rank").collect()]
    assert got == [("red sneakers", 0.83), ("blue sneakers", 0.83), ("leather wallet", 0.5), ("red hat", 0.17)]
    for candidates, code in (([], "candidates_empty"), ([" "], "candidates_blank")):
        with pytest.raises(BayesError) as e:
            recommend.recommend(m, ask.withColumn("candidates", F.array(*map(F.lit, candidates)).cast("array<string>")))
        assert e.value.code == code
    with pytest.raises(BayesError):
        recommend.recommend(m, ask, "unknown")


def test_registry_and_payload(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}")
    m = Model.fit(log_of(spark, SPAM), name="spam-1", temperature=2.0, tokenizer=NGramTokenizer(2), extra={"x": 1})
    docs = docs_of(spark, ["cheap prices now"])
    want = scores_of(m, docs)
    assert reg.load("spam-1") is None and reg.save(m) == 1 and reg.list() == ["spam-1"]
    back = reg.load("spam-1")
    assert scores_of(back, docs) == pytest.approx(want) and back.tokenizer == m.tokenizer and back.extra == {"x": 1}
    assert reg.save(m, expected=1) == 2
    with pytest.raises(BayesError):
        reg.save(m, expected=1)
    with pytest.raises(BayesError):
        reg.load("spam-1", "bernoulli-naive-bayes")
    json = payload.export(m)
    assert scores_of(payload.load(json), docs) == pytest.approx(want)
    newer = json.select(F.regexp_replace("payload", '"formatVersion":1', '"formatVersion":9').alias("payload"))
    with pytest.raises(BayesError):
        payload.load(newer)
    with pytest.raises(BayesError):
        payload.load(spark.createDataFrame([("{oops",)], "payload string"))
    payload.convert(json, reg, "copy")
    assert reg.list() == ["copy", "spam-1"]
    reg.delete("copy")
    assert not reg.exists("copy")
    for bad in ("", ".x", "a/b", "a\\b", None):
        with pytest.raises(BayesError):
            reg.generation(bad)
    memory = MemoryRegistry()
    memory.save(m)
    assert memory.list() == ["spam-1"]


def test_stream_into_registry(spark, tmp_path):
    rows = log_of(spark, SPAM)
    for k in range(3):
        rows.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    reg = Registry(spark, f"file://{tmp_path}/models")
    for _ in range(2):  # the second run has nothing new to do
        trainer.train_stream(stream, reg, "m", f"{tmp_path}/cp", every=2).awaitTermination()
        assert reg.generation("m") in (1, 2)  # two batches are published, one is left
        assert trainer.publish(reg, "m", f"{tmp_path}/cp") == 2
    key = lambda df: sorted(map(tuple, df.select("category", "token", "cnt", "doc_cnt").collect()))
    assert key(reg.load("m").cells) == key(train.cells(rows))
    docs = docs_of(spark, ["cheap prices now"])
    assert scores_of(reg.load("m"), docs) == pytest.approx(scores_of(Model.fit(rows), docs))


def test_engine_and_service(spark):
    m = Model.fit(log_of(spark, SPAM), name="spam")
    engine = Engine(spark).add(m).add(m.with_(name="c", kind="complement-naive-bayes"))
    docs = spark.createDataFrame([(1, "cheap pills")], "doc_id bigint, text string")
    assert engine.score_all(docs).count() == 4
    ask = spark.createDataFrame([(1, None, "cheap pills now", None, None, None), (2, "classify", "x" * 99, None, None, None), (3, "nope", "x", None, None, None), (4, "recommend", None, None, [], []), (5, "tag", "sql query", None, None, None), (6, "classify", None, None, None, None)], "req_id bigint, action string, text string, category string, context array<string>, candidates array<string>")
    out = {r["req_id"]: r for r in Service(m, tagger_of(spark), max_text_bytes=50).respond(ask).collect()}
    assert '"category":"spam"' in out[1]["response"] and '"isSpam":true' in out[1]["response"]
    assert [out[i]["status"] for i in range(1, 7)] == [200, 413, 400, 400, 200, 400]
    with pytest.raises(BayesError):
        Engine(spark).model()


def test_rules(spark):
    with pytest.raises(BayesError):
        Model.fit(log_of(spark, SPAM), alpha=0)
    with pytest.raises(BayesError):
        train.require_rows(log_of(spark, SPAM).limit(0))
    untrained = Model.fit(log_of(spark, SPAM).limit(0))
    assert not untrained.is_trained and score.scores(untrained, docs_of(spark, ["a"])).count() == 0
    assert score.classify(untrained, docs_of(spark, ["a"])).first()["category"] is None


def test_log_space(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    inf = float("inf")
    assert val(maths.log_add(F.lit(math.log(2.0)), F.lit(math.log(3.0)))) == pytest.approx(math.log(5))
    assert val(maths.log_add(F.lit(-inf), F.lit(-inf))) == -inf
    assert val(maths.log_complement(F.lit(0.0))) == -inf
    assert val(maths.sigmoid(F.lit(-800.0))) == 0
    total = lambda rows: maths.log_sum(spark.createDataFrame([(x,) for x in rows], "x double"), "x").first()[0]
    assert total([-inf, 0.0, 0.0]) == pytest.approx(math.log(2)) and total([]) == -inf and total([-inf]) == -inf and total([inf, 1.0]) == inf
    keyed = spark.createDataFrame([("a", 1000.0), ("a", 1000.0), (None, -1000.0)], "k string, x double")
    assert {r["k"]: r["log_sum"] for r in maths.log_sum(keyed, "x", "k").collect()} == {"a": pytest.approx(1000 + math.log(2)), None: -1000.0}


def test_one_of_several_writers_publishes(spark, tmp_path):
    """Four writers add a document each, again and again; none is lost, and a stale one is refused."""
    from concurrent.futures import ThreadPoolExecutor

    reg = Registry(spark, f"file://{tmp_path}")
    cells = "category string, token string, cnt bigint, doc_cnt bigint"

    def more(old):
        n = 0 if old is None else old.categories.first()["doc_count"]
        return Model(spark.createDataFrame([("a", "x", n + 1, n + 1)], cells), spark.createDataFrame([("a", 1, n + 1, n + 1)], "category string, cat_order int, doc_count bigint, total_tokens bigint"), name="m")

    def writer(_):
        for _ in range(2):
            reg.update("m", more, attempts=50)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(writer, range(4)))
    assert reg.generation("m") == 8 and reg.load("m").categories.first()["doc_count"] == 8
    at = reg.generation("m")
    assert reg._publish("m", at + 1, "theirs") and not reg._publish("m", at + 1, "ours") and reg._read("m", f"_CURRENT-{at + 1}") == "theirs"
    (tmp_path / "m" / f"_CURRENT-{at + 1}").unlink()
    (tmp_path / "m" / "tables-lost").mkdir()  # a writer that died before it published
    assert reg.load("m").categories.first()["doc_count"] == 8
    own = reg._read("m", f"_CURRENT-{at}")
    for f in (tmp_path / "m" / f"tables-{own}" / "meta").glob("part-*"):
        f.write_bytes(b"no parquet")
    for f in (tmp_path / "m" / f"tables-{own}" / "meta").glob(".part-*"):
        f.unlink()
    assert reg.load("m") is None


def test_registry_tokens(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}")
    reg.save(Model.fit(log_of(spark, SPAM), name="m"))
    ask = spark.createDataFrame([("cheap",), ("cheap",), ("tomorrow",), ("never",)], "token string")
    assert sorted(tuple(r)[:3] for r in reg.tokens("m", ask).select("category", "token", "cnt").collect()) == [("ham", "tomorrow", 1), ("spam", "cheap", 2)]
    assert reg.tokens("m", ask.limit(0)).count() == 0


def test_stored_histograms(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}")
    as_set = lambda df: {tuple(r) for r in df.select("fam", "category", "val", "cnt").collect()}
    more = log_of(spark, [("spam", "cheap cheap meeting"), ("news", "election results")])

    def batch(name):
        old = reg.load(name)
        new = old.with_(cells=trainer.fold(old.cells, trainer.signed(more)), categories=trainer.fold_categories(old.categories, more), histogram=None)
        reg.save(new, reg.generation(name), **histograms.follow(reg, old, new, more.select(F.explode("tokens").alias("token"))))

    for mode in histograms.MODES:
        reg.save(Model.fit(log_of(spark, SPAM), name=mode))
        histograms.start(reg, mode, mode)
        first = as_set(reg.histogram(mode))
        assert first == as_set(views.histogram(reg.load(mode).cells))
        batch(mode)
        now = as_set(views.histogram(reg.load(mode).cells))
        assert as_set(reg.histogram(mode)) == (now if mode == "immediate" else first)
        assert histograms.pending_tokens(reg, mode) == (4 if mode == "deferred" else 0)
        if mode == "deferred":
            batch(mode)  # tokens that are journalled keep the cells they were counted with
            assert histograms.maintain(reg, mode, limit=3) == 1
        assert histograms.maintain(reg, mode) == 0
        m = reg.load(mode)
        assert as_set(reg.histogram(mode)) == as_set(views.histogram(m.cells)) and as_set(m.counts("d")) == as_set(views.histogram(m.cells, ("d",)))
        docs = docs_of(spark, ["cheap election"])
        for kind in ("bernoulli-naive-bayes", "complement-naive-bayes"):
            assert scores_of(m.with_(kind=kind), docs) == pytest.approx(scores_of(m.with_(kind=kind, histogram=None), docs))
    histograms.start(reg, "deferred", "deferred", ("d",))
    assert histograms.mode_of(reg.load("deferred")) == ("immediate", ("d",))
    with pytest.raises(BayesError):
        histograms.start(reg, "deferred", "sometimes")


@pytest.mark.parametrize("mode", ["token", "payload"])
def test_jdbc(spark, tmp_path, mode):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    reg = JdbcRegistry(spark, url, mode)
    m = Model.fit(log_of(spark, SPAM), name="m", tokenizer=NGramTokenizer(2), temperature=2.0)
    docs = docs_of(spark, ["cheap prices now"])
    assert reg.load("m") is None and not reg.exists("m")
    reg.save(m)
    reg.save(m)
    back = reg.load("m")
    assert scores_of(back, docs) == pytest.approx(scores_of(m, docs)) and back.tokenizer == m.tokenizer and reg.list() == ["m"]
    with pytest.raises(BayesError) as e:
        JdbcRegistry(spark, url, "payload" if mode == "token" else "token").load("m")
    assert e.value.code == "mode_mismatch"
    reg.delete("m")
    assert reg.list() == []
    for bad in ({"mode": "other"}, {"table": "x; drop"}, {"table": "t" * 49}):
        with pytest.raises(BayesError):
            JdbcRegistry(spark, url, **bad)
    key = spark.createDataFrame([("x" * 192,), ("y" * 191,)], "t string").select(encode_token(F.col("t"))).collect()
    assert len(key[0][0]) == 191 and key[0][0].startswith("x" * 150 + "~") and key[1][0] == "y" * 191


def run_on_cluster(tmp_path, code):
    """Run code in a process whose executor is another JVM; ``spark`` is its session."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    conf = {"spark.master": "local-cluster[1,2,1024]", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{tmp_path}/shared"}
    head = f"from pyspark.sql import SparkSession\nspark = SparkSession.builder.config(map={conf!r}).getOrCreate()\n"
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS")}
    env |= {"PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", head + code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)


def cluster_matches(tmp_path, query):
    cols = "category, token, cnt, doc_cnt"
    code = f"""import json
from bayesloom.catalog import CATALOG
rows = CATALOG[{query!r}].build(spark, {SF!r}).select(*{cols.split(", ")!r}).collect()
print("ROWS", json.dumps(sorted(map(list, rows))))"""
    run = run_on_cluster(tmp_path, code)
    assert run.returncode == 0, run.stderr[-3000:]
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{SF}/part.parquet'")
    want = con.sql(f"SELECT {cols} FROM ({CATALOG[query].sql})").fetchall()
    assert json.loads(run.stdout.rpartition("ROWS ")[2]) == sorted(map(list, want)) and want


def test_jdbc_payload_with_executors_of_their_own(tmp_path):
    cluster_matches(tmp_path, "jdbc_payload_cells")


def test_jdbc_cells_with_executors_of_their_own(tmp_path):
    cluster_matches(tmp_path, "jdbc_cells")


def test_jdbc_cells_in_lots(spark, tmp_path, monkeypatch):
    m = Model.fit(log_of(spark, SPAM), name="m")
    monkeypatch.setattr(jdbc, "LOT", 7)
    reg = JdbcRegistry(spark, f"jdbc:derby:{tmp_path}/db;create=true")
    reg.save(m)
    reg.save(Model.fit(log_of(spark, []), name="empty"))
    back, empty = reg.load("m"), reg.load("empty")
    cells = lambda x: sorted(tuple(r) for r in x.cells.select("category", "token", "cnt", "doc_cnt").collect())
    assert reg.embedded and cells(back) == cells(m) and len(cells(m)) > 21
    assert back.cells.inputFiles() and not cells(empty) and not empty.is_trained


def test_jdbc_cells_by_executors(spark, tmp_path):
    """The path of servers: here executors share the driver's JVM, and so its Derby."""
    m = Model.fit(log_of(spark, SPAM), name="m")
    reg = JdbcRegistry(spark, f"jdbc:derby:{tmp_path}/db;create=true", parts=3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    reg.embedded = False
    reg.save(m)
    back = reg.load("m")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(back.cells) == rows(m.cells.select(*back.cells.columns)) and not back.cells.inputFiles()
    assert rows(back.categories) == rows(m.categories.select(*back.categories.columns))


@pytest.mark.parametrize(("url", "embedded"), [("jdbc:derby:memory:x", True), ("jdbc:derby:/a/db;create=true", True), ("jdbc:derby://host:1527/db", False), ("jdbc:h2:mem:x", True), ("jdbc:h2:tcp://host/x", False), ("jdbc:hsqldb:file:x", True), ("jdbc:hsqldb:hsql://host/x", False), ("jdbc:sqlite:x.db", True), ("jdbc:postgresql://host/db", False), ("jdbc:mysql://host/h2:mem", False)])
def test_databases_of_one_process(url, embedded):
    assert JdbcRegistry(None, url, create=False).embedded is embedded


def test_saved_taggers(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}")
    t = tagger_of(spark, threshold=0.3, max_tags=2)
    reg.save_tagger(t, "plain")
    fitted = spark.createDataFrame([("php", 2.0, -0.5, 7), ("security", 1.0, 0.0, 3)], "label string, slope double, intercept double, samples bigint")
    reg.save_tagger(Tagger(t.model, t.settings, fitted), "fitted")
    docs = docs_of(spark, ["escape the parameters of every sql query"])
    plain, back = reg.load_tagger("plain"), reg.load_tagger("fitted")
    assert plain.settings == t.settings == back.settings and plain.calibration is None and reg.load_tagger("none") is None
    key = lambda x: {r["label"]: r["probability"] for r in x.probabilities(docs).collect()}
    assert key(plain) == pytest.approx(key(t)) and key(back) == pytest.approx(key(Tagger(t.model, t.settings, fitted)))
    assert calibrate.export_platt(back.calibration)["php"] == {"slope": 2.0, "intercept": -0.5, "samples": 7}
    assert calibrate.restore_platt(spark, {"a": {"slope": float("nan"), "intercept": 0}, "b": {"slope": "1"}, "c": {"slope": 1, "intercept": 0}}).count() == 1


def test_payloads_are_bounded_and_converted(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}")
    one, two = (payload.export(Model.fit(log_of(spark, SPAM), name=n)) for n in ("one", "two"))
    assert payload.convert_all(one.unionAll(two), reg) == ["one", "two"] == reg.list()
    with pytest.raises(BayesError) as e:
        payload.export(Model.fit(log_of(spark, SPAM)), most=3)
    assert e.value.code == "payload_too_large"


def test_a_kind_of_ones_own(spark):
    def flat(model, docs, grid):
        return score._rows(docs.select("doc_id"), grid, lambda i, r: F.lit(float(r["cat_order"])))

    score.register_kind("flat", flat)
    assert score.classify(Model.fit(log_of(spark, SPAM), kind="flat"), docs_of(spark, ["x"])).first()["category"] == "ham"
    with pytest.raises(BayesError):
        score.register_kind("other", flat, ("nothing",))


def test_many_categories_take_several_passes(spark, monkeypatch):
    m = Model.fit(log_of(spark, [*SPAM, ("news", "election results tomorrow"), ("x", "pills and reports")]))
    docs = docs_of(spark, ["cheap election pills", ""])
    want = scores_of(m, docs)
    monkeypatch.setattr(score, "CATEGORIES_AT_ONCE", 3)
    assert scores_of(m, docs) == pytest.approx(want)
    t, held = tagger_of(spark), docs_of(spark, ["sql query flour"])
    odds = {r["label"]: r["log_odds"] for r in t.log_odds(held).collect()}
    monkeypatch.setattr(score, "CATEGORIES_AT_ONCE", 1)
    assert {r["label"]: r["log_odds"] for r in t.log_odds(held).collect()} == pytest.approx(odds)


def test_counted_in_place(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "id int, tokens array<string>")
    rows = lambda **o: sorted(map(tuple, train.counted(df, "id", **o).collect()), key=repr)
    assert rows() == [(1, "a", 1), (1, "b", 2)]
    assert rows(outer=True) == [(1, "a", 1), (1, "b", 2), (2, None, 0), (3, None, 0)]
    assert rows(whole=True) == [(1, "a", 1), (1, "b", 2), (1, None, 3), (2, None, 0), (3, None, 0)]


def test_replay_of_many_blocks(spark):
    import random

    r = random.Random(6)
    rows = [(i, r.choice("ab"), [r.choice("xy") for _ in range(r.randrange(3))], r.choice((1, 1, -1))) for i in range(60)]
    want = {}
    for _, c, tokens, sign in rows:
        for t in set(tokens):
            cnt, docs = want.get((c, t), (0, 0))
            want[c, t] = (max(0, cnt + sign * tokens.count(t)), max(0, docs + sign))
    log = spark.createDataFrame(rows, "seq bigint, category string, tokens array<string>, sign int")
    for blocks in (1, 7, 1000):
        got = {(x["category"], x["token"]): (x["cnt"], x["doc_cnt"]) for x in train.replay(log, blocks).collect()}
        assert got == {k: v for k, v in want.items() if v[0] > 0}


def test_recommend_trims_before_it_compares(spark):
    ask = spark.createDataFrame([(1, None, ["a", " a", "\tb\n", "\x0b", "b"])], "ctx_id int, context array<string>, candidates array<string>")
    assert [(r["candidate"], r["text"]) for r in recommend.probes(ask).collect()] == [("a", "a"), ("b", "b")]


def test_requests_of_json(spark):
    from bayesloom.plans import engine

    bodies = ['{"text": "cheap pills"}', '{"action": "recommend", "context": "red", "candidates": ["hat", 5]}', '{"action": "recommend", "candidates": [["x"]]}', '{"text": {"a": 1}}', "{oops", '{"text": "[not a list"}']
    df = spark.createDataFrame(list(enumerate(bodies)), "req_id bigint, body string")
    got = {r["req_id"]: r for r in engine.parse(df).collect()}
    assert [got[i]["malformed"] for i in range(6)] == [False, False, True, True, True, False]
    assert got[1]["context"] == ["red"] and got[1]["candidates"] == ["hat", "5"] and got[5]["text"] == "[not a list"
    m = Model.fit(log_of(spark, SPAM), name="m")
    status = lambda model: {r["req_id"]: (r["status"], r["error"]) for r in Service(model).respond(engine.parse(df)).collect()}
    assert status(m)[0] == (200, None) and status(m)[3] == (400, "parameter_invalid")
    empty = Model.fit(log_of(spark, SPAM).limit(0))
    assert status(empty)[0] == (503, "untrained")
    row = score.classify(empty, docs_of(spark, ["a"])).first()
    assert row["error"] == "untrained" and row["category"] is None


def test_every_code_has_a_message():
    import re
    from pathlib import Path

    from bayesloom import errors

    root = Path(errors.__file__).parent
    text = "\n".join(p.read_text() for p in root.rglob("*.py") if "llm" not in p.parts and p.name != "errors.py")
    raised = set(re.findall(r'BayesError\("(\w+)"', text))
    named = set(re.findall(r'"(\w+)"', text))
    assert raised <= set(errors.CODES) and set(errors.CODES) <= named and set(errors.STATUS) <= set(errors.CODES)

"""Every query of the engine with the DuckDB SQL that gives the same rows.

Queries count, train on and score whole tables. Those of calibration and metrics hold documents out, since that is what
they measure: by id modulo 5, 0 is the test part, 1 is held out for the fit, 2 to 4 train.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce, maths, tokenizers
from .functions.tokenizers import ChainTokenizer, NGramTokenizer, RegexTokenizer, WordTokenizer
from .operators import calibrate, metrics, recommend, score, train, views
from .operators.model import Model
from .operators.tag import Tagger, TagSettings
from .plans.engine import Engine, Service, parse
from .sources import histograms, payload, scratch
from .sources.jdbc import JdbcRegistry, encode_token
from .sources.registry import Registry
from .streaming import trainer


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOG: dict[str, Query] = {}
STOP = ["the", "and", "de", "la", "der", "die", "que", "of", "to"]


def query(sql: str | None = None):
    def add(f):
        CATALOG[f.__name__] = Query(f, sql)
        return f

    return add


# What the queries read.


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log_of(docs: DataFrame) -> DataFrame:
    docs = docs if docs.isStreaming else scratch.spread(docs)
    return train.training_log(docs.where(F.col("lang").isNotNull()), F.col("lang"), WordTokenizer().column(F.col("text")))


def train_log(spark: SparkSession, d: str) -> DataFrame:
    return log_of(table(spark, d, "documents"))


def model(spark: SparkSession, d: str, **settings) -> Model:
    return Model.fit(train_log(spark, d), **settings)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return scratch.spread(table(spark, d, "documents")).select("doc_id", WordTokenizer().column(F.col("text")).alias("tokens"))


def evaluated(spark: SparkSession, d: str, held: bool = False, **settings) -> tuple[Model, DataFrame]:
    """A model of the training part, and the test part (or that held out for fitting) with its labels."""
    learned, aside, test = train.train_test(table(spark, d, "documents"))
    kept = scratch.spread(aside if held else test).where(F.col("lang").isNotNull())
    return Model.fit(log_of(learned), **settings), kept.select("doc_id", WordTokenizer().column(F.col("text")).alias("tokens"), F.col("lang").alias("label"))


def tokens_of(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    return docs.select(F.col(key), F.posexplode(tokens).alias("pos", "token"))


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# The same in SQL.

WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2)"


def unnested(key: str, tokens: str, source: str) -> str:
    return f"SELECT {key}, CAST(unnest(range(len(ts))) AS INTEGER) AS pos, unnest(ts) AS token FROM (SELECT {key}, {tokens} AS ts FROM {source})"


STATS = f"""train AS (SELECT doc_id AS seq, lang AS category, {WORDS} AS tokens FROM documents WHERE lang IS NOT NULL),"""
FOLD = """ex AS (SELECT seq, category, unnest(tokens) AS token FROM train),
cells AS (SELECT category, token, count(*) AS cnt, count(DISTINCT seq) AS doc_cnt FROM ex GROUP BY ALL),
cats AS (SELECT category, CAST(row_number() OVER (ORDER BY min(seq), category) AS INTEGER) AS cat_order, count(*) AS doc_count, CAST(sum(len(tokens)) AS BIGINT) AS total_tokens FROM train GROUP BY category),
vocab AS (SELECT token, CAST(sum(doc_cnt) AS BIGINT) AS df, CAST(sum(cnt) AS BIGINT) AS g FROM cells GROUP BY token),
sc AS (SELECT (SELECT CAST(sum(doc_count) AS BIGINT) FROM cats) AS n, (SELECT CAST(sum(total_tokens) AS BIGINT) FROM cats) AS gt, (SELECT count(*) FROM vocab) AS v)"""
BASE = f"WITH {STATS} {FOLD}"
LEARNED = BASE.replace("WHERE lang", "WHERE doc_id % 5 >= 2 AND lang")


def scored(kind: str = "mnb", part: int | None = None, tfidf: bool = True, alpha: float = 1.0, base: str = BASE, docs: str | None = None) -> str:
    """CTEs up to ``ls(doc_id, category, cat_order, log_score)``; ``part`` names one that was held out."""
    docs = docs or f"SELECT doc_id, lang AS label, {WORDS} AS tokens FROM documents" + ("" if part is None else f" WHERE doc_id % 5 = {part} AND lang IS NOT NULL")
    base = base if part is None else LEARNED
    head = f"{base}, td AS ({docs}), q AS (SELECT doc_id, token, count(*) AS f FROM (SELECT doc_id, unnest(tokens) AS token FROM td) GROUP BY ALL)"
    w = "(1 + ln(f)) * (ln((n + 1) / (df + 1)) + 1)" if tfidf else "f"
    if kind == "mnb":
        term, extra, out = f"{w} * ln((coalesce(x.cnt, 0) + {alpha}) / (c.total_tokens + {alpha} * v))", "", "ln(c.doc_count / n) + coalesce(s, 0)"
    elif kind == "bnb":
        p = lambda x: f"(({x} + {alpha}) / (c.doc_count + 2 * {alpha}))"
        term = f"ln({p('coalesce(x.doc_cnt, 0)')}) - ln(1 - {p('coalesce(x.doc_cnt, 0)')})"
        extra = f", mass AS (SELECT c.category, sum(ln(1 - {p('coalesce(x.doc_cnt, 0)')})) AS mass FROM vocab CROSS JOIN cats c LEFT JOIN cells x ON x.token = vocab.token AND x.category = c.category GROUP BY ALL)"
        out = "ln(c.doc_count / n) + (SELECT mass FROM mass WHERE mass.category = c.category) + coalesce(s, 0)"
    else:
        weight = lambda: f"ln((vocab.g - coalesce(x.cnt, 0) + {alpha}) / (gt - c.total_tokens + {alpha} * v))"
        term = f"f * {weight()}"
        extra = f", norm AS (SELECT c.category, sum(abs({weight()})) AS norm FROM vocab CROSS JOIN cats c CROSS JOIN sc LEFT JOIN cells x ON x.token = vocab.token AND x.category = c.category GROUP BY ALL)"
        out = "-coalesce(s, 0) / (SELECT norm FROM norm WHERE norm.category = c.category)"
    sums = f"sums AS (SELECT q.doc_id, c.category, sum({term}) AS s FROM q JOIN vocab ON vocab.token = q.token CROSS JOIN cats c CROSS JOIN sc LEFT JOIN cells x ON x.token = q.token AND x.category = c.category GROUP BY ALL)"
    return f"{head}{extra}, {sums}, ls AS (SELECT td.doc_id, c.category, c.cat_order, {out} AS log_score FROM td CROSS JOIN cats c CROSS JOIN sc LEFT JOIN sums ON sums.doc_id = td.doc_id AND sums.category = c.category)"


def softmaxed(ctes: str, temperature: float = 1.0) -> str:
    return f"{ctes}, sm AS (SELECT doc_id, category, cat_order, e / sum(e) OVER (PARTITION BY doc_id) AS score FROM (SELECT *, exp((log_score - max(log_score) OVER (PARTITION BY doc_id)) / {temperature}) AS e FROM ls)), best AS (SELECT doc_id, category, score FROM sm QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cat_order) = 1)"


LS = "SELECT doc_id, category, round(log_score, 4) AS log_score FROM ls"


def log_score_rows(m: Model, spark: SparkSession, d: str) -> DataFrame:
    return score.log_scores(m, documents(spark, d)).select("doc_id", "category", r("log_score", 4).alias("log_score"))


def best_rows(m: Model, spark: SparkSession, d: str) -> DataFrame:
    return score.classify(m, documents(spark, d)).select("doc_id", "category", r("score").alias("score"))


BEST = "SELECT doc_id, category, round(score, 6) AS score FROM best"

# Tokenizers.


@query(unnested("doc_id", WORDS, "documents"))
def tokens_word(spark, d):
    return tokens_of(table(spark, d, "documents"), "doc_id", WordTokenizer().column(F.col("text")))


@query(unnested("doc_id", r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 3 AND NOT list_contains(" + str(STOP) + ", t))", "documents"))
def tokens_word_stop(spark, d):
    return tokens_of(table(spark, d, "documents"), "doc_id", WordTokenizer(3, STOP).column(F.col("text")))


@query(unnested("conv_id, turn", r"list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda t: t <> ''), lambda t: lower(t))", "conversations"))
def tokens_regex(spark, d):
    tokens = RegexTokenizer(r"/[\p{L}\p{N}]+/u").column(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(tokens).alias("pos", "token"))


@query(unnested("page_id", r"list_filter(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: t <> '')", "pages"))
def tokens_regex_group(spark, d):
    return tokens_of(table(spark, d, "pages"), "page_id", RegexTokenizer("<([a-zA-Z][a-zA-Z0-9]*)", lowercase=False).column(F.col("html")))


CLEAN = r"trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'))"


def char_sql(n: int, pad: bool) -> str:
    full = f"list_transform(range(1, greatest(length(s) - {n} + 2, 1)), lambda i: substring(s, CAST(i AS INTEGER), {n}))"
    if not pad:
        return f"CASE WHEN length(s) >= {n} THEN {full} ELSE [] END"
    lead = f"list_transform(range(1, {n}), lambda i: rpad(substring(s, 1, CAST(i AS INTEGER)), {n}, ' '))"
    trail = f"list_transform(range(1, {n}), lambda i: lpad(substring(s, CAST(length(s) - {n} + 1 + i AS INTEGER), CAST({n} - i AS INTEGER)), {n}, ' '))"
    return f"CASE WHEN length(s) >= {n} THEN list_concat(list_concat({lead}, {full}), {trail}) WHEN length(s) > 0 THEN [rpad(s, {n}, ' ')] ELSE [] END"


BENCH = f"(SELECT item_id, {CLEAN} AS s, {WORDS} AS w, text FROM benchmark)"
WORD2 = "CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: array_to_string(list_slice(w, i, i + 1), ' ')) ELSE [] END"


@query(unnested("item_id", char_sql(3, True), BENCH))
def tokens_char_ngram(spark, d):
    return tokens_of(table(spark, d, "benchmark"), "item_id", NGramTokenizer(3).column(F.col("text")))


@query(unnested("item_id", char_sql(4, False), BENCH))
def tokens_char_ngram_nopad(spark, d):
    return tokens_of(table(spark, d, "benchmark"), "item_id", NGramTokenizer(4, pad=False).column(F.col("text")))


@query(unnested("item_id", WORD2, BENCH))
def tokens_word_ngram(spark, d):
    return tokens_of(table(spark, d, "benchmark"), "item_id", NGramTokenizer(2, characters=False).column(F.col("text")))


@query(unnested("item_id", f"list_concat(w, {char_sql(3, False)})", BENCH))
def tokens_chain(spark, d):
    return tokens_of(table(spark, d, "benchmark"), "item_id", ChainTokenizer([WordTokenizer(), NGramTokenizer(3, pad=False)]).column(F.col("text")))


# Statistics.


@query(f"SELECT doc_id, token, count(*) AS f FROM (SELECT doc_id, unnest({WORDS}) AS token FROM documents) GROUP BY ALL")
def doc_term_frequency(spark, d):
    return score.term_counts(documents(spark, d)).where("f > 0")


@query(f"{BASE} SELECT token, df, g FROM vocab")
def document_frequency(spark, d):
    return views.vocabulary(train.cells(train_log(spark, d)))


@query(f"{BASE} SELECT n, gt AS g_total, v FROM sc")
def vocab_scalars(spark, d):
    return model(spark, d).scalars()


@query(f"{BASE} SELECT * FROM cats")
def category_stats(spark, d):
    return train.categories(train_log(spark, d))


CELLS = f"{BASE} SELECT category, token, cnt, doc_cnt FROM cells"


@query(CELLS)
def token_cells(spark, d):
    return train.cells(train_log(spark, d))


@query(f"{BASE} SELECT category, count(*) AS vocabulary_size FROM cells GROUP BY category")
def category_vocabulary_size(spark, d):
    return views.category_sizes(train.cells(train_log(spark, d)))


@query(f"{scored()} SELECT doc_id, token, round((1 + ln(f)) * (ln((n + 1) / (df + 1)) + 1), 6) AS weight FROM q JOIN vocab USING (token) CROSS JOIN sc")
def tfidf_weights(spark, d):
    m = model(spark, d)
    known = score.term_counts(documents(spark, d)).join(views.vocabulary(m.cells), "token").crossJoin(F.broadcast(m.scalars()))
    return known.select("doc_id", "token", r(maths.tfidf(F.col("f"), F.col("n"), F.col("df"))).alias("weight"))


HIST = {
    "d": "SELECT 'd' AS fam, category, doc_cnt AS val, count(*) AS cnt FROM cells GROUP BY ALL",
    "g": "SELECT 'g' AS fam, '' AS category, g AS val, count(*) AS cnt FROM vocab GROUP BY ALL",
    "a": "SELECT 'a' AS fam, category, g AS val, count(*) AS cnt FROM cells JOIN vocab USING (token) GROUP BY ALL",
    "k": "SELECT 'k' AS fam, category, g - cells.cnt AS val, count(*) AS cnt FROM cells JOIN vocab USING (token) GROUP BY category, g - cells.cnt",
}


def _hist(fam: str):
    def build(spark, d):
        return views.histogram(train.cells(train_log(spark, d)), (fam,))

    CATALOG[f"hist_{fam}"] = Query(build, f"{BASE} {HIST[fam]}")


for _fam in HIST:
    _hist(_fam)


@query(f"{BASE} SELECT c.category, vocab.g - coalesce(x.cnt, 0) AS val, count(*) AS cnt FROM vocab CROSS JOIN cats c LEFT JOIN cells x ON x.token = vocab.token AND x.category = c.category GROUP BY ALL")
def complement_counts(spark, d):
    m = model(spark, d)
    return views.complement_counts(m.counts("g", "a", "k"), m.categories)


@query(f"{BASE} SELECT 'd' || doc_cnt || ':' || category AS key, 'd' AS fam, category, doc_cnt AS val FROM cells GROUP BY ALL UNION ALL SELECT 'g' || g, 'g', '', g FROM vocab GROUP BY ALL")
def histogram_keys(spark, d):
    h = views.histogram(train.cells(train_log(spark, d)), ("d", "g")).select(views.encode_key().alias("key"))
    return h.select("key", views.decode_key().alias("k")).select("key", "k.*")


@query(f"{BASE} {' UNION ALL '.join(HIST.values())}")
def histogram_maintained(spark, d):
    log = train_log(spark, d)
    first, batch = log.where("seq % 2 = 0"), log.where("seq % 2 = 1")
    before, after = train.cells(first), train.cells(log)
    return trainer.maintain(before, after, views.histogram(before), batch)


# Scoring.


@query(f"{scored()} {LS}")
def mnb_log_scores(spark, d):
    return log_score_rows(model(spark, d), spark, d)


@query(f"{scored(tfidf=False)} {LS}")
def mnb_log_scores_raw_tf(spark, d):
    return log_score_rows(model(spark, d, use_tfidf=False), spark, d)


@query(f"{scored(alpha=0.25)} {LS}")
def mnb_log_scores_alpha(spark, d):
    return log_score_rows(model(spark, d, alpha=0.25), spark, d)


@query(f"{softmaxed(scored())} SELECT doc_id, category, round(score, 6) AS score FROM sm")
def mnb_scores(spark, d):
    return score.scores(model(spark, d), documents(spark, d)).select("doc_id", "category", r("score").alias("score"))


@query(f"{softmaxed(scored())} {BEST}")
def mnb_classify(spark, d):
    return best_rows(model(spark, d), spark, d)


SPAM_STATS = f"WITH train AS (SELECT doc_id AS seq, CASE WHEN toxic = 1 THEN 'spam' ELSE 'ham' END AS category, {WORDS} AS tokens FROM documents JOIN labels USING (doc_id)), {FOLD}"


@query(f"{softmaxed(scored(base=SPAM_STATS))} SELECT doc_id, category = 'spam' AS is_spam FROM best")
def is_spam(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    log = train.training_log(docs, F.when(F.col("toxic") == 1, "spam").otherwise("ham"), WordTokenizer().column(F.col("text")))
    return score.is_spam(Model.fit(log), documents(spark, d))


ROLE_STATS = f"WITH train AS (SELECT conv_id * 1000 + turn AS seq, role AS category, {WORDS} AS tokens FROM conversations WHERE role IS NOT NULL), {FOLD}"
ROLE_DOCS = f"SELECT conv_id * 1000 + turn AS doc_id, role AS label, {WORDS} AS tokens FROM conversations"


@query(f"{scored('cnb', base=ROLE_STATS, docs=ROLE_DOCS)} {LS}")
def cnb_roles(spark, d):
    turns = table(spark, d, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    log = train.training_log(turns.where("role is not null"), F.col("role"), WordTokenizer().column(F.col("text")))
    test = turns.select("doc_id", WordTokenizer().column(F.col("text")).alias("tokens"))
    found = score.log_scores(Model.fit(log, kind="complement-naive-bayes"), test)
    return found.select("doc_id", "category", r("log_score", 4).alias("log_score"))


@query(f"{scored('bnb')} SELECT category, round(mass, 4) AS mass FROM mass")
def bnb_absent_mass(spark, d):
    return score.absent_mass(model(spark, d)).select("category", r("mass", 4).alias("mass"))


@query(f"{scored('bnb')} {LS}")
def bnb_log_scores(spark, d):
    return log_score_rows(model(spark, d, kind="bernoulli-naive-bayes"), spark, d)


@query(f"{softmaxed(scored('bnb'))} {BEST}")
def bnb_classify(spark, d):
    return best_rows(model(spark, d, kind="bernoulli-naive-bayes"), spark, d)


@query(f"{scored('cnb')} SELECT category, round(norm, 4) AS norm FROM norm")
def cnb_norms(spark, d):
    return score.complement_norms(model(spark, d)).select("category", r("norm", 4).alias("norm"))


@query(f"{scored('cnb')} SELECT doc_id, category, round(log_score, 6) AS log_score FROM ls")
def cnb_log_scores(spark, d):
    m = model(spark, d, kind="complement-naive-bayes")
    return score.log_scores(m, documents(spark, d)).select("doc_id", "category", r("log_score").alias("log_score"))


@query(f"{softmaxed(scored('cnb'))} {BEST}")
def cnb_classify(spark, d):
    return best_rows(model(spark, d, kind="complement-naive-bayes"), spark, d)


# Withdrawal.

LESS = STATS.replace("WHERE lang", "WHERE doc_id % 5 <> 2 AND lang")


def signed_log(spark, d) -> DataFrame:
    """All documents, and a fifth of them withdrawn again."""
    log = train_log(spark, d)
    return log.unionByName(log.where("seq % 5 = 2").withColumn("sign", F.lit(-1)).withColumn("seq", F.col("seq") + 10**12))


@query(f"WITH {LESS} {FOLD} SELECT category, token, cnt, doc_cnt FROM cells")
def signed_fold_cells(spark, d):
    return train.cells(signed_log(spark, d))


@query(f"WITH {LESS} {FOLD} SELECT category, token, cnt, doc_cnt FROM cells")
def replayed_cells(spark, d):
    return train.replay(signed_log(spark, d))


@query(f"{scored(base=f'WITH {LESS} {FOLD}')} {LS}")
def untrain_equals_retrain(spark, d):
    return log_score_rows(Model.fit(signed_log(spark, d)), spark, d)


# Tagging.

TAGS = "list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)"
TAG_STATS = f"WITH train AS (SELECT doc_id AS seq, unnest(list_concat(['*'], {TAGS})) AS category, {WORDS} AS tokens FROM documents JOIN labels USING (doc_id)), {FOLD}"


def tag_ctes(part: int | None = None, probability: str = "1 / (1 + exp(-log_odds))") -> str:
    docs, stats = f"SELECT doc_id, {TAGS} AS labels, {WORDS} AS tokens FROM documents LEFT JOIN labels USING (doc_id)", TAG_STATS
    if part is not None:
        docs, stats = f"{docs.replace('LEFT JOIN', 'JOIN')} WHERE doc_id % 5 = {part}", stats.replace("USING (doc_id))", "USING (doc_id) WHERE doc_id % 5 >= 2)")
    return f"""{stats}, td AS ({docs}), q AS (SELECT doc_id, token, count(*) AS f FROM (SELECT doc_id, unnest(tokens) AS token FROM td) GROUP BY ALL),
bk AS (SELECT doc_count AS nb, total_tokens AS tb FROM cats WHERE category = '*'), lb AS (SELECT * FROM cats WHERE category <> '*'),
st AS (SELECT q.doc_id, c.category, sum((1 + ln(f)) * (ln((nb + 1) / (b.doc_cnt + 1)) + 1) * (ln((coalesce(x.cnt, 0) + 1) / (c.total_tokens + v)) - ln((b.cnt - coalesce(x.cnt, 0) + 1) / (tb - c.total_tokens + v)))) AS s
 FROM q JOIN cells b ON b.token = q.token AND b.category = '*' CROSS JOIN lb c CROSS JOIN bk CROSS JOIN sc LEFT JOIN cells x ON x.token = q.token AND x.category = c.category GROUP BY ALL),
lo AS (SELECT td.doc_id, td.labels, c.category AS label, c.cat_order AS label_order, ln((c.doc_count + 1) / (nb - c.doc_count + 1)) + coalesce(s, 0) AS log_odds FROM td CROSS JOIN lb c CROSS JOIN bk LEFT JOIN st ON st.doc_id = td.doc_id AND st.category = c.category),
pr AS (SELECT *, {probability} AS probability FROM lo)"""


def tagged(spark, d) -> DataFrame:
    labels = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return scratch.spread(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id").withColumn("labels", labels)


def tagger_of(docs: DataFrame, most: int = 1) -> Tagger:
    return Tagger.fit(Tagger.log(docs, F.col("labels"), WordTokenizer().column(F.col("text"))), TagSettings(0.5, most))


def tagger(spark, d, most: int = 1) -> Tagger:
    return tagger_of(tagged(spark, d), most)


def tags_evaluated(spark, d, held: bool = False) -> tuple[Tagger, DataFrame]:
    """A tagger of the training part, and the test part (or that held out for fitting) with its labels."""
    learned, aside, test = train.train_test(tagged(spark, d))
    return tagger_of(learned), (aside if held else test).select("doc_id", WordTokenizer().column(F.col("text")).alias("tokens"), "labels")


@query(f"{tag_ctes()} SELECT doc_id, label, round(log_odds, 4) AS log_odds FROM pr")
def tag_log_odds(spark, d):
    return tagger(spark, d).log_odds(documents(spark, d)).select("doc_id", "label", r("log_odds", 4).alias("log_odds"))


@query(f"{tag_ctes()} SELECT doc_id, label, round(probability, 6) AS probability FROM pr")
def tag_probabilities(spark, d):
    return tagger(spark, d).probabilities(documents(spark, d)).select("doc_id", "label", r("probability").alias("probability"))


@query(f"{tag_ctes()} SELECT doc_id, label, round(probability, 6) AS probability, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, label_order) AS INTEGER) AS rank FROM pr WHERE probability >= 0.5 QUALIFY rank <= 2")
def tag_topk(spark, d):
    return tagger(spark, d, 2).tag(documents(spark, d)).select("doc_id", "label", r("probability").alias("probability"), "rank")


# Recommendation.

PART_WORDS = WORDS.replace("text", "p_name || ' ' || p_type")
PART_STATS = f"WITH train AS (SELECT p_partkey AS seq, CASE WHEN p_size > 25 THEN 'liked' ELSE 'ignored' END AS category, {PART_WORDS} AS tokens FROM part), {FOLD}"
PROBES = f"SELECT p_brand || '|' || p_type AS doc_id, {WORDS} AS tokens FROM (SELECT DISTINCT b.p_brand, t.p_type, trim(b.p_brand) || ' ' || trim(t.p_type) AS text FROM part b CROSS JOIN (SELECT DISTINCT p_type FROM part) t)"


@query(f"{softmaxed(scored(base=PART_STATS, docs=PROBES))} SELECT split_part(doc_id, '|', 1) AS ctx_id, split_part(doc_id, '|', 2) AS candidate, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY split_part(doc_id, '|', 1) ORDER BY score DESC, split_part(doc_id, '|', 2)) AS INTEGER) AS rank FROM sm WHERE category = 'liked'")
def recommend_rank(spark, d):
    part = table(spark, d, "part")
    log = train.training_log(part, F.when(F.col("p_size") > 25, "liked").otherwise("ignored"), WordTokenizer().column(F.concat_ws(" ", "p_name", "p_type")), "p_partkey")
    types = part.agg(F.sort_array(F.collect_set("p_type")).alias("candidates"))
    contexts = part.select(F.col("p_brand").alias("ctx_id")).distinct().select("ctx_id", F.array("ctx_id").alias("context")).crossJoin(F.broadcast(types))
    return recommend.recommend(Model.fit(log), contexts).select("ctx_id", "candidate", r("score").alias("score"), "rank")


# Metrics.

PAIRS = f"{softmaxed(scored('cnb', part=0))}, pairs AS (SELECT td.label AS expected, best.category AS predicted FROM td JOIN best USING (doc_id)), labs AS (SELECT expected AS l FROM pairs UNION SELECT predicted FROM pairs), cm AS (SELECT a.l AS expected, b.l AS predicted, (SELECT count(*) FROM pairs p WHERE p.expected = a.l AND p.predicted = b.l) AS n FROM labs a CROSS JOIN labs b), pl AS (SELECT l AS label, CASE WHEN pr = 0 THEN 'nan'::DOUBLE ELSE tp / pr END AS precision, CASE WHEN ex = 0 THEN 'nan'::DOUBLE ELSE tp / ex END AS recall FROM (SELECT l, (SELECT sum(n) FROM cm WHERE expected = l AND predicted = l) AS tp, (SELECT sum(n) FROM cm WHERE predicted = l) AS pr, (SELECT sum(n) FROM cm WHERE expected = l) AS ex FROM labs)), f AS (SELECT *, CASE WHEN isnan(precision) OR isnan(recall) THEN 'nan'::DOUBLE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pl)"


def pairs(spark, d) -> DataFrame:
    m, test = evaluated(spark, d, kind="complement-naive-bayes")
    found = score.classify(m, test)
    return test.select("doc_id", F.col("label").alias("expected")).join(found, "doc_id").select("expected", F.col("category").alias("predicted"))


@query(f"{PAIRS} SELECT * FROM cm")
def confusion_matrix(spark, d):
    return metrics.confusion(pairs(spark, d))


@query(f"{PAIRS} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def metrics_per_label(spark, d):
    return metrics.per_label(metrics.confusion(pairs(spark, d))).select("label", *(r(c).alias(c) for c in ("precision", "recall", "f1")))


_acc = "(SELECT sum(CASE WHEN expected = predicted THEN n ELSE 0 END) / sum(n) FROM cm)"


@query(f"{PAIRS} SELECT round({_acc}, 6) AS accuracy, round(avg(CASE WHEN isnan(precision) THEN 0 ELSE precision END), 6) AS macro_precision, round(avg(CASE WHEN isnan(recall) THEN 0 ELSE recall END), 6) AS macro_recall, round(avg(CASE WHEN isnan(f1) THEN 0 ELSE f1 END), 6) AS macro_f1, round({_acc}, 6) AS micro_precision, round({_acc}, 6) AS micro_recall, round({_acc}, 6) AS micro_f1 FROM f")
def metrics_macro_micro(spark, d):
    out = metrics.overall(metrics.confusion(pairs(spark, d)))
    return out.select(*(r(c).alias(c) for c in out.columns))


OUTCOMES = f"{tag_ctes(0)}, oc AS (SELECT probability AS p, list_contains(labels, label) AS y FROM pr)"


def outcomes(spark, d) -> DataFrame:
    t, test = tags_evaluated(spark, d)
    p = t.probabilities(test)
    return p.join(test.select("doc_id", "labels"), "doc_id").select(F.col("probability").alias("p"), F.array_contains("labels", F.col("label")).alias("y"))


@query(f"{OUTCOMES} SELECT round(avg(-ln(greatest(CASE WHEN y THEN p ELSE 1 - p END, 1e-300))), 4) AS log_loss FROM oc")
def log_loss(spark, d):
    return outcomes(spark, d).agg(r(metrics.binary_log_loss(F.col("p"), F.col("y")), 4).alias("log_loss"))


@query(f"{OUTCOMES} SELECT round(avg(power(p - CASE WHEN y THEN 1 ELSE 0 END, 2)), 6) AS brier FROM oc")
def brier(spark, d):
    return outcomes(spark, d).agg(r(metrics.brier(F.col("p"), F.col("y"))).alias("brier"))


ECE = "SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(p) AS p, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS y FROM oc GROUP BY least(9, greatest(0, floor(p * 10))))"


@query(f"{OUTCOMES} {ECE}")
def ece(spark, d):
    return metrics.calibration_error(outcomes(spark, d)).select(r("ece").alias("ece"))


DIST = softmaxed(scored("cnb", part=0))


@query(f"{DIST} SELECT round(avg(-ln(greatest(coalesce(score, 0), 1e-300))), 6) AS log_loss FROM td LEFT JOIN sm ON sm.doc_id = td.doc_id AND sm.category = td.label")
def distribution_log_loss(spark, d):
    m, test = evaluated(spark, d, kind="complement-naive-bayes")
    return metrics.distribution_log_loss(score.scores(m, test), test).select(r("log_loss").alias("log_loss"))


@query(f"{DIST}, oc AS (SELECT score AS p, category = label AS y FROM td JOIN best USING (doc_id)) {ECE}")
def distribution_ece(spark, d):
    m, test = evaluated(spark, d, kind="complement-naive-bayes")
    return metrics.distribution_calibration_error(score.scores(m, test), test.select("doc_id", "label")).select(r("ece").alias("ece"))


# Calibration.

GRID = [0.01, 0.1, 0.5, 1.0, 2.0, 10.0, 100.0]


def held_vectors(spark, d) -> DataFrame:
    m, held = evaluated(spark, d, held=True, kind="complement-naive-bayes")
    return calibrate.vectors(score.log_scores(m, held), held)


@query(f"{scored('cnb', part=1)}, own AS (SELECT ls.doc_id, max(log_score) AS top, max(CASE WHEN category = label THEN log_score END) AS own FROM ls JOIN td USING (doc_id) GROUP BY ls.doc_id), g AS (SELECT unnest({GRID}::DOUBLE[]) AS temperature) SELECT temperature, round(avg(nll), 6) AS nll FROM (SELECT temperature, least(ln(total) - (own - top) / temperature, -ln(1e-300)) AS nll FROM (SELECT temperature, own.doc_id, any_value(own.own) AS own, any_value(own.top) AS top, sum(exp((log_score - own.top) / temperature)) AS total FROM own JOIN ls ON ls.doc_id = own.doc_id CROSS JOIN g WHERE own.own IS NOT NULL GROUP BY temperature, own.doc_id)) GROUP BY temperature")
def temperature_grid_nll(spark, d):
    return calibrate.grid_nll(held_vectors(spark, d), GRID).select("temperature", r("nll").alias("nll"))


@query(f"{softmaxed(scored('cnb'), 0.5)} SELECT doc_id, category, round(score, 6) AS score FROM sm")
def temperature_apply(spark, d):
    m = model(spark, d, kind="complement-naive-bayes", temperature=0.5)
    return score.scores(m, documents(spark, d)).select("doc_id", "category", r("score").alias("score"))


@query(f"{scored('cnb', part=1)} SELECT count(DISTINCT td.doc_id) AS samples, true AS least FROM td JOIN ls ON ls.doc_id = td.doc_id AND ls.category = td.label")
def temperature_fit(spark, d):
    """How many documents the fit used, and whether no temperature of a wide grid has a lower loss than the fitted one."""
    held = scratch.kept(held_vectors(spark, d))
    t = calibrate.fit_vectors(held)
    grid = [math.exp(k / 10) for k in range(-46, 47)]
    losses = held.agg(*(F.avg(calibrate.nll(F.lit(x))).alias(f"t{k}") for k, x in enumerate([t.value, *grid]))).first()
    return spark.createDataFrame([(t.samples, losses[0] <= min(losses) + 1e-9)], "samples bigint, least boolean")


def platt_values(spark, d) -> DataFrame:
    t, held = tags_evaluated(spark, d, held=True)
    odds = t.log_odds(held)
    return odds.join(held.select("doc_id", "labels"), "doc_id").select("label", (F.col("log_odds") / 100).alias("value"), F.array_contains("labels", F.col("label")).alias("positive"))


@query(f"{tag_ctes(1)} SELECT category AS label, count(*) AS samples, true AS least FROM lb CROSS JOIN td GROUP BY category")
def platt_fit(spark, d):
    """For each label how many values the fit used, and whether nowhere on a grid around the fit the loss is lower."""
    values = scratch.kept(platt_values(spark, d))
    fit = calibrate.fit_platt(values)
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0.0, -0.2, -0.01, 0.01, 0.2) for b in (0.0, -0.5, -0.01, 0.01, 0.5)))
    losses = calibrate.platt_losses(values, fit.select("label", F.explode(steps).alias("s"), "slope", "intercept").select("label", (F.col("slope") + F.col("s.a")).alias("slope"), (F.col("intercept") + F.col("s.b")).alias("intercept"), ((F.col("s.a") == 0) & (F.col("s.b") == 0)).alias("own")))
    by_label = losses.groupBy("label").agg(F.min("loss").alias("least_loss"), F.max(F.when(F.col("own"), F.col("loss"))).alias("own_loss"))
    return by_label.join(fit, "label").select("label", "samples", (F.col("own_loss") <= F.col("least_loss") + 1e-6).alias("least"))


@query(f"{tag_ctes(1)}, v AS (SELECT label, log_odds / 100 AS value, list_contains(labels, label) AS y FROM pr), t AS (SELECT *, 0.7 * value - 0.1 AS z, CASE WHEN y THEN (sum(y::INT) OVER w + 1) / (sum(y::INT) OVER w + 2) ELSE 1 / (sum(1 - y::INT) OVER w + 2) END AS t FROM v WINDOW w AS (PARTITION BY label)) SELECT label, round(sum(greatest(z, 0) - z * t + ln(1 + exp(-abs(z)))), 4) AS loss, round(sum((1 / (1 + exp(-z)) - t) * value), 4) AS g_slope, round(sum(1 / (1 + exp(-z)) - t), 4) AS g_intercept FROM t GROUP BY label")
def platt_gradient(spark, d):
    g = calibrate.platt_gradient(platt_values(spark, d), 0.7, -0.1)
    return g.select("label", *(r(c, 4).alias(c) for c in ("loss", "g_slope", "g_intercept")))


# Storage, streams, requests.


def _folder(spark: SparkSession) -> str:
    return scratch.fresh_dir(spark, "registry")


@query(CELLS)
def payload_roundtrip(spark, d):
    return payload.cells_of(payload.export(model(spark, d, name="langs")))


@query(f"{BASE} SELECT category, cat_order, doc_count, total_tokens FROM cats")
def payload_categories(spark, d):
    return payload.load(payload.export(model(spark, d, name="langs"))).categories.select("category", "cat_order", "doc_count", "total_tokens")


@query(CELLS)
def model_convert(spark, d):
    registry = Registry(spark, _folder(spark))
    payload.convert(payload.export(model(spark, d, name="langs")), registry, "langs")
    return registry.load("langs").cells


@query(f"{scored()} {LS}")
def registry_log_scores(spark, d):
    registry = Registry(spark, _folder(spark))
    registry.save(model(spark, d, name="langs"))
    return log_score_rows(registry.load("langs"), spark, d)


def _stream_source(spark: SparkSession, d: str) -> tuple[str, object]:
    """A folder that the file source can watch, and its schema."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    path = f"{_folder(spark)}/source"
    docs.write.parquet(path)
    return path, docs.schema


@query(CELLS)
def stream_train_cells(spark, d):
    path, schema = _stream_source(spark, d)
    return trainer.stream_cells(spark, path, schema, log_of, _folder(spark))


@query(CELLS)
def stream_registry_cells(spark, d):
    path, schema = _stream_source(spark, d)
    registry = Registry(spark, _folder(spark))
    stream = log_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    folder = _folder(spark)
    trainer.train_stream(stream, registry, "langs", folder, every=2).awaitTermination()
    trainer.publish(registry, "langs", folder)
    return registry.load("langs").cells


def requests(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return table(spark, d, "documents").select(F.col("doc_id").alias("req_id"), F.lit("classify").alias("action"), "text", F.lit(None).cast("string").alias("category"), none.alias("context"), none.alias("candidates"))


@query(f"{softmaxed(scored())} SELECT d.doc_id AS req_id, CASE WHEN d.text IS NULL THEN 400 WHEN strlen(d.text) > 65536 THEN 413 ELSE 200 END AS status, sm.category, round(sm.score, 6) AS score, sm.category = best.category AS is_best FROM documents d LEFT JOIN sm ON sm.doc_id = d.doc_id AND strlen(d.text) <= 65536 LEFT JOIN best ON best.doc_id = sm.doc_id")
def service_classify(spark, d):
    out = Service(model(spark, d)).respond(requests(spark, d))
    scores = F.from_json(F.get_json_object("response", "$.scores"), "map<string,double>")
    each = out.select("req_id", "status", F.get_json_object("response", "$.category").alias("top"), F.explode_outer(scores).alias("category", "score"))
    return each.select("req_id", "status", "category", r("score").alias("score"), (F.col("category") == F.col("top")).alias("is_best"))


@query(f"{tag_ctes()} SELECT d.doc_id AS req_id, pr.label, round(pr.probability, 6) AS probability FROM documents d LEFT JOIN pr ON pr.doc_id = d.doc_id AND pr.probability >= 0.5 AND d.text IS NOT NULL")
def service_tag(spark, d):
    t = tagger(spark, d, 0)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("req_id"), F.lit("tag").alias("action"), "text")
    none = F.lit(None).cast("array<string>")
    out = Service(t.model, t, max_text_bytes=0).respond(docs.withColumns({"category": F.lit(None).cast("string"), "context": none, "candidates": none}))
    tags = F.from_json(F.get_json_object("response", "$.tags"), "map<string,double>")
    return out.select("req_id", F.explode_outer(tags).alias("label", "probability")).select("req_id", "label", r("probability").alias("probability"))


@query(f"{softmaxed(scored(base=PART_STATS, docs=PROBES))} SELECT split_part(doc_id, '|', 1) AS brand, split_part(doc_id, '|', 2) AS candidate, round(score, 6) AS score FROM sm WHERE category = 'liked'")
def service_recommend(spark, d):
    part = table(spark, d, "part")
    log = train.training_log(part, F.when(F.col("p_size") > 25, "liked").otherwise("ignored"), WordTokenizer().column(F.concat_ws(" ", "p_name", "p_type")), "p_partkey")
    types = part.agg(F.sort_array(F.collect_set("p_type")).alias("candidates"))
    brands = part.select(F.col("p_brand").alias("brand")).distinct().withColumn("req_id", F.xxhash64("brand"))
    asks = brands.select("req_id", F.lit("recommend").alias("action"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("category"), F.array("brand").alias("context")).crossJoin(F.broadcast(types))
    out = Service(Model.fit(log), max_candidates=0).respond(asks).join(brands, "req_id")
    scores = F.from_json(F.get_json_object("response", "$.scores"), "map<string,double>")
    return out.select("brand", F.explode(scores).alias("candidate", "score")).select("brand", "candidate", r("score").alias("score"))


# More of storage, streams and requests.


def part_model(spark, d, **settings) -> Model:
    part = table(spark, d, "part")
    return Model.fit(train.training_log(part, F.when(F.col("p_size") > 25, "liked").otherwise("ignored"), WordTokenizer().column(F.concat_ws(" ", "p_name", "p_type")), "p_partkey"), **settings)


PART_CELLS = f"{PART_STATS} SELECT category, token, cnt, doc_cnt FROM cells"


@query(f"{BASE}, asked AS (SELECT DISTINCT unnest({WORDS}) AS token FROM benchmark) SELECT category, token, cnt, doc_cnt FROM cells JOIN asked USING (token)")
def registry_tokens(spark, d):
    registry = Registry(spark, _folder(spark))
    registry.save(model(spark, d, name="langs"))
    return registry.tokens("langs", table(spark, d, "benchmark").select(F.explode(WordTokenizer().column(F.col("text"))).alias("token")))


@query("SELECT unnest(['first', 'second']) AS name, unnest([2, 1]) AS generation, unnest(['multinomial-naive-bayes', 'complement-naive-bayes']) AS kind, unnest([0.5, 1.0]) AS alpha")
def registry_list(spark, d):
    registry = Registry(spark, _folder(spark))
    m = part_model(spark, d)
    registry.save(m.with_(name="first"))
    registry.save(m.with_(name="first", alpha=0.5))
    registry.save(m.with_(name="second", kind="complement-naive-bayes"))
    registry.save(m.with_(name="third"))
    registry.delete("third")
    found = [(n, registry.generation(n), registry.load(n).kind, registry.load(n).alpha) for n in registry.list()]
    return spark.createDataFrame(found, "name string, generation int, kind string, alpha double")


def _followed(spark, d, mode: str) -> DataFrame:
    """The stored counts after half of the documents were trained in a batch."""
    registry, log = Registry(spark, _folder(spark)), scratch.kept(train_log(spark, d))
    registry.save(Model.fit(log.where("seq % 2 = 0"), name="langs"))
    histograms.start(registry, "langs", mode)
    batch, old = log.where("seq % 2 = 1"), registry.load("langs")
    new = old.with_(cells=trainer.fold(old.cells, trainer.signed(batch)), categories=trainer.fold_categories(old.categories, batch), histogram=None)
    registry.save(new, registry.generation("langs"), **histograms.follow(registry, old, new, batch.select(F.explode("tokens").alias("token"))))
    while histograms.maintain(registry, "langs", limit=50_000):
        pass
    return registry.histogram("langs")


def _follow(mode: str):
    def build(spark, d):
        return _followed(spark, d, mode)

    CATALOG[f"histogram_{mode}"] = Query(build, f"{BASE} {' UNION ALL '.join(HIST.values())}")


for _mode in histograms.MODES:
    _follow(_mode)


@query(PART_CELLS)
def jdbc_cells(spark, d):
    registry = JdbcRegistry(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true")
    registry.save(part_model(spark, d, name="parts"))
    return registry.load("parts").cells


@query(PART_CELLS)
def jdbc_payload_cells(spark, d):
    registry = JdbcRegistry(spark, f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "payload")
    registry.save(part_model(spark, d, name="parts"))
    return registry.load("parts").cells


@query(f"{PART_STATS} SELECT name, category, token, cnt, doc_cnt FROM cells CROSS JOIN (SELECT unnest(['one', 'two']) AS name)")
def convert_all(spark, d):
    registry, m = Registry(spark, _folder(spark)), part_model(spark, d)
    names = payload.convert_all(payload.export(m.with_(name="one")).unionAll(payload.export(m.with_(name="two"))), registry)
    return reduce(DataFrame.unionByName, [registry.load(n).cells.withColumn("name", F.lit(n)) for n in names])


@query("SELECT p_partkey AS id, CASE WHEN length(t) > 191 THEN substring(t, 1, 150) || '~' || sha1(t) ELSE t END AS key FROM (SELECT p_partkey, repeat(p_name, CAST(p_size AS INTEGER)) AS t FROM part)")
def token_keys(spark, d):
    part = table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("id"), encode_token(F.repeat("p_name", F.col("p_size").cast("int"))).alias("key"))


@query(f"WITH {LESS} {FOLD} SELECT category, token, cnt, doc_cnt FROM cells")
def stream_withdrawn_cells(spark, d):
    """A stream of training documents and of their withdrawals."""
    path, signed = f"{_folder(spark)}/log", signed_log(spark, d)
    signed.write.parquet(path)
    return trainer.stream_cells(spark, path, signed.schema, lambda log: log, _folder(spark))


@query(CELLS)
def replayed_overdrawn_cells(spark, d):
    """Withdrawals that come before what they withdraw take nothing."""
    log = train_log(spark, d)
    return train.replay(log.unionByName(log.where("seq % 5 = 2").withColumn("sign", F.lit(-1)).withColumn("seq", F.col("seq") - 10**12)))


@query(f"{tag_ctes().replace(TAG_STATS, TAG_STATS.replace('USING (doc_id))', 'USING (doc_id) WHERE doc_id % 5 <> 2)'))} SELECT doc_id, label, round(log_odds, 4) AS log_odds FROM pr")
def untagged_log_odds(spark, d):
    """Tags of a fifth of the documents are trained and withdrawn."""
    log = Tagger.log(tagged(spark, d), F.col("labels"), WordTokenizer().column(F.col("text")))
    less = log.where("seq % 5 = 2").withColumns({"sign": F.lit(-1), "seq": F.col("seq") + 10**12})
    return Tagger.fit(log.unionByName(less)).log_odds(documents(spark, d)).select("doc_id", "label", r("log_odds", 4).alias("log_odds"))


@query(f"{tag_ctes(probability='1 / (1 + exp(-(0.01 * log_odds - 0.25)))')} SELECT doc_id, label, round(probability, 6) AS probability FROM pr")
def tag_platt_apply(spark, d):
    t = tagger(spark, d)
    fitted = spark.createDataFrame([("quality", 0.01, -0.25), ("toxic", 0.01, -0.25)], "label string, slope double, intercept double")
    return Tagger(t.model, t.settings, fitted).probabilities(documents(spark, d)).select("doc_id", "label", r("probability").alias("probability"))


@query(f"{tag_ctes(probability='1 / (1 + exp(-(0.02 * log_odds + 0.5)))')} SELECT doc_id, label, round(probability, 6) AS probability FROM pr WHERE probability >= 0.25")
def tagger_saved(spark, d):
    """A tagger with its settings and calibration, through the registry."""
    registry, t = Registry(spark, _folder(spark)), tagger(spark, d)
    fitted = spark.createDataFrame([("quality", 0.02, 0.5, 9), ("toxic", 0.02, 0.5, 9)], "label string, slope double, intercept double, samples bigint")
    registry.save_tagger(Tagger(t.model, TagSettings(0.25, 0), fitted), "tags")
    return registry.load_tagger("tags").tag(documents(spark, d)).select("doc_id", "label", r("probability").alias("probability"))


@query("SELECT lang AS category, count(*) AS documents FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def category_names(spark, d):
    return train.category_names(train_log(spark, d))


@query("SELECT doc_id AS seq, lang AS category FROM documents WHERE lang = 'fr'")
def category_documents(spark, d):
    return train.category_documents(train_log(spark, d), "fr").select("seq", "category")


@query(f"{BASE} {' UNION ALL '.join(HIST.values())}")
def histogram_expanded(spark, d):
    """All families as flat text keys, and back."""
    return views.expand(views.flatten(views.histogram(train.cells(train_log(spark, d)))))


@query(f"{scored('cnb', part=1)} SELECT count(*) AS samples, true AS installed FROM td")
def calibrated_model(spark, d):
    m, held = evaluated(spark, d, held=True, kind="complement-naive-bayes")
    fitted = calibrate.calibrate(m, held, held)
    again = calibrate.fit_temperature(score.log_scores(m, held), held)
    same = abs(fitted.temperature / again.value - 1) < 1e-3 and fitted.is_calibrated and not m.is_calibrated
    return spark.createDataFrame([(fitted.temperature_samples, same)], "samples bigint, installed boolean")


@query(unnested("doc_id", WORDS, "documents"))
def tokens_sql(spark, d):
    """The tokenizer as a SQL function."""
    tokenizers.register_sql(spark)
    name = f"documents_{uuid.uuid4().hex}"
    table(spark, d, "documents").createOrReplaceTempView(name)
    return tokens_of(spark.sql(f"SELECT doc_id, bayes_words(text) AS tokens FROM {name}"), "doc_id", F.col("tokens"))


@query(unnested("item_id", f"list_concat(w, {char_sql(3, False)})", BENCH))
def tokens_restored(spark, d):
    """A tokenizer that went through its exported state."""
    back = tokenizers.restore(tokenizers.export(ChainTokenizer([WordTokenizer(), NGramTokenizer(3, pad=False)])))
    return tokens_of(table(spark, d, "benchmark"), "item_id", back.column(F.col("text")))


ITEMS = f"SELECT item_id AS doc_id, {WORDS} AS tokens FROM benchmark"


@query(f"SELECT 'cnb' AS model, * FROM ({softmaxed(scored('cnb', docs=ITEMS))} SELECT doc_id, category, round(score, 6) AS score FROM sm) UNION ALL SELECT 'mnb', * FROM ({softmaxed(scored(docs=ITEMS))} SELECT doc_id, category, round(score, 6) AS score FROM sm)")
def engine_score_all(spark, d):
    """Every model of a registry scores the same documents."""
    registry, m = Registry(spark, _folder(spark)), model(spark, d)
    registry.save(m.with_(name="mnb"))
    registry.save(m.with_(name="cnb", kind="complement-naive-bayes"))
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return Engine(spark, registry).load_all().score_all(docs).select("model", "doc_id", "category", r("score").alias("score"))


@query("SELECT doc_id AS req_id, CASE doc_id % 6 WHEN 0 THEN 200 ELSE 400 END AS status, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'parameter_invalid' WHEN 2 THEN 'action_unknown' WHEN 3 THEN 'candidates_empty' WHEN 4 THEN 'candidates_blank' ELSE 'parameter_invalid' END AS error FROM documents")
def service_errors(spark, d):
    """JSON requests, most of them faulty."""
    bodies = ['{"text": "one two"}', '{"text": {"a": 1}}', '{"action": "delete", "text": "x"}', '{"action": "recommend", "candidates": []}', '{"action": "recommend", "candidates": " "}', '{"action": "recommend", "candidates": [["x"]]}']
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("doc_id") % 6 + 1).cast("int"))
    asks = parse(table(spark, d, "documents").select(F.col("doc_id").alias("req_id"), body.alias("body")))
    return Service(part_model(spark, d)).respond(asks).select("req_id", "status", "error")


@query("SELECT doc_id, 'untrained' AS error, CAST(NULL AS VARCHAR) AS category FROM documents")
def classify_untrained(spark, d):
    return score.classify(Model.fit(train_log(spark, d).limit(0)), documents(spark, d)).select("doc_id", "error", "category")


# Scalar functions.


def _values(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.col("value") / 10 - 5).alias("a"), (F.col("user_id") % 7 - 60).cast("double").alias("b"))


VALUES = "(SELECT event_id, value / 10 - 5 AS a, CAST(user_id % 7 - 60 AS DOUBLE) AS b FROM events)"


@query(f"SELECT event_id, round(CASE WHEN greatest(a, b) - least(a, b) > 50 THEN greatest(a, b) ELSE greatest(a, b) + ln(1 + exp(least(a, b) - greatest(a, b))) END, 6) AS v FROM {VALUES}")
def log_add(spark, d):
    return _values(spark, d).select("event_id", r(maths.log_add(F.col("a"), F.col("b"))).alias("v"))


@query(f"SELECT b, round(max(a) + ln(sum(exp(a - m))), 6) AS v FROM (SELECT b, a, max(a) OVER (PARTITION BY b) AS m FROM {VALUES}) GROUP BY b")
def log_sum(spark, d):
    return maths.log_sum(_values(spark, d), "a", "b").select("b", r("log_sum").alias("v"))


@query(f"SELECT event_id, CASE WHEN a >= 0 THEN NULL ELSE round(ln(1 - exp(a)), 6) END AS v FROM {VALUES}")
def log_complement(spark, d):
    v = maths.log_complement(F.col("a"))
    return _values(spark, d).select("event_id", F.when(v == float("-inf"), None).otherwise(r(v)).alias("v"))


@query(f"SELECT event_id, round(1 / (1 + exp(-a)), 6) AS v FROM {VALUES}")
def sigmoid(spark, d):
    return _values(spark, d).select("event_id", r(maths.sigmoid(F.col("a"))).alias("v"))


@query("SELECT event_id, coalesce(TRY_CAST(event_type AS BIGINT), 7) AS i, value AS f, CASE WHEN event_type IN ('', '0') THEN false ELSE true END AS b, user_id % 3 <> 0 AS whole, (user_id % 3) / 2 <> 0 AS fraction, CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS said FROM events")
def payload_coercions(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", coerce.to_int(F.col("event_type"), 7).alias("i"), coerce.to_float(F.col("value")).alias("f"), coerce.to_bool(F.col("event_type")).alias("b"), coerce.to_bool(F.col("user_id") % 3).alias("whole"), coerce.to_bool((F.col("user_id") % 3) / 2).alias("fraction"), coerce.to_bool(F.element_at(F.array(*map(F.lit, ("false", "0.0", "0", "no"))), (F.col("user_id") % 4 + 1).cast("int"))).alias("said"))

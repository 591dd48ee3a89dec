"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: lower-cased code-point n-grams (1 to 3), hashed to ``2**bits`` slots. A text's value in a slot is its share of
the text's n-grams times the slot's inverse document frequency in the training sample.
Training: follow-the-regularised-leader (proximal) on the softmax loss with L1 and L2 penalties; L1 leaves most weights
at exactly zero. A part of the sample is kept aside and a temperature is fitted on it by golden-section search.
Prediction: each n-gram's weights are gathered and averaged by text with array arithmetic, over whole texts.

The fit uses at most ``max_docs`` labelled documents of at most 2**bits slots each: a bounded sample, chosen by the hash
of the id. It runs in one task; the model (2**bits x languages floats) is all that the driver and executors hold.

Nulls: a null text, or one without any letter, is ``und`` with score 0; a null label is not trained on; a null id is kept.
No labelled row at all: every text is ``und``. Equal scores go to the first language by name. Repeated rows count as often
as they come. Texts of any length are whole: work goes by pieces of texts, and one long text is a piece by itself. Empty table: no rows.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_column, tidy

UNKNOWN = "und"
_tables: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter (general category L)."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables["letters"]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-cased texts, each between two blanks; n + 1 offsets)."""
    lowered = [f" {t.lower()} " for t in texts]
    data = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in lowered], dtype=np.int64)])


@dataclass
class Model:
    """Weights already multiplied by the inverse document frequencies."""

    langs: list[str]
    weights: np.ndarray  # 2**bits x languages
    bias: np.ndarray
    temperature: float
    bits: int
    orders: tuple[int, ...] = (1, 2, 3)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean weights of each text's n-grams by language, whether the text has a letter)."""
        data, at = points(texts)
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for slots, starts in grams(data, at, self.bits, self.orders):
            sums = np.zeros((len(slots) + 1, 1))
            for k in range(len(self.langs)):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[slots, k], dtype=np.float64)])
                total[:, k] += sums[starts[1:]] - sums[starts[:-1]]
            count += np.diff(starts)
        letters = np.concatenate([[0], np.cumsum(letter_table()[data])])
        return total / np.maximum(count, 1)[:, None] + self.bias, letters[at[1:]] > letters[at[:-1]]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        s, spoken = self.scores(texts)
        p = softmax(s / self.temperature)
        best = p.argmax(1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, spoken, strict=True)], np.where(spoken, p[np.arange(len(p)), best], 0.0)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def grams(data: np.ndarray, at: np.ndarray, bits: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (slots of all n-grams within the texts, n + 1 offsets)."""
    for n in orders:
        h = np.full(max(0, len(data) - n + 1), n, np.uint32)
        for i in range(n):
            h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint32(0x01000193 + 0x9E3779B0)
            h ^= h >> np.uint32(15)
        per = np.maximum(np.diff(at) - n + 1, 0)
        own = np.ones(len(h), bool)
        for back in range(1, n):  # n-grams that begin in the last n - 1 places of a text reach into the next
            places = at[1:] - back
            own[places[(places < len(h)) & (places >= 0)]] = False
        yield (h[own] >> np.uint32(32 - bits)), np.concatenate([[0], np.cumsum(per)])


def features(texts: list[str], bits: int, orders: tuple[int, ...] = (1, 2, 3)) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its slots and their shares of its n-grams."""
    out = []
    for t in texts:
        slots = np.concatenate([s for s, _ in grams(*points([t]), bits, orders)])
        own, n = np.unique(slots, return_counts=True)
        out.append((own.astype(np.int32), (n / max(1, len(slots))).astype(np.float32)))
    return out


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> Model:
    """FTRL-proximal over (language, slots, shares); every fifth row is kept for the temperature."""
    langs = sorted({r[0] for r in rows})
    size, k = 1 << bits, len(langs)
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    own = [r for i, r in enumerate(rows) if i % 5 != 4]
    df = np.zeros(size)
    for _, slots, _ in own:
        df[slots] += 1
    idf = np.log((1 + len(own)) / (1 + df)) + 1
    scale = 100.0  # shares are small: this only sets the unit of the weights
    z, n, bias = np.zeros((size, k)), np.zeros((size, k)), np.zeros(k)

    def weights(slots: np.ndarray) -> np.ndarray:
        zs = z[slots]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[slots])) / alpha + l2))

    for _ in range(epochs):
        for lang, slots, shares in own:
            x = shares * idf[slots] * scale
            w = weights(slots)
            p = softmax((x @ w + bias)[None])[0]
            p[langs.index(lang)] -= 1
            bias -= 0.01 * p
            g = x[:, None] * p[None]
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
            z[slots] += g - sigma * w
            n[slots] += g * g
    w = weights(np.arange(size)) * (idf * scale)[:, None]
    s = np.array([shares @ w[slots] + bias for _, slots, shares in held]).reshape(-1, k)
    y = np.array([langs.index(lang) for lang, _, _ in held], int)
    return Model(langs, w.astype(np.float32), bias, temperature(s, y), bits)


def temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    Targets are smoothed by one pseudo-row of each language, so that an aside without errors doesn't ask for certainty.
    """
    if not len(y):
        return 1.0
    k = s.shape[1]
    target = np.full((len(y), k), 1 / (len(y) + k))
    target[np.arange(len(y)), y] += len(y) / (len(y) + k)
    loss = lambda t: -(target * np.log(np.maximum(softmax(s / np.exp(t)), 1e-300))).sum(1).mean()
    a, b, phi = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    while b - a > 1e-4:
        c, d = b - phi * (b - a), a + phi * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, max_docs: int = 4000, bits: int = 15, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> Model:
    """Fit on a bounded sample of ``docs(doc_id, text, lang)``: the ``max_docs`` labelled rows of smallest hashed id."""
    small_batches(docs.sparkSession)
    order = F.xxhash64("doc_id", F.length("text"))
    chosen = docs.where("lang is not null and text is not null").select("lang", "text", order.alias("h"))
    bound = chosen.select("h").orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    if bound is None:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0), 1.0, bits)
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("slots", pa.binary()), ("shares", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            got = features(text_column(part).to_pylist(), bits)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([b.tobytes() for _, b in got], pa.binary())], schema=schema)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["lang"], r["slots"]))[:max_docs]
        if not got:
            return
        m = fit([(r["lang"], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in got], bits, alpha, beta, l1, l2, epochs)
        yield pa.RecordBatch.from_pylist([{"langs": m.langs, "w": zlib.compress(m.weights.tobytes(), 1), "bias": m.bias.tolist(), "t": m.temperature}], pa.schema([("langs", pa.list_(pa.string())), ("w", pa.binary()), ("bias", pa.list_(pa.float64())), ("t", pa.float64())]))

    sample = chosen.where(F.col("h") <= F.lit(bound)).mapInArrow(tidy(rows), "lang string, h bigint, slots binary, shares binary")
    found = sample.repartition(1).mapInArrow(tidy(learn), "langs array<string>, w binary, bias array<double>, t double").first()
    return Model(list(found["langs"]), np.frombuffer(zlib.decompress(bytes(found["w"])), np.float32).reshape(1 << bits, -1), np.array(found["bias"]), found["t"], bits)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the language and score of the whole text under ``names``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*(F.col(f"`{c}`").alias(f"k_{c}") for c in keep), "text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", `{names[0]}` string, `{names[1]}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            lang, score = shared.value.predict(text_column(part).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    return given.mapInArrow(tidy(run), schema)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that are not held out, predicted for all."""
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False)) & F.col("doc_id").isNotNull()), **options)
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")

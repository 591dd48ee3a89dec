"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Counting: the characters of trusted text are counted first; the 4,000 most frequent are symbols of their own, all others
share 64 by their code. Each task then counts the distinct 5-grams of its pieces of trusted text (12 bits a symbol), and
the counts are summed by n-gram over all of it. The lower orders'
continuation counts, the contexts' totals and the probabilities are joins of these count tables by context and suffix.
Scoring: the tables are dealt by the two characters before the predicted one into blocks of at most ``block_rows`` rows,
so that a position finds all it needs of orders 3 to 5 in one block; a block is broadcast, the documents pass by it, and
a document's sums over the blocks are added. A model of one block takes one pass.
Threshold: a text is kept if its perplexity lies between two quantiles of trusted texts of its language.

Nulls: a null text is empty, and an empty text's only prediction is its end; a null language is a language of its own; a
null id is kept but never trusted. Equal perplexities fall on the same side of a threshold, which itself is kept. Languages without trusted text take the thresholds of all trusted text; without any
trusted text perplexity is null and every text is kept. Repeated rows are kept. Texts of any length are
worked on whole: one longer than a piece of work is a piece by itself. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, mix, ragged, small_batches, text_column, tidy

ORDER, BITS = 5, 12
START, END = 0, 1
#: Symbols that rare characters share, and where those of single characters begin.
SHARED, OWN = 64, 66
#: Rows of tables in one block, and ids of trusted texts that may be broadcast.
BLOCK_ROWS, MAX_IDS = 2_000_000, 2_000_000
#: Languages whose thresholds may be broadcast.
MAX_LANGS = 10_000


def alphabet(docs: DataFrame) -> np.ndarray:
    """The symbol of every code point, from the counts of the lower-cased characters of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            data = np.frombuffer("".join(text_column(part).to_pylist()).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            codes, n = np.unique(data, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(tidy(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    found = [r["code"] for r in counted.orderBy(F.desc("n"), "code").limit((1 << BITS) - OWN).collect()]
    table = (mix(np.arange(0x110000, dtype=np.uint64)) % np.uint64(SHARED) + np.uint64(2)).astype(np.uint16)
    table[found] = OWN + np.arange(len(found))
    return table


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all lower-cased texts, each between four starts and an end; n + 1 offsets)."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    at = np.concatenate([[0], np.cumsum(sizes + ORDER)])
    out = np.full(int(at[-1]), START, np.int64)
    out[ragged(at[:-1] + ORDER - 1, sizes)] = table[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    out[at[1:] - 1] = END
    return out, at


def grams(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(5-gram codes of all predictions, n + 1 offsets)."""
    n = len(s) - ORDER + 1
    codes = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER):
        codes = codes << BITS | s[k : k + n]
    keep = np.ones(len(codes), bool)
    for back in range(1, ORDER):
        places = at[1:-1] - back
        keep[places] = False
    return codes[keep], at - np.arange(len(at)) * (ORDER - 1)


def counts(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(gram, n) over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # two bytes a code point
    small_batches(docs.sparkSession)
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 4 << 20):
            codes, n = np.unique(grams(*symbols(text_column(part).to_pylist(), shared.value))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], schema=schema)

    return docs.select("text").mapInArrow(tidy(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    """D1, D2 and D3+ of an order from its counts of counts."""
    row = table.agg(*(F.coalesce(F.sum((F.col("n") == k).cast("bigint")), F.lit(0)) for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = row
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    d = [k - (k + 1) * y * (b / a) if a else 0.0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(x, 0.0), float(k)) for k, x in zip((1, 2, 3), d, strict=True)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _low(c: str, chars: int) -> Column:
    return F.col(c).bitwiseAND(F.lit((1 << BITS * chars) - 1))


def model(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(kind, key, value) rows: kind k is ln p of seen k-grams, kind -k is ln of the back-off weight of their contexts."""
    tables = {ORDER: checkpointed(counts(docs, table))}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy(_low("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    size = tables[1].count() + 1  # and one that was never seen
    parts, below = [], None
    for k in range(1, ORDER + 1):
        t = checkpointed(tables[k]) if 1 < k < ORDER else tables[k]
        d = _discounts(t)
        ctx = t.withColumn("ctx", F.shiftright("gram", BITS))
        left = F.sum(_discount(d)) / F.sum("n")
        contexts = ctx.groupBy("ctx").agg(F.sum("n").alias("total"), left.alias("weight"))
        p = ctx.join(contexts, "ctx").withColumn("own", F.greatest(F.col("n") - _discount(d), F.lit(0.0)) / F.col("total"))
        if below is None:
            p = p.withColumn("p", F.col("own") + F.col("weight") / size)
            parts.append(contexts.select(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("key"), F.log(F.col("weight") / size).alias("value")))
        else:
            p = p.withColumn("low", _low("gram", k - 1)).join(below, "low").withColumn("p", F.col("own") + F.col("weight") * F.col("p_low"))
            parts.append(contexts.select(F.lit(-k).alias("kind"), F.col("ctx").alias("key"), F.log("weight").alias("value")))
        p = checkpointed(p.select("gram", "p"))
        parts.append(p.select(F.lit(k).alias("kind"), F.col("gram").alias("key"), F.log("p").alias("value")))
        below = p.select(F.col("gram").alias("low"), F.col("p").alias("p_low"))
    return checkpointed(reduce(DataFrame.unionAll, parts))


class Table:
    """A hash table of 64-bit keys on arrays, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left, place = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[place] == -1
            _, first = np.unique(place, return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            self.keys[place[put]], self.values[place[put]] = keys[left[put]], values[left[put]]
            left, place = left[~put], (place[~put] + free[~put].choose([1, 0])) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether the key is there)."""
        place = self._home(keys)
        have = self.keys[place]
        value, found = self.values[place], have == keys
        left = np.flatnonzero(~found & (have != -1))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            have = self.keys[place[left]]
            hit = have == keys[left]
            value[left[hit]], found[left[hit]] = self.values[place[left[hit]]], True
            left = left[~hit & (have != -1)]
        return value, found


class Scorer:
    """One block of the model."""

    def __init__(self, rows: pa.Table, block: int, blocks: int, table: np.ndarray):
        self.table = table
        kind, key, value = (rows.column(c).to_numpy() for c in ("kind", "key", "value"))
        self.block, self.blocks = block, blocks
        self.tables = {k: Table(key[kind == k], value[kind == k].astype(np.float32)) for k in range(-ORDER, ORDER + 1) if k not in (0, -1)}
        none = value[kind == 0]
        self.unseen = float(none[0]) if len(none) else 0.0

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        out, left, add = np.zeros(len(codes), np.float64), np.arange(len(codes)), np.zeros(len(codes), np.float64)
        for k in range(ORDER, 0, -1):
            own = codes[left] & ((1 << BITS * k) - 1)
            value, found = self.tables[k].get(own)
            out[left[found]] = add[left[found]] + value[found]
            left, own = left[~found], own[~found]
            if k > 1 and len(left):
                weight, known = self.tables[-k].get(own >> BITS)
                add[left] += np.where(known, weight, 0.0)
        out[left] = add[left] + self.unseen
        return out

    def mine(self, codes: np.ndarray) -> np.ndarray:
        return block_of((codes >> BITS) & 0xFFFFFF, self.blocks) == self.block

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of ln p over this block's predictions, all predictions) of each text."""
        codes, at = grams(*symbols(texts, self.table))
        if self.blocks == 1:
            p = self.log_p(codes)
        else:
            p, own = np.zeros(len(codes)), self.mine(codes)
            p[own] = self.log_p(codes[own])
        total = np.concatenate([[0.0], np.cumsum(p)])
        return total[at[1:]] - total[at[:-1]], np.diff(at)


def block_of(pair, blocks: int):
    """The block of a pair of characters, as an array or as a column."""
    if isinstance(pair, np.ndarray):
        return (pair * 40503 >> 4) % blocks
    return F.shiftright(pair * 40503, 4) % blocks


def scores(docs: DataFrame, tables: DataFrame, table: np.ndarray, keep: tuple[str, ...] = ("doc_id", "lang"), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The columns ``keep`` with n_grams and perplexity of every row."""
    small_batches(docs.sparkSession)
    rows = tables.count()
    blocks = max(1, -(-rows // block_rows))
    kind = F.col("kind")
    pair = F.when(kind >= 3, F.shiftright("key", BITS).bitwiseAND(F.lit(0xFFFFFF))).otherwise(F.col("key").bitwiseAND(F.lit(0xFFFFFF)))
    dealt = tables.withColumn("block", F.when((kind >= 3) | (kind <= -3), block_of(pair, blocks)).otherwise(-1))
    given = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ln_p double, n_grams bigint"

    def one(block: int) -> DataFrame:
        own = dealt.where(F.col("block").isin(-1, block)).select("kind", "key", "value").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(Scorer(own, block, blocks, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, 1 << 20):
                ln_p, n = shared.value.sums(text_column(part).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(ln_p), pa.array(n.astype(np.int64))], names=[*keep, "ln_p", "n_grams"])

        return given.mapInArrow(tidy(run), schema)

    if not rows:
        return docs.select(*keep, F.lit(None).cast("double").alias("perplexity"), (F.char_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint").alias("n_grams"))
    if blocks == 1:
        out = one(0)
    else:
        given = docs.select(*keep, "text").withColumn("_row", F.xxhash64(*keep, "text"))
        keep, schema = (*keep, "_row"), schema.replace(", ln_p", ", `_row` bigint, ln_p")
        given = given.select(*keep, "text")
        passes = reduce(DataFrame.unionAll, [one(b).withColumn("_pass", F.lit(b)) for b in range(int(blocks))])
        sums = passes.groupBy("_row").agg(F.sum("ln_p").alias("s"), F.sum((F.col("_pass") == 0).cast("bigint")).alias("copies"))
        out = passes.where("_pass = 0").join(sums, "_row").withColumn("ln_p", F.col("s") / F.col("copies")).drop("s", "copies", "_pass", "_row")
        keep = keep[:-1]
    return out.select(*keep, F.exp(-F.col("ln_p") / F.col("n_grams")).alias("perplexity"), "n_grams")


def trusted(docs: DataFrame, labels: DataFrame, max_ids: int = MAX_IDS) -> DataFrame:
    """``docs`` with a column ``trusted``: labelled as of good quality. Few ids are broadcast, more are joined by shuffle."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct()
    side = F.broadcast(ids) if ids.count() <= max_ids else ids
    return docs.join(side, docs["doc_id"] == F.col("_good"), "left").withColumn("trusted", F.col("_good").isNotNull()).drop("_good")


def classify(docs: DataFrame, labels: DataFrame, low: float = 0.0, high: float = 0.995, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, keep) of every document."""
    rows = trusted(docs.select("doc_id", "text", "lang"), labels)
    table = alphabet(rows.where("trusted"))
    scored = checkpointed(scores(rows, model(rows.where("trusted"), table), table, ("doc_id", "lang", "trusted"), block_rows))
    bounds = lambda d: d.agg(F.percentile_approx("perplexity", [low, high], 10000).alias("q"))
    good = scored.where("trusted and perplexity is not null")
    every = bounds(good).withColumnRenamed("q", "q_all")
    by_lang = checkpointed(bounds(good.groupBy(F.col("lang").alias("of"))).withColumnRenamed("q", "q_lang"))
    few = F.broadcast(by_lang) if by_lang.count() <= MAX_LANGS else by_lang  # else a language is a key of the join
    joined = scored.join(few, F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(every))
    q = F.coalesce("q_lang", "q_all")
    keep = F.coalesce((F.col("perplexity") >= q[0]) & (F.col("perplexity") <= q[1]), F.lit(True))
    return joined.select("doc_id", "lang", "n_grams", "perplexity", keep.alias("keep"))

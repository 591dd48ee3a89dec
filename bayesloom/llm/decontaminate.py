"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text. A seed is a fixed mask over
consecutive words: only positions marked 1 enter its hash, so a substituted word under a 0 doesn't hide a hit. Every seed
of every document is looked up among the benchmark's. Around a hit both word sequences are laid side by side, and the
longest stretch between two equal words with at least ``identity`` equal words is taken, the first of several; it counts
if it has ``min_words`` words, or all words of a shorter item. No overlap that counts is without a hit: ``complete`` proves it for MASKS at any length, other limits
get lighter seeds, and items of fewer than ``min_words`` words get the masks of ``short_masks`` at their length.

The benchmark's words and seeds are broadcast in blocks of at most ``block_words`` words; each block is one pass over
the documents, so the broadcast is bounded whatever the benchmark holds.

Nulls: a null text has no words and gives no row; a null id is kept. Repeated documents or items each give their rows.
Texts of any length are
worked on whole: one longer than a piece of work is a piece by itself. Empty table on either side: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, Rolling, chunks, flat, mix, ragged, small_batches, text_column, tidy, unused

#: Fixed masks. Every stretch of 13 or more words, 80% equal, holds a window that none of its substitutions hurts.
MASKS = ("11101111", "11010010111", "111110011", "1100100010111", "1110101001001", "1101111001")
MIN_WORDS = 13
IDENTITY = 0.8
BLOCK_WORDS = 2_000_000

INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_factors = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gains(identity: float) -> tuple[int, int]:
    """What an equal word adds to a stretch and an unequal one takes, in thousandths; a stretch counts from 0 on."""
    return round((1 - identity) * 1000), round(identity * 1000)


def complete(masks: tuple[str, ...], min_words: int = MIN_WORDS, identity: float = IDENTITY) -> bool:
    """Whether every stretch of ``min_words`` or more words that counts (its ends are equal words) has a hit.

    The states are the last words, equal or not, of stretches without a hit; for each the greatest sum is followed word by
    word. From ``min_words`` on a state that an earlier length reached with as much needs no second look.
    """
    up, down = gains(identity)
    states = np.arange(1 << max(map(len, masks)))
    hit = np.zeros(len(states), bool)
    for mask in masks:
        hit |= (states & int(mask, 2)) == int(mask, 2)
    none = np.iinfo(np.int64).min // 2
    now, top = np.full(len(states), none), np.full(len(states), none)
    now[1] = up
    if hit[1]:
        return True
    for n in range(1, 1000):
        if n > 1:
            after = np.full(len(states), none)
            for equal, gain in ((0, -down), (1, up)):
                np.maximum.at(after, (states << 1 | equal) & (len(states) - 1), np.where(now > none, now + gain, none))
            after[hit] = none
            now = after
        if n >= min_words:
            if now[1::2].max() >= 0:
                return False
            now = np.where(now > top, now, none)
            top = np.maximum(top, now)
            if now.max() == none:
                return True
    return False


@lru_cache
def long_masks(min_words: int = MIN_WORDS, identity: float = IDENTITY) -> tuple[str, ...]:
    """MASKS, or for limits that they don't cover the longest seed of consecutive words that does."""
    return next(m for m in (MASKS, *(("1" * k,) for k in range(12, 0, -1))) if complete(m, min_words, identity))


@lru_cache
def short_masks(n: int, identity: float = IDENTITY) -> tuple[str, ...]:
    """Masks over all n words of a short item: whichever inner words are unequal, one of them passes over all of those."""
    wrong = max(0, min(n - 2, n * gains(identity)[0] // 1000))
    groups = np.array_split(np.arange(1, n - 1), wrong + 2)
    hidden = [set(np.concatenate(g).tolist()) if g else set() for g in combinations(groups, wrong)]
    return tuple(sorted({"".join("01"[k not in h] for k in range(n)) for h in hidden}))


@dataclass
class Words:
    """The words of several texts: their hashes, and how many words come before each text."""

    symbols: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Words:
        raw, offsets = flat(pc.utf8_lower(texts))
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = INSIDE[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        return Words(Rolling(LETTER[raw]).spans(starts, ends), np.searchsorted(starts, offsets))

    def seeds(self, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word position) of each window of the mask that lies within one text."""
        n = len(self.symbols) - len(mask) + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.full(n, len(mask), np.uint64)
        for k, used in enumerate(mask):
            if used == "1":
                h += self.symbols[k : k + n] * _factors[k % 64]
        text = np.repeat(np.arange(len(self.before) - 1), np.diff(self.before))
        at = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
        return mix(h[at]), at


class Seeds:
    """The benchmark's words and its seeds by mask, sorted, with a bit table in front."""

    def __init__(self, ids: list, texts: list[str], min_words: int = MIN_WORDS, identity: float = IDENTITY):
        self.ids, self.words = ids, Words.of(pa.array(texts, pa.large_string()))
        sizes = np.diff(self.words.before)
        self.item = np.repeat(np.arange(len(ids)), sizes)
        self.tables = []
        short = sorted({int(n) for n in sizes if 0 < n < min_words})
        for mask, size in [*((m, 0) for m in long_masks(min_words, identity)), *((m, n) for n in short for m in short_masks(n, identity))]:
            h, at = self.words.seeds(mask)
            keep = sizes[self.item[at]] == size if size else sizes[self.item[at]] >= min_words
            h, at = h[keep], at[keep]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[h >> np.uint64(44)] = True
            self.tables.append((mask, h[order], at[order], bits))

    def hits(self, docs: Words, at_once: int = 1 << 20) -> np.ndarray:
        """Distinct (text, item, item position minus text position) of all hits."""
        found = [np.zeros((0, 3), np.int64)]
        text = np.repeat(np.arange(len(docs.before) - 1), np.diff(docs.before))
        for mask, known, at, bits in self.tables:
            h, place = docs.seeds(mask)
            some = bits[h >> np.uint64(44)]
            h, place = h[some], place[some]
            left, right = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            upto = np.cumsum(right - left)
            cuts = np.unique([0, *np.searchsorted(upto, np.arange(at_once, (upto[-1] if len(upto) else 0) + at_once, at_once)), len(upto)])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):  # a word said over and over meets itself many times
                n = (right - left)[s:e]
                where = np.repeat(place[s:e], n)
                other = at[ragged(left[s:e], n)]
                item = self.item[other]
                shift = (other - self.words.before[item]) - (where - docs.before[text[where]])
                found.append(np.unique(np.stack([text[where], item, shift], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)


def longest(equal: np.ndarray, identity: float) -> tuple[int, int]:
    """(start, end) of the longest stretch that begins and ends with true and of which at least ``identity`` is true; the
    first of several, (0, 0) of none."""
    if not equal.any():
        return 0, 0
    walk = np.concatenate([[0], np.cumsum(np.round((equal - identity) * 1000).astype(np.int64))])
    far = np.iinfo(np.int64).max // 4
    low = np.minimum.accumulate(np.where(np.append(equal, False), walk, far))  # least sum before a start up to here
    high = np.maximum.accumulate(np.where(np.concatenate([[False], equal]), walk, -far)[::-1])[::-1]  # greatest at an end from here on
    reach = np.searchsorted(-high, -low, "right") - 1
    sizes = reach - np.arange(len(reach))
    start = int(sizes.argmax())
    return (start, int(reach[start])) if sizes[start] > 0 else (0, 0)


SCHEMA = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, n_equal bigint, item_words bigint"
_schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def overlaps(part: pa.RecordBatch, seeds: Seeds, min_words: int, identity: float) -> pa.RecordBatch:
    docs, ids, best = Words.of(text_column(part)), part.column(0).to_pylist(), {}
    for text, item, shift in seeds.hits(docs).tolist():
        a = docs.symbols[docs.before[text] : docs.before[text + 1]]
        b = seeds.words.symbols[seeds.words.before[item] : seeds.words.before[item + 1]]
        start, end = max(0, shift), min(len(b), len(a) + shift)
        s, e = longest(a[start - shift : end - shift] == b[start:end], identity)
        if e - s >= min(min_words, len(b)):
            n = int((a[start - shift + s : start - shift + e] == b[start + s : start + e]).sum())
            row = (e - s, n, -(start - shift + s))
            best[text, item] = max(best.get((text, item), row), row)
    rows = [{"doc_id": ids[t], "item_id": seeds.ids[i], "start_word": -at, "n_words": n, "n_equal": eq, "item_words": int(seeds.words.before[i + 1] - seeds.words.before[i])} for (t, i), (n, eq, at) in sorted(best.items())]
    return pa.RecordBatch.from_pylist(rows, _schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each (document, item) that overlap: where, how long, and how many words are equal."""
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), ((F.length(F.coalesce("text", F.lit(""))) / 2).cast("bigint") + 1).alias("size"))
    total = items.agg(F.sum("size")).first()[0] or 0
    blocks = int(-(-total // block_words)) or 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    parts = []
    for k in range(blocks):
        rows = dealt.where(F.col("block") == k).select("item_id", "text").collect()  # about block_words words
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        shared = spark.sparkContext.broadcast(Seeds([r[0] for r in rows], [r[1] for r in rows], min_words, identity))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                yield overlaps(part, shared.value, min_words, identity)

        parts.append(given.mapInArrow(tidy(run), SCHEMA))
    return reduce(DataFrame.unionAll, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that overlap with an item; rows with a null id stay only if their text is clean."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    (name,) = unused(docs, "bad")
    bad = contaminated(keyed, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == F.col(name), "left_anti")

"""SimHash near-duplicates by bit-sliced comparison.

1. Fingerprint: 64 majority bits over the XXH64 (seed 42) of every shingle of a whole text.
2. Candidates: equal fingerprints are one. Two fingerprints that differ in at most RADIUS = 2 of 64 bits agree on at
   least two of four 16-bit blocks, so each fingerprint is dealt by its six pairs of blocks. A bucket of more than
   ``split`` fingerprints is dealt again by pairs of 8-bit blocks of the other 32 bits, which loses nothing for the same
   reason and bounds a bucket by 2**16 fingerprints, whatever the table holds.
3. Comparison: a bucket's fingerprints are stored vertically, as 64 bit planes. The distances from many fingerprints to
   64 others a word are counted at once by carry-save adders on whole words; when every lane of a block has passed the
   radius, the block is abandoned. A bucket gives one edge from each fingerprint to its component's first.
4. Components: large-star and small-star rounds join the buckets' edges; each round is written to the shared folder.

Nulls: a null text has no words, so its fingerprint is zero, as that of an empty text; a null id is kept, and never names
a component unless all its members' ids are null. Repeated rows are kept. Texts of any length are
worked on whole: one longer than a piece of work is a piece by itself. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, ragged, small_batches, text_column, tidy

RADIUS = 2
SPLIT = 4096
TILE = 256


def shingles(text: str, n: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a lower-cased text joined by one space, and where each shingle starts and ends in it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b"", [], []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < n:
        return joined, [0], [len(joined)]
    return joined, starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()


def fingerprint(text: str | None, n: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    joined, starts, ends = shingles(text or "", n)
    if not starts:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed 64-bit integer."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in text_column(part).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, fp bigint")


class BitPlanes:
    """A set of fingerprints stored by bit: plane i holds bit i of 64 fingerprints in each word.

    A cell is a word for a query: 64 distances that are counted at once. Planes that split the set most evenly come first,
    and every eighth plane the cells all of whose lanes are over the radius are abandoned. ``visited`` counts the planes
    of cells that were read.
    """

    STEP = 8

    def __init__(self, fps: np.ndarray):
        self.n, self.visited = len(fps), 0
        words = -(-self.n // 64)
        padded = np.zeros(words * 64, np.uint64)
        padded[: self.n] = fps
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lane, bit
        self.planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")  # bit, word
        self.valid = np.packbits(np.arange(words * 64) < self.n, bitorder="little").view("<u8")
        self.order = np.argsort(np.abs(2 * bits[: self.n].sum(0, dtype=np.int64) - self.n), kind="stable").tolist()

    def within(self, queries: np.ndarray, radius: int = RADIUS, own: np.ndarray | None = None) -> np.ndarray:
        """For each query a row of words whose set lanes are at most ``radius`` bits away; its ``own`` lane is left out."""
        words = len(self.valid)
        out = np.zeros((len(queries), words), np.uint64)
        wanted = np.tile(self.valid, (len(queries), 1))
        if own is not None:
            wanted[np.arange(len(queries)), own >> 6] &= ~(np.uint64(1) << (own & 63).astype(np.uint64))
        wanted = wanted.ravel()
        cell = np.flatnonzero(wanted)
        wanted = wanted[cell]
        sums = [np.zeros(len(cell), np.uint64) for _ in range((radius + 1).bit_length())]
        over = np.zeros(len(cell), np.uint64)
        query, word = np.divmod(cell, words)
        for step, i in enumerate(self.order, 1):
            flip = np.uint64(0) - ((queries >> np.uint64(i)) & np.uint64(1))
            carry = self.planes[i][word] ^ flip[query]
            for s in sums:
                s ^= carry
                carry &= ~s
            over |= carry
            self.visited += len(cell)
            if step % self.STEP == 0:
                near = wanted & ~(over | self._beyond(sums, radius))
                stay = np.flatnonzero(near)
                if not len(stay):
                    return out
                if len(stay) < len(cell):
                    cell, wanted, over, query, word = cell[stay], near[stay], over[stay], query[stay], word[stay]
                    sums = [s[stay] for s in sums]
        out.ravel()[cell] = wanted & ~(over | self._beyond(sums, radius))
        return out

    @staticmethod
    def _beyond(sums: list[np.ndarray], radius: int) -> np.ndarray:
        """Lanes whose count is over the radius. Counts only grow, or pass into ``over``."""
        more, same = np.zeros_like(sums[0]), ~np.zeros_like(sums[0])
        for k in range(len(sums) - 1, -1, -1):
            if radius >> k & 1:
                same = same & sums[k]
            else:
                more |= same & sums[k]
                same = same & ~sums[k]
        return more


def linked(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each distinct fingerprint of a bucket the place of the first one of its component."""
    if len(fps) == 2:
        near = bin(int(fps[0] ^ fps[1])).count("1") <= radius
        return np.array([0, 0 if near else 1])
    sliced = BitPlanes(fps)
    root = np.full(len(fps), -1, np.int64)
    unseen = sliced.valid.copy()
    for k in range(len(fps)):
        if root[k] >= 0:
            continue
        root[k] = k
        unseen[k >> 6] &= ~(np.uint64(1) << np.uint64(k & 63))
        front = np.array([k])
        while len(front):
            reached = np.zeros_like(unseen)
            for at in range(0, len(front), TILE):
                tile = front[at : at + TILE]
                reached |= np.bitwise_or.reduce(sliced.within(fps[tile], radius, tile), axis=0)
            reached &= unseen
            unseen &= ~reached
            front = np.flatnonzero(np.unpackbits(reached.view(np.uint8), bitorder="little"))
            root[front] = k
    return root


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket) in; an edge (fp, first fp of its component in the bucket) out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    kept: list[np.ndarray] = []
    last: tuple | None = None

    def done(parts: list[np.ndarray]) -> pa.RecordBatch | None:
        fps = np.unique(np.concatenate(parts))
        if len(fps) < 2:
            return None
        root = linked(fps.view(np.uint64))
        keep = root != np.arange(len(fps))
        return pa.RecordBatch.from_arrays([pa.array(fps[keep]), pa.array(fps[root[keep]])], schema=schema) if keep.any() else None

    for batch in batches:
        table, key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cuts = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1
        starts = [0, *cuts.tolist()]
        for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
            if s == e:
                continue
            if last is not None and last != (table[s], key[s]):
                if sum(map(len, kept)) > 1 and (out := done(kept)) is not None:
                    yield out
                kept = []
            last = (table[s], key[s])
            kept.append(fp[s:e])
    if sum(map(len, kept)) > 1 and (out := done(kept)) is not None:
        yield out


def _block(at: int, bits: int):
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))


def edges(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) that join all of ``distinct(fp)`` whose fingerprints link."""
    pairs = list(combinations(range(4), 2))
    first = [F.struct(F.lit(t).alias("t"), F.shiftleft(_block(16 * i, 16), 16).bitwiseOR(_block(16 * j, 16)).alias("key")) for t, (i, j) in enumerate(pairs)]
    dealt = distinct.select("fp", F.explode(F.array(*first)).alias("d")).select(F.col("d.t").alias("t"), F.col("d.key").alias("key"), "fp")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = dealt.join(sizes, ["t", "key"])
    small = sized.where(F.col("size") <= split).select("t", "key", "fp")
    again = []
    for t, chosen in enumerate(pairs):
        free = [16 * b + 8 * h for b in range(4) if b not in chosen for h in (0, 1)]
        for u, (i, j) in enumerate(pairs):
            key = F.shiftleft(F.col("key"), 16).bitwiseOR(F.shiftleft(_block(free[i], 8), 8)).bitwiseOR(_block(free[j], 8))
            again.append(F.when(F.col("t") == t, F.struct(F.lit(6 + 6 * t + u).alias("t"), key.alias("key"))))
    large = sized.where(F.col("size") > split).select("fp", F.explode(F.array_compact(F.array(*again))).alias("d")).select(F.col("d.t").alias("t"), F.col("d.key").alias("key"), "fp")
    return small.unionAll(large).repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(tidy(_edges), "a bigint, b bigint").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that can be reached.

    Large-star and small-star rounds; each halves the distance to the root at least, and only sums and minima by node
    are shuffled, so that a node of any degree is spread over the tasks that hold its edges.
    """
    now = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = checkpointed(small)
        total = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint")), F.sum(F.hash("v").cast("bigint"))).first()
        if total(after) == total(now):
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = after
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; component_id is the smallest id reachable over links."""
    fps = checkpointed(fingerprints(docs, shingle))
    return grouped(fps)


def grouped(fps: DataFrame) -> DataFrame:
    """Components of (doc_id, fp) rows that are kept somewhere."""
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(edges(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = checkpointed(rooted.join(named, "root").select(F.col("fp").alias("of"), "component_id"))
    return fps.join(by_fp, fps["fp"] == by_fp["of"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity of shingle sets, for stages that take a threshold instead of a radius.

SLOTS, BANDS, ROWS = 256, 16, 3
#: Within this radius of SimHash a high estimate links two texts; over it the shingle sets decide on every likely pair.
WIDE = 20
#: Texts of one bucket, and bytes of their sets, that are compared in one go; larger buckets are compared by pairs of such parts.
TILE_TEXTS, TILE_BYTES = 4096, 16 << 20
_rng = np.random.Generator(np.random.PCG64(7))
_odd = _rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, ascending."""
    joined, starts, ends = shingles(text or "", n)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def signature(text: str | None, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(SimHash of the set of shingles, its minimum under each of BANDS * ROWS hash functions, a byte for each of SLOTS bins).

    A bin holds the hashes of equal first bits, and its byte stands for the least of them; 0 marks an empty bin.
    """
    h = shingle_set(text, n)
    slots = np.zeros(SLOTS, np.uint8)
    if not len(h):
        return 0, np.zeros(BANDS * ROWS, np.uint32), slots
    ones, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1 << 11):
        part = h[at : at + (1 << 11)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        x = part.astype(np.uint32)[None, :] * _odd[0]
        x ^= x >> np.uint32(15)
        x *= _odd[1]
        least = np.minimum(least, x.min(1))
    bins = (h >> np.uint64(56)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    slots[bins[first]] = (h[first] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]), least, slots


@lru_cache
def limits(similarity: float, tail: float) -> tuple[np.ndarray, np.ndarray]:
    """For each number m of bins that either of two texts fills: (equal bins from which the pair may be similar, equal bins
    from which it is). At the threshold a pair lies under the first, or over the second, in at most ``tail`` of cases each.

    The least hashes of m bins are a random part of the union, so that the equal ones follow a hypergeometric law; its
    tails are bounded by those of the binomial law, which are taken here. Where m is too small for a verdict the limits are
    0 and m + 1, and the shingle sets decide.
    """
    p = similarity + (1 - similarity) / 255  # a bin keeps a byte of its least hash
    low, high = np.zeros(SLOTS + 1, np.int64), np.ones(SLOTS + 1, np.int64)
    for m in range(1, SLOTS + 1):
        chance = [math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)]
        under = np.cumsum([0, *chance])
        over = np.cumsum([0, *chance[::-1]])[::-1]
        low[m], high[m] = np.flatnonzero(under[: m + 1] <= tail).max(), np.flatnonzero(over <= tail).min()
    return low, high


def _equal_bins(sigs: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins of each signature that equal those of ``one``, bins that either fills); eight are counted at once."""
    count = lambda mask: mask.view(np.uint64).sum(1).view(np.uint8).reshape(-1, 8).sum(1, dtype=np.int64)
    same, empty = count(sigs == one), count((sigs | one) == 0)
    return same - empty, SLOTS - empty


class Sets:
    """Sets of shingles of one bucket, for exact similarities of one text to many others at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.at = np.cumsum(self.sizes) - self.sizes
        universe, members = np.unique(np.concatenate(sets), return_inverse=True)
        self.members, self.mark = members.astype(np.int32), np.zeros(len(universe), bool)

    def similarities(self, q: int, others: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
        own = self.members[self.at[q] : self.at[q] + self.sizes[q]]
        self.mark[own] = True
        ends, common = np.cumsum(self.sizes[others]), []
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(at_once, ends[-1] + at_once, at_once)), len(others)])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = others[s:e]
            hit = np.concatenate([[0], np.cumsum(self.mark[self.members[ragged(self.at[part], self.sizes[part])]])])
            upto = np.cumsum(self.sizes[part])
            common.append(hit[upto] - hit[upto - self.sizes[part]])
        self.mark[own] = False
        n = np.concatenate(common)
        union = self.sizes[q] + self.sizes[others] - n
        return np.where(union > 0, n / np.maximum(union, 1), 1.0)  # texts without words are alike


def _similar_links(fps: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], part: np.ndarray, similarity: float, tail: float) -> np.ndarray:
    """For each text of a tile the place of the first of its component. Texts of two parts are compared across the parts.

    The estimates come first; whom they leave open, and no link has joined yet, the sets of shingles decide on.
    """
    n, (maybe, sure) = len(fps), limits(similarity, tail)
    sliced, root, exact = BitPlanes(fps), np.arange(n), None
    across = part.min() != part.max()

    def join(q: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if root[j] != root[q]:
                one, two = sorted((root[j], root[q]))
                root[root == two] = one

    for q in range(n - 1):
        if q % TILE == 0:
            tile = np.arange(q, min(q + TILE, n))
            near = np.unpackbits(sliced.within(fps[tile], WIDE, tile).view(np.uint8), axis=1, bitorder="little")
        later = np.flatnonzero(root[q + 1 :] != root[q]) + q + 1
        if across:
            later = later[part[later] != part[q]]
        if not len(later):
            continue
        alike, filled = _equal_bins(sigs[later], sigs[q])
        linking = (near[q % TILE][later] > 0) & (alike >= sure[filled])
        join(q, later[linking])
        left = later[(alike >= maybe[filled]) & ~linking]
        left = left[root[left] != root[q]]
        if len(left):
            exact = exact or Sets(sets)
            join(q, left[exact.similarities(q, left) >= similarity])
    return root


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, tail: float = 1e-5) -> DataFrame:
    """(row, component) of each distinct text, row = xxhash64(text): components of texts of that similarity.

    Texts meet in buckets of equal minima (16 bands of 3: two texts of similarity 0.8 miss each other once in 100,000);
    of buckets that hold the same texts one is compared. There the texts' 256 bins estimate the Jaccard similarity of the
    shingle sets with a deviation of at most 0.025, beside a bit-sliced SimHash of the sets. The estimate decides alone only
    where at most ``tail`` of the pairs at the threshold get so low or so high a one (about 4.4 deviations either side),
    and links only within the wide radius of SimHash; of all other pairs the shingle sets themselves decide. A pair of
    similarity 0.8 is missed about twice in 100,000 (bands and estimate), one just below is linked once in 100,000 at most.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64("text").alias("row"), "text")
    schema = pa.schema([("row", pa.int64()), ("fp", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            got = [signature(t, shingle) for t in text_column(part).to_pylist()]
            fps = np.array([g[0] for g in got], np.uint64).view(np.int64)
            bands = [[xxhash.xxh64_intdigest(g[1][ROWS * b : ROWS * (b + 1)].tobytes(), b) - (1 << 63) for b in range(BANDS)] for g in got]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), pa.array([g[2].tobytes() for g in got], pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    signed = checkpointed(texts.mapInArrow(tidy(sign), "row bigint, fp bigint, sig binary, bands array<bigint>").dropDuplicates(["row"]))
    dealt = signed.select("row", F.explode("bands").alias("band"))
    content = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"c{k}") for k in (0, 1)]
    sizes = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("size"), *content).where("size > 1")
    some = checkpointed(dealt.join(sizes.groupBy("size", "c0", "c1").agg(F.min("band").alias("band")).select("band", "size"), "band"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sets = pa.array([shingle_set(t, shingle).tobytes() for t in text_column(part).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["row", "members"])

    nodes = some.select("row").distinct()
    sets = checkpointed(texts.join(nodes, "row").dropDuplicates(["row"]).mapInArrow(tidy(hashed), "row bigint, members binary"))
    known = signed.select("row", "fp", "sig").join(sets, "row")
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("size") / TILE_TEXTS, F.col("bytes") / TILE_BYTES))).cast("int")
    weights = some.join(sets.select("row", F.octet_length("members").alias("n")), "row").groupBy("band").agg(F.sum("n").alias("bytes"))
    own = F.pmod(F.xxhash64("row", F.lit(3)), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("i"), F.greatest(t, F.col("own")).alias("j")))
    placed = some.join(weights, "band").withColumn("parts", parts).withColumn("own", own)
    met = placed.select("row", "band", "own", F.explode(tiles).alias("t")).select("row", "band", "own", "t.i", "t.j").join(known, "row")
    edge_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                ids, part = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                fps, sigs = np.array([r[2] for r in rows], np.int64).view(np.uint64), np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, SLOTS)
                root = _similar_links(fps, sigs, [np.frombuffer(r[4], np.uint64) for r in rows], part, similarity, tail)
                keep = root != np.arange(len(ids))
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[root[keep]])], schema=edge_schema)

        rows, last = [], None
        for batch in batches:
            for band, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, i, j) != last:
                    yield from done(rows)
                    rows, last = [], (band, i, j)
                rows.append(tuple(row))
        yield from done(rows)

    laid = met.select("band", "i", "j", "row", "own", "fp", "sig", "members").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    roots = components(laid.mapInArrow(tidy(link), "a bigint, b bigint"))
    return signed.select("row").join(roots, signed["row"] == roots["node"], "left").select("row", F.coalesce("root", "row").alias("component"))

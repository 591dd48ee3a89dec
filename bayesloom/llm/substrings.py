"""Substring dedup: a document is streamed through suffix automata of the documents that may hold its passages first.

The plain form of the method streams every document through the automaton of every reference shard, which grows with the
square of the corpus. Here an automaton meets only the text that can match it:

1. Each window of ``window`` words has an anchor, its 8 words of smallest hash; anchors that two documents hold are found
   by a packed exchange. Exact copies are set aside: all but the first lose all their windows.
2. Around shared anchors windows are named by hash, and each learns the first document that holds it.
3. Every first document's runs of shared windows become a suffix automaton over its words (a reference shard: one
   document, cut into blocks of bounded size). The runs of later documents that name it, equal runs once, are streamed
   through it for matching statistics; where the matched length reaches ``window`` words, the window is confirmed.
4. Words covered by confirmed windows are removed; all other words are kept, joined by one space.

An automaton is handed to the task that holds its document's runs instead of being broadcast to all, since the shards
together grow with the corpus; a task holds one block's automaton at a time.

Nulls: a null text has no words; a null id counts as larger than any other, and null ids never take words from each
other. Rows with equal ids never take words from each other. Texts of any length are
worked on whole: one longer than a piece of work is a piece by itself. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, Rolling, checkpointed, chunks, flat, release, small_batches, text_column, tidy, word_spans
from .exchange import KEY_MASK, bucket_count, first_holders, gathered, gathered_first, shared_names, short, told_names, unsix
from .suffixes import _ints, _runs, pieces, positions

WINDOW = 50
ANCHOR = 8
#: Words of one automaton.
BLOCK = 50_000
LAST = (1 << 63) - 1


class Automaton:
    """Suffix automaton of one or more sequences of integers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, sequence: list[int]) -> None:
        """Add a sequence; matches never run over its ends."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[last] + 1)
                link[q] = clone
                p = last
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                last = clone
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[cur] = clone
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
            last = cur

    def statistics(self, sequence: list[int]) -> np.ndarray:
        """At each place the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        out, s, n = np.zeros(len(sequence), np.int64), 0, 0
        for i, c in enumerate(sequence):
            t = nxt[s].get(c)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(c)
            if t is None:
                n = 0
            else:
                s, n = t, n + 1
            out[i] = n
        return out


def sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """The best of each ``size`` neighbours, by doubling."""
    have, step = x, 1
    while 2 * step <= size:
        have = best(have[:-step], have[step:])
        step *= 2
    rest = size - step
    return best(have[: len(have) - rest], have[rest:]) if rest else have


class Text:
    """The words of several documents as 64-bit symbols."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.before = word_spans(raw, offsets)
        self.symbols = Rolling(LETTER[raw]).spans(self.starts, self.ends)
        self.rolling = Rolling(self.symbols)
        self.sizes = np.diff(self.before)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word within it, name) of the least 8 words of each window of each document."""
        size = min(ANCHOR, window)
        h, reach = self.rolling.windows(size), window - size + 1
        none = np.zeros(0, np.int64)
        if len(h) < reach:
            return none, none, none.view(np.uint64)
        low = sliding(h, reach, np.minimum)
        pad = np.zeros(reach - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([pad, low, pad]), reach, np.maximum) == h)
        doc = np.searchsorted(self.before, at, "right") - 1
        own = (at + size <= self.before[doc + 1]) & (self.sizes[doc] >= window)
        return doc[own], (at - self.before[doc])[own], h[at[own]]

    def windows(self, doc: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
        start = self.before[doc] + at
        return self.rolling.spans(start, start + window)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"doc": F.coalesce("doc_id", F.lit(LAST)), "k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("row"), "text")})


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, n_removed, kept) of each row of ``keyed(docs)`` that loses words, once for equal rows."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors, wide = bucket_count(total / 128), bucket_count(total / 64)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def names() -> Iterator[tuple]:
            for part in chunks(batches):
                doc, _, found = Text(*flat(text_column(part))).anchors(window)
                yield part.column(1).to_numpy().view(np.uint64)[doc], found, None

        yield from gathered(names(), anchors)

    first = shared_names(rows.select("text", "k1"), send_anchors, anchors)
    same = rows.groupBy("k2", F.xxhash64("text").alias("k3")).agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = checkpointed(rows.select("k1", "k2", "doc", F.xxhash64("text").alias("k3")).join(same, ["k2", "k3"]).where("doc > least").select("k1", "k2").distinct())

    packed = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("z", pa.binary()), ("at", pa.binary())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in chunks(batches):
            raw, offsets = flat(text_column(part))
            text = Text(raw, offsets)
            doc, at, names = text.anchors(window)
            names, cuts = short(names), np.searchsorted(doc, np.arange(part.num_rows + 1))
            told, out = part.column(4).to_pylist(), []
            for k in range(part.num_rows):
                own, n = slice(cuts[k], cuts[k + 1]), int(text.sizes[k]) - window + 1
                here = at[own][np.isin(names[own], told_names(told[k]))]
                if len(here) and n > 0:
                    near = np.zeros(n + 1, np.int64)
                    np.add.at(near, np.clip(here - window + min(ANCHOR, window), 0, n), 1)
                    np.add.at(near, np.minimum(here + 1, n), -1)
                    out.append((k, squeeze.compress(raw[offsets[k] : offsets[k + 1]].tobytes()), _ints(_runs(np.cumsum(near)[:-1] > 0))))
            take = pa.array([o[0] for o in out], pa.int32())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in (1, 2, 3)), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], schema=packed)

    gone = copies.groupBy(F.col("k1").bitwiseAND(F.lit(KEY_MASK)).alias("dkey")).agg(F.collect_set(F.struct("k1", "k2")).alias("gone"))
    told = first.join(gone, "dkey", "left")  # small rows, so that the texts are moved once
    joined = rows.join(told, rows["k1"].bitwiseAND(F.lit(KEY_MASK)) == told["dkey"])
    joined = joined.where(~F.coalesce(F.array_contains("gone", F.struct(rows["k1"].alias("k1"), rows["k2"].alias("k2"))), F.lit(False)))
    held = checkpointed(joined.select("text", "k1", "k2", "doc", "told").mapInArrow(tidy(locate), "k1 bigint, k2 bigint, doc bigint, z binary, at binary"))
    del first, gone, told, joined
    release(docs.sparkSession)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def names() -> Iterator[tuple]:
            for part, texts, piece in pieces(batches, "z"):
                text = Text(np.frombuffer(b"".join(texts), np.uint8), piece.offsets)
                doc, at = positions(part.column(2))
                yield part.column(0).to_numpy()[doc], text.windows(doc, at, window)

        yield from gathered_first(names(), wide)

    holders = first_holders(held.select("doc", "z", "at"), send_windows, wide)
    run_schema = pa.schema([("role", pa.int32()), ("owner", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("words", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, piece in pieces(batches, "z"):
            text = Text(np.frombuffer(b"".join(texts), np.uint8), piece.offsets)
            doc, at = positions(part.column(4))
            names, cuts = short(text.windows(doc, at, window)), np.searchsorted(doc, np.arange(part.num_rows + 1))
            told, own_doc, out = part.column(5).to_pylist(), part.column(2).to_pylist(), []
            k1, k2 = part.column(0).to_pylist(), part.column(1).to_pylist()
            for k in range(part.num_rows):
                own = slice(cuts[k], cuts[k + 1])
                known = unsix(b"".join(t["names"] for t in told[k]))
                owners = np.frombuffer(b"".join(t["owners"] for t in told[k]), "<i8")
                order = np.argsort(known)
                known, owners = known[order], owners[order]
                place = np.minimum(np.searchsorted(known, names[own]), len(known) - 1)
                hit = known[place] == names[own]
                here, owner = at[own][hit], owners[place[hit]]
                if not len(here):
                    continue
                breaks = np.flatnonzero((np.diff(here) != 1) | (np.diff(owner) != 0)) + 1
                base = text.before[k]
                for s, e in zip([0, *breaks.tolist()], [*breaks.tolist(), len(here)], strict=True):
                    words = text.symbols[base + here[s] : base + here[e - 1] + window].tobytes()
                    role = int(owner[s] != own_doc[k])
                    digest = np.frombuffer(hashlib.blake2b(words, digest_size=16).digest(), "<i8").tolist()
                    out.append((role, int(owner[s]), k1[k], k2[k], int(here[s]), *digest, words))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(run_schema)], schema=run_schema)

    cuts = held.join(holders, "doc").select("k1", "k2", "doc", "z", "at", "told")
    runs = checkpointed(cuts.mapInArrow(tidy(cut), "role int, owner bigint, k1 bigint, k2 bigint, start bigint, c1 bigint, c2 bigint, words binary"))
    hit_schema = pa.schema([("owner", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("found", pa.binary())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by (owner, role): each owner's runs build automata, then the runs that name it pass through."""
        owner, blocks, room = None, [], 0
        for batch in batches:
            out = []
            for o, role, c1, c2, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if o != owner:
                    owner, blocks, room = o, [], 0
                sequence = np.frombuffer(words, "<u8")
                if role == 0:
                    for s in range(0, max(1, len(sequence) - window + 1), BLOCK):
                        part = sequence[s : s + BLOCK + window - 1].tolist()
                        if len(part) > room:
                            blocks.append(Automaton())
                            room = BLOCK + window - 1
                        blocks[-1].extend(part)
                        room -= len(part)
                else:
                    found = np.zeros(len(sequence), bool)
                    for block in blocks:
                        found |= block.statistics(sequence.tolist()) >= window
                    if found.any():
                        out.append((o, c1, c2, _ints(_runs(found[window - 1 :]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(hit_schema)], schema=hit_schema)

    distinct = runs.select("owner", "role", "c1", "c2", "words").dropDuplicates(["owner", "role", "c1", "c2"])
    matched = checkpointed(distinct.repartition("owner").sortWithinPartitions("owner", "role").mapInArrow(tidy(match), "owner bigint, c1 bigint, c2 bigint, found binary"))
    confirmed = runs.where("role = 1").select("k1", "k2", "owner", "c1", "c2", "start").join(matched, ["owner", "c1", "c2"])
    by_row = confirmed.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "found")).alias("runs"))
    result = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, _ in pieces(batches, "z"):
            out, runs_of = [], part.column(3).to_pylist()
            for k, text in enumerate(texts):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for r in runs_of[k]:
                    found = np.frombuffer(r["found"], "<i8").reshape(-1, 2) + r["start"]
                    np.add.at(gone, found[:, 0], 1)
                    np.add.at(gone, found[:, 1] - 1 + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                out.append((int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], schema=result)

    partly = held.join(by_row, ["k1", "k2"]).select("k1", "k2", "z", "runs").mapInArrow(tidy(remove), "k1 bigint, k2 bigint, n_removed bigint, kept binary").dropDuplicates(["k1", "k2"])
    wholly = copies.select("k1", "k2", F.lit(None).cast("bigint").alias("n_removed"), F.lit(b"").alias("kept"))
    return partly.unionByName(wholly)


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("whole", pa.string())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words = [t.encode("utf-8", "surrogatepass").split() for t in text_column(part).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())], schema=schema)

    every = keyed(docs).select("doc_id", "k1", "k2", "text").mapInArrow(tidy(count), "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, whole string")
    found = repeats(docs, window).select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("sha"), F.lit(True).alias("hit"))
    gone = F.when(F.col("hit") & ((F.col("n_words") >= window) | F.col("n_removed").isNotNull()), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0).cast("bigint"))
    return every.join(found, ["k1", "k2"], "left").select("doc_id", "n_words", gone.alias("n_removed"), F.when(gone > 0, F.col("sha")).otherwise(F.col("whole")).alias("kept_sha256"))

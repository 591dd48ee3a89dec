"""Which names occur more than once, asked for packed arrays of names instead of rows.

A task puts some hundred thousand names of its texts together (48 bits of a 64-bit hash, or all 64 where the answer is a
verdict) and sends them to buckets by name, each with the 40-bit key of its document. A bucket answers each document with
those of its names that occur at least twice anywhere. A name that occurs twice among those put together is answered at
once, and sent on once without a document, so that a name that a third of all documents hold comes to its bucket once
for each such lot, not once a document. The number of buckets follows the input, so
a bucket's size does not. Keys and names are hashes: a document may be told a name too many, never one too few, and
callers look names up in their own document's list of names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

KEY_MASK = (1 << 40) - 1
#: Stands for the documents of one lot that were told of a name at once; nobody is told under it.
ALL_TOLD = 1 << 40
#: Names that one bucket gets, about.
BUCKET_NAMES = 1_000_000
#: Names that a task puts together before it deals them to buckets.
SEND_NAMES = 250_000
PACKED = "bucket int, local boolean, payload binary"
_packed = pa.schema([("bucket", pa.int32()), ("local", pa.bool_()), ("payload", pa.binary())])
_answers = pa.schema([("shard", pa.int32()), ("payload", pa.binary())])
_told = pa.schema([("dkey", pa.int64()), ("names", pa.binary())])


def short(names: np.ndarray, size: int = 6) -> np.ndarray:
    """The ``size`` bytes of a name that are sent."""
    return names >> np.uint64(64 - 8 * size)


def _six(x: np.ndarray, size: int = 6) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unsix(data: bytes, size: int = 6) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def _bucket(names: np.ndarray, buckets: int, size: int = 6) -> np.ndarray:
    """The bucket by the first 24 bits of a name."""
    return ((names >> np.uint64(8 * size - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def _pack(keys: np.ndarray, names: np.ndarray, multi: np.ndarray, size: int = 6) -> bytes:
    """Entries sorted by key: n, keys, counts, names, flags."""
    own, counts = np.unique(keys, return_counts=True)
    flags = np.packbits(multi).tobytes()
    return np.array([len(own), len(names)], "<u4").tobytes() + own.astype("<u8").tobytes() + counts.astype("<u4").tobytes() + _six(names, size) + flags


def _unpack(data: bytes, size: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n = np.frombuffer(data, "<u4", 2).tolist()
    at = 8 + 8 * k
    keys = np.repeat(np.frombuffer(data, "<u8", k, 8), np.frombuffer(data, "<u4", k, at))
    at += 4 * k
    return keys, unsix(data[at : at + size * n], size), np.unpackbits(np.frombuffer(data, np.uint8, -1, at + size * n))[:n].astype(bool)


def sent(keys: np.ndarray, names: np.ndarray, asked: np.ndarray | None, buckets: int, mode: str = "twice", size: int = 6) -> Iterator[pa.RecordBatch]:
    """The rows that one piece of text sends: (document key, name) of each place; ``asked`` marks places for two modes.

    twice: every place learns whether its name occurs twice. answer: the same, but only asked places are told.
    heard: every place learns whether its name is asked for anywhere; all places are sent on.
    """
    if not len(names):
        return
    names, keys = short(names, size), keys & np.uint64(KEY_MASK)
    mark = np.ones(len(names), bool) if asked is None else asked
    order = np.lexsort((~mark, keys, names))
    names, keys, mark = names[order], keys[order], mark[order]
    rows: list[tuple[int, bool, bytes]] = []
    if mode == "heard":
        first = np.concatenate([[True], (names[1:] != names[:-1]) | (keys[1:] != keys[:-1])])
        names, keys, mark = names[first], keys[first], mark[first]
    else:
        first = np.concatenate([[True], names[1:] != names[:-1]])
        run = np.cumsum(first) - 1
        many = np.bincount(run) > 1
        again = many[run] & mark
        if again.any():
            pairs = np.unique(np.stack([keys[again], names[again]], 1), axis=0)
            rows.append((int(pairs[0, 0]) % buckets, True, _pack(pairs[:, 0], pairs[:, 1], np.ones(len(pairs), bool), size)))
        names, keys, mark = names[first], np.where(many, np.uint64(ALL_TOLD), keys[first]), (many if mode == "twice" else mark[first] & ~many)
    bucket = _bucket(names, buckets, size)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        own = slice(cuts[b], cuts[b + 1])
        order = np.argsort(keys[own], kind="stable")
        rows.append((b, False, _pack(keys[own][order], names[own][order], mark[own][order], size)))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _packed, strict=True)], schema=_packed)


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]], buckets: int, mode: str = "twice", size: int = 6) -> Iterator[pa.RecordBatch]:
    """``sent`` for (keys, names, asked) of small pieces of text, put together until they are worth a row a bucket."""
    kept: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in parts:
        kept.append(tuple(x for x in part if x is not None))
        n += len(part[1])
        if n >= SEND_NAMES:
            yield from sent(*_joined(kept), buckets, mode, size)
            kept, n = [], 0
    if n:
        yield from sent(*_joined(kept), buckets, mode, size)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    keys, names, *asked = (np.concatenate(x) for x in zip(*parts, strict=True))
    return keys, names, asked[0] if asked else None


def _answered(keys: np.ndarray, names: np.ndarray, shards: int, size: int) -> pa.RecordBatch:
    """Answers packed by shard of the documents' keys."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((keys, shard))
    keys, names, shard = keys[order], names[order], shard[order]
    own = np.unique(shard)
    cuts = [*np.searchsorted(shard, own).tolist(), len(shard)]
    none = lambda n: np.zeros(n, bool)
    packed = [_pack(keys[s:e], names[s:e], none(e - s), size) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], schema=_answers)


def _tell(batches: Iterator[pa.RecordBatch], mode: str, shards: int, width: int) -> Iterator[pa.RecordBatch]:
    def told(parts: list[bytes], local: list[bytes]) -> Iterator[pa.RecordBatch]:
        found = [_unpack(p, width)[:2] for p in local]
        if parts:
            keys, names, multi = (np.concatenate(x) for x in zip(*(_unpack(p, width) for p in parts), strict=True))
            order = np.argsort(names, kind="stable")
            ordered = names[order]
            first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            run = np.cumsum(first) - 1
            marked = np.bincount(run, multi[order]) > 0
            several = np.bincount(run) > 1
            told_runs = {"twice": several | marked, "answer": several, "heard": marked}[mode]
            chosen = order[told_runs[run]]
            chosen = chosen[multi[chosen]] if mode == "answer" else chosen[keys[chosen] != ALL_TOLD]
            found.append((keys[chosen], names[chosen]))
        keys, names = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2
        if len(keys):
            yield _answered(keys, names, shards, width)

    parts: list[bytes] = []
    local: list[bytes] = []
    last, size = None, 0
    for batch in batches:
        for bucket, is_local, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last or size > 1 << 26 and is_local:  # answers of pieces may go out at any time
                yield from told(parts if bucket != last else [], local)
                parts, local, size = ([], [], 0) if bucket != last else (parts, [], 0)
                last = bucket
            (local if is_local else parts).append(payload)
            size += len(payload) * is_local
    yield from told(parts, local)


def _merge(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted by shard: a row for each document with all names that it is told of."""

    def merged(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        keys, names = (np.concatenate(x) for x in zip(*(_unpack(p, size)[:2] for p in parts), strict=True))
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])])
        keys, names = keys[new], names[new]
        own, counts = np.unique(keys, return_counts=True)
        offsets = np.concatenate([[0], size * np.cumsum(counts)]).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_six(names, size))])
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), lists], schema=_told)

    parts: list[bytes] = []
    last = None
    for batch in batches:
        for shard, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != last:
                yield from merged(parts)
                parts, last = [], shard
            parts.append(payload)
    yield from merged(parts)


def bucket_count(names: float) -> int:
    return int(min(1 << 20, max(4, -(-names // BUCKET_NAMES))))


def shared_names(rows: DataFrame, send: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], buckets: int, mode: str = "twice", size: int = 6) -> DataFrame:
    """(dkey, told): for each document key lists of the names that it is told of. ``send`` yields ``sent`` rows of the mode and size."""
    n = min(buckets, 4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.mapInArrow(tidy(send), PACKED).repartition(n, "bucket").sortWithinPartitions("bucket")
    answers = dealt.mapInArrow(tidy(lambda batches: _tell(batches, mode, buckets, size)), "shard int, payload binary")
    merged = answers.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(tidy(lambda batches: _merge(batches, size)), "dkey bigint, names binary")
    return merged.select("dkey", F.array("names").alias("told"))


def told_names(lists: list[bytes] | None, size: int = 6) -> np.ndarray:
    return np.unique(unsix(b"".join(lists), size)) if lists else np.zeros(0, np.uint64)


FIRSTS = "bucket int, payload binary"
_firsts = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
_holders = pa.schema([("doc", pa.int64()), ("names", pa.binary()), ("owners", pa.binary())])


def sent_first(docs: np.ndarray, names: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows that one piece sends to learn each name's first document: each (document, name) once."""
    if not len(names):
        return
    names = short(names)
    pairs = np.unique(np.stack([names, docs.view(np.uint64) ^ np.uint64(1 << 63)], 1), axis=0)
    names, docs = pairs[:, 0], (pairs[:, 1] ^ np.uint64(1 << 63)).view(np.int64)
    bucket = ((names >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
    order = np.lexsort((docs, bucket))
    names, docs, bucket = names[order], docs[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for b in np.unique(bucket).tolist():
        own = slice(cuts[b], cuts[b + 1])
        rows.append((b, _pack(docs[own].view(np.uint64), names[own], np.zeros(cuts[b + 1] - cuts[b], bool))))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _firsts, strict=True)], schema=_firsts)


def gathered_first(parts: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """``sent_first`` for (docs, names) of small pieces of text, put together until they are worth a row a bucket."""
    docs, names, n = [], [], 0
    for own, found in parts:
        docs.append(own)
        names.append(found)
        n += len(found)
        if n >= SEND_NAMES:
            yield from sent_first(np.concatenate(docs), np.concatenate(names), buckets)
            docs, names, n = [], [], 0
    if n:
        yield from sent_first(np.concatenate(docs), np.concatenate(names), buckets)


def _tell_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(parts: list[bytes]) -> pa.RecordBatch | None:
        if not parts:
            return None
        keys, names, _ = (np.concatenate(x) for x in zip(*map(_unpack, parts), strict=True))
        docs = keys.view(np.int64)
        order = np.lexsort((docs, names))
        names, docs = names[order], docs[order]
        new = np.concatenate([[True], names[1:] != names[:-1]])
        run = np.cumsum(new) - 1
        owner = docs[new][run]
        shared = (np.bincount(run, docs != owner) > 0)[run]
        names, docs, owner = names[shared], docs[shared], owner[shared]
        if not len(names):
            return None
        order = np.argsort(docs, kind="stable")
        own, counts = np.unique(docs, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(counts)])
        lists = [pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((size * ends).astype(np.int32).tobytes()), pa.py_buffer(data)]) for size, data in ((6, _six(names[order])), (8, owner[order].astype("<i8").tobytes()))]
        return pa.RecordBatch.from_arrays([pa.array(own), *lists], schema=_holders)

    parts: list[bytes] = []
    last = None
    for batch in batches:
        for bucket, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last:
                if (out := told(parts)) is not None:
                    yield out
                parts, last = [], bucket
            parts.append(payload)
    if (out := told(parts)) is not None:
        yield out


def first_holders(rows: DataFrame, send: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], buckets: int) -> DataFrame:
    """(doc, told): for each document lists of (6-byte names, 8-byte first document) of its names that others hold too."""
    n = min(buckets, 4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.mapInArrow(tidy(send), FIRSTS).repartition(n, "bucket").sortWithinPartitions("bucket")
    told = dealt.mapInArrow(tidy(_tell_first), "doc bigint, names binary, owners binary")
    return told.groupBy("doc").agg(F.collect_list(F.struct("names", "owners")).alias("told"))

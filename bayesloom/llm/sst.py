"""Token-ID output as sorted-string-table shards.

A shard is one file: data blocks, a Bloom filter over the keys, a sparse index with the first key of every block, and a
footer of fixed size. Keys ascend; within a block a key is stored as the length of the prefix that it shares with the key
before it and the bytes that follow. ``Shard.get`` finds a document by binary search in the index and reads one block.

File layout (little endian)
    block   zstd frame of entries: varint shared, varint rest, varint count, key[rest], count ids of ``width`` bytes
    bloom   bit array
    index   for each block: first key (KEY bytes), u64 offset, u32 length, u32 entries
    footer  u64 bloom offset, u64 bloom bytes, u32 hashes, u64 index offset, u32 blocks, u64 entries, u64 ids, u32 width, magic

Nulls: a null document id sorts before all others, a null text is an empty one. Repeated ids are kept, in the order of
the ids' hash of text, each with its ordinal. Texts of any length are
worked on whole: one longer than a piece of work is a piece by itself. An empty table gives no shard. Other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, chunks, filesystem, fresh_dir, small_batches, text_column, tidy
from .wordcache import encoder

MAGIC = b"LOOMSST1"
KEY = struct.Struct(">BQI")
ENTRY = struct.Struct(f"<{KEY.size}sQII")
FOOTER = struct.Struct("<QQIQIQQI8s")
BLOCK_BYTES = 1 << 16
#: Text that is encoded at once.
ENCODE_BYTES = 1 << 19
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    """Bytes that sort as (null first, id, ordinal)."""
    return KEY.pack(0, 0, ordinal) if doc_id is None else KEY.pack(1, doc_id + (1 << 63), ordinal)


def id_of(key: bytes) -> int | None:
    known, value, _ = KEY.unpack(key)
    return value - (1 << 63) if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_at(key: bytes, bits: int) -> list[int]:
    """Places of an id's bits; the ordinal is left out, so that a look-up needs the id alone."""
    h = xxhash.xxh64_intdigest(key[:9], 7)
    step = (h >> 32) | 1
    return [(h + i * step) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes (key, ids) pairs, which must come in ascending order of keys."""

    def __init__(self, out, width: int):
        self.out, self.width, self.dtype = out, width, {2: "<u2", 4: "<u4"}[width]
        self.at = self.ids = self.n = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self._open()

    def _open(self) -> None:
        self.block, self.first, self.last, self.entries = bytearray(), b"", b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        while shared < len(self.last) and self.last[shared] == key[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids.astype(self.dtype).tobytes()
        self.first, self.last, self.entries = self.first or key, key, self.entries + 1
        self.keys.append(key)
        self.n, self.ids = self.n + 1, self.ids + len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            packed = zstandard.ZstdCompressor(level=1).compress(bytes(self.block))
            self.index.append((self.first, self.at, len(packed), self.entries))
            self.out.write(packed)
            self.at += len(packed)
            self._open()

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-self.n * BLOOM_BITS // 8) * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for i in _bloom_at(key, bits):
                bloom[i >> 3] |= 1 << (i & 7)
        self.out.write(bytes(bloom))
        for row in self.index:
            self.out.write(ENTRY.pack(*row))
        self.out.write(FOOTER.pack(self.at, len(bloom), BLOOM_HASHES, self.at + len(bloom), len(self.index), self.n, self.ids, self.width, MAGIC))


class Shard:
    """Reads a shard from a seekable binary file; only footer, index and Bloom filter are held."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        size = file.tell()
        file.seek(size - FOOTER.size)
        bloom_at, bloom_len, self.hashes, index_at, blocks, self.n, self.n_ids, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.dtype = {2: "<u2", 4: "<u4"}[self.width]
        file.seek(bloom_at)
        self.bloom = file.read(bloom_len)
        file.seek(index_at)
        self.index = [ENTRY.unpack(file.read(ENTRY.size)) for _ in range(blocks)]
        self.firsts = [x[0] for x in self.index]

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, length, entries = self.index[k]
        self.file.seek(at)
        data, at, key = zstandard.ZstdDecompressor().decompress(self.file.read(length)), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            count, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, self.dtype, count, at)
            at += count * self.width

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that id, none if the shard holds none."""
        key = key_of(doc_id)
        if any(not self.bloom[i >> 3] >> (i & 7) & 1 for i in _bloom_at(key, 8 * len(self.bloom))):
            return []
        k = max(0, bisect_right(self.firsts, key) - 1)
        found = []
        while k < len(self.index) and self.index[k][0][:9] <= key[:9]:
            found += [ids for other, ids in self._block(k) if other[:9] == key[:9]]
            k += 1
        return found


MANIFEST = "shard int, path string, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint"
_manifest = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_shards(docs: DataFrame, vocabulary: str, uri: str, end_id: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write one shard for each range of ids under ``uri``; returns the manifest.

    Each attempt of a task writes a file of its own, and the manifest, kept in the shared folder, names the file of the
    attempt that counted; a lost executor costs its running tasks only.
    """
    small_batches(docs.sparkSession)
    fs, folder = filesystem(uri)
    fs.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, first, last, ordinal, sink = TaskContext.get().partitionId(), None, None, None, 0, None
        path = f"{uri}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        for part in chunks(batches, ENCODE_BYTES):
            pa.default_memory_pool().release_unused()
            ids, at = encoder(vocabulary).encode(text_column(part))
            if writer is None:
                fs, file = filesystem(path)
                sink = fs.open_output_stream(file)
                writer = Writer(sink, 2 if encoder(vocabulary).full.get_vocab_size() <= 1 << 16 else 4)
            ends = np.array([] if end_id is None else [end_id], np.uint32)
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                ordinal = ordinal + 1 if writer.n and doc_id == last else 0
                first, last = (doc_id if not writer.n else first), doc_id
                writer.add(key_of(doc_id, ordinal), np.concatenate([ids[at[k] : at[k + 1]], ends]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "first_id": first, "last_id": last, "n_docs": writer.n, "n_ids": writer.ids}], _manifest)

    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return checkpointed(ordered.mapInArrow(tidy(write, vocabulary), MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, read from the files; start counts the ids of all documents before it."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, file = filesystem(row["path"])
                with fs.open_input_file(file) as f:
                    start, out, size = row["before"], ([], [], []), 0
                    for doc_id, ids in Shard(f).scan():
                        for column, value in zip(out, (doc_id, start, ids.astype(np.int32)), strict=True):
                            column.append(value)
                        start, size = start + len(ids), size + len(ids)
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)
                            out, size = ([], [], []), 0
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(n, "shard").mapInArrow(tidy(read), "doc_id bigint, start bigint, ids array<int>")


def find(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents of ``ids(doc_id)``: each id goes to the shards whose range holds it, and is found there
    by the Bloom filter, a binary search in the index and one block. The manifest (a row a shard) is broadcast."""
    first, last = F.col("first_id"), F.col("last_id")
    null = (first.isNull(), last.isNull())  # null ids come first of all
    inside = F.when(F.col("doc_id").isNull(), null[0]).otherwise((null[0] | (first <= F.col("doc_id"))) & ~null[1] & (F.col("doc_id") <= last))
    asked = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(F.broadcast(manifest.select("path", "first_id", "last_id")), inside)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, file = None, None, None
        for batch in batches:
            found = ([], [])
            for doc_id, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != last:
                    if file is not None:
                        file.close()
                    fs, name = filesystem(path)
                    file, last = fs.open_input_file(name), path
                    shard = Shard(file)
                for own in shard.get(doc_id):
                    found[0].append(doc_id)
                    found[1].append(own.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(found, schema, strict=True)], schema=schema)
        if file is not None:
            file.close()

    dealt = asked.select("doc_id", "path").repartition("path").sortWithinPartitions("path", "doc_id")
    return dealt.mapInArrow(tidy(look), "doc_id bigint, ids array<int>")


def digests(read: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            sums = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], schema=schema)

    return read.mapInArrow(tidy(digest), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_shards(docs: DataFrame, vocabulary: str, uri: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Write ``docs`` as shards (under a fresh shared folder unless ``uri`` is given) and read them back."""
    return read_shards(write_shards(docs, vocabulary, uri or fresh_dir(docs.sparkSession, "sst"), end_id))

"""Helpers shared by the operators: shared storage, packed rows, and byte-level text arithmetic.

Text arithmetic works on Arrow buffers: the UTF-8 bytes of a whole batch are one ``uint8`` array, and words, windows
and their hashes are computed for all documents of the batch at once.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import fresh_dir, shared_dir  # noqa: F401  operators take them from here

#: Documents are worked on in pieces of about so many bytes of text, whatever the batch or the partition holds.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder until nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """An object that this worker process keeps between tasks, such as an encoder."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: str = ""):
    """``run`` for mapInArrow, with a worker's memory kept small: what other operators have left in a reused process goes
    first (all but ``holds``), and freed memory is given back when the task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [x for x in _held if x != holds]:
            del _held[name]
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own
            if trim:
                trim(0)

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Bound the batches between Spark and Python by bytes, unless the session has its own bound: long texts make large rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps that nothing refers to any more.

    Otherwise they stay until the driver happens to collect its garbage, and add to the disk that later steps need.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind as long as ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def filesystem(uri: str):
    """(file system, path) for a folder or file that any executor can reach."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column with nulls as empty texts, free of slicing offsets."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")
    return pa.concat_arrays([col]) if col.offset else col


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` bytes of text, or a single document."""
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lens, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets) of a large_string array without nulls."""
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
LETTER = _rng.integers(0, 1 << 64, 256, np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, which: str = "up") -> np.ndarray:
    """BASE**i, or its inverse, modulo 2**64 for i below n."""
    have = _powers[which]
    if len(have) < n:
        step = np.uint64(BASE if which == "up" else pow(BASE, -1, 1 << 64))
        full = np.full(max(n, len(have) + len(have) // 4), step, np.uint64)
        full[0] = 1
        _powers[which] = have = np.multiply.accumulate(full)
    return have[:n]


class Rolling:
    """Hashes of any span of a sequence of 64-bit symbols in constant time each."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * powers(len(symbols)), out=self.sums[1:])
        self.down = powers(len(symbols) + 1, "down")

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """The hash at every start of a window of n symbols."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n] + np.uint64(n))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document) of the runs of ``[^\\x20\\x09-\\x0D]`` within each document."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~WHITESPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers start, start + 1, ... of each (start, length) in one array."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)

"""SentencePiece models on the tokenizers library.

``read_model`` parses the model's protobuf; ``backend`` rebuilds it: the normaliser (precompiled character map, extra
white space, the metaspace marker), unigram scores or BPE merges, user-defined symbols and byte fallback. No piece may
hold a marker behind another character, so a text is cut before each run of markers without changing its encoding; the
distinct segments of a batch are encoded in batches by the library's threads, and remembered. Texts that the cut doesn't
fit (runs of blanks, blanks at an end, markers) run through the whole tokenizer. ``compare`` encodes with the
sentencepiece library too and says for each text whether the ids are the same.

Nulls: a null text is empty and has no ids; a null id is kept, as are repeated rows. Texts of any length are
worked on whole: one longer than a piece of work is a piece by itself. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from .common import chunks, flat, held, ragged, small_batches, text_column, tidy
from .wordcache import Memory, WordEncoder, encode_words

MARK = "▁"
#: Kinds of pieces and of models in the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_extra: bool = True
    escape: bool = True


def read_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(fields(value))
            spec.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            own = dict(fields(value))
            spec.kind, spec.unk_id = own.get(3, UNIGRAM), own.get(40, 0)
            spec.byte_fallback, spec.suffix = bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(fields(value))
            spec.charsmap = own.get(2, b"")
            spec.dummy_prefix, spec.strip_extra, spec.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
    if spec.suffix or not spec.escape:
        raise ValueError("models that mark white space behind words or not at all aren't supported")
    return spec


def merges_of(spec: Spec) -> list[tuple[str, str]]:
    """The pairs that make up each piece, in order of the piece's score: the order of merges."""
    place = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    ranked = sorted((i for i, (p, _, kind) in enumerate(spec.pieces) if kind == NORMAL and len(p) > 1), key=lambda i: (-spec.pieces[i][1], i))
    out = []
    for i in ranked:
        piece = spec.pieces[i][0]
        pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in place and piece[k:] in place]
        out += sorted(pairs, key=lambda lr: (place[lr[0]], place[lr[1]]))
    return out


def backend(spec: Spec) -> Tokenizer:
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unk_id, spec.byte_fallback)
    elif spec.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocab, merges_of(spec), unk_token=spec.pieces[spec.unk_id][0], fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=1)
    else:
        raise ValueError("only unigram and BPE models are supported")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.strip_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
    steps += [normalizers.Prepend(MARK)] if spec.dummy_prefix else []
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    t.add_tokens([AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER_DEFINED])
    return t


class PieceEncoder(WordEncoder):
    """Ids of whole texts by segments, and back."""

    def __init__(self, path: str, max_words: int = 600_000):
        with open(path, "rb") as f:
            self.spec = read_model(f.read())
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.full, self.bare = backend(self.spec), backend(self.spec)
        self.bare.normalizer = None
        usable = [p for p, _, kind in self.spec.pieces if kind in (NORMAL, USER_DEFINED)]
        plain = not self.spec.charsmap and self.spec.dummy_prefix and not any(kind == USER_DEFINED for _, _, kind in self.spec.pieces)
        self.cuttable = plain and not any(MARK in p.lstrip(MARK) for p in usable)
        table = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.spec.pieces]
        self.out = np.frombuffer(b"".join(table), np.uint8)
        self.out_size = np.fromiter(map(len, table), np.int64, len(table))
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.memory = Memory(max_words, np.uint32)

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw, offsets = flat(texts)
        blank = np.flatnonzero(raw == 0x20)
        starts, ends = np.sort(np.concatenate([offsets[:-1], blank + 1])), np.sort(np.concatenate([blank, offsets[1:]]))
        return raw, starts, ends, np.concatenate([[0], np.searchsorted(blank, offsets[1:]) + np.arange(1, len(offsets))])

    def learn(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        marked = [MARK + s.decode() for s in segments]
        return encode_words(self.bare, marked)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False) if self.cuttable else np.ones(len(texts), bool)
        if not odd.any():
            return super().encode(texts)
        some = np.flatnonzero(odd)
        slow = {int(k): np.array(e.ids, np.uint32) for k, e in zip(some, self.full.encode_batch_fast(texts.take(pa.array(some)).to_pylist(), add_special_tokens=False), strict=True)}
        rest = pa.concat_arrays([texts.filter(pa.array(~odd))])
        ids, at = super().encode(rest) if len(rest) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        parts, k = [], 0
        for i in range(len(texts)):
            if i in slow:
                parts.append(slow[i])
            else:
                parts.append(ids[at[k] : at[k + 1]])
                k += 1
        return np.concatenate(parts or [ids]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, n + 1 offsets); the blank that stands for the marker put in front is taken off."""
        size = self.out_size[ids]
        raw = self.out[ragged(self.out_at[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        if self.spec.dummy_prefix and len(raw):
            first = ends[:-1][ends[1:] > ends[:-1]]
            keep = np.ones(len(raw), bool)
            keep[first[raw[first] == 0x20]] = False
            raw, ends = raw[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
        return raw, ends


def piece_encoder(path: str) -> PieceEncoder:
    return held(path, lambda: PieceEncoder(path))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every document's whole text."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2 << 20):
            ids, at = piece_encoder(model).encode(text_column(part))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run, model), "doc_id bigint, ids array<int>")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows; a null list gives an empty text."""
    small_batches(tokens.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).to_pylist()
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            raw, ends = piece_encoder(model).decode(ids, np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64))
            data = raw.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([data[s:e].decode("utf-8", "replace") for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())], schema=schema)

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(tidy(run, model), "doc_id bigint, text string")


def compare(docs: DataFrame, model: str, parity: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_ok, same_ids) of every document.

    ``decoded_ok`` says that decoding gives the text back; ``same_ids`` that the sentencepiece library gives the same ids
    (null unless ``parity``).
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_ok", pa.bool_()), ("same_ids", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        coder = piece_encoder(model)
        other = sentencepiece.SentencePieceProcessor(model_file=model) if parity else None
        for part in chunks(batches, 1 << 20):
            pa.default_memory_pool().release_unused()
            texts = text_column(part)
            ids, at = coder.encode(texts)
            raw, ends = coder.decode(ids, at)
            data, plain, back = ids.astype("<u4").tobytes(), texts.to_pylist(), raw.tobytes()
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            same = [None] * len(plain)
            if other:
                same = [bool(np.array_equal(np.array(x, np.uint32), ids[s:e])) for x, (s, e) in zip(other.encode(plain, num_threads=1), spans, strict=True)]
            ok = [back[s:e] == t.encode("utf-8", "surrogatepass") for t, s, e in zip(plain, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array([zlib.crc32(data[4 * s : 4 * e]) for s, e in spans], pa.int64()), pa.array(ok, pa.bool_()), pa.array(same, pa.bool_())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run, model), "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_ok boolean, same_ids boolean")

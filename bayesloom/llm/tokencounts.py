"""Token counts by section: a document is encoded once, and its tokens' character spans are joined with its sections'.

The vocabulary is a byte-level BPE whose pieces (words with the blank before them, runs of white space, ...) are encoded
independently; the distinct pieces of a batch are encoded once and remembered with each token's characters. A section is
a half-open span of characters. A token belongs to the section that holds all of its characters; one that crosses a
boundary goes by the rule:

    most    to the section that holds most of its characters, the earlier one if two hold as many
    start   to the section that holds its first character
    split   to each section in proportion to its characters there (counts become fractions)

Characters of no section count under no section; overlapping sections each count their tokens.

Nulls: a null text is empty, a null list of sections is none, a section with a null bound or of no length gets 0. Each
section of each row gives a row. Repeated rows are kept; null ids are kept. Texts of any length are
worked on whole: one longer than a piece of work is a piece by itself. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import chunks, flat, held, small_batches, text_column, tidy
from .wordcache import Memory, WordEncoder, byte_letters, encode_words

RULES = ("most", "start", "split")
#: How the vocabulary cuts a text into pieces (a fixed public pattern).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class SpanEncoder(WordEncoder):
    """Ids and character spans of whole texts. A remembered token is id | start << 20 | end << 42 within its piece."""

    def __init__(self, path: str, max_words: int = 400_000):
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        cut = self.full.pre_tokenizer
        if not isinstance(cut, ByteLevel) or cut.add_prefix_space or not cut.use_regex or self.full.normalizer is not None:
            raise ValueError("the vocabulary must cut texts by the byte-level pattern, without a normaliser or a blank put in front")
        if self.full.get_vocab_size(with_added_tokens=True) > 1 << 20:
            raise ValueError("the vocabulary has ids over 20 bits")
        self.bare, self.pattern, self.letters = Tokenizer(self.full.model), regex.compile(PIECES), byte_letters()
        vocabulary = self.full.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))  # a letter of a token stands for a byte
        self.memory = Memory(max_words, np.uint64)

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw, offsets = flat(texts)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that holds each byte
        first = np.append(np.flatnonzero(np.diff(char, prepend=-1)), len(raw))  # and where each begins
        pieces = [self.pattern.findall(t) for t in texts.to_pylist()]
        ends = first[np.cumsum(np.fromiter((len(p) for found in pieces for p in found), np.int64))]
        return raw, np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends, np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])

    def learn(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = encode_words(self.bare, [s.decode("latin-1").translate(self.letters) for s in segments])
        raw = np.frombuffer(b"".join(segments), np.uint8)
        ends = np.cumsum(self.bytes_of[ids])
        char = np.cumsum((raw & 0xC0) != 0x80)
        base = np.repeat(np.concatenate([[0], char[np.cumsum(list(map(len, segments)))[:-1] - 1]]), counts)
        starts, ends = char[np.concatenate([[0], ends[:-1]])] - 1 - base, char[ends - 1] - base
        return ids.astype(np.uint64) | starts.astype(np.uint64) << np.uint64(20) | ends.astype(np.uint64) << np.uint64(42), counts

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends, n + 1 offsets): characters are counted from each text's start."""
        if (pc.max(pc.utf8_length(texts)).as_py() or 0) >= 1 << 22:  # a piece may be too long for the packed form
            encoded = self.full.encode_batch(texts.to_pylist(), add_special_tokens=False)
            spans = np.array([s for e in encoded for s in e.offsets], np.int64).reshape(-1, 2)
            return np.array([i for e in encoded for i in e.ids], np.int64), spans[:, 0], spans[:, 1], np.concatenate([[0], np.cumsum([len(e.ids) for e in encoded])])
        raw, begin, end, at = self.segments(texts)
        packed, n = self.memory.all_ids(self.memory.look_up(raw, begin, end, self.learn))
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        base = chars[begin] - np.repeat(chars[np.append(begin, len(raw))[at[:-1]]], np.diff(at))
        base = np.repeat(base, n)
        mask = np.uint64((1 << 22) - 1)
        ids = (packed & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = base + (packed >> np.uint64(20) & mask).astype(np.int64)
        ends = base + (packed >> np.uint64(42)).astype(np.int64)
        return ids, starts, ends, np.concatenate([[0], np.cumsum(n)])[at]


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str) -> np.ndarray:
    """Tokens of each section; starts and ends ascend. Only tokens that a section's bounds cut are looked at one by one."""
    out = np.zeros(len(sections))
    cut: dict[int, list[int]] = {}
    for k, (s, e) in enumerate(sections):
        if e <= s:
            continue
        first, last = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e, "left"))  # tokens that touch it
        whole, stop = int(np.searchsorted(starts, s, "left")), int(np.searchsorted(ends, e, "right"))
        out[k] += max(0, min(stop, last) - max(whole, first))
        for t in {*range(first, min(whole, last)), *range(max(stop, first), last)}:
            cut.setdefault(t, []).append(k)
    if cut and rule == "most":  # the farthest end of all sections that begin up to a place
        begins, order = np.array([s for s, _ in sections]), np.argsort([s for s, _ in sections], kind="stable")
        begins, reach = begins[order], np.maximum.accumulate(np.array([e for _, e in sections])[order])
    for t, touched in cut.items():
        a, b = int(starts[t]), int(ends[t])
        shares = {k: min(b, sections[k][1]) - max(a, sections[k][0]) for k in touched}
        if rule == "split":
            for k, n in shares.items():
                out[k] += n / (b - a)
        elif rule == "start":
            for k in touched:
                out[k] += sections[k][0] <= a < sections[k][1]
        else:
            before = int(np.searchsorted(begins, a, "right"))
            best = max(shares, key=lambda k: (shares[k], -sections[k][0], -k))
            out[best] += not (before and reach[before - 1] >= b)  # a section that holds all of it has counted it
    return out


def lines(text: Column) -> Column:
    """A text's lines as sections, each with its line break."""
    return F.transform(
        F.filter(F.aggregate(F.split(text, "\n"), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), lambda acc, x: F.concat(acc, F.array(F.struct(F.element_at(acc, -1)["end"].alias("start"), (F.element_at(acc, -1)["end"] + F.char_length(x) + 1).alias("end"))))), lambda s: s["end"] > s["start"]),
        lambda s: F.struct(F.lit("line").alias("name"), s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end")),
    )


def thirds(text: Column) -> Column:
    """Head, middle and tail of a text, by characters."""
    n = F.char_length(text).cast("bigint")
    a, b = F.floor(n / 3), F.floor(2 * n / 3)
    parts = (("head", F.lit(0).cast("bigint"), a), ("middle", a, b), ("tail", b, n))
    return F.array(*(F.struct(F.lit(name).alias("name"), s.alias("start"), e.alias("end")) for name, s, e in parts))


def section_counts(docs: DataFrame, vocabulary: str, sections: Column, rule: str = "most") -> DataFrame:
    """(doc_id, section, name, start, end, n_tokens, doc_tokens): a row for each element (name, start, end) of ``sections``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(vocabulary, lambda: SpanEncoder(vocabulary))
        for part in chunks(batches, 1 << 20):
            pa.default_memory_pool().release_unused()
            _, starts, ends, at = coder.spans(text_column(part))
            out: list[list] = [[] for _ in schema]
            for k, (doc_id, wanted) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                wanted = wanted or []
                bounds = [(w["start"], w["end"]) if w and w["start"] is not None and w["end"] is not None else (0, 0) for w in wanted]
                n = allocate(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]], bounds, rule)
                for i, (w, (s, e)) in enumerate(zip(wanted, bounds, strict=True)):
                    for column, value in zip(out, (doc_id, i, w and w["name"], s, e, float(n[i]), int(at[k + 1] - at[k])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return given.withColumn("sections", sections).mapInArrow(tidy(run, vocabulary), "doc_id bigint, section int, name string, start bigint, end bigint, n_tokens double, doc_tokens bigint")

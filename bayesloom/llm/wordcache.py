"""Encoding with the tokenizers library where every distinct segment of a text is encoded once.

A vocabulary that encodes the segments of a text (its white-space words, say) independently of each other needs to see
each of them once. The segments of a batch of whole texts are byte spans; a span is known by two 64-bit hashes, is looked
up in a hash table on arrays, and the ids of all texts are put together by array arithmetic. Only segments that the table
doesn't hold go to the library. Words of letters with at most one ``.`` or ``,`` behind go straight to the library's BPE
model; all others run through the whole library pipeline. The result equals ``Tokenizer.encode(text,
add_special_tokens=False)``; the tests compare both.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import Rolling, flat, held, ragged, word_spans


def byte_letters() -> dict[int, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes (a fixed public rule)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b if b in plain else 256 + sum(1 for x in range(b) if x not in plain) for b in range(256)}


def encode_words(tokenizer: Tokenizer, words: list[str], group: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, how many each has), each word by itself; groups of words are encoded by the library's threads."""
    parts = tokenizer.encode_batch([words[k : k + group] for k in range(0, len(words), group)], is_pretokenized=True, add_special_tokens=False)
    counts = [np.bincount(np.array(e.word_ids, np.int64), minlength=min(group, len(words) - group * k)) for k, e in enumerate(parts)]
    none = [np.zeros(0, np.int64)]
    return np.concatenate([*(np.array(e.ids, np.uint32) for e in parts), *none]).astype(np.uint32), np.concatenate([*counts, *none]).astype(np.int32)


class Memory:
    """Integers of remembered segments, found by two 64-bit hashes; all on arrays, some 50 bytes a segment.

    At most ``most`` segments are held. When they would be more, those that were met twice or more stay, or, if those are
    over half of it, those that the present batch holds.
    """

    def __init__(self, most: int, dtype: type):
        self.most, self.dtype, self.seed = most, dtype, 0
        self._clear()

    def _clear(self) -> None:
        self.n = self.used = 0
        self.bits = 12
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.key, self.check = np.zeros(1 << 11, np.uint64), np.zeros(1 << 11, np.uint64)
        self.starts, self.counts, self.met = np.zeros(1 << 11, np.int64), np.zeros(1 << 11, np.int32), np.zeros(1 << 11, np.int32)
        self.ids = np.zeros(1 << 13, self.dtype)

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for k in (0, 1):
            letters = np.random.Generator(np.random.PCG64([self.seed, k, 11])).integers(0, 1 << 64, 256, np.uint64)
            out.append(Rolling(letters[raw]).spans(starts, ends))
        return out[0], out[1]

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places of segments, -1 where one isn't held; -2 where another one has its first hash."""
        mask = (1 << self.bits) - 1
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        place = self.slots[slot]
        left = np.flatnonzero((place >= 0) & (self.key[place] != key))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            place[left] = self.slots[slot[left]]
            left = left[(place[left] >= 0) & (self.key[place[left]] != key[left])]
        clash = (place >= 0) & (self.check[place] != check)
        return np.where(clash, -2, place)

    def _enter(self, own: np.ndarray) -> None:
        """Slots for entries whose keys are distinct and not held."""
        mask = (1 << self.bits) - 1
        slot = (self.key[own] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(own):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = own[free]
            lost = self.slots[slot] != own
            own, slot = own[lost], (slot[lost] + 1) & mask

    def add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n = self.n + len(key)
        while n > len(self.key):
            for name in ("key", "check", "starts", "counts", "met"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(len(old) // 2 + 1, old.dtype)]))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) // 2 + 1, self.dtype)])
        own = np.arange(self.n, n)
        self.key[own], self.check[own], self.counts[own], self.met[own] = key, check, counts, 0
        self.starts[own] = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = n, self.used + len(ids)
        if 2 * n > 1 << self.bits:
            self.bits = int(2 * n - 1).bit_length() + 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            own_all = np.arange(n)
            self._enter(own_all)
        else:
            self._enter(own)
        return own

    def forget(self, present: np.ndarray) -> None:
        """Make room, with the entries ``present`` kept in any case."""
        stay = self.met[: self.n] > 1
        if stay.sum() > self.most // 2:
            stay[:] = False
        stay[present] = True
        own = np.flatnonzero(stay)
        key, check, counts = self.key[own], self.check[own], self.counts[own]
        ids = self.ids[ragged(self.starts[own], counts)]
        self._clear()
        if len(own):
            self.add(key, check, ids, counts)

    def look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn) -> np.ndarray:
        """The place of each segment; ``learn(list of segments as bytes)`` gives (integers of all, counts) of unknown ones."""
        key, check = self.hashes(raw, starts, ends)
        place = self.find(key, check)
        new = np.flatnonzero(place < 0)
        if len(new):
            _, first, inverse = np.unique(key[new], return_index=True, return_inverse=True)
            if (place[new] == -2).any() or (check[new] != check[new[first]][inverse]).any():
                self.seed += 1  # two segments of one first hash: all anew, by other hashes
                self._clear()
                return self.look_up(raw, starts, ends, learn)
            if self.n + len(first) > self.most:
                self.forget(np.unique(place[place >= 0]))
                place = self.find(key, check)
            at = new[first]
            data = raw.tobytes()
            ids, counts = learn([data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            place[new] = self.add(key[at], check[at], ids, counts)[inverse]
        self.met[: self.n] += np.bincount(place, minlength=self.n).astype(np.int32)
        np.minimum(self.met, 1 << 20, out=self.met)
        return place

    def all_ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(integers of all places, how many each has)."""
        counts = self.counts[place].astype(np.int64)
        return self.ids[ragged(self.starts[place], counts)], counts


class WordEncoder:
    """Ids of whole texts for a vocabulary that lower-cases and drops white space."""

    def __init__(self, path: str, max_words: int = 600_000):
        import json

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if '"ByteLevel"' not in json.dumps(spec["pre_tokenizer"]) or '"Lowercase"' not in json.dumps(spec["normalizer"]):
            raise ValueError("the vocabulary must lower-case, drop white space and work on bytes")
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=1)
        self.letters = byte_letters()
        self.memory = Memory(max_words, np.uint32)

    def learn(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, how many each has)."""
        slow, slow_at = [], []
        got: list[list[int]] = []
        pieces: dict[str, list[int]] = {}
        tokenize = self.model.tokenize
        for w in map(bytes.decode, segments):
            body, end = (w[:-1], w[-1]) if w[-1] in ".," else (w, "")
            ascii_only = body.isascii()
            if body.isalpha() and (ascii_only or (unicodedata.is_normalized("NFC", body) and "Σ" not in body and "İ" not in body)):
                low = body.lower()
                found = pieces.get(low)
                if found is None:
                    found = pieces[low] = [t.id for t in tokenize(low if ascii_only else low.encode().decode("latin-1").translate(self.letters))]
                if end:
                    if end not in pieces:
                        pieces[end] = [t.id for t in tokenize(end)]
                    found = found + pieces[end]
                got.append(found)
            else:
                slow_at.append(len(got))
                slow.append(w)
                got.append([])
        if slow:
            for k, e in zip(slow_at, self.full.encode_batch_fast(slow, add_special_tokens=False), strict=True):
                got[k] = e.ids
        counts = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter((i for g in got for i in g), np.uint32, int(counts.sum())), counts

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all texts, starts and ends of the segments, segments before each text)."""
        raw, offsets = flat(texts)
        return raw, *word_spans(raw, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets into them) of a large_string array without nulls."""
        raw, starts, ends, before = self.segments(texts)
        ids, counts = self.memory.all_ids(self.memory.look_up(raw, starts, ends, self.learn))
        return ids, np.concatenate([[0], np.cumsum(counts)])[before]


def encoder(path: str) -> WordEncoder:
    """The encoder of this process for a vocabulary file."""
    return held(path, lambda: WordEncoder(path))

"""Tokenizers as column expressions: text in, array of tokens out, all inside the JVM.

Every tokenizer is a dataclass with ``column(text) -> Column``; its settings travel with a model as (class, config).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import BayesError

WORD_PATTERN = r"[\p{L}\p{N}]+"


def scrub(text: Column) -> Column:
    """Invalid UTF-8 replaced by U+FFFD; a null text is an empty one."""
    return F.make_valid_utf8(F.coalesce(text.cast("string"), F.lit("")))


def normalize(text: Column) -> Column:
    return F.lower(scrub(text))


def _own(pattern: str) -> str:
    """A delimited pattern with flags, as /.../iu, in Java's notation; a bare pattern as it is."""
    m = re.fullmatch(r"([/#~!@%])(.*)\1([a-zA-Z]*)", pattern, re.S)
    if not m:
        return pattern
    flags = {"u": "", "i": "i", "m": "m", "s": "s", "x": "x"}
    try:
        on = "".join(flags[f] for f in m[3])
    except KeyError as e:
        raise BayesError("pattern_invalid", pattern) from e
    return f"(?{on}){m[2]}" if on else m[2]


def check_pattern(pattern: str) -> str:
    """The pattern, compiled once by the JVM that will run it."""
    own = _own(pattern)
    spark = SparkSession.getActiveSession()
    if spark is None:
        return own
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(own)
    except Exception as e:
        raise BayesError("pattern_invalid", pattern) from e
    return own


def groups(pattern: str) -> int:
    spark = SparkSession.getActiveSession()
    return spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()


@dataclass
class WordTokenizer:
    """Lower-cased matches of a pattern of at least ``min_length`` code points that aren't stop words."""

    min_length: int = 2
    stop_words: list[str] | None = None
    pattern: str = WORD_PATTERN

    def __post_init__(self) -> None:
        self.min_length = max(1, int(self.min_length))
        if self.stop_words is not None:
            self.stop_words = [w.lower() for w in self.stop_words]
        self.pattern = check_pattern(self.pattern)

    def column(self, text: Column) -> Column:
        found = F.regexp_extract_all(normalize(text), F.lit(self.pattern), F.lit(0))
        keep = F.filter(found, lambda t: F.char_length(t) >= self.min_length)
        return F.filter(keep, lambda t: ~t.isin(self.stop_words)) if self.stop_words else keep


@dataclass
class RegexTokenizer:
    """Group 1 of each match, or the whole match; empty ones are dropped, lower-casing comes after matching."""

    pattern: str = r"([\p{L}\p{N}]+)"
    lowercase: bool = True

    def __post_init__(self) -> None:
        self.pattern = check_pattern(self.pattern)

    def column(self, text: Column) -> Column:
        found = F.regexp_extract_all(scrub(text), F.lit(self.pattern), F.lit(1 if groups(self.pattern) else 0))
        kept = F.filter(found, lambda t: t != "")
        return F.transform(kept, F.lower) if self.lowercase else kept


@dataclass
class NGramTokenizer:
    """Character n-grams (padded at both ends or not) of the collapsed text, or n-grams of words."""

    n: int = 3
    characters: bool = True
    pad: bool = True
    words: WordTokenizer = field(default_factory=WordTokenizer)

    def __post_init__(self) -> None:
        self.n = max(1, int(self.n))
        if isinstance(self.words, dict):
            self.words = WordTokenizer(**self.words)

    def column(self, text: Column) -> Column:
        return self._characters(text) if self.characters else self._words(text)

    def _words(self, text: Column) -> Column:
        words, n = self.words.column(text), self.n
        if n == 1:
            return words
        full = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, full(w)).otherwise(F.array().cast("array<string>"))))

    def _characters(self, text: Column) -> Column:
        n, none = self.n, F.array().cast("array<string>")
        clean = F.trim(F.regexp_replace(normalize(text), r"[\s\p{Z}]+", " "))

        def grams(t: Column) -> Column:
            size = F.char_length(t)
            full = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
            if n == 1:
                return F.when(size > 0, full).otherwise(none)
            if not self.pad:
                return F.when(size >= n, full).otherwise(none)
            ends = F.sequence(F.lit(1), F.lit(n - 1))
            lead = F.transform(ends, lambda i: F.rpad(F.substring(t, F.lit(1), i), n, " "))
            trail = F.transform(ends, lambda i: F.lpad(F.substring(t, size - n + 1 + i, F.lit(n) - i), n, " "))
            return F.when(size >= n, F.concat(lead, full, trail)).when(size > 0, F.array(F.rpad(t, n, " "))).otherwise(none)

        return F.flatten(F.transform(F.array(clean), grams))


@dataclass
class ChainTokenizer:
    """The tokens of several tokenizers of the same text, one after the other, duplicates kept."""

    tokenizers: list = field(default_factory=list)

    def add(self, tokenizer) -> ChainTokenizer:
        self.tokenizers.append(tokenizer)
        return self

    def remove(self, tokenizer) -> bool:
        found = tokenizer in self.tokenizers
        if found:
            self.tokenizers.remove(tokenizer)
        return found

    def clear(self) -> None:
        self.tokenizers.clear()

    def column(self, text: Column) -> Column:
        return F.concat(*(t.column(text) for t in self.tokenizers)) if self.tokenizers else F.array().cast("array<string>")


@dataclass
class CustomTokenizer:
    """A tokenizer of the user's own, given as a function from a column to a column; not saved with a model."""

    function: Callable[[Column], Column]

    def column(self, text: Column) -> Column:
        return self.function(text)


REGISTRY: dict[str, type] = {"word": WordTokenizer, "regex": RegexTokenizer, "ngram": NGramTokenizer, "chain": ChainTokenizer}


def register(name: str, kind: type) -> None:
    """Add a class of tokenizers, a dataclass with ``column(text)``, that models may be saved with."""
    if not name or not is_dataclass(kind) or not callable(getattr(kind, "column", None)) or REGISTRY.get(name, kind) is not kind:
        raise BayesError("tokenizer_unknown", name)
    REGISTRY[name] = kind


def export(tokenizer) -> dict:
    """{class, config} of a registered tokenizer."""
    name = next((k for k, v in REGISTRY.items() if type(tokenizer) is v), None)
    if name is None:
        raise BayesError("tokenizer_unknown", type(tokenizer).__name__)
    if name == "chain":
        return {"class": name, "config": json.dumps([export(t) for t in tokenizer.tokenizers])}
    return {"class": name, "config": json.dumps(asdict(tokenizer))}


def restore(state: dict):
    """The tokenizer of {class, config}; unknown settings are ignored, unknown classes refused."""
    kind = REGISTRY.get(state.get("class"))
    if kind is None:
        raise BayesError("tokenizer_unknown", state.get("class"))
    config = json.loads(state.get("config") or "{}")
    if kind is ChainTokenizer:
        return ChainTokenizer([restore(s) for s in config])
    known = kind.__dataclass_fields__
    return kind(**{k: v for k, v in config.items() if k in known})


def register_sql(spark: SparkSession) -> None:
    """SQL functions ``bayes_words`` and ``bayes_ngrams`` for users of ``spark.sql``."""
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION bayes_words(t STRING) RETURNS ARRAY<STRING> RETURN filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+', 0), w -> char_length(w) >= 2)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bayes_ngrams(t STRING, n INT) RETURNS ARRAY<STRING> RETURN if(char_length(t) >= n, transform(sequence(1, greatest(char_length(t) - n + 1, 1)), i -> substring(lower(t), i, n)), cast(array() as array<string>))")

"""Models as versioned Parquet tables: each save writes tables of its own and then publishes them under the next number.

Layout under the root: ``name/tables-ID/{cells,categories,words,meta,...}``, a folder for each save, and ``name/_CURRENT-N``, a
small file with the ID of generation N. The file appears whole or not at all, and only once: of several writers that
built on the same generation one publishes, the others are refused and may try again (``update``). Readers take the
highest N, so they see one generation whole, whatever a lost writer has left behind.
All file access goes through Hadoop's file systems, so the root may be any store that Spark can write.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BayesError
from ..functions import tokenizers
from ..operators import calibrate, views
from ..operators.model import FORMAT_VERSION, Model
from ..operators.tag import Tagger, TagSettings
from . import scratch

#: The explicit schemas of a model's tables.
CELLS = "category string, token string, cnt bigint, doc_cnt bigint"
CATEGORIES = "category string, cat_order int, doc_count bigint, total_tokens bigint"
META = "kind string, name string, format_version int, layout_version int, alpha double, use_tfidf boolean, spam_category string, tokenizer struct<class:string,config:string>, temperature double, temperature_samples bigint, extra string, generation bigint, updated_at timestamp"
#: The layout of the tables, beside the format of what they say.
LAYOUT_VERSION = 1
WORDS = "token string, df bigint, g bigint, cells array<struct<category:string,cnt:bigint,doc_cnt:bigint>>"
HISTOGRAM = "fam string, category string, val bigint, cnt bigint"


def check_name(name: str | None) -> str:
    if name is None:
        raise BayesError("name_required")
    if not name or name.startswith((".", "_")) or any(c in name for c in "/\\\0:"):
        raise BayesError("name_invalid", repr(name))
    return name


class Storage(Protocol):
    """What keeps models by name: ``MemoryRegistry``, ``Registry`` and ``JdbcRegistry`` do, and others may."""

    def save(self, model: Model) -> object: ...

    def load(self, name: str) -> Model | None: ...

    def exists(self, name: str) -> bool: ...

    def delete(self, name: str) -> None: ...

    def list(self) -> list[str]: ...


@dataclass
class MemoryRegistry:
    """Models of this process, by name."""

    models: dict[str, Model] = field(default_factory=dict)

    def save(self, model: Model) -> None:
        self.models[check_name(model.name)] = model

    def load(self, name: str) -> Model | None:
        return self.models.get(name)

    def exists(self, name: str) -> bool:
        return name in self.models

    def delete(self, name: str) -> None:
        self.models.pop(name, None)

    def list(self) -> list[str]:
        return sorted(self.models)


class Registry:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep)
        self._jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        path = self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, *parts: str) -> str | None:
        path, fs = self._path(*parts)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, name: str, number: int, text: str) -> bool:
        """Whether ``_CURRENT-number`` was made; it is made with its text, and never over one that exists."""
        beside, fs = self._path(name, f".new-{uuid.uuid4().hex}")
        path, _ = self._path(name, f"_CURRENT-{number}")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if fs.getScheme() != "file":
                return bool(fs.rename(beside, path))  # false if the target exists
            local = lambda p: self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
            try:
                self._jvm.java.nio.file.Files.createLink(local(path), local(beside))  # a local rename would replace the target
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                return False
            return True
        finally:
            fs.delete(beside, False)

    def _generations(self, name: str) -> list[int]:
        path, fs = self._path(check_name(name))
        if not fs.exists(path):
            return []
        names = (str(f.getPath().getName()) for f in fs.listStatus(path))
        return sorted(int(n[9:]) for n in names if n.startswith("_CURRENT-") and n[9:].isdigit())

    def generation(self, name: str) -> int:
        """The current generation, 0 if there is none."""
        return max(self._generations(name), default=0)

    def save(self, model: Model, expected: int | None = None, **tables: DataFrame) -> int:
        """Write ``model`` as the next generation; ``expected`` is the one that the caller built it on. ``tables`` are more
        of the model's tables by name, as ``histogram``."""
        name = check_name(model.name)
        now = self.generation(name)
        if expected is not None and expected != now:
            raise BayesError("generation_conflict", now)
        new, own = now + 1, uuid.uuid4().hex
        base = f"{self.root}/{name}/tables-{own}"
        cells = model.cells.select("category", "token", "cnt", "doc_cnt")
        cells.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{base}/cells")
        model.categories.write.parquet(f"{base}/categories")
        words = model.wide if model.wide is not None else views.wide(cells)  # what scoring reads: no vocabulary is counted again
        words.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{base}/words")
        for table, rows in tables.items():
            rows.write.parquet(f"{base}/{table}")
        state = tokenizers.export(model.tokenizer)
        row = (model.kind, name, FORMAT_VERSION, LAYOUT_VERSION, float(model.alpha), model.use_tfidf, model.spam_category, (state["class"], state["config"]), model.temperature, model.temperature_samples, json.dumps(model.extra), new)
        meta = self.spark.createDataFrame([row], META.rsplit(", ", 1)[0])
        meta.withColumn("updated_at", F.current_timestamp()).coalesce(1).write.parquet(f"{base}/meta")
        if not self._publish(name, new, own):
            folder, fs = self._path(name, f"tables-{own}")
            fs.delete(folder, True)
            raise BayesError("generation_conflict", new)
        for old in [n for n in self._generations(name) if n <= new - self.keep]:
            folder, fs = self._path(name, f"tables-{self._read(name, f'_CURRENT-{old}')}")
            pointer, _ = self._path(name, f"_CURRENT-{old}")
            fs.delete(pointer, False)
            fs.delete(folder, True)
        return new

    def update(self, name: str, change: Callable[[Model | None], Model], attempts: int = 5) -> int:
        """Publish ``change(current model)``; when another writer was first, again from what it published, after a pause of
        random length."""
        for k in range(attempts):
            at = self.generation(name)
            try:
                return self.save(change(self.load(name)).with_(name=name), expected=at)
            except BayesError as e:
                if e.code != "generation_conflict" or k + 1 == attempts:
                    raise
                time.sleep(random.uniform(0, 0.2 * 2**k))
        raise BayesError("generation_conflict", name)

    def _table(self, name: str, table: str, schema: str) -> DataFrame:
        own = self._read(name, f"_CURRENT-{self.generation(name)}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/tables-{own}/{table}")

    def has_table(self, name: str, table: str) -> bool:
        path, fs = self._path(name, f"tables-{self._read(name, f'_CURRENT-{self.generation(name)}')}", table)
        return bool(fs.exists(path))

    def load(self, name: str, kind: str | None = None) -> Model | None:
        """The model, or None if it is missing or its metadata can't be read; newer formats and other kinds are refused."""
        if not self.generation(check_name(name)):
            return None
        try:
            meta = self._table(name, "meta", META).first()
        except (PySparkException, Py4JJavaError):  # missing or corrupt files
            return None
        if meta is None:
            return None
        for written, own in ((meta["format_version"], FORMAT_VERSION), (meta["layout_version"], LAYOUT_VERSION)):
            if (written or 1) > own:
                raise BayesError("format_newer", written)
        alpha = meta["alpha"] if meta["alpha"] and meta["alpha"] > 0 else 1.0
        model = Model(self._table(name, "cells", CELLS), self._table(name, "categories", CATEGORIES), meta["kind"], name, alpha, meta["use_tfidf"], meta["spam_category"], tokenizers.restore(meta["tokenizer"].asDict()), meta["temperature"], meta["temperature_samples"] or 0, json.loads(meta["extra"] or "{}"))
        model.histogram = self.histogram(name)
        model.wide = self._table(name, "words", WORDS) if self.has_table(name, "words") else None
        return model.as_kind(kind) if kind else model

    def save_tagger(self, tagger: Tagger, name: str, expected: int | None = None) -> int:
        """Save a tagger's model with its settings and each label's calibration."""
        s = tagger.settings
        state = {"threshold": s.threshold, "max_tags": s.max_tags, "background": s.background, "platt": calibrate.export_platt(tagger.calibration) if tagger.calibration is not None else None}
        return self.save(tagger.model.with_(name=name, extra=tagger.model.extra | {"tagger": state}), expected)

    def load_tagger(self, name: str) -> Tagger | None:
        """The tagger saved under a name; a model that was saved without one has the settings of a new tagger."""
        model = self.load(name)
        if model is None:
            return None
        state = model.extra.get("tagger") or {}
        platt = state.get("platt")
        settings = TagSettings(**{k: state[k] for k in ("threshold", "max_tags", "background") if k in state})
        return Tagger(model, settings, calibrate.restore_platt(self.spark, platt) if platt is not None else None)

    def exists(self, name: str) -> bool:
        return self.generation(name) > 0

    def delete(self, name: str) -> None:
        path, fs = self._path(check_name(name))
        fs.delete(path, True)

    def list(self) -> list[str]:
        path, fs = self._path()
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
        return sorted(n for n in names if not n.startswith((".", "_")) and self.exists(n))

    def tokens(self, name: str, tokens: DataFrame) -> DataFrame:
        """The cells of the given tokens: a join instead of batches of point reads. Cells are stored in order of the token,
        and the bounds of the tokens asked for go to the scan, so that row groups outside them aren't read."""
        asked = scratch.kept(tokens.select("token").distinct())
        low, high = asked.agg(F.min("token"), F.max("token")).first()
        cells = self._table(name, "cells", CELLS)
        return cells.where(F.col("token").between(low, high) if low is not None else F.lit(False)).join(asked, "token", "left_semi")

    def histogram(self, name: str, families: tuple[str, ...] = ()) -> DataFrame | None:
        """The stored counts of counts, of some families if any are named; None if the model has none."""
        if not self.generation(name) or not self.has_table(name, "histogram"):
            return None
        stored = self._table(name, "histogram", HISTOGRAM)
        return stored.where(F.col("fam").isin(*families)) if families else stored

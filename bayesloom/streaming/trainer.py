"""Incremental training with Structured Streaming: a stream of the training log folded into cells, or into a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import train, views
from ..operators.model import Model
from ..sources import histograms, scratch
from ..sources.registry import CELLS as registry_cells
from ..sources.registry import Registry


def fold(cells: DataFrame, delta: DataFrame) -> DataFrame:
    """Cells after a micro-batch of signed deltas."""
    both = cells.select("category", "token", "cnt", "doc_cnt").unionByName(delta)
    return both.groupBy("category", "token").agg(F.sum("cnt").alias("cnt"), F.sum("doc_cnt").alias("doc_cnt")).where("cnt > 0")


def category_sums(log: DataFrame) -> DataFrame:
    """(category, doc_count, total_tokens, first): what a batch adds to each category."""
    return log.groupBy("category").agg(F.sum("sign").cast("bigint").alias("doc_count"), F.sum(F.size("tokens") * F.col("sign")).cast("bigint").alias("total_tokens"), F.min("seq").alias("first"))


def fold_categories(old: DataFrame, log: DataFrame) -> DataFrame:
    """Categories after a micro-batch; new ones come behind the known ones, in order of ``seq``."""
    return merged(old, category_sums(log))


def merged(old: DataFrame, sums: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    joined = old.select("category", "cat_order", F.col("doc_count").alias("d0"), F.col("total_tokens").alias("t0")).join(sums, "category", "full")
    order = Window.orderBy(F.col("cat_order").isNull(), "cat_order", "first", "category")  # one row a category
    zero = F.lit(0)
    summed = joined.select("category", "cat_order", "first", (F.coalesce("d0", zero) + F.coalesce("doc_count", zero)).alias("doc_count"), F.greatest(F.coalesce("t0", zero) + F.coalesce("total_tokens", zero), zero).cast("bigint").alias("total_tokens"))
    return summed.where("doc_count > 0").select("category", F.row_number().over(order).alias("cat_order"), "doc_count", "total_tokens")


def signed(log: DataFrame) -> DataFrame:
    """Net signed counts of a micro-batch, withdrawals included."""
    return train.deltas(log).groupBy("category", "token").agg(F.sum("n").alias("cnt"), F.sum("docs").alias("doc_cnt"))


#: What a micro-batch leaves: ``train.fold`` of its rows.
FOLDED = "category string, token string, cnt bigint, doc_cnt bigint, first bigint, batch bigint"


def train_stream(log: DataFrame, registry: Registry, name: str, checkpoint: str, every: int = 16, **settings) -> StreamingQuery:
    """Train ``name`` from a stream of the training log: a micro-batch writes its signed sums under the checkpoint, and every
    so many batches ``publish`` folds what is new into the next generation, so that the cells aren't rewritten each time.
    Call ``publish`` when the stream has stopped, for the rest. A batch that runs again replaces its own sums."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        train.fold(batch).write.mode("overwrite").parquet(f"{checkpoint}/sums/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            publish(registry, name, checkpoint, **settings)

    return log.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(registry: Registry, name: str, checkpoint: str, **settings) -> int:
    """Fold the sums of batches that aren't in the current generation into the next one; the generation that holds them all.

    The last batch folded travels with the model, so a restart neither loses nor repeats one.
    """
    at, old = registry.generation(name), registry.load(name)
    done = old.extra.get("batch", -1) if old is not None else -1
    sums = registry.spark.read.schema(FOLDED).parquet(f"{checkpoint}/sums").where(F.col("batch") > done)
    last = sums.agg(F.max("batch")).first()[0]
    if last is None:
        return at
    summed = sums.groupBy("category", "token").agg(F.sum("cnt").alias("cnt"), F.sum("doc_cnt").alias("doc_cnt"), F.min("first").alias("first"))
    folded, tables = scratch.kept(summed), {}
    if old is None:
        model = Model.of(folded, name=name, **settings)
    else:
        tokens = folded.where("token is not null")
        more = folded.where("token is null").select("category", F.col("doc_cnt").alias("doc_count"), F.col("cnt").alias("total_tokens"), "first")
        model = old.with_(cells=scratch.kept(fold(old.cells, tokens.select("category", "token", "cnt", "doc_cnt"))), categories=merged(old.categories, more), histogram=None)
        tables = histograms.follow(registry, old, model, tokens.select("token"))
    return registry.save(model.with_(extra=model.extra | {"batch": last}), at, **tables)


def cells_stream(log: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write every micro-batch's signed counts under ``folder``, a folder a batch: a batch that runs again replaces its own."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        signed(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return log.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_cells(spark: SparkSession, path: str, schema, to_log, folder: str) -> DataFrame:
    """Cells of all files under ``path``, trained by a stream that reads them once and then stops."""
    stream = to_log(spark.readStream.schema(schema).parquet(path))
    cells_stream(stream, f"{folder}/deltas", f"{folder}/checkpoint").awaitTermination()
    deltas = spark.read.schema(registry_cells).parquet(f"{folder}/deltas")
    return deltas.groupBy("category", "token").agg(F.sum("cnt").alias("cnt"), F.sum("doc_cnt").alias("doc_cnt")).where("cnt > 0")


def touched(cells: DataFrame, batch: DataFrame) -> DataFrame:
    """The cells of tokens that a batch touches: what an incremental recount has to read."""
    return cells.join(batch.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi")


def maintain(before: DataFrame, after: DataFrame, histogram: DataFrame, batch: DataFrame) -> DataFrame:
    """The histogram after a batch: cells of touched tokens are taken out as they were and put in as they are."""
    change = views.histogram_delta(touched(before, batch), touched(after, batch))
    return histogram.unionByName(change).groupBy("fam", "category", "val").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def windowed_training(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Extension: category counts by event-time window of a stream of (time, category, tokens)."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("window"), "category").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tokens")).alias("tokens"))

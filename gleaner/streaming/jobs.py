"""Structured Streaming jobs. Each has a batch twin in ``gleaner.operators`` with equal results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.language import Lexicon
from gleaner.functions.scoring import iff
from gleaner.operators import quota, state
from gleaner.operators.ingest import ingest_into
from gleaner.session import settled
from gleaner.sources.snapshots import Change, Snapshots


def verdict_log_stream(verdicts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append-only verdict log of a stream: one verdict per link and UTC day.

    Of the verdicts of one micro-batch the earliest counts, in whatever order files
    and tasks bring them; a verdict of a later batch yields to a logged one. None is
    dropped for being late. Rows are stored by batch and day, so a batch reads back
    only the days it touches, and a retried batch replaces its folder.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = settled(state.verdict_log(batch))
        if batch_id:
            log = batch.sparkSession.read.parquet(folder).filter(F.col("batch") < batch_id)
            known = log.join(rows.select("day").distinct(), "day", "left_semi").select("url_hash", "day")
            rows = rows.join(known, ["url_hash", "day"], "left_anti")
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/batch={batch_id}")

    return verdicts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reader_state_changes(events: DataFrame) -> DataFrame:
    """Update-mode stream of (user_id, item_id, is_saved, is_read, saved_at).

    The fold only needs running maxima, so the state store keeps three small
    structs per save and tasks combine before the shuffle.
    """
    when = F.struct("at", "seq")
    updating = F.col("saved").isNull() | F.col("saved")
    folded = events.groupBy("user_id", "item_id").agg(
        F.max(F.when(F.col("saved") == F.lit(False), when)).alias("removed"),
        F.max(F.when(updating, when)).alias("updated"),
        F.max(F.when(updating & F.col("read").isNotNull(), F.struct("at", "seq", "read"))).alias("set_read"),
    )
    never = F.col("removed").isNull()
    is_saved = iff(F.col("updated").isNotNull() & (never | (F.col("updated") > F.col("removed"))))
    read_since = F.struct("set_read.at", "set_read.seq")
    is_read = iff(F.col("set_read.read") & (never | (read_since > F.col("removed"))))
    return folded.select(
        "user_id",
        "item_id",
        is_saved.alias("is_saved"),
        (is_saved & is_read).alias("is_read"),
        F.when(is_saved, F.col("updated.at")).alias("saved_at"),
    )


def write_changes(
    stream: DataFrame, tables: Snapshots, name: str, keys: list[str], checkpoint: str, mode: str = "update"
) -> StreamingQuery:
    """Keep a keyed table in step with an update-mode stream, as far as data is available.

    A batch publishes the rows it changes, and a retried one nothing; the table is
    written anew once in a while, so neither its readers nor its folder see all batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.commit(name, batch_id, {name: Change(batch, keys)})
        tables.expire(keep=2)

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def signals_stream(hits: DataFrame, tables: Snapshots, checkpoint: str, name: str = "signal_summaries") -> StreamingQuery:
    """Fold hits into running signals of a keyed table.

    A micro-batch is summed up by item first; only the stored summaries of its items are
    read and written, so the cost of a batch follows the batch. Batches are taken in
    arrival order.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        if tables.done(name, batch_id):
            return
        base = tables.version()
        summaries, known = settled(state.hit_summaries(batch)), tables.read(name, base)
        if known is not None:
            touched = known.join(summaries.select("item_id"), "item_id", "left_semi")
            summaries = state.merge_hit_summaries(touched, summaries)
        tables.commit(name, batch_id, {name: Change(summaries, ["item_id"])}, base)
        tables.expire(keep=2)

    return hits.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _previous(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(f"{folder}/state={batch_id - 1}") if batch_id > 0 else None


def quota_stream(requests: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Decide requests as they arrive; the open window of each platform is carried between batches."""

    def decide(batch: DataFrame, batch_id: int) -> None:
        opened = _previous(batch.sparkSession, folder, batch_id)
        decisions = settled(quota.quota_ledger(batch, opened))
        decisions.write.mode("overwrite").parquet(f"{folder}/decisions/batch={batch_id}")
        quota.open_windows(decisions, opened).write.mode("overwrite").parquet(f"{folder}/state={batch_id}")

    return requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_window_stream(raw: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per item, type and window from raw JSON events; late events beyond the watermark are dropped."""
    return state.event_windows(state.valid_events(raw), width, late)


def ingest_stream(
    payloads: DataFrame,
    normalize: Callable[[DataFrame], DataFrame],
    tables: Snapshots,
    dictionaries: Callable[[SparkSession], dict[str, DataFrame]],
    checkpoint: str,
    now: Column,
    discovery: bool = False,
    *,
    lexicon: Lexicon,
    writer: str = "ingest",
) -> StreamingQuery:
    """Run the ingest pass on every micro-batch of raw payloads.

    ``tables`` holds corpus and sources; each batch reads them as the last one left them
    and publishes all its changes at once, so a retried batch changes nothing.
    ``dictionaries`` returns source_topics, topic_aliases and, if any, pages as of the
    batch's start.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        known = dictionaries(batch.sparkSession)
        ingest_into(
            tables, writer, batch_id, normalize(batch), known["source_topics"], known["topic_aliases"], now,
            known.get("pages"), discovery, lexicon=lexicon,
        )

    return payloads.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

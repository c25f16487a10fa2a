"""Resumable work as streams (STM-*): a checkpointed file stream takes the place of resume loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from ..functions import text as X


def enrich_stream(
    spark: SparkSession, source: str, schema, enrich: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str
) -> StreamingQuery:
    """STM-01..03: enriches new files once each; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """MTH-06: rows done, rows a second and the seconds left of a stream of a known number of rows, from the job's own reports."""

    def __init__(self, total: int):
        self.total, self.done, self.seconds, self.batches = total, 0, 0.0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.done += event.progress.numInputRows
            self.seconds += event.progress.batchDuration / 1000
            self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def rate(self) -> float:
        return self.done / self.seconds if self.seconds else 0.0

    @property
    def left(self) -> float | None:
        return (self.total - self.done) / self.rate if self.rate else None


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """MTH-06, STM-01: rows that count themselves as they are written; counts are aggregates, known (`get`) when the write has ended.

    Rows of tasks that are run again count once: what counts is a stage's result.
    """
    observation = Observation()
    return rows.observe(observation, F.count("*").alias("rows"), *[c.alias(name) for name, c in counts.items()]), observation


def distinct_sources(stream: DataFrame, time: str = "ts", late: str = "1 hour", key: str = "source") -> DataFrame:
    """STM-04: the first row of each source, with state bounded by the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Beyond the reference: event-time counts by type, for batch and stream alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


class PagePointer(StatefulProcessor):
    """STM-05, WIN-06: a document's pages as map state, loaded once, and its pointer as value state: the last page and the misses since.

    A row takes no page with it: of the pages, only those in the pointer's window are looked up. Where `idle` is set, a timer of so
    many milliseconds without segments ends a document and frees its state.
    """

    def __init__(self, least: int, window: int, widest: int, idle: int | None):
        self.least, self.window, self.widest, self.idle = least, window, widest, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "plain string")
        self.pointer = handle.getValueState("pointer", "page int, missed int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for page, plain in zip(initialState["page"], initialState["plain"], strict=True):
            self.pages.updateValue((int(page),), (plain,))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        out = []
        if self.pages.exists():
            page, missed = self.pointer.get() if self.pointer.exists() else (0, 0)
            seen: dict[int, str | None] = {}
            given = pd.concat(list(rows)).sort_values("pos")
            for pos, own in zip(given["pos"], given["key"], strict=True):
                ahead = None
                if len(own) >= self.least:
                    for p in range(page, page + min(self.window + 6 * missed, self.widest)):
                        if p not in seen:
                            seen[p] = self.pages.getValue((p,))[0] if self.pages.containsKey((p,)) else None
                        if seen[p] is None:  # beyond the last page
                            break
                        if own in seen[p]:
                            ahead = p
                            break
                page = page if ahead is None else ahead
                missed = 0 if ahead is not None else missed + (len(own) >= self.least)
                out.append((key[0], int(pos), page, ahead is not None))
            self.pointer.update((page, missed))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=["doc_id", "pos", "page", "confident"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        self.pages.clear()
        self.pointer.clear()
        yield pd.DataFrame([], columns=["doc_id", "pos", "page", "confident"])

    def close(self) -> None:
        pass


def align_stream(
    segments: DataFrame, pages: DataFrame, key_len: int = 20, least: int = 10, window: int = 6, widest: int = 80, idle: int | None = None
) -> DataFrame:
    """STM-05, PAG-01: page alignment of segments that arrive as a stream, in order within a document: (doc_id, pos, page, confident).

    pages (doc_id, page, text) is static and read when the query first starts; afterwards it lies in the state. Needs the
    RocksDB state store (`stateful`). Documents without pages have no rows, as in `align_pages`.
    """
    plain = X.alnum(F.coalesce("text", F.lit("")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    sheets = pages.select("doc_id", place.cast("int").alias("page"), plain.alias("plain"))
    keyed = segments.select("doc_id", "pos", F.left(plain, F.lit(key_len)).alias("key"))
    return keyed.groupBy("doc_id").transformWithStateInPandas(
        PagePointer(least, window, widest, idle),
        "doc_id long, pos int, page int, confident boolean",
        "Append",
        "ProcessingTime" if idle else "None",
        sheets.groupBy("doc_id"),
    )


def stateful(spark: SparkSession) -> None:
    """The state store that processors with several states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

"""Streaming forms of the incremental operators: each input once, and turns merged across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import versions


def once(docs: DataFrame, keys: list[str], stamp: str, delay: str) -> DataFrame:
    """Each key's first row. Keys are remembered for ``delay`` of event time, so that state stays bounded."""
    return docs.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(keys)


def register_new(stream: DataFrame, registry_path: str, out_path: str, keys: list[str], checkpoint: str):
    """Start a query that writes rows whose keys aren't registered, and registers them. Both are appended to; a batch
    that is run again finds its own keys registered, so its rows are written with their batch number and are told apart.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.dropDuplicates(keys)
        try:
            known = spark.read.parquet(registry_path).where(F.col("batch") != number).select(*keys)
        except Exception as e:  # the first batch finds no registry
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = rows.select(*keys).limit(0)
        new = versions.unprocessed(rows, known, keys).withColumn("batch", F.lit(number)).persist()
        new.write.mode("overwrite").parquet(f"{out_path}/batch={number:010d}")
        new.select(*keys, "batch").write.mode("append").parquet(registry_path)
        new.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_turns(segments: DataFrame, key: str, speaker: str, stamp: str, delay: str) -> DataFrame:
    """(key, speaker, n, first, last) of each finished turn: a turn ends when another speaks or ``delay`` has passed.

    Rows of a batch are sorted by time within their key; the open turn of each key is all the state there is.
    """
    source = segments.select(F.col(key).cast("string").alias("key"), F.col(speaker).alias("speaker"), F.col(stamp).alias("at")).withWatermark("at", delay)
    out, state = "key string, speaker string, n long, first timestamp, last timestamp", "speaker string, n long, first long, last long"
    minutes = pd.Timedelta(delay).value // 1_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        done = []
        now = held.getOption
        if held.hasTimedOut:
            s, n, a, z = now
            held.remove()
            yield pd.DataFrame([(k[0], s, n, pd.Timestamp(a), pd.Timestamp(z))], columns=["key", "speaker", "n", "first", "last"])
            return
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        turn = list(now) if now else None
        for who, at in zip(rows["speaker"], rows["at"], strict=True):
            t = pd.Timestamp(at).value
            if turn and turn[0] == who:
                turn[1], turn[3] = turn[1] + 1, max(turn[3], t)
            else:
                if turn:
                    done.append((k[0], turn[0], turn[1], pd.Timestamp(turn[2]), pd.Timestamp(turn[3])))
                turn = [who, 1, t, t]
        held.update(tuple(turn))
        held.setTimeoutTimestamp(max(turn[3] // 1_000_000 + minutes, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["key", "speaker", "n", "first", "last"])

    return source.groupBy("key").applyInPandasWithState(step, out, state, "append", "EventTimeTimeout")


def sessions(events: DataFrame, key: str, stamp: str, gap: str, delay: str) -> DataFrame:
    """(key, first, last, n) of runs of events with no gap of ``gap`` between them."""
    own = events.withWatermark(stamp, delay).groupBy(key, F.session_window(stamp, gap).alias("w"))
    return own.agg(F.count("*").alias("n"), F.min(stamp).alias("first"), F.max(stamp).alias("last")).select(key, "first", "last", "n")

"""Parts of recordings that arrive in any order, given out in order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "recording string, part int, start double, end double, speaker string, text string"
_COLUMNS = ["recording", "part", "start", "end", "speaker", "text"]


def _segments(recording: str, part: int, offset: float, segments: str | None) -> list[tuple]:
    """A part's segments in the time of the whole recording, without empty ones."""
    rows = [(s, (s.get("text") or "").strip()) for s in json.loads(segments or "[]")]
    timed = [(recording, part, round((s.get("start") or 0.0) + offset, 2), round((s.get("end") or 0.0) + offset, 2), (s.get("speaker") or "").strip(), text) for s, text in rows if text]
    return sorted(timed, key=lambda r: r[2])


class Reorder(StatefulProcessor):
    """Holds parts until all before them have come, or until ``wait`` milliseconds of event time pass without one."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "part int")
        self.waiting = handle.getMapState("waiting", "part int", "offset double, segments string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = self.due.get()[0] if self.due.exists() else 0
        latest = 0
        for frame in rows:
            for r in frame.itertuples(index=False):
                latest = max(latest, int(r.at.timestamp() * 1000))
                if r.part >= due:  # a part that has been given out isn't again
                    self.waiting.updateValue((int(r.part),), (float(r.offset), r.segments))
        out = []
        while self.waiting.containsKey((due,)):
            out += _segments(key[0], due, *self.waiting.getValue((due,)))
            self.waiting.removeKey((due,))
            due += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.due.update((due,))
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.wait)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Missing parts are given up: what waits is given out, and nothing is kept."""
        held = sorted((k[0], *v) for k, v in self.waiting.iterator())
        self.due.clear()
        self.waiting.clear()
        yield pd.DataFrame([x for part, offset, segments in held for x in _segments(key[0], part, offset, segments)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def in_order(parts: DataFrame, delay: str, wait: str) -> DataFrame:
    """(recording, part, start, end, speaker, text) of a stream of parts (recording, part from 0, offset, at, segments).

    Segments are an array of structs start, end, speaker and text, in seconds of their part; they come out in the recording's time, those of a
    part once all parts before it have. If none comes for ``wait`` of event time, the missing parts are given up and those that wait come out;
    a part after that, within the watermark's ``delay``, comes out by itself when its own time is up. A part that comes twice counts once.
    The state of a recording is the number of the next part and the parts that wait, and goes when its time is up. Needs the RocksDB state store.
    """
    rows = parts.select(F.col("recording").cast("string").alias("recording"), F.col("part").cast("int").alias("part"), F.col("offset").cast("double").alias("offset"), "at", F.to_json("segments").alias("segments"))
    timed = rows.withWatermark("at", delay)
    return timed.groupBy("recording").transformWithStateInPandas(statefulProcessor=Reorder(pd.Timedelta(wait) // pd.Timedelta("1ms")), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")

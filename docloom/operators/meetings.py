"""Files of meetings: those whose keys are prefixes of each other belong together.

Sorted by bytes, all keys with a prefix follow it. So one walk over the sorted keys finds the shortest prefix of each, and
all it has to remember is the last key that no other is a prefix of. The walk runs in every range of the sort by itself; the key
that each leaves to the next, a row for each range, is settled on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.durable import kept

Open = tuple[str, str] | None


def meeting_key(name: Column) -> Column:
    """A file's name without folder, ending, dates before it and the mark of a transcript, in lower case; of a name that has nothing else, the name."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    key = F.regexp_replace(F.regexp_replace(stem, r"^(?:\d{4}-\d{2}-\d{2}_\d{4}_)+", ""), r"(?i)_transcripcion$", "")
    return F.lower(F.when(key == "", stem).otherwise(key))


def _next(now: Open, group: str, key: str) -> Open:
    """The key that stays open after a key of a group."""
    return now if now and now[0] == group and key.startswith(now[1]) else (group, key)


def _walk(start: dict[int, Open]):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = start.get(TaskContext.get().partitionId())
        for b in it:
            roots = []
            for group, key in zip(b.column("g").to_pylist(), b.column("k").to_pylist(), strict=True):
                now = _next(now, group, key)
                roots.append(now[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())], names=[*b.schema.names, "root"])

    return batches


def _lasts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Open = None
    for b in it:
        for group, key in zip(b.column("g").to_pylist(), b.column("k").to_pylist(), strict=True):
            now = _next(now, group, key)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), *now)], names=["part", "g", "k"])


def roots(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, root) of every distinct key: root is the shortest key of its group that it begins with, itself perhaps. Null keys and groups have none."""
    each = rows.select(F.col(group).cast("string").alias("g"), F.col(key).alias("k")).distinct()
    return _rooted(each).select(F.col("g").cast(rows.schema[group].dataType).alias(group), F.col("k").alias(key), "root")


def _rooted(each: DataFrame) -> DataFrame:
    """Rows with their columns and root, from rows with g and k, in which no two are alike; those with a null are left out."""
    each = each.where("g is not null and k is not null")
    n = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = kept(each.repartitionByRange(n, "g", "k").sortWithinPartitions("g", "k"))
    left = {r["part"]: (r["g"], r["k"]) for r in ranges.select("g", "k").mapInArrow(_lasts, "part long, g string, k string").collect()}  # a row for each range
    start: dict[int, Open] = {}
    now: Open = None
    for part in sorted(left):
        start[part] = now
        now = _next(now, *left[part])
    return ranges.mapInArrow(_walk(start), T.StructType([*ranges.schema.fields, T.StructField("root", T.StringType())]))


def meetings(files: DataFrame, folder: str, name: str) -> DataFrame:
    """(folder, origin, newest, minutes, transcripts): files of a folder by meeting, the names of each kind from the newest on.

    Markdown files are minutes; text, WebVTT and Word files are transcripts; others are left out. Keys that are prefixes of each other
    make one meeting, known by the shortest. newest is the greatest name's date and time.
    """
    ending = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    kind = F.when(ending == "md", "minutes").when(ending.isin("txt", "vtt", "docx"), "transcript")
    known = files.select(folder, name, kind.alias("kind"), meeting_key(F.col(name)).alias("key")).where("kind is not null")
    # names go with their keys, so nothing is joined back
    names = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col(name))).alias(k)
    each = known.groupBy(F.col(folder).cast("string").alias("g"), F.col("key").alias("k")).agg(F.max(name).alias("last"), names("minutes"), names("transcript"))
    newest = F.replace(F.left(F.max("last"), F.lit(16)), F.lit("_"), F.lit(" "))
    sorted_names = lambda k: F.reverse(F.array_sort(F.flatten(F.collect_list(k))))
    found = _rooted(each).groupBy(F.col("g").cast(files.schema[folder].dataType).alias(folder), F.col("root").alias("origin"))
    return found.agg(newest.alias("newest"), sorted_names("minutes").alias("minutes"), sorted_names("transcript").alias("transcripts"))

"""Ordered sequences: first rows, context around changes, runs of labels, highlights, and keyed merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_k(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def with_context(rows: DataFrame, key: str, order: str, changed: Column, around: int = 2) -> DataFrame:
    """Changed rows and those at most ``around`` places from one; column folded counts the rows left out just before."""
    w = Window.partitionBy(key).orderBy(order)
    near = F.max(changed.cast("int")).over(w.rowsBetween(-around, around)) == 1
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_near", near)
    kept = marked.where("_near")
    return kept.withColumn("folded", (F.col("_n") - F.coalesce(F.lag("_n").over(w), F.lit(0)) - 1).cast("long")).drop("_n", "_near")


def merged_runs(rows: DataFrame, key: str, order: list[str], same: list[str], text: str) -> DataFrame:
    """Neighbouring rows with equal ``same`` columns as one: (key, run, same columns, n, text joined by spaces)."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*same)).over(w)
    cut = rows.withColumn("_new", F.when(before.isNull(), 0).otherwise((~before.eqNullSafe(F.struct(*same))).cast("int"))).withColumn("run", F.sum("_new").over(w))
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return cut.groupBy(key, "run", *same).agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["_t"]), " ").alias(text))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("m", T.LongType())])))
def _apart(spans: pd.Series) -> pd.Series:
    out = []
    for row in spans:
        kept, to = [], None
        for x in row:
            if to is None or x["s"] >= to:
                kept.append(x)
                to = -x["m"]
        out.append(kept)
    return pd.Series(out)


def highlights(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans that don't overlap: in order of start, the longest first, each kept if it begins after the last one kept ends.

    A key's spans are gathered, as numbers, as every choice depends on the one before.
    """
    ordered = F.array_sort(F.collect_set(F.struct(F.col(start).cast("long").alias("s"), (-F.col(end)).cast("long").alias("m"))))
    kept = spans.groupBy(key).agg(ordered.alias("_s")).select(key, F.explode(_apart("_s")).alias("x"))
    return kept.select(key, F.col("x.s").alias(start), (-F.col("x.m")).alias(end))


def keyed_merge(old: DataFrame, new: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, nth, old, new, change) of two lists whose keys may repeat: equal keys match first to first, second to second."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    a = old.select(key, nth.alias("nth"), F.col(value).alias("old"))
    b = new.select(key, nth.alias("nth"), F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "kept").otherwise("changed")
    return a.join(b, [key, "nth"], "full").withColumn("change", change)


def after_mark(text: Column, mark: str = "---") -> Column:
    """What stands after the first mark, trimmed; empty without one."""
    return F.when(F.instr(text, mark) > 0, F.trim(F.substr(text, F.instr(text, mark) + len(mark)))).otherwise("")


def age(day: Column, today: Column) -> Column:
    """today, yesterday, this week, this month or older."""
    n = F.datediff(today, day)
    return F.when(n <= 0, "today").when(n == 1, "yesterday").when(n < 7, "this week").when(n < 31, "this month").otherwise("older")

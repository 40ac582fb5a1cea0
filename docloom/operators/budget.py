"""Character budgets, truncation and pagination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.durable import kept
from docloom.operators import running


def fair_share(items: DataFrame, group: str, ident: str, size: str, budget: int) -> DataFrame:
    """items with column quota: each group's budget shared fairly; what small items don't need goes to the others.

    In the order of sizes an item gets all it asks for while that is no more than an equal share of what is left; from
    the first that asks for more, all get that share, rounded down. Groups may have any size; ids must differ in them.
    """
    placed = running.before(items, group, [size, ident], _used=F.col(size), _rank=F.lit(1))
    n = items.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    share = F.floor((F.lit(budget) - F.col("_used")) / (F.col("_n") - F.col("_rank")))
    rows = placed.join(n, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("_share", share).withColumn("_fits", F.col(size) <= F.col("_share"))
    # once one doesn't fit, no later one does
    caps = rows.where("not _fits").groupBy(F.col(group).alias("_g")).agg(F.min(F.struct(F.col(size).alias("s"), F.col(ident).alias("i"), F.col("_share").alias("q"))).alias("_cap"))
    capped = rows.join(caps, F.col(group).eqNullSafe(F.col("_g")), "left")
    return capped.withColumn("quota", F.when(F.col("_fits"), F.col(size)).otherwise(F.greatest(F.col("_cap.q"), F.lit(0))).cast("long")).select(*items.columns, "quota")


def cut_at(items: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """items with column taken: how much of each is within the group's budget, in order; those with none are left out. Groups may have any size."""
    placed = running.before(items, group, order, _used=F.col(size))
    return placed.withColumn("taken", F.least(F.col(size), F.lit(budget) - F.col("_used")).cast("long")).where("taken > 0").drop("_used")


def pages_of(rows: DataFrame, group: str, order: list[str], per_page: int) -> DataFrame:
    """rows with column page from 1: so many to a page."""
    return rows.withColumn("page", (F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / per_page) + 1).cast("int"))


def _starts(heights: np.ndarray, first: float, rest: float, more: np.ndarray) -> list[int]:
    """Places where pages begin; more[i] is the first place at which a page that begins at i may end."""
    ends, out, at = np.cumsum(heights), [], 0
    while at < len(heights):
        out.append(at)
        room = (ends[at - 1] if at else 0) + (rest if at else first)
        at = max(int(np.searchsorted(ends, room, side="right")), int(more[at]))
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _paged(heights: pd.Series, first: pd.Series, rest: pd.Series) -> pd.Series:
    out = []
    for h, f, r in zip(heights, first, rest, strict=True):
        marks = np.zeros(len(h), np.int32)
        marks[_starts(np.asarray(h, float), f, r, np.arange(1, len(h) + 1))] = 1
        out.append(np.cumsum(marks))
    return pd.Series(out)


def paginate(height: Column, capacity: float, rest: float | None = None) -> Column:
    """Pages of a row's ordered array of heights: a new one wherever the next doesn't fit; an array as long as it. Pages after the first may have another capacity."""
    return _paged(height.cast("array<double>"), F.lit(float(capacity)), F.lit(float(capacity if rest is None else rest)))


def paginate_rows(rows: DataFrame, group: str, order: list[str], height: str, capacity: float, rest: float | None = None, stays: str | None = None, light: str | None = None) -> DataFrame:
    """rows with column page from 1, for lists of any length: a new page wherever the next unit doesn't fit.

    A row for which ``stays`` holds is a unit with the one after it. A page has at least one row for which ``light`` (titles, blank lines) doesn't
    hold, however high. Heights are whole numbers or decimals, no null; ``order`` tells the rows of a list apart. Running sums give the
    unit at which a page that begins at any unit would end; which units do begin pages is found by following these links from the first. Links within
    a stretch of units are followed in one task; only units at which one from an earlier stretch ends are joined, twice as far in each round.
    """
    glued, empty = (F.col(c) if c else F.lit(False) for c in (stays, light))
    placed = kept(running.before(rows, group, order, _start=F.col(height), _unit=F.when(glued, 0).otherwise(1)))
    units = placed.groupBy(F.col(group).alias("_list"), F.col("_unit").alias("_u")).agg(F.min("_start").alias("start"), F.sum(height).alias("h"), F.bool_or(~empty).alias("full"))
    units = kept(units.withColumn("stop", F.col("start") + F.col("h")))
    room = F.when(F.col("_u") == 0, F.lit(capacity)).otherwise(F.lit(capacity if rest is None else rest))
    # sorted by value, a question (where does the page of this unit end?) is followed by the first unit that ends beyond its room
    ends = units.select("_list", F.col("stop").cast("decimal(38,6)").alias("at"), F.lit(1).alias("kind"), "_u")
    asks = units.select("_list", (F.col("start").cast("decimal(38,6)") + room.cast("decimal(38,6)")).cast("decimal(38,6)").alias("at"), F.lit(2).alias("kind"), "_u")
    over = running.following(ends.unionByName(asks), "_list", ["at", "kind", "_u"], F.when(F.col("kind") == 1, F.col("_u")), "next").where("kind = 2").select("_list", "_u", "next")
    # and a page goes on beyond its first unit that isn't light
    full = running.following(units, "_list", ["_u"], F.when(F.col("full"), F.col("_u")), "later").select("_list", "_u", F.when(F.col("full"), F.col("_u")).otherwise(F.col("later")).alias("least"))
    links = over.join(full, ["_list", "_u"]).where("next is not null and least is not null").select("_list", "_u", F.greatest(F.col("next"), F.col("least") + 1).alias("next"))
    last = units.groupBy("_list").agg(F.max("_u").alias("last"))
    jumps = kept(links.join(last, "_list").where("next <= last").drop("last"))
    found = _followed(jumps, units.where("_u = 0").select("_list", "_u"))
    begins = found.select("_list", "_u", F.lit(1).alias("begins"))
    marked = units.select("_list", "_u").join(begins, ["_list", "_u"], "left")
    numbered = running.before(marked, "_list", ["_u"], upto=F.coalesce("begins", F.lit(0))).select("_list", "_u", (F.col("upto") + F.coalesce("begins", F.lit(0))).cast("int").alias("page"))
    return placed.join(numbered, F.col(group).eqNullSafe(F.col("_list")) & (F.col("_unit") == F.col("_u"))).select(*rows.columns, "page")


#: Units of a list whose links one task follows.
STRETCH = 1 << 16


def _hops(units: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """For each link of a stretch, the one that goes on where it ends; -1 if that is in another stretch or the last page's unit."""
    at = np.minimum(np.searchsorted(units, nexts), len(units) - 1)
    return np.where(units[at] == nexts, at, -1)


def _ends(links: pd.DataFrame) -> pd.DataFrame:
    """Links of a stretch, each followed as far as links of the stretch go."""
    links = links.sort_values("_u", ignore_index=True)
    ends = links["next"].to_numpy().copy()
    hops = _hops(links["_u"].to_numpy(), ends)
    while len(more := np.flatnonzero(hops >= 0)):
        to = hops[more]
        ends[more], hops[more] = ends[to], hops[to]
    return links.assign(next=ends)[["_list", "_u", "next"]]


def _walked(links: pd.DataFrame) -> pd.DataFrame:
    """The ends of a stretch's links that are followed from its marked unit."""
    links = links.sort_values("_u", ignore_index=True)
    nexts, marks = links["next"].to_numpy(), np.flatnonzero(links["begins"].notna())
    hops, out = _hops(links["_u"].to_numpy(), nexts).tolist(), []
    at = int(marks[0]) if len(marks) else -1
    while at >= 0:
        out.append(at)
        at = hops[at]
    return pd.DataFrame({"_list": links["_list"].iloc[out], "_u": nexts[out]})


def _followed(links: DataFrame, first: DataFrame, stretch: int | None = None) -> DataFrame:
    """(_list, _u): the units that links (_list, _u, next), next beyond _u, lead to from the first ones, and these."""
    stretch = stretch or STRETCH
    number = lambda c: F.floor(F.col(c) / stretch)
    unit = links.schema["_u"].dataType.simpleString()
    links = links.select("_list", F.col("_u").cast("long"), F.col("next").cast("long"), number("_u").alias("_s"))
    first = first.select("_list", F.col("_u").cast("long"))
    kind = f"`_list` {links.schema['_list'].dataType.simpleString()}, `_u` bigint"
    entries = links.where(number("next") != F.col("_s")).select("_list", F.col("next").alias("_u")).unionByName(first).distinct()
    jumps = kept(links.groupBy("_list", "_s").applyInPandas(_ends, f"{kind}, next bigint").join(entries, ["_list", "_u"], "left_semi"))
    found = kept(first)
    while not jumps.isEmpty():
        found = kept(found.unionByName(found.join(jumps, ["_list", "_u"]).select("_list", F.col("next").alias("_u"))))
        jumps = kept(jumps.join(jumps.select("_list", F.col("_u").alias("next"), F.col("next").alias("further")), ["_list", "next"]).select("_list", "_u", F.col("further").alias("next")))
    marked = links.join(found.withColumn("begins", F.lit(1)), ["_list", "_u"], "left")
    return kept(found.unionByName(marked.groupBy("_list", "_s").applyInPandas(_walked, kind)).distinct().select("_list", F.col("_u").cast(unit)))


def text_height(text: Column, per_line: int, points: float) -> Column:
    """Height of a text in lines of so many characters."""
    lines = F.aggregate(F.split(text, "\n"), F.lit(0), lambda a, x: a + F.greatest(F.ceil(F.length(x) / per_line), F.lit(1)).cast("int"))
    return lines * F.lit(points)

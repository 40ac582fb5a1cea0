"""Running sums over groups of any size, in two passes over ranges.

Rows are range-sorted by group and order, so a large group lies in many ranges. Each range sums by itself; the sums of ranges, a row for each
range and group in it, are added up in order and carried in. Where rows have whole numbers for places, ranges are stretches of
these and no sort by range is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.durable import kept

_BEFORE = (Window.unboundedPreceding, -1)


def spread(rows: DataFrame, keys: str | list[str]) -> DataFrame:
    """rows dealt out by keys over all shuffle partitions: merged into fewer, a task's sorts grow large, as such rows take little room on the way."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *([keys] if isinstance(keys, str) else keys))


def ranged(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with column _part, in ranges of (group, order); order must tell the rows of a group apart for equal ones to be spread."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, group, *order).withColumn("_part", F.spark_partition_id()))


def before(rows: DataFrame, group: str, order: list[str], **values: Column) -> DataFrame:
    """rows with, for each named value, its sum over the rows before in their group; rows of a null group are one group."""
    cut = ranged(rows.withColumns({f"_{k}": v for k, v in values.items()}), group, order)
    sums = cut.groupBy(group, "_part").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in values))
    upto = Window.partitionBy(group).orderBy("_part").rowsBetween(*_BEFORE)
    carried = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), *(F.coalesce(F.sum(f"_{k}").over(upto), F.lit(0)).alias(f"_c_{k}") for k in values))
    local = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(*_BEFORE)
    own = cut.withColumns({k: F.coalesce(F.sum(f"_{k}").over(local), F.lit(0)) for k in values})
    both = own.join(carried, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return both.withColumns({k: F.col(k) + F.col(f"_c_{k}") for k in values}).select(*rows.columns, *values)


def following(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the first value that isn't null among the rows after in their group."""
    cut = ranged(rows.withColumn("_v", value), group, order)
    place = F.struct(*order)
    firsts = cut.groupBy(group, "_part").agg(F.min_by("_v", F.when(F.col("_v").isNotNull(), place)).alias("_v"))
    after = Window.partitionBy(group).orderBy(F.desc("_part")).rowsBetween(*_BEFORE)
    carried = firsts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.last("_v", ignorenulls=True).over(after).alias("_c"))
    local = Window.partitionBy("_part", group).orderBy(*(F.desc(c) for c in order)).rowsBetween(*_BEFORE)
    both = cut.withColumn(name, F.last("_v", ignorenulls=True).over(local)).join(carried, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return both.withColumn(name, F.coalesce(name, "_c")).select(*rows.columns, name)


def upto(rows: DataFrame, groups: list[str], place: str, sums: dict[str, Column], lasts: dict[str, Column], stretch: int = 1 << 12) -> DataFrame:
    """rows with named sums, and named last values that aren't null, of the rows of their group up to and with their own, by a whole-number place.

    Stretches of so many places are windows of their own; one row for each is carried in. Groups must not be null, places must differ in them.
    """
    own = {f"_{k}": v for k, v in (sums | lasts).items()}
    cut = rows.withColumns({"_part": F.floor(F.col(place) / stretch)} | own)
    keys = [*groups, "_part"]
    ends = cut.groupBy(keys).agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in sums), *(F.max_by(f"_{k}", F.when(F.col(f"_{k}").isNotNull(), F.col(place))).alias(f"_{k}") for k in lasts))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(*_BEFORE)
    carried = ends.select(*keys, *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_c_{k}") for k in sums), *(F.last(f"_{k}", ignorenulls=True).over(earlier).alias(f"_c_{k}") for k in lasts))
    local = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = cut.withColumns({k: F.sum(f"_{k}").over(local) for k in sums} | {k: F.last(f"_{k}", ignorenulls=True).over(local) for k in lasts}).join(carried, keys)
    return both.withColumns({k: F.col(k) + F.col(f"_c_{k}") for k in sums} | {k: F.coalesce(k, f"_c_{k}") for k in lasts}).select(*rows.columns, *sums, *lasts)

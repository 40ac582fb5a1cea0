"""Timed segments of speech: global times, turns, speakers, clean runs and resolved names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest chain of «merge with» decisions that is followed.
DEPTH = 10


def global_times(segments: DataFrame, offsets: DataFrame, part: str = "part") -> DataFrame:
    """Segments of parts on the recording's own clock, to hundredths; parts without an offset are left out."""
    at = lambda c: F.round(F.col(c) + F.col("offset_s"), 2).alias(c)
    return segments.join(offsets.select(part, "offset_s"), part).select(part, at("start"), at("end"), *[c for c in segments.columns if c not in (part, "start", "end")])


def islands(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """rows with column island: it goes up by one wherever the value differs from the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0))).withColumn("island", F.sum("_new").over(w)).drop("_new")


def turns(rows: DataFrame, key: str, order: list[str], speaker: str, start: str, end: str, text: str | None = None) -> DataFrame:
    """One row for each stretch of one speaker: (key, island, speaker, n, start, end[, text])."""
    aggs = [F.count("*").alias("n"), F.min(start).alias(start), F.max(end).alias(end)]
    if text:
        ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
        aggs.append(F.array_join(F.transform(ordered, lambda x: x["_text"]), " ").alias(text))
    return islands(rows, key, order, speaker).groupBy(key, "island", speaker).agg(*aggs)


def seconds(rows: DataFrame, key: str, speaker: str, start: str, end: str) -> DataFrame:
    """(key, speaker, total, n, first): how long each speaker speaks, negative lengths as none."""
    return rows.groupBy(key, speaker).agg(F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0))).alias("total"), F.count("*").alias("n"), F.min(start).alias("first"))


def speaker_ids(totals: DataFrame, key: str, speaker: str) -> DataFrame:
    """totals with ident SPEAKER_NN, numbered from 0 in the order of first appearance."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("first", speaker)) - 1
    return totals.withColumn("ident", F.format_string("SPEAKER_%02d", n))


def overlap_free(runs: DataFrame, key: str, run_id: str, speaker: str, start: str, end: str, bucket: int) -> DataFrame:
    """Runs that no run of another speaker in the same recording overlaps (open intervals).

    A run is put in every stretch of ``bucket`` that it touches, so that runs are compared only within a stretch of one
    recording: an equi-join whose groups hold what is spoken in that stretch.
    """
    # the sides have columns of their own: the join is of a table with itself
    a = runs.select(F.col(key).alias("_k"), F.col(run_id).alias("_i"), F.col(speaker).alias("_s"), F.col(start).alias("_b"), F.col(end).alias("_e"), F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("_c"))
    b = a.select(*(F.col(c).alias("o" + c) for c in ("_k", "_s", "_b", "_e", "_c")))
    hit = a.join(b, F.expr("_k = o_k and _c = o_c and o_b < _e and o_e > _b and o_s <> _s"), "left_semi").select("_k", "_i").distinct()
    return runs.join(hit, (F.col(key) == F.col("_k")) & (F.col(run_id) == F.col("_i")), "left_anti")


def best_run(runs: DataFrame, key: str, speaker: str, start: str, end: str, clean: Column, least: float = 1.0, most: float = 9.9) -> DataFrame:
    """Each speaker's longest run, clean ones first, the earliest of equals; length between ``least`` and ``most``."""
    place = F.row_number().over(Window.partitionBy(key, speaker).orderBy(clean.desc(), F.desc(F.col(end) - F.col(start)), start))
    best = runs.withColumn("_p", place).where("_p = 1").drop("_p")
    return best.withColumn("clip_s", F.least(F.greatest(F.col(end) - F.col(start), F.lit(least)), F.lit(most)))


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """left with ``out``: the latest right value at or before each row's time, by one window over both sides."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(
        right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def asof_forward(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """left with ``out``: the first right value after each row's time."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(
        right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def resolve_aliases(decisions: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(ident, name, status): names by following «merge with» at most ``depth`` steps.

    decisions: ident, name, target (whom to merge with, or null), ignored. Status is named, ignored, cycle (no end within
    depth) or unresolved (the chain ends without a name). Each step is a join on what is still open.
    """
    now = decisions.select("ident", F.col("ident").alias("at"))
    own = decisions.select(F.col("ident").alias("_i"), F.col("name").alias("_n"), F.col("target").alias("_t"), F.col("ignored").alias("_g"))
    for _ in range(depth):
        step = now.join(own, F.col("at") == F.col("_i"), "left")
        now = step.select("ident", F.when(F.col("_t").isNotNull() & ~F.coalesce("_g", F.lit(False)), F.col("_t")).otherwise(F.col("at")).alias("at"))
    end = now.join(own, F.col("at") == F.col("_i"), "left")
    status = F.when(F.coalesce("_g", F.lit(False)), "ignored").when(F.col("_t").isNotNull(), "cycle").when(F.coalesce(F.trim("_n"), F.lit("")) == "", "unresolved").otherwise("named")
    return end.select("ident", F.when(status == "named", F.col("_n")).alias("name"), status.alias("status"))


def isolated_labels(segments: DataFrame, known: DataFrame, part: str, speaker: str) -> DataFrame:
    """segments whose labels are told apart by part, but for the known names."""
    names = known.select(F.col("name").alias("_name")).distinct()
    return segments.join(names, F.col(speaker) == F.col("_name"), "left").withColumn(
        speaker, F.when(F.col("_name").isNull(), F.concat(F.col(speaker), F.lit("·p"), F.col(part).cast("string"))).otherwise(F.col(speaker))
    ).drop("_name")


def n_parts(seconds: Column, longest: int = 300, margin: int = 5) -> Column:
    """Parts that a recording is cut into; a rest shorter than ``margin`` belongs to the part before."""
    n = F.greatest(F.ceil(F.coalesce(seconds, F.lit(1)) / longest), F.lit(1)).cast("long")
    return F.when((n > 1) & (seconds - (n - 1) * longest < margin), n - 1).otherwise(n)


def renamed(turns: DataFrame, names: DataFrame, speaker: str = "speaker") -> DataFrame:
    """turns under the speakers' final names (speaker, name); those without one are left out."""
    own = names.select(F.col(speaker).alias("_s"), "name").where("name is not null")
    return turns.join(own, F.col(speaker) == F.col("_s")).drop("_s", speaker).withColumnRenamed("name", speaker)


def recordings(parts: DataFrame, key: str, seconds: str, failed: str) -> DataFrame:
    """(key, seconds, failed part numbers in order) of meetings by their parts."""
    return parts.groupBy(key).agg(F.sum(seconds).alias("seconds"), F.array_sort(F.collect_list(F.when(F.col(failed), F.col("part")))).alias("failed"))

"""Cases and their files: listings, projections and small statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import running


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with column place, from 1, over all of them: by ranges, not in one task."""
    own = running.before(rows.withColumn("_all", F.lit(0)), "_all", order, place=F.lit(1))
    return own.withColumn("place", (F.col("place") + 1).cast("int")).drop("_all")


def listing(files: DataFrame, case: str, config: str, modified: str) -> DataFrame:
    """(case, files, modified, place) of cases by their files, the last modified first; files whose configuration is no JSON object don't count."""
    sound = F.get_json_object(config, "$").startswith("{")
    n = files.where(F.coalesce(sound, F.lit(False))).groupBy(case).agg(F.count("*").alias("files"), F.max(modified).alias("modified"))
    return _numbered(n.withColumn("_late", -F.unix_micros(F.col("modified").cast("timestamp"))), ["_late", case]).drop("_late")


def used_tokens(traces: DataFrame, trace: str, keep: list[str]) -> DataFrame:
    """keep, prompt, answer and total tokens from the usage object of a trace's JSON; missing ones are null."""
    number = lambda name: F.get_json_object(trace, f"$.usage.{name}").try_cast("long")
    prompt, answer = number("prompt_tokens"), number("completion_tokens")
    return traces.select(*keep, prompt.alias("prompt"), answer.alias("answer"), (F.coalesce(prompt, F.lit(0)) + F.coalesce(answer, F.lit(0))).alias("total"))


def status(rows: DataFrame, case: str, state: str, ident: str, states: list[str]) -> DataFrame:
    """(case, total, for each state its count and its ids in order, status): the wide row of a case and its JSON."""
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col(state) == s, F.col(ident))))
    n = rows.groupBy(case).agg(F.count("*").alias("total"), *(ids(s).alias(f"ids_{s.lower()}") for s in states))
    wide = n.withColumns({f"n_{s.lower()}": F.size(f"ids_{s.lower()}").cast("long") for s in states})
    return wide.withColumn("status", F.to_json(F.struct("total", *(F.col(f"n_{s.lower()}").alias(s) for s in states))))


def inventory(files: DataFrame, case: str, folder: str, folders: list[str]) -> DataFrame:
    """(case, a count for each folder, other): the evidence by folder."""
    return files.groupBy(case).agg(*(F.count_if(F.col(folder) == f).alias(f"n_{f.lower()}") for f in folders), F.count_if(~F.col(folder).isin(folders) | F.col(folder).isNull()).alias("other"))


def leading(rows: DataFrame, key: str, name: str, seconds: str, least: Column, k: int) -> DataFrame:
    """(key, name, seconds, place): of those for which ``least`` holds, the k with most seconds; equal ones by name."""
    w = Window.partitionBy(key).orderBy(F.desc(seconds), name)
    return rows.where(least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(key, name, seconds, "place")


def frequent(rows: DataFrame, term: str, order: str) -> DataFrame:
    """(term, n, first, place): terms by count, the one seen first first among equals."""
    n = rows.groupBy(term).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return _numbered(n.withColumn("_rare", -F.col("n")), ["_rare", "first", term]).drop("_rare")


def published(before: Column, now: Column) -> Column:
    """Ids published so far and now, each once, in order."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(before, none), F.coalesce(now, none)))


def stale(made: Column, changed: Column) -> Column:
    """Whether something made from a file is older than the file, or not there at all; nothing is stale that has no file."""
    return changed.isNotNull() & (made.isNull() | (made < changed))


def scaled_heights(rows: DataFrame, table: str, height: str, total: Column) -> DataFrame:
    """rows with column scaled: heights stretched or shrunk so that a table's add up to ``total``."""
    return rows.withColumn("scaled", F.col(height) * total / F.sum(height).over(Window.partitionBy(table)))


def placed(blocks: DataFrame, page: str, y: str, kinds: list[str], kind: str, ident: str) -> DataFrame:
    """blocks with column place: down the page, and at one height by kind in the order of ``kinds``."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(y, F.array_position(F.array(*map(F.lit, kinds)), F.col(kind)), ident)))

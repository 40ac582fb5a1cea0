"""Approved findings put into reports: which may enter, which are there already, the report after it and what it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.durable import kept
from docloom.operators import matching, reports

APPROVED = "aprobada"


def hindrances(kind: Column, proposed: Column, recommendation: Column) -> Column:
    """Why a finding can't enter a report: its level is only proposed, or its recommendation is missing."""
    lacking = X.strip(F.coalesce(recommendation, F.lit(""))) == ""
    missing = F.when(lacking, F.when(kind == "suggestion", "no proposal").otherwise("no recommendation"))
    return F.array_compact(F.array(F.when(F.coalesce(proposed, F.lit(False)), "level only proposed"), missing))


def present(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """(id, ident, number, kind) of approved findings that an entry of their report stands for.

    Entries choose in the order of the report, each the finding left whose title or incidence is most alike, from a similarity of 0.6 on.
    """
    entries = reports.parse_entries(docs, id_col).withColumn("place", F.col("number") + F.when(F.col("kind") == "suggestion", 1 << 40).otherwise(0))
    pairs = matching.best_pairs(entries.withColumn("ident", F.col("place")), found.where(F.col("state") == APPROVED), id_col, "ident", ["title", "incidence"], by="order")
    named = entries.select(id_col, F.col("place").alias("left_id"), "number", "kind")
    return pairs.join(named, [id_col, "left_id"]).select(id_col, F.col("right_id").alias("ident"), "number", "kind")


def plan(docs: DataFrame, found: DataFrame, id_col: str, append: bool = False) -> DataFrame:
    """Approved findings with columns hindrances, present and enters.

    found has id, ident (unique in a report), state, kind, proposed and the columns of entries. Appending leaves out those that are present; writing anew
    takes all. What is hindered doesn't enter.
    """
    approved = found.where(F.col("state") == APPROVED).withColumn("hindrances", hindrances(F.col("kind"), F.col("proposed"), F.col("recommendation")))
    if append:
        there = present(docs, found, id_col).select(id_col, "ident", F.lit(True).alias("present"))
        approved = approved.join(there, [id_col, "ident"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
    else:
        approved = approved.withColumn("present", F.lit(False))
    return approved.withColumn("enters", ~F.col("present") & (F.size("hindrances") == 0))


def published(docs: DataFrame, found: DataFrame, id_col: str, append: bool = False) -> DataFrame:
    """(id, old, new): every report before and after its findings enter: behind its entries if ``append``, else in their place. A report that none enters stays as it is."""
    entering = kept(plan(docs, found, id_col, append).where("enters"))
    columns = [c for c in reports.ENTRY if c != "number"]
    full = entering if "cause" in entering.columns else entering.withColumn("cause", F.lit(""))
    fresh = full.select(id_col, F.lit(1).alias("late"), F.row_number().over(Window.partitionBy(id_col).orderBy("ident")).alias("number"), "cause", *columns)
    whole = fresh
    if append:
        now = reports.parse_entries(docs, id_col).select(id_col, F.lit(0).alias("late"), "number", F.lit("").alias("cause"), *columns)
        whole = now.unionByName(fresh)
    ordered = whole.withColumn("number", F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("late", "number"))).drop("late")
    touched = entering.select(id_col).distinct()
    heads = reports.parse_heads(docs, id_col).join(touched, id_col, "left_semi")
    new = reports.render_reports(heads, ordered.join(touched, id_col, "left_semi"), id_col).withColumnRenamed("text", "new")
    return docs.select(id_col, F.col("text").alias("old")).join(new, id_col, "left").withColumn("new", F.coalesce("new", "old"))


def preview(docs: DataFrame, found: DataFrame, id_col: str, append: bool = False) -> DataFrame:
    """What publishing would change, section by section; nothing is written."""
    return reports.compare_reports(published(docs, found, id_col, append), id_col)

"""Incremental processing, version history, registries and integrity manifests: append-only tables and joins on hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X


def unprocessed(docs: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Documents whose name and hash aren't registered: new ones, and those whose content has changed."""
    return docs.join(registry.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: the present state of an append-only table."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the new ones in place of those with their keys."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return latest(both, keys, ["_n"]).drop("_n")


def accumulated(old: DataFrame, new: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """upsert() in which ``amount`` adds up."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    others = [c for c in old.columns if c not in (*keys, amount)]
    return both.groupBy(*keys).agg(F.sum(amount).alias(amount), *(F.max_by(c, "_n").alias(c) for c in others))


def snapshot_names(rows: DataFrame, stamp: Column, stem: Column, reason: Column, order: list[str]) -> DataFrame:
    """rows with column file: time, stem and reason; files of one time and stem are told apart by a number."""
    named = rows.withColumn("_ts", F.date_format(stamp, "yyyy-MM-dd'T'HH-mm-ss")).withColumn("_stem", stem)
    n = F.row_number().over(Window.partitionBy("_ts", "_stem").orderBy(*order)) - 1
    name = F.concat_ws("_", "_ts", "_stem", X.slug(reason))
    return named.withColumn("file", F.when(n == 0, name).otherwise(F.concat(name, F.lit("."), n.cast("string")))).drop("_ts", "_stem")


def snapshot_time(name: Column) -> Column:
    """The time in a snapshot's name; null if it has none."""
    return F.try_to_timestamp(F.substring(name, 1, 19), F.lit("yyyy-MM-dd'T'HH-mm-ss"))


def latest_different(versions: DataFrame, current: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """(key, version columns) of the newest version whose content isn't the current one."""
    now = current.select(key, F.col(digest).alias("_now"))
    return latest(versions.join(now, key).where(F.col(digest) != F.col("_now")).drop("_now"), [key], order)


def verified(manifest: DataFrame, found: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, status) of every file in the manifest: ok, missing or changed. Files beyond the manifest aren't reported."""
    own = found.select(F.col(path).alias("_p"), F.col(digest).alias("_d"))
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("_d") != F.col(digest), "changed").otherwise("ok")
    return manifest.join(own, F.col(path) == F.col("_p"), "left").select(path, status.alias("status"))


def pairs(drafts: DataFrame, approved: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Drafts with the approved version of their key; of several the last one."""
    own = latest(approved, [key], order)
    return drafts.join(own.select(key, *(F.col(c).alias("approved_" + c) for c in own.columns if c != key)), key)


def restored(versions: DataFrame, key: str, order: str, back: DataFrame) -> DataFrame:
    """Rows to append that bring a version back: of each key in ``back`` the version named there, or the newest if that is null."""
    asked = back.select(F.col(key).alias("_k"), F.col(order).alias("_o"))
    found = versions.join(asked, F.col(key) == F.col("_k")).where(F.col("_o").isNull() | (F.col(order) == F.col("_o")))
    return latest(found.drop("_k", "_o"), [key], [order])


def deleted(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose keys are named by a tombstone."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def rewritten(texts: DataFrame, paragraphs: DataFrame, answers: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, ident, answer) of the answers whose paragraph still stands in the text. A text's paragraphs are gathered next to it, so that it is moved once."""
    asked = answers.join(paragraphs.select(key, ident, "paragraph"), [key, ident]).groupBy(key).agg(F.collect_list(F.struct(ident, "answer", "paragraph")).alias("_a"))
    return texts.select(key, "text").join(asked, key).select(key, F.explode(F.filter("_a", lambda a: F.contains(F.col("text"), a["paragraph"]))).alias("_a")).select(key, f"_a.{ident}", "_a.answer")

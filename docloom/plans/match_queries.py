"""Registered queries that SQL can't express: similarity, comparison of versions, patches, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import external
from docloom.operators import diff, markdown, matching, patch, segment


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sections(spark, sf_dir):
    """Each line of a document as a section, and a later version: every third line goes, every fifth is changed."""
    own = segment.lines(_t(spark, sf_dir, "documents").where(F.length("text") > 0), "doc_id")
    old = own.select("doc_id", F.lit("line").alias("kind"), F.left("text", F.lit(40)).alias("title"), F.col("line").alias("ord"), "text")
    new = old.where("ord % 3 <> 0").withColumn("text", F.when(F.col("ord") % 5 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return old, new


def section_diff(spark, sf_dir):
    return diff.compare_sections(*_sections(spark, sf_dir), "doc_id").groupBy("doc_id", "state").agg(F.count("*").alias("sections"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def similarity(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    pairs = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"))
    return pairs.select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"), F.round(diff.ratio("a.n_name", "b.n_name"), 6).alias("ratio"))


def fuzzy_pairs(spark, sf_dir):
    """Of each source, documents of the first fifty ids of a hundred matched one to one with those of the last fifty whose words are alike, the most similar first."""
    d = _t(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return matching.best_pairs(d.where("doc_id % 100 < 50"), d.where("doc_id % 100 >= 50"), "source", "doc_id", "text", 0.8).withColumn("score", F.round("score", 6))


def patch_apply(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.regexp_extract("text", r"^([^.!?\n]+[.!?])", 1)
    changes = docs.select("doc_id", F.lit(1).alias("seq"), F.lit(None).cast("string").alias("section"), first.alias("old"), F.lit("Replaced.").alias("new"), F.lit(None).cast("string").alias("insert_after"))
    again = changes.withColumn("seq", F.lit(2))
    out = patch.apply_changes(docs, changes.unionByName(again), "doc_id")
    return out.select("doc_id", F.md5("text").alias("digest"), F.array_join(F.transform("results", lambda x: x["state"]), ",").alias("states"))


def findings_parse(spark, sf_dir):
    """Parts as findings, rendered by brand and parsed again."""
    p = _t(spark, sf_dir, "part").select("p_brand", F.row_number().over(segment.Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long").alias("block"), F.col("p_name").alias("title"), F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("fields"))
    back = markdown.parse_findings(markdown.render_findings(p, "p_brand", {"type": "Type", "size": "Size"}), "p_brand")
    return back.select("p_brand", "block", "title", F.col("fields")["type"].alias("p_type"), F.col("fields")["size"].cast("int").alias("p_size"))


def model_answers(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return external.complete(d, "doc_id", "text", "summary", "action string, size int").select("doc_id", "answer.action", "answer.size", "attempts")


QUERIES = {f.__name__: f for f in (section_diff, similarity, fuzzy_pairs, patch_apply, findings_parse, model_answers)}

ORACLES = {
    "findings_parse": "SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS block, trim(p_name) AS title, p_type, p_size FROM part",
    "model_answers": "SELECT doc_id, 'summary' AS action, CAST(length(coalesce(text, '')) AS INTEGER) AS size, 1::INTEGER AS attempts FROM documents",
}

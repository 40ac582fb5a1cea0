"""Registered queries over findings, plans of changes, layouts, recordings and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import findings, layout, transcripts, versions


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legible_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(X.legible(F.col("text"))).alias("digest"))


def file_names(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.file_name(F.col("text")).alias("file"))


def part_labels(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "Sugerencia de mejora").when(F.col("p_size") % 3 == 1, "MEJORA propuesta").otherwise("Recomendación")
    reason = F.when(F.col("p_size") % 4 == 0, "corregir").when(F.col("p_size") % 4 == 1, "").otherwise(F.concat(F.lit("por-"), F.lower("p_brand")))
    return p.select("p_partkey", X.finding_kind(kind).alias("kind"), X.change_origin(reason).alias("origin"), X.contentless(F.split("p_name", " ")[0]).alias("contentless"), transcripts.n_parts(F.col("p_size") * 101).alias("parts"))


def order_months(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy(X.month_label(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))


def plan_summary(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "R", "aplicado en prosa").when(F.col("l_returnflag") == "A", "insertado").when(F.col("l_linenumber") > 3, "conflicto").otherwise("no encontrado")
    return findings.applied(_t(spark, sf_dir, "lineitem").withColumn("state", state), "l_orderkey", "state")


def paragraph_findings(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    out = findings.by_paragraph(li, ["l_orderkey", "l_returnflag"], "l_linenumber", "l_linestatus")
    return out.withColumn("messages", F.array_join("messages", ","))


def bad_choices(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 9).alias("choice"))
    totals = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return findings.out_of_range(li, totals, "l_orderkey", "choice", "n")


def numbered_tests(spark, sf_dir):
    d = _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size", "p_name"))), lambda x: F.concat((x["p_size"] % 12).cast("string"), F.lit(".7. "), F.upper(x["p_name"]))), "\n").alias("text"))
    return findings.numbered_tests(d, "p_brand")


def line_styles(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.repeat(F.lit("x"), F.col("l_linenumber").cast("int") - 1).alias("text"), (F.col("l_quantity").cast("int") % 7 + 8).cast("double").alias("size"), (F.col("l_returnflag") == "N").alias("bold"))
    out = layout.line_style(li, ["l_orderkey"])
    return out.withColumn("size", F.round("size", 6))


def layout_objects(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    area = (F.col("q") * F.col("l_linenumber") * 3000).cast("double")
    return li.select("l_orderkey", "l_linenumber", layout.real_table(F.col("q"), area).alias("is_table"), layout.real_image(F.col("q") * 2, F.col("l_linenumber") * 12).alias("is_image"))


def numbering_before(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    li = li.select("l_orderkey", "l_linenumber", F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "R", ") x").when(F.col("l_returnflag") == "A", ".1. x").otherwise(" x")).alias("text"))
    return layout.separator_before(li, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "before")


def renamed_turns(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"))
    names = c.select("speaker").distinct().withColumn("name", F.when(F.col("speaker") != "system", F.concat(F.lit("Speaker "), F.upper("speaker"))))
    return transcripts.renamed(c, names).select("conv_id", "turn", "speaker")


def recordings(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("part"), F.col("l_quantity").cast("long").alias("s"), (F.col("l_returnflag") == "R").alias("bad"))
    return transcripts.recordings(li, "l_orderkey", "s", "bad").withColumn("failed", F.array_join("failed", ","))


def restored_versions(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    back = _t(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "P", 1).alias("l_linenumber"))
    return versions.restored(li, "l_orderkey", "l_linenumber", back).select("l_orderkey", "l_linenumber", "l_partkey")


def deleted_cases(spark, sf_dir):
    gone = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return versions.deleted(_t(spark, sf_dir, "lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


def rewritten_paragraphs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")
    each = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("id", "paragraph")).where("paragraph <> ''")
    changed = F.when(F.col("id") % 2 == 0, F.concat("paragraph", F.lit("\u0001"))).otherwise(F.col("paragraph"))
    answers = each.select("doc_id", "id", F.md5("paragraph").alias("answer"))
    return versions.rewritten(d, each.withColumn("paragraph", changed), answers, "doc_id", "id")


QUERIES = {f.__name__: f for f in (
    legible_text, file_names, part_labels, order_months, plan_summary, paragraph_findings, bad_choices, numbered_tests, line_styles, layout_objects,
    numbering_before, renamed_turns, recordings, restored_versions, deleted_cases, rewritten_paragraphs,
)}

_STRIPPED = "list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g'))"
_PROSE = f"""array_to_string(list_filter({_STRIPPED}, lambda l: l <> ''
    AND length(regexp_replace(l, '[^\\p{{L}}\\p{{Z}}\\s]', '', 'g')) >= 0.6 * length(l)
    AND len(regexp_extract_all(l, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{{4,}}')) >= CASE WHEN regexp_matches(l, '\\p{{Ll}}') THEN 2 ELSE 5 END), chr(10))"""
_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)

ORACLES = {
    "legible_text": f"SELECT doc_id, md5(CASE WHEN length(t) >= 20 THEN t ELSE '' END) AS digest FROM (SELECT doc_id, {_PROSE} AS t FROM documents)",
    "file_names": "SELECT doc_id, replace(trim(left(regexp_replace(text, '[^\\p{L}\\p{N}_\\-. ]', '', 'g'), 60)), ' ', '_') AS file FROM documents",
    "part_labels": f"""SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'sugerencia' ELSE 'recomendacion' END AS kind,
        CASE WHEN p_size % 4 = 0 THEN 'Corrección de estilo' WHEN p_size % 4 = 1 THEN 'Cambio' ELSE 'Por ' || lower(p_brand) END AS origin,
        (length(w) < 4 OR w IN ({_STOPS})) AS contentless, CASE WHEN n > 1 AND s - (n - 1) * 300 < 5 THEN n - 1 ELSE n END AS parts
        FROM (SELECT *, lower(regexp_replace(split_part(p_name, ' ', 1), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS w, p_size * 101 AS s, CAST(greatest(1, ceil(p_size * 101 / 300)) AS BIGINT) AS n FROM part)""",
    "order_months": "SELECT strftime(o_orderdate, '%B %Y') AS month, count(*) AS n FROM orders GROUP BY 1",
    "plan_summary": """SELECT l_orderkey, done, conflicts, total, 'Aplicados ' || done || ' de ' || total || ' cambios en el informe' AS summary FROM
        (SELECT l_orderkey, count(*) FILTER (l_returnflag IN ('R', 'A')) AS done, count(*) FILTER (l_returnflag NOT IN ('R', 'A') AND l_linenumber > 3) AS conflicts, count(*) AS total FROM lineitem GROUP BY 1)""",
    "paragraph_findings": "SELECT l_orderkey, l_returnflag, count(*) AS n, string_agg(l_linestatus, ',' ORDER BY l_linenumber, l_linestatus) AS messages FROM lineitem GROUP BY 1, 2",
    "bad_choices": """SELECT l_orderkey, l_linenumber, choice FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) % 9 AS choice, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
        WHERE choice >= n OR choice < 0""",
    "numbered_tests": """SELECT p_brand, (p_size % 12) || '.7' AS code, arg_min(trim(upper(p_name)), p_partkey) AS title FROM part
        WHERE regexp_full_match(upper(p_name), '[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ0-9 ,/()\\-–—:]{10,}\\s*') GROUP BY 1, 2""",
    "line_styles": """SELECT l_orderkey, round(coalesce(sum(size * n) / nullif(sum(n), 0), 0), 6) AS size, (sum(n) > 0 AND coalesce(sum(n) FILTER (l_returnflag = 'N'), 0) * 2 >= sum(n)) AS bold
        FROM (SELECT *, CAST(CAST(trunc(l_quantity) AS INTEGER) % 7 + 8 AS DOUBLE) AS size, l_linenumber - 1 AS n FROM lineitem) GROUP BY 1""",
    "layout_objects": """SELECT l_orderkey, l_linenumber, (q >= 20 AND q >= 0.0003::DOUBLE * (q * l_linenumber * 3000)::DOUBLE) AS is_table, (q * 2 >= 40 AND l_linenumber * 12 >= 40) AS is_image
        FROM (SELECT *, CAST(trunc(l_quantity) AS INTEGER) AS q FROM lineitem)""",
    "numbering_before": "SELECT l_orderkey, l_linenumber, lag(CASE l_returnflag WHEN 'R' THEN ')' WHEN 'A' THEN '.' END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)",
    "renamed_turns": "SELECT conv_id, turn, 'Speaker ' || upper(role) AS speaker FROM conversations WHERE role <> 'system'",
    "recordings": "SELECT l_orderkey, sum(CAST(trunc(l_quantity) AS BIGINT))::BIGINT AS seconds, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), '') AS failed FROM lineitem GROUP BY 1",
    "restored_versions": """SELECT l_orderkey, max(l_linenumber) AS l_linenumber, arg_max(l_partkey, l_linenumber) AS l_partkey FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderstatus = 'F' OR (o_orderstatus = 'P' AND l_linenumber = 1) GROUP BY 1""",
    "deleted_cases": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "rewritten_paragraphs": "SELECT doc_id, id, md5(p) AS answer FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS id FROM documents) WHERE p <> '' AND id % 2 = 1",
}

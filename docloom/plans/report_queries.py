"""Registered queries over reports, versions and their differences, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import diff, edits, layout, lint, meetings, reports, rules


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reports(spark, sf_dir):
    """Heads and entries: suppliers' countries as reports, customers as their entries."""
    heads = _t(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("report"), F.concat(F.lit("About "), "n_name").alias("introduction"),
        F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("First of "), "n_name", F.lit("\n\nSecond."))).otherwise("").alias("summary"), F.when(F.col("n_nationkey") % 3 == 0, "Razonable").otherwise("").alias("rating"),
    )
    number, kind = F.col("c_custkey").cast("int"), F.when(F.col("c_custkey") % 3 == 0, "suggestion").otherwise("recommendation")
    balance = F.round("c_acctbal").cast("long").cast("string")
    entries = _t(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("report"), kind.alias("kind"), number.alias("number"), F.concat("c_name", F.lit(" · 2.1")).alias("title"), F.concat(F.lit("2."), number.cast("string"), F.lit(" a) x: y")).alias("test"),
        F.element_at(F.array(*map(F.lit, reports.LEVELS)), number % 4 + 1).alias("risk"), (number % 2 == 0).alias("proposed"), F.col("c_mktsegment").alias("area"), F.when(number % 5 != 0, "Area head").otherwise("").alias("owner"),
        F.lit("").alias("due"), F.when(number % 7 == 0, "TMS-10").otherwise("").alias("reference"), F.concat(F.lit("Balance of "), balance, F.lit("\nin two lines.\n\n- Not: a data line")).alias("incidence"),
        F.when(number % 5 == 0, "").otherwise(F.concat(F.lit("- Key: "), number.cast("string"), F.lit("\n- Balance: "), balance)).alias("details"),
        F.when(number % 5 == 0, "").otherwise("It may grow.\n\n- And so on").alias("consequences"), F.when(number % 6 == 0, "").otherwise("Settle it.\n\nWatch it.").alias("recommendation"),
    )
    return heads, entries


def report_entries(spark, sf_dir):
    """Reports written and read again: entries."""
    return reports.entries_of(reports.render_lines(*_reports(spark, sf_dir), "report"), "report")


def report_heads(spark, sf_dir):
    """Reports written and read again: heads."""
    heads, entries = _reports(spark, sf_dir)
    return reports.heads_of(reports.render_lines(heads, entries, "report"), heads.select("report"), "report")


def report_changes(spark, sf_dir):
    """Each report against a version with every eleventh entry left out, every seventh renamed in its prose and the introduction kept."""
    heads, entries = _reports(spark, sf_dir)
    changed = F.when(F.col("number") % 7 == 0, F.concat("incidence", F.lit(" now"))).otherwise(F.col("incidence"))
    left = entries.where("number % 11 <> 0").withColumn("incidence", changed)
    found = reports.compare_lines(*(reports.render_lines(heads, e, "report") for e in (entries, left)), heads.select("report"), "report")
    return found.where("kind in ('introduction', 'summary') or state = 'deleted'").groupBy("report", "kind", "state").agg(F.count("*").alias("sections"))


def _versions(spark, sf_dir):
    """Lines of documents as sections under their own text, and a version with lines moved down, left out and repeated."""
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).select("doc_id", F.lit("line").alias("kind"), F.md5("text").alias("title"), (F.col("ord") * 10).cast("long").alias("ord"), "text")
    moved = lines.where("ord % 110 <> 50").withColumn("ord", F.when(F.col("ord") % 70 == 30, F.col("ord") + 45).otherwise(F.col("ord")))
    return lines, moved.unionByName(lines.where("ord % 130 = 20").withColumn("ord", F.col("ord") + 8))


def section_alignment(spark, sf_dir):
    """Sections that keep their order between two versions, with their places in both."""
    return diff.align_sections(*_versions(spark, sf_dir), "doc_id").where("stays").select("doc_id", F.col("a_ord").alias("old_place"), F.col("b_ord").alias("new_place"))


def unified_diff(spark, sf_dir):
    """Each document against a version with lines left out and changed: lines gained, and the digest of what its hunks make of the old text."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 3 != 1, F.when(i % 5 == 2, F.concat(x, F.lit(" more"))).otherwise(x)))
    pairs = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"), F.array_join(F.array_compact(lines), "\n").alias("new"))
    found = edits.hunks(pairs, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("hunk", "a", "n", "b", "m", "lines"))).alias("h"))
    none = F.array().cast(found.schema["h"].dataType)
    both = pairs.join(found, "doc_id", "left").withColumn("h", F.coalesce("h", none))
    gained = F.aggregate("h", F.lit(0).cast("long"), lambda a, h: a + h["m"] - h["n"])
    return both.select("doc_id", gained.alias("gained"), F.md5(F.array_join(edits.with_hunks(F.col("old"), F.col("h")), "\n")).alias("digest"))


def reading_order(spark, sf_dir):
    """Eight orders as the rows of a page, their lines as pieces of a row: pages of one column, of several, and of gaps that don't recur."""
    page = F.floor(F.col("l_orderkey") / 8)
    x0 = (F.col("l_linenumber") - 1) * 100 + F.when(page % 3 == 1, F.col("l_partkey") % 90).otherwise(F.col("l_partkey") % 5)
    text = F.when(F.col("l_partkey") % 7 == 0, "1.").when(F.col("l_partkey") % 11 == 0, "de").otherwise(F.concat(F.lit("Item "), F.col("l_partkey")))
    y0 = (F.col("l_orderkey") % 8) * 20 + F.col("l_partkey") % 3
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = _t(spark, sf_dir, "lineitem").select(page.alias("page"), ident.alias("ident"), text.alias("text"), x0.alias("x0"), (x0 + F.when(page % 3 == 0, 99).otherwise(60)).alias("x1"), y0.alias("y0"), (y0 + 12).alias("y1"))
    return layout.reading_order(lines, "page", "ident")


def meeting_files(spark, sf_dir):
    """A file for each order in its customer's folder, under keys that are cut at many lengths."""
    o = _t(spark, sf_dir, "orders")
    word = F.concat("o_orderstatus", F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.lit("_"), "o_orderstatus", "o_orderpriority")
    mark, ending = F.when(F.col("o_orderkey") % 2 == 0, "_Transcripcion").otherwise(""), F.element_at(F.array(*map(F.lit, ("md", "txt", "VTT", "png"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd_HHmm_"), F.left(word, (F.col("o_orderkey") % 13 + 1).cast("int")), mark, F.lit("."), ending)
    found = meetings.meetings(o.select(F.col("o_custkey").alias("folder"), name.alias("name")), "folder", "name")
    return found.select("folder", "origin", "newest", F.array_join("minutes", ",").alias("minutes"), F.array_join("transcripts", ",").alias("transcripts"))


STYLE = rules.from_config({
    "palabras_prohibidas": [{"termino": "Balance of", "motivo": "Say which.", "sugerencia": "Balance at closing"}],
    "tono": {"expresiones_a_cuestionar": [{"termino": "balance", "alternativa": "position"}, {"termino": "not: a", "alternativa": ""}], "adjetivos_a_cuestionar": [{"termino": "second"}]},
    "reglas": {"longitud_maxima_frase": 7, "niveles_riesgo_validos": ["Crítico", "Alto", "Medio"]},
    "estructura_conclusion": [{"campo": "owner", "descripcion": "who"}, {"campo": "due", "descripcion": "when", "requerido": False}],
})


def record_lint(spark, sf_dir):
    """Findings of all fields of the reports' entries, counted by kind and field."""
    found = lint.record_findings(_reports(spark, sf_dir)[1], STYLE, "number", ["title", "incidence", "details", "consequences", "recommendation"], "risk")
    return found.groupBy(F.col("number").alias("entry"), "field", "kind", "severity").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


QUERIES = {f.__name__: f for f in (report_entries, report_heads, report_changes, section_alignment, unified_diff, reading_order, meeting_files, record_lint)}

_ENTRIES = r"""
    SELECT c_nationkey AS report, CASE WHEN c_custkey % 3 = 0 THEN 'suggestion' ELSE 'recommendation' END AS kind, CAST(c_custkey AS INTEGER) AS num,
           c_name || ' · 2.1' AS title, '2.' || c_custkey || ' a) x: y' AS test, ['Crítico', 'Alto', 'Medio', 'Bajo'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS risk, c_custkey % 2 = 0 AS proposed,
           c_mktsegment AS area, CASE WHEN c_custkey % 5 <> 0 THEN 'Area head' ELSE '' END AS owner, '' AS due, CASE WHEN c_custkey % 7 = 0 THEN 'TMS-10' ELSE '' END AS reference,
           'Balance of ' || CAST(round(c_acctbal) AS BIGINT) || chr(10) || 'in two lines.' || chr(10) || chr(10) || '- Not: a data line' AS incidence,
           CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '- Key: ' || c_custkey || chr(10) || '- Balance: ' || CAST(round(c_acctbal) AS BIGINT) END AS details,
           CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'It may grow.' || chr(10) || chr(10) || '- And so on' END AS consequences,
           CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Settle it.' || chr(10) || chr(10) || 'Watch it.' END AS recommendation FROM customer"""

ORACLES = {
    "report_entries": f"WITH e AS ({_ENTRIES}) SELECT report, kind, CAST(row_number() OVER (PARTITION BY report, kind ORDER BY num) AS INTEGER) AS number, * EXCLUDE (report, kind, num) FROM e",
    "report_heads": "SELECT n_nationkey AS report, 'About ' || n_name AS introduction, CASE WHEN n_nationkey % 4 <> 0 THEN 'First of ' || n_name || chr(10) || chr(10) || 'Second.' ELSE '' END AS summary, CASE WHEN n_nationkey % 3 = 0 THEN 'Razonable' ELSE '' END AS rating FROM nation",
    "report_changes": f"""WITH e AS ({_ENTRIES})
        SELECT report, kind, 'deleted' AS state, count(*) AS sections FROM e WHERE num % 11 = 0 GROUP BY report, kind
        UNION ALL SELECT n_nationkey, 'introduction', 'equal', 1 FROM nation
        UNION ALL SELECT n_nationkey, 'summary', 'equal', 1 FROM nation WHERE n_nationkey % 4 <> 0 OR n_nationkey % 3 = 0""",
    # level of a pair: length of the longest run that ends there; the run goes back from the least last place to the least place one level lower
    "section_alignment": """WITH RECURSIVE l AS (SELECT doc_id, md5(unnest(string_split(text, chr(10)))) AS k, CAST(unnest(range(len(string_split(text, chr(10))))) * 10 AS BIGINT) AS ord FROM documents),
        n AS (SELECT doc_id, k, CASE WHEN ord % 70 = 30 THEN ord + 45 ELSE ord END AS ord FROM l WHERE ord % 110 <> 50 UNION ALL SELECT doc_id, k, ord + 8 FROM l WHERE ord % 130 = 20),
        p AS (SELECT a.doc_id, a.ord AS a, b.ord AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY ord) AS nth FROM l) a JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY ord) AS nth FROM n) b USING (doc_id, k, nth)),
        r AS (SELECT 1 AS level, doc_id, a, b FROM p UNION SELECT r.level + 1, p.doc_id, p.a, p.b FROM r JOIN p ON p.doc_id = r.doc_id AND r.a < p.a AND r.b < p.b),
        v AS (SELECT doc_id, a, b, max(level) AS level FROM r GROUP BY doc_id, a, b),
        q AS (SELECT x.doc_id, x.a, x.b, arg_min(y.a, y.b) AS before FROM v x LEFT JOIN v y ON x.doc_id = y.doc_id AND y.a < x.a AND y.b < x.b AND y.level = x.level - 1 GROUP BY x.doc_id, x.a, x.b),
        e AS (SELECT doc_id, arg_min(a, b) AS a FROM v WHERE (doc_id, level) IN (SELECT (doc_id, max(level)) FROM v GROUP BY doc_id) GROUP BY doc_id),
        c AS (SELECT doc_id, a FROM e UNION ALL SELECT q.doc_id, q.before FROM c JOIN q USING (doc_id, a) WHERE q.before IS NOT NULL)
        SELECT doc_id, a AS old_place, b AS new_place FROM c JOIN p USING (doc_id, a)""",
    "unified_diff": """WITH d AS (SELECT doc_id, coalesce(text, '') AS old, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        n AS (SELECT doc_id, old, array_to_string(list_transform(list_filter(range(len(l)), lambda i: i % 3 <> 1), lambda i: CASE WHEN i % 5 = 2 THEN l[i + 1] || ' more' ELSE l[i + 1] END), chr(10)) AS new FROM d),
        t AS (SELECT doc_id, regexp_replace(old, '\\n\\z', '') AS old, new AS raw, regexp_replace(new, '\\n\\z', '') AS new FROM n)
        SELECT doc_id, CAST((CASE WHEN raw = '' THEN 0 ELSE len(string_split(new, chr(10))) END) - (CASE WHEN old = '' THEN 0 ELSE len(string_split(old, chr(10))) END) AS BIGINT) AS gained, md5(new) AS digest FROM t""",
    "reading_order": r"""WITH g AS (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS page, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ident, CASE WHEN l_partkey % 7 = 0 THEN '1.' WHEN l_partkey % 11 = 0 THEN 'de' ELSE 'Item ' || l_partkey END AS text,
            (l_linenumber - 1) * 100 + CASE WHEN floor(l_orderkey / 8) % 3 = 1 THEN l_partkey % 90 ELSE l_partkey % 5 END AS x0, (l_orderkey % 8) * 20 + l_partkey % 3 AS y0 FROM lineitem),
        l AS (SELECT *, x0 + CASE WHEN page % 3 = 0 THEN 99 ELSE 60 END AS x1, y0 + 12 AS y1 FROM g),
        b0 AS (SELECT *, CASE WHEN y0 >= max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM l),
        b AS (SELECT * EXCLUDE (n), sum(n) OVER (PARTITION BY page ORDER BY y0, y1) AS band FROM b0),
        p0 AS (SELECT *, CASE WHEN x0 >= max(x1) OVER (PARTITION BY page, band ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM b),
        p AS (SELECT * EXCLUDE (n), sum(n) OVER (PARTITION BY page, band ORDER BY x0, x1) AS piece FROM p0),
        s AS (SELECT page, band, piece, min(x0) AS x0, max(x1) AS x1, string_agg(text, ' ' ORDER BY x0, ident) AS words, first(text ORDER BY x0, ident) AS text FROM p GROUP BY page, band, piece),
        c AS (SELECT *, coalesce(x0 - lag(x1) OVER w >= 8 AND NOT (length(trim(lag(words) OVER w)) < 15 AND regexp_matches(trim(lag(words) OVER w) || ' x', '^[0-9]+(\.[0-9]+){0,3}[.)]\s+\S')), false) AS parted,
                     length(regexp_replace(text, '\W', '', 'g')) >= 4 AS votes FROM s WINDOW w AS (PARTITION BY page, band ORDER BY piece)),
        v0 AS (SELECT page, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) > 8 THEN 1 ELSE 0 END AS n FROM c WHERE parted AND votes),
        v1 AS (SELECT page, x0, sum(n) OVER (PARTITION BY page ORDER BY x0) AS k FROM v0),
        v AS (SELECT page, min(x0) AS lo, max(x0) AS hi FROM v1 GROUP BY page, k HAVING count(*) >= 3),
        f AS (SELECT c.page, c.band, c.piece, CAST(parted AND EXISTS (SELECT 1 FROM v WHERE v.page = c.page AND c.x0 BETWEEN lo - 8 AND hi + 8) AS INTEGER) AS ok FROM c),
        k AS (SELECT page, band, piece, CAST(sum(ok) OVER (PARTITION BY page, band ORDER BY piece) AS INTEGER) AS col FROM f),
        r AS (SELECT p.page, ident, p.band, col, row_number() OVER (PARTITION BY p.page ORDER BY p.band, col, y0, x0, ident) AS place, row_number() OVER (PARTITION BY p.page, p.band, col ORDER BY y0, x0, ident) = 1 AS first, max(col) OVER (PARTITION BY p.page, p.band) > 0 AS several FROM p JOIN k USING (page, band, piece))
        SELECT page, ident, CAST(band AS BIGINT) AS band, col AS "column", CAST(place AS INTEGER) AS place, (first AND col > 0) OR coalesce(lag(several) OVER w AND lag(band) OVER w <> band, false) AS breaks FROM r WINDOW w AS (PARTITION BY page ORDER BY place)""",
    "meeting_files": """WITH f AS (SELECT o_custkey AS folder, strftime(o_orderdate, '%Y-%m-%d_%H%M_') || left(o_orderstatus || replace(o_orderpriority, ' ', '_') || '_' || o_orderstatus || o_orderpriority, CAST(o_orderkey % 13 + 1 AS INTEGER))
                || CASE WHEN o_orderkey % 2 = 0 THEN '_Transcripcion' ELSE '' END || '.' || ['md', 'txt', 'VTT', 'png'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS name FROM orders),
        k AS (SELECT folder, name, lower(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '^([0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{4}_)+', ''), '_Transcripcion$', '')) AS key,
                CASE WHEN name LIKE '%.md' THEN 'm' WHEN lower(name) LIKE '%.txt' OR lower(name) LIKE '%.vtt' THEN 't' END AS kind FROM f),
        d AS (SELECT DISTINCT folder, key FROM k WHERE kind IS NOT NULL),
        r AS (SELECT a.folder, a.key, arg_min(b.key, length(b.key)) AS root FROM d a JOIN d b ON a.folder = b.folder AND starts_with(a.key, b.key) GROUP BY a.folder, a.key)
        SELECT folder, root AS origin, replace(left(max(name), 16), '_', ' ') AS newest, coalesce(string_agg(name, ',' ORDER BY name DESC) FILTER (kind = 'm'), '') AS minutes,
               coalesce(string_agg(name, ',' ORDER BY name DESC) FILTER (kind = 't'), '') AS transcripts FROM k JOIN r USING (folder, key) WHERE kind IS NOT NULL GROUP BY folder, root""",
    "record_lint": f"""WITH e AS ({_ENTRIES}), t AS (SELECT num, 'incidence' AS field, incidence AS text FROM e UNION ALL SELECT num, 'details', details FROM e)
        SELECT num AS entry, 'owner' AS field, 'structure' AS kind, 'error' AS severity, 1::BIGINT AS n, -1::INTEGER AS first_pos FROM e WHERE owner = ''
        UNION ALL SELECT num, 'due', 'structure', 'warning', 1, -1 FROM e
        UNION ALL SELECT num, 'risk', 'structure', 'error', 1, -1 FROM e WHERE risk = 'Bajo'
        UNION ALL SELECT num, 'incidence', 'forbidden', 'error', 1, 0 FROM e
        UNION ALL SELECT num, 'incidence', 'tone', 'warning', 2, 0 FROM e
        UNION ALL SELECT num, 'details', 'tone', 'warning', 1, CAST(strpos(details, 'Balance') - 1 AS INTEGER) FROM e WHERE details <> ''
        UNION ALL SELECT num, field, 'long_sentence', 'warning', count(*), CAST(min(strpos(text, s) - 1) AS INTEGER) FROM (
            SELECT num, field, text, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM t)
            WHERE len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) > 7 GROUP BY num, field""",
}

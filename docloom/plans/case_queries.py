"""Registered queries over cases, their files, findings and actions, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import actions, cases, reports, speakers
from docloom.plans.report_queries import _reports


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_listing(spark, sf_dir):
    """Users as cases, their events as files; every thirteenth has a broken configuration."""
    e = _t(spark, sf_dir, "events").withColumn("config", F.when(F.col("event_id") % 13 == 0, "{broken").otherwise(F.col("props")))
    return cases.listing(e, "user_id", "config", "ts").select("user_id", "files", F.unix_micros(F.col("modified").cast("timestamp")).alias("modified"), "place")


def trace_tokens(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.format_string('{"usage": {"prompt_tokens": %s, "completion_tokens": %s}}', F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).otherwise("null")).alias("trace"))
    return cases.used_tokens(e, "trace", ["event_id"])


def case_status(spark, sf_dir):
    """Customers as cases, their orders as findings: counts, ids and JSON by state."""
    n = cases.status(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", ["F", "O", "P"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return n.select("o_custkey", "total", "n_f", "n_o", "n_p", text("ids_f"), text("ids_o"), "status")


def evidence_inventory(spark, sf_dir):
    return cases.inventory(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["A", "R"])


def leading_voices(spark, sf_dir):
    """Of each user the two event types with the greatest values, among those with at least two events."""
    n = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.floor(F.coalesce("value", F.lit(0.0))).cast("long")).alias("seconds"), F.count("*").alias("n"))
    return cases.leading(n, "user_id", "event_type", "seconds", F.col("n") >= 2, 2)


def frequent_terms(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))
    return cases.frequent(p, "term", "p_partkey")


def published_ids(spark, sf_dir):
    """Orders that a customer had before and after a day, as ids published before and now; an overlap on it."""
    o = _t(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    both = o.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderkey") % 3 != 0, F.col("id"))).alias("before"), F.collect_set(F.when(F.col("o_orderkey") % 3 != 1, F.col("id"))).alias("now"))
    return both.select("o_custkey", F.array_join(cases.published(F.col("before"), F.col("now")), ",").alias("ids"))


def stale_decks(spark, sf_dir):
    """An order as a deck made from its lines: stale if a line is shipped after it, or if it isn't there."""
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("changed"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("made")).join(lines, "o_orderkey", "left")
    return o.select("o_orderkey", cases.stale(F.col("made"), F.col("changed")).alias("stale"))


def scaled_rows(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return cases.scaled_heights(li, "l_orderkey", "l_quantity", F.lit(100.0)).select("l_orderkey", "l_linenumber", "l_partkey", F.round("scaled", 6).alias("scaled"))


def placed_blocks(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("page"), (F.col("l_partkey") % 7).alias("y"), "l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("ident"))
    return cases.placed(li, "page", "y", ["R", "N", "A"], "l_returnflag", "ident").select("page", "ident", "place")


def report_sections(spark, sf_dir):
    """Sections of the written reports, in order."""
    heads, entries = _reports(spark, sf_dir)
    found = reports.sections_of(reports.render_lines(heads, entries, "report"), heads.select("report"), "report")
    return found.select("report", "kind", "title", F.row_number().over(Window.partitionBy("report").orderBy("ord")).alias("place"))


def _findings(spark, sf_dir):
    """Entries of the reports as findings of a case: a third approved, every eleventh discarded."""
    e = _reports(spark, sf_dir)[1]
    state = F.when(F.col("number") % 11 == 0, actions.DISCARDED).when(F.col("number") % 3 == 1, actions.APPROVED).otherwise(actions.PROPOSED)
    notes = F.when(F.col("number") % 13 == 0, "Say more.").otherwise("")
    return e.select(F.col("report").alias("case"), F.format_string("C-%02d", "number").alias("ident"), state.alias("state"), "kind", F.col("risk").alias("level"), "proposed", notes.alias("notes"), "test", "title", "incidence", "recommendation", "number")


def extracted_findings(spark, sf_dir):
    """Parts as answers of a model, added to the findings of the case of their size."""
    answers = _t(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 30).cast("int").alias("case"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 4 == 0, "Mejora").otherwise("Recomendación").alias("kind"), F.when(F.col("p_partkey") % 5 != 0, "ALTO riesgo").otherwise("").alias("level"),
        (F.col("p_partkey") % 2 == 0).alias("supported"), F.col("p_name").alias("title"), F.lit("").alias("recommendation"),
    )
    return actions.extracted(_findings(spark, sf_dir).drop("number"), answers).select("case", "ident", "state", "kind", "level", "proposed", "title", "outcome")


def uncovered_tests(spark, sf_dir):
    """Codes of parts as tests of a case, mentioned by the tests of its findings."""
    p = F.col("p_partkey")
    tests = _t(spark, sf_dir, "part").select((p % 25).cast("int").alias("case"), F.concat(F.lit("2."), (p % 100).cast("string")).alias("code"), F.col("p_name").alias("title"))
    return actions.uncovered(tests, _findings(spark, sf_dir).select("case", F.col("test").alias("text")))


def recommended_findings(spark, sf_dir):
    """Findings that lack a recommendation get a person's, a model's, or none; some come with a suggestion."""
    f = _findings(spark, sf_dir)
    given = f.where("number % 12 < 6").select("case", "ident", F.when(F.col("number") % 4 == 2, "Mine").otherwise("").alias("text"), (F.col("number") % 24 == 0).alias("refused"))
    answers = f.where("number % 18 > 0").select("case", "ident", F.lit(" Theirs ").alias("recommendation"), F.when(F.col("number") % 36 == 6, "Also").otherwise("").alias("extra_title"), F.lit("More").alias("extra_text"))
    found = actions.recommended(f.drop("number"), given, answers, all_states=True)
    return found.select("case", "ident", "state", "kind", "title", "recommendation", "outcome")


def _recordings(spark, sf_dir):
    """Users' events as the segments of recordings of two parts, an event type a voice; one type is a known name."""
    e = _t(spark, sf_dir, "events")
    at = (F.unix_micros(F.col("ts").cast("timestamp")) % 3_600_000_000) / 1_000_000.0
    text = F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_id").cast("string"))
    segments = e.select(F.col("user_id").alias("recording"), (F.col("event_id") % 2).cast("int").alias("part"), F.round(at, 2).alias("start"), F.round(at + F.floor(F.coalesce("value", F.lit(0.0))) / 10, 2).alias("end"), F.col("event_type").alias("speaker"), text.alias("text"))
    users = e.select(F.col("user_id").alias("recording")).distinct()
    both = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(s).alias("offset_s")) for p, s in ((0, 0.0), (1, 3600.0)))))
    offsets = users.select("recording", both.alias("o")).select("recording", "o.*").where("part = 0 or recording % 3 <> 0")
    return segments, offsets, users.select("recording", F.lit("purchase").alias("name"))


def voices(spark, sf_dir):
    segments, offsets, known = _recordings(spark, sf_dir)
    heard = speakers.voices(speakers.whole(segments, offsets, known), known, 30.0)
    return heard.select("recording", "speaker", "ident", "known", F.round("seconds", 1).alias("seconds"), "n")


def labelled_transcripts(spark, sf_dir):
    """Turns under final names: the first voice is named, the second merges with it, the third is ignored, others have no name."""
    segments, offsets, known = _recordings(spark, sf_dir)
    own = speakers.whole(segments, offsets, known)
    heard = speakers.voices(own, known, 30.0)
    others = heard.where("not known").select("recording", "ident")
    number = F.substring("ident", 9, 2).cast("int")
    decisions = others.where(number <= 3).select("recording", "ident", F.when(number == 1, "Ana").alias("name"), F.when(number == 2, "SPEAKER_01").alias("target"), (number == 3).alias("ignored"))
    turns = speakers.transcript(own, speakers.named(heard, decisions))
    return speakers.written(turns).select("recording", F.md5("text").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        voices, labelled_transcripts, case_listing, trace_tokens, case_status, evidence_inventory, leading_voices, frequent_terms, published_ids, stale_decks, scaled_rows, placed_blocks, report_sections,
        extracted_findings, uncovered_tests, recommended_findings,
    )
}

_F = """f AS (SELECT c_nationkey AS "case", printf('C-%02d', c_custkey) AS ident, CASE WHEN c_custkey % 11 = 0 THEN 'descartada' WHEN c_custkey % 3 = 1 THEN 'aprobada' ELSE 'propuesta' END AS state,
        CASE WHEN c_custkey % 3 = 0 THEN 'suggestion' ELSE 'recommendation' END AS kind, ['Crítico', 'Alto', 'Medio', 'Bajo'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS level, c_custkey % 2 = 0 AS proposed, '2.' || c_custkey || ' a) x: y' AS test,
        c_name || ' · 2.1' AS title, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Settle it.' || chr(10) || chr(10) || 'Watch it.' END AS recommendation, c_custkey AS num FROM customer)"""

_V = """p AS (SELECT DISTINCT user_id AS recording FROM events), o AS (SELECT recording, part, part * 3600.0::DOUBLE AS off FROM p, (VALUES (0), (1)) AS x(part) WHERE part = 0 OR recording % 3 <> 0),
        e AS (SELECT user_id AS recording, CAST(event_id % 2 AS INTEGER) AS part, (epoch_us(ts) % 3600000000) / 1000000.0::DOUBLE AS t, floor(coalesce(value, 0)) / 10 AS len, event_type, event_id FROM events),
        g AS (SELECT e.recording, e.part, round(round(t, 2) + off, 2) AS b, round(round(t + len, 2) + off, 2) AS f, event_id::VARCHAR AS text,
                CASE WHEN event_type = 'purchase' OR e.recording % 3 = 0 THEN event_type ELSE event_type || '·p' || (e.part + 1) END AS speaker FROM e JOIN o USING (recording, part) WHERE event_id % 9 <> 0),
        n AS (SELECT recording, speaker, speaker = 'purchase' AS known, round(sum(greatest(f - b, 0)), 2) AS seconds, count(*) AS n, min((b, part, f)) AS first FROM g GROUP BY recording, speaker HAVING speaker = 'purchase' OR round(sum(greatest(f - b, 0)), 2) >= 30),
        v AS (SELECT *, CASE WHEN known THEN speaker ELSE printf('SPEAKER_%02d', count(*) FILTER (NOT known) OVER (PARTITION BY recording ORDER BY first, speaker)) END AS ident FROM n)"""

ORACLES = {
    "voices": f"WITH {_V} SELECT recording, speaker, ident, known, round(seconds, 1) AS seconds, n FROM v",
    "labelled_transcripts": f"""WITH {_V}, w AS (SELECT g.*, CASE WHEN known THEN g.speaker ELSE 'Ana' END AS name FROM g JOIN v USING (recording, speaker) WHERE known OR ident IN ('SPEAKER_01', 'SPEAKER_02')),
        i0 AS (SELECT *, CASE WHEN lag(name) OVER (PARTITION BY recording ORDER BY b, part, f) <> name THEN 1 ELSE 0 END AS new FROM w), i AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY b, part, f) AS turn FROM i0),
        t AS (SELECT recording, turn, name || ': ' || string_agg(text, ' ' ORDER BY b, part, f, text) AS line FROM i GROUP BY recording, turn, name)
        SELECT recording, md5(string_agg(line, chr(10) ORDER BY turn)) AS digest FROM t GROUP BY recording""",
    "case_listing": "WITH n AS (SELECT user_id, count(*) AS files, max(epoch_us(ts)) AS modified FROM events WHERE event_id % 13 <> 0 AND props IS NOT NULL GROUP BY user_id) SELECT *, CAST(row_number() OVER (ORDER BY modified DESC, user_id) AS INTEGER) AS place FROM n",
    "trace_tokens": "WITH n AS (SELECT event_id, CAST(props::JSON ->> '$.k' AS BIGINT) AS prompt, CASE WHEN event_id % 3 <> 0 THEN event_id END AS answer FROM events) SELECT *, coalesce(prompt, 0) + coalesce(answer, 0) AS total FROM n",
    "case_status": """WITH n AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p,
            coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), '') AS ids_f, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'O'), '') AS ids_o FROM orders GROUP BY o_custkey)
        SELECT *, '{"total":' || total || ',"F":' || n_f || ',"O":' || n_o || ',"P":' || n_p || '}' AS status FROM n""",
    "evidence_inventory": "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) FILTER (l_returnflag NOT IN ('A', 'R') OR l_returnflag IS NULL) AS other FROM lineitem GROUP BY l_orderkey",
    "leading_voices": "WITH n AS (SELECT user_id, event_type, CAST(sum(CAST(floor(coalesce(value, 0)) AS BIGINT)) AS BIGINT) AS seconds FROM events GROUP BY user_id, event_type HAVING count(*) >= 2) SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seconds DESC, event_type) AS INTEGER) AS place FROM n QUALIFY place <= 2",
    "frequent_terms": "WITH n AS (SELECT term, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) GROUP BY term) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, first, term) AS INTEGER) AS place FROM n",
    "published_ids": "SELECT o_custkey, string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS ids FROM orders GROUP BY o_custkey",
    "stale_decks": "SELECT o_orderkey, changed IS NOT NULL AND (o_orderkey % 5 = 0 OR o_orderdate IS NULL OR o_orderdate < changed) AS stale FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS changed FROM lineitem GROUP BY l_orderkey) USING (o_orderkey)",
    "scaled_rows": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 100.0::DOUBLE / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS scaled FROM lineitem",
    "placed_blocks": """WITH l AS (SELECT CAST(floor(l_orderkey / 16) AS BIGINT) AS page, l_partkey % 7 AS y, l_returnflag AS kind, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS ident FROM lineitem)
        SELECT page, ident, CAST(row_number() OVER (PARTITION BY page ORDER BY y, list_position(['R', 'N', 'A'], kind), ident) AS INTEGER) AS place FROM l""",
    "report_sections": """WITH s AS (SELECT n_nationkey AS report, 'introduction' AS kind, 'Introducción' AS title, 0 AS a, 0 AS b FROM nation UNION ALL SELECT n_nationkey, 'summary', 'Resumen ejecutivo', 1, 0 FROM nation WHERE n_nationkey % 4 <> 0 OR n_nationkey % 3 = 0
            UNION ALL SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'suggestion' ELSE 'recommendation' END, c_name || ' · 2.1', CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END, c_custkey FROM customer)
        SELECT report, kind, title, CAST(row_number() OVER (PARTITION BY report ORDER BY a, b) AS INTEGER) AS place FROM s""",
    "extracted_findings": f"""WITH {_F}, m AS (SELECT "case", max(num) AS m FROM f GROUP BY "case")
        SELECT "case", ident, state, kind, level, proposed, title, 'kept' AS outcome FROM f
        UNION ALL SELECT CAST(p_partkey % 30 AS INTEGER), printf('C-%02d', coalesce(m, 0) + row_number() OVER (PARTITION BY p_partkey % 30 ORDER BY p_partkey)), 'propuesta', CASE WHEN p_partkey % 4 = 0 THEN 'suggestion' ELSE 'recommendation' END,
            CASE WHEN p_partkey % 5 <> 0 THEN 'Alto' ELSE '' END, p_partkey % 5 <> 0 AND p_partkey % 2 <> 0, p_name, 'added' FROM part LEFT JOIN m ON m."case" = p_partkey % 30""",
    "uncovered_tests": """SELECT CAST(p_partkey % 25 AS INTEGER) AS "case", '2.' || (p_partkey % 100) AS code, p_name AS title FROM part
        WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = p_partkey % 25 AND c_custkey = p_partkey % 100)""",
    "recommended_findings": f"""WITH {_F}, j AS (SELECT *, CASE WHEN state = 'descartada' THEN 'out of scope' WHEN recommendation <> '' THEN 'kept' WHEN num % 12 < 6 AND num % 24 = 0 THEN 'refused' WHEN num % 12 < 6 AND num % 4 = 2 THEN 'given' WHEN num % 18 > 0 THEN 'answered' ELSE 'open' END AS outcome FROM f),
        x AS (SELECT * FROM j WHERE outcome = 'answered' AND kind <> 'suggestion' AND num % 36 = 6), n AS (SELECT "case", count(*) AS n FROM f GROUP BY "case")
        SELECT "case", ident, state, kind, title, CASE outcome WHEN 'given' THEN 'Mine' WHEN 'answered' THEN 'Theirs' ELSE recommendation END AS recommendation, outcome FROM j
        UNION ALL SELECT x."case", printf('C-%02d', n + row_number() OVER (PARTITION BY x."case" ORDER BY ident)), 'propuesta', 'suggestion', 'Also', 'More', 'added' FROM x JOIN n USING ("case")""",
}

"""Registered queries over rows: turns, as-of joins, versions, gates, budgets and page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import budget, findings, layout, lint, transcripts, versions


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# events as speech: a user's events are a recording, the event's type is who speaks, value the length in tenths of minutes
def _speech(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_id", F.col("event_type").alias("speaker"), us.alias("b"), (us + F.floor(F.coalesce("value", F.lit(0.0))).cast("long") * 6_000_000).alias("e"))


_S = "s AS (SELECT user_id, event_id, event_type AS speaker, epoch_us(ts) AS b, epoch_us(ts) + CAST(floor(coalesce(value, 0)) AS BIGINT) * 6000000 AS e FROM events)"
_ISL = "i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY b, event_id) AS island FROM (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY user_id ORDER BY b, event_id) <> speaker THEN 1 ELSE 0 END AS new FROM s))"


def speaker_islands(spark, sf_dir):
    return transcripts.turns(_speech(spark, sf_dir), "user_id", ["b", "event_id"], "speaker", "b", "e").select("user_id", F.col("island").cast("long").alias("island"), "speaker", "n", "b", "e")


def speaker_seconds(spark, sf_dir):
    return transcripts.seconds(_speech(spark, sf_dir), "user_id", "speaker", "b", "e").select("user_id", "speaker", "total", "n")


def first_appearance_ids(spark, sf_dir):
    return transcripts.speaker_ids(transcripts.seconds(_speech(spark, sf_dir), "user_id", "speaker", "b", "e"), "user_id", "speaker").select("user_id", "speaker", "ident")


def relevant_speakers(spark, sf_dir):
    return transcripts.seconds(_speech(spark, sf_dir), "user_id", "speaker", "b", "e").where((F.col("total") >= 3_000_000_000) | (F.col("speaker") == "purchase")).select("user_id", "speaker", "total")


def interval_overlap_anti(spark, sf_dir):
    return transcripts.overlap_free(_speech(spark, sf_dir), "user_id", "event_id", "speaker", "b", "e", 3_600_000_000).select("user_id", "event_id", "speaker")


def best_runs(spark, sf_dir):
    runs = transcripts.turns(_speech(spark, sf_dir), "user_id", ["b", "event_id"], "speaker", "b", "e")
    clean = transcripts.overlap_free(runs, "user_id", "island", "speaker", "b", "e", 3_600_000_000).select("user_id", "island", F.lit(True).alias("clean"))
    best = transcripts.best_run(runs.join(clean, ["user_id", "island"], "left"), "user_id", "speaker", "b", "e", F.coalesce("clean", F.lit(False)), 1.0, 9_000_000_000.0)
    return best.select("user_id", "speaker", "b", F.col("clip_s").cast("long").alias("clip"))


def top_voices(spark, sf_dir):
    n = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), F.desc("user_id")).limit(4)


def part_offsets(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + 1).alias("end"))
    offsets = spark.range(1, 8).select(F.col("id").cast("int").alias("part"), (F.col("id") * 300.0).alias("offset_s"))
    return transcripts.global_times(li, offsets).select("l_orderkey", "part", "start", "end")


def asof_backward(spark, sf_dir):
    s = _speech(spark, sf_dir)
    return transcripts.asof_backward(s.where("speaker = 'purchase'").select("user_id", "event_id", "b"), s.where("speaker <> 'purchase'"), "user_id", "b", "event_id", "before").select("user_id", "event_id", "before")


def asof_forward(spark, sf_dir):
    s = _speech(spark, sf_dir)
    return transcripts.asof_forward(s.where("speaker = 'purchase'").select("user_id", "event_id", "b"), s.where("speaker <> 'purchase'"), "user_id", "b", "event_id", "after").select("user_id", "event_id", F.col("after").alias("after_id"))


def alias_chain(spark, sf_dir):
    """Customers as speakers: a key that is no multiple of five merges with the next smaller; of each hundred the fifth and sixth point at one another."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    target = F.when(k % 100 == 5, k + 1).when(k % 100 == 6, k - 1).when(k % 5 != 0, k - 1)
    decisions = c.select(k.alias("ident"), F.when(k % 20 == 0, "").otherwise(F.col("c_name")).alias("name"), target.alias("target"), (k % 10 == 0).alias("ignored"))
    return transcripts.resolve_aliases(decisions)


def new_documents(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    # what the sources with an even number hold is registered
    registry = docs.where(F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2 == 0).select("sha256")
    return versions.unprocessed(docs, registry, ["sha256"]).select("doc_id", "sha256")


def dup_by_hash(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def manifest_verify(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    manifest = docs.select("path", F.sha2("text", 256).alias("sha256"))
    k = F.col("path").cast("long")
    found = docs.where(k % 10 != 3).select("path", F.sha2(F.when(k % 10 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return versions.verified(manifest, found)


def latest_orders(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return versions.latest(o, ["o_custkey"], ["at", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def latest_different(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    now = versions.latest(o, ["o_custkey"], ["at", "o_orderkey"])
    return versions.latest_different(o, now, "o_custkey", ["at", "o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus")


def snapshot_names(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    named = versions.snapshot_names(o, F.col("o_orderdate").cast("timestamp"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"), ["o_orderkey"])
    return named.select("o_orderkey", "file", F.unix_micros(versions.snapshot_time(F.col("file"))).alias("taken"))


def registry_upsert(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"), F.lit(1).cast("long").alias("amount"))
    old, new = (c.where(f"v % 2 = {i}").groupBy("k").agg(F.max("v").alias("v"), F.sum("amount").alias("amount")) for i in (0, 1))
    return versions.accumulated(old, new, ["k"], "amount").select("k", "v", "amount")


def draft_pairs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Informe "), (F.floor(F.col("doc_id") / 3)).cast("string"), F.when(F.col("doc_id") % 3 == 0, "_Borrador").when(F.col("doc_id") % 3 == 1, " aprobado").otherwise(" final")).alias("name"))
    named = d.withColumn("key", X.pair_key(F.col("name")))
    drafts, approved = named.where(F.col("name").endswith("_Borrador")), named.where(~F.col("name").endswith("_Borrador"))
    return versions.pairs(drafts, approved, "key", ["doc_id"]).select("key", "doc_id", F.col("approved_doc_id"))


def unpaired_drafts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") + 1).alias("next"), "source")
    return d.join(d.select(F.col("doc_id").alias("next"), "source"), ["next", "source"], "left_anti").select("doc_id")


_STATES = ["O", "F", "P"]


def status_pivot(spark, sf_dir):
    return findings.pivot_states(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", _STATES)


def workflow_phase(spark, sf_dir):
    own = findings.pivot_states(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", _STATES)
    steps = [("draft", F.col("n_f") == 0), ("review", F.col("n_o") > F.col("n_f")), ("publish", F.col("n_p") > 0)]
    return own.select("o_custkey", findings.phase(steps, "archive").alias("phase"))


def required_fields(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return lint.missing_fields(c, {"c_name": True, "c_mktsegment": False}, "c_custkey")


def domain_check(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(" (proposed)")).alias("p"))
    return lint.outside_domain(o, "p", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "o_orderkey")


def publication_gate(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    out = findings.gate(o, {"open": F.col("o_orderstatus") == "O", "low": F.col("o_totalprice") < 50000, "urgent": F.col("o_orderpriority").startswith("1")})
    return out.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("passes"))


def next_ids(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_nationkey", "c_name")
    return findings.next_id(c, "c_nationkey", "c_name")


def field_updates(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = c.where("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.lit("APPROVED")).alias("c_mktsegment"))
    return findings.updated(c, changes, "c_custkey", ["c_mktsegment"])


def approvals(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(X.code_id(F.col("c_name")).alias("ident"), F.lit("proposed").alias("state"))
    return findings.with_state(c, [f"C-{i:02d}" for i in (3, 7, 40)], "ident", "state", "approved").groupBy("state").agg(F.count("*").alias("n"), F.min("ident").alias("first_id"))


def annex_rows(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return findings.annex(d, "doc_id", F.col("text")).select("doc_id", F.col("k").cast("int").alias("k"), "number", "shown", F.md5("part").alias("digest"))


def fair_share_budget(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("size"))
    return budget.fair_share(d, "source", "doc_id", "size", 20_000).select("doc_id", "source", "quota")


def corpus_cut(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("size"))
    return budget.cut_at(d, "source", ["doc_id"], "size", 20_000).select("doc_id", "taken")


def pages_fixed(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return budget.pages_of(li, "l_orderkey", ["l_linenumber", "l_partkey"], 2).select("l_orderkey", "l_linenumber", "l_partkey", "page")


def pages_by_capacity(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("rows"))
    pages = budget.paginate(F.transform("rows", lambda x: x["l_quantity"].cast("double")), 60.0)
    return li.select("l_orderkey", F.size("rows").alias("n"), F.array_max(pages).alias("pages"))


def pages_of_long_lists(spark, sf_dir):
    """All order lines of a status as one list, by order: pages of 2,000 pieces, 1,500 after the first; a first line stays with what follows, small lots don't fill a page."""
    li = _t(spark, sf_dir, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("pieces"), F.col("l_extendedprice").alias("price"))
    marked = li.withColumns({"first": F.col("l_linenumber") == 1, "small": F.col("pieces") < 3})
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]
    found = budget.paginate_rows(marked, "l_linestatus", order, "pieces", 2000, 1500, "first", "small")
    return found.groupBy("l_linestatus", "page").agg(F.count("*").alias("n"), F.sum("pieces").alias("pieces"), F.min("l_orderkey").alias("from_order"))


# order lines as lines on a page: the order is the page, supplier and part give places, quantity the type size
def _layout(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    y, x = F.col("l_partkey") % 97, F.col("l_suppkey") % 41
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), (F.floor(F.col("l_orderkey") / 32)).alias("doc"), x.alias("x0"), (x + 9).alias("x1"), y.alias("y0"), (y + 12).alias("y1"), F.col("l_quantity").cast("long").alias("size"), F.col("l_returnflag").alias("text"), (F.col("l_linestatus") == "F").alias("bold"))


_LAY = "l AS (SELECT l_orderkey AS page, l_linenumber AS line, l_partkey AS part, CAST(floor(l_orderkey / 32) AS BIGINT) AS doc, l_suppkey % 41 AS x0, l_suppkey % 41 + 9 AS x1, l_partkey % 97 AS y0, l_partkey % 97 + 12 AS y1, CAST(l_quantity AS BIGINT) AS size, l_returnflag AS text, l_linestatus = 'F' AS bold FROM lineitem)"


def layout_bands(spark, sf_dir):
    return layout.alone(layout.bands(_layout(spark, sf_dir), "page", "y0", "y1"), "page", "band", ["y0", "y1"]).groupBy("page", "band").agg(F.count("*").alias("n"), F.min("y0").alias("top"), F.bool_and("alone").alias("alone"))


def layout_columns(spark, sf_dir):
    return layout.clusters(_layout(spark, sf_dir), "doc", "x0", 1, 3)


def layout_median(spark, sf_dir):
    return layout.weighted_median(_layout(spark, sf_dir).withColumn("w", F.col("part") % 13), "doc", "size", "w")


def layout_headers(spark, sf_dir):
    return layout.repeated_texts(_layout(spark, sf_dir), "doc", "page", "text")


def layout_levels(spark, sf_dir):
    own = _layout(spark, sf_dir).withColumn("w", F.lit(1))
    return layout.size_levels(own, "doc", "size", layout.weighted_median(own, "doc", "size", "w")).select("doc", F.col("size").cast("double").alias("size"), "level")


def layout_outside(spark, sf_dir):
    own = _layout(spark, sf_dir)
    return layout.outside(own.where("line > 1"), own.where("line = 1"), "page").select("page", "line", "part")


def scalar_labels(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", X.clock(F.col("o_totalprice")).alias("clock"), X.thousands(F.floor("o_totalprice")).alias("thousands"), X.code_id(F.concat(F.lit("OBS-"), F.col("o_custkey").cast("string"))).alias("code"),
        X.slug(F.col("o_orderpriority")).alias("slug"), F.bround(F.col("o_orderkey") / 2).cast("long").alias("half_even"), F.least(F.greatest(F.col("o_totalprice") / 100000, F.lit(0.5)), F.lit(0.98)).alias("clamped"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.regexp_extract(F.date_format("o_orderdate", "yyyy-MM-dd"), r"(\d{4})", 1).alias("year"),
    )


def portfolio(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.countDistinct("o_custkey").alias("customers"))


def searched(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    text = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return c.where(text.contains("build") & F.col("c_custkey").cast("string").rlike("^[A-Za-z0-9._-]+$") & (F.col("c_acctbal") >= 0)).select("c_custkey", "c_mktsegment")


_LATEST = "(SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)"
_PIVOT = "(SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_custkey)"

ORACLES = {
    "speaker_islands": f"WITH {_S}, {_ISL} SELECT user_id, CAST(island AS BIGINT) AS island, speaker, count(*) AS n, min(b) AS b, max(e) AS e FROM i GROUP BY user_id, island, speaker",
    "speaker_seconds": f"WITH {_S} SELECT user_id, speaker, CAST(sum(greatest(e - b, 0)) AS BIGINT) AS total, count(*) AS n FROM s GROUP BY user_id, speaker",
    "first_appearance_ids": f"WITH {_S} SELECT user_id, speaker, printf('SPEAKER_%02d', row_number() OVER (PARTITION BY user_id ORDER BY min(b), speaker) - 1) AS ident FROM s GROUP BY user_id, speaker",
    "relevant_speakers": f"WITH {_S} SELECT user_id, speaker, CAST(sum(greatest(e - b, 0)) AS BIGINT) AS total FROM s GROUP BY user_id, speaker HAVING sum(greatest(e - b, 0)) >= 3000000000 OR speaker = 'purchase'",
    "interval_overlap_anti": f"WITH {_S} SELECT user_id, event_id, speaker FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.user_id = s.user_id AND o.b < s.e AND o.e > s.b AND o.speaker <> s.speaker)",
    "best_runs": f"""WITH {_S}, {_ISL}, r AS (SELECT user_id, island, speaker, count(*) AS n, min(b) AS b, max(e) AS e FROM i GROUP BY user_id, island, speaker)
        SELECT user_id, speaker, b, CAST(least(greatest(e - b, 1), 9000000000) AS BIGINT) AS clip FROM r QUALIFY row_number() OVER (PARTITION BY user_id, speaker ORDER BY EXISTS (SELECT 1 FROM r AS o WHERE o.user_id = r.user_id AND o.b < r.e AND o.e > r.b AND o.speaker <> r.speaker), e - b DESC, b) = 1""",
    "top_voices": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id DESC LIMIT 4",
    "part_offsets": 'SELECT l_orderkey, l_linenumber AS part, round(l_quantity + l_linenumber * 300.0::DOUBLE, 2) AS start, round(l_quantity + 1 + l_linenumber * 300.0::DOUBLE, 2) AS "end" FROM lineitem',
    "asof_backward": f"WITH {_S} SELECT p.user_id, p.event_id, o.event_id AS before FROM (SELECT * FROM s WHERE speaker = 'purchase') p ASOF LEFT JOIN (SELECT * FROM s WHERE speaker <> 'purchase') o ON p.user_id = o.user_id AND p.b >= o.b",
    "asof_forward": f"WITH {_S} SELECT p.user_id, p.event_id, o.event_id AS after_id FROM (SELECT * FROM s WHERE speaker = 'purchase') p ASOF LEFT JOIN (SELECT * FROM s WHERE speaker <> 'purchase') o ON p.user_id = o.user_id AND p.b < o.b",
    "alias_chain": """WITH RECURSIVE d AS (SELECT c_custkey AS ident, CASE WHEN c_custkey % 20 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 100 = 5 THEN c_custkey + 1 WHEN c_custkey % 100 = 6 THEN c_custkey - 1 WHEN c_custkey % 5 <> 0 THEN c_custkey - 1 END AS target, c_custkey % 10 = 0 AS ignored FROM customer),
        r AS (SELECT ident, ident AS at_id, 0 AS k FROM d UNION ALL SELECT r.ident, CASE WHEN d.target IS NOT NULL AND NOT d.ignored THEN d.target ELSE r.at_id END, k + 1 FROM r JOIN d ON d.ident = r.at_id WHERE k < 10)
        SELECT r.ident, CASE WHEN NOT d.ignored AND d.target IS NULL AND d.name <> '' THEN d.name END AS name, CASE WHEN d.ignored THEN 'ignored' WHEN d.target IS NOT NULL THEN 'cycle' WHEN d.name = '' THEN 'unresolved' ELSE 'named' END AS status
        FROM r JOIN d ON d.ident = r.at_id WHERE k = 10""",
    "new_documents": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 = 0)",
    "dup_by_hash": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "manifest_verify": "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 10 = 7 THEN 'changed' ELSE 'ok' END AS status FROM documents",
    "latest_orders": f"SELECT o_custkey, o_orderkey, o_orderstatus FROM {_LATEST} WHERE rn = 1",
    "latest_different": f"""WITH n AS (SELECT o_custkey, o_orderstatus AS now FROM {_LATEST} WHERE rn = 1)
        SELECT o_custkey, o_orderkey, o_orderstatus FROM orders JOIN n USING (o_custkey) WHERE o_orderstatus <> now QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "snapshot_names": """WITH n AS (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') || '_' || o_custkey || '_' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS f, row_number() OVER (PARTITION BY date_trunc('second', o_orderdate), o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)
        SELECT o_orderkey, CASE WHEN k = 0 THEN f ELSE f || '.' || k END AS file, epoch_us(date_trunc('second', o_orderdate)) AS taken FROM n""",
    "registry_upsert": "WITH c AS (SELECT c_nationkey AS k, c_custkey % 2 AS side, max(c_custkey) AS v, count(*) AS amount FROM customer GROUP BY 1, 2) SELECT k, arg_max(v, side) AS v, CAST(sum(amount) AS BIGINT) AS amount FROM c GROUP BY k",
    "draft_pairs": "SELECT 'informe ' || CAST(floor(d.doc_id / 3) AS BIGINT) AS key, d.doc_id, max(a.doc_id) AS approved_doc_id FROM documents d JOIN documents a ON d.doc_id % 3 = 0 AND a.doc_id IN (d.doc_id + 1, d.doc_id + 2) GROUP BY d.doc_id",
    "unpaired_drafts": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents a WHERE a.doc_id = d.doc_id + 1 AND a.source = d.source)",
    "status_pivot": f"SELECT * FROM {_PIVOT}",
    "workflow_phase": f"SELECT o_custkey, CASE WHEN n_f = 0 THEN 'draft' WHEN n_o > n_f THEN 'review' WHEN n_p > 0 THEN 'publish' ELSE 'archive' END AS phase FROM {_PIVOT}",
    "required_fields": "SELECT c_custkey, 'c_name' AS field, 'error' AS severity FROM customer WHERE c_custkey % 7 = 0 OR trim(coalesce(c_name, '')) = '' UNION ALL SELECT c_custkey, 'c_mktsegment', 'warning' FROM customer WHERE c_custkey % 11 = 0 OR trim(coalesce(c_mktsegment, '')) = ''",
    "domain_check": "SELECT o_orderkey, trim(o_orderpriority) AS value FROM orders WHERE trim(o_orderpriority) NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '')",
    "publication_gate": "WITH g AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_totalprice < 50000 THEN 'low' END, CASE WHEN starts_with(o_orderpriority, '1') THEN 'urgent' END) AS reasons FROM orders) SELECT o_orderkey, reasons, reasons = '' AS passes FROM g",
    "next_ids": "SELECT c_nationkey, coalesce(max(TRY_CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT)), 0) + 1 AS next FROM customer GROUP BY 1",
    "field_updates": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'APPROVED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "approvals": "WITH c AS (SELECT printf('C-%02d', CAST(regexp_extract(c_name, '(\\d+)$', 1) AS INTEGER)) AS ident FROM customer), s AS (SELECT ident, CASE WHEN ident IN ('C-03', 'C-07', 'C-40') THEN 'approved' ELSE 'proposed' END AS state FROM c) SELECT state, count(*) AS n, min(ident) AS first_id FROM s GROUP BY state",
    "annex_rows": """WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS p FROM documents), e AS (SELECT doc_id, p, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS k FROM p)
        SELECT doc_id, k, doc_id || '.' || k AS number, CASE WHEN k = 1 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS shown, md5(p[k]) AS digest FROM e""",
    "fair_share_budget": """WITH w AS (SELECT doc_id, source, n_chars AS size, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
          count(*) OVER (PARTITION BY source) - row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) + 1 AS rest FROM documents),
        q AS (SELECT *, floor((20000 - before) / rest) AS share FROM w), c AS (SELECT *, first_value(CASE WHEN size > share THEN share END IGNORE NULLS) OVER (PARTITION BY source ORDER BY size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cap FROM q)
        SELECT doc_id, source, CAST(CASE WHEN size <= share THEN size ELSE greatest(cap, 0) END AS BIGINT) AS quota FROM c""",
    "corpus_cut": "WITH w AS (SELECT doc_id, n_chars, 20000 - coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM documents) SELECT doc_id, CAST(least(n_chars, free) AS BIGINT) AS taken FROM w WHERE least(n_chars, free) > 0",
    "pages_fixed": "SELECT l_orderkey, l_linenumber, l_partkey, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) // 2 + 1 AS INTEGER) AS page FROM lineitem",
    "layout_bands": f"""WITH {_LAY}, n AS (SELECT *, CASE WHEN y0 >= max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM l),
        b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page ORDER BY y0, y1) AS BIGINT) AS band FROM n) SELECT page, band, count(*) AS n, min(y0) AS top, count(*) = 1 AS alone FROM b GROUP BY page, band""",
    "layout_columns": f"""WITH {_LAY}, n AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc ORDER BY x0) > 1 THEN 1 ELSE 0 END AS new FROM l),
        c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc ORDER BY x0) AS BIGINT) AS cluster FROM n) SELECT doc, cluster, count(*) AS n, min(x0) AS from_at, max(x0) AS to_at FROM c GROUP BY doc, cluster HAVING count(*) >= 3""",
    "layout_median": f"WITH {_LAY}, s AS (SELECT doc, size, sum(part % 13) AS w FROM l GROUP BY doc, size), u AS (SELECT doc, size, sum(w) OVER (PARTITION BY doc ORDER BY size) AS u, sum(w) OVER (PARTITION BY doc) AS t FROM s) SELECT doc, min(size) AS median FROM u WHERE u * 2 >= t GROUP BY doc",
    "pages_by_capacity": """WITH RECURSIVE l AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i FROM lineitem),
        p AS (SELECT l_orderkey, i, q AS used, 1 AS page FROM l WHERE i = 1
              UNION ALL SELECT l.l_orderkey, l.i, CASE WHEN p.used + l.q > 60 THEN l.q ELSE p.used + l.q END, CASE WHEN p.used + l.q > 60 THEN p.page + 1 ELSE p.page END FROM p JOIN l ON l.l_orderkey = p.l_orderkey AND l.i = p.i + 1)
        SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, CAST(max(page) AS INTEGER) AS pages FROM p GROUP BY l_orderkey""",
    "pages_of_long_lists": """WITH RECURSIVE r AS (SELECT l_linestatus AS g, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, row_number() OVER w AS i,
                coalesce(sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit
              FROM lineitem WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
        u AS (SELECT g, unit, sum(q) AS h, bool_or(q >= 3) AS filled FROM r GROUP BY g, unit),
        s AS (SELECT g, unit, h, CAST(sum(h) OVER (PARTITION BY g ORDER BY unit) AS BIGINT) AS stop, filled FROM u),
        k AS (SELECT g, unit, stop - h AS start, stop, min(CASE WHEN filled THEN unit END) OVER (PARTITION BY g ORDER BY unit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1 AS least FROM s),
        q AS (SELECT a.g, a.unit, a.least, b.unit AS over FROM (SELECT *, start + CASE WHEN unit = 0 THEN 2000 ELSE 1500 END AS room FROM k) a ASOF JOIN k b ON a.g = b.g AND a.room < b.stop),
        n AS MATERIALIZED (SELECT g, unit, greatest(over, least) AS nxt FROM q WHERE least IS NOT NULL),
        c AS (SELECT g, CAST(0 AS HUGEINT) AS unit, 1 AS page FROM (SELECT DISTINCT g FROM u) UNION ALL SELECT n.g, n.nxt, c.page + 1 FROM c JOIN n ON n.g = c.g AND n.unit = c.unit JOIN u ON u.g = n.g AND u.unit = n.nxt)
        SELECT l_linestatus, CAST(page AS INTEGER) AS page, count(*) AS n, CAST(sum(q) AS BIGINT) AS pieces, min(l_orderkey) AS from_order
        FROM (SELECT r.g AS l_linestatus, r.q, r.l_orderkey, c.page FROM r ASOF JOIN c ON r.g = c.g AND r.unit >= c.unit) GROUP BY l_linestatus, page""",
    "layout_headers": f"WITH {_LAY}, a AS (SELECT doc, count(DISTINCT page) AS n FROM l GROUP BY doc) SELECT doc, text, count(DISTINCT page) AS pages FROM l JOIN a USING (doc) GROUP BY doc, text, n HAVING count(DISTINCT page) >= 2 AND count(DISTINCT page) > 0.6 * n",
    "layout_levels": f"""WITH {_LAY}, s AS (SELECT doc, size, count(*) AS w FROM l GROUP BY doc, size), u AS (SELECT doc, size, sum(w) OVER (PARTITION BY doc ORDER BY size) AS u, sum(w) OVER (PARTITION BY doc) AS t FROM s), m AS (SELECT doc, min(size) AS median FROM u WHERE u * 2 >= t GROUP BY doc),
        d AS (SELECT DISTINCT doc, size FROM l JOIN m USING (doc) WHERE size > median) SELECT doc, CAST(size AS DOUBLE) AS size, CAST(level AS INTEGER) AS level FROM (SELECT doc, size, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC) AS level FROM d) WHERE level <= 4""",
    "layout_outside": f"WITH {_LAY} SELECT page, line, part FROM l WHERE line > 1 AND NOT EXISTS (SELECT 1 FROM l AS t WHERE t.line = 1 AND t.page = l.page AND l.x0 < t.x1 AND l.x1 > t.x0 AND l.y0 < t.y1 AND l.y1 > t.y0)",
    "scalar_labels": """SELECT o_orderkey, printf('%02d:%02d', CAST(floor(floor(o_totalprice) / 60) AS BIGINT), CAST(floor(o_totalprice) AS BIGINT) % 60) AS clock, replace(printf('%,d', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') AS thousands, printf('C-%02d', o_custkey) AS code,
        trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CAST(round_even(o_orderkey / 2, 0) AS BIGINT) AS half_even, least(greatest(o_totalprice / 100000, 0.5), 0.98) AS clamped,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y') AS year FROM orders""",
    "portfolio": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS closed, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
    "searched": "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') AND c_acctbal >= 0",
}

QUERIES = {
    f.__name__: f
    for f in (
        speaker_islands, speaker_seconds, first_appearance_ids, relevant_speakers, interval_overlap_anti, best_runs, top_voices, part_offsets, asof_backward, asof_forward, alias_chain, new_documents, dup_by_hash, manifest_verify,
        latest_orders, latest_different, snapshot_names, registry_upsert, draft_pairs, unpaired_drafts, status_pivot, workflow_phase, required_fields, domain_check, publication_gate, next_ids, field_updates, approvals, annex_rows,
        fair_share_budget, corpus_cut, pages_fixed, pages_by_capacity, pages_of_long_lists, layout_bands, layout_columns, layout_median, layout_headers, layout_levels, layout_outside, scalar_labels, portfolio, searched,
    )
}

"""Registered queries over ordered rows: context, runs, highlights, merges, maps, set operations and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import sequences


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_examples(spark, sf_dir):
    return sequences.first_k(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 3)


def folded_context(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select((F.floor(F.col("l_orderkey") / 16)).alias("doc"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("line"), "l_quantity")
    unique = li.groupBy("doc", "line").agg(F.max("l_quantity").alias("q"))
    return sequences.with_context(unique, "doc", "line", F.col("q") > 48).select("doc", "line", "folded")


def merged_headings(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", F.col("l_partkey").cast("string").alias("text"))
    return sequences.merged_runs(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_returnflag"], "text").select("l_orderkey", F.col("run").cast("long").alias("run"), "l_returnflag", "n", "text")


def highlight_spans(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 50).cast("long")
    spans = li.select("l_orderkey", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    return sequences.highlights(spans, "l_orderkey")


def rule_merge(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    old, new = c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 3 <> 1").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")))
    return sequences.keyed_merge(old, new, "c_nationkey", "c_mktsegment", "c_custkey")


def inbox(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Inbox\n--- "), "text").alias("text"))
    return d.select("doc_id", F.md5(sequences.after_mark(F.col("text"))).alias("digest"))


def forgotten(spark, sf_dir):
    """Customers none of whose order numbers is a multiple of seven."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderkey").alias("keys"))
    return o.where(~F.exists("keys", lambda x: x % 7 == 0)).select("o_custkey", F.size("keys").cast("long").alias("n"))


def set_operations(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    one = lambda name, df: df.agg(F.count("*").alias("n"), F.sum("k").alias("total")).withColumn("operation", F.lit(name))
    out = one("union all", o.unionByName(c))
    for name, df in (("union", o.unionByName(c).distinct()), ("intersect", o.intersect(c)), ("except", c.exceptAll(o.distinct())), ("distinct", o.distinct())):
        out = out.unionByName(one(name, df))
    return out.select("operation", "n", F.coalesce("total", F.lit(0)).alias("total"))


def map_merge(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("old"), F.create_map(F.lit("type"), F.lower("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("new"))
    # the right side wins; keys of the left that it lacks stay
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key("new", k)), "new")
    return p.select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("entries"))


def json_fields(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long").getField("k").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("json"))


def order_ages(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", sequences.age(F.to_date("o_orderdate"), F.to_date(F.lit("1998-08-02"))).alias("age"))


def trace_listing(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.where(F.from_json("props", "k long").getField("k").isNotNull()).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


_FOLD = "q AS (SELECT CAST(floor(l_orderkey / 16) AS BIGINT) AS doc, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS line, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"

ORACLES = {
    "first_examples": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3",
    "folded_context": f"""WITH {_FOLD}, m AS (SELECT *, row_number() OVER w AS n, max(CASE WHEN q > 48 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM q WINDOW w AS (PARTITION BY doc ORDER BY line))
        SELECT doc, line, n - coalesce(lag(n) OVER (PARTITION BY doc ORDER BY line), 0) - 1 AS folded FROM m WHERE near = 1""",
    "merged_headings": """WITH n AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w <> l_returnflag THEN 1 ELSE 0 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
        r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS run FROM n)
        SELECT l_orderkey, run, l_returnflag, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM r GROUP BY l_orderkey, run, l_returnflag""",
    "highlight_spans": """WITH RECURSIVE s AS (SELECT l_orderkey, CAST(l_partkey % 50 AS BIGINT) AS b, CAST(l_partkey % 50 AS BIGINT) + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
        o AS (SELECT l_orderkey, b, e, row_number() OVER (PARTITION BY l_orderkey ORDER BY b, e DESC) AS n FROM (SELECT DISTINCT * FROM s)),
        k AS (SELECT l_orderkey, n, b, e, e AS upto, TRUE AS kept FROM o WHERE n = 1
              UNION ALL SELECT o.l_orderkey, o.n, o.b, o.e, CASE WHEN o.b >= k.upto THEN o.e ELSE k.upto END, o.b >= k.upto FROM k JOIN o ON o.l_orderkey = k.l_orderkey AND o.n = k.n + 1)
        SELECT l_orderkey, b AS start, e AS "end" FROM k WHERE kept""",
    "rule_merge": """WITH a AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth, c_mktsegment AS old FROM customer WHERE c_custkey % 3 <> 0),
        b AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS new FROM customer WHERE c_custkey % 3 <> 1)
        SELECT c_nationkey, CAST(nth AS INTEGER) AS nth, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'kept' ELSE 'changed' END AS change FROM a FULL JOIN b USING (c_nationkey, nth)""",
    "inbox": "SELECT doc_id, md5(trim(text)) AS digest FROM documents",
    "forgotten": "SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING NOT bool_or(o_orderkey % 7 = 0)",
    "set_operations": """WITH o AS (SELECT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer), u AS (
          SELECT 'union all' AS operation, k FROM (SELECT k FROM o UNION ALL SELECT k FROM c) UNION ALL SELECT 'union', k FROM (SELECT k FROM o UNION SELECT k FROM c) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM o INTERSECT SELECT k FROM c)
          UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM o) UNION ALL SELECT 'distinct', k FROM (SELECT DISTINCT k FROM o))
        SELECT v.operation, count(k) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM (VALUES ('union all'), ('union'), ('intersect'), ('except'), ('distinct')) AS v(operation) LEFT JOIN u USING (operation) GROUP BY 1""",
    "map_merge": "SELECT p_partkey, 'brand=' || p_brand || ';size=' || p_size || ';type=' || lower(p_type) AS entries FROM part",
    "json_fields": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events""",
    "order_ages": "WITH d AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS n FROM orders) SELECT o_orderkey, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN 'this week' WHEN n < 31 THEN 'this month' ELSE 'older' END AS age FROM d",
    "trace_listing": "SELECT event_id, event_type FROM events WHERE json_extract(props, '$.k') IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 50",
}

QUERIES = {f.__name__: f for f in (first_examples, folded_context, merged_headings, highlight_spans, rule_merge, inbox, forgotten, set_operations, map_merge, json_fields, order_ages, trace_listing)}

"""Structured findings: flags, gates, states and the workflow's next step, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def proposed(level: Column, supported: Column) -> Column:
    """A risk level that no evidence supports is proposed."""
    return (F.coalesce(F.trim(level), F.lit("")) != "") & ~F.coalesce(supported, F.lit(False))


def gate(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """rows with column reasons: all that block a row; an empty array lets it pass."""
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in reasons.items()))))


def pivot_states(rows: DataFrame, key: str, state: str, states: list[str]) -> DataFrame:
    """(key, n, a count for each state)."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in states))


def next_id(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, next): one more than the greatest number that ends an id; 1 without any."""
    return rows.groupBy(key).agg((F.coalesce(F.max(F.expr(f"try_cast(regexp_extract({ident}, '(\\\\d+)$', 1) AS BIGINT)")), F.lit(0)) + 1).alias("next"))


def updated(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the changes' values where they aren't null; only the named fields change."""
    new = changes.select(F.col(key).alias("_k"), *(F.col(f).alias("_" + f) for f in fields))
    out = rows.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*(F.coalesce(F.col("_" + c), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def with_state(rows: DataFrame, ids: list[str] | None, ident: str, state: str, to: str) -> DataFrame:
    """rows with the state of the ids set; None is all of them."""
    return rows.withColumn(state, F.lit(to) if ids is None else F.when(F.col(ident).isin(ids), F.lit(to)).otherwise(F.col(state)))


def phase(steps: list[tuple[str, Column]], last: str) -> Column:
    """The first step whose condition holds, else the last."""
    out = F.lit(last)
    for name, cond in reversed(steps):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def annex(rows: DataFrame, ident: str, text: Column) -> DataFrame:
    """A row for each paragraph of ``text``, numbered N.k; the id is shown only in the first."""
    parts = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    each = rows.select(ident, F.posexplode(parts).alias("_k", "part"))
    return each.select(ident, (F.col("_k") + 1).alias("k"), F.concat_ws(".", F.col(ident).cast("string"), (F.col("_k") + 1).cast("string")).alias("number"), F.when(F.col("_k") == 0, F.col(ident).cast("string")).otherwise("").alias("shown"), "part")


def applied(plan: DataFrame, key: str, state: str) -> DataFrame:
    """(key, done, conflicts, total, summary) of the changes of a plan by their states."""
    n = plan.groupBy(key).agg(F.count_if(F.col(state).rlike("^(aplicado|insertado|eliminado)")).alias("done"), F.count_if(F.col(state).startswith("conflicto")).alias("conflicts"), F.count("*").alias("total"))
    return n.withColumn("summary", F.format_string("Aplicados %d de %d cambios en el informe", "done", "total"))


def by_paragraph(found: DataFrame, keys: list[str], order: str, message: str) -> DataFrame:
    """(keys, n, messages in order): all findings of a paragraph as one row, for one rewriting of it."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(message).alias("m"))))
    return found.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(rows, lambda x: x["m"]).alias("messages"))


def out_of_range(chosen: DataFrame, totals: DataFrame, key: str, index: str, total: str) -> DataFrame:
    """Chosen rows whose index, from zero, isn't below the total of their key, or whose key has none."""
    own = totals.select(F.col(key).alias("_k"), F.col(total).alias("_n"))
    each = chosen.join(own, F.col(key) == F.col("_k"), "left")
    return each.where(F.col("_n").isNull() | (F.col(index) < 0) | (F.col(index) >= F.col("_n"))).select(*chosen.columns)


def numbered_tests(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, code, title) of lines «2.11. TITLE IN CAPITALS»; a code's first title counts."""
    line = F.col("_line")
    pattern = r"^\s*(\d{1,2}\.\d{1,2})\.?\s+([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ0-9 ,/()\-–—:]{10,})\s*$"
    each = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_pos", "_line")).where(line.rlike(pattern))
    cut = each.select(key, "_pos", F.regexp_extract(line, pattern, 1).alias("code"), F.trim(F.regexp_extract(line, pattern, 2)).alias("title"))
    return cut.groupBy(key, "code").agg(F.min_by("title", "_pos").alias("title"))

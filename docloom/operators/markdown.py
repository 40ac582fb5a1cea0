"""Findings as Markdown and back: blocks under headings, labelled fields, and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import segment

LABEL = r"^\s*(?:[-*]\s+)?\*\*([^*:]+):\*\*\s*(.*)$"


def parse_findings(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, block, title, fields map): each «## title» block's fields by normalised label.

    A field's value runs over lines to the next label or heading; quoted lines are left out. Two windows over a
    document's lines carry the block and the label forward; nothing else is gathered.
    """
    own = segment.sections(segment.lines(docs, id_col, text_col), id_col, F.col("text").startswith("## ")).where("section > 0")
    body = own.where(~F.col("text").startswith("## ") & ~F.ltrim("text").startswith(">"))
    label = F.regexp_extract("text", LABEL, 1)
    w = Window.partitionBy(id_col, "section").orderBy("line")
    tagged = body.withColumn("field", F.last(F.when(label != "", X.field_key(label)), ignorenulls=True).over(w)).withColumn("value", F.when(label != "", F.regexp_extract("text", LABEL, 2)).otherwise(F.col("text")))
    values = tagged.where("field is not null").groupBy(id_col, "section", "field").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("v"))
    joined = values.withColumn("value", X.strip(F.array_join(F.transform("v", lambda x: x["value"]), "\n")))
    fields = joined.groupBy(id_col, "section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    titles = own.where(F.col("text").startswith("## ")).select(id_col, "section", X.strip(F.expr("substring(text, 4)")).alias("title"))
    empty = F.create_map().cast("map<string,string>")
    return titles.join(fields, [id_col, "section"], "left").select(id_col, F.col("section").alias("block"), "title", F.coalesce("fields", empty).alias("fields"))


def render_findings(findings: DataFrame, id_col: str, labels: dict[str, str]) -> DataFrame:
    """(id, text): blocks in order, their fields in the order of ``labels`` (field -> label); empty fields are left out."""
    lines = F.array_compact(F.array(*(F.when(F.coalesce(F.col("fields")[f], F.lit("")) != "", F.concat(F.lit(f"**{name}:** "), F.col("fields")[f])) for f, name in labels.items())))
    block = F.concat(F.lit("## "), "title", F.lit("\n\n"), F.array_join(lines, "\n\n"), F.lit("\n"))
    return findings.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("block", block.alias("t")))).alias("b")).select(id_col, F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("text"))


def table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table: the first is the header, short ones are filled up, pipes escaped."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\s*\n\s*", " ")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width.cast("int")))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0])), F.array(rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")).otherwise("")


def compact_sheet(cells: DataFrame, sheet: str, row: str = "row", col: str = "col", value: str = "value", most: int = 40) -> DataFrame:
    """(sheet, row, kind, cells): a sheet's rows without empty columns; rows of one cell are paragraphs, at most ``most``
    of the others are kept and the number left out is given in the last row."""
    full = cells.where(F.trim(F.coalesce(value, F.lit(""))) != "")
    rows = full.groupBy(sheet, row).agg(F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), F.col(value).alias("v")))).alias("x"))
    typed = rows.select(sheet, row, F.when(F.size("x") <= 1, "paragraph").otherwise("data").alias("kind"), F.transform("x", lambda x: x["v"]).alias("cells"))
    n = F.count_if(F.col("kind") == "data").over(Window.partitionBy(sheet).orderBy(row))
    numbered = typed.withColumn("_n", n)
    left_out = numbered.where((F.col("kind") == "data") & (F.col("_n") > most)).groupBy(sheet).agg(F.max(row).alias(row), F.count("*").alias("_o"))
    note = left_out.select(sheet, row, F.lit("omitted").alias("kind"), F.array(X.thousands(F.col("_o"))).alias("cells"))
    return numbered.where((F.col("kind") == "paragraph") | (F.col("_n") <= most)).drop("_n").unionByName(note)

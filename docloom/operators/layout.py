"""Page layout over tables of text lines: bands, columns, statistics of type sizes, headers and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import running


def bands(lines: DataFrame, page: str | list[str], low: str, high: str, out: str = "band") -> DataFrame:
    """lines with a band number: lines whose extents overlap, directly or through others, share one."""
    return _banded(running.spread(lines, page), page, low, high, out)


def _banded(lines: DataFrame, page: str | list[str], low: str, high: str, out: str) -> DataFrame:
    w = Window.partitionBy(page).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("_new", F.coalesce((F.col(low) >= reach).cast("int"), F.lit(0))).withColumn(out, F.sum("_new").over(w)).drop("_new")


def clusters(lines: DataFrame, page: str, at: str, tolerance: float = 8, least: int = 3) -> DataFrame:
    """(page, cluster, n, from, to): places at most ``tolerance`` from the next, where at least ``least`` lines stand."""
    w = Window.partitionBy(page).orderBy(at)
    rows = lines.withColumn("_new", F.coalesce((F.col(at) - F.lag(at).over(w) > tolerance).cast("int"), F.lit(0))).withColumn("cluster", F.sum("_new").over(w))
    return rows.groupBy(page, "cluster").agg(F.count("*").alias("n"), F.min(at).alias("from_at"), F.max(at).alias("to_at")).where(F.col("n") >= least)


def weighted_median(lines: DataFrame, doc: str, value: str, weight: str) -> DataFrame:
    """(doc, median): the least value up to which at least half of the weight lies. Values are summed first."""
    sums = lines.groupBy(doc, value).agg(F.sum(weight).alias("_w"))
    total = F.sum("_w").over(Window.partitionBy(doc))
    upto = F.sum("_w").over(Window.partitionBy(doc).orderBy(value))
    return sums.withColumn("_half", upto * 2 >= total).where("_half").groupBy(doc).agg(F.min(value).alias("median"))


def repeated_texts(lines: DataFrame, doc: str, page: str, text: str, share: float = 0.6) -> DataFrame:
    """(doc, text, pages): texts on at least two pages and more than ``share`` of a document's pages: headers, footers."""
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("_all"))
    n = lines.groupBy(doc, text).agg(F.countDistinct(page).alias("pages"))
    return n.join(pages, doc).where((F.col("pages") >= 2) & (F.col("pages") > share * F.col("_all"))).drop("_all")


def size_levels(lines: DataFrame, doc: str, size: str, body: DataFrame, levels: int = 4) -> DataFrame:
    """(doc, size, level): the greatest sizes, to halves, above the body's median; level 1 is the greatest."""
    sizes = lines.select(doc, (F.bround(F.col(size) * 2) / 2).alias("size")).distinct().join(body, doc).where("size > median")
    return sizes.withColumn("level", F.dense_rank().over(Window.partitionBy(doc).orderBy(F.desc("size")))).where(F.col("level") <= levels).select(doc, "size", "level")


def heading_kind(text: Column, size: Column, median: Column, bold: Column) -> Column:
    """numbered, large, bold or body: mostly numeric text is never a heading."""
    digits = F.regexp_count(text, F.lit(r"[0-9]"))
    return (
        F.when(digits * 2 > F.length(F.regexp_replace(text, r"\s", "")), "body")
        .when(text.rlike(r"^\d+(\.\d+)*\.?\s+\p{L}"), "numbered")
        .when(size >= 1.15 * median, "large")
        .when((size >= 1.02 * median) & bold, "bold")
        .otherwise("body")
    )


def outside(lines: DataFrame, tables: DataFrame, page: str) -> DataFrame:
    """Lines whose rectangle meets no table's on their page: an anti-join on the page with overlap in both directions."""
    own = tables.select(F.col(page).alias("_p"), *(F.col(c).alias("_" + c) for c in ("x0", "x1", "y0", "y1")))
    return lines.join(own, F.expr(f"{page} = _p and x0 < _x1 and x1 > _x0 and y0 < _y1 and y1 > _y0"), "left_anti")


def alone(lines: DataFrame, page: str, band: str, order: list[str] | None = None) -> DataFrame:
    """lines with column alone: whether nothing else stands in their band. In an order in which bands follow each other, only neighbours are looked at and nothing is sorted anew."""
    if order:
        w = Window.partitionBy(page).orderBy(*order)
        same = [F.coalesce(f(band).over(w) == F.col(band), F.lit(False)) for f in (F.lag, F.lead)]
        return lines.withColumn("alone", ~same[0] & ~same[1])
    return lines.withColumn("alone", F.count("*").over(Window.partitionBy(page, band)) == 1)


def line_style(spans: DataFrame, keys: list[str], text: str = "text", size: str = "size", bold: str = "bold") -> DataFrame:
    """(keys, size, bold) of lines: sizes weighed by characters, bold if half of the characters are. Empty spans don't count."""
    n = F.length(text)
    total = F.sum(n)
    out = spans.groupBy(*keys).agg((F.sum(F.col(size) * n) / F.nullif(total, F.lit(0))).alias("_s"), (F.sum(F.when(F.col(bold), n).otherwise(0)) * 2 >= total).alias("_b"), total.alias("_n"))
    return out.select(*keys, F.coalesce("_s", F.lit(0.0)).alias("size"), ((F.col("_n") > 0) & F.col("_b")).alias("bold"))


def real_table(chars: Column, area: Column, least: int = 20, density: float = 0.0003) -> Column:
    """Whether a detected table holds enough text, in all and for its area."""
    return (chars >= least) & ((area <= 0) | (chars >= density * area))


def real_image(width: Column, height: Column, least: float = 40) -> Column:
    """Whether an image is more than an icon or a rule."""
    return (width >= least) & (height >= least)


def separator_before(lines: DataFrame, page: str, order: str, text: str = "text") -> DataFrame:
    """lines with column before: what follows the number of the line before on the page; null if that has no number."""
    own = F.nullif(F.regexp_extract(F.trim(text), r"^\d+(?:\.\d+)*([.)\-])", 1), F.lit(""))
    return lines.withColumn("before", F.lag(own).over(Window.partitionBy(page).orderBy(order)))


# Fixed values of column detection: longest marker, marks of lists.
MARKER_LENGTH, BULLETS = 15, ("•", "-", "*", "▪", "◦", "‣", "·", "●", "○")


def is_marker(text: Column) -> Column:
    """Whether a text is only a list mark or a short number with a stop or bracket after it."""
    own = F.regexp_replace(text, r"^\s+|\s+$", "")
    numbered = F.regexp_like(F.concat(own, F.lit(" x")), F.lit(r"^\d+(\.\d+){0,3}[.)]\s+\S"))
    return (F.length(own) < MARKER_LENGTH) & (own.isin(*BULLETS) | numbered)


def reading_order(lines: DataFrame, page: str, ident: str, text: str = "text", gap: float = 8, tolerance: float = 8, least: int = 3) -> DataFrame:
    """(page, ident, band, column from 0, place from 1, breaks) of lines with x0, x1, y0, y1: where columns are confirmed, each is read before the next.

    Lines whose heights overlap are a band; in it, those whose widths overlap are a piece. A piece may begin a column if
    ``gap`` lies between it and the one before, which isn't a mere marker. The page votes: pieces with content that may begin one are
    gathered by their left edges, and only an edge where ``least`` of them stand, each within ``tolerance`` of the next,
    confirms. breaks holds for the first line of every column but the first, and of a band after one of several columns.
    ``ident`` tells lines of a page apart. Everything is a window or an aggregate within a page; pages of any number are spread, once.
    """
    cut = _banded(_banded(running.spread(lines, page), page, "y0", "y1", "band"), [page, "band"], "x0", "x1", "piece")
    told = F.array_sort(F.collect_list(F.struct("x0", F.col(ident).alias("i"), F.coalesce(text, F.lit("")).alias("t"), "y0")))
    pieces = cut.groupBy(page, "band", "piece").agg(F.min("x0").alias("left"), F.max("x1").alias("right"), told.alias("told"))
    w = Window.partitionBy(page, "band").orderBy("piece")
    words = F.array_join(F.transform("told", lambda x: x["t"]), " ")
    parted = F.coalesce((F.col("left") - F.lag("right").over(w) >= gap) & ~is_marker(F.lag(words).over(w)), F.lit(False))
    candidates = pieces.select(page, "band", "piece", "left", parted.alias("parted"), (~X.contentless(F.col("told")[0]["t"])).alias("votes"), "told")
    # a page's edges are one row, so that nothing but the page is joined on and pages stay where they are
    edges = clusters(candidates.where("parted and votes"), page, "left", tolerance, least).groupBy(page).agg(F.collect_list(F.struct("from_at", "to_at")).alias("edges"))
    agreed = F.col("parted") & F.coalesce(F.exists("edges", lambda e: F.col("left").between(e["from_at"] - tolerance, e["to_at"] + tolerance)), F.lit(False))
    columns = candidates.join(edges, page, "left").withColumn("confirmed", agreed.cast("int")).withColumn("column", F.sum("confirmed").over(w).cast("int"))
    placed = columns.select(page, "band", "column", F.explode("told").alias("l")).select(page, F.col("l.i").alias(ident), "band", "column", "l.x0", "l.y0")
    down = Window.partitionBy(page).orderBy("band", "column", "y0", "x0", ident)
    first = F.row_number().over(Window.partitionBy(page, "band", "column").orderBy("y0", "x0", ident)) == 1
    several = placed.withColumns({"first": first, "several": F.max("column").over(Window.partitionBy(page, "band")) > 0, "place": F.row_number().over(down)})
    after = F.lag("several").over(down) & (F.lag("band").over(down) != F.col("band"))
    return several.select(page, ident, "band", "column", "place", ((F.col("first") & (F.col("column") > 0)) | F.coalesce(after, F.lit(False))).alias("breaks"))

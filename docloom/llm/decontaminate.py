"""Benchmark decontamination with DataFrame functions only: windows of benchmark words, looked up in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

#: Bytes of benchmark windows and their items that are broadcast at most; more are joined by shuffle, with the same rows.
MOST_BROADCAST = 64 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything up to \x7F that no word holds, after lower-casing.
_BETWEEN = "".join(chr(i) for i in range(128) if not (chr(i).isdigit() or "a" <= chr(i).lower() <= "z"))


def words(text: Column) -> Column:
    """The words of a text: runs of digits, ASCII letters (lower-cased) and whatever is beyond ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def benchmark_windows(benchmark: DataFrame, n: int = 13, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram array of words, items array): each window of n words, or the whole of a shorter item, and whose it is."""
    own = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    each = own.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.slice(F.col("w"), i + 1, n))).alias("gram"))
    return each.groupBy("gram").agg(F.collect_set("item").alias("items"))


def _covered(spots: Column) -> Column:
    """How many words the sorted (start, length) spots cover."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(acc["to"], x["at"]))).cast("long").alias("n"),
        F.greatest(acc["to"], x["at"] + x["len"]).cast("int").alias("to"),
    )
    return F.aggregate(F.array_sort(spots), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])


def _key(w: Column, at: Column | int, k: int) -> Column:
    """A hash of four words spread over the window of k words at ``at``: found quickly, verified later."""
    return F.xxhash64(*(w[at + i] for i in sorted({0, k // 3, 2 * k // 3, k - 1})))


def _places(k: int) -> Column:
    """The keys of all windows of k words of column w, in order."""
    starts = F.when(F.size("w") >= k, F.sequence(F.lit(0), F.size("w") - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _key(F.col("w"), i, k))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items): words inside any occurrence of a benchmark window, and the items they are from.

    Windows are looked up by a hash of four of their words and verified word for word. Every row gives one row, judged
    by its own text: rows with a null id and rows that share an id too. Null and empty texts have no words and no hits;
    an empty benchmark hits nothing; an empty table gives an empty one; other columns aren't read.
    """
    return _scanned(docs, benchmark, n, F.col(id_col), text_col).withColumnRenamed("id", id_col)


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, carried: Column, text_col: str) -> DataFrame:
    """As scan, with column id as ``carried`` says."""
    grams = benchmark_windows(benchmark, n).withColumn("k", F.size("gram"))
    key = F.lit(None).cast("long")
    for k in range(1, n + 1):
        key = F.when(F.col("k") == k, _key(F.col("gram"), 0, k)).otherwise(key)
    known = grams.select("gram", "items", "k", key.alias("h"))
    known = known.persist()
    try:
        sizes = [r[0] for r in known.select("k").distinct().orderBy("k").collect()]  # at most n numbers
        # 60 for a row's numbers, 20 for each array element, and the characters
        of = lambda c: F.size(c) * 20 + F.length(F.concat_ws("", c))
        size = known.agg(F.sum(60 + of("gram").cast("long") + of("items"))).first()[0] or 0
        small = size <= MOST_BROADCAST
    finally:
        known.unpersist()
    # a row's number is the same whenever its partition is read again
    source = docs.select(carried.alias("id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("w"))
    # an entry of no words stands for the document itself, whether anything hits or not
    sets = [F.struct(F.lit(0).alias("k"), F.array(F.lit(0).cast("long")).alias("h")), *(F.struct(F.lit(k).alias("k"), _places(k).alias("h")) for k in sizes)]
    each = source.select("id", "row", "w", F.explode(F.array(*sets)).alias("s")).select("id", "row", "w", "s.k", F.posexplode("s.h").alias("at", "h"))
    gram = "slice(d.w, d.at + 1, d.k)"
    if not small:  # a shuffle would copy all of a document's words with each window; it gets the window's own
        each, gram = each.select("id", "row", "k", "at", "h", F.expr("slice(w, at + 1, k)").alias("g"), F.when(F.col("k") == 0, F.size("w")).alias("n")), "d.g"
    else:
        each = each.withColumn("n", F.when(F.col("k") == 0, F.size("w")))
    side = F.broadcast(known) if small else known
    # two inequalities, as an equality of words would be part of the join's key and be made for every window
    same = f"d.h = b.h and d.k = b.k and {gram} <= b.gram and {gram} >= b.gram"
    met = each.alias("d").join(side.alias("b"), F.expr(same), "left").where("d.k = 0 or b.h is not null")
    hits = met.select("d.id", "d.row", "d.n", F.when(F.col("d.k") > 0, F.struct("d.at", F.col("d.k").alias("len"))).alias("spot"), "b.items")
    each = hits.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n").cast("long").alias("n_words"),
        _covered(F.collect_set("spot")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return each.drop("row")


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """Hit at all, and in at least a twentieth of its words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns.

    Each row is judged by its own text, rows that share an id too. Rows with a null id are kept, and so are null and
    empty texts; an empty table gives an empty one.
    """
    text = F.xxhash64(F.col(text_col))
    found = _scanned(docs.where(F.col(id_col).isNotNull()), benchmark, n, F.struct(F.col(id_col).alias("own"), text.alias("text")), text_col)
    # written first, so that its size is known when the join is planned
    own, hashed = free_name(docs.columns, "__bad"), free_name(docs.columns, "__bad_text")
    bad = stored(found.where(contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("id.own").alias(own), F.col("id.text").alias(hashed)), "contaminated")
    return docs.join(bad, (F.col(id_col) == F.col(own)) & (text == F.col(hashed)), "left_anti")

"""Documents to numbered lines, paragraphs, sentences and sections, each a row with its ordinal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X


def lines(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line from 1, text)."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "text")).select(id_col, (F.col("line") + 1).alias("line"), "text")


def _paragraphs(text: str | None) -> list[dict]:
    out: list[tuple[int, list[str]]] = []
    cut = True
    for n, line in enumerate(text.split("\n") if text is not None else (), 1):
        if not line.strip():
            cut = True
        elif not line.lstrip().startswith(">"):
            if cut:
                out.append((n, []))
            out[-1][1].append(line)
            cut = False
    return [{"line": n, "text": "\n".join(own)} for n, own in out]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())])))
def _cut(texts: pd.Series) -> pd.Series:
    return pd.Series([_paragraphs(t) for t in texts])


def paragraphs(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line, text): stretches of lines between blank ones, with the number of the first; quoted lines left out.

    Built within each row, so no shuffle, in time with its length.
    """
    return docs.select(id_col, F.explode(_cut(text_col)).alias("p")).select(id_col, "p.line", "p.text")


def sentences(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, sent_no from 0, text, n_words)."""
    each = docs.select(id_col, F.posexplode(X.sentences(F.col(text_col))).alias("sent_no", "text"))
    return each.withColumn("n_words", X.n_words(F.col("text")))


def sections(rows: DataFrame, id_col: str, is_heading: Column, closes: Column | None = None, line_col: str = "line") -> DataFrame:
    """Lines with the heading they stand under and its number: the last heading, none after a line that closes.

    One window for each document; section 0 is what precedes the first heading.
    """
    w = Window.partitionBy(id_col).orderBy(line_col)
    closing = F.lit(False) if closes is None else closes
    mark = F.when(is_heading, F.struct(F.col("text").alias("heading"), F.lit(True).alias("open"))).when(closing, F.struct(F.lit(None).cast("string").alias("heading"), F.lit(False).alias("open")))
    return (
        rows.withColumn("section", F.count_if(is_heading).over(w))
        .withColumn("_m", F.last(mark, ignorenulls=True).over(w))
        .withColumn("heading", F.col("_m.heading"))
        .drop("_m")
    )


def ordinals(rows: DataFrame, id_col: str, group_col: str, flag: Column, line_col: str = "line") -> DataFrame:
    """A running number of flagged lines that starts anew in each group."""
    return rows.withColumn("ordinal", F.count_if(flag).over(Window.partitionBy(id_col, group_col).orderBy(line_col)))

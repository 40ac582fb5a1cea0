"""Edit scripts between two sequences, and unified differences of texts.

Elements that stand once on either side and keep their order are fixed first; what lies between two of them is aligned by a
longest common subsequence. That is found with a row of the table as one long integer and by halving the rows, so space is
linear and each row costs a few operations on whole integers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.batches import bounded

_OPERATIONS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("text", T.StringType())]))

Pairs = list[tuple[int, int]]


def rising(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience: of equally long ones the one whose last value,
    then the value before, and so on, is least among those that stand there."""
    tops, at, before = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        tops[pile:], at[pile:] = [v, *tops[pile + 1 :]], [i, *at[pile + 1 :]]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _common_lengths(rows: Sequence[Hashable], cols: Sequence[Hashable]) -> np.ndarray:
    """Length of the longest common subsequence of ``rows`` with each prefix of ``cols``: a zero bit for each place where it grows."""
    masks: dict[Hashable, int] = {}
    for j, x in enumerate(cols):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(cols)) - 1
    v = full
    for x in rows:
        if m := masks.get(x):
            u = v & m
            v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(cols) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(cols)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def longest_common(a: Sequence[Hashable], b: Sequence[Hashable]) -> Pairs:
    """Places (i, j) of a longest common subsequence, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        if n - i == 1:
            hit = next((k for k in range(j, m) if b[k] == a[i]), None)
            out += [] if hit is None else [(i, hit)]
            continue
        half = (i + n) // 2
        sums = _common_lengths(a[i:half], b[j:m]) + _common_lengths(a[half:n][::-1], b[j:m][::-1])[::-1]
        cut = j + int(sums.argmax())
        todo += [(i, half, j, cut), (half, n, cut, m)]
    return sorted(out)


def aligned(a: Sequence[Hashable], b: Sequence[Hashable]) -> Pairs:
    """Places (i, j) of equal elements, in order on both sides: unique ones first, a longest common subsequence between them."""
    in_a, in_b, where = Counter(a), Counter(b), {x: j for j, x in enumerate(b)}
    unique = [(i, where[x]) for i, x in enumerate(a) if in_a[x] == 1 == in_b.get(x)]
    fixed = [unique[k] for k in rising([j for _, j in unique])]
    out, i, j = [], 0, 0
    for n, m in [*fixed, (len(a), len(b))]:
        out += [(i + x, j + y) for x, y in longest_common(a[i:n], b[j:m])]
        out.append((n, m))
        i, j = n + 1, m + 1
    return out[:-1]


def stretches(pairs: Pairs, n: int, m: int) -> Iterator[tuple[bool, int, int, int, int]]:
    """(equal, i, i2, j, j2): the two sequences cut into what stays and what is replaced."""
    i = j = at = 0
    while at <= len(pairs):
        x, y = pairs[at] if at < len(pairs) else (n, m)
        if (x, y) != (i, j):
            yield False, i, x, j, y
        end = at
        while end < len(pairs) and pairs[end] == (x + end - at, y + end - at):
            end += 1
        if end > at:
            yield True, x, x + end - at, y, y + end - at
        i, j, at = x + end - at, y + end - at, max(end, at + 1)


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have none, and a line feed at the end ends the last."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def _operations(old: np.ndarray, new: np.ndarray) -> list[dict]:
    a, b = old.tolist(), new.tolist()
    out = []
    for equal, i, n, j, m in stretches(aligned(a, b), len(a), len(b)):
        if equal:
            out += [{"kind": " ", "a": x, "b": y, "text": a[x]} for x, y in zip(range(i, n), range(j, m), strict=True)]
        else:
            out += [{"kind": "-", "a": x, "b": j, "text": a[x]} for x in range(i, n)]
            out += [{"kind": "+", "a": n, "b": y, "text": b[y]} for y in range(j, m)]
    return out


@F.pandas_udf(_OPERATIONS)
def operations(old: pd.Series, new: pd.Series) -> pd.Series:
    """The edit script of two lists of lines: kind blank, - or +, the lines before it on either side, and the line."""
    return pd.Series([_operations(x, y) for x, y in zip(old, new, strict=True)])


def hunks(pairs: DataFrame, id_col: str, old: str = "old", new: str = "new", context: int = 2) -> DataFrame:
    """(id, hunk from 1, a, n, b, m, lines): the changes of each row's two texts with ``context`` lines around them.

    a and b are the lines before the hunk, n and m its lines on either side; lines are its rows with their sign. Null texts are
    empty; equal texts have no hunk. Ids must differ. A window over a text's lines finds those near a change, another one numbers the runs of them.
    """
    script = bounded(pairs).select(id_col, F.posexplode(operations(lines_of(F.col(old)), lines_of(F.col(new)))).alias("place", "o")).select(id_col, "place", "o.*")
    w = Window.partitionBy(id_col).orderBy("place")
    near = F.max(F.col("kind") != " ").over(w.rowsBetween(-context, context))
    shown = script.withColumn("near", near).where("near").withColumn("first", F.coalesce(F.col("place") - F.lag("place").over(w) > 1, F.lit(True)))
    numbered = shown.withColumn("hunk", F.count_if("first").over(w))
    side = lambda sign: F.count_if(F.col("kind") != sign)
    rows = F.array_sort(F.collect_list(F.struct("place", F.concat("kind", "text").alias("line"))))
    return numbered.groupBy(id_col, "hunk").agg(F.min("a").alias("a"), side("+").alias("n"), F.min("b").alias("b"), side("-").alias("m"), F.transform(rows, lambda r: r["line"]).alias("lines"))


def unified(pairs: DataFrame, id_col: str, old: str = "old", new: str = "new", context: int = 2, names: tuple[str, str] = ("old", "new")) -> DataFrame:
    """(id, diff): unified differences; texts that are equal by lines have an empty one."""
    span = lambda start, n: F.concat(F.when(F.col(n) == 0, F.col(start)).otherwise(F.col(start) + 1).cast("string"), F.when(F.col(n) == 1, "").otherwise(F.concat(F.lit(","), F.col(n).cast("string"))))
    head = F.concat(F.lit("@@ -"), span("a", "n"), F.lit(" +"), span("b", "m"), F.lit(" @@\n"))
    text = hunks(pairs, id_col, old, new, context).withColumn("t", F.concat(head, F.array_join("lines", "\n")))
    whole = text.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("hunk", "t"))).alias("h"))
    joined = F.concat(F.lit(f"--- {names[0]}\n+++ {names[1]}\n"), F.array_join(F.transform("h", lambda x: x["t"]), "\n"))
    return pairs.select(id_col).join(whole.select(id_col, joined.alias("diff")), id_col, "left").select(id_col, F.coalesce("diff", F.lit("")).alias("diff"))


def with_hunks(old: Column, found: Column) -> Column:
    """The lines that hunks (an array of their structs, in order) make of a text: those between them stay, those of a hunk are its own without the deleted ones."""
    lines = lines_of(old)
    end = lambda i: F.when(i > 0, found[i - 1]["a"] + found[i - 1]["n"]).otherwise(F.lit(0))
    cut = lambda start, stop: F.slice(lines, (start + 1).cast("int"), (stop - start).cast("int"))
    own = lambda h: F.transform(F.filter(h["lines"], lambda x: ~x.startswith("-")), lambda x: F.substr(x, F.lit(2)))
    changed = F.flatten(F.transform(found, lambda h, i: F.concat(cut(end(i), h["a"]), own(h))))
    last = end(F.size(found))
    return F.concat(changed, cut(last, F.size(lines)))

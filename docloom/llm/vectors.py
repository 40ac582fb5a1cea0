"""What the operators on embeddings share: integer vectors, and exact sums of them."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, stored

#: Rows of a batch of integer vectors, and the largest absolute entry: beyond it no squared distance fits a long.
ROWS, WIDEST = 4000, 1 << 53


def sound(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of ``dims`` finite entries, their rows as doubles)."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dims)
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    good = np.isfinite(values).all(axis=1)
    return at[good], values[good]


def rows_of(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists are all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim > 1 else 0)), pa.array(flat, kind))


def integers(vectors: DataFrame, id_col: str, vector: Column, dims: int, scale: int, plus: int = 0) -> DataFrame:
    """(id, x): floor(scale * entry) + plus of every vector of ``dims`` finite entries, written to the shared folder.

    Entries beyond WIDEST count as WIDEST. The other vectors have no row.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, values = sound(b.column("v"), dims)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(values * scale), -WIDEST, WIDEST).astype(np.int64) + plus
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), lists(x, pa.int64())], names=["id", "x"])

    named = vectors.select(F.col(id_col).alias("id"), vector.cast("array<double>").alias("v"))
    kind = named.schema["id"].dataType.simpleString()
    with vector_batches(vectors):
        return stored(named.mapInArrow(batches, f"id {kind}, x array<long>"), "integers")


def vector_batches(df: DataFrame) -> contextlib.AbstractContextManager[None]:
    """Batches of ROWS for what runs inside: rows of one vector each."""
    return batch_rows(df.sparkSession, ROWS)


def exact_sums(x: DataFrame, group: Column) -> dict[int, tuple[int, list[int]]]:
    """{group: (rows, componentwise sums of x)} over small integer groups, exactly: a task sends one row a group, Spark adds them.

    What comes to the driver has a number for each group and component, however many rows there are.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in it:
            of, rows = b.column("g").to_numpy(), rows_of(b.column("x"))
            if len(rows) and int(np.abs(rows).max()) >= 1 << 40:  # a batch's sum might not fit a long
                rows = rows.astype(object)
            for g in np.unique(of).tolist():
                n, sums = held.get(g, (0, 0))
                mine = rows[of == g]
                held[g] = n + len(mine), sums + mine.sum(axis=0).astype(object)
        named = [[g for g in held], [n for n, _ in held.values()], [[Decimal(int(s)) for s in sums] for _, sums in held.values()]]
        kinds = pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(named, kinds, strict=True)], names=["g", "n", "sums"])

    with vector_batches(x):
        parts = x.select(group.cast("int").alias("g"), "x").mapInArrow(batches, "g int, n long, sums array<decimal(38,0)>")
        cells = parts.select("g", "n", F.posexplode("sums").alias("place", "part"))
        found = cells.groupBy("g", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(found, key=lambda r: (r["g"], r["place"])):
        out.setdefault(r["g"], (r["n"], []))[1].append(int(r["total"]))
    return out

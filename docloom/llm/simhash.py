"""SimHash near-duplicates: fingerprints of word shingles, met in the middle of Hamming balls.

Two fingerprints that differ in at most three bits differ in at most two outside some third of their bits. So each
fingerprint, with each third left out in turn, emits itself and all variants within half of that radius: one bit.
Fingerprints that are near meet on a variant; those that meet are verified bit by bit. Full balls of half of three
would need radius two, 2,081 variants; leaving out a third needs 132 and misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, bounded, free_name, per_row, stored, text_bytes
from .components import components

#: First bit and number of bits of each part that is left out in turn.
PARTS = ((0, 21), (21, 21), (42, 22))
#: Shingles turned into bits at once.
CHUNK = 1 << 16


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of ``width``-word shingles of lower-cased text; zero without words."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), "<u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) of every row; null and empty texts have fingerprint zero."""
    return per_row(docs.select(F.col(id_col), text_bytes(text_col).alias("data")), lambda x: (fingerprint(x, width),), "fp long", id_col)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.uint64(1)
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for lo, n in PARTS:
            rest = fps & ~np.uint64(((1 << n) - 1) << lo)
            flips = np.array([0, *(1 << i for i in range(64) if not lo <= i < lo + n)], np.uint64)
            keys = (rest[:, None] ^ flips[None, :]) | (one << np.uint64(lo))  # the mark tells the parts apart
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, len(flips)).view(np.int64))], names=["key", "fp"])


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join the fingerprints within the radius as all such pairs would: each new one is linked to one of a group.

    Rows of the distance matrix are made one at a time; memory stays in proportion to the group.
    """
    left, edges = fps, []
    while len(left):
        todo, left = left[:1], left[1:]
        while len(todo) and len(left):
            at, todo = todo[0], todo[1:]
            near = np.bitwise_count(left ^ at) <= radius
            edges += [(at, x) for x in left[near]]
            todo, left = np.concatenate([todo, left[near]]), left[~near]
    return edges


def _edges(radius: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key: edges within each key. A key that a batch cuts is carried over to the next."""
        keys = fps = np.empty(0, np.int64)
        for b in _and_end(it):
            if b is not None:
                keys = np.concatenate([keys, b.column("key").to_numpy()])
                fps = np.concatenate([fps, b.column("fp").to_numpy()])
                whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            else:
                whole = len(keys)
            starts = np.flatnonzero(np.r_[True, keys[1:whole] != keys[: whole - 1]]) if whole else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, whole])
            found = set()
            for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                if n == 2:
                    x, y = fps[s : s + 2].view(np.uint64)
                    if x != y and int(x ^ y).bit_count() <= radius:
                        found.add((int(x), int(y)))
                else:
                    found.update((int(x), int(y)) for x, y in _forest(np.unique(fps[s : s + n]).view(np.uint64), radius))
            if found:
                both = np.array(sorted(found), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])
            keys, fps = keys[whole:], fps[whole:]

    return batches


def _and_end(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from it
    yield None


def near_edges(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints of column fp as all pairs within ``radius`` (at most 3) would."""
    if not 0 <= radius <= 3:
        raise ValueError("balls of one bit around two thirds of the bits find a radius of at most 3")
    spark = bounded(distinct.sparkSession)
    met = distinct.select("fp").mapInArrow(_variants, "key long, fp long").repartition("key").sortWithinPartitions("key")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")  # rows of 16 bytes
    try:
        return stored(met.mapInArrow(_edges(radius), "a long, b long").distinct(), "near")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component_id): component_id is the least id reachable by links of at most ``radius`` differing bits.

    Equal fingerprints, those of null and empty texts included, are linked: they become one node before anything is
    paired, so copies cost nothing. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    links = components(near_edges(least, radius))
    roots = least.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = stored(roots, "roots")
    firsts = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(roots.join(firsts, "component").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its component, with all their columns.

    Rows with a null id are kept. A repeated row is kept as often as it stands there.
    """
    groups = near_duplicates(docs.where(F.col(id_col).isNotNull()).select(id_col, text_col), id_col, text_col)
    # written first, so that its size is known when the join is planned
    gone = free_name(docs.columns, "__dropped")
    dropped = stored(groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct(), "dropped")
    may = IdFilter(dropped, gone)  # documents that can't be among them aren't shuffled
    judged = may.split(docs, id_col, True).join(dropped, F.col(id_col) == F.col(gone), "left_anti")
    return judged.unionByName(may.split(docs, id_col, False))

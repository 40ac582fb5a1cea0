"""Embedding near-duplicates by NN-descent.

Equal vectors become one node. A first neighbour graph comes from random hyperplanes: sorted by its signs, each vector
is compared with a few around it, for a few sets of planes. The graph is then refined: neighbours of a vector,
in either direction, are compared with each other, and whoever is nearer goes into the lists. Lists that are full of
links grow to twice their length. After each round a fixed sample is compared with every vector; while it shows a
missing link, or new links are still found, another round follows, with one more set of planes; if that hasn't ended
after ROUNDS, an error says so. Of the graph the threshold edges stay; within each component they join, all pairs are compared in blocks, so every vector's links are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, stored
from .components import components

#: Sets of planes in the first and in later rounds, vectors compared at once, and by how many the next ones overlap.
SETS, MORE_SETS, NEAR, OVERLAP = 4, 1, 100, 50
#: Length of a neighbour list; below this cosine no neighbour can lead to a link; rounds at most; sample for the audit.
LIST, FLOOR, ROUNDS, AUDIT = 10, 0.9, 25, 256
#: Vectors of a component in one block, and neighbours of one vector in one row.
BLOCK, FAN = 1000, 256

_EDGE = "a long, b long, sim double"


def _matrix(vectors) -> np.ndarray:
    return np.array(vectors, np.float64)


def _strong(ids: np.ndarray, x: np.ndarray, least: float, k: int) -> list[tuple[int, int, float]]:
    """Of some vectors: each one's k nearest, as far as FLOOR, and edges that connect what links of ``least`` connect."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    found: set[tuple[int, int, float]] = set()

    def put(i: int, j: int) -> None:
        i, j = (i, j) if ids[i] < ids[j] else (j, i)
        found.add((int(ids[i]), int(ids[j]), float(sims[i, j])))

    busy = np.flatnonzero(sims.max(axis=1, initial=-2) >= FLOOR)
    for i in busy:
        near = np.flatnonzero(sims[i] >= FLOOR)
        if len(near) > k:
            near = near[np.argsort(-sims[i, near], kind="stable")[:k]]
        for j in near:
            put(i, j)
    left = busy
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = sims[i, left] >= least
            for j in left[hit]:
                put(i, j)
            todo += left[hit].tolist()
            left = left[~hit]
    return list(found)


def _edges(out: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "sim"])


def _planes(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).normal(size=(dims, 63))


def _signs(seeds: list[int]):
    weights = 1 << np.arange(62, -1, -1)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            vectors = b.column("v").to_pylist()
            sizes = np.array([len(x) for x in vectors])
            of = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes).tolist()}  # those of one length in one product
            for seed in seeds:
                codes = np.zeros(len(vectors), np.int64)
                for n, at in of.items():
                    codes[at] = (_matrix([vectors[i] for i in at.tolist()]) @ _planes(n, seed) > 0) @ weights
                yield pa.RecordBatch.from_arrays([b.column("part"), pa.array([seed] * b.num_rows, pa.int32()), pa.array(codes), b.column("id"), b.column("v")], names=["part", "seed", "code", "id", "v"])

    return batches


def _neighbourhoods(least: float):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of vectors sorted by part, set of planes and signs: edges among every NEAR that follow each other."""
        now, rows = None, []
        for b in it:
            out = []
            for part, seed, i, v in zip(*(b.column(c).to_pylist() for c in ("part", "seed", "id", "v")), strict=True):
                if now != (part, seed):
                    out += _among(rows, least)
                    now, rows = (part, seed), []
                rows.append((i, v))
                if len(rows) == NEAR:
                    out += _among(rows, least)
                    rows = rows[NEAR - OVERLAP :]
            yield _edges(out)
        yield _edges(_among(rows, least))

    return batches


def _among(rows: list[tuple[int, list[float]]], least: float) -> list[tuple[int, int, float]]:
    return _strong(np.array([x[0] for x in rows]), _matrix([x[1] for x in rows]), least, LIST) if len(rows) > 1 else []


def _local_joins(least: float):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for own in b.column("near").to_pylist():
                out += _among([(x["id"], x["v"]) for x in own], least)
            yield _edges(out)

    return batches


def _first_graph(nodes: DataFrame, seeds: list[int], least: float) -> DataFrame:
    coded = nodes.mapInArrow(_signs(seeds), "part long, seed int, code long, id long, v array<double>")
    n = nodes.sparkSession.sparkContext.defaultParallelism * 2
    return coded.repartitionByRange(n, "part", "seed", "code", "id").sortWithinPartitions("part", "seed", "code", "id").mapInArrow(_neighbourhoods(least), _EDGE)


def _refined(edges: DataFrame, nodes: DataFrame, least: float, length: int, round_: int) -> DataFrame:
    """Edges among the neighbours of each vector, neighbours in either direction."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "sim").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "sim"))
    full = both.where(F.col("sim") >= least).groupBy("v").agg(F.count("*").alias("n"))
    # a list that is full of links is saturated and grows
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    lists = both.join(full, "v", "left").withColumn("place", place).where(F.col("place") <= F.when(F.col("n") >= length, 2 * length).otherwise(length)).select("v", "u")
    members = lists.unionByName(lists.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
    spread = members.withColumn("c", F.floor((F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", F.lit(round_)))) - 1) / FAN))  # other parts in each round
    near = spread.join(nodes.select(F.col("id").alias("u"), F.col("v").alias("x")), "u")
    grouped = near.groupBy("v", "c").agg(F.collect_list(F.struct(F.col("u").alias("id"), F.col("x").alias("v"))).alias("near")).where(F.size("near") > 1)
    return grouped.select("near").mapInArrow(_local_joins(least), _EDGE)


def _missing(nodes: DataFrame, edges_of: DataFrame, least: float) -> tuple[int, int]:
    """(links of the sample, those between vectors that the links don't connect yet): the sample against every vector."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(AUDIT).collect()
    asked: dict[tuple[int, int], tuple[list[int], list[list[float]]]] = {}
    for r in sample:
        ids, vectors = asked.setdefault((r["part"], len(r["v"])), ([], []))
        ids.append(r["id"])
        vectors.append(r["v"])
    shared = spark.sparkContext.broadcast({k: (np.array(ids), _matrix(v)) for k, (ids, v) in asked.items()})

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for part, i, v in zip(*(b.column(c).to_pylist() for c in ("part", "id", "v")), strict=True):
                if (part, len(v)) in shared.value:
                    ids, x = shared.value[part, len(v)]
                    sims = x @ np.array(v)
                    out += [(int(ids[k]), i, float(sims[k])) for k in np.flatnonzero(sims >= least) if ids[k] != i]
            yield _edges(out)

    found = nodes.mapInArrow(batches, _EDGE).select("a", "b").distinct()
    of = edges_of.select("node", "component")
    a = of.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = of.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = found.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    return found.count(), apart.count()


def _counts(least: float):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of two blocks of a component (i and j; one, if they are the same): links between them, weighted by copies."""
        for b in it:
            ids, sums = [], []
            for i, j, rows in zip(*(b.column(c).to_pylist() for c in ("i", "j", "rows")), strict=True):
                side = [[x for x in rows if x["block"] == k] for k in ((i,) if i == j else (i, j))]
                x = [_matrix([r["v"] for r in s]) for s in side]
                n = [np.array([r["n"] for r in s], np.int64) for s in side]
                if not all(map(len, side)):
                    continue
                close = x[0] @ x[-1].T >= least
                if i == j:
                    np.fill_diagonal(close, False)
                    counts = [close @ n[0]]
                else:
                    counts = [close @ n[1], close.T @ n[0]]
                for s, c in zip(side, counts, strict=True):
                    ids += [r["id"] for r in s]
                    sums += c.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.int64())], names=["id", "n"])

    return batches


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector: links join vectors of one label with cosine of ``least`` or more.

    Vectors link with nothing if they or their label or id are null, if they are empty or zero, if they hold null or
    non-finite numbers, or to vectors of another length. Equal vectors are links of one another; a repeated row counts
    as another vector. kept is whether the id is the least of its component, and true for null ids. An empty table
    gives an empty one. All arithmetic is in double precision.
    """
    spark = bounded(vectors.sparkSession)
    raw = F.col(vector_col).cast("array<double>")
    # divided by the greatest component first: squares of very large or small ones would leave the range of numbers
    most = F.array_max(F.transform("raw", lambda x: F.abs(x)))
    finite = F.coalesce(~F.exists("raw", lambda x: x.isNull() | F.isnan(x)) & (F.col("most") > 0) & (F.col("most") < F.lit(float("inf"))), F.lit(False))
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite
    scaled = vectors.select(F.col(id_col), F.col(label_col), raw.alias("raw")).withColumn("most", most).withColumn("sound", sound).withColumn("v", F.when(F.col("sound"), F.transform("raw", lambda x: x / F.col("most"))))
    named = scaled.select(
        F.col(id_col), F.col(label_col).cast("string").alias("label"), "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), "sound"
    ).withColumns({"h1": F.when(F.col("sound"), F.xxhash64("label", "v")), "h2": F.when(F.col("sound"), F.xxhash64(F.lit(1), "v", "label"))})
    named = stored(named, "vectors")
    classes = named.where("sound").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(id_col).alias("id"), F.first("label").alias("label"), F.first("v").alias("v"), F.first("norm").alias("norm"))
    # a node is known by its vector's hash; ids may be shared
    nodes = stored(classes.select(F.col("h1").alias("node"), "h1", "h2", "n", "id", F.xxhash64("label", F.size("v")).alias("part"), F.transform("v", lambda x: x / F.col("norm")).alias("v")), "nodes")
    own = nodes.select("part", F.col("node").alias("id"), "v")
    edges = stored(_first_graph(own, list(range(SETS)), least).distinct(), "graph")
    length, before = LIST, -1
    for round_ in range(ROUNDS):
        new = _refined(edges, own, least, length, round_)
        if round_:
            new = new.unionByName(_first_graph(own, list(range(SETS + MORE_SETS * (round_ - 1), SETS + MORE_SETS * round_)), least))
        edges = stored(edges.unionByName(new).groupBy("a", "b").agg(F.max("sim").alias("sim")), "graph")
        linked = stored(components(edges.where(F.col("sim") >= least)), "linked")
        _, apart = _missing(own, linked, least)
        now = linked.select("component").distinct().count() - linked.count()  # how many joins the links have made
        if not apart and now == before:
            break
        before, length = now, 2 * length
    else:
        raise RuntimeError(f"links were still found after {ROUNDS} rounds")
    grouped = nodes.join(linked, "node").select(F.col("node").alias("id"), "n", "v", "component")
    sizes = grouped.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    cut = grouped.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = cut.groupBy("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("block", "id", "n", "v")).alias("rows"))
    counts = pairs.select("i", "j", "rows").mapInArrow(_counts(least), "id long, n long").groupBy("id").agg(F.sum("n").alias("others"))
    firsts = nodes.join(linked, "node").groupBy("component").agg(F.min("id").alias("first"))
    placed = linked.join(firsts, "component").select("node", "first")
    of = nodes.select("node", "id", "h1", "h2", "n").join(placed, "node", "left").join(counts.withColumnRenamed("id", "node"), "node", "left")
    of = of.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("first", "id").alias("component"))
    out = named.join(of, ["h1", "h2"], "left").select(id_col, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("component"), F.col(id_col)).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

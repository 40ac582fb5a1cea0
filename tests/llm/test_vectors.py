"""Clustering and whitening of embeddings, against plain loops and a dense eigendecomposition."""

import hashlib
import math
import random

import numpy as np
import pytest

from docloom.llm import queries, sortmeans, whitening
from docloom.llm.vectors import integers

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, x int, cluster string, id int, n int, label int"


def table(spark, rows, schema=SCHEMA):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, 1, "c", 2, 3, 4) for i, v in rows], schema)


def floored(v, scale):
    return [math.floor(e * scale) for e in v]


def plain_clusters(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = [(i, floored(v, scale)) for i, v in rows if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    by_mark = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in by_mark[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids] for _, x in kept]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rounds):
        of = assign()
        for g in range(len(centroids)):
            mine = [x for (_, x), (c, _) in zip(kept, of, strict=True) if c == g]
            if mine:
                centroids[g] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    of = assign()
    total = sum(d for _, d in of)
    sums = {g: sum(d for c, d in of if c == g) for g, _ in of}
    return sorted(((i, c, d, sums[c], total, centroids[c]) for (i, _), (c, d) in zip(kept, of, strict=True)), key=repr)


def got_clusters(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_clusters_of_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    plain = plain_clusters(rows)
    got = got_clusters(queries.op11_sortmeans(spark, SF))
    assert got == sorted(((i, c, d, s, t, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for i, c, d, s, t, m in plain), key=repr)


def test_clusters_of_odd_rows(spark):
    rnd = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(60)]
    rows += [(7, [0.5, 0.5, 0.5])] * 5 + [(None, [1.0, 1.0, 1.0]), (None, [0.0, 1.0, 0.0])]
    rows += [(90, None), (91, []), (92, [1.0]), (93, [nan, 0.0, 0.0]), (94, [inf, 0.0, 0.0]), (95, [None, 0.0, 0.0]), (96, [0.0] * 4)]
    for scale in (1, 1024):
        assert got_clusters(sortmeans.clusters(table(spark, rows), dims=3, scale=scale)) == plain_clusters(rows, dims=3, scale=scale)
    few = rows[:3]
    assert got_clusters(sortmeans.clusters(table(spark, few), dims=3)) == plain_clusters(few, dims=3)
    # distances of some 2^62 are still exact
    large = [(i, [rnd.uniform(-1e6, 1e6) for _ in range(3)]) for i in range(40)]
    assert got_clusters(sortmeans.clusters(table(spark, large), dims=3)) == plain_clusters(large, dims=3)
    # what a long can't hold is null
    huge = got_clusters(sortmeans.clusters(table(spark, [(1, [1e300, 0.0, 0.0]), (2, [-1e300, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])]), k=1, dims=3))
    assert len(huge) == 3 and all(r[4] is None for r in huge)
    assert sortmeans.clusters(table(spark, []), dims=3).collect() == []
    assert sortmeans.clusters(table(spark, rows[-7:]), dims=3).collect() == []


def test_stops_early_and_is_right():
    rnd = np.random.default_rng(5)
    centroids = (rnd.normal(size=(8, 16)) * 1000).astype(int)
    x = np.vstack([c + (rnd.normal(size=(50, 16)) * 30).astype(int) for c in centroids])
    far = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    true = far.argmin(1)
    best, near, looked = sortmeans.nearest(x, true, centroids.tolist())
    assert (best == true).all() and (near == far.min(1)).all() and looked < 2 * len(x)
    for before in range(8):  # whatever it starts from
        best, near, _ = sortmeans.nearest(x, np.full(len(x), before), centroids.tolist())
        assert (best == true).all() and (near == far.min(1)).all()
    tied = sortmeans.nearest(np.array([[0, 0]]), np.array([2]), [[0, 5], [9, 9], [5, 0], [0, 5]])
    assert tied[0].tolist() == [0] and tied[1].tolist() == [25]  # the limit itself is still looked at


def plain_whitening(x, k):
    n = len(x)
    centred = x - x.mean(axis=0)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return centred @ u / np.sqrt(e), e / np.trace(v)


def check_whitening(rows, ids, x, k):
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    w, explained = plain_whitening(x.astype(float), k)
    by_id = {r["vec_id"]: r for r in rows}
    assert by_id.keys() == set(ids)
    got = np.array([by_id[i]["whitened"] for i in ids])
    signs = np.sign((got * w).sum(axis=0))
    assert np.abs(got * signs - w).max() < 1e-7
    for i, row in zip(ids, x, strict=True):
        r = by_id[i]
        assert r["n"] == n and r["deviation"] == sum((n * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True))
        assert np.allclose(r["explained"], explained, rtol=1e-9) and 0 <= r["identity_error"] < 1e-9


def test_whitening_of_whole_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    ids = sorted(rows)
    x = np.array([[math.floor(64 * float(e)) + 1_000_000 for e in rows[i]] for i in ids], np.int64)
    check_whitening(whitening.whitened(vectors).collect(), ids, x, 32)
    flat = queries.op13_whitening(spark, SF).collect()
    assert len(flat) == 32 * len(ids) and {r["component"] for r in flat} == set(range(1, 33))


def test_block_narrower_than_vectors(spark):
    """The iteration itself: 5 of 90 components from a block of 8, from decaying and from flat spectra."""
    rnd = np.random.default_rng(8)
    for fall in (0.9, 0.999):
        raw = rnd.normal(size=(300, 90)) * fall ** np.arange(90) @ np.linalg.qr(rnd.normal(size=(90, 90)))[0]
        vectors = table(spark, [(i, v.tolist()) for i, v in enumerate(raw)])
        x = np.floor(raw * 64).astype(np.int64) + 1_000_000
        got = whitening.whitened(vectors, k=5, block=8).collect()
        check_whitening(got, list(range(300)), x, 5)
        from pyspark.sql import functions as F

        found = whitening.fit(integers(vectors, "vec_id", F.col("embedding"), 90, 64, 1_000_000), 5, 8)
        assert found.passes > 2
        v = np.cov(x.T.astype(float), bias=True)
        assert np.linalg.norm(v @ found.components - found.components * found.eigenvalues, axis=0).max() < 1e-12 * found.eigenvalues[0]


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [0.25, 0.25, 0.25]), (3, [3.0, 1.0, 0.0])]
    bad = [(4, None), (5, []), (6, [nan, 0.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, [None, 0.0, 0.0]), (9, [1.0])]
    rows = whitening.whitened(table(spark, good + bad)).collect()
    assert sorted(str(r["vec_id"]) for r in rows) == ["1", "2", "2", "3", "None"]
    x = np.array([[math.floor(64 * e) + 1_000_000 for e in v] for _, v in good], float)
    assert np.allclose(sorted(np.abs([r["whitened"][0] for r in rows])), sorted(np.abs(plain_whitening(x, 1)[0][:, 0])))
    equal = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [r["whitened"] for r in equal] == [[], []] and [r["deviation"] for r in equal] == [0, 0]
    line = whitening.whitened(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert all(len(r["whitened"]) == 1 and r["explained"] == pytest.approx([1.0]) for r in line)
    assert whitening.whitened(table(spark, [])).collect() == [] == whitening.whitened(table(spark, bad[:5])).collect()
    far = whitening.whitened(table(spark, [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])])).collect()
    assert len(far) == 3

"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network in numpy.

Words are runs of letters and digits or of other marks, hashed to BUCKETS buckets, case kept. Every bucket has a sparse
random index vector; its word vector is the sum of the index vectors of its neighbours over the whole corpus. So what
is gathered is a table of fixed size, summed by Spark from every partition. A document's input is the mean and the
spread of its words' vectors and a few shares (distinct words, capitals, marks, repetition). The network is trained on
a bounded sample of labelled rows and its probabilities calibrated by a temperature fitted on rows kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, free_name, text_bytes

BUCKETS, DIMS, SPARSE, REACH = 1 << 13, 32, 4, 2
#: Labelled rows that the network is fitted on at most: those with the least hashes of their ids.
SAMPLE = 20_000
HIDDEN, EPOCHS, SEED = 32, 40, 42
N_SHARES = 9
#: Bytes of text whose words are worked on at once.
PIECE = 400_000

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 mark, 2 letter or digit
_KIND[[*range(9, 14), 32]] = 3
_KIND[[i for i in range(256) if chr(i).isascii() and chr(i).isalnum()]] = 2
_KIND[128:] = 2
_KIND = np.where(_KIND == 3, 0, np.where(_KIND == 2, 2, 1)).astype(np.uint8)
_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_AT = np.stack([_rng.permutation(DIMS)[:SPARSE] for _ in range(BUCKETS)])
_SIGN = _rng.choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, SPARSE))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: each word's bucket, its text, its first byte's place, and the joined bytes."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    kind = _KIND[joined]
    first = np.flatnonzero((kind > 0) & (kind != np.r_[np.uint8(0), kind[:-1]]))
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64), first, joined
    inside = np.flatnonzero(kind > 0)
    word = np.cumsum(np.r_[False, np.diff(inside) > 1] | np.r_[True, kind[inside[1:]] != kind[inside[:-1]]]) - 1
    # a word's hash: the sum of its bytes' numbers, each times a power for its place
    part = _BYTE[joined[inside]] * _POWER[np.minimum(inside - first[word], 63)]
    hashes = np.add.reduceat(part, np.flatnonzero(np.r_[True, word[1:] != word[:-1]]))
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return bucket, np.searchsorted(np.cumsum(sizes), first, side="right"), first, joined


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This partition's sums of neighbours' index vectors, a row for each bucket that occurs."""
    sums, counts = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for texts in _pieces(b.column("data").to_pylist()):
            bucket, doc, _, _ = tokens(texts)
            counts += np.bincount(bucket, minlength=BUCKETS)
            for step in range(1, REACH + 1):
                near = doc[step:] == doc[:-step]
                left, right = bucket[:-step][near], bucket[step:][near]
                for own, other in ((left, right), (right, left)):
                    for k in range(SPARSE):
                        sums += np.bincount(own * DIMS + _AT[other, k], _SIGN[other, k], BUCKETS * DIMS)
    seen = np.flatnonzero(counts)
    vectors = sums.reshape(BUCKETS, DIMS)[seen]
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen]), *(pa.array(vectors[:, i].copy()) for i in range(DIMS))], names=["bucket", "n", *(f"v{i}" for i in range(DIMS))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(vector, count) of every bucket over the whole corpus: BUCKETS rows, whatever the corpus's size."""
    spark = bounded(docs.sparkSession)
    schema = "bucket long, n long, " + ", ".join(f"v{i} double" for i in range(DIMS))
    parts = docs.select(text_bytes(text_col).alias("data")).mapInArrow(_context, schema)
    # whole numbers, which doubles sum exactly as far as 2**53, so the order of partitions doesn't matter
    total = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIMS)))
    vectors, counts = np.zeros((BUCKETS, DIMS), np.float32), np.zeros(BUCKETS)
    for r in total.collect():
        vectors[r[0]], counts[r[0]] = r[2:], r[1]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0), counts


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in lists of some PIECE bytes: a word takes hundreds of bytes while its vector is at hand."""
    now, size = [], 0
    for x in texts:
        if now and size + len(x) > PIECE:
            yield now
            now, size = [], 0
        now.append(x)
        size += len(x)
    if now:
        yield now


def pooled(texts: list[bytes], vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row for each text: mean and spread of its words' vectors, and shares. Texts without words give zeros."""
    rows = [_pooled(x, vectors, weight) for x in _pieces(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, 2 * DIMS + N_SHARES), np.float32)


def _pooled(texts: list[bytes], vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    bucket, doc, first, joined = tokens(texts)
    out = np.zeros((len(texts), 2 * DIMS + N_SHARES), np.float32)
    if not len(bucket):
        return out
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    have = doc[starts]
    n = np.diff(np.r_[starts, len(doc)]).astype(np.float32)
    w = weight[bucket].astype(np.float32)
    each = np.maximum(np.add.reduceat(w, starts), 1e-9)[:, None]
    rows = vectors[bucket]
    mean = np.add.reduceat(rows * w[:, None], starts) / each
    out[have, :DIMS] = mean
    out[have, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(rows * rows * w[:, None], starts) / each - mean * mean, 0))
    mark = _KIND[joined[first]] == 1
    upper = (joined[first] >= 65) & (joined[first] <= 90)
    after = np.minimum(first + 1, len(joined) - 1)
    shout = upper & (joined[after] >= 65) & (joined[after] <= 90)
    pairs = np.r_[False, (bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1])]
    order = np.lexsort((bucket, doc))
    new = np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
    digit = (joined[first] >= 48) & (joined[first] <= 57)
    shares = [np.add.reduceat(x.astype(np.float32), starts) / n for x in (mark, upper, shout, pairs, digit)]
    distinct = np.add.reduceat(new.astype(np.float32), starts) / n
    size = np.fromiter((len(x) for x in texts), np.float32, len(texts))[have]
    out[have, 2 * DIMS :] = np.stack([*shares, distinct, np.log1p(n) / 10, size / n / 10, distinct * np.log1p(n) / 5], axis=1)
    return out


def fold(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(of))


class Network:
    """Two layers: rectified, then logistic, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        """Fits to rows x and labels y of 0 and 1, every fifth row kept for the temperature. One class: its share, smoothed."""
        rng = np.random.default_rng(seed)
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.trained = len(y) >= 10 and 0 < y.sum() < len(y)
        if not self.trained:
            return
        apart = np.arange(len(y)) % 5 == 4
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-4
        z, zy, v, vy = self._scaled(x[~apart]), y[~apart], self._scaled(x[apart]), y[apart]
        shape = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
        self.w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, shape[0]), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(())]
        m, s, t, size = [np.zeros(k) for k in shape], [np.zeros(k) for k in shape], 0, 64
        for epoch in range(EPOCHS):
            rate = 3e-3 * (1 - epoch / EPOCHS)
            order = rng.permutation(len(z))
            for at in range(0, len(z), size):
                rows = order[at : at + size]
                a = z[rows] @ self.w[0] + self.w[1]
                h = np.maximum(a, 0)
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - zy[rows]) / len(rows)
                back = np.outer(d, self.w[2]) * (a > 0)
                t += 1
                for i, g in enumerate((z[rows].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ d + 1e-4 * self.w[2], d.sum())):
                    m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        logits = self._logits(v)
        loss = lambda k: np.mean(np.logaddexp(0, np.where(vy > 0, -logits, logits) / k))
        self.temperature = min(np.geomspace(0.5, 10, 120), key=loss)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(self._scaled(x)) / self.temperature, -30, 30)))


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, np.ndarray, Network]:
    """Word vectors and weights from all texts, and the network fitted to at most ``sample`` labelled rows."""
    spark = docs.sparkSession
    vectors, counts = word_vectors(docs, text_col)
    model = spark.sparkContext.broadcast((vectors, 1e-3 / (1e-3 + counts / max(counts.sum(), 1))))
    own = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).groupBy("__id").agg(F.min("y").alias("y"))
    picked = own.where(fold(F.col("__id"), 4) != 2).orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(sample)
    # the sample's size is bounded, so it is broadcast and texts stay where they are
    rows = docs.select(F.col(id_col), text_bytes(text_col).alias("data")).join(F.broadcast(picked), F.col(id_col) == F.col("__id")).select("__id", "data", "y")

    def inputs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = pooled(b.column("data").to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([b.column("__id").cast(pa.string()), pa.array(list(x), pa.list_(pa.float32())), b.column("y")], names=["id", "x", "y"])

    bounded(spark)
    known = sorted(rows.mapInArrow(inputs, "id string, x array<float>, y int").collect(), key=lambda r: r["id"])
    x = np.array([r["x"] for r in known], np.float64).reshape(len(known), 2 * DIMS + N_SHARES)
    return *model.value, Network(x, np.array([r["y"] for r in known], np.float64))


def _with_scores(source: DataFrame, model: tuple, data: str, score: str) -> DataFrame:
    """source with column ``score`` in place of column ``data``."""
    shared = source.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in source.columns if c != data]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, weight, net = shared.value
        for b in it:
            scores = net(pooled(b.column(data).to_pylist(), vectors, weight).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, score])

    bounded(source.sparkSession)
    return source.mapInArrow(batches, T.StructType([*(source.schema[c] for c in keep), T.StructField(score, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score) of every row, texts scored whole; learned from labelled rows that aren't held out.

    Held out are rows whose crc32(id as text) mod 4 is 2. An id with two labels counts as label 0. Null labels and null ids aren't learned from; null and empty
    texts get a score as any other. Repeated rows give repeated rows; without labels of both kinds every score is the
    smoothed share of label 1; an empty table gives an empty one. At most ``sample`` labelled rows are fitted.
    """
    model = learned(docs, labels, id_col, text_col, label_col, sample)
    source = docs.select(F.col(id_col), F.coalesce(fold(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), text_bytes(text_col).alias("__data"))
    return _with_scores(source, model, "__data", "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores at least ``least``, with all their columns. Rows with a null id are kept.

    Each row is judged by its own text, where it stands; nothing is joined.
    """
    model = learned(docs, labels, id_col, text_col, "quality", SAMPLE)
    data, score = free_name(docs.columns, "__data"), free_name(docs.columns, "__score")
    judged = _with_scores(docs.withColumn(data, text_bytes(text_col)), model, data, score)
    return judged.where((F.col(score) >= least) | F.col(id_col).isNull()).select(*docs.columns)

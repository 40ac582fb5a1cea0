"""Toxicity by a noisy channel: obfuscated words are decoded by Viterbi under a character model, then scored.

The character model holds trigram counts of the whole corpus's text. A word with look-alike characters or letters
repeated, and a run of short pieces set apart by blanks, is a lattice of what it may stand for: a path may keep or drop
each repeated letter, each mark and each blank. The likeliest path under model and channel is the restored text. A document's score comes from the toxic weight of its restored words and their beginnings (so that
inflected forms count that were never seen), learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, text_bytes
from .quality import fold

#: Labelled rows that weights are learned from at most: those with the least hashes of their ids.
SAMPLE = 20_000
#: Weights kept at most (those that mark most toxic documents; a bound of the model), and the least documents that a weight must come from: a number and a share of the toxic ones.
WEIGHTS, LEAST, SHARE = 20_000, 3, 0.004
#: Lengths of the beginnings of words that have weights of their own.
BEGINNINGS = (4, 5, 6)
#: Words that a worker remembers.
KEPT = 200_000

#: What a character may stand for besides itself. Fixed values.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
    "*": "aeiou", "#": "h", "%": "x", "&": "e",
}
#: Log costs in the channel: a look-alike, a repeated letter left out, a mark between letters left out, a blank left out.
COST_LOOK, COST_REPEAT, COST_MARK, COST_BLANK = -0.7, -0.4, -1.2, -0.8
#: Letters of the pieces that may be one word set apart.
PIECE = 3

SIZE = 32
_CLASS = np.zeros(256, np.int64)
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i + 1
_CLASS[128:] = 27
_EDGE = " \t\n\r\v\f.,;:!?\"'()[]{}<>«»“”‘’-–—_*#%&$/\\|=+~^`"
_SPACED = re.compile(rf"(?<!\S)\S{{1,{PIECE}}}(?:\s+\S{{1,{PIECE}}})+(?!\S)")
_ALONE = re.compile(r"(?<!\S)\S(?!\S).*(?<!\S)\S(?!\S)", re.S)
_TWICE = re.compile(r"([^\W\d_])\1")
_APART = re.compile(r"\w(?:[.\-_*~/]\w){2,}")
_ODD = re.compile(r"[^\W\d_][0-9@$!|+€£¡(<*#%&]+[^\W\d_]|[0-9@$!|€£¡(<*]+[^\W\d_]|([^\W\d_])\1\1|[^\W\d_][0-9@$€]")


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SIZE**3, np.int64)
    for b in batches:
        x = _CLASS[np.frombuffer(b"  ".join([b"", *b.column("data").to_pylist(), b""]), np.uint8)]
        counts += np.bincount(x[:-2] * (SIZE * SIZE) + x[1:-1] * SIZE + x[2:], minlength=SIZE**3)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a letter after two others, from all texts whole: at most SIZE**3 numbers reach the driver."""
    bounded(docs.sparkSession)
    parts = docs.select(text_bytes(text_col).alias("data")).mapInArrow(_trigrams, "gram long, n long")
    counts = np.zeros(SIZE**3)
    for gram, n in parts.groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    three = counts.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    return np.log((three + 5 * p2) / (three.sum(2, keepdims=True) + 5))


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest plain text for an obfuscated one (lower case), by Viterbi over the lattice of its characters.

    Blanks are part of the lattice: a path drops one, or keeps it as the end of a word. Wherever a single path is left
    what it says is final, so time is in proportion to the length.
    """
    states = {(0, 0): (0.0, "")}  # the last two letters' classes -> score and text since all paths were one
    before, done = "", []
    for c in word:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(x, COST_LOOK) for x in LOOKS.get(c, "")]
        for (a, b), (score, text) in states.items():
            ways = [((b, k), score + cost + model[a, b, k], text + x) for x, cost in options if (k := _letter(x))]
            if c == before:
                ways.append(((a, b), score + COST_REPEAT, text))
            if c == " ":
                ways.append(((a, b), score + COST_BLANK, text))
                if b:
                    ways.append(((b, 0), score + model[a, b, 0], text + c))
            elif not c.isalnum():
                ways.append(((a, b), score + COST_MARK, text))
            for state, s, t in ways:
                if state not in after or (s, t) > after[state]:
                    after[state] = (s, t)
        if not after:  # a digit or mark that stands for nothing
            after = states
        if len(after) == 1:
            ((state, (score, text)),) = after.items()
            done.append(text)
            after = {state: (score, "")}
        states, before = after, c
    return "".join(done) + max((s + model[a, b, 0], t) for (a, b), (s, t) in states.items())[1]


def restored(token: str, model: np.ndarray) -> set[str]:
    """What a token of lower-cased text may be: itself without marks at its ends, and decoded if it looks obfuscated.

    A token that begins with a zero byte is a run of pieces with blanks between them.
    """
    if token[:1] == "\0":
        return {x for x in decode(" ".join(token[1:].split()), model).split() if len(x) > 2}
    plain = token.strip(_EDGE)
    found = {plain}
    if _APART.fullmatch(plain):
        plain = re.sub(r"[.\-_*~/]", "", plain)
        found.add(plain)
    body = token.strip(" \t.,;:?\"'()[]{}<>«»“”‘’-–—_/\\=~^`") if any(c in "$@!*|" for c in token) else plain
    for x in {plain, body}:
        if len(x) > 2 and _ODD.search(x) and any(c.isalpha() for c in x):
            found.add(decode(x, model))
    if _TWICE.search(plain):  # the path without repeated letters, which the corpus may make the less likely one
        found.add(_TWICE.sub(r"\1", plain))
    return {x for x in found if len(x) > 2}


def words_of(data: bytes) -> set[str]:
    """The distinct tokens of a text, lower-cased, and the runs of pieces in it that hold single characters, marked by a zero byte.

    Of other runs every two pieces are joined: the path that drops the blank between them and keeps all others.
    """
    text = data.decode("utf-8", "replace").lower()
    own = set(text.split())
    for run in _SPACED.findall(text):
        if _ALONE.search(run):
            own.add("\0" + run)
        else:
            pieces = run.split()
            own.update(map(str.__add__, pieces, pieces[1:]))
    return own


def _parts(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def _evidence(model):
    """(feature, toxic, clean) per partition, each document's key counted once: copies of one text count as one."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: dict[str, list] = {"feature": [], "key": [], "y": []}
            for data, y in zip(b.column("data").to_pylist(), b.column("y").to_pylist(), strict=True):
                words = words_of(data)
                key = min((xxhash.xxh3_64_intdigest(x) >> 1 for x in words), default=0)
                own = {p for t in words for x in restored(t, model.value) for p in _parts(x)}
                out["feature"] += own
                out["key"] += [key] * len(own)
                out["y"] += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out["feature"], pa.string()), pa.array(out["key"], pa.int64()), pa.array(out["y"], pa.int32())], names=["feature", "key", "y"])

    return batches


class Scorer:
    """Toxic weights of words, remembered for each token."""

    def __init__(self, weights: dict[str, float], model: np.ndarray, line: np.ndarray, prior: float):
        self.weights, self.model, self.line, self.prior, self.known = weights, model, line, prior, {}

    def weight(self, token: str) -> float:
        found = max((self.weights.get(p, 0.0) for x in restored(token, self.model) for p in _parts(x)), default=0.0)
        if len(self.known) >= KEPT:
            self.known.clear()
        if len(token) <= 48:
            self.known[token] = found
        return found

    def inputs(self, data: bytes) -> list[float]:
        words = words_of(data)
        known = self.known.get
        top = sorted(filter(None, (self.weight(t) if (w := known(t)) is None else w for t in words)), reverse=True)
        return [1.0, *(top + [0.0, 0.0, 0.0])[:3], float(np.log1p(sum(top)))]

    def __call__(self, data: bytes) -> float:
        if not len(self.line):
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.inputs(data), self.line), -30, 30))))


def _fit_line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[1e-1] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> Scorer:
    """The weights, and the line that turns them into a score, fitted on a fifth of the sample that has no part in the weights."""
    spark = docs.sparkSession
    model = character_model(docs, text_col)
    shared = spark.sparkContext.broadcast(model)
    own = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).groupBy("__id").agg(F.max("y").alias("y"))
    picked = own.where(fold(F.col("__id"), 5) != 0).orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(sample)
    # the sample's size is bounded, so it is broadcast
    rows = docs.select(F.col(id_col), text_bytes(text_col).alias("data")).join(F.broadcast(picked), F.col(id_col) == F.col("__id")).select("__id", "data", "y")
    apart = F.pmod(F.xxhash64(F.lit("line"), F.col("__id").cast("string")), F.lit(5)) == 0
    bounded(spark)
    each = rows.where(~apart).select("data", "y").mapInArrow(_evidence(shared), "feature string, key long, y int").distinct()
    total = rows.where(~apart).agg(F.sum("y"), F.count("*")).first()
    a, b = int(total[0] or 0), int(total[1] - (total[0] or 0))
    weights: dict[str, float] = {}
    prior = (a + 1) / (a + b + 2)
    if not a or not b:
        return Scorer(weights, model, np.empty(0), prior)
    odds = F.log((F.col("t") + 0.5) / (a + 1)) - F.log((F.col("c") + 0.5) / (b + 1))
    counted = each.groupBy("feature").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).withColumn("w", odds)
    strong = counted.where((F.col("t") >= max(LEAST, SHARE * a)) & (F.col("w") >= 2.5))
    weights = {r["feature"]: r["w"] for r in strong.orderBy(F.desc(F.col("t") * F.col("w")), "feature").limit(WEIGHTS).collect()}
    rater = spark.sparkContext.broadcast(Scorer(weights, model, np.empty(0), prior))

    def inputs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([rater.value.inputs(x) for x in b.column("data").to_pylist()], pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    known = rows.where(apart).select("data", "y").mapInArrow(inputs, "x array<double>, y int").collect()
    x, y = np.array([r[0] for r in known]).reshape(len(known), 5), np.array([r[1] for r in known], float)
    if not 0 < y.sum() < len(y):  # too few to fit a line to: two strong words are toxic
        return Scorer(weights, model, np.array([-3.0, 0.5, 0.5, 0.0, 0.0]), prior)
    return Scorer(weights, model, _fit_line(x, y), prior)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score) of every row, texts scored whole; learned from labelled rows that aren't held out.

    Held out are rows whose crc32(id as text) mod 5 is 0. An id with two labels counts as label 1. Null labels aren't learned from; null and empty texts have
    no toxic words; without labels of both kinds every score is the smoothed share of label 1. Repeated rows give
    repeated rows; an empty table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    own = spark.sparkContext.broadcast(learned(docs, labels, id_col, text_col, label_col, sample))
    source = bounded(spark) and docs.select(F.col(id_col), F.coalesce(fold(F.col(id_col), 5) == 0, F.lit(False)).alias("held_out"), text_bytes(text_col).alias("data"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(id_col), b.column("held_out"), pa.array(list(map(own.value, b.column("data").to_pylist())), pa.float64())], names=[id_col, "held_out", "score"])

    return source.mapInArrow(batches, T.StructType([*source.schema.fields[:2], T.StructField("score", T.DoubleType())]))

"""Packing documents into training sequences along a space-filling curve.

Every document becomes a vector of hashed token counts, projected to DIMS dimensions; the Hilbert key of its cell orders the
corpus so that neighbours on the curve have similar vectors. The documents are range-sorted by that key and laid end
to end; a running sum in each range and the sums of the ranges before it give each document its place, and cuts
at every ``size`` tokens give the sequences. What is left at the end is cut at its binary digits, so that no sequence needs padding.
"""

from __future__ import annotations

import contextlib
import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, forget, stored

#: Buckets of hashed tokens, dimensions of the curve, bits of a dimension, and deviations on either side that the cells span.
BUCKETS, DIMS, BITS, SPAN = 256, 4, 15, 4.0
#: Words kept with their ids by a worker, characters of such a word, and tokens in one range of the sort.
WORDS, WORD_CHARS, RANGE_TOKENS = 400_000, 40, 1 << 24
#: Characters encoded in one call, of a word that has calls of its own, and of the texts worked on at once.
CALL_CHARS, LONG, SLICE = 100_000, 10_000, 1 << 19
#: Within words too long to keep, places where no token and no normal form reaches across.
_SAFE = re.compile(r"(?<=[0-9。、，])(?=[A-Za-zぁ-ゖァ-ヺ一-鿿])")

#: Words that any normal form and lower-casing leave alone; characters outside those of which capitals are the plain ones of a small letter; signs after letters.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_SIMPLE = re.compile("[^\x00-\xff\u2013-\u2026\u3001\u3002\u4e00-\u9fff]")
_SIGNS = re.compile(r"[.,;:!?](?<=[a-zß-öø-ÿ].)[.,;:!?]*(?=[ \n]|$)")


class _Words(dict):
    """Word -> its ids as little-endian unsigned numbers of ``width`` bytes.

    New words are encoded many in one call: words of small letters of Latin-1, which no normaliser changes and every
    tokenizer with word ends takes whole, set apart by blanks and told apart by those ends; any others set apart by a special token,
    which ends a word as the end of a text does.
    """

    def __init__(self, path: str):
        super().__init__()
        self.model, self.bare = tokenizers.Tokenizer.from_file(path), tokenizers.Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.width = 2 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.marks = {t.content: i for i, t in self.model.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        suffix, vocabulary = getattr(self.model.model, "end_of_word_suffix", None), self.model.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def encoded(self, text: str, model: tokenizers.Tokenizer | None = None) -> np.ndarray:
        return np.array((model or self.model).encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")

    def learn(self, words: list[str]) -> None:
        """Enter the ids of words."""
        mark, number = next(iter(self.marks.items()), ("", -1))
        plain = [w for w in words if _LETTERS.fullmatch(w) and len(w) < LONG] if self.last.any() else []
        rest = set(words).difference(plain)
        alone = [w for w in rest if len(w) >= LONG or not mark or any(m in w for m in self.marks)]
        for word in alone:
            parts = [word] if len(word) < LONG else _SAFE.split(word)
            self[word] = b"".join(self.encoded(part).tobytes() for part in parts)
        left = []
        for group in _groups(plain):
            ids = self.encoded(" ".join(group), self.bare)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                self._enter(group, ids, [0, *ends.tolist()], ends.tolist())
            else:
                left += group
        for group in _groups(list(rest.difference(alone)) + left):
            ids = self.encoded(mark.join(group))
            at = np.flatnonzero(ids == number).tolist()
            self._enter(group, ids, [0, *(i + 1 for i in at)], [*at, len(ids)])

    def _enter(self, group: list[str], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        raw, width = ids.tobytes(), self.width
        for word, start, end in zip(group, starts, ends, strict=False):
            self[word] = raw[start * width : end * width]


def _groups(words: list[str]) -> Iterator[list[str]]:
    """Words in lists of about CALL_CHARS characters."""
    group, chars = [], 0
    for word in words:
        group.append(word)
        chars += len(word)
        if chars > CALL_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


@functools.lru_cache(1)
def _words(path: str) -> _Words:
    return _Words(path)


def _split(text: str) -> list[str]:
    """Words of a text. Blanks end words for the tokenizer too, and so does a change from letters to signs; it reads capitals of the letters that _SIMPLE leaves as small ones."""
    if not _SIMPLE.search(text) and "<|" not in text:
        text = _SIGNS.sub(r" \g<0>", text.lower())
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def token_ids(texts: list[str], words: _Words) -> list[bytes]:
    """The ids of texts, each word encoded once."""
    split = [_split(text) for text in texts]
    found = [list(map(words.get, own)) for own in split]
    gaps = [list(_nones(row)) for row in found]
    new = {own[i] for own, at in zip(split, gaps, strict=True) for i in at}
    room = WORDS - len(words)
    words.learn(list(new))
    for own, row, at in zip(split, found, gaps, strict=True):
        for i in at:
            row[i] = words[own[i]]
    for word in new:  # what isn't kept goes when the batch is done
        room -= len(word) <= WORD_CHARS
        if room < 0 or len(word) > WORD_CHARS:
            del words[word]
    return [b"".join(row) for row in found]


def _nones(row: list) -> Iterator[int]:
    at = -1
    with contextlib.suppress(ValueError):
        while True:
            at = row.index(None, at + 1)
            yield at


@functools.lru_cache(1)
def _projection(seed: int = 12) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(BUCKETS, DIMS))


@functools.lru_cache(1)
def _buckets() -> np.ndarray:
    """Bucket of every token id, by its last 16 bits; BUCKETS more for those that count as negative."""
    mixed = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS + np.where(mixed >> np.uint64(20) & np.uint64(1), 0, BUCKETS)


def cells_of(token_lists: list[np.ndarray]) -> np.ndarray:
    """Cells of documents: token counts hashed to BUCKETS with signs, damped by logarithms, normalised and projected to DIMS dimensions."""
    counts = np.zeros((len(token_lists), 2, BUCKETS))
    for c, ids in zip(counts, token_lists, strict=True):
        c[:] = np.bincount(_buckets().take(ids if ids.itemsize == 2 else ids & 0xFFFF), minlength=2 * BUCKETS).reshape(2, BUCKETS)
    vectors = counts[:, 0] - counts[:, 1]
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    at = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0) @ _projection()
    return np.clip((at + SPAN) * (1 << BITS) / (2 * SPAN), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (a row each) with ``bits`` bits a dimension: rotations undone from the top bit, then Gray code."""
    x = cells.T.astype(np.int64).copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in x:
            turned = (axis >> b & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, 0)
            x[0] ^= swap
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= flips
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> b & 1
    return key


def cuts(total: int, size: int) -> tuple[int, list[int]]:
    """(first token after the whole sequences, starts of the sequences after it): the rest is cut at its binary digits, the largest first."""
    whole = total - total % size
    starts, at = [], whole
    for b in range((total - whole).bit_length() - 1, -1, -1):
        if (total - whole) >> b & 1:
            starts.append(at)
            at += 1 << b
    return whole, starts


def pieces_of(first: int, n: int, total: int, size: int) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset there) of a document that holds the places first .. first + n - 1."""
    whole, tail = cuts(total, size)
    out, at = [], first
    while at < first + n:
        if at < whole:
            sequence, begin = divmod(at, size)[0], at - at % size
            end = begin + size
        else:
            k = bisect_right(tail, at) - 1
            sequence, begin, end = whole // size + k, tail[k], tail[k + 1] if k + 1 < len(tail) else total
        length = min(end, first + n) - at
        out.append((at - first, length, sequence, at - begin))
        at += length
    return out


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some SLICE bytes of text: what is held of a part's words is many times its text."""
    start, ends = 0, np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))
    while start < b.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE)))
        yield b.slice(start, end - start)
        start = end


def packed(docs: DataFrame, path: str, size: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids are little-endian unsigned 32-bit numbers.

    A document's ids are those of the tokenizer file at ``path`` without special tokens, then ``end``; start counts the
    document's ids before the piece, and pieces lie in their sequence without gaps. All sequences have ``size`` ids but the
    last few, whose lengths are different powers of two if ``size`` is one. Null texts count as empty and have one id; repeated rows and null ids are packed as
    any. Texts are whole; ties on the curve go by id, then by row, so that copies of any number are dealt to
    many ranges. An empty table gives an empty one.
    """
    spark = bounded(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = named.schema["id"].dataType.simpleString()

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        kept, last = f"<u{words.width}", np.array([end], f"<u{words.width}").tobytes()
        for b in (part for whole in it for part in _slices(whole)):
            ids = [i + last for i in token_ids(b.column("text").to_pylist(), words)]
            key = hilbert(cells_of([np.frombuffer(i, kept)[:-1] for i in ids]), BITS)
            n = np.array([len(i) // words.width for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(key), pa.array(n), pa.array(ids, pa.binary())], names=["id", "key", "n", "ids"])

    tokens = stored(named.mapInArrow(encoded, f"id {kind}, key long, n long, ids binary").withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_TOKENS))

    def laid(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for b in it:
            n = b.column("n").to_numpy()
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), b.column("ids"), pa.array(np.full(len(n), part, np.int32)), pa.array(first)], names=["id", "n", "ids", "part", "first"])

    sorted_ = tokens.repartitionByRange(ranges, "key", "id", "row").sortWithinPartitions("key", "id", "row")
    placed = stored(sorted_.select("id", "n", "ids").mapInArrow(laid, f"id {kind}, n long, ids binary, part int, first long"), "placed")
    forget(tokens)
    held = dict(placed.groupBy("part").agg(F.sum("n")).collect())  # a row for each range
    before, at = {}, 0
    for part in sorted(held):
        before[part], at = at, at + held[part]
    starts = spark.sparkContext.broadcast(before)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _words(path).width
        for b in it:
            rows = []
            for i, n, ids, part, first in zip(*(b.column(c).to_pylist() for c in ("id", "n", "ids", "part", "first")), strict=True):
                whole = np.frombuffer(ids, f"<u{width}").astype("<u4")
                rows += [(i, s, k, whole[s : s + k].tobytes(), n, q, o) for s, k, q, o in pieces_of(starts.value[part] + first, n, total, size)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = b.schema.field("id").type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    out = placed.mapInArrow(cut, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """(sequence_id, ids, n_ids, padding) from the pieces: ids joined by offset; padding up to ``size`` but for a power of two. No group holds more than ``size`` ids."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = pieces.groupBy("sequence_id").agg(F.aggregate(joined, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.sum("length").alias("n_ids"))
    power = F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0
    return out.withColumn("padding", F.when(power, 0).otherwise(size - F.col("n_ids")).cast("long"))

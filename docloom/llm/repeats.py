"""Repeated byte strings: maximal repeats from the common-prefix interval tree of an enhanced, sparse suffix array.

Every window of ``length`` bytes has an anchor: its 40-byte string of least hash, the leftmost of equals. Equal windows
have equal anchors at equal places, so only suffixes that start at anchors are needed, and windows are compared only
where anchors are equal. A run is a stretch of windows with one anchor, its text the bytes that they cover.

1. Every run goes by anchor to one place. Runs with equal text are repeats as they are.
2. For anchors with different texts, one context of each text is fetched. Sorted by what follows the anchor they are a
   suffix array; a stack scan over neighbours' common prefixes gives the interval tree; within an interval the common
   left extensions are told apart, which gives maximal repeats with all their occurrences.
3. The texts of an anchor with more than MOST of them are split: windows that reach far to the left go by what stands
   there, the others by what stands to the right, and again, halving the range of windows, until a group is small
   enough for 2 or has one window left, whose bytes are compared in sorted order.

What repeats within a partition is folded before the shuffle, so copies of one text don't meet in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, bounded, stored, text_bytes

#: Bytes of an anchor, texts of an anchor that one task gathers, bytes hashed at once, runs remembered for folding.
ANCHOR, MOST, PIECE, SEEN = 40, 20_000, 1 << 20, 1_000_000

_MASK = np.uint64((1 << 24) - 1)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 5
_Q = pow(_P, -1, 1 << 64)
_ROWS = "a long, u long, k1 long, k2 long, s int, l short, r short, dup boolean"
_NAMES = ["a", "u", "k1", "k2", "s", "l", "r", "dup"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any substring of some bytes: differences of sums of bytes times powers."""

    powers = np.cumprod(np.r_[np.uint64(1), np.full(PIECE + 8192, _P, np.uint64)], dtype=np.uint64)
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(PIECE + 8192, _Q, np.uint64)], dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        self.sums = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * self.powers[: len(data)], dtype=np.uint64)]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of all texts: each run's text number, start, bytes before the anchor, windows, anchor's hash, and text's hash."""
    found = []
    pieces = [(i, at) for i, x in enumerate(texts) for at in range(0, max(0, len(x) - length + 1), PIECE)]
    group: list[tuple[int, int, bytes]] = []
    total = 0
    for n, (i, at) in enumerate(pieces):
        part = texts[i][at : at + PIECE + length - 1]
        group.append((i, at, part))
        total += len(part)
        if total >= PIECE // 2 or n + 1 == len(pieces):
            found.append(_runs_of(group, length))
            group, total = [], 0
        elif total + min(PIECE + length, len(texts[pieces[n + 1][0]]) - pieces[n + 1][1]) > PIECE + 4096:
            found.append(_runs_of(group, length))
            group, total = [], 0
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs_of(group: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
    sizes = np.array([len(x[2]) for x in group])
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    hashes = _Hashes(data)
    at = np.arange(len(data) - ANCHOR + 1)
    least = (hashes(at, at + ANCHOR) & ~_MASK) | at.astype(np.uint64)
    width, span = 1, length - ANCHOR + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    own = np.repeat(np.arange(len(group)), np.maximum(sizes - length + 1, 0))
    start = np.arange(len(own)) - np.repeat(np.r_[0, np.cumsum(np.maximum(sizes - length + 1, 0))[:-1]], np.maximum(sizes - length + 1, 0)) + base[own]
    anchor = (least[start] & _MASK).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])]) if len(own) else np.empty(0, np.int64)
    n = np.diff(np.r_[first, len(own)])
    s, a, g = start[first], anchor[first], own[first]
    whole = hashes(s, s + n + length - 1)
    text = _mix(whole * np.uint64(31) + (a - s).astype(np.uint64) * np.uint64(1 << 32) + n.astype(np.uint64))
    number, shift = np.array([x[0] for x in group]), np.array([x[1] for x in group])
    return number[g], s - base[g] + shift[g], a - s, n, hashes(a, a + ANCHOR), text


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=_NAMES)


def _fold(found: Iterator[tuple], seen: dict[tuple[int, int], bool]) -> list[tuple]:
    """Rows to deal by anchor. Of equal texts in a partition the first two go; of the others the answer is known.

    Those are marked and dealt by where they stand.
    """
    out = []
    for a, u, k1, k2, s, l, r in found:
        if (twice := seen.get((a, u))) is None:
            if len(seen) >= SEEN:
                seen.clear()
            seen[a, u] = False
        elif twice:
            out.append((hash((k1, k2, s)), u, k1, k2, s, l, r, True))
            continue
        else:
            seen[a, u] = True
        out.append((a, u, k1, k2, s, l, r, False))
    return out


def _run_rows(length: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], bool] = {}
        for b in it:
            i, s, l, n, a, u = runs(b.column("data").to_pylist(), length)
            k1, k2 = (b.column(c).to_numpy()[i].tolist() if len(i) else [] for c in ("k1", "k2"))
            yield _batch(_fold(zip(a.view(np.int64).tolist(), u.view(np.int64).tolist(), k1, k2, s.tolist(), l.tolist(), n.tolist(), strict=True), seen))

    return batches


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and text: all whose text repeats, marked; one of each text of anchors with several.

    A group of any size passes with one row kept back. kind: 0 repeats, 1 and 2 are texts to compare, 2 if it repeats.
    """
    kept: list | None = None  # the last row
    several = twice = False  # whether its anchor has other texts; whether its text has occurred before
    for b in batches:
        out = []
        for row in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True):
            if row[7]:
                out.append((0, *row[:7]))
                continue
            if kept is not None:
                same = kept[0] == row[0] and kept[1] == row[1]
                if same or twice:
                    out.append((0, *kept))
                if not same:
                    if several or kept[0] == row[0]:
                        out.append((1 + twice, *kept))
                    several = kept[0] == row[0]
                twice = same
            kept = row[:7]
        yield _answer(out)
    if kept is not None:
        yield _answer([*([(0, *kept)] if twice else []), *([(1 + twice, *kept)] if several else [])])


def _answer(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["kind", *_NAMES[:7]])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(suffixes: list[bytes]) -> list[tuple[int, int, int]]:
    """(common prefix, first, end) of every interval of sorted suffixes: a stack scan over neighbours' common prefixes."""
    out, stack = [], []
    for i in range(1, len(suffixes) + 1):
        height = _common(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else -1
        first = i - 1
        while stack and stack[-1][0] > height:
            top, first = stack.pop()
            out.append((top, first, i))
        if height >= 0 and (not stack or stack[-1][0] < height):
            stack.append((height, first))
    return out


def maximal_repeats(contexts: list[tuple[bytes, bytes]], length: int) -> list[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of every maximal repeat of at least ``length`` bytes.

    contexts: (reversed bytes before the anchor, bytes from it on). An interval's members have a common right extension;
    sorted by what stands before the anchor, a second scan gives their common left extensions. A group is put out where
    neither extension could be longer with the same members.
    """
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    by_left = sorted(range(len(contexts)), key=lambda i: contexts[i][0])
    rank = {x: i for i, x in enumerate(by_left)}
    groups = []
    for right, first, end in intervals([contexts[i][1] for i in order]):
        members = sorted(order[first:end], key=rank.__getitem__)
        for left, lo, hi in intervals([contexts[i][0] for i in members]):
            if left + right < length:
                continue
            inner = members[lo:hi]
            ends = {contexts[i][1][right : right + 1] for i in inner}
            if len(ends) > 1 or ends == {b""}:  # else a deeper interval has the same members
                groups.append((left, right, inner))
    return groups


def _suffixes(length: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of contexts sorted by anchor: occurrences of maximal repeats. At most MOST contexts have one anchor."""
        group: list[tuple] = []
        for b in it:
            out: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("a", "k1", "k2", "s", "l", "data", "dup")), strict=True):
                if group and group[0][0] != row[0]:
                    out += _spans(group, length)
                    group = []
                group.append(row)
            yield _spans_batch(out)
        yield _spans_batch(_spans(group, length))

    return batches


def _spans(group: list[tuple], length: int) -> list[tuple]:
    if len(group) < 2:
        return []
    contexts = [(x[5][: x[4]][::-1], x[5][x[4] :]) for x in group]
    reach: dict[int, tuple[int, int]] = {}  # all of a context's repeats hold its anchor, so their union is one span
    for left, right, members in maximal_repeats(contexts, length):
        for i in members:
            if not group[i][6]:
                most = reach.get(i, (0, 0))
                reach[i] = (max(most[0], left), max(most[1], right))
    return [(group[i][1], group[i][2], group[i][3] + group[i][4] - left, group[i][3] + group[i][4] + right) for i, (left, right) in reach.items()]


def _spans_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["k1", "k2", "s", "e"])


def _contexts(length: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of texts with the runs asked for: each run's bytes."""
        names = ["a", "k1", "k2", "s", "l", "data", "dup"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
        for b in it:
            out = []
            for data, k1, k2, asked in zip(*(b.column(c).to_pylist() for c in ("data", "k1", "k2", "asked")), strict=True):
                out += [(x["a"], k1, k2, x["s"], x["l"], data[x["s"] : x["s"] + x["r"] + length - 1], x["kind"] == 2) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

    return batches


def _same_window(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by group and their one window: spans of those equal to another. One row is kept back."""
    last, waiting = None, None
    for b in it:
        out = []
        for g, window, k1, k2, at, dup in zip(*(b.column(c).to_pylist() for c in ("a", "w", "k1", "k2", "at", "dup")), strict=True):
            if (g, window) != last:
                last, waiting = (g, window), None
                if not dup:  # else it is known as a repeat
                    waiting = (k1, k2, at, at + len(window))
                continue
            if waiting:
                out.append(waiting)
                waiting = None
            if not dup:
                out.append((k1, k2, at, at + len(window)))
        yield _spans_batch(out)


def _split_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the contexts' repeats. Columns lo and ro say how much before and from the anchor a group has in common.

    Of the windows left to a group, from ``lo`` to ``length - ro`` bytes before the anchor, those with at least the
    middle of that before it go by these bytes, the others by those behind: each pair that shares a window meets.
    """
    spark, spans = contexts.sparkSession, []
    now = contexts.withColumns({"lo": F.lit(0), "ro": F.lit(ANCHOR)})
    while True:
        sized = now.join(now.groupBy("a").agg(F.count("*").alias("n")), "a")
        if spans:  # few contexts are left, and each of the parts below would join them again
            sized = stored(sized, "hot-sizes")
        small = sized.where(F.col("n").between(2, MOST)).select("a", "k1", "k2", "s", "l", "data", "dup")
        last = (F.col("n") > MOST) & (F.col("lo") + F.col("ro") == length)
        window = F.expr(f"substring(data, l - lo + 1, {length})")
        alone = sized.where(last).select("a", window.alias("w"), "k1", "k2", (F.col("s") + F.col("l") - F.col("lo")).alias("at"), "dup")
        with batch_rows(spark, 5000):
            near = small.repartition("a").sortWithinPartitions("a").mapInArrow(_suffixes(length), "k1 long, k2 long, s int, e int")
            same = alone.repartition("a", F.xxhash64("w")).sortWithinPartitions("a", "w").mapInArrow(_same_window, "k1 long, k2 long, s int, e int")
            spans.append(stored(near.unionByName(same), "spans"))
        many = sized.where((F.col("n") > MOST) & (F.col("lo") + F.col("ro") < length)).drop("n")
        many = many.withColumn("lm", F.expr(f"lo + ({length} - lo - ro + 1) div 2").cast("int")).withColumn("rm", length + 1 - F.col("lm"))
        left = many.where("l >= lm").withColumns({"a": F.xxhash64("a", F.lit(0), F.expr("substring(data, l - lm + 1, lm)")), "lo": F.col("lm")})
        right = many.where("length(data) - l >= rm").withColumns({"a": F.xxhash64("a", F.lit(1), F.expr("substring(data, l + 1, rm)")), "ro": F.col("rm")})
        now = stored(left.unionByName(right).drop("lm", "rm"), "hot-contexts")
        if now.isEmpty():
            return functools.reduce(DataFrame.unionByName, spans)


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(k1, k2, s, e): bytes from s to e of the document with that key are part of a repeat of at least ``length`` bytes.

    docs: columns k1, k2 (the key; equal only for equal rows) and data, the bytes.
    """
    spark = bounded(docs.sparkSession)
    source = docs.select("k1", "k2", "data")
    rows = source.where(F.length("data") >= length).mapInArrow(_run_rows(length), _ROWS)
    with batch_rows(spark, 20_000):
        met = stored(rows.repartition("a").sortWithinPartitions("a", "u").mapInArrow(_compared, "kind byte, a long, u long, k1 long, k2 long, s int, l short, r short"), "runs")
    whole = met.where("kind = 0").select("k1", "k2", "s", F.expr(f"s + r + {length - 1}").alias("e"))
    asked = met.where("kind > 0").groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "s", "l", "r", "kind")).alias("asked"))
    wanted = source.repartition("k1", "k2").join(asked.hint("shuffle_hash"), ["k1", "k2"])
    contexts = stored(wanted.select("k1", "k2", "data", "asked").mapInArrow(_contexts(length), "a long, k1 long, k2 long, s int, l int, data binary, dup boolean"), "contexts")
    return whole.unionByName(_split_spans(contexts, length))


def _id_key(docs: DataFrame, id_col: str) -> Column:
    """A whole number for each id: the id itself if it is one, else its text's hash; null ids share one."""
    own = F.col(id_col)
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    return F.coalesce(own.cast("long") if whole else F.xxhash64(own.cast("string")), F.lit(-(1 << 63)))


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary): what is left of each text's bytes without the repeated ones.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another.
    Null and empty texts have no bytes. A repeated row counts as another document, so its text goes; rows with a null
    id and rows that share an id are told apart by their texts. An empty table gives an empty one.
    """
    source = docs.select(F.col(id_col), _id_key(docs, id_col).alias("k1"), F.xxhash64(text_bytes(text_col)).alias("k2"), text_bytes(text_col).alias("data"))
    spans = repeated_spans(source, length).groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    joined = source.repartition("k1", "k2").join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select(id_col, "data", "spans")
    bounded(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for data, spans in zip(b.column("data").to_pylist(), b.column("spans").to_pylist(), strict=True):
                kept, at, n = [], 0, 0
                end = -1
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if s > end:
                        if end >= 0:
                            at = end
                        kept.append(data[at:s])
                        n += 1
                        end = e
                    else:
                        end = max(end, e)
                kept.append(data[max(end, 0) :])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), n, left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(batches, T.StructType([source.schema[id_col], *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept binary").fields]))

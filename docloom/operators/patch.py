"""Ordered change plans applied to documents: each change sees the text that the ones before have left."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.batches import bounded

APPLIED, APPROXIMATE, DELETED, INSERTED, NOT_APPLIED, CONFLICT = "applied", "applied (approximate match)", "deleted", "inserted", "not applied", "conflict"

_OUT = "text string, results array<struct<seq:int,state:string,detail:string>>"
_QUOTES = str.maketrans({**dict.fromkeys("\"'«»“”‘’`", ""), **dict.fromkeys("–—−‐", "-")})


def loose(text: str) -> str:
    """Without case, accents, quotes, kinds of dashes, runs of space, and stops at the ends."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return " ".join(plain.translate(_QUOTES).split()).strip("' .")


#: A heading's code or number, of which the first figures count, and what sets it apart from the title. Fixed value.
_NUMBER = re.compile(r"(?:(?:obs|c)-)?(\d+)(?:\.\d+)*\b\s*[.):·–-]*\s*")
#: Least likeness of a heading to the section asked for, and that of one whose words hold the other's. Fixed values.
LEAST_LIKE, HOLDS = 0.6, 0.9
_STOP = re.compile(r"(?<=[.!?])\s+")


class Section(NamedTuple):
    title: str
    level: int
    start: int
    end: int


def sections(text: str) -> list[Section]:
    """Every section of a Markdown text, each up to the next heading of its level or above, in one pass over its lines."""
    out: list[Section] = []
    open_: list[int] = []  # places in out of sections that haven't ended, the innermost last
    at = 0
    for line in text.split("\n"):
        marks = len(line) - len(line.lstrip("#"))
        if marks and line[marks : marks + 1].isspace():
            while open_ and out[open_[-1]].level >= marks:
                k = open_.pop()
                out[k] = out[k]._replace(end=at)
            open_.append(len(out))
            out.append(Section(line[marks:].strip(), marks, at, len(text)))
        at += len(line) + 1
    return out


def likeness(title: str, asked: str) -> float:
    """How like a heading is to the section asked for: 0 if both have numbers and they differ as numbers, 1 if they say the same."""
    title, asked = loose(title), loose(asked.strip().lstrip("#"))
    if not asked or title == asked:
        return float(bool(asked))
    (number, words), (other, wanted) = _numbered(title), _numbered(asked)
    if number and other and number != other:
        return 0.0
    held = bool(wanted) and (wanted in words or words in wanted)
    ratios = (SequenceMatcher(None, x, y).ratio() for x, y in ((title, asked), (words, wanted)))
    return max(HOLDS * held, *ratios)


def _numbered(heading: str) -> tuple[str, str]:
    m = _NUMBER.match(heading)
    return (str(int(m[1])), heading[m.end() :]) if m else ("", heading)


def section_range(text: str, section: str) -> tuple[int, int] | None:
    """Where the section most like the one asked for stands, the first of equals; None if none is like enough."""
    like = [(likeness(x.title, section), -x.start, x.end) for x in sections(text)]
    score, start, end = max(like, default=(0.0, 0, 0))
    return (-start, end) if score >= LEAST_LIKE else None


def _pieces(text: str) -> set[tuple[int, int]]:
    """Places of all lines and of all sentences within lines, without white space at their ends."""
    out, at = set(), 0
    for line in text.split("\n"):
        cuts = [0, *(m.end() for m in _STOP.finditer(line)), len(line)]
        for lo, hi in {(0, len(line)), *pairwise(cuts)}:
            part = line[lo:hi]
            if part.strip():
                start = at + lo + len(part) - len(part.lstrip())
                out.add((start, start + len(part.strip())))
        at += len(line) + 1
    return out


def locate(text: str, fragment: str) -> tuple[list[tuple[int, int]], bool]:
    """Where a fragment stands, and whether only approximately.

    White space may differ, unless it stands somewhere just so. If it stands nowhere: whole lines and sentences that
    differ from it in case, accents, quotes or dashes alone.
    """
    words = fragment.split()
    if not words:
        return [], False
    found = [m.span() for m in re.finditer(r"\s+".join(map(re.escape, words)), text)]
    just_so = [(i, j) for i, j in found if text[i:j] == fragment.strip()]
    if found:
        return just_so or found, False
    want = loose(fragment)
    return sorted(x for x in _pieces(text) if loose(text[slice(*x)]) == want), True


def apply_plan(text: str, changes: list[dict]) -> tuple[str, list[dict]]:
    """The patched text and a result for each change, in the order of seq."""
    results, touched = [], []  # touched: (seq, text that a change has replaced)
    for c in sorted(changes, key=lambda x: x["seq"]):
        old, new, after = (c.get(k) or "" for k in ("old", "new", "insert_after"))

        def done(state: str, detail: str = "", seq: int = c["seq"]) -> None:
            results.append({"seq": seq, "state": state, "detail": detail})

        low, high = 0, len(text)
        if (c.get("section") or "").strip():
            span = section_range(text, c["section"])
            if span is None:
                done(NOT_APPLIED, f"section «{c['section']}» not found")
                continue
            low, high = span
        anchor = old or after
        if not anchor:
            done(NOT_APPLIED, "neither a text to replace nor a place to insert")
            continue
        found, approximate = locate(text[low:high], anchor)
        if len(found) != 1:
            earlier = next((s for s, t in touched if t == anchor or len(anchor) > 20 and (anchor in t or t in anchor)), None) if not found else None
            if earlier is not None:
                done(CONFLICT, f"change {earlier} has already replaced this text")
            else:
                done(NOT_APPLIED, f"found {len(found)} times" if found else "text not found")
            continue
        at, end = low + found[0][0], low + found[0][1]
        if old:
            touched.append((c["seq"], text[at:end]))
            text = text[:at] + new + text[end:]
            done(DELETED if not new else APPROXIMATE if approximate else APPLIED)
        else:
            text = text[:end] + new + text[end:]
            done(INSERTED)
    return text, results


def apply_changes(docs: DataFrame, changes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, results) of every document. changes: key, seq, section, old, new, insert_after.

    A document's plan is gathered next to its text (a plan is what a person writes); documents without one stay as they are.
    """
    plans = changes.groupBy(key).agg(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "section", "old", "new", "insert_after")).alias("_plan"))
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(plans, key, "left")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.list_(pa.struct([("seq", pa.int32()), ("state", pa.string()), ("detail", pa.string())])))
        for b in it:
            out = [apply_plan(t, p or []) for t, p in zip(b.column("_text").to_pylist(), b.column("_plan").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=[key, "text", "results"])

    return bounded(rows).mapInArrow(batches, f"{key} {docs.schema[key].dataType.simpleString()}, {_OUT}")

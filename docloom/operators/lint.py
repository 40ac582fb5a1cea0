"""Rule-based linting: rules are data; a text's words are read once, whatever the number of rules, and nothing shuffles."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.functions.batches import bounded
from docloom.operators import segment

if TYPE_CHECKING:
    from docloom.operators.rules import Style

#: Parts that each fragment's documents are dealt to before the first ones are chosen.
PARTS = 64


@dataclass(frozen=True)
class Rule:
    term: str
    kind: str = "forbidden"
    severity: str = "error"
    message: str = ""
    suggestion: str = ""
    lang: str | None = None  # texts in this language only


_WORD = re.compile(r"\w+", re.ASCII)


def _folded(term: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", term.lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"[^\W\d_]", lambda m: m[0] if m[0].isascii() else "z", plain)


class _Matcher:
    """Finds all rules' terms in one pass over a text's words: a word leads to the terms that begin with it."""

    def __init__(self, rules: list[Rule], by_lang: bool):
        self.by_lang = by_lang
        self.first: dict[str | None, dict[str, list[tuple[int, str]]]] = {}
        self.odd: list[tuple[int, str | None, re.Pattern]] = []  # terms that don't begin with a word
        for n, r in enumerate(rules):
            term, lang = _folded(r.term), r.lang if by_lang else None
            if m := _WORD.match(term):
                self.first.setdefault(lang, {}).setdefault(m[0], []).append((n, term))
            elif term:
                self.odd.append((n, lang, re.compile(rf"\b{re.escape(term)}\b", re.ASCII)))

    def find(self, text: str, lang: str | None) -> list[tuple[int, int, int]]:
        """(rule, place, length) in order of places, then rules; occurrences of one rule don't overlap."""
        tables = [t for t in (self.first.get(None), self.first.get(lang) if lang is not None else None) if t]
        out, done = [], {}
        for m in _WORD.finditer(text) if tables else ():
            for table in tables:
                for n, term in table.get(m[0], ()):
                    at, end = m.start(), m.start() + len(term)
                    inner = end == m.end() or text.startswith(term, at) and (term[-1:].isalnum() or term[-1] == "_") != (end < len(text) and bool(_WORD.match(text, end)))
                    if inner and at >= done.get(n, 0):
                        out.append((n, at, len(term)))
                        done[n] = end
        out += [(n, m.start(), len(m[0])) for n, own, pattern in self.odd if own in (None, lang) for m in pattern.finditer(text)]
        return sorted(out, key=lambda x: (x[1], x[0]))


def _hits(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str, lang_col: str | None, counted: bool) -> DataFrame:
    """(id, rule, at, fragment) of every match, or (id, rule, n) of every rule that matches."""
    matcher = _Matcher(rules, lang_col is not None)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(X.for_words(F.col(text_col)), F.lit("")).alias("norm"), lang.alias("lang"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, places = [], []
            for place, (text, norm, own) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "norm", "lang")), strict=True)):
                found = matcher.find(norm, own)
                each = sorted(Counter(n for n, _, _ in found).items()) if counted else [(n, at, text[at : at + size]) for n, at, size in found]
                rows += each
                places += [place] * len(each)
            kinds = (pa.int32(), pa.int64()) if counted else (pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(places, pa.int64())), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", *names])

    names = ["rule", "n"] if counted else ["rule", "at", "fragment"]
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("rule int, n long" if counted else "rule int, at int, fragment string").fields])
    return bounded(source).mapInArrow(batches, out)


def _told(rules: list[Rule], *names: str) -> list[Column]:
    """Columns of the rule that a row's number tells."""
    known = F.array(*(F.struct(*(F.lit(getattr(r, k)).alias(k) for k in names)) for r in rules))
    return [F.element_at(known, F.col("rule") + 1)[k].alias(k) for k in names]


def counts(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """(id, term, kind, severity, n): how often each rule's term stands in each text, where it does."""
    return _hits(docs, rules, id_col, text_col, lang_col, True).select(F.col("id").alias(id_col), *_told(rules, "term", "kind", "severity"), "n")


def findings(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str = "text", lang_col: str | None = None, longest: int | None = None) -> DataFrame:
    """(id, kind, severity, term, pos, fragment, message, suggestion, rule) of every match, and of every sentence of over
    ``longest`` words. Terms are matched without case and accents between word borders; rules may overlap. rule is the
    place of the rule among ``rules``, and their number for sentences; findings of a text are in order by pos, then rule."""
    found = _hits(docs, rules, id_col, text_col, lang_col, False)
    out = found.select(F.col("id").alias(id_col), *_told(rules, "kind", "severity", "term"), F.col("at").alias("pos"), "fragment", *_told(rules, "message", "suggestion"), "rule")
    return out.unionByName(long_sentences(docs, longest, id_col, text_col).withColumn("rule", F.lit(len(rules)))) if longest else out


def record_findings(records: DataFrame, style: Style, id_col: str, fields: list[str], level: str | None = None) -> DataFrame:
    """(id, field, kind, severity, pos, fragment, message, suggestion) of structured findings: fields that are missing, a level that isn't valid, and
    the findings of every text field. pos is -1 where a field as a whole is meant. Fields that the style asks for and the table hasn't count as missing."""
    blank = lambda f: X.strip(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "" if f in records.columns else F.lit(True)
    said = [
        F.struct(
            F.lit(f).alias("field"), F.lit("structure").alias("kind"), F.lit("error" if must else "warning").alias("severity"), F.lit(-1).alias("pos"), F.lit(f).alias("fragment"),
            F.lit(f"Falta el campo obligatorio «{f}» ({told})." if must else f"Campo «{f}» pendiente ({told}).").alias("message"), F.lit("Completar antes de volcar al informe." if must else "").alias("suggestion"), blank(f).alias("hit"),
        )
        for f, told, must in style.fields
    ]
    if level and style.levels:
        value = X.strip(F.regexp_replace(F.coalesce(F.col(level), F.lit("")), r"\(propuesto por el modelo, sin evidencia en PT\)", ""))
        shown = F.concat(F.upper(F.left(value, F.lit(1))), F.lower(F.substring(value, 2, 1 << 30)))
        wrong = F.lit(f"Nivel de riesgo no válido. Valores permitidos: {', '.join(style.levels)}.")
        said.append(F.struct(F.lit(level).alias("field"), F.lit("structure").alias("kind"), F.lit("error").alias("severity"), F.lit(-1).alias("pos"), shown.alias("fragment"), wrong.alias("message"), F.lit("").alias("suggestion"), ((shown != "") & ~shown.isin(style.levels)).alias("hit")))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields)))
    texts = records.select(F.col(id_col).alias("_i"), each.alias("_f")).where(X.strip(F.coalesce("_f.text", F.lit(""))) != "").select(F.struct(F.col("_i").alias("i"), F.col("_f.field").alias("f")).alias("_k"), F.col("_f.text").alias("_t"))
    found = findings(texts, style.rules, "_k", "_t", longest=style.longest)
    prose = found.select(F.col("_k.i").alias(id_col), F.col("_k.f").alias("field"), "kind", "severity", "pos", "fragment", F.concat(F.lit("["), "_k.f", F.lit("] "), "message").alias("message"), "suggestion")
    if not said:
        return prose
    whole = records.select(id_col, F.explode(F.filter(F.array(*said), lambda x: x["hit"])).alias("s")).select(id_col, *(f"s.{c}" for c in prose.columns[1:]))
    return whole.unionByName(prose)


def long_sentences(docs: DataFrame, longest: int, id_col: str, text_col: str = "text") -> DataFrame:
    """Findings for sentences of over ``longest`` words; pos is where the sentence's words first stand."""
    own = docs.select(id_col, F.col(text_col).alias("_text"), F.explode(F.filter(X.sentences(F.col(text_col)), lambda s: F.size(X.words(s)) > longest)).alias("s"))
    return own.select(
        id_col,
        F.lit("long_sentence").alias("kind"),
        F.lit("warning").alias("severity"),
        F.lit("").alias("term"),
        (F.expr("locate(s, _text)") - 1).alias("pos"),
        F.when(F.length("s") > 80, F.concat(F.left("s", F.lit(80)), F.lit("…"))).otherwise(F.col("s")).alias("fragment"),
        F.concat(F.lit("Sentence of "), X.n_words(F.col("s")).cast("string"), F.lit(f" words (limit {longest}).")).alias("message"),
        F.lit("Split it in two or three.").alias("suggestion"),
    )


def markdown_findings(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str = "text", lang_col: str | None = None, longest: int | None = None) -> DataFrame:
    """findings() of each paragraph but headings, labels and bullets removed, with line and paragraph_line."""
    own = segment.paragraphs(docs, id_col, text_col)
    if lang_col:
        own = own.join(docs.select(id_col, lang_col), id_col)
    prose = own.where(~F.ltrim("text").startswith("#"))
    plain = F.regexp_replace(F.regexp_replace("text", r"\*\*[^*]+?:\*\*\s*", ""), r"(?m)^\s*[-*]\s+", "")
    each = prose.withColumn("text", plain).withColumn("_p", F.struct(F.col(id_col).alias("id"), F.col("line").alias("line"), F.col("text").alias("text")))
    found = findings(each, rules, "_p", "text", lang_col, longest)
    line = F.col("_p.line") + F.regexp_count(F.expr("substring(_p.text, 1, greatest(pos, 0))"), F.lit("\n"))
    return found.select(F.col("_p.id").alias(id_col), line.cast("int").alias("line"), F.col("_p.line").alias("paragraph_line"), *[c for c in found.columns if c != "_p"])


def verdict(found: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """(id, errors, warnings, clean) of every document; clean is without errors."""
    n = found.groupBy(id_col).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return docs.select(id_col).join(n, id_col, "left").select(id_col, F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), F.coalesce("warnings", F.lit(0)).cast("long").alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("clean"))


def profile(found: DataFrame, id_col: str) -> DataFrame:
    """(fragment, n, documents, examples, kind, action): how often each fragment is found in texts held to be right.

    examples are the ids of the first three documents; action is what the counts suggest for the rule.
    """
    each = found.groupBy(F.lower("fragment").alias("fragment"), id_col).agg(F.count("*").alias("n"), F.max_by("kind", "pos").alias("kind"))
    grouped = each.groupBy("fragment").agg(F.sum("n").alias("n"), F.count("*").alias("documents"), F.max_by("kind", F.col(id_col)).alias("kind"))
    # first three of each of PARTS parts, then of all: no fragment's documents are ever gathered
    part = F.pmod(F.xxhash64(id_col), F.lit(PARTS))
    some = each.select("fragment", id_col, part.alias("_part"))
    for by in (["fragment", "_part"], ["fragment"]):
        some = some.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(id_col))).where("_place <= 3").drop("_place")
    examples = some.groupBy("fragment").agg(F.array_sort(F.collect_list(id_col)).alias("examples"))
    out = grouped.join(examples, "fragment").select("fragment", "n", "documents", "examples", "kind")
    return out.withColumn("action", F.when((F.col("documents") > 1) | (F.col("n") >= 3), "review the rule").otherwise("look at the context"))


def missing_fields(records: DataFrame, fields: dict[str, bool], id_col: str) -> DataFrame:
    """(id, field, severity) of every empty field: an error if it is required, else a warning."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit("error" if must else "warning").alias("severity"), (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "").alias("empty")) for f, must in fields.items()))
    return records.select(id_col, F.explode(F.filter(each, lambda x: x["empty"])).alias("f")).select(id_col, "f.field", "f.severity")


def outside_domain(records: DataFrame, column: str, valid: list[str], id_col: str) -> DataFrame:
    """(id, value) of records whose value isn't one of the valid ones; empty values aren't judged."""
    value = F.trim(F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), r"\s*\(.*\)\s*$", ""))
    return records.select(id_col, value.alias("value")).where((F.col("value") != "") & ~F.col("value").isin(valid))

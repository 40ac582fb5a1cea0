"""Audit reports as Markdown, read into heads and entries, written from them, and compared.

Reading is an automaton over the lines of an entry. A line that opens a recommendation or the details sets the state whatever it was;
any other keeps it or, once, moves it on: from data lines to prose, from bullets to closing prose. So the
state of every line follows from two ordered windows over its entry, the last line that sets it and whether one since then moves it on.
Sections are spans between headings, entries are numbered in stretches of lines, and a report can be written as rows of lines, so none is
ever in one task as a whole, however long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.durable import kept
from docloom.operators import diff, edits, running

# The words of the format.
INTRODUCTION, SUMMARY, FINDINGS, SUGGESTIONS = "Introducción", "Resumen ejecutivo", "Detalle de conclusiones", "Sugerencias de mejora"
PENDING, NONE = "_(pendiente)_", "_(ninguna)_"
RATING, NEXT_STEPS = "**Evaluación global:**", "**Próximos pasos:**"
DETAILS = "*A continuación, se muestran los detalles descriptivos de la situación anterior:*"
PROPOSED = "(propuesto por el modelo, sin evidencia en PT)"
NEXT_STEPS_TEXT = "Los destinatarios del presente informe deberán remitir su conformidad sobre el mismo al Departamento de Auditoría Interna. En el Anexo se recogerán los planes de acción a implantar para solventar las incidencias identificadas acorde al plazo acordado de implantación."
SUGGESTIONS_TEXT = "A continuación, se muestran las debilidades identificadas para las que, dado su impacto limitado, no se exigirá la elaboración de un plan de acción específico, si bien se exponen para su consideración con el objetivo de mejorar el nivel de control."
LEVELS = ("Crítico", "Alto", "Medio", "Bajo")
#: Column of an entry -> its label in a data line, and other spellings that are read as it.
DATA = {"test": "Prueba", "risk": "Nivel de riesgo", "area": "Área", "owner": "Responsable", "due": "Plazo", "reference": "Ref. recomendación"}
ALSO = {"nivel": "risk", "riesgo": "risk", "ref recomendacion": "reference", "referencia recomendacion": "reference", "referencia": "reference", "ref.": "reference"}
#: Labels that are data lines too but no column of a report's entry.
OTHER = ("fuente", "estado", "tipo", "notas del auditor", "notas", "incidencia detectada", "causa raiz", "como se ha llegado", "consecuencias", "recomendacion", "propuesta de mejora", "propuesta", "incidencia", "causa", "como se ha llegado a ella", "como", "detalles descriptivos", "consecuencia")
DATA_LINE = r"^\s*[-*]\s*([^:]+?)\s*:\s*(.*)$"
OPENING = r"(?iu)^\*\*(?:recomendaci[oó]n|propuesta de mejora|sugerencia de mejora)\s*[\dNX]+(?:\.\d+)?\.?\*\*\s*(.*)$"
BULLET = r"^\s*[-*•/]\s+"

#: Columns of an entry besides its report's id.
ENTRY = ("kind", "number", "title", "test", "risk", "proposed", "area", "owner", "due", "reference", "incidence", "details", "consequences", "recommendation")
#: States of the automaton.
_DATA, _PROSE, _DETAILS, _AFTER, _RECOMMENDATION = range(5)
_PLAIN = {"Prueba": "prueba", "Nivel de riesgo": "nivel de riesgo", "Área": "area", "Responsable": "responsable", "Plazo": "plazo", "Ref. recomendación": "ref. recomendacion"}


def _field(line: Column) -> Column:
    """Column that a data line fills, «other» for one that fills none, null for any other line."""
    known = {_PLAIN[label]: name for name, label in DATA.items()} | ALSO | dict.fromkeys(OTHER, "other")
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.when(F.regexp_like(line, F.lit(DATA_LINE)), F.try_element_at(names, X.fold_label(F.regexp_extract(line, DATA_LINE, 1))))


def lines_of(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line from 0, text): the lines of each report."""
    return docs.select(id_col, F.posexplode(edits.lines_of(F.col(text_col))).alias("line", "text"))


def _sections(rows: DataFrame, id_col: str, parts: tuple[str, ...]) -> DataFrame:
    """Lines of the last section of each of the kinds: (id, part, line, text), without headings of sections.

    Only headings go through a window of the report; the lines of a section are those between its heading and the next.
    """
    marks = rows.where(F.col("text").startswith("## ") | F.regexp_like("text", F.lit("^#(?!#)"))).withColumn("_to", F.lead("line").over(Window.partitionBy(id_col).orderBy("line")))
    title = X.fold_label(F.expr("substring(text, 4)"))
    part = F.when(title.startswith("introduccion"), "introduction").when(title.startswith("resumen"), "summary").when(title.contains("conclusion"), "recommendation").when(title.contains("sugerencia") | title.contains("mejora"), "suggestion")
    named = marks.where(F.col("text").startswith("## ")).select(id_col, part.alias("part"), F.struct(F.col("line").alias("at"), F.col("_to").alias("to")).alias("_s")).where(F.col("part").isin(*parts))
    spans = named.groupBy(id_col, "part").agg(F.max("_s").alias("_s"))
    inside = rows.join(spans, id_col).where((F.col("line") > F.col("_s.at")) & (F.col("_s.to").isNull() | (F.col("line") < F.col("_s.to"))))
    return inside.select(id_col, "part", "line", "text")


def _joined(rows: Column, between: str) -> Column:
    """Texts of an array of (place, text) structs, in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), between)


def parse_heads(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, introduction, summary, rating) of every report; what is missing or pending is empty. Repeated and null ids aren't allowed."""
    return heads_of(lines_of(docs, id_col, text_col), docs.select(id_col), id_col)


def heads_of(lines: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """What parse_heads gives, for the reports of ``ids``, from lines (id, line, text)."""
    rows = _sections(lines, id_col, ("introduction", "summary")).where(~F.ltrim("text").startswith(">"))
    line = X.strip(F.col("text"))
    rating = (F.col("part") == "summary") & line.startswith(RATING)
    shown = ~rating & ~((F.col("part") == "summary") & line.startswith(NEXT_STEPS))
    own = lambda part: F.collect_list(F.when((F.col("part") == part) & shown, F.struct("line", "text")))
    texts = rows.groupBy(id_col).agg(
        X.strip(_joined(own("introduction"), "\n")).alias("introduction"),
        X.strip(_joined(own("summary"), "\n")).alias("summary"),
        F.max_by(F.when(rating, X.strip(F.substr(line, F.lit(len(RATING) + 1)))), F.when(rating, F.col("line"))).alias("rating"),
    )
    blank = lambda c: F.when(F.col(c).isNull() | F.col(c).isin(PENDING, NONE), "").otherwise(F.col(c)).alias(c)
    return ids.join(texts, id_col, "left").select(id_col, blank("introduction"), blank("summary"), F.coalesce("rating", F.lit("")).alias("rating"))


def parse_entries(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, kind, number, title, test, risk, proposed, area, owner, due, reference, incidence, details, consequences, recommendation).

    kind is recommendation or suggestion, by section; number counts its entries from 1. Prose before the details is the incidence, prose after
    them the consequences; text after a recommendation belongs to it. Missing fields are empty.
    """
    return entries_of(lines_of(docs, id_col, text_col), id_col)


def entries_of(lines: DataFrame, id_col: str) -> DataFrame:
    """What parse_entries gives, from lines (id, line, text)."""
    rows = _sections(lines, id_col, ("recommendation", "suggestion"))
    start, level = F.col("text").startswith("### "), F.length(F.regexp_extract("text", "^(#*)", 1))
    ends = (level > 0) & (level < 3) & ~start
    blocks = running.upto(rows, [id_col, "part"], "line", {"number": F.when(start, 1).otherwise(0)}, {"open": F.when(start, True).when(ends, False)}).where("open")
    line = X.strip(F.col("text"))
    b = Window.partitionBy(id_col, "part", "number").orderBy("line")
    opening = F.regexp_like(line, F.lit(OPENING))
    details = (line == DETAILS) | F.lower(line).startswith("*a continuación, se muestran los detalles")
    sets = F.when(opening, _RECOMMENDATION).when(details, _DETAILS)
    read = running.spread(blocks, [id_col, "part", "number"]).where(start | ~F.ltrim("text").startswith(">")).withColumns({"blank": line == "", "sets": F.when(~start, sets), "field": _field(F.col("text")), "start": start})
    read = read.withColumns({"turn": F.count("sets").over(b), "base": F.coalesce(F.last("sets", ignorenulls=True).over(b), F.lit(_DATA)), "para": F.count_if(F.col("blank") | F.col("sets").isNotNull()).over(b)})
    moves = ~F.col("start") & ~F.col("blank") & F.col("sets").isNull() & F.when(F.col("base") == _DATA, F.col("field").isNull()).when(F.col("base") == _DETAILS, ~F.regexp_like("text", F.lit(BULLET))).otherwise(F.lit(False))
    moved = F.max(moves).over(Window.partitionBy(id_col, "part", "number", "turn").orderBy("line"))
    state = F.when((F.col("base") == _DATA) & moved, _PROSE).when((F.col("base") == _DETAILS) & moved, _AFTER).otherwise(F.col("base"))
    known = read.withColumn("state", state).where("not blank").withColumn("field", F.when((F.col("state") == _DATA) & ~F.col("start"), F.col("field")))
    value = F.when(F.col("start"), F.substr("text", F.lit(5))).when(F.col("sets") == _RECOMMENDATION, F.regexp_extract(line, OPENING, 1)).when(F.col("sets") == _DETAILS, None)
    value = value.when(F.col("state") == _DATA, X.strip(F.regexp_extract("text", DATA_LINE, 2))).when(F.col("state") == _DETAILS, X.strip(F.regexp_replace("text", BULLET, ""))).otherwise(F.regexp_replace("text", r"\s+$", ""))
    worded = known.withColumn("value", value).where("value is not null")
    unit = F.when((F.col("state") == _DATA) | (F.col("state") == _DETAILS), F.col("line")).otherwise(F.col("para"))
    paragraphs = worded.groupBy(id_col, "part", "number", "start", "state", "turn", "field", unit.alias("unit")).agg(X.strip(_joined(F.collect_list(F.struct("line", F.col("value").alias("text"))), "\n")).alias("text"))
    units = paragraphs.groupBy(id_col, "part", "number", "start", "state", "turn").agg(
        F.collect_list(F.struct("unit", "text")).alias("u"), *(F.max_by(F.when(F.col("field") == name, F.col("text")), F.when(F.col("field") == name, F.col("unit"))).alias(name) for name in DATA)
    )
    of = lambda which: F.when((F.col("state") == which) & ~F.col("start"), F.struct("turn", F.col("u")))
    flat = lambda which: F.flatten(F.transform(F.array_sort(F.collect_list(of(which))), lambda t: F.array_sort(t["u"])))
    text = lambda rows, between: F.array_join(F.transform(rows, lambda r: r["text"]), between)
    each = F.transform(F.array_sort(F.collect_list(of(_RECOMMENDATION))), lambda t: X.strip(text(F.array_sort(t["u"]), "\n")))
    entries = units.groupBy(id_col, F.col("part").alias("kind"), F.col("number").cast("int").alias("number")).agg(
        F.max(F.when(F.col("start"), F.col("u")[0]["text"])).alias("heading"),
        *(F.max(F.when((F.col("state") == _DATA) & ~F.col("start"), F.col(name))).alias(name) for name in DATA),
        text(flat(_PROSE), "\n\n").alias("incidence"),
        F.array_join(F.transform(flat(_DETAILS), lambda r: F.concat(F.lit("- "), r["text"])), "\n").alias("details"),
        text(flat(_AFTER), "\n\n").alias("consequences"),
        F.array_join(each, "\n\n").alias("recommendation"),
    )
    heading = F.coalesce("heading", F.lit(""))
    title = F.when(F.regexp_like(heading, F.lit(r"^\d+")), X.strip(F.regexp_extract(heading, r"^\d+\s*[.)·\-–:]?\s*(.*)$", 1))).otherwise(heading)
    raw = F.coalesce("risk", F.lit(""))
    bare = X.strip(F.replace(raw, F.lit(PROPOSED), F.lit("")))
    risk = reduce(lambda c, name: c.when(X.fold_label(bare).startswith(X.fold_label(F.lit(name))), name), LEVELS, F.when(F.lit(False), "")).otherwise(bare)
    others = [F.coalesce(c, F.lit("")).alias(c) for c in ("area", "owner", "due", "reference")]
    return entries.select(id_col, "kind", "number", title.alias("title"), F.coalesce("test", F.lit("")).alias("test"), risk.alias("risk"), raw.contains(PROPOSED).alias("proposed"), *others, "incidence", "details", "consequences", "recommendation")


def recommendations(text: Column) -> Column:
    """One recommendation for each paragraph or bullet, without list marks."""
    parts = F.split(X.strip(F.coalesce(text, F.lit(""))), r"\n\s*\n|\n(?=\s*[-*•]\s)", -1)
    return F.filter(F.transform(parts, lambda p: X.strip(F.regexp_replace(p, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda p: p != "")


def entry_text(suggestion: Column, number: Column) -> Column:
    """Markdown of an entry, from the columns that parse_entries gives and, if there is one, cause."""
    own = lambda c: X.strip(F.coalesce(c, F.lit("")))
    some = lambda c, x: F.when(own(F.col(c)) != "", x)
    data = []
    for name, label in DATA.items():
        value = own(F.col(name))
        if name == "risk":
            value = F.when(F.coalesce("proposed", F.lit(False)) & (value != ""), F.concat(value, F.lit(f" {PROPOSED}"))).otherwise(value)
        line = F.concat(F.lit(f"- {label}: "), value)
        data.append(line if name == "test" else F.when(~suggestion | (own(F.col(name)) != ""), line))
    items = F.transform(F.filter(F.split(own(F.col("details")), "\n", -1), lambda x: X.strip(x) != ""), lambda x: F.concat(F.lit("- "), X.strip(F.regexp_replace(x, r"^\s*[-*•/]\s*", ""))))
    label = F.when(suggestion, "Sugerencia de mejora").otherwise("Recomendación")
    advice = F.transform(recommendations(F.col("recommendation")), lambda r, k: F.concat(F.lit("**"), label, F.lit(" "), number.cast("string"), F.lit("."), (k + 1).cast("string"), F.lit(".** "), r, F.lit("\n")))
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(F.concat(F.lit("### "), number.cast("string"), F.lit(". "), own(F.col("title"))), F.lit("")),
        F.array_compact(F.array(*data)),
        F.array(F.lit("")),
        F.array_compact(F.array(*(some(c, F.concat(own(F.col(c)), F.lit("\n"))) for c in ("incidence", "cause")))),
        F.when(F.size(items) > 0, F.concat(F.array(F.lit(DETAILS)), items, F.array(F.lit("")))).otherwise(none),
        F.array_compact(F.array(some("consequences", F.concat(own(F.col("consequences")), F.lit("\n"))))),
        advice,
    )
    return F.array_join(parts, "\n")


def _written(entries: DataFrame, id_col: str) -> DataFrame:
    """Entries with suggestion, place (from 1 within their kind, by number) and Markdown."""
    full = entries if "cause" in entries.columns else entries.withColumn("cause", F.lit(""))
    placed = full.withColumn("suggestion", F.col("kind") == "suggestion").withColumn("place", F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("number")))
    return placed.withColumn("markdown", entry_text(F.col("suggestion"), F.col("place")))


def _own(c: str) -> Column:
    return X.strip(F.coalesce(F.col(c), F.lit("")))


def _opening(heading: str) -> list[Column]:
    """The parts of a report before its findings, from the columns of a head."""
    summary = F.when(_own("summary") != "", _own("summary")).otherwise(PENDING)
    summary = F.concat(summary, F.when(_own("rating") != "", F.concat(F.lit(f"\n\n{RATING} "), _own("rating"))).otherwise(""), F.when(_own("summary") != "", f"\n\n{NEXT_STEPS} {NEXT_STEPS_TEXT}").otherwise(""))
    return [
        F.lit(f"{heading}\n"),
        F.concat(F.lit(f"## {INTRODUCTION}\n\n"), F.when(_own("introduction") != "", _own("introduction")).otherwise(PENDING), F.lit("\n")),
        F.concat(F.lit(f"## {SUMMARY}\n\n"), summary, F.lit("\n")),
        F.lit(f"## {FINDINGS}\n"),
    ]


def render_reports(heads: DataFrame, entries: DataFrame, id_col: str, heading: str = "# Informe de auditoría interna") -> DataFrame:
    """(id, text): the report of every head, its entries numbered anew by kind in the order of their numbers; parse_heads and parse_entries are its inverse."""
    grouped = _written(entries, id_col).groupBy(id_col).agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "markdown")))), lambda x: x["markdown"]).alias(k) for k in ("recommendation", "suggestion")))
    full = heads.join(grouped, id_col, "left")
    none = F.array().cast("array<string>")
    first, second = F.coalesce("recommendation", none), F.coalesce("suggestion", none)
    parts = F.concat(
        F.array(*_opening(heading)),
        F.when(F.size(first) > 0, first).otherwise(F.array(F.lit(f"{PENDING}\n"))),
        F.array(F.lit(f"## {SUGGESTIONS}\n")),
        F.when(F.size(second) > 0, F.concat(F.array(F.lit(f"_{SUGGESTIONS_TEXT}_\n")), second)).otherwise(F.array(F.when(F.size(first) > 0, f"{NONE}\n").otherwise(f"{PENDING}\n"))),
    )
    return full.select(id_col, F.concat(F.regexp_replace(F.array_join(parts, "\n"), r"\s+\z", ""), F.lit("\n")).alias("text"))


def render_lines(heads: DataFrame, entries: DataFrame, id_col: str, heading: str = "# Informe de auditoría interna") -> DataFrame:
    """(id, line from 0, text): the lines of what render_reports writes, for reports of any length; white space at a report's very end stays.

    Entries are placed by running sums over ranges, and nothing is gathered for a report.
    """
    full = (entries if "cause" in entries.columns else entries.withColumn("cause", F.lit(""))).where("kind in ('recommendation', 'suggestion')").join(heads.select(id_col), id_col, "left_semi")
    suggestion = F.col("kind") == "suggestion"
    n_lines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    fields = [c for c in full.columns if c not in (id_col, "number")]
    written = full.select(id_col, F.when(suggestion, 3).otherwise(1).alias("rank"), "number", F.lit(None).cast("string").alias("own"), n_lines(entry_text(suggestion, F.lit(0))).alias("n"), F.struct(*fields).alias("e"))
    counts = full.groupBy(id_col).agg(F.count_if(~suggestion).alias("first"), F.count_if(suggestion).alias("second"))
    first, second = F.coalesce("first", F.lit(0)), F.coalesce("second", F.lit(0))
    opening = F.array_join(F.concat(F.array(*_opening(heading)), F.when(first == 0, F.array(F.lit(f"{PENDING}\n"))).otherwise(F.array().cast("array<string>"))), "\n")
    middle = F.concat(F.lit(f"## {SUGGESTIONS}\n\n"), F.when(second > 0, f"_{SUGGESTIONS_TEXT}_\n").otherwise(F.when(first > 0, f"{NONE}\n").otherwise(f"{PENDING}\n")))
    fixed = heads.join(counts, id_col, "left").select(id_col, F.explode(F.array(F.struct(F.lit(0).alias("rank"), opening.alias("own")), F.struct(F.lit(2).alias("rank"), middle.alias("own")))).alias("p"))
    fixed = fixed.select(id_col, "p.rank", F.lit(None).cast(full.schema["number"].dataType).alias("number"), "p.own", n_lines(F.col("p.own")).alias("n"), F.lit(None).cast(written.schema["e"].dataType).alias("e"))
    placed = running.before(written.unionByName(fixed), id_col, ["rank", "number"], at=F.col("n"), first=F.when(F.col("rank") == 1, 1).otherwise(0), second=F.when(F.col("rank") == 3, 1).otherwise(0))
    numbered = placed.select(id_col, "at", "own", F.when(F.col("rank") == 1, F.col("first")).otherwise(F.col("second")).alias("place"), "e.*")
    text = F.coalesce("own", entry_text(suggestion, F.col("place") + 1))
    return numbered.select(id_col, "at", F.posexplode(F.split(text, "\n", -1)).alias("line", "text")).select(id_col, (F.col("at") + F.col("line")).alias("line"), "text")


def sections(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, kind, title, ord, text): the sections of each report as they are shown, the rating with the summary; empty ones are left out."""
    return sections_of(lines_of(docs, id_col, text_col), docs.select(id_col), id_col)


def sections_of(lines: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """What sections gives, for the reports of ``ids``, from lines (id, line, text)."""
    heads = heads_of(lines, ids, id_col)
    rated = F.concat("summary", F.when(F.col("rating") != "", F.concat(F.lit(f"\n\n{RATING} "), "rating")).otherwise(""))
    top = [heads.select(id_col, F.lit(k).alias("kind"), F.lit(t).alias("title"), F.lit(o).cast("long").alias("ord"), X.strip(c).alias("text")) for k, t, o, c in (("introduction", INTRODUCTION, 0, F.col("introduction")), ("summary", SUMMARY, 1, rated))]
    # entries that were read are numbered without gaps; findings come before suggestions, whichever numbers they have
    read = entries_of(lines, id_col).withColumn("cause", F.lit(""))
    suggestion = F.col("kind") == "suggestion"
    below = read.select(id_col, "kind", "title", (F.col("number") * 2 + F.when(suggestion, 1 << 40).otherwise(0)).alias("ord"), entry_text(suggestion, F.col("number")).alias("text"))
    return top[0].unionByName(top[1]).unionByName(below).where(X.strip(F.col("text")) != "")


def compare_reports(pairs: DataFrame, id_col: str, old: str = "old", new: str = "new") -> DataFrame:
    """What compare_sections gives for the two versions of each report; where texts differ outside of all sections, one row of kind document compares them whole. The pairs are checkpointed, as they are read several times."""
    pairs = kept(pairs.select(id_col, F.col(old).alias("old"), F.col(new).alias("new")))
    ids = pairs.select(id_col)
    found = diff.compare_sections(*(sections_of(lines_of(pairs, id_col, c), ids, id_col) for c in ("old", "new")), id_col)
    return _with_rest(found, pairs.join(_changed(found, id_col), id_col, "left_anti"), id_col)


def compare_lines(old: DataFrame, new: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """What compare_reports gives for reports of any length, as lines (id, line, text). Only reports without a changed section are gathered, to be compared whole."""
    found = diff.compare_sections(*(sections_of(rows, ids, id_col) for rows in (old, new)), id_col)
    changed = _changed(found, id_col)
    text = lambda rows, name: rows.join(changed, id_col, "left_anti").groupBy(id_col).agg(_joined(F.collect_list(F.struct("line", "text")), "\n").alias(name))
    return _with_rest(found, text(old, "old").join(text(new, "new"), id_col, "full"), id_col)


def _changed(found: DataFrame, id_col: str) -> DataFrame:
    return found.where("state <> 'equal'").select(id_col).distinct()


def _with_rest(found: DataFrame, rest: DataFrame, id_col: str) -> DataFrame:
    """found and a row for each pair of texts that differ though no section does."""
    differ = rest.where(~F.coalesce("old", F.lit("")).eqNullSafe(F.coalesce("new", F.lit(""))))
    whole = differ.select(id_col, F.lit("document").alias("kind"), F.lit("Documento completo").alias("title"), F.lit("modified").alias("state"), diff.line_diff("old", "new").alias("lines"))
    counts = {k: diff.count_lines(F.col("lines"), v) for k, v in (("added", "add"), ("deleted", "del"))}
    return found.unionByName(whole.withColumns(counts), allowMissingColumns=True)

"""What an auditor's assistant does to findings, with the answers of people and models as tables joined by id.

Findings have columns case, ident, state, kind, level, proposed, notes, test and recommendation, besides the texts that a style asks for. Every
action gives them back with a column outcome; nothing is asked or written here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import findings, lint
from docloom.operators.rules import Style

# States, levels, and the share of content words that a reworded text must keep.
PROPOSED, APPROVED, DISCARDED = "propuesta", "aprobada", "descartada"
LEVELS = ("Crítico", "Alto", "Medio", "Bajo")
KEPT = 85
KEY = ["case", "ident"]


def kind_of(label: Column) -> Column:
    return F.when(X.finding_kind(F.coalesce(label, F.lit(""))) == "sugerencia", "suggestion").otherwise("recommendation")


def level_of(label: Column) -> Column:
    """A level by its beginning, without accents and case; any other as it stands."""
    own = X.strip(F.coalesce(label, F.lit("")))
    out = own
    for name in LEVELS:
        out = F.when(X.fold_label(own).startswith(X.fold_label(F.lit(name))), name).otherwise(out)
    return out


def keeps_base(before: Column, after: Column) -> Column:
    """Whether a reworded text keeps most content words of the first."""
    base = X.content_tokens(before)
    return (F.size(base) == 0) | (F.size(F.array_intersect(base, X.content_tokens(after))) * 100 >= F.size(base) * KEPT)


def _filled(c: str) -> Column:
    return X.strip(F.coalesce(F.col(c), F.lit(""))) != ""


def extracted(existing: DataFrame, answers: DataFrame) -> DataFrame:
    """Existing findings and, behind them, the answers (case, ord, kind, level, supported and any other columns) as proposed ones with the next ids of their case.

    A level that no evidence supports is only proposed. Columns that the answers haven't are null, notes empty.
    """
    first = findings.next_id(existing, "case", "ident")
    place = F.row_number().over(Window.partitionBy("case").orderBy("ord"))
    numbered = answers.withColumn("_n", place).join(first, "case", "left")
    fresh = numbered.withColumns({
        "ident": F.format_string("C-%02d", F.coalesce("next", F.lit(1)) + F.col("_n") - 1), "state": F.lit(PROPOSED), "kind": kind_of(F.col("kind")), "level": level_of(F.col("level")),
        "proposed": findings.proposed(F.col("level"), F.col("supported")), "notes": F.lit(""),
    }).drop("_n", "next", "ord", "supported")
    known = [c for c in fresh.columns if c in existing.columns]
    return existing.withColumn("outcome", F.lit("kept")).unionByName(fresh.select(known).withColumn("outcome", F.lit("added")), allowMissingColumns=True)


def uncovered(tests: DataFrame, mentions: DataFrame) -> DataFrame:
    """(case, code, title) of tests that no mention (case, text) names. Codes are taken out of the mentions, so that they meet by equality."""
    named = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![\d.])(\d{1,2}\.\d{1,2})(?!\d)"), 1)
    return tests.join(mentions.select("case", F.explode(named).alias("code")).distinct(), ["case", "code"], "left_anti").select("case", "code", "title")


def _errors(rows: DataFrame, style: Style, fields: list[str]) -> DataFrame:
    """(case, ident, errors) of all rows."""
    keyed = rows.withColumn("_key", F.struct(*KEY))
    found = lint.record_findings(keyed, style, "_key", fields, "level")
    n = found.where("severity = 'error'").groupBy("_key").agg(F.count("*").alias("errors"))
    return keyed.select("_key").join(n, "_key", "left").select("_key.case", "_key.ident", F.coalesce("errors", F.lit(0)).alias("errors"))


def reviewed(rows: DataFrame, style: Style, fields: list[str]) -> DataFrame:
    """(case, ident, errors) of the findings that aren't discarded."""
    return _errors(rows.where(F.col("state") != DISCARDED), style, fields)


def _answered(rows: DataFrame, answers: DataFrame, fields: list[str], takes: Column) -> DataFrame:
    """rows with the answers' fields where ``takes`` holds and there is an answer; column _answered tells where."""
    new = answers.select(*KEY, F.lit(True).alias("_there"), *(F.col(f).alias(f"_{f}") for f in fields if f in answers.columns))
    both = rows.join(new, KEY, "left").withColumn("_answered", takes & F.coalesce("_there", F.lit(False)))
    changed = {f: F.when(F.col("_answered") & F.col(f"_{f}").isNotNull(), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields if f in answers.columns}
    return both.withColumns(changed).select(*rows.columns, "_answered")


def corrected(rows: DataFrame, answers: DataFrame, style: Style, fields: list[str]) -> DataFrame:
    """Findings with errors as the answers give them, their recommendation untouched. outcome: skipped (discarded), clean, unanswered, verified, or still wrong after it."""
    before = rows.join(_errors(rows, style, fields).withColumnRenamed("errors", "_before"), KEY)
    wrong = (F.col("state") != DISCARDED) & (F.col("_before") > 0)
    changed = _answered(before, answers, [f for f in fields if f != "recommendation"], wrong)
    after = changed.join(_errors(changed, style, fields).withColumnRenamed("errors", "_after"), KEY)
    outcome = F.when(F.col("state") == DISCARDED, "skipped").when(F.col("_before") == 0, "clean").when(~F.col("_answered"), "unanswered").when(F.col("_after") == 0, "verified").otherwise("still wrong")
    return after.withColumn("outcome", outcome).select(*rows.columns, "outcome")


def regenerated(rows: DataFrame, answers: DataFrame, fields: list[str]) -> DataFrame:
    """Findings with notes as the answers (with kind, level and supported) give them: proposed again, their notes emptied. Without notes they stay. outcome: regenerated or kept."""
    changed = _answered(rows, answers, fields, _filled("notes"))
    told = answers.select(*KEY, kind_of(F.col("kind")).alias("_kind"), level_of(F.col("level")).alias("_level"), findings.proposed(F.col("level"), F.col("supported")).alias("_proposed"))
    both, here = changed.join(told, KEY, "left"), F.col("_answered")
    new = {"kind": F.col("_kind"), "level": F.col("_level"), "proposed": F.col("_proposed"), "state": F.lit(PROPOSED), "notes": F.lit("")}
    out = both.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()} | {"outcome": F.when(here, "regenerated").otherwise("kept")})
    return out.select(*rows.columns, "outcome")


def recommended(rows: DataFrame, given: DataFrame, answers: DataFrame, reword: bool = False, all_states: bool = False) -> DataFrame:
    """Findings with a recommendation each, and suggestions that come with one.

    One that has a recommendation keeps it; if ``reword``, an answer to it is taken where it keeps the words, but not for suggestions. One that has none gets what a person
    has given (case, ident, text, refused), nothing if they refuse, else the answer's (case, ident, recommendation, extra_title, extra_text); a
    recommendation's extra becomes a suggestion of its own behind the others of the case.
    outcome: out of scope, kept, reworded, not reworded, refused, given, answered, open, or added.
    """
    told = answers.select(*KEY, F.col("recommendation").alias("_answer"), "extra_title", "extra_text")
    both = rows.join(given.select(*KEY, F.col("text").alias("_given"), F.coalesce("refused", F.lit(False)).alias("_refused")), KEY, "left").join(told, KEY, "left")
    scope = (F.col("state") != DISCARDED) & (F.lit(all_states) | (F.col("state") == APPROVED))
    has, suggestion = _filled("recommendation"), F.col("kind") == "suggestion"
    outcome = (
        F.when(~scope, "out of scope").when(has & (suggestion | ~F.lit(reword) | ~_filled("_answer")), "kept")
        .when(has, F.when(keeps_base(F.col("recommendation"), F.col("_answer")), "reworded").otherwise("not reworded"))
        .when(F.coalesce("_refused", F.lit(False)), "refused").when(_filled("_given"), "given").when(_filled("_answer"), "answered").otherwise("open")
    )
    judged = both.withColumn("outcome", outcome)
    text = F.when(F.col("outcome").isin("reworded", "answered"), X.strip(F.col("_answer"))).when(F.col("outcome") == "given", X.strip(F.col("_given"))).otherwise(F.col("recommendation"))
    kept = judged.withColumn("recommendation", text).select(*rows.columns, "outcome")
    more = judged.where((F.col("outcome") == "answered") & ~suggestion & _filled("extra_title") & _filled("extra_text"))
    n = rows.groupBy("case").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("case").orderBy("ident"))
    fixed = {"ident": F.format_string("C-%02d", F.col("_n") + F.col("_place")), "title": X.strip(F.col("extra_title")), "recommendation": X.strip(F.col("extra_text")), "kind": F.lit("suggestion"), "state": F.lit(PROPOSED), "proposed": F.lit(False)}
    blank = {c: F.lit("") for c in ("level", "notes", "details", "owner", "area", "due") if c in rows.columns}
    extra = more.join(n, "case").withColumn("_place", place).withColumns(fixed | blank).withColumn("outcome", F.lit("added"))
    return kept.unionByName(extra.select(*(c for c in kept.columns if c in extra.columns)), allowMissingColumns=True)


def drafted(heads: DataFrame, answers: DataFrame, key: str, sections: list[str], force: bool = False) -> DataFrame:
    """heads with the asked sections as the answers give them; what is written already is only replaced if ``force``. outcome names the sections replaced."""
    new = answers.select(key, *(F.col(s).alias(f"_{s}") for s in sections))
    both = heads.join(new, key, "left")
    takes = {s: _filled(f"_{s}") & (F.lit(force) | ~_filled(s)) for s in sections}
    outcome = F.array_compact(F.array(*(F.when(takes[s], s) for s in sections)))
    return both.withColumn("outcome", outcome).withColumns({s: F.when(F.array_contains("outcome", s), F.col(f"_{s}")).otherwise(F.col(s)) for s in sections}).select(*heads.columns, "outcome")

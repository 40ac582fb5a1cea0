"""Operators that SQL can't express, on small cases."""

import itertools
import random
import re
import tempfile
import zipfile
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions import external
from docloom.functions import text as X
from docloom.operators import actions, budget, diff, edits, layout, lint, markdown, matching, meetings, patch, publishing, reports, rules, speakers
from docloom.plans import text_queries
from docloom.sources import readers
from docloom.streaming import incremental

REPORT = "# Report\n\n## 1. Rates\n\nThe rates are old. They were set in 2019.\n\n## 2. Contracts\n\nThe rates are old. Nobody signs.\n\n## 3. Rates\n\nÁrea técnica «principal».\n"


@pytest.mark.parametrize(
    ("change", "state", "has"),
    [
        ({"section": "1. Rates", "old": "The rates are old.", "new": "Rates date back."}, patch.APPLIED, "Rates date back. They were"),
        ({"old": "The rates are old.", "new": "x"}, patch.NOT_APPLIED, "The rates are old. They"),
        ({"old": "not there", "new": "x"}, patch.NOT_APPLIED, "Nobody"),
        ({"section": "9. None", "old": "Nobody signs.", "new": "x"}, patch.NOT_APPLIED, "Nobody signs."),
        ({"old": "Nobody signs.", "new": ""}, patch.DELETED, "old. \n"),
        ({"old": 'Area tecnica "principal"', "new": "Area."}, patch.APPROXIMATE, "\nArea.\n"),
        ({"insert_after": "Nobody signs.", "new": " Yet."}, patch.INSERTED, "Nobody signs. Yet."),
        ({"old": "They were\nset in 2019.", "new": "Set."}, patch.APPLIED, "old. Set."),
    ],
)
def test_patch_states(change, state, has):
    text, results = patch.apply_plan(REPORT, [{"seq": 1} | change])
    assert results[0]["state"] == state and has in text
    assert state != patch.NOT_APPLIED or text == REPORT


def test_patch_numbers_are_numbers():
    text = "## 3. Approver equals requester\n\nSame words.\n\n## 4. Approver equals requester\n\nSame words.\n"
    for asked in ("03. Approver equals requester", "OBS-03 Approver equals requester", "### 3 - Approver equals requester"):
        out, results = patch.apply_plan(text, [{"seq": 1, "section": asked, "old": "Same words.", "new": "Other."}])
        assert results[0]["state"] == patch.APPLIED and out.index("Other.") < out.index("## 4")
    assert patch.apply_plan(text, [{"seq": 1, "section": "05. Approver equals requester", "old": "Same words.", "new": "x"}])[1][0]["state"] == patch.NOT_APPLIED


def test_shortening(spark):
    rows = [("a 12 b", "a 12"), ("a 12. b", "a b"), ("1) see 12) TMS-10, 3,5%", "TMS-10 3,5%"), ("x", "x y"), ("x", " "), ("", "y"), ("", " "), ("keep this now", "keep that"), ("x y", "bad")]
    df = spark.createDataFrame(rows, "b string, a string")
    got = [r[0] for r in df.select(X.shortening_refused(F.col("b"), F.col("a"), ("keep this",), (F.col("a") == "bad").cast("int"))).collect()]
    assert got == [None, "lost figures: 12", None, "longer", "empty", "nothing to shorten", None, "lost phrase: keep this", "against the style"]


def test_condense_acceptance_of_empty_texts(spark, tmp_path):
    """Each pair of odd texts, as the query's SQL judges it."""
    odd = ["", " \n", None, "\v", "!!! ...", "the plan of 2020", "All rights reserved 12.5", "1) 12,", "of"]
    rows = [(3 * i + k, x, "en", "s") for i, pair in enumerate(itertools.product(odd, odd)) for k, x in enumerate(pair)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, text_queries.condense_acceptance(spark, str(tmp_path)).collect()))
    assert len(got) == 81 and got == sorted(con.sql(f"SELECT doc_id, reason FROM ({text_queries.ORACLES['condense_acceptance']})").fetchall())


def test_patch_order_and_conflict(spark):
    plan = [(1, 2, None, "They were set in 2019.", "b", None), (1, 1, None, "They were set in 2019.", "a", None), (1, 3, None, None, "!", "a"), (2, 1, None, "x", "y", None)]
    changes = spark.createDataFrame(plan, "doc int, seq int, section string, old string, new string, insert_after string")
    docs = spark.createDataFrame([(1, "They were set in 2019."), (3, None)], "doc int, text string")
    got = {r["doc"]: r for r in patch.apply_changes(docs, changes, "doc").collect()}
    assert got[1]["text"] == "a!" and [x["state"] for x in got[1]["results"]] == [patch.APPLIED, patch.CONFLICT, patch.INSERTED]
    assert got[3]["text"] == "" and got[3]["results"] == []


def test_compare_sections(spark):
    cols = "doc int, kind string, title string, ord int, text string"
    old = spark.createDataFrame([(1, "s", "Context", 1, "a\nb"), (1, "f", "Rates are old", 2, "x y z"), (1, "f", "Gone", 3, "qqq"), (1, "f", "Same", 4, "1"), (1, "f", "Same", 5, "2")], cols)
    new = spark.createDataFrame([(1, "s", "CONTEXT", 1, "a\nc"), (1, "f", "Rates are too old", 2, "x y z"), (1, "f", "Added", 3, "kkk"), (1, "f", "Same", 4, "1"), (1, "f", "Same", 5, "2")], cols)
    got = {(r["title"], r["state"], r["added"], r["deleted"]) for r in diff.compare_sections(old, new, "doc").collect()}
    assert got == {("CONTEXT", "modified", 1, 1), ("Rates are too old", "modified", 0, 0), ("Gone", "deleted", 0, 1), ("Added", "new", 1, 0), ("Same", "equal", 0, 0)}


def test_line_diff_marks_tokens():
    rows = diff.compared_lines("one two\nsame", "one 2\nsame\nmore")
    assert [(r["kind"], r["text"]) for r in rows] == [("del", "one two"), ("add", "one 2"), ("equal", "same"), ("add", "more")]
    assert rows[1]["parts"] == [{"text": "one ", "changed": False}, {"text": "2", "changed": True}]


def test_sections_that_move(spark):
    """Order decides: a moved section is deleted and new, repeated titles match by their turn, and marks of rewritten lines go."""
    cols = "doc int, kind string, title string, ord int, text string"
    row = lambda titles: [(1, "f", t, i, f"words of {t}") for i, t in enumerate(titles)]
    old, new = spark.createDataFrame(row("ABCDEAF"), cols), spark.createDataFrame(row("BCADEAF"), cols)
    got = sorted((r["a_ord"], r["b_ord"], r["state"]) for r in diff.compare_sections(old, new, "doc").select(F.coalesce("a_ord", F.lit(-1)).alias("a_ord"), F.coalesce("b_ord", F.lit(-1)).alias("b_ord"), "state").collect())
    assert got == [(-1, 2, "new"), (0, -1, "deleted"), (1, 0, "equal"), (2, 1, "equal"), (3, 3, "equal"), (4, 4, "equal"), (5, 5, "equal"), (6, 6, "equal")]
    # of two runs of one length the one whose values are least; prose decides where titles differ, lines of data don't count
    a = spark.createDataFrame([(1, "f", "Old title", 1, "### 1. Old title\n- Area: x\nThe rates were set in spring"), (1, "f", "Z", 2, "z")], cols)
    b = spark.createDataFrame([(1, "f", "Quite another", 1, "### 4. Quite another\n- Area: y\nThe rates were set in autumn"), (1, "f", "Z", 2, "z")], cols)
    assert {(r["title"], r["state"], r["added"]) for r in diff.compare_sections(a, b, "doc").collect()} == {("Quite another", "modified", 3), ("Z", "equal", 0)}
    assert diff.compare_sections(a.limit(0), b, "doc").count() == 2 == diff.compare_sections(a, b.limit(0), "doc").count()


def test_lines_written_anew():
    rows = diff.compared_lines("alpha beta gamma\n\nkeep", "completely other, words!\nkeep\nmore")
    assert [(r["kind"], r["text"], r["parts"]) for r in rows] == [("del", "alpha beta gamma", []), ("add", "completely other, words!", []), ("equal", "keep", []), ("add", "more", [])]
    uneven = diff.compared_lines("one two three\nx", "one two 3\ny y\nz z")
    assert [(r["kind"], [p["text"] for p in r["parts"]]) for r in uneven] == [("del", ["one two ", "three"]), ("del", []), ("add", ["one two ", "3"]), ("add", []), ("add", [])]
    assert diff.compared_lines(None, None) == []


def test_lint_reads_words_once(spark):
    """Terms of several words, terms within others, terms that don't begin with a word, accents, borders; against a scan a term."""
    terms = ["mal", "mal hecho", "hecho", "la la", "ñandú", "no: a", "%", "(x)", "de_la", "ab"]
    rows = [(1, "Mal hecho, MAL  hecho; malo. la la la la, ñandú Nandu ñandúes"), (2, "no: a no: ab %b a%b (x) b(x)c de_la ab ab_ é"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "i int, text string")
    rules = [lint.Rule(t) for t in terms]
    got = sorted((r["i"], r["rule"], r["pos"], r["fragment"]) for r in lint.findings(docs, rules, "i").collect())
    plain = []
    for i, text in rows:
        norm = lint._folded(text or "")
        plain += [(i, n, m.start(), text[m.start() : m.end()]) for n, t in enumerate(terms) for m in re.finditer(rf"\b{re.escape(lint._folded(t))}\b", norm, re.ASCII)]
    assert got == sorted(plain) and len(got) > 12
    counted = {(r["i"], r["term"]): r["n"] for r in lint.counts(docs, rules, "i").collect()}
    assert counted == {(i, t): n for i, _ in rows for k, t in enumerate(terms) if (n := sum(1 for p in plain if p[:2] == (i, k)))}


def test_style_of_a_file(spark):
    yaml = pytest.importorskip("yaml")
    text = yaml.safe_dump({
        "palabras_prohibidas": [{"termino": "siempre", "motivo": "Absoluto.", "sugerencia": "en los casos analizados"}], "primera_persona": ["yo"],
        "tono": {"expresiones_a_cuestionar": [{"termino": "falta de", "alternativa": "oportunidades"}]}, "reglas": {"longitud_maxima_frase": 6, "niveles_riesgo_validos": ["Alto", "Medio"]},
        "estructura_conclusion": [{"campo": "titulo", "descripcion": "Título"}, {"campo": "plazo", "descripcion": "Plazo", "requerido": False}, {"campo": "otro", "descripcion": "?"}],
    })
    style = rules.load(text)
    assert [(r.term, r.kind, r.severity) for r in style.rules] == [("siempre", "forbidden", "error"), ("yo", "first_person", "error"), ("falta de", "tone", "warning")]
    assert rules.load("") == rules.Style([]) and style.longest == 6
    with pytest.raises(ValueError, match="term"):
        rules.from_config({"primera_persona": [3]})
    records = spark.createDataFrame([("C-01", "Siempre", "Falta de control. Una frase de más de seis palabras en total.", "alto (propuesto por el modelo, sin evidencia en PT)"), ("C-02", " ", None, "Nulo")], "id string, titulo string, incidencia string, nivel string")
    got = {(r["id"], r["field"], r["kind"], r["severity"]) for r in lint.record_findings(records, style, "id", ["titulo", "incidencia"], "nivel").collect()}
    assert got == {
        ("C-01", "titulo", "forbidden", "error"), ("C-01", "incidencia", "tone", "warning"), ("C-01", "incidencia", "long_sentence", "warning"), ("C-01", "plazo", "structure", "warning"), ("C-01", "otro", "structure", "error"),
        ("C-02", "titulo", "structure", "error"), ("C-02", "plazo", "structure", "warning"), ("C-02", "otro", "structure", "error"), ("C-02", "nivel", "structure", "error"),
    }


FOUND = "case int, ident string, state string, kind string, level string, proposed boolean, notes string, test string, title string, recommendation string"


def test_findings_corrected_and_regenerated(spark):
    style = rules.from_config({"palabras_prohibidas": [{"termino": "siempre"}], "estructura_conclusion": [{"campo": "title", "descripcion": "título"}]})
    rows = [(1, "C-01", "propuesta", "recommendation", "Alto", False, "", "2.1", "Siempre tarde", "Siempre igual"), (1, "C-02", "aprobada", "suggestion", "", False, "Más corto", "", "Bien", ""), (1, "C-03", "descartada", "recommendation", "", False, "", "", "", ""), (1, "C-04", "propuesta", "recommendation", "", False, " ", "", "", ""), (1, "C-05", "propuesta", "recommendation", "", False, None, "", "siempre", "")]
    found = spark.createDataFrame(rows, FOUND)
    assert {r["ident"]: r["errors"] for r in actions.reviewed(found, style, ["title"]).collect()} == {"C-01": 1, "C-02": 0, "C-04": 1, "C-05": 1}
    answers = spark.createDataFrame([(1, "C-01", "Tarde", "Otra", "Sugerencia", "bajo", True), (1, "C-02", "Mejor", "Ya", "recomendación", "ALTO", False), (1, "C-05", "Siempre mal", "x", "", "", None)], "case int, ident string, title string, recommendation string, kind string, level string, supported boolean")
    got = {r["ident"]: (r["outcome"], r["title"], r["recommendation"]) for r in actions.corrected(found, answers, style, ["title", "recommendation"]).collect()}
    # the recommendation stays as it was, so its error stays too
    assert got == {"C-01": ("still wrong", "Tarde", "Siempre igual"), "C-02": ("clean", "Bien", ""), "C-03": ("skipped", "", ""), "C-04": ("unanswered", "", ""), "C-05": ("still wrong", "Siempre mal", "")}
    assert {r["ident"]: r["outcome"] for r in actions.corrected(found, answers, style, ["title"]).collect()}["C-01"] == "verified"
    again = {r["ident"]: tuple(r)[2:] for r in actions.regenerated(found, answers, ["title", "recommendation"]).collect()}
    assert again["C-02"] == ("propuesta", "recommendation", "Alto", True, "", "", "Mejor", "Ya", "regenerated")
    assert again["C-01"][-1] == again["C-05"][-1] == "kept"


def test_drafts_do_not_overwrite(spark):
    heads = spark.createDataFrame([(1, "", "Old"), (2, "Mine", None), (3, "a", "b")], "id int, introduction string, summary string")
    answers = spark.createDataFrame([(1, "New", "New"), (2, "New", "New")], "id int, introduction string, summary string")
    got = lambda **more: {r["id"]: tuple(r)[1:] for r in actions.drafted(heads, answers, "id", **more).collect()}
    assert got(sections=["introduction", "summary"]) == {1: ("New", "Old", ["introduction"]), 2: ("Mine", "New", ["summary"]), 3: ("a", "b", [])}
    assert got(sections=["summary"], force=True) == {1: ("", "New", ["summary"]), 2: ("Mine", "New", ["summary"]), 3: ("a", "b", [])}


def test_speakers_enrolled_and_named(spark):
    cols = "recording int, part int, start double, end double, speaker string, text string"
    part = spark.createDataFrame([(1, 0, 0.0, 8.0, "A", "x"), (1, 0, 7.0, 9.0, "B", "x"), (1, 0, 9.0, 10.0, "C", "x"), (1, 0, 10.0, 13.0, "Eva", "x"), (1, 0, 14.0, 17.0, "D", "x"), (1, 0, 18.0, 20.5, "E", "x"), (2, 0, 0.0, 3.0, "A", "x")], cols)
    known = spark.createDataFrame([(1, "Eva"), (1, "HABLANTE_1")], "recording int, name string")
    got = {(r["recording"], r["speaker"]): (r["name"], r["start"], r["clip_s"]) for r in speakers.enrolled(part, known).collect()}
    assert got == {(1, "A"): ("HABLANTE_2", 0.0, 8.0), (1, "D"): ("HABLANTE_3", 14.0, 3.0), (2, "A"): ("HABLANTE_1", 0.0, 3.0)}
    offsets = spark.createDataFrame([(1, 0, 0.0), (1, 1, 300.0), (2, 0, 0.0)], "recording int, part int, offset_s double")
    two = part.unionByName(spark.createDataFrame([(1, 1, 0.5, 30.0, "A", " later "), (1, 2, 0.0, 1.0, "A", "failed part"), (1, 1, 2.0, 3.0, "Eva", " ")], cols))
    own = speakers.whole(two, offsets, known)
    assert {(r["speaker"], r["start"], r["text"]) for r in own.where("part = 1").collect()} == {("A·p2", 300.5, "later")}
    heard = speakers.voices(own, known, 5.0)
    assert {(r["recording"], r["speaker"]): r["ident"] for r in heard.collect()} == {(1, "A·p1"): "SPEAKER_01", (1, "Eva"): "Eva", (1, "A·p2"): "SPEAKER_02"}
    told = speakers.named(heard, spark.createDataFrame([(1, "SPEAKER_01", "", "SPEAKER_02", False), (1, "SPEAKER_02", " Luis ", None, False)], "recording int, ident string, name string, target string, ignored boolean"))
    assert {r["speaker"]: (r["name"], r["status"]) for r in told.collect()} == {"A·p1": ("Luis", "named"), "A·p2": ("Luis", "named"), "Eva": ("Eva", "known")}
    assert speakers.written(speakers.transcript(own, told)).collect()[0]["text"] == "Luis: x\nEva: x\nLuis: later"


def test_edit_scripts():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(0, 15))] for _ in range(2))
        exact, quick = edits.longest_common(a, b), edits.aligned(a, b)
        assert len(exact) == plain(a, b)
        for pairs in (exact, quick):
            assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(pairs))
        made, i, j = [], 0, 0
        for equal, x, n, y, m in edits.stretches(quick, len(a), len(b)):
            assert (x, y) == (i, j) and (not equal or a[x:n] == b[y:m])
            made, i, j = made + b[y:m], n, m
        assert made == b and (i, j) == (len(a), len(b))
        run = [a[i] for i in edits.rising(a)]
        longest = max((k for k in range(len(a) + 1) if any(all(p < q for p, q in itertools.pairwise(c)) for c in itertools.combinations(a[:9], k))), default=0)
        assert all(p < q for p, q in itertools.pairwise(run)) and len(run) >= longest


WRITTEN = """# Informe
> nota

## Introducción

> instrucciones
Primera línea.

## Resumen ejecutivo

Texto.

**Evaluación global:** Mejorable

**Próximos pasos:** fijo

## Detalle de conclusiones

### 1. Tarifas · 2.11

- Prueba: 2.11 a) Contrastar: todo
- Nivel de riesgo: medio (propuesto por el modelo, sin evidencia en PT)
- Ref: desconocida
- Área: no es dato ya

Párrafo
en dos líneas.
> fuera

*A continuación, se muestran los detalles descriptivos de la situación anterior:*
- uno
* dos

Cierre.
- Plazo: tampoco es dato

**Recomendación N.1.** Primera.
Sigue.

Y sigue.

**Recomendación 1.2**  Segunda.
### Sin número
## Sugerencias de mejora

_(ninguna)_
"""


def test_parse_reports(spark):
    docs = spark.createDataFrame([(1, WRITTEN), (2, None), (3, "no sections\n### 1. x"), (4, "## Introducción\n_(pendiente)_\n## Resumen\n\n## Conclusiones\n### 1) A\n# otra\n### 2) B")], "id int, text string")
    heads = {r["id"]: (r["introduction"], r["summary"], r["rating"]) for r in reports.parse_heads(docs, "id").collect()}
    assert heads == {1: ("Primera línea.", "Texto.", "Mejorable"), 2: ("", "", ""), 3: ("", "", ""), 4: ("", "", "")}
    got = {(r["id"], r["number"]): r for r in reports.parse_entries(docs, "id").collect()}
    assert {k: r["title"] for k, r in got.items()} == {(1, 1): "Tarifas · 2.11", (1, 2): "Sin número", (4, 1): "A"}
    r = got[1, 1]
    assert (r["test"], r["risk"], r["proposed"], r["area"]) == ("2.11 a) Contrastar: todo", "Medio", True, "")
    assert r["incidence"] == "- Ref: desconocida\n- Área: no es dato ya\n\nPárrafo\nen dos líneas."
    assert (r["details"], r["consequences"]) == ("- uno\n- dos", "Cierre.\n- Plazo: tampoco es dato")
    assert r["recommendation"] == "Primera.\nSigue.\nY sigue.\n\nSegunda."
    assert [got[1, 2][c] for c in ("test", "incidence", "details", "recommendation")] == [""] * 4


def test_compare_reports(spark):
    retitled = WRITTEN.replace("### 1. Tarifas · 2.11", "### 1. Tarifas desactualizadas · 2.11").replace("Cierre.", "Cierre nuevo.")
    pairs = spark.createDataFrame([(1, WRITTEN, WRITTEN), (2, WRITTEN, retitled), (3, WRITTEN, WRITTEN.replace("# Informe", "# Otro")), (4, "uno", "dos"), (5, None, WRITTEN)], "id int, old string, new string")
    rows = reports.compare_reports(pairs, "id").collect()
    of = lambda i: sorted((r["kind"], r["state"]) for r in rows if r["id"] == i)
    same = [("introduction", "equal"), ("recommendation", "equal"), ("recommendation", "equal"), ("summary", "equal")]
    assert of(1) == same and of(3) == sorted([("document", "modified"), *same]) and of(4) == [("document", "modified")]
    assert of(2) == [("introduction", "equal"), ("recommendation", "equal"), ("recommendation", "modified"), ("summary", "equal")]
    assert of(5) == [("introduction", "new"), ("recommendation", "new"), ("recommendation", "new"), ("summary", "new")]
    marked = next(r for r in rows if r["id"] == 2 and r["state"] == "modified")
    assert (marked["added"], marked["deleted"]) == (2, 2)


def _long_report(spark, n):
    heads = spark.createDataFrame([(1, "Intro", "", "Razonable"), (2, "", "Summary\n\nof two", ""), (3, "", "", "")], "id int, introduction string, summary string, rating string")
    words = ("test", "risk", "area", "owner", "due", "reference", "details", "consequences")
    entries = spark.range(n).select((F.col("id") % 2 + 1).cast("int").alias("id"), F.when(F.col("id") % 5 == 4, "suggestion").otherwise("recommendation").alias("kind"), (F.lit(n) - F.col("id")).cast("int").alias("number"), F.concat(F.lit("T "), "id").alias("title"), F.lit(False).alias("proposed"), *(F.lit("").alias(c) for c in words), F.lit("Some.\n\n# not a heading of ours").alias("incidence"), F.lit("Do it.\n\nAnd that.").alias("recommendation"))
    return heads, entries.where("id < 3")


def test_reports_as_lines(spark):
    heads, entries = _long_report(spark, 40)
    texts = {r["id"]: r["text"] for r in reports.render_reports(heads, entries, "id").collect()}
    rows = reports.render_lines(heads, entries, "id")
    got = {i: [r["text"] for r in rows.where(f"id = {i}").orderBy("line").collect()] for i in texts}
    assert {i: "\n".join(x).rstrip() + "\n" for i, x in got.items()} == texts
    assert all([r["line"] for r in rows.where(f"id = {i}").orderBy("line").collect()] == list(range(len(x))) for i, x in got.items())
    whole = spark.createDataFrame(list(texts.items()), "id int, text string")
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(reports.entries_of(rows, "id")) == order(reports.parse_entries(whole, "id"))
    assert order(reports.heads_of(rows, heads.select("id"), "id")) == order(reports.parse_heads(whole, "id"))
    new = reports.render_lines(heads.withColumn("introduction", F.when(F.col("id") == 1, "Other").otherwise("")), entries.where("number % 7 <> 0"), "id")
    news = new.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("new"))
    assert order(reports.compare_lines(rows, new, heads.select("id"), "id")) == order(reports.compare_reports(whole.withColumnRenamed("text", "old").join(news, "id"), "id"))


def test_long_reports_are_not_one_window(spark):
    """No window, sort or list of the lines of a report: only its headings and sums of stretches are ordered as a whole."""
    plan = reports.entries_of(reports.render_lines(*_long_report(spark, 10), "id"), "id")._jdf.queryExecution().optimizedPlan().toString()
    by_report = [x for x in re.findall(r"Window \[(.*?)\], \[id#\d+\w*(?:, part#\d+\w*)?\], ", plan)]
    assert by_report and all("lead(line" in x or "_part" in x or "sum(_number" in x for x in by_report)


def test_states_without_edit_scripts(spark):
    """Line breaks and blanks as Python has them; the state alone needs no Python."""
    texts = [("a\u2028b", "a\nb"), ("a\u00a0", "a"), ("a\n\u3000\x1f\nb", "a\r\nb"), ("a\x85b", "a b"), ("", "\n \n"), ("a", "a"), ("a\x0bb\x1c", "a\n\nb")]
    old, new = (spark.createDataFrame([(i, "k", "T", 1, x[side]) for i, x in enumerate(texts)], "doc int, kind string, title string, ord long, text string") for side in (0, 1))
    found = diff.compare_sections(old, new, "doc")
    rows = found.collect()
    assert len(rows) == len(texts) and all((r["state"] == "modified") == (r["added"] + r["deleted"] > 0) for r in rows)
    assert {r["doc"] for r in rows if r["state"] == "equal"} == {0, 2, 4, 5, 6}
    assert "line_diff" not in found.select("doc", "state")._jdf.queryExecution().optimizedPlan().toString()


def patched(old, text):
    """What a unified difference makes of a text."""
    lines, out, at = (old or "").splitlines(), [], 0
    for hunk in re.split(r"(?m)^(?=@@ )", text)[1:]:
        head, *body = hunk.split("\n")
        start, n = re.match(r"@@ -(\d+)(?:,(\d+))?", head).groups()
        start = int(start) - (n != "0")
        out += lines[at:start]
        at = start
        for line in body:
            if line[:1] in (" ", "-"):
                assert lines[at] == line[1:]
                at += 1
            if line[:1] in (" ", "+"):
                out.append(line[1:])
    return out + lines[at:]


def test_unified(spark):
    rnd = random.Random(4)
    rows = [(i, "\n".join(rnd.choice("abcde") * 2 for _ in range(rnd.randint(1, 30))), "\n".join(rnd.choice("abcde") * 2 for _ in range(rnd.randint(1, 30)))) for i in range(40)]
    rows += [(100, None, "x\ny"), (101, "x", None), (102, "same\nsame", "same\nsame"), (103, None, None), (104, "\n".join(map(str, range(300))), "\n".join(str(x) for x in range(300) if x % 50))]
    pairs = spark.createDataFrame(rows, "id int, old string, new string")
    got = {r["id"]: r["diff"] for r in edits.unified(pairs, "id").collect()}
    assert got.keys() == {r[0] for r in rows} and got[102] == got[103] == ""
    for i, old, new in rows:
        assert patched(old, got[i]) == (new or "").splitlines()
    assert got[104].count("@@ -") == 6 and got[104].startswith("--- old\n+++ new\n@@ -1,3 +1,2 @@\n-0\n 1\n 2\n@@ -49,5 +48,4 @@")
    assert got[100] == "--- old\n+++ new\n@@ -0,0 +1,2 @@\n+x\n+y"


def test_best_pairs(spark):
    a = spark.createDataFrame([(1, 1, "the rates are old"), (1, 2, "nobody signs"), (1, 3, "zzz"), (1, 4, None), (None, 5, "x")], "g int, id int, t string")
    b = spark.createDataFrame([(1, 7, "the rates are old."), (1, 8, "the rates are cold"), (1, 9, "nobody ever signs"), (2, 1, "zzz"), (1, 6, "")], "g int, id int, t string")
    assert {(r["left_id"], r["right_id"]) for r in matching.best_pairs(a, b, "g", "id", "t").collect()} == {(1, 7), (2, 9)}
    assert matching.best_pairs(a.limit(0), b, "g", "id", "t").collect() == []


@pytest.mark.parametrize("by", ["score", "order"])
def test_best_pairs_are_the_greedy_ones(spark, by):
    """Near copies and exact ones of texts with repeated words, against all pairs of each group in order."""
    rnd = random.Random(7)
    base = [[rnd.choice("abcdefghij") * 3 for _ in range(rnd.randint(1, 12))] for _ in range(8)]
    near = lambda: " ".join(w if rnd.random() < 0.85 else rnd.choice("xyz") for w in rnd.choice(base))
    rows = [[(rnd.randint(0, 2), i, near()) for i in range(40)] for _ in range(2)]

    def likeness(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 2 * t[-1][-1] / (len(a) + len(b))

    score = {(g, i, j): likeness(x.split(), y.split()) for g, i, x in rows[0] for h, j, y in rows[1] if g == h}
    order = sorted((k for k, s in score.items() if s >= 0.6), key=lambda k: (k[0], *((-score[k], k[1]) if by == "score" else (k[1], -score[k])), k[2]))
    used, plain = set(), []
    for g, i, j in order:
        if not used & {(g, 0, i), (g, 1, j)}:
            used |= {(g, 0, i), (g, 1, j)}
            plain.append((g, i, j))
    left, right = (spark.createDataFrame(r, "g int, id int, t string") for r in rows)
    assert sorted(tuple(r)[:3] for r in matching.best_pairs(left, right, "g", "id", "t", by=by).collect()) == sorted(plain)


def test_hopeless_candidates_are_left_out(spark):
    """Texts whose first shared word leaves too few to share are no candidates; those that are alike are."""
    side = lambda rows: spark.createDataFrame([(1, i, w) for i, w in rows], "g int, id int, w array<string>")
    some = lambda p, k: [f"{p}{i}" for i in range(k)]
    left = side([(1, [*some("a", 5), "x", *some("c", 4)]), (2, ["q", "r", "s", "t", "t"]), (4, some("c", 4)), (5, some("c", 4))])
    right = side([(1, [*some("b", 5), "x", *some("d", 4)]), (2, ["q", "r", "s", "t", "u"]), (4, some("d", 4)), (5, some("d", 4))])
    got = {(r["left_id"], r["right_id"]) for r in matching.candidates(left, right, 0.6).collect()}
    assert got == {(2, 2)}


def test_ids_of_pairs_are_whole(spark):
    """Long ids that a double can't tell apart, equal texts and alike ones."""
    a, b = 2**62 + 1, -(2**62) - 3
    side = lambda *rows: spark.createDataFrame(rows, "g int, id long, t string")
    got = matching.best_pairs(side((1, a, "p q r s t u v w x y"), (1, a + 1, "the same text")), side((1, b, "p q r s t u v w x z"), (1, b + 1, "the same text")), "g", "id", "t", 0.8)
    assert sorted(tuple(r)[1:3] for r in got.collect()) == [(a, b), (a + 1, b + 1)]


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_candidates_are_alike(spark, least):
    """Every alike pair of texts of all sizes is a candidate, by words lost, put in and changed anywhere; few unlike ones are, though all share rare words."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(20 if rnd.random() < 0.3 else 2000)}"
    base = [[word() for _ in range(n)] for n in [*range(1, 25), *range(30, 300, 9)] for _ in range(2)]
    edit = lambda w, share: [x for v in w for x in (([v] if rnd.random() > share else []) if kind == 0 else [v, word()] if kind == 1 and rnd.random() < share else [word()] if kind == 2 and rnd.random() < share else [v])] or w
    other = []
    for k, w in enumerate(base):
        kind = k % 3
        other.append(edit(w, (1 - least) * (1 if kind == 2 else 1.5) * rnd.choice((0.5, 0.9, 1))))
    side = lambda texts: spark.createDataFrame([(1, f"t{i}", w) for i, w in enumerate(texts)], "g int, id string, w array<string>")
    got = {(r["left_id"], r["right_id"]) for r in matching.candidates(side(base), side(other), least).collect()}
    alike = {(f"t{i}", f"t{j}") for i, a in enumerate(base) for j, b in enumerate(other) if 2 * min(len(a), len(b)) >= least * (len(a) + len(b)) and 2 * len(edits.longest_common(a, b)) >= least * (len(a) + len(b)) - 1e-9}
    assert len(alike) > 50 and alike <= got
    short = {f"t{i}" for i, w in enumerate(base) if len(w) < 60}
    assert least < 0.75 or len([p for p in got - alike if p[0] not in short]) <= 20


def test_batches_of_texts_are_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        pairs = spark.createDataFrame([(1, "a", "b")], "id int, old string, new string")
        changes = pairs.select("id", F.lit(1).alias("seq"), F.lit(None).cast("string").alias("section"), "old", "new", F.lit(None).cast("string").alias("insert_after"))
        for call in (lambda: edits.hunks(pairs, "id"), lambda: patch.apply_changes(pairs, changes, "id", "old"), lambda: lint.findings(pairs, [lint.Rule("a", message="b")], "id", "old")):
            spark.conf.set(key, "10000")
            call()
            assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)


def test_publish(spark):
    docs = spark.createDataFrame([(1, WRITTEN), (2, WRITTEN)], "id int, text string")
    blank = dict.fromkeys(("test", "risk", "area", "owner", "due", "reference", "details", "consequences"), "")
    row = lambda i, ident, title, **more: {"id": i, "ident": ident, "state": "aprobada", "kind": "recommendation", "title": title, "proposed": False, "incidence": f"Sobre {title}", "recommendation": "Hacerlo.", **blank, **more}
    found = spark.createDataFrame(
        [row(1, "C-01", "Tarifas · 2.11"), row(1, "C-02", "Nueva"), row(1, "C-03", "Sin validar", proposed=True), row(1, "C-04", "Mejora", kind="suggestion", recommendation=" "), row(1, "C-05", "Borrador", state="propuesta")],
        "id int, ident string, state string, kind string, title string, proposed boolean, incidence string, recommendation string, test string, risk string, area string, owner string, due string, reference string, details string, consequences string",
    )
    told = {r["ident"]: (r["hindrances"], r["present"], r["enters"]) for r in publishing.plan(docs, found, "id", append=True).collect()}
    assert told == {"C-01": ([], True, False), "C-02": ([], False, True), "C-03": (["level only proposed"], False, False), "C-04": (["no proposal"], False, False)}
    for append, titles in ((True, ["Tarifas · 2.11", "Sin número", "Nueva"]), (False, ["Tarifas · 2.11", "Nueva"])):
        out = publishing.published(docs, found, "id", append)
        entries = reports.parse_entries(out, "id", "new").where("id = 1").orderBy("number").collect()
        assert [r["title"] for r in entries] == titles
        assert out.where("id = 2 and old = new").count() == 1
    states = sorted((r["title"], r["state"]) for r in publishing.preview(docs, found, "id", append=True).where("id = 1 and state <> 'equal'").collect())
    assert ("Nueva", "new") in states and all(s != "deleted" for _, s in states)


def test_findings_round_trip(spark):
    rows = [(1, 1, "Rates", {"impact": "High", "cause": "a\nb"}), (1, 2, "Empty", {"impact": "x"})]
    found = spark.createDataFrame(rows, "doc int, block long, title string, fields map<string,string>")
    text = markdown.render_findings(found, "doc", {"impact": "Impact", "cause": "Cause"})
    back = {r["block"]: (r["title"], r["fields"]) for r in markdown.parse_findings(text, "doc").collect()}
    assert back == {1: ("Rates", {"impact": "High", "cause": "a\nb"}), 2: ("Empty", {"impact": "x"})}


def test_tables_and_sheets(spark):
    df = spark.createDataFrame([([["a", "b|c"], ["1"]],)], "rows array<array<string>>")
    assert df.select(markdown.table(F.col("rows"))).first()[0] == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    cells = [("s", 1, 1, "Only text"), *[("s", r, c, str(r * c)) for r in range(2, 60) for c in (1, 3)], ("s", 3, 2, " ")]
    got = markdown.compact_sheet(spark.createDataFrame(cells, "sheet string, row int, col int, value string"), "sheet").collect()
    assert [r["kind"] for r in got].count("data") == 40 and [r["cells"] for r in got if r["kind"] == "omitted"] == [["18"]]


def test_markdown_lint_lines(spark):
    text = "# Always a title\n\nIntro line\nwe always fail\n\n> always quoted\n\n**Cause:** Always.\n- never ALWAYS"
    docs = spark.createDataFrame([(1, text)], "doc int, text string")
    got = lint.markdown_findings(docs, [lint.Rule("always"), lint.Rule("never", severity="warning")], "doc").select("line", "term", "pos", "fragment").collect()
    assert {tuple(r) for r in got} == {(4, "always", 14, "always"), (8, "always", 0, "Always"), (9, "always", 14, "ALWAYS"), (9, "never", 8, "never")}


def test_text_functions(spark):
    df = spark.createDataFrame([("  Revisión «Año 2024» – Área ",)], "t string")
    x = F.col("t")
    got = df.select(X.fold_label(x), X.ascii_key(x), X.loose(x), X.field_key(x), X.slug(x), X.figures(F.lit("1) 25% of 3.400,5 and A-12.")), X.risk_level(F.lit(" Crítico (x)")), X.code_id(F.lit("OBS-3"))).first()
    assert tuple(got) == ("revision «ano 2024» – area", "revision ano 2024 area", "revision ano 2024 - area", "revision_«ano_2024»_–_area", "revision-ano-2024-area", ["25%", "3.400,5", "12"], "Crítico", "C-03")


def test_pages_by_capacity(spark):
    df = spark.createDataFrame([([3.0, 3.0, 5.0, 20.0, 1.0],)], "h array<double>")
    assert df.select(budget.paginate(F.col("h"), 10.0)).first()[0] == [1, 1, 2, 3, 4]


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T  \r\n\r\n\r\n\r\nbody\t\n", encoding="utf-8")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nHello\n\n2\n00:00:03.000 --> 00:00:04.000\nthere\n")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row r="2"/></sheetData></worksheet>')
    files = readers.scan(spark, str(tmp_path))
    found = readers.blocks(files)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.markdown(found).collect()}
    assert got["a.md"] == "# T\n\nbody\n" and got["b.vtt"] == "Hello\n\nthere\n"
    assert got["c.docx"] == "## Head\n\nText\n\n| x |\n| --- |\n" and got["d.xlsx"] == "## One\n\n| name |  | 7 |\n| --- | --- | --- |\n"
    assert [r["path"].rsplit("/", 1)[1] for r in found.where("kind = 'error'").collect()] == ["bad.docx"]


def test_spoken_lines(spark):
    df = spark.createDataFrame([("- [01:05–01:10] Ana: hello: you",), ("other",)], "text string")
    assert [tuple(r)[1:] for r in readers.spoken(df).collect()] == [(65.0, 70.0, "Ana", "hello: you")]


def test_unpasted():
    assert readers.unpasted('"a ""b""\nc"\t\nplain\t\t') == 'a "b"\nc\nplain'


def test_external_model(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, p string")
    got = {r["id"]: r for r in external.complete(rows, "id", "p", "draft", "action string, size int").collect()}
    assert got[1]["answer"].asDict() == {"action": "draft", "size": 3} and got[2]["answer"]["size"] == 0
    bad = external.complete(rows, "id", "p", "x", "a string", provider=lambda *_: "[1]").collect()
    assert all(r["attempts"] == 2 and "no object" in r["error"] for r in bad)


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"name": ["a", "b", "a"], "sha256": ["1", "2", "1"]})
    source = tmp_path / "in"
    for i, part in enumerate((rows.iloc[:2], rows.iloc[2:])):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("name string, sha256 string").parquet(str(source))
        incremental.register_new(stream, str(tmp_path / "reg"), str(tmp_path / "out"), ["name", "sha256"], str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2, i


def test_merged_turns_stream(spark, tmp_path):
    at = pd.to_datetime(["2024-01-01 10:00", "2024-01-01 10:01", "2024-01-01 10:02", "2024-01-01 10:03"])
    spark.createDataFrame(pd.DataFrame({"m": [1] * 4, "who": ["A", "A", "B", "A"], "at": at})).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("m long, who string, at timestamp").parquet(str(tmp_path / "in"))
    q = incremental.merged_turns(stream, "m", "who", "at", "10 minutes").writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["speaker"], r["n"]) for r in spark.table("turns").orderBy("first").collect()] == [("A", 2), ("B", 1)]


def test_patch_sections_by_likeness():
    text = "# Report\n## 1. Access control reviews\nOne.\n### Detail\nIn.\n## 2. Access control reviews\nTwo.\n## Overall opinion of the auditors\nEnd.\n"
    cut = lambda s: text[slice(*patch.section_range(text, s))] if patch.section_range(text, s) else None
    assert cut("2. Access control reviews").startswith("## 2.") and "Two." in cut("2. Access control reviews")
    assert cut("### 1) access control review").endswith("In.\n")
    assert cut("Overall opinion").startswith("## Overall")
    assert cut("3. Access control reviews") is None and cut("Budget") is None and cut("") is None
    assert patch.sections("no heading") == [] and patch.section_range("", "x") is None


def test_text_labels_of_nulls_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "según"), (4, "antes-de-deshacer"), (5, "sug: a\tb/c"), (6, "#### ||| ==\nuna frase con letras y palabras")], "id int, x string")
    x = F.col("x")
    out = {r["id"]: tuple(r)[1:] for r in rows.select("id", X.legible(x), X.file_name(x), X.finding_kind(x), X.change_origin(x), X.contentless(x)).collect()}
    assert out[1] == ("", None, "recomendacion", "Cambio", None)
    assert out[2] == ("", "", "recomendacion", "Cambio", True)
    assert out[3][4] is True and out[4][3] == "Deshacer" and out[5][1:3] == ("sug_abc", "sugerencia")
    assert out[6][0] == "una frase con letras y palabras"


def test_bands_sort_and_deal_out_pages_once(spark):
    """Bands, and whether lines stand alone in them, take one exchange by page that isn't merged and one sort; edges that touch part bands."""
    rows = [(page, y, y + h) for page in range(20) for y, h in ((0, 10), (5, 3), (10, 5), (10, 5), (20, 0), (20, 0), (30, 9), (39, 1))]
    lines = spark.createDataFrame(rows, "page int, y0 int, y1 int")
    banded = layout.bands(lines, "page", "y0", "y1")
    got = layout.alone(banded, "page", "band", ["y0", "y1"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, layout.alone(banded, "page", "band").collect()))
    assert {tuple(x) for x in got.select("page", "y0", "alone").distinct().collect() if x[0] == 0} == {(0, 0, False), (0, 5, False), (0, 10, False), (0, 20, False), (0, 30, True), (0, 39, True)}
    plan = got.groupBy("page", "band").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_reading_order_deals_out_pages_once(spark):
    """Pieces are brought back to their lines without a shuffle: all exchanges are those of the lines by page."""
    rows = [(p, f"{p}-{r}-{c}", f"text {r} {c}", c * 100 + r % 3, c * 100 + 60, r * 20, r * 20 + 12) for p in range(3) for r in range(5) for c in range(3)]
    lines = spark.createDataFrame(rows, "page int, ident string, text string, x0 int, x1 int, y0 int, y1 int")
    got = layout.reading_order(lines, "page", "ident")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") <= 2
    found = {r["ident"]: (r["column"], r["breaks"]) for r in got.where("page = 1").collect()}
    assert {found[f"1-{r}-{c}"] for r in range(5) for c in range(3)} == {(0, False), (0, True), (1, True), (2, True)} and sum(r["place"] for r in got.where("page = 1").collect()) == 15 * 16 // 2


def test_entries_of_a_report_are_spread_over_all_partitions(spark):
    """The windows over entries stay on as many partitions as the session has, however little room their lines take on the way."""
    lines = reports.lines_of(spark.createDataFrame([(1, "## Detalle de conclusiones\n\n### 1. One\n\n- Prueba: t\n\nProse.\n")], "report int, text string"), "report")
    got = reports.entries_of(lines, "report")
    assert [(r["title"], r["test"], r["incidence"]) for r in got.collect()] == [("One", "t", "Prose.")]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_compared_sections_are_written_compressed(spark):
    """Of two versions' texts, whose hexadecimal digits take half a byte each, less than three quarters goes into the shared folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    folder = Path(sc.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    old = spark.range(40).select(F.lit(1).alias("doc"), F.lit("line").alias("kind"), F.concat(F.lit("Title "), "id").alias("title"), F.col("id").alias("ord"), F.expr("array_join(transform(sequence(1, 300), k -> sha2(concat(id, ' ', k), 256)), ' ')").alias("text"))
    new = old.where("ord <> 7").withColumn("text", F.when(F.col("ord") == 9, F.concat("text", F.lit("more"))).otherwise(F.col("text")))
    before = size()
    states = {r["title"]: r["state"] for r in diff.compare_sections(old, new, "doc").collect()}
    assert states == {f"Title {i}": {7: "deleted", 9: "modified"}.get(i, "equal") for i in range(40)}
    assert size() - before < 1.5 * old.agg(F.sum(F.length("text"))).first()[0]


def test_names_of_meetings_go_with_their_keys(spark):
    """Files of a meeting from the newest on, repeated ones too, without a join that reads all names again."""
    names = ["2024-01-02_0900_Plan.md", "2024-01-03_0900_Plan_B.txt", "2024-01-03_0900_Plan_B.txt", "2024-01-04_0900_Other.md", "2024-01-05_0900_Plan.png", None]
    files = spark.createDataFrame([(f, n) for f in (1, 2) for n in names] + [(None, names[0])], "folder long, name string")
    found = meetings.meetings(files, "folder", "name")
    assert "Join" not in found._jdf.queryExecution().toString()
    want = [("other", "2024-01-04 0900 ", ["2024-01-04_0900_Other.md"], []), ("plan", "2024-01-03 0900 ", names[:1], names[1:3])]
    assert sorted(map(tuple, found.collect())) == [(f, *w) for f in (1, 2) for w in want]

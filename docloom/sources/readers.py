"""Documents from folders: text, Markdown, transcripts, and the zipped XML formats, as rows of blocks.

Files come through Spark's binaryFile source, so any store that Spark reads will do; each task decodes its own files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X

BLOCKS = "path string, ext string, page int, ord int, kind string, text string, level int, rows array<array<string>>, note string"
EXTENSIONS = ("md", "txt", "vtt", "docx", "xlsx", "pptx")
#: Rows read of a sheet; the note of its last block says if there were more.
SHEET_ROWS = 2000


def scan(spark: SparkSession, folder: str, recursive: bool = False, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name, ext, stem, sha256, modified, length, content) of a folder's files with these extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"), "length", "content")


def vtt_text(x: Column) -> Column:
    """What is spoken in a WebVTT file: without header, cue numbers and times; blank runs are one."""
    plain = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"(?m)^(WEBVTT.*|\d+|[\d:.]+\s*-->.*)$", "")
    return X.clean_whitespace(plain)


def unpasted(text: str) -> str:
    """Text pasted from a spreadsheet: cells without their quotes, lines without the tabs at their ends."""
    out, cell = [], False
    for line in text.split("\n"):
        body = line if cell else line.rstrip("\t ")
        quotes = body.count('"')
        if not cell and body.startswith('"'):
            body = body[1:]
            cell = quotes % 2 == 1
        elif cell and quotes % 2 == 1:
            body, cell = body.rstrip("\t "), False
        if not cell and body.endswith('"'):
            body = body[:-1]
        out.append(body.replace('""', '"'))
    return "\n".join(out)


def _plain(name: str, data: bytes) -> Iterator[tuple]:
    text, note = data.decode("utf-8", "replace"), None
    if "\t" in text or re.search('(?m)^"', text):
        text, note = unpasted(text), "pasted from a spreadsheet"
    yield 1, "text", text, None, None, note


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _said(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def _docx(name: str, data: bytes) -> Iterator[tuple]:
    page = 1
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for node in body:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            style = style.get(f"{_W}val", "") if style is not None else ""
            heading = re.fullmatch(r"(?:Heading|Ttulo|Título|Titulo)\s?(\d)", style)
            kind = "heading" if heading or style == "Title" else "list" if node.find(f"{_W}pPr/{_W}numPr") is not None else "paragraph"
            if text := _said(node, f"{_W}t").strip():
                yield page, kind, text, int(heading[1]) if heading else 1 if kind == "heading" else None, None, None
            page += sum(b.get(f"{_W}type") == "page" for b in node.iter(f"{_W}br"))
        elif node.tag == f"{_W}tbl":
            yield page, "table", "", None, [["\n".join(_said(p, f"{_W}t") for p in c.iter(f"{_W}p")).strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")], None


def _xlsx(name: str, data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_said(x, f"{_S}t") for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for page, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            rows, more = [], False
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    at = 0
                    for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = c.findtext(f"{_S}v") or ""
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else _said(c, f"{_S}t") if c.get("t") == "inlineStr" else value)
                if any(x.strip() for x in cells):
                    if more := len(rows) >= SHEET_ROWS:
                        break
                    rows.append(cells)
            yield page, "heading", sheet.get("name"), 2, None, None
            if rows:
                yield page, "table", "", None, rows, f"only the first {SHEET_ROWS} rows" if more else None


def _pptx(name: str, data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for page, (number, part) in enumerate(slides, 1):
            first = True
            for node in ElementTree.fromstring(z.read(part)).iter():
                if node.tag.endswith("}sp"):
                    if text := "\n".join(filter(None, (_said(p, f"{_A}t").strip() for p in node.iter(f"{_A}p")))):
                        yield page, "heading" if first else "paragraph", text, 2 if first else None, None, None
                        first = False
                elif node.tag == f"{_A}tbl":
                    yield page, "table", "", None, [[_said(c, f"{_A}t").strip() for c in r.iter(f"{_A}tc")] for r in node.iter(f"{_A}tr")], None
            if f"ppt/notesSlides/notesSlide{number}.xml" in z.namelist() and (text := _said(ElementTree.fromstring(z.read(f"ppt/notesSlides/notesSlide{number}.xml")), f"{_A}t").strip()):
                yield page, "quote", text, None, None, None


#: What decodes an extension's files to (page, kind, text, level, rows, note); users may add their own.
DECODERS = {"md": _plain, "txt": _plain, "vtt": _plain, "docx": _docx, "xlsx": _xlsx, "pptx": _pptx}


NAMES = [x.split()[0] for x in re.split(r", (?=\w+ )", BLOCKS)]
_KINDS = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string())), pa.string())


def decoded(path: str, ext: str, data: bytes, known: dict) -> list[tuple]:
    """A file's rows of BLOCKS; one of kind error with the reason if it can't be decoded."""
    try:
        if ext not in known:
            raise ValueError(f"no reader for .{ext}; there are {', '.join(sorted(known))}")
        return [(path, ext, x[0], n, *x[1:]) for n, x in enumerate(known[ext](path, data))]
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [(path, ext, None, None, "error", None, None, None, str(e))]


def columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([x[i] for x in rows], k) for i, k in enumerate(_KINDS)]


def blocks(files: DataFrame, decoders: dict | None = None) -> DataFrame:
    """Rows of BLOCKS of files from scan(). What can't be decoded is one row of kind error with the reason as note."""
    known = decoders or DECODERS

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            files = zip(*(b.column(c).to_pylist() for c in ("path", "ext", "content")), strict=True)
            yield pa.RecordBatch.from_arrays(columns([x for path, ext, data in files for x in decoded(path, ext, data, known)]), names=NAMES)

    return files.select("path", "ext", "content").mapInArrow(batches, BLOCKS)


def markdown(found: DataFrame) -> DataFrame:
    """(path, text): a file's blocks in order as Markdown."""
    from docloom.operators.markdown import table

    body = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text"))
        .when(F.col("kind") == "list", F.concat(F.lit("- "), "text"))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> "))))
        .when(F.col("kind") == "table", table(F.col("rows")))
        .when(F.col("ext") == "vtt", vtt_text(F.col("text")))
        .otherwise(F.col("text"))
    )
    rows = found.where("kind <> 'error'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "ord", body.alias("t")))).alias("b"))
    return rows.select("path", X.clean_whitespace(F.array_join(F.transform("b", lambda x: x["t"]), "\n\n")).alias("text"))


def spoken(lines: DataFrame, text: str = "text") -> DataFrame:
    """Segments of «- [mm:ss–mm:ss] who: what» lines: start_s, end_s, speaker, said; other lines are left out."""
    form = r"^\s*-\s*\[(\d+):(\d\d)\s*[–-]\s*(\d+):(\d\d)\]\s*([^:]+):\s*(.*)$"
    part = lambda n: F.regexp_extract(text, form, n)
    own = lines.where(F.col(text).rlike(form))
    at = lambda m, s: (part(m).cast("int") * 60 + part(s).cast("int")).cast("double")
    return own.withColumns({"start_s": at(1, 2), "end_s": at(3, 4), "speaker": F.trim(part(5)), "said": F.trim(part(6))})

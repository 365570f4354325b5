"""Flattening of document XML: one row for each act, section, term and candidate.

This is the only Python between files and tables. Text order in mixed content can't be
had from the built-in XML reader, so each document is walked once, in Arrow batches.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .files import contents, storage

INLINE = frozenset(("b", "i", "span", "sub", "sup", "u"))
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1000
CONTROL = re.compile("[\x1c-\x1f]")

FLAT = (
    "path string, error string, frbr_uri string, expr_date string, full_text string, "
    "sections array<struct<eid:string,heading:string,text:string,prose_text:string,doc_pos:int,refs:array<struct<href:string,ref_text:string>>>>, "
    "terms array<struct<term:string,display_term:string,section_eid:string,definition_text:string,doc_pos:int>>, "
    "candidates array<struct<text:string,section_eid:string,doc_pos:int>>"
)


def _rows(**fields: pa.DataType | str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.string() if t == "s" else t) for n, t in fields.items()]))


ARROW = pa.schema([
    *[(n, pa.string()) for n in ("path", "error", "frbr_uri", "expr_date", "full_text")],
    ("sections", _rows(eid="s", heading="s", text="s", prose_text="s", doc_pos=pa.int32(), refs=_rows(href="s", ref_text="s"))),
    ("terms", _rows(term="s", display_term="s", section_eid="s", definition_text="s", doc_pos=pa.int32())),
    ("candidates", _rows(text="s", section_eid="s", doc_pos=pa.int32())),
])


def _name(el: ET.Element) -> str:
    return el.tag.rsplit("}", 1)[-1] if isinstance(el.tag, str) else ""


def _flat(text: str) -> str:
    return " ".join(text.split())


def prose(section: ET.Element) -> str:
    """Text outside refs and headings. What follows an element counts, even where the
    element lies in one that is left out."""
    parts: list[str] = []
    todo: list[tuple[ET.Element, bool, bool]] = [(section, False, False)]
    while todo:  # (element, left out, whether its inside has been walked)
        el, out, done = todo.pop()
        if done:
            parts.append(el.tail or "")
            continue
        if not out and isinstance(el.tag, str):
            parts.append(el.text or "")
        if el is not section:
            todo.append((el, out, True))
        for child in reversed(el):
            todo.append((child, out or _name(child) in ("heading", "ref"), False))
    return _flat("".join(parts))


def flatten(data: bytes) -> dict:
    """Everything of one document; ValueError without its address, ParseError for
    broken XML."""
    root = ET.fromstring(data)
    work = root.find(".//{*}FRBRWork/{*}FRBRuri")
    uri = (work.get("value") if work is not None else None) or ""
    if not uri:
        raise ValueError("no FRBRWork/FRBRuri")
    date = next((d.get("date") for d in root.iterfind(".//{*}FRBRExpression/{*}FRBRdate") if d.get("name") == "Generation"), None)
    sections, terms, candidates = [], [], []
    stack: list[tuple[ET.Element, str]] = [(root, "")]
    pos = 0
    while stack:
        el, inside = stack.pop()
        name = _name(el)
        pos += 1
        if name == "section":
            inside = el.get("eId", "")
            heading = next((h for h in el if _name(h) == "heading"), None)
            refs = [{"href": r.get("href", ""), "ref_text": "".join(r.itertext()).strip()} for r in el.iter() if _name(r) == "ref"]
            sections.append({"eid": inside, "heading": (heading.text or "").strip() or None if heading is not None else None, "text": _flat(CONTROL.sub(" ", "".join(el.itertext()))), "prose_text": prose(el), "doc_pos": pos, "refs": refs})
        elif name == "p":
            kids = {_name(c) for c in el}
            if {"term", "def"} <= kids:
                term = next(c for c in el if _name(c) == "term")
                text = next(c for c in el if _name(c) == "def")
                display = (term.text or "").strip()
                if display:
                    terms.append({"term": display.lower(), "display_term": display, "section_eid": inside, "definition_text": "".join(text.itertext()).strip(), "doc_pos": pos})
            elif kids <= INLINE:
                text = "".join(el.itertext()).strip()
                if text:
                    candidates.append({"text": text, "section_eid": inside, "doc_pos": pos})
        for child in reversed(el):
            stack.append((child, inside))
    return {"frbr_uri": uri.rstrip("/"), "expr_date": date, "full_text": _flat(CONTROL.sub(" ", "".join(root.itertext()))), "sections": sections, "terms": terms, "candidates": candidates}


def _flat_row(data: bytes) -> dict:
    """The columns of FLAT but path; an error in place of a document that can't be read."""
    row = dict.fromkeys(ARROW.names[1:])
    try:
        return row | flatten(data)
    except (ValueError, ET.ParseError) as e:
        return row | {"error": f"{type(e).__name__}: {e}"}


def flat_files(named: DataFrame, folder: str) -> DataFrame:
    """The rows of named, whose column path is relative to the folder or absolute, with
    the FLAT columns of the file each names; error is "missing file" where there is none.
    Files are opened one by one where their rows are: nothing lists the folder, and a row
    meets its file without a join."""
    at = named.columns.index("path")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema) + "," + FLAT.split(",", 1)[1]
    docs = pa.schema(list(ARROW)[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = storage(folder)
        for b in batches:
            rows, size, start = [], 0, 0
            for path in [*b.column(at).to_pylist(), Ellipsis]:
                if rows and (path is Ellipsis or size >= BATCH_BYTES or len(rows) >= BATCH_ROWS):
                    part, new = b.slice(start, len(rows)), pa.RecordBatch.from_pylist(rows, docs)
                    yield pa.RecordBatch.from_arrays([*part.columns, *new.columns], names=[*part.schema.names, *docs.names])
                    rows, size, start = [], 0, start + len(rows)
                if path is Ellipsis:
                    break
                data = contents(where, base, path) if path else None
                rows.append(dict.fromkeys(docs.names) | {"error": "missing file"} if data is None else _flat_row(data))
                size += len(data or b"")

    return named.mapInArrow(run, schema)


def flat_documents(files: DataFrame) -> DataFrame:
    """FLAT rows of files (path, content). A document that can't be read has error and
    nothing else. Rows go on in batches of about BATCH_BYTES of XML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                data = data.as_py() or b""
                row = {"path": path.as_py()} | _flat_row(data)
                rows.append(row)
                size += len(data)
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.select("path", "content").mapInArrow(run, FLAT)

"""Uploaded files: what they are, and whether they can be read. Bytes come from Spark's binaryFile reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters a deck may hold, and XML names of slides.
MOST_CHARS = 40_000_000
A, P, R = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PROBE = "struct<kind: string, encrypted: boolean, has_eof: boolean, pages: int, entries: int, inflated: long, damaged: boolean>"
SLIDES = "path string, slide int, title string, body string, notes string, words int, error string"


def pdf_pages(raw: bytes) -> int | None:
    """Page objects, if as many as the largest /Count says; else null."""
    n = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", raw))
    counts = [int(x) for x in re.findall(rb"/Count\s+(\d+)", raw)]
    return n if n and counts and n == max(counts) else None


#: The part that tells an office file's kind.
OOXML = {"pptx": "ppt/presentation.xml", "docx": "word/document.xml", "xlsx": "xl/workbook.xml"}


def probe(raw: bytes) -> tuple:
    """(kind, encrypted, has_eof, pages, entries, inflated, damaged) of a file's bytes."""
    if b"%PDF-" in raw[:1024]:
        return "pdf", bool(re.search(rb"/Encrypt\s+\d", raw)), b"%%EOF" in raw[-2048:], pdf_pages(raw), None, None, b"%%EOF" not in raw[-2048:]
    if raw[:2] == b"PK":
        try:
            entries = zipfile.ZipFile(io.BytesIO(raw)).infolist()
        except (zipfile.BadZipFile, ValueError, OSError):
            return "zip", False, None, None, None, None, True
        names = {e.filename for e in entries}
        kind = next((k for k, part in OOXML.items() if part in names), "zip")
        return kind, any(e.flag_bits & 1 for e in entries), None, None, len(entries), sum(e.file_size for e in entries), False
    try:
        raw[:4096].decode("utf-8")
        return ("txt" if raw else "empty"), False, None, None, None, None, False
    except UnicodeDecodeError as e:
        return ("txt" if e.start > 4090 else "other"), False, None, None, None, None, False


def sliced(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches of fewer rows, for what makes or holds a file's bytes a row."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


def probed(files: DataFrame) -> DataFrame:
    """Adds `probe` to (path, content binary, ...)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            found = [probe(bytes(x) if x is not None else b"") for x in b["content"]]
            out = pd.DataFrame(found, columns=["kind", "encrypted", "has_eof", "pages", "entries", "inflated", "damaged"])
            out.insert(0, "path", b["path"].to_numpy())
            out.insert(1, "size", [len(x) if x is not None else 0 for x in b["content"]])
            yield out.astype({"pages": "Int32", "entries": "Int32", "inflated": "Int64", "has_eof": "boolean"})

    return files.select("path", "content").mapInPandas(run, "path string, size long, kind string, encrypted boolean, has_eof boolean, pages int, entries int, inflated long, damaged boolean")


def text_of(node: ElementTree.Element) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in node.iter(f"{A}p")).strip()


def slides_of(raw: bytes) -> list[tuple[int, str, str, str, int]]:
    """(slide, title, body, notes, words) in the order of the presentation's relationships."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    if sum(e.file_size for e in z.infolist()) > MOST_CHARS:
        raise ValueError("too large")
    xml = lambda name: ElementTree.fromstring(z.read(name))
    links = lambda name: {x.get("Id"): (x.get("Type", ""), x.get("Target", "")) for x in xml(name)} if name in z.namelist() else {}
    parts = links("ppt/_rels/presentation.xml.rels")
    out = []
    for n, ref in enumerate(xml("ppt/presentation.xml").iter(f"{P}sldId"), 1):
        name = "ppt/" + parts[ref.get(f"{R}id")][1].removeprefix("/ppt/").removeprefix("../")
        title, body, notes = "", [], ""
        for shape in xml(name).iter(f"{P}sp"):
            mark = next(shape.iter(f"{P}ph"), None)
            text = text_of(shape)
            if mark is not None and mark.get("type") in ("title", "ctrTitle") and not title:
                title = text
            elif text:
                body.append(text)
        for row in xml(name).iter(f"{A}tr"):
            body.append(" | ".join(text_of(c) for c in row.iter(f"{A}tc")))
        folder, _, base = name.rpartition("/")
        for kind, target in links(f"{folder}/_rels/{base}.rels").values():
            if kind.endswith("/notesSlide"):
                notes = text_of(xml("ppt/" + target.removeprefix("../")))
        whole = "\n".join([title, *body])
        out.append((n, title, "\n".join(body), notes, len(whole.split())))
    return out


def read_decks(files: DataFrame) -> DataFrame:
    """(path, content) -> a row per slide; a file that can't be read gives one row with `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    rows += [(path, *s, None) for s in slides_of(bytes(raw or b""))]
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SLIDES.split(", ")]).astype({"slide": "Int32", "words": "Int32"})

    return files.select("path", "content").mapInPandas(run, SLIDES)


def unchanged(content: Column, known_hash: Column) -> Column:
    """Has a file the bytes that its checkpointed hash says?"""
    return F.sha2(content, 256).eqNullSafe(known_hash)


def fetch_layer(known_etag: Column, etag: Column, known_modified: Column, modified: Column, known_hash: Column, content: Column) -> Column:
    """By which layer a fetched file is known not to have changed: its tag, its time, the hash of its bytes; null where it changed. A
    tag or time that either side lacks tells nothing."""
    return F.when(etag == known_etag, "etag").when(modified <= known_modified, "last-modified").when(F.sha2(content, 256) == known_hash, "hash")


def fetch_status(code: Column) -> Column:
    return F.when(code.isin(401, 403, 410), "unauthorized").when(code == 304, "not_modified").when(code.between(200, 299), "ok").otherwise("retryable")

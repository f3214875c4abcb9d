"""Redacted files: the parts of a file, redacted, put back in its own format."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import REDACTION, VeilError
from . import files

_S = files._S


def _archive(data: bytes, changed: Mapping[str, bytes]) -> bytes:
    """A zip archive with some members' bytes replaced; all others are as they were."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in source.infolist():
            z.writestr(item, changed.get(item.filename, source.read(item.filename)))
    return out.getvalue()


def _docx(data: bytes, texts: Mapping[str | None, str], contents: Mapping[str | None, bytes]) -> bytes:
    if None in texts:
        data = files.docx_with_text(data, texts[None])
    return _archive(data, {k: v for k, v in contents.items() if k})


def _xlsx(data: bytes, texts: Mapping[str | None, str]) -> bytes:
    """Cells get their text in place. Shared strings are dropped, as they hold what cells held: every cell has its own text then."""
    changed: dict[str, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared, sheets = files.xlsx_sheets(z)
        for part, sheet in sheets.items():
            root = ElementTree.fromstring(z.read(part))
            for c in root.iter(f"{_S}c"):
                old = files.xlsx_value(c, shared)
                if old is None:
                    continue
                name = c.get("r") if sheet is None else f"{sheet}!{c.get('r')}"
                new = texts.get(name, old)
                if new != old or c.get("t") == "s":
                    for child in list(c):
                        c.remove(child)
                    c.set("t", "inlineStr")
                    ElementTree.SubElement(ElementTree.SubElement(c, f"{_S}is"), f"{_S}t").text = new
            changed[part] = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
        if "xl/sharedStrings.xml" in z.namelist():
            changed["xl/sharedStrings.xml"] = f'<sst xmlns="{_S[1:-1]}"/>'.encode()
    return _archive(data, changed)


def _csv(data: bytes, texts: Mapping[str | None, str]) -> bytes:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for k, row in enumerate(csv.reader(io.StringIO(data.decode("utf-8"), newline="")), 1):
        writer.writerow([texts.get(f"{files.column_letters(c)}{k}", value) for c, value in enumerate(row)])
    return out.getvalue().encode()


def _rtf(text: str) -> bytes:
    """A plain file of the text: what the source held beside its text is not carried over."""
    plain = re.sub(r"([\\{}])", r"\\\1", text).replace("\n", "\\par\n").replace("\t", "\\tab ")
    units = "".join(c if ord(c) < 128 else "".join(f"\\u{int.from_bytes(u, 'little', signed=True)}?" for u in (lambda b: (b[i : i + 2] for i in range(0, len(b), 2)))(c.encode("utf-16-le"))) for c in plain)
    return b"{\\rtf1\\ansi " + units.encode("ascii") + b"}"


def rewrite(data: bytes, extension: str | None, texts: Mapping[str | None, str], contents: Mapping[str | None, bytes] = {}) -> bytes:
    """A file with parts replaced: ``texts`` and ``contents`` by part as ``decode`` names them. A format that can't be written is an error."""
    e = (extension or "").lower().lstrip(".")
    kind = files.modality(e)
    try:
        if e == "docx":
            return _docx(data, texts, contents)
        if e == "xlsx":
            return _xlsx(data, texts)
        if e == "csv":
            return _csv(data, texts)
        if kind in ("image", "audio"):
            return contents.get(None, data)
        if None not in texts:
            return data
        if e == "rtf":
            return _rtf(texts[None])
        if e != "pdf":
            return texts[None].encode("utf-8")
    except VeilError:
        raise
    except Exception as x:  # noqa: BLE001
        raise VeilError(REDACTION, f"{e}: {x}") from x
    raise VeilError(REDACTION, f"{e} files can't be written")


def redacted_files(sources: DataFrame, parts: DataFrame, text_col: str = "redacted", content_col: str = "content") -> DataFrame:
    """(file, extension, content, error) of the files ``sources`` (file, extension, content), with the redacted ``parts`` (file, part_id, text or content) in place.

    A file that can't be written has no content and says why: its source bytes
    never stand in. A file of which no part is given isn't in the result.
    """
    of_file = parts.groupBy("file").agg(F.collect_list(F.struct("part_id", F.col(text_col).alias("text"), F.col(content_col).alias("content"))).alias("parts"))
    both = sources.select("file", "extension", "content").join(of_file, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for e, data, given in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                try:
                    texts = {p["part_id"]: p["text"] for p in given if p["text"] is not None}
                    contents = {p["part_id"]: p["content"] for p in given if p["content"] is not None}
                    if not texts and not contents:
                        raise VeilError(REDACTION, "no part of the file was redacted")
                    out.append(rewrite(data, e, texts, contents))
                    errors.append(None)
                except VeilError as x:
                    out.append(None)
                    errors.append(str(x))
            yield pa.record_batch([*b.columns[:2], pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["file", "extension", "content", "error"])

    return both.mapInArrow(run, "file string, extension string, content binary, error string")

"""Document sources: the format follows from the extension, never from the content type.

Undecodable bytes don't fail a job: the row carries decode_error, so it can be
set aside.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CAPABILITY_UNAVAILABLE, MALFORMED_INPUT, VeilError

#: Extension to body modality. Formats that only a codec library could decode are refused by name.
FORMATS = {"txt": "text", "json": "text", "html": "text", "htm": "text", "xml": "text", "rtf": "text", "docx": "text", "pdf": "text", "csv": "tabular", "xlsx": "tabular", "png": "image", "tiff": "image", "tif": "image", "wav": "audio"}
REFUSED = {"jpeg": "image", "jpg": "image", "mp3": "audio"}
#: Whether pages can be rendered as images.
RENDERABLE = False
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def modality(extension: str | None) -> str:
    e = (extension or "").lower().lstrip(".")
    if e in FORMATS:
        return FORMATS[e]
    raise VeilError(CAPABILITY_UNAVAILABLE, f"no codec for {e!r}")


def docx_parts(data: bytes) -> list[tuple[str | None, str, str | None, bytes | None]]:
    """(part, modality, text, bytes): the body's paragraphs as one text, and each picture under its name in the archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        lines = ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p")]
        out: list[tuple] = [(None, "text", "\n".join(lines), None)]
        for name in sorted(z.namelist()):
            if name.startswith("word/media/"):
                out.append((name, "image", None, z.read(name)))
        return out


def docx_with_text(data: bytes, new: str) -> bytes:
    """The archive with its body's paragraphs replaced, line by line; every other part keeps its bytes."""
    source = zipfile.ZipFile(io.BytesIO(data))
    root = ElementTree.fromstring(source.read("word/document.xml"))
    lines = new.split("\n")
    paragraphs = list(root.iter(f"{_W}p"))
    if len(lines) != len(paragraphs):
        raise VeilError("Redaction", "the body's paragraphs and the redacted text differ in number")
    for p, line in zip(paragraphs, lines):
        for k, t in enumerate(p.iter(f"{_W}t")):
            t.text = line if k == 0 else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in source.infolist():
            z.writestr(item, ElementTree.tostring(root, encoding="utf-8", xml_declaration=True) if item.filename == "word/document.xml" else source.read(item.filename))
    return out.getvalue()


def xlsx_sheets(z: zipfile.ZipFile) -> tuple[list[str], dict[str, str | None]]:
    """Shared strings, and the sheets in the workbook's order: part and name.

    Sheets that the workbook doesn't name follow, under their part's name; a sheet alone without a workbook part has none.
    """
    names, shared = set(z.namelist()), []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    sheets: dict[str, str | None] = {}
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            sheets[posixpath.normpath(posixpath.join("/xl", targets[sheet.get(f"{_R}id")]))[1:]] = sheet.get("name")
    parts = [n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n) and n not in sheets]
    for n in sorted(parts, key=lambda n: (int((re.findall(r"\d+", n) or [0])[-1]), n)):
        sheets[n] = posixpath.basename(n)[:-4] if len(parts) + len(sheets) > 1 else None
    return shared, sheets


def xlsx_value(c: ElementTree.Element, shared: list[str]) -> str | None:
    v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
    if inline is not None:
        return "".join(t.text or "" for t in inline.iter(f"{_S}t"))
    return None if v is None or v.text is None else shared[int(v.text)] if c.get("t") == "s" else v.text


def column_letters(k: int) -> str:
    """The letters of column ``k``, from 0."""
    out, k = "", k + 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def csv_cells(data: bytes) -> list[tuple[int, str, str]]:
    """(row from 1, column letters, value) of all cells, those of a header too."""
    rows = csv.reader(io.StringIO(data.decode("utf-8"), newline=""))
    return [(k, column_letters(c), value) for k, row in enumerate(rows, 1) for c, value in enumerate(row)]


def xlsx_cells(data: bytes) -> list[tuple[str | None, int, str, str]]:
    """(sheet, row from 1, column letters, value) of all sheets' cells that have a value."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared, sheets = xlsx_sheets(z)
        out = []
        for part, sheet in sheets.items():
            for c in ElementTree.fromstring(z.read(part)).iter(f"{_S}c"):
                text = xlsx_value(c, shared)
                if text is not None:
                    column, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    out.append((sheet, int(row), column, text))
        return out


def rtf_text(data: bytes) -> str:
    """The shown text of an RTF file: groups that hold no text are skipped, paragraphs are lines."""
    if not data.startswith(b"{\\rtf"):
        raise ValueError("no RTF header")
    out, skip, stack = [], False, []
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+)\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)", data.decode("latin-1")):
        code, point, word, _, mark, brace, text = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif mark == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            skip = True
        elif skip:
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif point:
            out.append(chr(int(point) % 65536))
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif mark in ("\\", "{", "}"):
            out.append(mark)
        elif mark == "~":
            out.append(" ")
        elif text:
            out.append(text)
    return "".join(out).strip("\n")


def pdf_text(data: bytes) -> str:
    """The text layer of a simple PDF: strings shown in its content streams, plain or deflated, without font decoding."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("no PDF header")
    lines = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"/FlateDecode" in m[1]:
            body = zlib.decompressobj().decompress(body)
        for block in re.findall(rb"BT(.*?)ET", body, re.S):
            shown = []
            for t in re.finditer(rb"\[(.*?)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")|(T\*|T[dD]\b)", block, re.S):
                if t[3]:
                    shown.append(b"\n")
                else:
                    shown += [re.sub(rb"\\([()\\])", rb"\1", s[1:-1]) for s in re.findall(rb"\((?:\\.|[^\\()])*\)", t[1] or t[2], re.S)]
            lines.append(b"".join(shown).decode("latin-1").strip("\n"))
    return "\n".join(x for x in lines if x)


def png_pixels(data: bytes):
    """Height x width x channels of an 8-bit PNG that isn't interlaced."""
    import numpy as np

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG header")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    w, h, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or channels is None or interlaced:
        raise VeilError(CAPABILITY_UNAVAILABLE, "PNG: only 8-bit gray and color without interlacing")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    before = np.zeros(w * channels, np.int64)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind in (0, 2):
            line = line + (before if kind == 2 else 0)
        else:
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                b, c = before[x], before[x - channels] if x >= channels else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                line[x] = (line[x] + p) & 255
        before = line & 255
        out[y] = before
    return out.reshape(h, w, channels)


def png_bytes(pixels) -> bytes:
    """An 8-bit PNG of height x width x channels."""
    import numpy as np

    h, w, channels = pixels.shape
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    lines = np.hstack([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * channels).astype(np.uint8)])
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def tiff_pages(data: bytes) -> list:
    """Height x width x channels of each page of a TIFF with 8-bit gray or RGB strips, plain or deflated."""
    import numpy as np

    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("no TIFF header")
    sizes = {1: "B", 2: "B", 3: "H", 4: "I"}
    pages, at = [], struct.unpack(order + "I", data[4:8])[0]
    while at:
        tags, (n,) = {}, struct.unpack(order + "H", data[at : at + 2])
        for k in range(n):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if kind in sizes:
                width = struct.calcsize(sizes[kind]) * count
                raw = entry[8 : 8 + width] if width <= 4 else data[(o := struct.unpack(order + "I", entry[8:])[0]) : o + width]
                tags[tag] = struct.unpack(f"{order}{count}{sizes[kind]}", raw)
        one = lambda tag, default: tags.get(tag, (default,))[0]
        channels, packed = one(277, 1), one(259, 1)
        if set(tags.get(258, (1,))) != {8} or channels not in (1, 3, 4) or packed not in (1, 8, 32946) or one(317, 1) != 1 or one(284, 1) != 1:
            raise VeilError(CAPABILITY_UNAVAILABLE, "TIFF: only 8-bit gray and color, plain or deflated")
        strips = [data[o : o + c] for o, c in zip(tags[273], tags[279])]
        body = b"".join(s if packed == 1 else zlib.decompress(s) for s in strips)
        pages.append(np.frombuffer(body, np.uint8).reshape(one(257, 0), one(256, 0), channels).copy())
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return pages


def tiff_bytes(pages: list) -> bytes:
    """A TIFF of 8-bit pages with one deflated strip each."""
    import numpy as np

    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for p in pages:
        h, w, channels = p.shape
        body, strip = zlib.compress(np.ascontiguousarray(p, np.uint8).tobytes()), len(out)
        out += body + b"\0" * (len(body) % 2)
        depths = len(out)
        out += struct.pack(f"<{channels}H", *[8] * channels) + b"\0" * (channels * 2 % 4)
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, channels, 8 if channels == 1 else depths), (259, 3, 1, 8), (262, 3, 1, 1 if channels == 1 else 2), (273, 4, 1, strip), (277, 3, 1, channels), (278, 4, 1, h), (279, 4, 1, len(body))]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def picture_pages(data: bytes) -> list:
    """The pages of a PNG (one) or TIFF."""
    return tiff_pages(data) if data[:2] in (b"II", b"MM") else [png_pixels(data)]


def picture_bytes(pages: list, like: bytes) -> bytes:
    """Pages in the format of ``like``."""
    return tiff_bytes(pages) if like[:2] in (b"II", b"MM") else png_bytes(pages[0])


def decode(data: bytes, extension: str | None) -> list[tuple[str | None, str, str | None, bytes | None]]:
    """(part, modality, text, bytes) of one file."""
    e = (extension or "").lower().lstrip(".")
    kind = modality(e)
    try:
        if e == "docx":
            return docx_parts(data)
        if e == "rtf":
            return [(None, kind, rtf_text(data), None)]
        if e == "pdf":
            return [(None, kind, pdf_text(data), None)]
        if e in ("png", "tiff", "tif"):
            picture_pages(data)
            return [(None, kind, None, data)]
        if e == "wav":
            import wave

            with wave.open(io.BytesIO(data)):
                return [(None, kind, None, data)]
        if e == "xlsx":
            return [(f"{c}{r}" if sheet is None else f"{sheet}!{c}{r}", kind, v, None) for sheet, r, c, v in xlsx_cells(data)]
        if e == "csv":
            return [(f"{c}{r}", kind, v, None) for r, c, v in csv_cells(data)]
        return [(None, kind, data.decode("utf-8"), None)]
    except VeilError:
        raise
    except Exception as x:  # noqa: BLE001
        raise VeilError(MALFORMED_INPUT, f"{e}: {x}") from x


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, extension, modified, length, content) of each file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.col("modificationTime").alias("modified"), "length", "content")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per part of each file under ``path``: file, extension, modified, length, part_id, modality, text, content, decode_error."""
    return parts_of(list_files(spark, path))


def parts_of(files: DataFrame) -> DataFrame:
    """One row per part of each of ``files``, with the columns that ``read_files`` gives; a file that can't be decoded has one row, which says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path_, e, at, n, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    rows += [(path_, e, at, n, *part, None) for part in decode(content, e)]
                except VeilError as x:
                    rows.append((path_, e, at, n, None, None, None, None, str(x)))
            kinds = [pa.string(), pa.string(), b.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["file", "extension", "modified", "length", "part_id", "modality", "text", "content", "decode_error"])

    return files.select("file", "extension", "modified", "length", "content").mapInArrow(run, "file string, extension string, modified timestamp, length bigint, part_id string, modality string, text string, content binary, decode_error string")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (file, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table of strings, or of ``schema``."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)

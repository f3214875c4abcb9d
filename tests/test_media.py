"""Sources, pictures and sounds."""

import io
import wave
import zipfile

import numpy as np
import pytest

from sparkveil.errors import CAPABILITY_UNAVAILABLE, MALFORMED_INPUT, VeilError
from sparkveil.operators import audio, image
from sparkveil.plans.policy import Redaction, text_op
from sparkveil.sources import files, rewrite

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def picture():
    return np.arange(8 * 8 * 3, dtype=np.uint8).reshape(8, 8, 3)


def clip(channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.arange(8000, dtype=np.int16).repeat(channels).tobytes())
    return out.getvalue()


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:r><w:t>Mail a@b.com</w:t></w:r><w:r><w:t> now</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/media/image1.png", files.png_bytes(picture()))
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}"><si><t>name</t></si><si><t>a@b.com</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def samples(data):
    with wave.open(io.BytesIO(data)) as w:
        return np.frombuffer(w.readframes(w.getnframes()), np.int16).reshape(-1, w.getnchannels())


def test_png_round_trip_with_all_filters():
    p = picture()
    assert (files.png_pixels(files.png_bytes(p)) == p).all()
    import struct
    import zlib

    raw, before = b"", np.zeros(24, np.int64)
    for y in range(8):
        line, kind = p[y].reshape(-1).astype(np.int64), y % 5
        left = np.r_[np.zeros(3, np.int64), line[:-3]]
        corner = np.r_[np.zeros(3, np.int64), before[:-3]]
        paeth = []
        for a, b, c in zip(left, before, corner):
            q = a + b - c
            paeth.append(min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2])
        guess = [0 * line, left, before, (left + before) // 2, np.array(paeth)][kind]
        raw += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        before = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (files.png_pixels(data) == p).all()


def test_tiff_round_trip(spark):
    gray = picture()[..., :1]
    pages = files.tiff_pages(files.tiff_bytes([picture(), gray]))
    assert (pages[0] == picture()).all() and (pages[1] == gray).all()
    plain = files.tiff_bytes([gray])
    assert files.decode(plain, "TIFF")[0][1] == "image"
    big = b"MM\0*\0\0\0\x0c" + b"\1\2\3\4" + b"\0\x08" + b"".join(__import__("struct").pack(">HHI", t, 3, 1) + __import__("struct").pack(">HH", v, 0) for t, v in ((256, 2), (257, 2), (258, 8), (259, 1), (262, 1), (273, 8), (277, 1), (279, 4))) + b"\0\0\0\0"
    assert files.tiff_pages(big)[0].reshape(-1).tolist() == [1, 2, 3, 4]
    rows = spark.createDataFrame([(1, bytearray(files.tiff_bytes([picture(), gray])), [(0, 0, 2, 2, 1)])], "id int, content binary, regions array<struct<x:int,y:int,w:int,h:int,page:int>>")
    after = files.tiff_pages(bytes(image.redact_images(rows, Redaction.of("image", "erase")).first().content))
    assert (after[0] == picture()).all() and (after[1][:2, :2] == 255).all() and (after[1][2:] == gray[2:]).all()
    with pytest.raises(VeilError):
        files.decode(b"II*\0\xff\xff", "tif")


@pytest.mark.parametrize("kind", ["erase", "keep", "blur", "pixelate", "blackbox"])
def test_image_operators_touch_only_the_region(kind):
    p, box = picture(), (2, 1, 4, 3)
    out = image.apply(p, box, Redaction.of("image", kind))
    inside = np.zeros((8, 8), bool)
    inside[1:4, 2:6] = True
    assert (out[~inside] == p[~inside]).all()
    expected = {"erase": lambda: (out[inside] == 255).all(), "keep": lambda: (out == p).all(), "blackbox": lambda: (out[inside] == 0).all(), "pixelate": lambda: len(np.unique(out[inside], axis=0)) == 1, "blur": lambda: out[inside].std(0).max() < p[inside].std(0).max()}
    assert expected[kind]()


def test_image_parameters_and_bounds():
    p = picture()
    red = image.apply(p, (-3, -3, 5, 5), Redaction.of("image", "blackbox", color="#ff0000"))
    assert (red[:2, :2] == [255, 0, 0]).all() and (red[2:] == p[2:]).all()
    assert (image.apply(p, (20, 20, 5, 5), Redaction.of("image", "erase")) == p).all()
    two = image.apply(p, (0, 0, 4, 4), Redaction.of("image", "pixelate", block_size=2))
    assert len(np.unique(two[:4, :4].reshape(-1, 3), axis=0)) == 4


@pytest.mark.parametrize("kind", ["erase", "keep", "silence", "beep"])
def test_audio_operators(kind):
    data = clip(2)
    before, after = samples(data), samples(audio.redact_wav(data, [(0.25, 0.5)], Redaction.of("audio", kind)))
    if kind == "erase":
        assert len(after) == 6000 and (after == np.delete(before, range(2000, 4000), axis=0)).all()
        return
    assert len(after) == 8000 and (after[:2000] == before[:2000]).all() and (after[4000:] == before[4000:]).all()
    middle = after[2000:4000]
    if kind == "keep":
        assert (middle == before[2000:4000]).all()
    elif kind == "silence":
        assert (middle == 0).all()
    else:
        assert abs(int(np.abs(middle).max()) - 16384) < 20 and (middle[:, 0] == middle[:, 1]).all()


@pytest.mark.parametrize("waveform", ["sine", "square", "triangle", "sawtooth"])
def test_waveforms_stay_in_range(waveform):
    out = audio.apply(np.zeros((8000, 1), np.int16), 8000, [(0, 1)], Redaction.of("audio", "beep", waveform=waveform, amplitude=1.0))
    assert np.abs(out.astype(int)).max() <= 32767 and out.std() > 1000


def test_redaction_of_frames(spark):
    rows = spark.createDataFrame([(1, bytearray(files.png_bytes(picture())), [(0, 0, 2, 2)]), (2, bytearray(files.png_bytes(picture())), None), (3, None, None)], "id int, content binary, regions array<struct<x:int,y:int,w:int,h:int>>")
    got = {r.id: r.content for r in image.redact_images(rows, Redaction.of("image", "erase")).collect()}
    assert (files.png_pixels(bytes(got[1]))[:2, :2] == 255).all() and bytes(got[2]) == files.png_bytes(picture()) and got[3] is None
    rows = spark.createDataFrame([(1, bytearray(clip()), [(0.0, 0.5)]), (2, bytearray(clip()), [])], "id int, content binary, intervals array<struct<t_start:double,t_end:double>>")
    got = {r.id: bytes(r.content) for r in audio.redact_audio(rows, Redaction.of("audio", "erase")).collect()}
    assert len(samples(got[1])) == 4000 and got[2] == clip()


def test_decoders():
    assert files.decode(docx(), "docx")[0][2] == "Mail a@b.com now\nSecond"
    assert files.decode(docx(), "docx")[1][0] == "word/media/image1.png"
    assert files.decode(xlsx(), "XLSX") == [("A1", "tabular", "name", None), ("A2", "tabular", "a@b.com", None), ("B2", "tabular", "5", None)]
    rtf = rb"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9\par two " + b"\\u" + rb"8364? \{x\}}"
    assert files.decode(rtf, ".rtf")[0][2] == "Café\ntwo € {x}"
    assert files.decode(b"%PDF-1.4\n1 0 obj\n<< /Length 40 >>\nstream\nBT (Hello \\(you\\)) Tj T* [(a) 3 (b)] TJ ET\nendstream\n", "pdf")[0][2] == "Hello (you)\nab"
    for bad in ((b"x", "docx"), (b"\xff\xfe", "txt"), (b"x", "png"), (b"x", "wav"), (b"x", "rtf")):
        with pytest.raises(VeilError) as e:
            files.decode(*bad)
        assert e.value.kind == MALFORMED_INPUT
    for unknown in ("jpeg", "mp3", "", None):
        with pytest.raises(VeilError) as e:
            files.modality(unknown)
        assert e.value.kind == CAPABILITY_UNAVAILABLE


def test_every_sheet_is_read():
    cell = lambda v: f'<worksheet xmlns="{SHEET}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    for named in (True, False):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k in (10, 2):
                z.writestr(f"xl/worksheets/sheet{k}.xml", cell(f"{k}@b.com"))
            if named:
                z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET}" xmlns:r="{relations}"><sheets><sheet name="Staff" r:id="a"/><sheet name="Q 1" r:id="b"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="b" Target="worksheets/sheet2.xml"/><Relationship Id="a" Target="/xl/worksheets/sheet10.xml"/></Relationships>')
        expected = [("Staff!A1", "10@b.com"), ("Q 1!A1", "2@b.com")] if named else [("sheet2!A1", "2@b.com"), ("sheet10!A1", "10@b.com")]
        assert [(p, t) for p, _, t, _ in files.decode(out.getvalue(), "xlsx")] == expected


def test_docx_keeps_other_parts():
    out = files.docx_with_text(docx(), "Mail  now\nSecond")
    parts = files.docx_parts(out)
    assert parts[0][2] == "Mail  now\nSecond" and parts[1][3] == files.png_bytes(picture())
    with pytest.raises(VeilError):
        files.docx_with_text(docx(), "one line")


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Contact a@b.com", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(docx())
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "d.mp3").write_bytes(b"x")
    got = {(r.file.rsplit("/", 1)[1], r.part_id): r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt", None].text == "Contact a@b.com" and got["b.docx", "word/media/image1.png"].modality == "image"
    assert "MalformedInput" in got["c.txt", None].decode_error and "CapabilityUnavailable" in got["d.mp3", None].decode_error
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.csv").write_text("a,b\n1,c@d.org\n")
    assert files.read_csv(spark, str(tmp_path / "t")).first().b == "c@d.org"
    assert files.read_text(spark, str(tmp_path / "a.txt")).first().text == "Contact a@b.com"


def test_pictures_and_sounds_under_policies(spark):
    from sparkveil import Engine, ModalityRedactions, Policy, Reader, Scope

    ocr = Reader("ocr", lambda contents: [[("mail", 0, 0, 2, 2), ("a@b.com", 4, 4, 3, 2)] if c else [] for c in contents])
    stt = Reader("stt", lambda contents: [[("call", 0.0, 0.25), ("+1-415-555-0142", 0.25, 0.5), ("or", 0.5, 0.6), ("a@b.com", 0.75, 1.0)] for _ in contents])
    scope = (Scope("s", ("email_address", "phone_number")),)
    engine = Engine().with_ocr(ocr).with_stt(stt)
    black = Policy("p", "p", scope, fallback=ModalityRedactions.for_image("blackbox"))
    rows = spark.createDataFrame([(1, bytearray(files.png_bytes(picture()))), (2, None)], "doc_id bigint, content binary")
    got = {r.doc_id: r for r in engine.redact_pictures(rows, [black]).collect()}
    pixels = files.png_pixels(bytes(got[1].content))
    assert (pixels[4:6, 4:7] == 0).all() and (pixels[:4] == picture()[:4]).all() and got[2].content is None
    assert [(e.modality, e.value) for e in got[1].entities] == [("image", "a@b.com")]
    untouched = Policy("p", "p", scope, fallback=ModalityRedactions.for_text("erase"))
    assert bytes(engine.redact_pictures(rows, [untouched]).where("doc_id = 1").first().content) == files.png_bytes(picture())
    cut = Policy("p", "p", scope, fallback=ModalityRedactions.for_audio("erase"))
    rows = spark.createDataFrame([(1, bytearray(clip()))], "doc_id bigint, content binary")
    after = samples(bytes(engine.redact_sounds(rows, [cut]).first().content))
    assert (after == np.delete(samples(clip()), [*range(2000, 4000), *range(6000, 8000)], axis=0)).all()
    assert bytes(Engine().redact_sounds(rows, [cut]).first().content) == clip()


def test_files_are_written_back_in_their_format():
    new = rewrite.rewrite(docx(), "docx", {None: "Mail  now\nSecond"}, {"word/media/image1.png": b"other"})
    assert files.decode(new, "docx") == [(None, "text", "Mail  now\nSecond", None), ("word/media/image1.png", "image", None, b"other")]
    new = rewrite.rewrite(xlsx(), "xlsx", {"A2": "[mail] & <more>"})
    assert [c[0] for c in files.decode(new, "xlsx")] == ["A1", "A2", "B2"] and [c[2] for c in files.decode(new, "xlsx")] == ["name", "[mail] & <more>", "5"]
    assert not any(b"a@b.com" in zipfile.ZipFile(io.BytesIO(new)).read(n) for n in zipfile.ZipFile(io.BytesIO(new)).namelist())
    table = b'a,"b, c"\r\n"line\ntwo",x@y.org\r\n'
    assert [(p, v) for p, _, v, _ in files.decode(table, "csv")] == [("A1", "a"), ("B1", "b, c"), ("A2", "line\ntwo"), ("B2", "x@y.org")]
    assert files.csv_cells(rewrite.rewrite(table, "csv", {"B2": 'say "no"'})) == [(1, "A", "a"), (1, "B", "b, c"), (2, "A", "line\ntwo"), (2, "B", 'say "no"')]
    assert files.rtf_text(rewrite.rewrite(b"{\\rtf1 old}", "rtf", {None: "né {w}\\ 漢\nend"})) == "né {w}\\ 漢\nend"
    assert rewrite.rewrite(b"<p>old", "html", {None: "<p>new"}) == b"<p>new" and rewrite.rewrite(b"x", "txt", {}) == b"x"
    assert [files.column_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    for bad in ((b"%PDF", "pdf", {None: "x"}), (docx(), "docx", {None: "one line"}), (b"no zip", "xlsx", {"A1": "x"})):
        with pytest.raises(VeilError) as e:
            rewrite.rewrite(*bad)
        assert e.value.kind == "Redaction"


def test_a_file_that_cant_be_written_has_no_content(spark):
    sources = spark.createDataFrame([("a.txt", "txt", b"old"), ("b.pdf", "pdf", b"%PDF old"), ("c.txt", "txt", b"left out")], "file string, extension string, content binary")
    parts = spark.createDataFrame([("a.txt", None, "new", None), ("b.pdf", None, "new", None)], "file string, part_id string, redacted string, content binary")
    got = {r.file: r for r in rewrite.redacted_files(sources, parts).collect()}
    assert set(got) == {"a.txt", "b.pdf"} and bytes(got["a.txt"].content) == b"new" and got["b.pdf"].content is None and "pdf" in got["b.pdf"].error


def test_whole_files_with_text_and_pictures(spark):
    """One call: the letter's text, the picture inside it, a sound, and files that can't be read or written."""

    from sparkveil import Engine, ModalityRedactions, Policy, Reader, Scope

    def words(contents):
        return [[("a@b.com", 3, 4, 3, 2)] for _ in contents]

    actions = ModalityRedactions(text=text_op("replace", template="[mail]"), image=Redaction.of("image", "blackbox"))
    mail = Policy("p", "p", (Scope("s", ("email_address",)),), fallback=actions)
    rows = [("d.docx", "docx", docx()), ("n.txt", "txt", b"to a@b.com"), ("x.csv", "csv", b"k,a@b.com\n"), ("p.png", "png", files.png_bytes(picture())), ("s.wav", "wav", clip()), ("bad.txt", "txt", b"\xff\xfe a@b.com"), ("j.jpeg", "jpeg", b"x"), ("f.pdf", "pdf", b"%PDF\n1 0 obj\n<< /Length 30 >>\nstream\nBT (a@b.com) Tj ET\nendstream\n")]
    sources = spark.createDataFrame([(f, e, None, len(c), bytearray(c)) for f, e, c in rows], "file string, extension string, modified timestamp, length bigint, content binary")
    got = {r.file: r for r in Engine().with_ocr(Reader("ocr", words)).redact_files(sources, [mail]).collect()}
    assert set(got) == {f for f, _, _ in rows}
    parts = files.decode(bytes(got["d.docx"].content), "docx")
    assert parts[0][2] == "Mail [mail] now\nSecond" and (files.png_pixels(parts[1][3])[4:6, 3:6] == 0).all()
    assert bytes(got["n.txt"].content) == b"to [mail]" and bytes(got["x.csv"].content) == b"k,[mail]\n"
    assert (files.png_pixels(bytes(got["p.png"].content))[4:6, 3:6] == 0).all() and bytes(got["s.wav"].content) == clip()
    assert all(got[k].content is None and got[k].error for k in ("bad.txt", "j.jpeg", "f.pdf"))

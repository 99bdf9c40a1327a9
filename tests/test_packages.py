"""Workbooks, text documents and decks as minimal packages."""

import zipfile

import pytest

from assetloom.sources import catalogs, packages

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rels(*targets):
    each = "".join(f'<Relationship Id="rId{k}" Type="x/{kind}" Target="{target}"{mode}/>' for k, (kind, target, mode) in enumerate(targets, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{each}</Relationships>'


@pytest.fixture
def folder(tmp_path):
    def pack(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, data in members.items():
                z.writestr(member, data)

    pack("book.xlsx", {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" r:id="rId1"/><sheet name="Lost" r:id="rId9"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/sheet1.xml", "")),
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><drawing r:id="rId1"/></worksheet>', "xl/worksheets/_rels/sheet1.xml.rels": rels(("drawing", "../drawings/drawing1.xml", "")),
        "xl/drawings/drawing1.xml": f'<xdr:wsDr {NS}><xdr:oneCellAnchor><xdr:ext cx="{682 * 9525}" cy="{456 * 9525}"/><xdr:pic><a:blip r:embed="rId1"/></xdr:pic></xdr:oneCellAnchor></xdr:wsDr>', "xl/drawings/_rels/drawing1.xml.rels": rels(("image", "../media/i.png", "")),
    })
    document = {"word/document.xml": f'<w xmlns="x" {NS}><wp:inline><wp:extent cx="5" cy="6"/><a:blip r:embed="rId1"/></wp:inline><wp:anchor><a:blip r:embed="rId2"/></wp:anchor></w>', "word/_rels/document.xml.rels": rels(("image", "media/i.png", ""), ("image", "http://a/b.png", ' TargetMode="External"'))}
    pack("text.docx", document)
    pack("signed.docx", document | {"_xmlsignatures/sig1.xml": "<x/>"})
    pack("bomb.docx", {"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'})
    pack("deck.pptx", {"ppt/slides/slide1.xml": f'<p:sld {NS}><p:grpSp><a:videoFile r:link="rId1"/></p:grpSp><a:wavAudioFile/></p:sld>', "ppt/slideMasters/slideMaster1.xml": f'<p:sldMaster {NS}><a:audioFile/></p:sldMaster>', "ppt/slides/_rels/slide1.xml.rels": rels(("video", "../media/v.flv", ""), ("video", "http://a/v.mp4", ' TargetMode="External"'))})
    return str(tmp_path)


def test_placed_images(spark, folder):
    of = lambda suffix: packages.packages(spark, folder, (suffix,))
    sheet = packages.sheet_images(of("xlsx")).collect()
    assert [(r["sheet"], r["media"], r["error"]) for r in sheet] == [("One", "xl/media/i.png", None)] and sheet[0]["area_ratio"] == pytest.approx(0.5, abs=1e-6)
    got = {(r["package"].rpartition("/")[2], r["media"], r["cx"], r["error"]) for r in packages.text_images(of("docx")).collect()}
    assert got == {("text.docx", "word/media/i.png", 5, None), ("signed.docx", None, None, "ValueError: the package is signed"), ("bomb.docx", None, None, "ValueError: word/document.xml declares entities")}
    assert packages.fidelity(of("pptx")).first()[1:6] == (2, 1, 1, 1, 1)


def test_snapshots_and_blobs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", 3)], "schema_version int, project_id string, revision long")
    root = str(tmp_path / "c")
    for revision in (3, 4):
        catalogs.committed(rows, root, revision)
    found, revision = catalogs.latest(spark, root)
    assert revision == 5 and found.count() == 1
    blobs = spark.createDataFrame([("ab1", b"x"), ("ab1", b"x"), ("cd2", b"y")], "sha256 string, content binary")
    for _ in range(2):
        catalogs.stored_by_hash(blobs, str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2


def test_public_files(spark, tmp_path):
    cut = "a" * 8191 + "é"
    for name, data in {"a.PY": b"\xff", "README": b"\xff", "b.bin": b"a\0b", "c.dat": "é".encode(), "d.dat": b"\xff", "cut.dat": cut.encode(), "empty": b"", "build": b"x", "dist/x.py": b"x", "k/.git/y": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["is_text"] for r in packages.public_files(spark, str(tmp_path)).collect()}
    assert got == {"a.PY": True, "README": True, "b.bin": False, "c.dat": True, "d.dat": False, "cut.dat": False, "build": True}  # empty files aren't listed


def test_transcode_source(spark):
    probes = [
        (1, 1_000_000, '{"streams":[{"codec_type":"video","width":640,"height":360,"avg_frame_rate":"0/0","r_frame_rate":"25/1","duration":"4"},{"codec_type":"audio","bit_rate":"128500"}],"format":{"duration":"5"}}'),
        (2, 1_000_000, '{"streams":[{"codec_type":"video","width":640,"height":360,"bit_rate":"900000"}],"format":{"duration":"8"}}'),
        (3, 100, "broken"),
    ]
    got = {r["k"]: r for r in packages.transcode_source(spark.createDataFrame(probes, "k int, size_bytes long, probe string")).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["fps"], one["seconds"], one["has_audio"], one["audio_source_kbps"], one["total_kbps"], one["video_kbps"]) == (25.0, 4.0, True, 128, 2000, 1872)
    assert (two["fps"], two["seconds"], two["has_audio"], two["total_kbps"], two["video_kbps"]) == (None, 8.0, False, 1000, 900)
    assert (three["width"], three["height"], three["video_kbps"]) == (0, 0, 8)

"""Packages rewritten by a plan, archives, intents and scans by suffix."""

import io
import zipfile

import pytest

from assetloom.sources import packages, rewrites

RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="x/video" Target="../media/a.wmv"/><Relationship Id="rId2" Type="x/image" Target="/ppt/media/b.png"/><Relationship Id="rId3" Type="x/image" Target="http://a/c.png" TargetMode="External"/></Relationships>'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="wmv" ContentType="video/x-ms-wmv"/><Override PartName="/ppt/media/a.wmv" ContentType="video/x-ms-wmv"/></Types>'
CHANGES = "package string, member string, target string, content binary"


def deck(**more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in ({"[Content_Types].xml": TYPES, "ppt/slides/slide1.xml": "<s/>", "ppt/slides/_rels/slide1.xml.rels": RELS, "ppt/media/a.wmv": "old", "ppt/media/b.png": "b", "ppt/media/lost.png": "x"} | more).items():
            z.writestr(name, data)
    return bytearray(out.getvalue())


def test_rewritten_package(spark):
    rows = spark.createDataFrame([("p", deck()), ("same", deck()), ("held", deck()), ("twice", deck()), ("absent", deck()), ("bad", bytearray(b"no zip")), ("signed", deck(**{"_xmlsignatures/s.xml": "<x/>"})), ("moved", deck()), ("gone", deck())], "package string, content binary")
    plan = [("p", "ppt/media/a.wmv", "ppt/media/a.mp4", bytearray(b"new")), ("p", "ppt/media/lost.png", None, None), ("p", "docProps/note.txt", "docProps/note.txt", bytearray(b"n")), ("held", "ppt/media/b.png", None, None), ("twice", "ppt/media/a.wmv", "ppt/media/b.png", None), ("absent", "ppt/media/z.png", None, None), ("bad", "x", "x", bytearray(b"")), ("signed", "ppt/media/lost.png", None, None), ("moved", "ppt/slides/slide1.xml", "ppt/slides/s.xml", None), ("gone", "ppt/slides/slide1.xml", None, None), ("gone", "ppt/media/a.wmv", None, None)]
    got = {r["package"]: r for r in rewrites.rewritten(rows, spark.createDataFrame(plan, CHANGES)).collect()}
    assert {k: r["error"] for k, r in got.items() if r["error"]} == {
        "held": "ValueError: ppt/slides/slide1.xml still refers to ppt/media/b.png", "twice": "ValueError: two members get one name", "absent": "ValueError: the package has no ppt/media/z.png",
        "bad": "BadZipFile: File is not a zip file", "signed": "ValueError: the package is signed", "moved": "ValueError: ppt/slides/slide1.xml has relationships and keeps its name",
    }
    assert "same" not in got
    with zipfile.ZipFile(io.BytesIO(got["gone"]["content"])) as z:
        assert z.namelist() == ["[Content_Types].xml", "ppt/media/b.png", "ppt/media/lost.png"] and b"a.wmv" not in z.read("[Content_Types].xml")
    with zipfile.ZipFile(io.BytesIO(got["p"]["content"])) as z:
        assert z.namelist() == ["[Content_Types].xml", "ppt/slides/slide1.xml", "ppt/slides/_rels/slide1.xml.rels", "ppt/media/a.mp4", "ppt/media/b.png", "docProps/note.txt"]
        assert z.read("ppt/media/a.mp4") == b"new"
        types, rels = z.read("[Content_Types].xml").decode(), z.read("ppt/slides/_rels/slide1.xml.rels").decode()
    assert 'Target="../media/a.mp4"' in rels and 'Target="/ppt/media/b.png"' in rels and 'Target="http://a/c.png"' in rels
    assert 'Extension="mp4" ContentType="video/mp4"' in types and 'PartName="/ppt/media/a.mp4"' in types
    again = rewrites.rewritten(rows, spark.createDataFrame(plan[:3], CHANGES)).first()
    assert again["sha256"] == got["p"]["sha256"]


def test_structure_changes(spark):
    schema = "document string, kind string, fingerprint string"
    before = spark.createDataFrame([("d", "page", "a"), ("d", "page", "a"), ("d", "field", None)], schema)
    after = spark.createDataFrame([("d", "page", "a"), ("d", "field", None), ("d", "outline", "o")], schema)
    assert rewrites.structure_changes(before, before).isEmpty()
    assert {(r["kind"], r["change"]) for r in rewrites.structure_changes(before, after).collect()} == {("page", -1), ("outline", 1)}


def test_archived(spark):
    media = spark.createDataFrame([("p", "m/1.mp4", "a", 1), ("p", "m/2.mp4", "b", 2), ("q", "m/3.mp4", "b", 2), ("q", "m/4.mp4", "c", 3), ("q", "m/5.mp4", "d", 4)], "package string, media string, sha256 string, size_bytes long")
    hashes = spark.createDataFrame([("a", "f1"), ("d", "f1"), ("d", "f2")], "sha256 string, family_id string")
    matches = spark.createDataFrame([("c", "f2")], "sha256 string, family_id string")
    assets, stored = rewrites.archived(media, hashes, matches)
    assert {(r["media"], r["how"], r["family_id"]) for r in assets.collect()} == {("m/1.mp4", "existing", "f1"), ("m/2.mp4", "new", "family-b"), ("m/3.mp4", "new", "family-b"), ("m/4.mp4", "matched", "f2"), ("m/5.mp4", "ambiguous", None)}
    assert {tuple(r) for r in stored.collect()} == {("b", "family-b", "2.mp4", 2), ("c", "f2", "4.mp4", 3)}
    assert rewrites.archived(media.limit(0), hashes, matches)[1].isEmpty()


def test_intents(spark, tmp_path):
    schema, root = "variant_id string, path string, quarantined_path string, state string", str(tmp_path / "q")
    rows = spark.createDataFrame([("v", "a", "b", "moving")], schema)
    assert spark.read.json(rewrites.log_intents(rows, root, 0)).count() == 1
    with pytest.raises(FileExistsError):
        rewrites.log_intents(rows, root, 0)
    with pytest.raises(ValueError):
        rewrites.log_intents(spark.createDataFrame([("v", "a", None, "moving")], schema), root, 1)


def test_native_binaries(spark):
    pe = bytearray(b"MZ" + bytes(58) + (64).to_bytes(4, "little") + b"PE\0\0\x64\x86")
    files = [("elf", bytearray(b"\x7fELF" + bytes(14) + b"\xb7\0")), ("mach", bytearray(b"\xcf\xfa\xed\xfe\x07\0\0\x01")), ("pe", pe), ("other", bytearray(b"\x7fELF" + bytes(14) + b"\x01\x01")), ("text", bytearray(b"MZ, as a word")), ("empty", bytearray())]
    got = {r["path"]: (r["format"], r["arch"]) for r in rewrites.native_binaries(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"elf": ("elf", "arm64"), "mach": ("mach-o", "x86_64"), "pe": ("pe", "x86_64"), "other": ("elf", None)}


def test_backends(spark, tmp_path):
    assert rewrites.backend("a/B.XLSX") is packages.sheet_images
    assert rewrites.backend("a.odt", {"odt": packages.members}) is packages.members
    with pytest.raises(ValueError, match="no scan for .odt"):
        rewrites.backend("a.odt")
    for name in ("a.pptx", "b.docx"):
        (tmp_path / name).write_bytes(b"no zip")
    assert {r["kind"] for r in rewrites.scanned(spark, str(tmp_path)).collect()} == {"pptx", "docx"}

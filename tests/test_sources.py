import json
import zipfile

import pytest

from assetloom.sources import catalogs, packages
from assetloom.streaming import ingest

REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
SLIDE = '<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"{}><p:pic><p:nvPicPr><p:cNvPr id="4" name="pic"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId1"/></p:blipFill><p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="50" cy="100"/></a:xfrm></p:spPr></p:pic></p:sld>'
PRESENTATION = '<p:presentation xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><p:sldIdLst><p:sldId id="1" r:id="rId2"/><p:sldId id="2" r:id="rId1"/></p:sldIdLst><p:sldSz cx="100" cy="200"/></p:presentation>'


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "deck.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", PRESENTATION)
        z.writestr("ppt/_rels/presentation.xml.rels", REL.format('<Relationship Id="rId1" Type="x/slide" Target="slides/slide1.xml"/><Relationship Id="rId2" Type="x/slide" Target="slides/slide2.xml"/>'))
        for k, show in ((1, ""), (2, ' show="0"')):
            z.writestr(f"ppt/slides/slide{k}.xml", SLIDE.format(show))
            z.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", REL.format('<Relationship Id="rId1" Type="x/image" Target="../media/used.png"/><Relationship Id="rId9" Type="x/image" Target="http://a/b.png" TargetMode="External"/>'))
        z.writestr("ppt/media/used.png", b"1")
        z.writestr("ppt/media/unused.png", b"2")
    (tmp_path / "broken.pptx").write_bytes(b"no zip")
    return str(tmp_path)


def test_package_scan(spark, folder):
    rows = packages.packages(spark, folder).persist()
    parts, rels, found = packages.members(rows), packages.relationships(rows), packages.occurrences(rows)
    assert [r["media"] for r in packages.orphan_media(parts, rels).collect()] == ["ppt/media/unused.png"]
    assert parts.where("error IS NOT NULL").count() == 1
    got = {r["slide"]: (r["number"], r["hidden"], r["width_ratio"], r["area_ratio"]) for r in found.where("error IS NULL").collect()}
    assert got == {"ppt/slides/slide2.xml": (1, True, 0.5, 0.25), "ppt/slides/slide1.xml": (2, False, 0.5, 0.25)}
    media = packages.placed_media(found, rels).collect()
    assert [(m["media"], m["n_occurrences"], m["slides"]) for m in media] == [("ppt/media/used.png", 2, [1, 2])]
    assert packages.same_structure(parts, parts).count() == 0
    assert not packages.is_signed(parts).where("signed").count()
    assert packages.crawl(spark, folder, "*.pptx").count() == 2


def test_manifest_falls_back(spark, tmp_path):
    good = {"schema_version": 1, "project_id": "p", "revision": 3, "families": [{"id": "f", "name": "n", "source_variant_id": "v2", "known_hashes": ["h"], "variants": [{"id": "v1", "sha256": "a"}, {"id": "v2", "sha256": "b"}]}], "decks": [{"id": "d", "source_path": "x", "source_aliases": ["y"], "assets": [{"family_id": "f", "variant_id": "v1", "part": "m", "occurrences": [{"slide_path": "s", "shape_id": "1"}]}]}]}
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "good.json").write_text(json.dumps(good))
    rows, recovered = catalogs.opened(spark, str(tmp_path / "bad.json"), str(tmp_path / "good.json"))
    family, deck = catalogs.families(rows), catalogs.decks(rows)
    assert recovered and catalogs.variants(family).count() == 2
    assert {r["sha256"] for r in catalogs.family_hashes(family).collect()} == {"h", "a", "b"}
    assert catalogs.source_variant(family).first()["id"] == "v2"
    assert catalogs.occurrences(deck).first()["slide_path"] == "s" and catalogs.deck_paths(deck).count() == 2
    assert catalogs.outputs(deck).count() == 0
    with pytest.raises(ValueError):
        catalogs.opened(spark, str(tmp_path / "bad.json"), str(tmp_path / "missing.json"))
    catalogs.committed(rows.drop("_corrupt"), str(tmp_path / "c"), 3)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        catalogs.committed(rows.drop("_corrupt"), str(tmp_path / "c"), 3)


def test_streamed_import_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name, data in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (source / name).write_bytes(data)
    for _ in range(2):
        ingest.imported_once(ingest.files(spark, str(source)), str(tmp_path / "lib"), str(tmp_path / "ck")).awaitTermination()
        ingest.delivered(ingest.files(spark, str(source)), str(tmp_path / "done"), "v1", str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "lib")).count() == 2
    assert spark.read.parquet(str(tmp_path / "done")).count() == 2

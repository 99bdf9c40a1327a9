"""Boxes, groups and pages against numbers worked out by hand."""

import math
import zipfile
from xml.etree import ElementTree

import pytest
from test_packages import NS, S, rels

from assetloom.operators import budget
from assetloom.sources import geometry, packages

LIST = '<a:extLst><a:ext uri="{FF2B5EF4-FFF2-40B4-BE49-F238E27FC236}"><x/></a:ext></a:extLst>'


def picture(name, rel, xfrm, crop="", extra=""):
    return f'<p:pic><p:nvPicPr><p:cNvPr id="4" name="{name}">{LIST}</p:cNvPr><p:nvPr>{extra}</p:nvPr></p:nvPicPr><p:blipFill><a:blip r:embed="{rel}">{LIST}</a:blip>{crop}</p:blipFill><p:spPr>{xfrm}{LIST}</p:spPr></p:pic>'


def xfrm(x, y, cx, cy, more="", tail=""):
    return f'<a:xfrm {more}><a:off x="{x}" y="{y}"/><a:ext cx="{cx}" cy="{cy}"/>{tail}</a:xfrm>'


def group(inner, x, y, cx, cy, child, more=""):
    tail = '<a:chOff x="{}" y="{}"/><a:chExt cx="{}" cy="{}"/>'.format(*child)
    return f"<p:grpSp><p:grpSpPr>{xfrm(x, y, cx, cy, more, tail)}</p:grpSpPr>{inner}</p:grpSp>"


@pytest.fixture
def deck(spark, tmp_path):
    slide = f"<p:sld {NS}><p:cSld><p:spTree>" + "".join([
        picture("plain", "rId1", xfrm(0, 0, 500, 400)),
        picture("turned", "rId1", xfrm(100, 100, 400, 200, 'rot="5400000"'), '<a:srcRect l="25000" b="10000"/>'),
        group(group(picture("nested", "rId1", xfrm(10, 10, 20, 10, 'rot="2700000" flipH="1"')), 0, 0, 100, 100, (0, 0, 50, 50)), 200, 300, 300, 100, (0, 0, 100, 100)),
        picture("video", "rId1", xfrm(0, 0, 1000, 800), extra='<a:videoFile r:link="rId2"/>'),
        picture("nowhere", "rId1", ""),
    ]) + "</p:spTree></p:cSld></p:sld>"
    hidden = f'<p:sld {NS} show="0">' + picture("hidden", "rId1", xfrm(0, 0, 1000, 800)) + "</p:sld>"
    order = rels(("slide", "slides/slide2.xml", ""), ("slide", "slides/slide1.xml", ""))
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="rId1"/><p:sldId r:id="rId2"/></p:sldIdLst><p:sldSz cx="1000" cy="800"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", order)
        z.writestr("ppt/slides/slide1.xml", slide)
        z.writestr("ppt/slides/slide2.xml", hidden)
        for k in (1, 2):
            z.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", rels(("image", "../media/i.png", ""), ("video", "../media/v.mp4", "")))
        for name in ("i.png", "v.mp4", "orphan.mp4"):
            z.writestr(f"ppt/media/{name}", b"x" * 1000)
    return packages.packages(spark, str(tmp_path), ("pptx",))


def test_places_on_the_slide(deck):
    found = packages.occurrences(deck)
    got = {(r["shape_name"], r["rel_id"]): r for r in found.collect()}
    assert set(got) == {("plain", "rId1"), ("turned", "rId1"), ("nested", "rId1"), ("video", "rId1"), ("video", "rId2"), ("hidden", "rId1")}
    plain, turned, nested = (got[n, "rId1"] for n in ("plain", "turned", "nested"))
    assert (plain["cx"], plain["cy"], plain["area_ratio"], plain["placed_ratio"]) == (500, 400, 0.25, 0.25)
    assert (turned["rotation"], turned["crop_left"], turned["crop_bottom"]) == (90.0, 0.25, 0.1)
    assert [round(turned[f"placed_{c}"], 6) for c in ("x", "y", "cx", "cy", "area")] == [200, 0, 200, 400, 80_000]
    # The inner group doubles, the outer one makes the doubled box 3 times as wide: 6 and 2 times. The centre (20, 15) comes
    # to (200 + 120, 300 + 30); a diagonal of 45 degrees makes the box 30 / sqrt 2 wide and high before that.
    side = 30 / math.sqrt(2)
    assert (nested["flip_h"], nested["flip_v"]) == (True, False)
    assert [nested[f"placed_{c}"] for c in ("x", "y", "cx", "cy", "area")] == pytest.approx([320 - 3 * side, 330 - side, 6 * side, 2 * side, 20 * 10 * 12])
    shown = packages.shown_only(found)
    assert {r["number"] for r in shown.collect()} == {1} and found.where("shape_name = 'plain'").first()["number"] == 2


def test_from_deck_to_plan(spark, deck):
    found, parts, links = packages.occurrences(deck), packages.members(deck), packages.relationships(deck)
    package = found.first()["package"]
    probe = '{"streams":[{"codec_type":"video","width":1920,"height":1080,"avg_frame_rate":"30/1","duration":"10","bit_rate":"4000000"}],"format":{"duration":"10"}}'
    probes = spark.createDataFrame([(package, f"ppt/media/{n}.mp4", probe) for n in ("v", "orphan")], "package string, media string, probe string")
    inputs = packages.plan_inputs(packages.placed_media(found, links), parts, probes)
    plan = {r["media"]: r for r in budget.profile_plan(inputs, "balanced").collect()}
    whole, orphan = plan["ppt/media/v.mp4"], plan["ppt/media/orphan.mp4"]
    assert (whole["area"], whole["display_px"], whole["referenced"], whole["n_occurrences"]) == (1.0, 1080, True, 1) and whole["plan_height"] == 1080
    assert (orphan["area"], orphan["display_px"], orphan["referenced"], orphan["n_occurrences"]) == (0.0, 0, False, 0) and orphan["plan_height"] < 1080
    assert {r["media"] for r in packages.orphan_media(parts, links).collect()} == {"ppt/media/orphan.mp4"}


def test_turns_keep_areas_and_groups_compose():
    box = geometry.Box(3, 4, 10, 6, 33.0, True, False)
    outer = geometry.turned(0, 0, 100, 50, 120.0, False, True)
    assert geometry.placed(box, outer)[4] == pytest.approx(60)
    there, back = geometry.turned(1, 2, 8, 8, 70.0, False, False), geometry.turned(1, 2, 8, 8, -70.0, False, False)
    assert geometry.after(back, there) == pytest.approx(geometry.SAME)


def test_pages_and_anchors():
    sheet = lambda inner: ElementTree.fromstring(f"<worksheet {S}>{inner}</worksheet>")
    assert geometry.page_pixels(sheet("")) == (682, 912)
    assert geometry.page_pixels(sheet('<pageMargins left="1" right="1" top="0.5" bottom="0.5"/><pageSetup paperSize="9" orientation="landscape"/>')) == (round(9.69 * 96), round(7.27 * 96))
    anchor = lambda inner: ElementTree.fromstring(f"<xdr:a {NS}>{inner}</xdr:a>")
    cells = "<xdr:from><xdr:col>1</xdr:col><xdr:row>2</xdr:row></xdr:from><xdr:to><xdr:col>4</xdr:col><xdr:row>7</xdr:row></xdr:to>"
    assert geometry.anchor_pixels(anchor(cells)) == (192, 100) and geometry.anchor_pixels(anchor("")) == (1, 1)
    assert geometry.anchor_pixels(anchor(f'{cells}<xdr:pic><xdr:nvPicPr>{LIST}</xdr:nvPicPr><xdr:spPr><a:xfrm><a:ext cx="95250" cy="190500"/></a:xfrm></xdr:spPr></xdr:pic>')) == (10, 20)

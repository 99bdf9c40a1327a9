"""Files by byte ranges, one of them beyond what a binary value holds."""

import hashlib
import resource
import zipfile

from test_packages import NS, rels

from assetloom.sources import packages, ranges


def test_a_package_beyond_two_gigabytes(spark, tmp_path):
    zeros, h, n = bytes(64 << 20), hashlib.sha256(), 34
    with zipfile.ZipFile(tmp_path / "big deck.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="rId1"/></p:sldIdLst><p:sldSz cx="100" cy="100"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels(("slide", "slides/slide1.xml", "")))
        z.writestr("ppt/slides/slide1.xml", f'<p:sld {NS}><p:pic><p:nvPicPr><p:cNvPr id="1" name="v"/><p:nvPr><a:videoFile r:link="rId1"/></p:nvPr></p:nvPicPr><p:spPr><a:xfrm><a:ext cx="50" cy="50"/></a:xfrm></p:spPr></p:pic></p:sld>')
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rels(("video", "../media/v.mp4", "")))
        with z.open("ppt/media/v.mp4", "w", force_zip64=True) as f:
            for _ in range(n):
                f.write(zeros)
                h.update(zeros)
    (tmp_path / "broken.pptx").write_bytes(b"PK no package")
    files = packages.listed(spark, str(tmp_path), ("pptx",))
    got = {(r["package"].rsplit("/", 1)[1], r["member"]): r for r in ranges.hashed_members(files).collect()}
    video = got["big%20deck.pptx", "ppt/media/v.mp4"] if ("big%20deck.pptx", "ppt/media/v.mp4") in got else got["big deck.pptx", "ppt/media/v.mp4"]
    assert (video["size"], video["sha256"]) == (n * len(zeros), h.hexdigest()) and video["size"] > 1 << 31
    assert got["broken.pptx", None]["error"] and len(got) == 6
    found = packages.occurrences(files).where("error IS NULL").collect()
    assert [(r["shape_name"], r["area_ratio"]) for r in found] == [("v", 0.25)]
    big = str(tmp_path / "big deck.pptx")
    pairs = spark.createDataFrame([(1, 2, big, big), (1, 3, big, str(tmp_path / "broken.pptx")), (1, 4, big, "/none")], "a int, b int, path_a string, path_b string")
    out = {r["b"]: r["similarity"] for r in ranges.file_similarity(pairs).collect()}
    assert out[2] == 1.0 and 0 < out[3] < 1 and out[4] is None
    (tmp_path / "big deck.pptx").unlink()
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 1 << 22  # KB; no process held the package


def test_damaged_copies(spark, tmp_path):
    whole = bytes(range(256)) * 4000
    for name, data in {"a": whole, "b": whole[:600_000] + b"x" * 300_000, "c": whole[:100_000], "d": bytes(len(whole))}.items():
        (tmp_path / name).write_bytes(data)
    rows = [(k, "clip", str(tmp_path / p), 1920, 1080, seconds, (tmp_path / p).stat().st_size, error) for k, p, seconds, error in ((1, "a", 10.0, None), (2, "b", 10.2, "cut"), (3, "c", 10.0, "cut"), (4, "d", 10.1, ""), (5, "b", 10.3, "cut"), (6, "b", 10.0, None))]
    rows.append((7, "other", str(tmp_path / "b"), 1920, 1080, 10.0, 900_000, "cut"))
    got = ranges.damaged_copies(spark.createDataFrame(rows, "id int, name string, path string, width int, height int, duration_sec double, size_bytes long, error string")).collect()
    assert {(r["a"], r["b"], r["broken"]) for r in got} == {(2, 6, 2), (1, 2, 2)} - ({(1, 2, 2)} if ranges.aligned_share(str(tmp_path / "a"), str(tmp_path / "b")) < 0.7 else set())

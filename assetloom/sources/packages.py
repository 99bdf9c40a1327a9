"""Scans of office packages: a ZIP file a row, its members, relationships and media occurrences as rows.

Packages are read with Spark's binaryFile reader, so they can be in any store. Only what a scan needs is parsed,
in Arrow batches; whatever can't be read gives a row with an error instead of failing the job (SRC-09's rule).
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetloom.functions import media as rules
from assetloom.sources import geometry, ranges

MEMBERS = "package string, member string, size long, compressed long, crc long, sha256 string, error string"
RELATIONSHIPS = "package string, owner string, rel_id string, kind string, target string, external boolean, error string"
OCCURRENCES = "package string, slide string, number int, shape_id string, shape_name string, rel_id string, x long, y long, cx long, cy long, slide_cx long, slide_cy long, hidden boolean, rotation double, flip_h boolean, flip_v boolean, crop_left double, crop_top double, crop_right double, crop_bottom double, placed_x double, placed_y double, placed_cx double, placed_cy double, placed_area double, error string"

# Folders that tools write, and the namespaces of the formats.
IGNORED_FOLDERS = (".git", ".venv", "build", "dist", "__pycache__")
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def packages(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pptx", "docx", "xlsx")) -> DataFrame:
    """SRC-01, SRC-05, SRC-06, SRC-08: the files of a folder and its subfolders, one row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(path)
    return files.select(F.col("path").alias("package"), "content")


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pptx", "docx", "xlsx")) -> DataFrame:
    """SRC-01, SRC-05, SRC-06: the packages of a folder without their contents. Scans of these rows read by byte ranges: the
    central directory and the members that they need, so that packages may have any size.

    The store must be one that Arrow's file systems reach from executors (a shared folder, HDFS, S3, GCS).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(path)
    return files.select(F.col("path").alias("package"))


def crawl(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC-12: path, size and time of every file that isn't empty (Spark's reader skips those); contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), "modificationTime")


def public_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21: the files of a tree but those in folders that tools write, with whether each is text. Spark's reader skips empty files."""
    from assetloom.functions.media import is_text

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.split(F.element_at(F.split("path", F.lit(f"\\Q{root}/\\E"), 2), -1), "/")
    return files.where(~F.arrays_overlap(F.slice(inside, 1, F.size(inside) - 1), F.array(*[F.lit(d) for d in IGNORED_FOLDERS]))).select("path", F.col("length").alias("size_bytes"), is_text(F.col("path"), F.col("content")).alias("is_text"))


def owner_of(rels: str) -> str:
    """SCL-07: the part that a relationship member belongs to."""
    folder, name = posixpath.split(rels)
    return posixpath.join(posixpath.dirname(folder), name.removesuffix(".rels"))


def target_of(owner: str, target: str) -> str:
    """SCL-07: a relationship's target as a member name."""
    target = target.replace("\\", "/")
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(owner), target))


#: Bytes that a member of XML may have unpacked.
MOST_XML = 64 << 20


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    """A member's root element; entities that a document declares itself are refused, as is what unpacks without bound."""
    with z.open(name) as f:
        data = f.read(MOST_XML + 1)
    if len(data) > MOST_XML:
        raise ValueError(f"{name} is larger than {MOST_XML} bytes")
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def _hashed(z: zipfile.ZipFile, name: str) -> str:
    h = hashlib.sha256()
    with z.open(name) as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def _scan(read: Callable[[zipfile.ZipFile], Iterator[tuple]], schema: str) -> Callable:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                package = batch.column(0)[k].as_py()
                try:
                    with (ranges.opened(package) if batch.num_columns == 1 else io.BytesIO(batch.column(1)[k].as_py())) as held, zipfile.ZipFile(held) as z:
                        rows = [(package, *r, None) for r in read(z)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error) as e:
                    rows = [(package, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    return work


def _members(z: zipfile.ZipFile) -> Iterator[tuple]:
    for i in z.infolist():
        if not i.is_dir():
            yield i.filename, i.file_size, i.compress_size or i.file_size, i.CRC, _hashed(z, i.filename)


def members(rows: DataFrame) -> DataFrame:
    """SUP-05, SCL-43: members with their effective size, checksum and hash."""
    return rows.mapInArrow(_scan(_members, MEMBERS), MEMBERS)


def _relationships(z: zipfile.ZipFile) -> Iterator[tuple]:
    for name in z.namelist():
        if name.endswith(".rels"):
            owner = owner_of(name)
            for r in _xml(z, name):
                external = r.get("TargetMode") == "External"
                target = r.get("Target", "")
                yield owner, r.get("Id"), r.get("Type", "").rpartition("/")[2], target if external else target_of(owner, target), external


def relationships(rows: DataFrame) -> DataFrame:
    """SRC-03: every relationship of every part."""
    return rows.mapInArrow(_scan(_relationships, RELATIONSHIPS), RELATIONSHIPS)


def referenced_media(rels: DataFrame, kinds: tuple[str, ...] = ("image", "video", "media", "audio")) -> DataFrame:
    """SRC-03: (package, media, owners) of internal relationships."""
    inside = rels.where(F.col("kind").isin(*kinds) & ~F.col("external"))
    return inside.groupBy("package", F.col("target").alias("media")).agg(F.sort_array(F.collect_set("owner")).alias("owners"))


def orphan_media(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """JON-19, SET-04: media members that no relationship refers to."""
    media = parts.where(F.col("member").rlike("(^|/)media/")).select("package", F.col("member").alias("media"))
    return media.join(referenced_media(rels).select("package", "media"), ["package", "media"], "left_anti")


def _slide_order(z: zipfile.ZipFile) -> list[str]:
    """SRC-02: slides in the order of presentation; of their file numbers where that can't be told."""
    names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    by_number = sorted(names, key=lambda n: int(re.findall(r"\d+", n)[-1]))
    try:
        rels = {r.get("Id"): target_of("ppt/presentation.xml", r.get("Target", "")) for r in _xml(z, "ppt/_rels/presentation.xml.rels")}
        listed = [rels[s.get(f"{_R}id")] for s in _xml(z, "ppt/presentation.xml").iter(f"{_P}sldId")]
    except KeyError:
        return by_number
    return [n for n in listed if n in set(names)] or by_number


def _occurrences(z: zipfile.ZipFile) -> Iterator[tuple]:
    width = height = 0
    if "ppt/presentation.xml" in z.namelist():
        size = _xml(z, "ppt/presentation.xml").find(f"{_P}sldSz")
        if size is not None:
            width, height = int(size.get("cx", 0)), int(size.get("cy", 0))
    for number, slide in enumerate(_slide_order(z), 1):
        root = _xml(z, slide)
        hidden = root.get("show") == "0"
        for pic, outer in geometry.pictures(root):
            box = geometry.box_of(pic.find(f"{_P}spPr/{_A}xfrm"))
            if box is None:
                continue
            named = pic.find(f"{_P}nvPicPr/{_P}cNvPr")
            shape = (named.get("id"), named.get("name")) if named is not None else (None, None)
            place = (box.x, box.y, box.cx, box.cy, width, height, hidden, box.rotation, box.flip_h, box.flip_v, *geometry.crop(pic), *geometry.placed(box, outer))
            for rel in dict.fromkeys(r for _, r in geometry.media_ids(pic)):
                yield slide, number, *shape, rel, *place


def occurrences(rows: DataFrame) -> DataFrame:
    """SRC-01, SRC-02, SRC-04, PRJ-02: pictures and videos on slides, with their share of the slide.

    Shares are those of a picture's own extent; `placed_...` is what it covers once it is turned and the groups around it
    are scaled, turned and mirrored, and `placed_ratio` the share of the slide of that. Pictures without an extent are none.
    """
    found = rows.mapInArrow(_scan(_occurrences, OCCURRENCES), OCCURRENCES)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = found.withColumns({"width_ratio": share("cx", "slide_cx"), "height_ratio": share("cy", "slide_cy")})
    slide = F.col("slide_cx").cast("double") * F.col("slide_cy")
    return out.withColumns({"area_ratio": F.col("width_ratio") * F.col("height_ratio"), "placed_ratio": F.when(slide > 0, F.col("placed_area") / slide).otherwise(0.0)})


def shown_only(found: DataFrame) -> DataFrame:
    """SRC-02, SRC-19: occurrences on slides that aren't hidden, numbered without these."""
    slides = found.select("package", "slide", "number", "hidden").distinct()
    kept = slides.where("NOT hidden").withColumn("shown", F.row_number().over(W.partitionBy("package").orderBy("number")))
    return found.join(kept.select("package", "slide", "shown"), ["package", "slide"]).withColumn("number", F.col("shown")).drop("shown")


def placed_media(found: DataFrame, rels: DataFrame) -> DataFrame:
    """SRC-01, AGG-08: each media part with its occurrences and the largest of them."""
    joined = found.join(rels.select("package", F.col("owner").alias("slide"), "rel_id", "kind", F.col("target").alias("media")), ["package", "slide", "rel_id"])
    place = F.struct("area_ratio", (-F.col("number")).alias("first"))
    return joined.groupBy("package", "media").agg(F.count("*").alias("n_occurrences"), F.sort_array(F.collect_set("number")).alias("slides"), F.max_by(F.struct("width_ratio", "height_ratio", "area_ratio"), place).alias("largest"))


def plan_inputs(placed: DataFrame, parts: DataFrame, probes: DataFrame, render_height: int = 1080, overscan: float = 1.1) -> DataFrame:
    """SRC-01, PRJ-02, PRJ-05: each video of a deck as `budget.profile_plan` takes it.

    placed: of `placed_media`; parts: of `members`; probes: (package, media, probe), what a probe says of the file. Videos
    that no slide shows are planned as the smallest (`referenced` false).
    """
    sized = parts.select("package", F.col("member").alias("media"), F.col("size").alias("size_bytes"))
    videos = transcode_source(probes.join(sized, ["package", "media"]))
    rows = videos.join(placed.withColumn("referenced", F.lit(True)), ["package", "media"], "left")
    ratio = lambda c: F.coalesce(F.col(f"largest.{c}"), F.lit(0.0))
    return rows.withColumns({
        "area": ratio("area_ratio"), "width_ratio": ratio("width_ratio"), "height_ratio": ratio("height_ratio"), "display_px": rules.display_pixels(F.lit(render_height), ratio("height_ratio"), overscan),
        "referenced": F.coalesce("referenced", F.lit(False)), "n_occurrences": F.coalesce("n_occurrences", F.lit(0)),
    }).drop("largest")


def fonts(rows: DataFrame) -> DataFrame:
    """SRC-17, SRT-09: distinct explicit typefaces of each package."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        faces = {m for n in z.namelist() if n.endswith(".xml") for m in re.findall(r'typeface="([^"+][^"]*)"', z.read(n).decode("utf-8", "replace"))}
        yield from ((f,) for f in sorted(faces, key=str.lower))

    schema = "package string, typeface string, error string"
    return rows.mapInArrow(_scan(read, schema), schema)


def is_signed(parts: DataFrame) -> DataFrame:
    """FLT-23: packages that hold a signature, which a rewrite would break."""
    return parts.groupBy("package").agg(F.bool_or(F.startswith(F.lower("member"), F.lit("_xmlsignatures/"))).alias("signed"))


def same_structure(before: DataFrame, after: DataFrame) -> DataFrame:
    """JON-18, SET-05: members that one side lacks or that differ in size or checksum; none where all is kept."""
    a, b = (x.select("member", F.col("size").alias(f"size_{k}"), F.col("crc").alias(f"crc_{k}")) for k, x in (("before", before), ("after", after)))
    return a.join(b, "member", "full_outer").where(~(F.col("size_before").eqNullSafe(F.col("size_after")) & F.col("crc_before").eqNullSafe(F.col("crc_after"))))


PLACED = "package string, sheet string, drawing string, media string, cx long, cy long, area_ratio double, error string"
# Namespaces of drawings.
_W = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _targets(z: zipfile.ZipFile, owner: str) -> dict[str, str]:
    """Internal targets of a part's relationships by id."""
    folder, name = posixpath.split(owner)
    rels = posixpath.join(folder, "_rels", f"{name}.rels")
    if rels not in z.namelist():
        return {}
    return {r.get("Id"): target_of(owner, r.get("Target", "")) for r in _xml(z, rels) if r.get("TargetMode") != "External"}


def _sheet_images(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Workbook -> sheet -> drawing -> anchor -> picture."""
    book = _targets(z, "xl/workbook.xml")
    for sheet in _xml(z, "xl/workbook.xml").iter(f"{_S}sheet"):
        part = book.get(sheet.get(f"{_R}id"))
        if part is None:
            continue
        drawings, root = _targets(z, part), _xml(z, part)
        width, height = geometry.page_pixels(root)
        for d in root.iter(f"{_S}drawing"):
            drawing = drawings.get(d.get(f"{_R}id"))
            if drawing is None:
                continue
            media = _targets(z, drawing)
            for anchor in _xml(z, drawing):
                w, h = geometry.anchor_pixels(anchor)
                for blip in anchor.iter(f"{_A}blip"):
                    if (m := media.get(blip.get(f"{_R}embed"))) is not None:
                        yield sheet.get("name"), drawing, m, w * geometry.EMU, h * geometry.EMU, min(1.0, w / width) * min(1.0, h / height)


def sheet_images(rows: DataFrame) -> DataFrame:
    """SRC-06: pictures of workbooks by sheet, with their share of a printable page."""
    return rows.mapInArrow(_scan(_sheet_images, PLACED), PLACED)


def _text_images(z: zipfile.ZipFile) -> Iterator[tuple]:
    if any(n.lower().startswith("_xmlsignatures/") for n in z.namelist()):
        raise ValueError("the package is signed")
    for part in sorted(n for n in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml", n)):
        media = _targets(z, part)
        for holder in (e for e in _xml(z, part).iter() if e.tag in (f"{_W}inline", f"{_W}anchor")):
            ext = next(holder.iter(f"{_W}extent"), None)
            for blip in holder.iter(f"{_A}blip"):
                if (m := media.get(blip.get(f"{_R}embed"))) is not None:
                    yield part, None, m, int(ext.get("cx", 0)) if ext is not None else 0, int(ext.get("cy", 0)) if ext is not None else 0, 1.0


def text_images(rows: DataFrame) -> DataFrame:
    """SRC-05: pictures of text documents; their share of a page counts as whole. Signed packages give an error."""
    return rows.mapInArrow(_scan(_text_images, PLACED), PLACED)


FIDELITY = "package string, audio long, linked long, grouped long, unsupported long, in_masters long, error string"


def _fidelity(z: zipfile.ZipFile) -> Iterator[tuple]:
    audio = linked = grouped = unsupported = masters = 0
    for name in z.namelist():
        if re.fullmatch(r"ppt/(slides|slideMasters|slideLayouts)/[^/]+\.xml", name):
            root = _xml(z, name)
            media = [e for e in root.iter() if e.tag in (f"{_A}audioFile", f"{_A}videoFile", f"{_A}wavAudioFile")]
            audio += sum(e.tag != f"{_A}videoFile" for e in media)
            grouped += sum(e.tag == f"{_A}videoFile" for g in root.iter(f"{_P}grpSp") for e in g.iter())
            masters += 0 if name.startswith("ppt/slides/") else len(media)
        elif name.endswith(".rels"):
            for r in _xml(z, name):
                kind = r.get("Type", "").rpartition("/")[2]
                linked += kind in ("video", "audio", "media") and r.get("TargetMode") == "External"
                unsupported += kind == "video" and r.get("TargetMode") != "External" and not re.search(r"\.(mp4|m4v|mov|wmv|avi|mkv|webm|mpg|mpeg)$", r.get("Target", "").lower())
    yield audio, linked, grouped, unsupported, masters


def fidelity(rows: DataFrame) -> DataFrame:
    """SRC-18: what a rewrite of a deck may lose: sounds, linked, grouped and unsupported media, and media of masters."""
    return rows.mapInArrow(_scan(_fidelity, FIDELITY), FIDELITY)


PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string,nb_frames:string,avg_frame_rate:string,r_frame_rate:string,bit_rate:string>>, format struct<duration:string,bit_rate:string,size:string>"


def probed(rows: DataFrame, json: str = "probe") -> DataFrame:
    """SRC-09: media metadata from a probe's JSON; what can't be read is told in `probe_error`, not raised."""
    from assetloom.functions.numbers import frame_rate

    p = F.from_json(json, PROBE)
    first = lambda kind: F.get(F.filter(F.col("p.streams"), lambda s: s["codec_type"] == kind), F.lit(0))
    out = rows.withColumn("p", p).withColumns({"v": first("video"), "a": first("audio")})
    seconds = F.coalesce(F.col("v.duration").try_cast("double"), F.col("p.format.duration").try_cast("double"))
    error = F.when(F.col("p.streams").isNull(), "unreadable").when(F.col("v").isNull(), "no_video").when(F.coalesce(seconds, F.lit(0.0)) <= 0, "no_duration").otherwise("")
    out = out.withColumns({
        "width": F.col("v.width"), "height": F.col("v.height"), "duration_sec": F.coalesce(seconds, F.lit(0.0)), "bitrate_kbps": F.floor(F.coalesce(F.col("p.format.bit_rate").try_cast("double"), F.lit(0.0)) / 1000).cast("int"), "video_codec": F.col("v.codec_name"),
        "audio_codec": F.coalesce("a.codec_name", F.lit("")), "has_audio": F.col("a").isNotNull(), "fps": frame_rate(F.coalesce("v.avg_frame_rate", F.lit(""))), "probe_error": error,
    })
    return out.drop("p", "v", "a")


def transcode_source(rows: DataFrame, json: str = "probe") -> DataFrame:
    """SUP-18: a probe and `size_bytes` as the inputs of `budget.profile_plan`: sizes, rates that are known or follow from the
    bytes, frames a second and seconds. A file without a picture's size has `width` 0 and keeps its own rates."""
    from assetloom.functions.numbers import frame_rate

    p = F.from_json(json, PROBE)
    first = lambda kind: F.get(F.filter(F.col("p.streams"), lambda s: s["codec_type"] == kind), F.lit(0))
    positive = lambda c, kind: F.when(F.col(c).try_cast(kind) > 0, F.col(c).try_cast(kind))
    rate = lambda c: F.nullif(frame_rate(F.coalesce(c, F.lit(""))), F.lit(0.0))
    out = rows.withColumn("p", p).withColumns({"v": first("video"), "a": first("audio")})
    out = out.withColumns({
        "width": F.coalesce(F.greatest(F.col("v.width"), F.lit(0)), F.lit(0)), "height": F.coalesce(F.greatest(F.col("v.height"), F.lit(0)), F.lit(0)), "fps": F.coalesce(rate("v.avg_frame_rate"), rate("v.r_frame_rate")),
        "seconds": F.greatest(F.lit(0.1), F.coalesce(positive("v.duration", "double"), positive("p.format.duration", "double"), F.lit(0.1))),
        "has_audio": positive("a.bit_rate", "long").isNotNull(), "audio_source_kbps": F.floor(F.coalesce(positive("a.bit_rate", "long"), F.lit(0)) / 1000),
        "_video": F.floor(F.coalesce(positive("v.bit_rate", "long"), positive("p.format.bit_rate", "long"), F.lit(0)) / 1000),
    })
    out = out.withColumn("total_kbps", F.greatest(F.col("_video") + F.col("audio_source_kbps"), F.floor(F.col("size_bytes") * 8 / F.col("seconds") / 1000), F.lit(1)))
    known = F.when(F.col("_video") > 0, F.col("_video"))
    return out.withColumn("video_kbps", F.greatest(F.lit(1), F.coalesce(known, F.col("total_kbps") - F.col("audio_source_kbps")))).drop("p", "v", "a", "_video")


HEADERS = "path string, format string, width int, height int, sha256 string, error string"


def _header(data: bytes) -> tuple[str, int, int]:
    """Format and size of a picture from its first bytes."""
    big = lambda a, b: int.from_bytes(data[a:b], "big")
    little = lambda a, b: int.from_bytes(data[a:b], "little")
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG", big(16, 20), big(20, 24)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "GIF", little(6, 8), little(8, 10)
    if data[:2] == b"BM":
        return "BMP", little(18, 22), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            marker, size = data[at + 1], big(at + 2, at + 4)
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return "JPEG", big(at + 7, at + 9), big(at + 5, at + 7)
            at += 2 + size
    raise ValueError("not a picture of a known format")


def image_headers(rows: DataFrame) -> DataFrame:
    """SRC-08, SRC-10: format, size and hash of standalone pictures (path, content), without decoding them."""
    names = ["path", "format", "width", "height", "sha256", "error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    kind, width, height = _header(data or b"")
                    out.append((path, kind, width, height, hashlib.sha256(data).hexdigest(), None))
                except ValueError as e:
                    out.append((path, None, None, None, None, str(e)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("path", "content").mapInArrow(work, HEADERS)

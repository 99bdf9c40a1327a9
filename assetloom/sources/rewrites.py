"""What goes back into files and catalogs: packages rewritten by a plan, media archived, intents logged, scans by suffix."""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogs, packages

# Namespaces of the package format, its list of types, types by suffix.
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
TYPES_MEMBER = "[Content_Types].xml"
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "mp4": "video/mp4", "mov": "video/quicktime", "wmv": "video/x-ms-wmv"}

REWRITTEN = "package string, content binary, sha256 string, error string"


def _text(root: ElementTree.Element, namespace: str) -> bytes:
    ElementTree.register_namespace("", namespace)
    return ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)


def _relinked(z: zipfile.ZipFile, name: str, target: dict[str, str | None]) -> bytes | None:
    """A relationship member with the new names of its targets; None where nothing changes."""
    owner, root, changed = packages.owner_of(name), packages._xml(z, name), False
    for r in root:
        if r.get("TargetMode") == "External":
            continue
        old = packages.target_of(owner, r.get("Target", ""))
        new = target.get(old, old)
        if new is None:
            raise ValueError(f"{owner} still refers to {old}")
        if new != old:
            absolute = r.get("Target", "").startswith("/")
            r.set("Target", f"/{new}" if absolute else posixpath.relpath(new, posixpath.dirname(owner) or "."))
            changed = True
    return _text(root, _RELS) if changed else None


def _typed(z: zipfile.ZipFile, target: dict[str, str | None], names: set[str]) -> bytes:
    """The list of types: parts under their new names, none for parts that went, and a default for each new suffix of media."""
    root = packages._xml(z, TYPES_MEMBER)
    suffixes = set()
    for e in list(root):
        if "PartName" in e.attrib:
            part = e.get("PartName").lstrip("/")
            now = target.get(part, part)
            if now is None:
                root.remove(e)
            else:
                e.set("PartName", f"/{now}")
        else:
            suffixes.add(e.get("Extension", "").lower())
    fresh = {posixpath.splitext(n)[1][1:].lower() for n in names} & set(MEDIA_TYPES) - suffixes
    for k, suffix in enumerate(sorted(fresh)):
        root.insert(k, ElementTree.Element(f"{{{_TYPES}}}Default", {"Extension": suffix, "ContentType": MEDIA_TYPES[suffix]}))
    return _text(root, _TYPES)


def _packed(data: bytes, changes: list[dict]) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if any(n.startswith("_xmlsignatures/") for n in names):
            raise ValueError("the package is signed")
        plan = {c["member"]: c for c in changes}
        if len(plan) != len(changes):
            raise ValueError("a member has two changes")
        if absent := sorted(m for m, c in plan.items() if m not in names and (c["content"] is None or c["target"] != m)):
            raise ValueError(f"the package has no {absent[0]}")
        target = {m: c["target"] for m, c in plan.items() if m in names}
        for m, new in list(target.items()):
            own = posixpath.join(posixpath.dirname(m), "_rels", posixpath.basename(m) + ".rels")
            if own in names and new is None:
                target[own] = None
            elif own in names and new != m:
                raise ValueError(f"{m} has relationships and keeps its name")
        after = [target.get(n, n) for n in names] + [m for m in plan if m not in names]
        if len(kept := [n for n in after if n is not None]) != len(set(kept)):
            raise ValueError("two members get one name")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as w:
            for i in z.infolist():
                change, new = plan.get(i.filename), target.get(i.filename, i.filename)
                if new is None:
                    continue
                content = change["content"] if change else None
                if content is None and i.filename == TYPES_MEMBER:
                    content = _typed(z, target, set(kept))
                elif content is None and i.filename.endswith(".rels"):
                    content = _relinked(z, i.filename, target)
                head = zipfile.ZipInfo(new, i.date_time)
                head.compress_type, head.external_attr = i.compress_type, i.external_attr
                w.writestr(head, z.read(i) if content is None else content)
            for m in sorted(set(plan) - names):
                head = zipfile.ZipInfo(m)
                head.compress_type = zipfile.ZIP_DEFLATED
                w.writestr(head, plan[m]["content"])
    return out.getvalue()


def rewritten(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """SNK-07: packages with the changes to their members; a package a row, with its new bytes and hash, or the error.

    changes: package, member, target, content. A target of null removes the member, one of another name renames it, and
    every relationship and type follows; content of null keeps the bytes. A member that isn't there yet is appended under
    its own name. Members keep their order, time and compression, so equal plans give equal bytes. A removal that leaves
    a reference, a new name for a part with relationships, names that meet and signed packages are errors; a part's own
    relationships go with it. A package without changes doesn't come back.
    """
    schema = pa.schema([("package", pa.string()), ("content", pa.binary()), ("sha256", pa.string()), ("error", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                package, content, error = batch.column(0)[k].as_py(), None, None
                try:
                    content = _packed(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                sha = None if content is None else hashlib.sha256(content).hexdigest()
                yield pa.RecordBatch.from_pylist([{"package": package, "content": content, "sha256": sha, "error": error}], schema=schema)

    plan = changes.groupBy("package").agg(F.collect_list(F.struct("member", "target", "content")).alias("changes"))
    return rows.select("package", "content").join(plan, "package").select("package", "content", "changes").mapInArrow(work, REWRITTEN)


def structure_changes(before: DataFrame, after: DataFrame, key: str = "document") -> DataFrame:
    """SUP-11: what a rewrite changed of a document's structure; no row if it is the same.

    Both: key, kind (page, annotation, field, attachment, outline), fingerprint. Repeated entries count as often as they come.
    """
    both = before.select(key, "kind", "fingerprint", F.lit(-1).alias("side")).unionByName(after.select(key, "kind", "fingerprint", F.lit(1).alias("side")))
    return both.groupBy(key, "kind", "fingerprint").agg(F.sum("side").alias("change")).where("change <> 0")


def archived(media: DataFrame, hashes: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-03: media of decks as assets, and the variants that the library lacks.

    media: package, media, sha256, size_bytes. hashes: sha256, family_id, as known by the library; several families of one
    hash name none of them. matches: sha256, family_id, as found by fingerprints. Returns the media with family_id and how
    it came (existing, ambiguous, matched, new), and one variant for each content that is stored now, under the first name.
    """
    known = hashes.groupBy("sha256").agg(F.count_distinct("family_id").alias("_n"), F.min("family_id").alias("_known"))
    near = matches.groupBy("sha256").agg(F.count_distinct("family_id").alias("_m"), F.min("family_id").alias("_near"))
    how = F.when(F.col("_n") == 1, "existing").when(F.col("_n") > 1, "ambiguous").when(F.col("_m") == 1, "matched").otherwise("new")
    family = F.when(F.col("how") == "existing", F.col("_known")).when(F.col("how") == "matched", F.col("_near")).when(F.col("how") == "new", F.concat(F.lit("family-"), F.left("sha256", F.lit(16))))
    assets = media.join(known, "sha256", "left").join(near, "sha256", "left").withColumn("how", how).withColumn("family_id", family).drop("_n", "_known", "_m", "_near")
    stored = assets.where(F.col("how").isin("matched", "new")).groupBy("sha256").agg(F.min(F.struct("package", "media", "family_id", "size_bytes")).alias("v"))
    return assets, stored.select("sha256", "v.family_id", F.element_at(F.split("v.media", "/"), -1).alias("name"), "v.size_bytes")


def log_intents(entries: DataFrame, root: str, expected: int) -> str:
    """SNK-10: the whole quarantine log as a new revision, written aside and renamed, before any file is moved."""
    if not entries.where("variant_id IS NULL OR path IS NULL OR quarantined_path IS NULL OR state IS NULL OR state NOT IN ('moving', 'quarantined', 'reverted')").isEmpty():
        raise ValueError("an intent lacks its variant, path, place in quarantine or state")
    return catalogs.committed(entries, root, expected)


def native_binaries(rows: DataFrame) -> DataFrame:
    """SRC-23: path, hash, format and processor of the programs among files (path, content), read from their headers.

    What they link to isn't read.
    """
    at = lambda start, n: F.hex(F.substring("content", start, n))
    start = F.conv(F.concat(at(64, 1), at(63, 1), at(62, 1), at(61, 1)), 16, 10).cast("int")
    coff = F.hex(F.substring("content", start + 1, F.lit(6)))
    kind = F.when(at(1, 4) == "7F454C46", "elf").when(at(1, 4) == "CFFAEDFE", "mach-o").when((at(1, 2) == "4D5A") & coff.startswith("50450000"), "pe")
    # Numbers of processors in the three formats, as bytes in files.
    arch: dict[str, tuple[Column, dict[str, str]]] = {
        "elf": (at(19, 2), {"0300": "x86", "3E00": "x86_64", "2800": "arm", "B700": "arm64"}),
        "mach-o": (at(5, 4), {"07000001": "x86_64", "0C000001": "arm64"}),
        "pe": (F.right(coff, F.lit(4)), {"4C01": "x86", "6486": "x86_64", "64AA": "arm64"}),
    }
    found = F.coalesce(*[F.when((F.col("format") == f) & (number == n), a) for f, (number, names) in arch.items() for n, a in names.items()])
    return rows.withColumn("format", kind).where("format IS NOT NULL").select("path", F.sha2("content", 256).alias("sha256"), "format", found.alias("arch"))


Scan = Callable[[DataFrame], DataFrame]
BACKENDS: dict[str, Scan] = {"pptx": packages.occurrences, "xlsx": packages.sheet_images, "docx": packages.text_images}


def backend(path: str, others: dict[str, Scan] | None = None) -> Scan:
    """UDF-02, UDF-03: the scan of a document by its suffix; callers may bring scans of their own or put them in place of these."""
    suffix = posixpath.splitext(path)[1][1:].lower()
    found = BACKENDS | (others or {})
    if suffix not in found:
        raise ValueError(f"no scan for .{suffix}; there are {', '.join(sorted(found))}")
    return found[suffix]


def scanned(spark: SparkSession, path: str, others: dict[str, Scan] | None = None) -> DataFrame:
    """UDF-02, SRC-08: the placed media of all documents of a folder, each kind by its scan; columns that a kind lacks are null."""
    out = None
    for suffix, scan in (BACKENDS | (others or {})).items():
        rows = scan(packages.packages(spark, path, (suffix,))).withColumn("kind", F.lit(suffix))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out

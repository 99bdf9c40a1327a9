"""Pictures of PDF files: objects by cross-reference tables and streams, places from the content of pages.

A task reads a file's objects and gives rows: a row for each page, and one for each place of a picture. What follows from
them (pictures once by number and generation, the largest place, the class of a page, what is left out and why) is joins
and aggregates. A file whose cross-references can't be read is searched for its objects; one that still makes no sense
gives a row with an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions import media as rules
from assetloom.sources import ranges
from assetloom.sources.geometry import SAME, Map, after

SCAN = "path string, page int, has_text boolean, name string, num int, gen int, width int, height int, bits int, space string, filter string, bytes long, complex string, width_ratio double, height_ratio double, area_ratio double, reason string, error string"
# Properties of pictures that a rewrite doesn't keep, and colour spaces that it does.
COMPLEX = ("SMask", "Mask", "ImageMask", "Alternates", "Metadata", "OC", "OPI")
PLAIN = ("DeviceGray", "DeviceRGB", "DeviceCMYK")
#: Forms inside forms, and bytes that a stream may unpack to.
DEEP, MOST = 12, 256 << 20
_SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z])")


class Name(str):
    pass


class Ref(tuple):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    depth, start = 0, at
    while True:
        c = data[at : at + 1]
        if c == b"\\":
            at += 1
        elif c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return data[start + 1 : at], at + 1
        elif not c:
            raise ValueError("a string has no end")
        at += 1


def parse(data: bytes, at: int) -> tuple[object, int]:
    """The value at a place, and where it ends. Operators come as bytes."""
    at = _SPACE.match(data, at).end()
    two = data[at : at + 2]
    if two == b"<<":
        out, at = {}, at + 2
        while True:
            at = _SPACE.match(data, at).end()
            if data[at : at + 2] == b">>":
                return out, at + 2
            key, at = parse(data, at)
            out[key], at = parse(data, at)
    if two[:1] == b"[":
        items, at = [], at + 1
        while True:
            at = _SPACE.match(data, at).end()
            if data[at : at + 1] == b"]":
                return items, at + 1
            item, at = parse(data, at)
            items.append(item)
    if two[:1] == b"(":
        return _string(data, at)
    if two[:1] == b"<":
        end = data.index(b">", at)
        return bytes.fromhex((h := re.sub(rb"\s", b"", data[at + 1 : end]).decode()) + "0" * (len(h) % 2)), end + 1
    if two[:1] == b"/":
        m = _TOKEN.match(data, at + 1)
        raw = m.group() if m else b""
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1")), at + 1 + len(raw)
    if m := _REF.match(data, at):
        return Ref((int(m[1]), int(m[2]))), m.end()
    m = _TOKEN.match(data, at)
    if not m:
        raise ValueError(f"nothing to read at {at}")
    word = m.group()
    if _NUMBER.match(word):
        return (float(word) if b"." in word else int(word)), m.end()
    return {b"true": True, b"false": False, b"null": None}.get(word, word), m.end()


def _unpredicted(data: bytes, p: dict) -> bytes:
    """Undo the predictors of PNG; others but none are refused."""
    kind = p.get("Predictor", 1)
    if kind == 1:
        return data
    if kind < 10:
        raise ValueError(f"predictor {kind}")
    step = max(1, p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8)
    width = (p.get("Columns", 1) * p.get("Colors", 1) * p.get("BitsPerComponent", 8) + 7) // 8
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            guess = left + up - corner
            paeth = min((left, up, corner), key=lambda x: abs(guess - x))
            row[i] = (row[i] + (0, left, up, (left + up) // 2, paeth)[how]) & 255
        out += row
        above = bytes(row).ljust(width, b"\0")
    return bytes(out)


class Document:
    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.trailer, self.held = data, {}, {}, {}
        try:
            self._linked(int(re.findall(rb"startxref\s+(\d+)", data[-2048:])[-1]))
            self.resolve(self.trailer["Root"])["Pages"]
        except (IndexError, ValueError, KeyError, TypeError, RecursionError, zlib.error):
            self.places, self.held = {}, {}
            for m in re.finditer(rb"(?:^|[\r\n ])(\d+)[ \t]+(\d+)[ \t]+obj\b", data):
                self.places[int(m[1])] = (1, m.start(1), int(m[2]))
            for m in re.finditer(rb"trailer", data):
                self.trailer |= parse(data, m.end())[0]
            if "Root" not in self.trailer:
                roots = [Ref((n, g)) for n, (_, _, g) in self.places.items() if isinstance(x := self.resolve(Ref((n, g))), dict) and x.get("Type") == "Catalog"]
                if not roots:
                    raise ValueError("no catalogue") from None
                self.trailer["Root"] = roots[-1]

    def _linked(self, at: int | None) -> None:
        """Cross-reference tables and streams, the newest first."""
        seen: set[int] = set()
        while at is not None and at not in seen:
            seen.add(at)
            begin = _SPACE.match(self.data, at).end()
            if self.data[begin : begin + 4] == b"xref":
                trailer = self._table(begin + 4)
            else:
                trailer = self._stream(at)
            self.trailer = trailer | self.trailer
            if isinstance(hybrid := trailer.get("XRefStm"), int) and hybrid not in seen:
                seen.add(hybrid)
                self._stream(hybrid)
            at = trailer.get("Prev")

    def _table(self, at: int) -> dict:
        while True:
            first, at = parse(self.data, at)
            if first == b"trailer":
                return parse(self.data, at)[0]
            n, at = parse(self.data, at)
            for k in range(n):
                offset, at = parse(self.data, at)
                gen, at = parse(self.data, at)
                used, at = parse(self.data, at)
                if used == b"n":
                    self.places.setdefault(first + k, (1, offset, gen))

    def _stream(self, at: int) -> dict:
        head, raw = self._object(at)
        rows = self.decoded(head, raw)
        widths = head["W"]
        index = head.get("Index", [0, head["Size"]])
        numbers = [first + k for first, n in zip(index[::2], index[1::2], strict=True) for k in range(n)]
        for number, row in zip(numbers, range(0, len(rows), sum(widths)), strict=False):
            fields, p = [], row
            for w in widths:
                fields.append(int.from_bytes(rows[p : p + w], "big") if w else None)
                p += w
            kind = 1 if fields[0] is None else fields[0]
            if kind in (1, 2):
                self.places.setdefault(number, (kind, fields[1], fields[2] or 0))
        return head

    def _object(self, at: int) -> tuple[object, bytes | None]:
        """The object at a place, with its raw stream."""
        for _ in range(2):
            _, at = parse(self.data, at)
        word, at = parse(self.data, at)
        if word != b"obj":
            raise ValueError(f"no object at {at}")
        value, at = parse(self.data, at)
        at = _SPACE.match(self.data, at).end()
        if not isinstance(value, dict) or self.data[at : at + 6] != b"stream":
            return value, None
        at += 6 + (2 if self.data[at + 6 : at + 8] == b"\r\n" else 1)
        size = self.resolve(value.get("Length"))
        if not isinstance(size, int) or not re.match(rb"\s*endstream", self.data[at + size : at + size + 20]):
            size = self.data.index(b"endstream", at) - at
        return value, self.data[at : at + size]

    def found(self, ref: Ref) -> tuple[object, bytes | None]:
        if ref[0] not in self.held:
            kind, a, b = self.places.get(ref[0], (0, 0, 0))
            if kind == 2:
                head, raw = self.found(Ref((a, 0)))
                body = self.decoded(head, raw)
                pairs = [int(x) for x in body[: head["First"]].split()]
                for number, offset in zip(pairs[::2], pairs[1::2], strict=True):
                    if self.places.get(number, (0,))[:2] == (2, a):
                        self.held.setdefault(number, (parse(body, head["First"] + offset)[0], None))
            elif kind == 1:
                self.held[ref[0]] = self._object(a)
            self.held.setdefault(ref[0], (None, None))
        return self.held[ref[0]]

    def resolve(self, x: object) -> object:
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            x = self.found(x)[0]
        raise ValueError("references go round in a circle")

    def filters(self, head: dict) -> list[str]:
        f = self.resolve(head.get("Filter")) or []
        return [self.resolve(x) for x in (f if isinstance(f, list) else [f])]

    def decoded(self, head: dict, raw: bytes) -> bytes:
        parms = self.resolve(head.get("DecodeParms")) or {}
        parms = parms if isinstance(parms, list) else [parms]
        for k, name in enumerate(self.filters(head)):
            if name not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {name}")
            one = zlib.decompressobj()
            raw = one.decompress(raw, MOST)
            if one.unconsumed_tail:
                raise ValueError(f"a stream unpacks to more than {MOST} bytes")
            raw = _unpredicted(raw, self.resolve(parms[k]) or {} if k < len(parms) else {})
        return raw

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        stack, seen = [(self.resolve(self.trailer["Root"])["Pages"], {})], set()
        while stack:
            ref, above = stack.pop()
            if isinstance(ref, Ref):
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.resolve(ref)
            if not isinstance(node, dict):
                continue
            node = above | node
            if "Kids" in node:
                kept = {k: node[k] for k in ("Resources", "MediaBox") if k in node}
                stack += [(kid, kept) for kid in reversed(self.resolve(node["Kids"]))]
            else:
                yield node


def _drawn(doc: Document, content: bytes, resources: dict, outer: Map, depth: int = 0) -> Iterator[tuple]:
    """("text",), ("inline",), and ("image", name, reference, map) of what a content stream draws."""
    objects = doc.resolve(resources.get("XObject")) or {}
    ctm, stack, operands, at = outer, [], [], 0
    while (at := _SPACE.match(content, at).end()) < len(content):
        if content[at : at + 1] in b"{})":
            at += 1
            continue
        x, at = parse(content, at)
        if not isinstance(x, bytes) or isinstance(x, Name) or content[at - 1 : at] in (b")", b">"):
            operands.append(x)
            continue
        if x == b"q":
            stack.append(ctm)
        elif x == b"Q" and stack:
            ctm = stack.pop()
        elif x == b"cm" and len(operands) >= 6:
            ctm = after(ctm, tuple(float(v) for v in operands[-6:]))
        elif x in (b"Tj", b"TJ", b"'", b'"'):
            shown = operands[-1] if operands else b""
            if any(isinstance(s, bytes) and s.strip() for s in (shown if isinstance(shown, list) else [shown])):
                yield ("text",)
        elif x == b"BI":
            yield ("inline",)
            m = re.compile(rb"[\s]EI(?=[\s]|$)").search(content, at)
            at = m.end() if m else len(content)
        elif x == b"Do" and operands and operands[-1] in objects:
            ref = objects[operands[-1]]
            head, raw = doc.found(ref) if isinstance(ref, Ref) else (ref, None)
            if isinstance(head, dict) and head.get("Subtype") == "Image":
                yield "image", str(operands[-1]), ref, ctm
            elif isinstance(head, dict) and head.get("Subtype") == "Form" and depth < DEEP:
                inner = after(ctm, tuple(float(v) for v in doc.resolve(head.get("Matrix")) or SAME))
                yield from _drawn(doc, doc.decoded(head, raw), doc.resolve(head.get("Resources")) or resources, inner, depth + 1)
        operands = []


def _rows(data: bytes) -> Iterator[tuple]:
    doc = Document(data)
    if "Encrypt" in doc.trailer:
        raise ValueError("the file is encrypted")
    for number, page in enumerate(doc.pages(), 1):
        text, found, none = False, [], (None,) * 13
        try:
            box = [float(doc.resolve(v)) for v in doc.resolve(page.get("MediaBox")) or (0, 0, 612, 792)]
            width, height = abs(box[2] - box[0]) or 1.0, abs(box[3] - box[1]) or 1.0
            parts = doc.resolve(page.get("Contents")) or []
            content = b"\n".join(doc.decoded(*doc.found(r)) for r in (parts if isinstance(parts, list) else [page["Contents"]]) if isinstance(r, Ref))
            for what, *more in _drawn(doc, content, doc.resolve(page.get("Resources")) or {}, SAME):
                if what == "text":
                    text = True
                elif what == "inline":
                    found.append((*none, "inline"))
                else:
                    name, ref, (a, b, c, d, _, _) = more
                    head, raw = doc.found(ref)
                    space = doc.resolve(head.get("ColorSpace"))
                    odd = next((k for k in COMPLEX if head.get(k) is not None), None)
                    w, h = ((a * a + b * b) ** 0.5) / width, ((c * c + d * d) ** 0.5) / height
                    size = [doc.resolve(head.get(k)) for k in ("Width", "Height", "BitsPerComponent")]
                    found.append((name, *ref, *size, f"[{doc.resolve(space[0])}]" if isinstance(space, list) and space else str(space), "+".join(doc.filters(head)), len(raw or b""), odd, w, h, abs(a * d - b * c) / (width * height), None))
        except (ValueError, KeyError, TypeError, IndexError, zlib.error) as e:
            found.append((*none, f"unreadable: {e}"))
        for row in found or [(*none, None)]:
            yield number, text, *row


def scan(files: DataFrame) -> DataFrame:
    """SRC-07: of files (path) a row for each place of a picture on a page, and one for a page without any.

    `name` is null where no picture is named; `reason` says what was left out on a page, `error` what of a whole file.
    """
    names = [c.split()[0] for c in SCAN.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCAN.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with ranges.opened(path) as f:
                        rows = [(path, *r, None) for r in _rows(f.read())]
                except (ValueError, KeyError, TypeError, IndexError, OSError, RecursionError, zlib.error) as e:
                    rows = [(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return files.select("path").mapInArrow(work, SCAN)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """The PDF files of a folder and its subfolders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select("path")


def unsafe() -> Column:
    """Why a picture is left as it is; null where it may be compressed anew."""
    return F.when(F.contains("filter", F.lit("JBIG2Decode")), "jbig2").when(F.col("complex").isNotNull(), F.concat(F.lit("property "), F.col("complex"))).when(~F.col("space").isin(*PLAIN), "colour space").when(F.col("bytes") <= 0, "no data")


def images(scanned: DataFrame) -> DataFrame:
    """SRC-07: each picture once by number and generation, with its pages, its largest place and why it is left as it is."""
    rows = scanned.where("name IS NOT NULL")
    place = F.struct("area_ratio", (-F.col("page")).alias("first"))
    facts = ["width", "height", "bits", "space", "filter", "bytes", "complex"]
    out = rows.groupBy("path", "num", "gen").agg(F.count("*").alias("n_places"), F.count_distinct("page").alias("n_pages"), F.min("page").alias("first_page"), F.max_by(F.struct("width_ratio", "height_ratio", "area_ratio"), place).alias("largest"), *[F.first(c).alias(c) for c in facts])
    return out.withColumn("reason", unsafe())


def page_classes(scanned: DataFrame) -> DataFrame:
    """SRC-07, AGG-10: (path, page, kind, has_text, largest) of each page: digital, scanned, or mixed."""
    per = scanned.where("page IS NOT NULL").groupBy("path", "page").agg(F.bool_or("has_text").alias("has_text"), F.coalesce(F.max("area_ratio"), F.lit(0.0)).alias("largest"))
    return per.withColumn("kind", rules.page_class(F.col("largest"), F.col("has_text")))


def skipped(scanned: DataFrame) -> DataFrame:
    """SRC-07: (path, page, name, reason) of what is left out, and of whole files that can't be read."""
    left = scanned.where("reason IS NOT NULL").select("path", "page", "name", "reason")
    kept = images(scanned).where("reason IS NOT NULL").select("path", "num", "gen", F.col("reason").alias("why"))
    named = scanned.where("name IS NOT NULL").groupBy("path", "num", "gen").agg(F.min(F.struct("page", "name")).alias("at")).join(kept, ["path", "num", "gen"])
    return left.unionByName(named.select("path", "at.page", "at.name", F.col("why").alias("reason"))).unionByName(scanned.where("error IS NOT NULL").select("path", "page", "name", F.col("error").alias("reason")))

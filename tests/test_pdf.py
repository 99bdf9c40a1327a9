"""PDF files made here, object by object."""

import zlib

import pytest

from assetloom.sources import pdf

CONTENT = b"q 600 0 0 700 0 0 cm /I1 Do Q BT /F 12 Tf (Hi \\) there) Tj ET q 1 0 0 1 10 10 cm /F1 Do Q"
FORM = b"q 0 50 -100 0 0 0 cm /I2 Do Q BI /W 1 /H 1 ID x EI"


def objects(second=b"/ColorSpace /DeviceRGB"):
    stream = lambda head, data: b"<<%s /Length %d>>stream\n%s\nendstream" % (head, len(data), data)
    packed = zlib.compress(CONTENT)
    return {
        1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R 9 0 R] /MediaBox [0 0 600 800] /Resources <</XObject <</I1 5 0 R /F1 6 0 R>>>> >>",
        3: b"<</Type /Page /Parent 2 0 R /Contents 4 0 R>>", 4: stream(b"/Filter /FlateDecode", packed), 5: stream(b"/Type /XObject /Subtype /Image /Width 30 /Height 40 /BitsPerComponent 8 /Filter /DCTDecode " + second, b"jpeg"),
        6: stream(b"/Type /XObject /Subtype /Form /Matrix [2 0 0 2 0 0] /Resources <</XObject <</I2 7 0 R>>>>", FORM), 7: stream(b"/Subtype /Image /Width 3 /Height 4 /ColorSpace [/Indexed /DeviceRGB 1 <000000ffffff>] /SMask 5 0 R", b"zz"),
        9: b"<</Type /Page /Parent 2 0 R /Contents [10 0 R]>>", 10: stream(b"", b"q 300 0 0 400 0 0 cm /I1 Do Q % note\n/None Do"),
    }


def table(parts, trailer=b"<</Root 1 0 R /Size 11>>", shift=0):
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for n, body in parts.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out) + shift
    out += b"xref\n0 11\n" + b"".join(b"%010d %05d %c \n" % (at.get(n, 0), 0, ord("n" if n in at else "f")) for n in range(11))
    return bytes(out) + b"trailer\n" + trailer + b"\nstartxref\n%d\n%%%%EOF" % start


def streamed(parts):
    """Objects without streams in an object stream, places in a cross-reference stream with a predictor."""
    inside = {n: b for n, b in parts.items() if b"stream" not in b}
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, body in parts.items():
        if n not in inside:
            at[n] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    body, index = bytearray(), []
    for n, b in inside.items():
        index.append(b"%d %d" % (n, len(body)))
        body += b + b" "
    head = b" ".join(index) + b" "
    packed = zlib.compress(head + bytes(body))
    at[20] = len(out)
    out += b"20 0 obj\n<</Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d>>stream\n%s\nendstream\nendobj\n" % (len(inside), len(head), len(packed), packed)
    rows = []
    for n in range(22):
        kind, a, b = (2, 20, list(inside).index(n)) if n in inside else (1, at.get(n, len(out)), 0) if n in at or n == 21 else (0, 0, 0)
        rows.append(bytes([kind]) + a.to_bytes(3, "big") + bytes([b]))
    above, lines = bytes(5), b""
    for r in rows:
        lines += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above, strict=True))
        above = r
    packed = zlib.compress(lines)
    start = len(out)
    out += b"21 0 obj\n<</Type /XRef /Size 22 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms <</Predictor 12 /Columns 5>> /Length %d>>stream\n%s\nendstream\nendobj\n" % (len(packed), packed)
    return bytes(out) + b"startxref\n%d\n%%%%EOF" % start


@pytest.fixture
def files(spark, tmp_path):
    for name, data in {
        "table": table(objects()), "streams": streamed(objects()), "shifted": table(objects(), shift=7), "cmyk": table(objects(b"/ColorSpace /DeviceCMYK /Metadata 4 0 R")), "locked": table(objects(), b"<</Root 1 0 R /Size 11 /Encrypt 4 0 R>>"), "nonsense": b"%PDF no more",
        "circle": table(objects() | {2: b"<</Type /Pages /Kids [3 0 R 2 0 R 9 0 R] /MediaBox [0 0 600 800] /Resources <</XObject <</I1 5 0 R /F1 6 0 R>>>> >>"}), "cut": table(objects() | {4: b"<</Filter /LZWDecode /Length 2>>stream\nxx\nendstream"}),
    }.items():
        (tmp_path / f"{name}.pdf").write_bytes(data)
    return pdf.scan(pdf.pdf_files(spark, str(tmp_path)))


def of(rows, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows.collect() if r["path"].endswith(f"/{name}.pdf")), key=repr)


def test_pictures_and_their_places(files):
    found = pdf.images(files).select("path", "num", "gen", "n_places", "n_pages", "first_page", "width", "height", "largest.*", "space", "filter", "bytes", "reason")
    for name in ("table", "streams", "shifted", "circle"):
        one, two = of(found, name, "num", "n_places", "n_pages", "first_page", "width", "area_ratio", "reason"), of(found, name, "num", "width_ratio", "height_ratio", "space")
        assert one == [(5, 2, 2, 1, 30, 0.875, None), (7, 1, 1, 1, 3, pytest.approx(100 * 200 / 480_000), "property SMask")], name
        assert two == [(5, 1.0, 0.875, "DeviceRGB"), (7, pytest.approx(100 / 600), pytest.approx(0.25), "[Indexed]")]
    assert of(found, "cmyk", "num", "reason") == [(5, "property Metadata"), (7, "property SMask")]


def test_classes_of_pages_and_what_is_left_out(files):
    classes = pdf.page_classes(files)
    for name in ("table", "streams", "shifted", "circle"):
        assert of(classes, name, "page", "kind", "has_text") == [(1, "mixed", True), (2, "digital", False)]
    left = pdf.skipped(files)
    assert of(left, "table", "page", "name", "reason") == [(1, "I2", "property SMask"), (1, None, "inline")]
    assert of(left, "locked", "page", "reason") == [(None, "ValueError: the file is encrypted")]
    assert of(left, "nonsense", "page", "reason") == [(None, "ValueError: no catalogue")]
    assert (1, "unreadable: filter LZWDecode") in of(left, "cut", "page", "reason")

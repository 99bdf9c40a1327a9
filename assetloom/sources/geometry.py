"""Where pictures of a slide or sheet stand: extents by path, and affine maps through nested groups.

A shape's box is turned about its centre and mirrored; a group maps the box of its children onto its own, and is turned and
mirrored as a whole. A map is six numbers (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_P14 = "{http://schemas.microsoft.com/office/powerpoint/2010/main}"
_X = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# EMU of a pixel, pixels of a column and a row, inches of paper sizes (letter, legal, A4) and default margins.
EMU, COLUMN, ROW = 9525, 64, 20
PAPER = {1: (8.5, 11.0), 5: (8.5, 14.0), 9: (8.27, 11.69)}
MARGINS = {"left": 0.7, "right": 0.7, "top": 0.75, "bottom": 0.75}

Map = tuple[float, float, float, float, float, float]
SAME: Map = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def after(outer: Map, inner: Map) -> Map:
    """The map that applies `inner` first."""
    a, b, c, d, e, f = inner
    g, h, i, j, k, l = outer  # noqa: E741
    return g * a + i * b, h * a + j * b, g * c + i * d, h * c + j * d, g * e + i * f + k, h * e + j * f + l


def turned(x: float, y: float, cx: float, cy: float, rotation: float, flip_h: bool, flip_v: bool) -> Map:
    """A box's content mirrored and then turned clockwise about its centre."""
    mx, my = x + cx / 2, y + cy / 2
    u, v = (-1.0 if flip_h else 1.0), (-1.0 if flip_v else 1.0)
    s, c = math.sin(math.radians(rotation)), math.cos(math.radians(rotation))
    return after((1, 0, 0, 1, mx, my), after((c, s, -s, c, 0, 0), after((u, 0, 0, v, 0, 0), (1, 0, 0, 1, -mx, -my))))


@dataclass
class Box:
    x: int
    y: int
    cx: int
    cy: int
    rotation: float
    flip_h: bool
    flip_v: bool

    def map(self) -> Map:
        return turned(self.x, self.y, self.cx, self.cy, self.rotation, self.flip_h, self.flip_v)


def _numbers(e: ElementTree.Element | None, *names: str) -> list[int] | None:
    return None if e is None else [int(e.get(n, 0)) for n in names]


def box_of(transform: ElementTree.Element | None) -> Box | None:
    """The box that a transform gives; null where it has no extent. Extension lists hold elements of the same name and aren't asked."""
    size = None if transform is None else _numbers(transform.find(f"{_A}ext"), "cx", "cy")
    if size is None:
        return None
    at = _numbers(transform.find(f"{_A}off"), "x", "y") or [0, 0]
    return Box(*at, *size, int(transform.get("rot", 0)) / 60_000, transform.get("flipH") in ("1", "true"), transform.get("flipV") in ("1", "true"))


def _group_map(group: ElementTree.Element) -> Map:
    transform = group.find(f"{_P}grpSpPr/{_A}xfrm")
    box = box_of(transform)
    if box is None:
        return SAME
    first = _numbers(transform.find(f"{_A}chOff"), "x", "y") or [box.x, box.y]
    inside = _numbers(transform.find(f"{_A}chExt"), "cx", "cy") or [box.cx, box.cy]
    sx, sy = (own / child if child else 1.0 for own, child in zip((box.cx, box.cy), inside, strict=True))
    return after(box.map(), (sx, 0, 0, sy, box.x - first[0] * sx, box.y - first[1] * sy))


def pictures(element: ElementTree.Element, outer: Map = SAME) -> Iterator[tuple[ElementTree.Element, Map]]:
    """All pictures below an element in document order, each with the map of the groups around it."""
    for child in element:
        if child.tag == f"{_P}pic":
            yield child, outer
        else:
            yield from pictures(child, after(outer, _group_map(child)) if child.tag == f"{_P}grpSp" else outer)


def placed(box: Box, outer: Map) -> tuple[float, float, float, float, float]:
    """Left, top, width and height of what a box covers on the slide, and its own area there."""
    whole = after(outer, box.map())
    a, b, c, d, e, f = whole
    corners = [(a * x + c * y + e, b * x + d * y + f) for x in (box.x, box.x + box.cx) for y in (box.y, box.y + box.cy)]
    xs, ys = zip(*corners, strict=True)
    return min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys), abs(a * d - b * c) * box.cx * box.cy


def crop(pic: ElementTree.Element) -> list[float]:
    """The shares that are cut off on the left, at the top, on the right and at the bottom."""
    cut = pic.find(f"{_P}blipFill/{_A}srcRect")
    return [0.0] * 4 if cut is None else [int(cut.get(k, 0)) / 100_000 for k in "ltrb"]


def media_ids(pic: ElementTree.Element) -> list[tuple[str, str]]:
    """(kind, relationship) of a picture: its image, and its video as linked and as embedded."""
    out = [("image", e.get(f"{_R}embed")) for e in pic.iter(f"{_A}blip")]
    out += [("video", e.get(f"{_R}link")) for e in pic.iter(f"{_A}videoFile")]
    out += [("media", e.get(f"{_R}embed")) for e in pic.iter(f"{_P14}media")]
    return [(k, r) for k, r in out if r]


def page_pixels(sheet: ElementTree.Element) -> tuple[int, int]:
    """Pixels of a worksheet's printable page, by paper, orientation and margins."""
    setup, margins = sheet.find(f"{_S}pageSetup"), sheet.find(f"{_S}pageMargins")
    paper = PAPER.get(int(setup.get("paperSize", 1)) if setup is not None else 1, PAPER[1])
    width, height = reversed(paper) if setup is not None and setup.get("orientation") == "landscape" else paper
    left, right, top, bottom = (float(margins.get(k, v)) if margins is not None else v for k, v in MARGINS.items())
    return max(1, round((width - left - right) * 96)), max(1, round((height - top - bottom) * 96))


def anchor_pixels(anchor: ElementTree.Element) -> tuple[int, int]:
    """Pixels of an anchored picture: its own extent, else its shape's, else the cells that it spans."""
    size = _numbers(anchor.find(f"{_X}ext"), "cx", "cy") or _numbers(anchor.find(f".//{_A}xfrm/{_A}ext"), "cx", "cy")
    if size is not None:
        return max(1, round(size[0] / EMU)), max(1, round(size[1] / EMU))
    begin, end = anchor.find(f"{_X}from"), anchor.find(f"{_X}to")
    if begin is None or end is None:
        return 1, 1
    cell = lambda e, name, other: int(e.findtext(f"{_X}{name}", str(other)))
    column, row = cell(begin, "col", 0), cell(begin, "row", 0)
    return max(1, (cell(end, "col", column + 1) - column) * COLUMN), max(1, (cell(end, "row", row + 1) - row) * ROW)

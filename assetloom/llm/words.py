"""Words of whole texts as numbers, found in the bytes of Arrow columns.

A text column is cut into stretches of a bounded number of bytes: some short texts each, or a part of a long one.
A stretch has its own vocabulary; its words are places in it. Parts of one text are cut between words, and each begins
with the last `lead` words of the part before, so that no run of words across a cut is lost: the first `again` words
of such a stretch are known from the part before, and a run of words is new where it ends behind them.

Word characters, gaps and breaks are told by byte, so the separators must be ASCII; bytes of 128 and more never are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

INSIDE, GAP, BREAK = 0, 1, 2
#: Bytes of a stretch; a longer word makes it longer.
STRETCH = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """What each byte is: a gap between words, a break that no run of words spans, or inside of a word."""
    out = np.full(256, INSIDE, dtype=np.uint8)
    out[list(gaps)] = GAP
    out[list(breaks)] = BREAK
    return out


@dataclass
class Stretch:
    word: np.ndarray  # places in the vocabulary
    row: np.ndarray  # the row of each word
    piece: np.ndarray  # a number that changes at every break and row
    vocabulary: pa.StringArray
    again: int  # words that the stretch before had


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    return ends, np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)


def _cut(data: np.ndarray, kind: np.ndarray, lo: int, hi: int, most: int) -> int:
    """Where a part of at least about `most` / 2 bytes of a long text ends: at a byte that isn't inside a word."""
    size = most
    while lo + size < hi:
        at = np.flatnonzero(kind[data[lo + size // 2 : lo + size]] != INSIDE)
        if len(at):
            return lo + size // 2 + int(at[-1])
        size *= 2
    return hi


def _read(data: np.ndarray, kind: np.ndarray, lo: int, hi: int, begins: np.ndarray, first_row: int, again: int) -> tuple[Stretch, np.ndarray]:
    """The stretch from `lo` to `hi`, whose rows begin at `begins`, and where its words begin."""
    body = _LOWER[data[lo:hi]]
    what = kind[body]
    inside = what == INSIDE
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = begins[(begins > lo) & (begins < hi)] - lo  # rows end words, too
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, sizes = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes -= starts
    ends = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body[inside])))
    coded = words.dictionary_encode()
    row = first_row + np.searchsorted(begins - lo, starts, side="right") - 1
    piece = row + np.searchsorted(np.flatnonzero(what == BREAK), starts)
    return Stretch(coded.indices.to_numpy(), row, piece, coded.dictionary, again), starts + lo


def stretches(texts: pa.Array, kind: np.ndarray, lead: int, most: int = STRETCH) -> Iterator[Stretch]:
    """The stretches of a column without nulls, with A-Z in lower case."""
    ends, data = _buffers(texts)
    row, n = 0, len(texts)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        begins = ends[row:stop].astype(np.int64)
        lo, last, again, size = int(ends[row]), int(ends[stop]), 0, most
        while lo < last:
            hi = last if stop - row > 1 else _cut(data, kind, lo, last, size)
            got, starts = _read(data, kind, lo, hi, begins if stop - row > 1 else np.array([lo]), row, again)
            if hi < last and len(starts) <= lead:  # too few words to go on from
                size *= 2
                continue
            yield got
            lo, again, size = (last if hi == last else int(starts[-lead]) if lead else hi), lead, most
        row = stop

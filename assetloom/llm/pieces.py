"""Operator 4: exact SentencePiece encoding of a merge-type (BPE) model by backtracking, and decoding.

A sequence of pieces is the model's encoding of a text exactly when every two neighbours are compatible, that
is when merging their joined characters afresh gives the two of them again. So no priority queue over the text
is needed: Aho-Corasick gives the longest piece at every position, the encoder takes it if it is compatible
with the piece before, else a shorter one, and steps back where none is left, marking the position in a
bitfield so that it is never tried again. Work is linear in the text, also for texts without any space.

The library is used to read the vocabulary only. Pieces never hold a space mark after another character nor a
line feed beside one (checked when the model is loaded), so a text is encoded run by run, and a bounded cache
keeps the encodings of runs: it changes the time, never the result.

Cases: null is encoded as the empty text, with no ids, and decodes to the empty text; characters that the
vocabulary lacks become the bytes of their UTF-8; very long texts and very long runs are encoded whole; an
empty table gives an empty result; extra columns pass through, those named like a result as `<name>_input`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Aside, mapped, portions, with_results

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Entries of a worker's caches: two generations of runs, of which the older one goes when the newer is full, and one of pairs.
CACHED_RUNS, CACHED_PAIRS = 150_000, 200_000


class Pieces:
    """The vocabulary of a model file, with encoding and decoding."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        named = [sp.id_to_piece(i) for i in ids]
        self.score = {named[i]: sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.id = {p: i for i, p in enumerate(named) if p in self.score}
        self.byte_id = {int(named[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        byte_of = {i: b for b, i in self.byte_id.items()}
        self.surface = [chr(byte_of[i]) if byte_of.get(i, 255) < 128 else "" if sp.is_control(i) else " ⁇ " if sp.is_unknown(i) else named[i].replace(SPACE, " ") for i in ids]
        self.byte = np.array([byte_of.get(i, -1) for i in ids], dtype=np.int16)
        self.high = self.byte >= 128
        self.marked = np.array([p.startswith(SPACE) and p in self.score for p in named])
        self.control = np.array([sp.is_control(i) for i in ids])
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if len(p) > 1:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        several = [p for p in self.score if len(p) > 1]
        self.breaks = "\n" if not any("\n" in p for p in several) else ""
        self.by_runs = by_runs = not any(SPACE in p.lstrip(SPACE) for p in several)
        rest = f"[^{SPACE}{self.breaks}]"
        self.runs = re.compile((f"{self.breaks}|" if self.breaks else "") + f"{SPACE}*{rest}+|{SPACE}+") if by_runs else re.compile("(?s).+")
        self.encoded: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.compatible: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short text, by definition: the best pair first, of equals the leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether `piece` may follow `before` ("" at the start of a run)."""
        key = (before, piece)
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) >= CACHED_PAIRS:
                self.compatible.clear()
            found = self.compatible[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def split(self, run: str) -> list[str]:
        """The pieces of a run; characters that the vocabulary lacks stand alone."""
        n = len(run)
        longest = [1] * n
        for end, size in self.automaton.iter(run):
            if size > longest[end + 1 - size]:
                longest[end + 1 - size] = size
        failed = bytearray(n // 8 + 1)  # a bit for each position from which no encoding goes on
        out: list[str] = []
        at, size, score, known = 0, longest[0], self.score, self.compatible.get
        while at < n:
            before = out[-1] if out else ""
            while size:
                end = at + size
                piece = run[at:end]
                if (size == 1 or piece in score) and not failed[end >> 3] >> (end & 7) & 1:
                    fits = known((before, piece))
                    if self.fits(before, piece) if fits is None else fits:
                        break
                size -= 1
            if size:
                out.append(piece)
                at = end
                size = longest[at] if at < n else 0
            else:
                failed[at >> 3] |= 1 << (at & 7)
                size = len(out.pop())
                at -= size
        return out

    def _run(self, run: str) -> bytes:
        ids: list[int] = []
        for p in self.split(run):
            i = self.id.get(p)
            if i is not None:
                ids.append(i)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in p.encode())
            else:
                ids.append(self.unknown)
        return np.array(ids, dtype=np.int32).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        if not text:
            return b""
        cache, older, out = self.encoded, self.older, []
        for run in self.runs.findall(SPACE + text.replace(" ", SPACE)):
            got = cache.get(run)
            if got is None:
                got = older.get(run) or self._run(run)
                if len(run) <= 64:
                    if len(cache) >= CACHED_RUNS:
                        self.older, self.encoded = older, cache = cache, {}
                    cache[run] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.asarray(ids, dtype=np.int32)
        if not len(ids):
            return ""
        first = int(np.argmin(self.control[ids]))  # of the pieces that give text
        if self.high[ids].any():
            out, k, n = [], 0, len(ids)
            listed = ids.tolist()
            while k < n:
                if self.byte[listed[k]] < 0:
                    out.append(self.surface[listed[k]])
                    k += 1
                    continue
                end = k
                while end < n and self.byte[listed[end]] >= 0:
                    end += 1
                out.append(_utf8(bytes(self.byte[ids[k:end]].astype(np.uint8))))
                k = end
            text = "".join(out)
        else:
            text = "".join(map(self.surface.__getitem__, ids.tolist()))
        return text[1:] if self.marked[ids[first]] else text


def _utf8(data: bytes) -> str:
    """UTF-8 in which every byte that starts no valid character is one replacement mark."""
    out = []
    while data:
        try:
            return "".join([*out, data.decode()])
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode())
            out.append("�")
            data = data[e.start + 1 :]
    return "".join(out)


_LOADED: dict[str, Pieces] = {}


def load(path: str | None = None) -> Pieces:
    """The model of a path that every executor has; the public tokenizers' one where none is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all where None), with the `ids` of the text (array<int>) and what they decode to (`decoded`)."""
    kept = docs.select(*(docs.columns if keep is None else keep))
    names = Aside(kept)
    rows = docs.select(*kept.columns, F.coalesce(F.col(text), F.lit(""))).toDF(*names.rows.columns, "body")
    schema = T.StructType([*names.rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    width, columns = len(kept.columns), schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for start, texts in portions(batch.column(width)):
                ids = [np.frombuffer(model.encode_bytes(t), dtype=np.int32) for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                decoded = pa.array([model.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns[:width], lists, decoded], columns)

    return names.back(mapped(rows, work, schema), ["ids", "decoded"])


def digests(rows: DataFrame) -> DataFrame:
    """`rows` of `encoded` with the ids' number and hash and the decoded text's hash."""
    return with_results(rows, {
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids"), ","), 256),
        "decoded_sha256": F.sha2(F.col("decoded"), 256),
    })

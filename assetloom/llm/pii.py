"""Operator 7: personal data by fixed patterns and a semi-Markov conditional random field.

The fixed patterns give the base spans; the field adds spans beside them: the same kinds in other forms (addresses with
"(at)" and "(dot)", numbers with other separators), and secrets. Around every token that holds a digit, "@" or a
bracketed "at" or "dot", the text is cut into atoms (runs of letters and digits, single other characters). Any run of at
most `LONGEST` atoms is a candidate segment, scored for each kind by weights of features of the whole span: its
shape, groups of digits, separators, checksums, randomness, and what stands before and after; and by a weight of the kind
that the segment before it has and of the gap between the two. A dynamic program over the zone chooses boundaries
and kinds of all segments together. Outside of zones no segment can score, as each must hold such a trigger; so
whole texts are covered, of any length.

Weights are learned by gradient ascent on the likelihood (forward-backward over segments and kinds before) from a bounded
sample of what surrounds triggers (`SAMPLE` documents, `WINDOWS` places of each by a hash, `REACH` characters to either
side), annotated by the base patterns and by the patterns of secrets below. Each annotated place is also learned from
with the span rewritten in another form (`FORMS`), and beside look-alikes that are none (`DECOYS`: dates, prices, card
numbers with a wrong check digit), so that the field finds what the patterns miss.

Zones are decoded atom by atom in bounded memory: a segment ends within `LONGEST` atoms, so no more columns of values are
held, and what all paths agree on is given out. Bounds of the method, not of the texts: a segment has at most `LONGEST`
atoms (a card number, digit by digit, has 37 at most and is a base span) and `WIDEST` characters, and of what stands before a zone `CONTEXT` characters are looked at.

Cases: null is the empty text and has no spans; spans count code points; an added span never overlaps a base
span; repeated rows get a row each; without any annotated zone nothing is added; an empty table gives an empty
result; extra columns pass through, one named `spans` as `spans_input`.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Aside, mapped, portions

#: In the order of the digests.
KINDS = ("email", "ip", "card", "phone", "secret")
SAMPLE, WINDOWS, REACH, LONGEST, WIDEST, CONTEXT, AROUND = 300, 8, 200, 24, 400, 120, 2
#: Atoms after which what is settled is given out.
FLUSH = 512
ROUNDS, RATE, SHRINK = 6, 0.3, 0.002
#: What a segment must score beyond nothing.
LEAST_SCORE = 0.5

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Patterns that annotate secrets for learning.
_SECRETS = (re.compile(r"\bAKIA[0-9A-Z]{16}\b"), re.compile(r"(?i)\b(?:password|passwd|token|secret|api_?key)\s?[:=]\s?\"?([A-Za-z0-9]{8,})"))

Span = tuple[str, int, int]
Item = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out: list[Span] = [("email", *m) for m in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for kind, pattern, least, most in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
        for m in pattern.finditer(text) if kind == "card" or "+" in text else ():
            if m.end() - m.start() < least:
                continue
            digits = _digits(m.group())
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


_TRIGGER = re.compile(r"[0-9@]|[\[({<][ \t]?(?:at|dot|AT|DOT)[ \t]?[\])}>]")
_SPACE = re.compile(r"\s")
_ATOM = re.compile(r"[A-Za-z0-9]+|.", re.S)
_BEFORE = re.compile(r"(?:\S{1,40}\s){0,%d}\S{0,80}$" % AROUND)
_WORDED = re.compile(r"[ \t]?[\[({<][ \t]?(at|dot|AT|DOT)[ \t]?[\])}>][ \t]?")


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches of tokens with a trigger and a few tokens around them, merged where they meet."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := _TRIGGER.search(text, at):
        start = max(0, m.start() - CONTEXT)
        lead = _BEFORE.search(text, start, m.start())
        start = lead.start() if lead else m.start()
        m = _SPACE.search(text, m.end())
        end = m.start() if m else len(text)
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
        at = end
    return out


def _shape(s: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", s))


def _features(text: str, start: int, end: int, before: str) -> list[str]:
    """Names of what holds for a whole span."""
    s = text[start:end]
    digits = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isascii() and c.isalpha() for c in s)
    alnum = len(s) == digits + letters
    out = ["bias", f"digits:{min(digits, 20)}", f"first:{_kind(s[0])}", f"last:{_kind(s[-1])}"]
    out += [f"left:{_kind(text[start - 1]) if start else '^'}", f"right:{_kind(text[end]) if end < len(text) else '$'}", f"before:{before}"]
    plain, words = _WORDED.subn(lambda m: "@" if m[1] in ("at", "AT") else ".", s) if "t" in s or "T" in s else (s, 0)
    shape = _shape(plain)
    out.append(f"shape:{shape}" if len(shape) <= 24 else "shape:long")
    if words:
        out.append(f"worded:{min(words, 4)}")
    if " " in s:
        out.append(f"spaces:{min(s.count(' '), 6)}")
    if "@" in plain:
        host = plain[plain.rfind("@") + 1 :]
        out += [f"at:{plain.count('@')}", f"host:{min(host.count('.'), 3)}", f"solid:{' ' not in plain}", f"address:{bool(_ADDRESS.fullmatch(plain.replace(' ', '')))}"]
    if letters == 0 and digits >= 4:
        groups = re.findall("[0-9]+", s)
        marks = "".join(sorted({c for c in s if not "0" <= c <= "9"}))
        out += [f"groups:{'.'.join(str(len(g)) for g in groups[:6])}", f"marks:{marks}", f"n_groups:{min(len(groups), 6)}", f"plus:{s[0] == '+'}"]
        if 12 < digits < 20:
            out.append(f"luhn:{luhn(_digits(s))}")
            out.append(f"luhn:{luhn(_digits(s))}:even:{len({len(g) for g in groups}) == 1}")
        if len(groups) == 4:
            out.append(f"octets:{all(len(g) <= 3 and int(g) <= 255 for g in groups)}:{marks != ''}")
    if alnum and digits and letters:
        counts = Counter(s)
        entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts.values())
        case = "upper" if s.isupper() else "lower" if s.islower() else "mixed"
        out += [f"code:{min(len(s) // 4, 10)}:{case}", f"random:{int(entropy)}", f"hex:{all(c in '0123456789abcdefABCDEF' for c in s)}", f"switch:{min(len(re.findall('[0-9]+', s)), 6)}"]
    return out


_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _kind(c: str) -> str:
    return "9" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c.isspace() else c


def atoms_of(text: str, zone: tuple[int, int]) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text, *zone)]


def _told(text: str, zone: tuple[int, int]) -> Iterator[tuple[int, int, bool, bool, bool]]:
    """Atoms one after another: start, end, whether a trigger begins in it, and whether a segment may begin or end with it."""
    marks = _TRIGGER.finditer(text, *zone)
    mark = next(marks, None)
    for m in _ATOM.finditer(text, *zone):
        a, b = m.span()
        held = False
        while mark is not None and mark.start() < b:
            held, mark = True, next(marks, None)
        c = text[a]
        plain = c.isascii() and c.isalnum()
        yield a, b, held, plain or c in "+(", plain


def steps(text: str, zone: tuple[int, int]) -> Iterator[list[tuple[int, tuple[int, int], list[str]]]]:
    """For each atom of a zone the candidate segments that begin with it: number of atoms, span, features.

    No more than `LONGEST` atoms are held at a time, whatever the zone's length.
    """
    source, ahead, last = _told(text, zone), deque(), ""  # last: the word before the atom
    while True:
        while len(ahead) < LONGEST and (atom := next(source, None)) is not None:
            ahead.append(atom)
        if not ahead:
            return
        a, b, _, edge, _ = ahead[0]
        out, found = [], False
        if edge:
            for size, (c, d, held, _, final) in enumerate(ahead, 1):
                if text[c] == "\n" or d - a > WIDEST:
                    break
                found = found or held
                if found and final:
                    out.append((size, (a, d), _features(text, a, d, last)))
        yield out
        if text[a].isalpha():
            last = text[a:b].lower() if b - a <= 12 else "long"
        ahead.popleft()


def segments(text: str, zone: tuple[int, int]) -> Iterator[tuple[int, int, list[str]]]:
    """Each candidate segment as (first atom, atom after the last, features), one after another."""
    for i, found in enumerate(steps(text, zone)):
        for size, _, features in found:
            yield i, i + size, features


#: States between segments: nothing yet, or the kind of the last segment and how many atoms ago it ended (0, 1, more).
_GAPS = 3
_STATES = ["none", *(f"{k}:{g}" for k in KINDS for g in range(_GAPS))]
_AFTER = [0, *(1 + _GAPS * (s // _GAPS) + min(s % _GAPS + 1, _GAPS - 1) for s in range(len(KINDS) * _GAPS))]
_TO = [1 + _GAPS * k for k in range(len(KINDS))]


class Field:
    """Weights of (feature, kind) and of (state before, kind), with inference over one zone."""

    def __init__(self, weights: dict[str, list[float]] | None = None) -> None:
        self.weights = weights or {}

    def scores(self, features: list[str]) -> list[float]:
        total = [0.0] * len(KINDS)
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                for k, x in enumerate(w):
                    total[k] += x
        return total

    def transitions(self) -> np.ndarray:
        """Weights of a segment's kind after each state."""
        return np.array([self.weights.get(f"after:{s}", [0.0] * len(KINDS)) for s in _STATES])

    def decoded(self, zone: Iterable[list[tuple[int, Item, list[str]]]]) -> Iterator[tuple[Item, int]]:
        """The highest-scoring choice of segments (item, kind) of a zone, given as the candidates (atoms, item, features) of
        each atom; atoms outside of segments score 0.

        Only the columns of values that a segment may still end at are held. Every `FLUSH` atoms paths that no continuation
        can bring back are dropped, and the segments that all others share are given out.
        """
        into = self.transitions()
        # What a segment can gain from the one before it, and the next one from it, at most.
        most = into.max(axis=0)
        onward = [max(0.0, float((into[t : t + _GAPS] - into.min(axis=0)).max())) for t in _TO]
        # By state the best score of what ends before an atom, with its last segment: [item, kind, the segment before].
        columns: deque[dict[int, tuple[float, list | None]]] = deque([{0: (0.0, None)}])
        for n, found in enumerate(zone, 1):
            now = columns.popleft()
            if not columns:
                columns.append({})
            column = columns[0]
            for state, (v, back) in now.items():
                after = _AFTER[state]
                if after not in column or v > column[after][0]:
                    column[after] = (v, back)
            for size, item, f in found:
                for k, s in enumerate(self.scores(f)):
                    s -= LEAST_SCORE
                    if s + most[k] + onward[k] > 0:
                        v, state = max((v + into[state, k], state) for state, (v, _) in now.items())
                        while len(columns) < size:
                            columns.append({})
                        column = columns[size - 1]
                        if _TO[k] not in column or v + s > column[_TO[k]][0]:
                            column[_TO[k]] = (v + s, [item, k, now[state][1]])
            if n % FLUSH == 0:
                _drop_beaten(columns[0], into)
                yield from _shared_by_all(columns)
        chain, back = [], max(columns[0].values(), key=lambda x: x[0])[1]
        while back is not None:
            chain.append((back[0], back[1]))
            back = back[2]
        yield from chain[::-1]

    def best(self, n: int, candidates: Iterable[tuple[int, int, list[str]]]) -> list[tuple[int, int, int]]:
        """The highest-scoring choice of segments (first, after, kind) of n atoms."""
        by_first: list[list[tuple[int, tuple[int, int], list[str]]]] = [[] for _ in range(n)]
        for i, j, f in candidates:
            by_first[i].append((j - i, (i, j), f))
        return [(i, j, k) for (i, j), k in self.decoded(by_first)]


def _drop_beaten(column: dict[int, tuple[float, list | None]], into: np.ndarray) -> None:
    """Drop states that another one beats whatever follows: by more than the next segment can prefer them, now or later."""

    def least(one: int, other: int) -> float:
        gain = 0.0
        for _ in range(_GAPS):
            gain = min(gain, float((into[one] - into[other]).min()))
            one, other = _AFTER[one], _AFTER[other]
        return gain

    for other in sorted(column, key=lambda x: column[x][0]):
        if any(one != other and column[one][0] + least(one, other) > column[other][0] for one in column):
            del column[other]


def _shared_by_all(columns: Iterable[dict[int, tuple[float, list | None]]]) -> Iterator[tuple[Item, int]]:
    """Take the first segments that all paths have in common off them."""
    heads = [(column, state) for column in columns for state in column]
    chains = []
    for column, state in heads:
        chain, back = [], column[state][1]
        while back is not None:
            chain.append(back)
            back = back[2]
        chains.append(chain[::-1])
    shortest, k = min(chains, key=len), 0
    while k < len(shortest) and all(chain[k] is shortest[k] for chain in chains):
        k += 1
    if not k:
        return
    for (column, state), chain in zip(heads, chains, strict=True):
        if len(chain) > k:
            chain[k][2] = None
        else:
            column[state] = (column[state][0], None)
    yield from [(item, kind) for item, kind, _ in shortest[:k]]


def _logsum(x: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


class _Zone:
    """A zone to learn from, with its features as numbers."""

    def __init__(self, n: int, candidates: list[tuple[int, int, list[str]]], gold: list[tuple[int, int, int]], index: dict[str, int]) -> None:
        self.n, sizes = n, [len(f) for _, _, f in candidates]
        self.features = np.array([index.setdefault(name, len(index)) for _, _, f in candidates for name in f])
        self.bounds, self.sizes = np.cumsum([0, *sizes[:-1]]), np.array(sizes)
        first, after = np.array([i for i, _, _ in candidates]), np.array([j for _, j, _ in candidates])
        #: By first atom: the candidates from there, and the atoms after them.
        self.starts = [(int(i), np.flatnonzero(first == i), after[first == i]) for i in np.unique(first)]
        self.gold = np.zeros((len(candidates), len(KINDS)))
        self.before = np.zeros((len(_STATES), len(KINDS)))
        place = {(i, j): x for x, (i, j, _) in enumerate(candidates)}
        state, at = 0, 0
        for i, j, k in sorted(gold):
            if (i, j) in place:
                for _ in range(min(i - at, _GAPS)):
                    state = _AFTER[state]
                self.gold[place[i, j], k] = 1
                self.before[state, k] += 1
                state, at = _TO[k], j

    def gradients(self, scores: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of the gold segments, by the candidates' scores and by the weights of states before."""
        forward, backward = np.full((self.n + 1, len(_STATES)), -1e30), np.zeros((self.n + 1, len(_STATES)))
        forward[0, 0] = 0.0
        entered, at = {}, 0
        outside = lambda row: np.logaddexp.reduceat(row[_ORDER], _RUNS)  # noqa: E731  by the state one atom later

        for i, xs, js in self.starts:
            while at < i:
                forward[at + 1, _LATER] = np.logaddexp(forward[at + 1, _LATER], outside(forward[at]))
                at += 1
            entered[i] = forward[i][:, None] + into
            there = (js[:, None], _TO)
            forward[there] = np.logaddexp(forward[there], _logsum(entered[i]) + scores[xs])
        while at < self.n:
            forward[at + 1, _LATER] = np.logaddexp(forward[at + 1, _LATER], outside(forward[at]))
            at += 1
        total = _logsum(forward[self.n])
        seen, states = -self.gold, -self.before
        for i, xs, js in reversed(self.starts):
            while at > i:
                at -= 1
                backward[at] = backward[at + 1, _AFTER]
            ahead = scores[xs] + backward[js[:, None], _TO]
            each = np.exp(np.minimum(0.0, entered[i][None] + ahead[:, None] - total))
            seen[xs] += each.sum(axis=1)
            states += each.sum(axis=0)
            backward[i] = np.logaddexp(backward[i], _logsum((into + _logsum(ahead)).T))
        return -seen, -states


#: States that come to the same one an atom later stand together, and the states that they come to.
_ORDER = np.argsort(_AFTER, kind="stable")
_LATER, _RUNS = np.unique(np.array(_AFTER)[_ORDER], return_index=True)


def trained(data: list[tuple[int, list[tuple[int, int, list[str]]], list[tuple[int, int, int]]]], rounds: int, rate: float, dice: random.Random) -> Field:
    """The field that gradient steps on zones (atoms, candidates, gold segments) lead to."""
    index: dict[str, int] = {}
    each = [_Zone(n, candidates, gold, index) for n, candidates, gold in data if candidates]
    weights, into = np.zeros((len(index), len(KINDS))), np.zeros((len(_STATES), len(KINDS)))
    for r in range(rounds):
        dice.shuffle(each)
        step = rate / (1 + r)
        for z in each:
            g, states = z.gradients(np.add.reduceat(weights[z.features], z.bounds), into)
            some = np.repeat(np.abs(g).max(axis=1) > 1e-3, z.sizes)
            at = z.features[some]
            np.add.at(weights, at, step * (np.repeat(g, z.sizes, axis=0)[some] - SHRINK * weights[at]))
            into += step * (states - SHRINK * into * (states != 0))
    names = {name: weights[k].tolist() for name, k in index.items()}
    return Field(names | {f"after:{s}": into[k].tolist() for k, s in enumerate(_STATES)})


def annotated(text: str) -> list[Span]:
    """Base spans, and secrets beside them."""
    out = base_spans(text)
    for p in _SECRETS:
        for m in p.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if any("0" <= c <= "9" for c in text[a:b]) and not any(a < e and s < b for _, s, e in out):
                out.append(("secret", a, b))
    return out


def _grouped(s: str, mark: str, sizes: tuple[int, ...] = (4, 4, 4, 4, 4)) -> str:
    digits, parts = _digits(s), []
    for n in sizes:
        parts.append(digits[:n])
        digits = digits[n:]
    return mark.join(p for p in [*parts[:-1], parts[-1] + digits] if p)


def _national(s: str) -> str:
    return _digits(s)[-10:]


#: Other forms of each kind, by name: how a span of a base pattern or a secret is rewritten.
FORMS: dict[str, dict[str, Callable[[str], str]]] = {
    "email": {
        "(at)": lambda s: s.replace("@", "(at)"), " (at) ": lambda s: s.replace("@", " (at) "), " [at] ": lambda s: s.replace("@", " [at] "),
        "[at][dot]": lambda s: s.replace("@", "[at]").replace(".", "[dot]"), " (at) (dot) ": lambda s: s.replace("@", " (at) ").replace(".", " (dot) "), " @ ": lambda s: s.replace("@", " @ "),
    },
    "ip": {"[.]": lambda s: s.replace(".", "[.]"), "(.)": lambda s: s.replace(".", "(.)"), "[dot]": lambda s: s.replace(".", "[dot]"), " . ": lambda s: s.replace(".", " . ")},
    "card": {".": lambda s: _grouped(s, "."), "_": lambda s: _grouped(s, "_"), "/": lambda s: _grouped(s, "/"), "4-6-5": lambda s: _grouped(s, ".", (4, 6, 9))},
    "phone": {
        "(3) 3-4": lambda s: f"({_national(s)[:3]}) {_national(s)[3:6]}-{_national(s)[6:]}", "3-3-4": lambda s: _grouped(_national(s), "-", (3, 3, 4)), "3.3.4": lambda s: _grouped(_national(s), ".", (3, 3, 4)),
        "3 3 4": lambda s: _grouped(_national(s), " ", (3, 3, 4)), "1-3-3-4": lambda s: "1-" + _grouped(_national(s), "-", (3, 3, 4)),
    },
    "secret": {"bare": lambda s: s, "upper": lambda s: s.upper(), "short": lambda s: s[: max(16, len(s) * 3 // 5)]},
}


def _wrong_card(dice: random.Random) -> str:
    while luhn(digits := "".join(dice.choice("0123456789") for _ in range(16))):
        pass
    return dice.choice([digits, _grouped(digits, "."), _grouped(digits, "_"), _grouped(digits, "/"), _grouped(digits, "-")])


#: What looks alike and is none.
DECOYS: tuple[Callable[[random.Random], str], ...] = (
    lambda d: f"{d.randint(1900, 2030)}-{d.randint(1, 12):02}-{d.randint(1, 28):02}", lambda d: f"{d.randint(1, 28)}/{d.randint(1, 12)}/{d.randint(1900, 2030)}", lambda d: f"{d.randint(1, 28)}.{d.randint(1, 12)}.{d.randint(1900, 2030)}",
    lambda d: f"{d.randint(0, 23)}:{d.randint(0, 59):02}:{d.randint(0, 59):02}", lambda d: f"v{d.randint(0, 9)}.{d.randint(0, 20)}.{d.randint(0, 99)}", lambda d: f"{d.randint(1, 9)}.{d.randint(0, 9)}",
    lambda d: f"${d.randint(1, 999)},{d.randint(0, 999):03}.{d.randint(0, 99):02}", lambda d: f"978-{d.randint(0, 9)}-{d.randint(10, 99)}-{d.randint(100000, 999999)}-{d.randint(0, 9)}", lambda d: f"{d.randint(10, 9999)}-{d.randint(10, 9999)}",
    lambda d: str(d.randint(0, 10 ** d.randint(1, 12))), lambda d: f"{d.randint(300, 999)}.{d.randint(0, 999)}.{d.randint(256, 999)}.{d.randint(0, 999)}", lambda d: f"h{d.randint(1, 9)}", lambda d: f"covid{d.randint(10, 99)}", lambda d: f"@{d.choice(['home', 'work', 'noon'])}",
    _wrong_card, _wrong_card,
)


def rewritten(text: str, spans: list[Span], dice: random.Random, forms: dict[str, dict[str, Callable[[str], str]]]) -> tuple[str, list[Span]]:
    """The text with its spans in other forms and a look-alike beside some, and where the spans are then."""
    out, found, at, size = [], [], 0, 0

    def put(s: str) -> None:
        nonlocal size
        out.append(s)
        size += len(s)

    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < at or not forms.get(kind):
            continue
        name = dice.choice(sorted(forms[kind]))
        lead = text[at:a]
        if kind == "secret":  # without what announces it
            lead = re.sub(r"(?i)(?:password|passwd|token|secret|api_?key)\s?[:=]\s?\"?$", "", lead)
        put(lead)
        if dice.random() < 0.3:
            put(dice.choice(DECOYS)(dice) + " ")
        new = forms[kind][name](text[a:b])
        found.append((kind, size, size + len(new)))
        put(new)
        if dice.random() < 0.3:
            put(" " + dice.choice(DECOYS)(dice))
        at = b + (kind == "secret" and text[b : b + 1] == '"')
    put(text[at:])
    return "".join(out), found


def learn_from(texts: list[str], rounds: int = ROUNDS, rate: float = RATE, seed: int = 5, forms: dict[str, dict[str, Callable[[str], str]]] | None = None) -> Field:
    """Weights from texts annotated by patterns, as they are and rewritten; order and forms are drawn by the seed."""
    data, dice = [], random.Random(seed)
    forms = FORMS if forms is None else forms
    for text in texts:
        spans = annotated(text)
        versions = [(text, spans)]
        if spans:
            versions += [rewritten(text, spans, dice, forms) for _ in range(2)]
        for body, marked in versions:
            for zone in zones(body):
                atoms = atoms_of(body, zone)
                candidates = list(segments(body, zone))
                first, after = {a: i for i, (a, _) in enumerate(atoms)}, {b: i + 1 for i, (_, b) in enumerate(atoms)}
                gold, end = [], 0
                for k, a, b in sorted(marked, key=lambda x: x[1:]):
                    if a in first and b in after and first[a] >= end and after[b] - first[a] <= LONGEST:
                        gold.append((first[a], after[b], KINDS.index(k)))
                        end = after[b]
                if candidates:
                    data.append((len(atoms), candidates, gold))
    if not any(gold for *_, gold in data):
        return Field()
    return trained(data, rounds, rate, dice)


def learn(docs: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> Field:
    """The field from places with a digit run or "@", of a bounded sample of documents."""
    rows = docs.where(F.col(text).rlike(r"@|[0-9]{2}")).select(F.xxhash64(doc_id).alias("h"), F.col(doc_id).alias("sampled_id")).distinct()
    ids = rows.orderBy("h", "sampled_id").limit(sample).select("sampled_id")  # ids only; of bounded size, so it may be broadcast
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(F.broadcast(ids), F.col("id") == F.col("sampled_id"))
    places = F.regexp_extract_all("body", F.lit(rf"([^\n]{{0,{REACH}}}(?:@|[0-9]{{2}})[^\n]{{0,{REACH}}})"))
    some = F.slice(F.array_sort(F.transform(places, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, WINDOWS)
    one = texts.groupBy("id").agg(F.min_by("body", F.xxhash64("body")).alias("body")).select(F.explode(F.transform(some, lambda x: x["x"])).alias("x"))
    return learn_from(sorted(r["x"] for r in one.collect()))


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def extra_spans(text: str, field: Field, base: list[Span]) -> list[Span]:
    """Spans that the field finds in the whole text and that overlap no base span."""
    out: list[Span] = []
    starts, ends = _merged(base)
    for zone in zones(text):
        for (a, b), k in field.decoded(steps(text, zone)):
            at = bisect_right(ends, a)  # the first stretch that ends after the start
            if at == len(starts) or starts[at] >= b:
                out.append((KINDS[k], a, b))
    return out


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def tagged(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all where None) with `spans`: kind, start, end and base, by kind and start."""
    kept = docs.select(*(docs.columns if keep is None else keep))
    names = Aside(kept)
    rows = docs.select(*kept.columns, F.coalesce(F.col(text), F.lit(""))).toDF(*names.rows.columns, "body")
    schema = T.StructType([*names.rows.schema.fields, T.StructField("spans", T.ArrayType(_SPAN))])
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    width, columns = len(kept.columns), schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in portions(batch.column(width)):
                out = []
                for t in texts:
                    base = base_spans(t)
                    both = [(*x, True) for x in base] + ([(*x, False) for x in extra_spans(t, field, base)] if field.weights else [])
                    both.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                    out.append([dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in both])
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns[:width], pa.array(out, kinds)], columns)

    return names.back(mapped(rows, work, schema), ["spans"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first holds."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])

"""Several values packed in one field.

A cell is a lattice over all of its delimiters. Between two of them lies a
piece; at each delimiter the value that is being read either ends, goes on
with its next member, or goes on within the label of the same member.
Expectation-maximisation over the whole column learns how often each of these
happens (by the state of the value, the delimiter and the kind of the next
piece; ids are such kinds, not a grammar that must hold) and how frequent each
member of values is. The most probable way through the lattice of a cell
(Viterbi) is its segmentation. Quoted spans are atomic: no value ends inside
one. What the operator keeps of the values read is up to the caller.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import storable, written

EM_ROUNDS = 2
#: Member frequencies are kept in ``HASHES`` rows of so many hashed counters, whatever the size of the column: a member
#: reads as its smallest counter less what a counter holds on average, so one rarer than 1 in ``BUCKETS`` reads as unseen.
BUCKETS, HASHES = 1 << 20, 3
#: Weight of a member never seen, and how much rarer than their members single words are taken to be, to at most so many words.
UNSEEN, WORD, MOST_WORDS = 0.2, 50.0, 12
#: Pieces a member with a frequency of its own may have. Longer labels are read too, with the weight of unseen ones.
LONGEST = 8
# Words and signs that stand for nothing.
PLACEHOLDERS = frozenset(("", "nan", "none", "null", "n/a", "na", "no path found", "[]", "-"))
#: Segmentations remembered by a worker for lattices that hold no choice of labels.
REMEMBERED = 50_000

# Delimiter classes: line, tab, bar, semicolon, slash, comma, none (a blank or nothing), chain (an arrow or hop behind an id).
DELIMITERS = "nt|;/, >"
# Kinds of pieces: ends with an entity or a property, bare entity, bracketed triple, text without an id.
KINDS = "EPBTX"
#: What may follow in each state: go on within the label (L), to the next member (M), or end the value (V).
#: States: x label at the start, o property at the start, e head, p property, t complete, b bare id, g bracketed triple;
#: yp and yt labels of a property and a tail being read; E, Q, T, YH, YP, YT the like behind a complete triple.
MOVES: dict[str, dict[str, dict[str, str]]] = {
    "x": {"L": {"X": "x", "E": "e", "P": "o"}},
    "o": {}, "b": {}, "g": {},
    "e": {"M": {"P": "p", "X": "yp", "E": "e"}},
    "p": {"M": {"E": "t", "X": "yt"}},
    "yp": {"L": {"X": "yp", "P": "p"}},
    "yt": {"L": {"X": "yt", "E": "t"}},
    "t": {"M": {"E": "E", "P": "Q", "X": "YH"}},
    "E": {"M": {"P": "Q", "X": "YP"}},
    "Q": {"M": {"E": "t", "X": "YT"}},
    "YH": {"L": {"X": "YH", "E": "E", "P": "Q"}},
    "YP": {"L": {"X": "YP", "P": "Q"}},
    "YT": {"L": {"X": "YT", "E": "t"}},
}
FIRST = {"E": "e", "P": "o", "B": "b", "T": "g", "X": "x"}
LABELS = frozenset(("x", "yp", "yt", "YH", "YP", "YT"))
COMPLETE = frozenset(("t", "g", "E", "Q", "YH", "YP", "YT"))

_PRIOR_ENDS = {"x": 0.5, "o": 0.9, "e": 0.6, "p": 0.05, "t": 0.7, "E": 0.05, "Q": 0.05}
_PRIOR_DELIMITERS = {  # per state and move, in the order of DELIMITERS
    "V": (0.25, 0.1, 0.2, 0.2, 0.05, 0.15, 0.05, 0.0001),
    "L": (0.0005, 0.0005, 0.002, 0.002, 0.01, 0.05, 0.9, 0.0001),
    "M": (0.0005, 0.0005, 0.0005, 0.0005, 0.0005, 0.6, 0.001, 0.4),
    "tM": (1e-5, 1e-5, 1e-5, 1e-5, 1e-5, 1e-5, 1e-5, 1.0),
}
_PRIOR_KINDS = {
    "V": dict(zip(KINDS, (0.4, 0.05, 0.2, 0.15, 0.2))),
    "L": {"X": 0.5, "E": 0.4, "P": 0.4},
    "M": {"P": 0.9, "E": 0.9, "X": 0.1},
    "eM": {"P": 0.9, "X": 0.1, "E": 0.01},
}
#: Weight of the prior against counts, in moves of each state.
PRIOR_WEIGHT = 50.0

_TOKEN = re.compile(
    r"(\(([QP])\d+\)(?:(\s*(?:[-=]+>|→|--+\[?|[-=]+(?=\s*(?:[|;\r\n\t]|$))))|([ ]?[\r\n\t|;,/]))?"
    r"|([\r\n\t|;,/])|(<[^<>\r\n]*>)|(?<![\w(])Q\d+(?![\w)]))"
)
#: Text of nothing but labels with ids and single delimiters, the most frequent one, is read by this; longer labels are left
#: to the general pattern, so that no long text is tried from each of its positions to its end.
_PLAIN = re.compile(r"( {0,8}+)(?! )([^()<>|;,/\r\n\tQ]{0,400}+\(([QP])\d+\))(\s*(?:[-=]+>|→|--+\[?)|[ ]?[\r\n\t|;,/])?")
_BLANKS = " \t\r\n|;,/"
_TAIL = _BLANKS + "]}"
_MARK = re.compile(r"(?:[•*–-]\s+|\(\d+\)\s*|\d+[.)]\s+)")
_MARKS = "•*–-(0123456789"
_DELIMITER = re.compile(r"[,;|\r\n\t/]")
_LISTED = re.compile(r""""((?:[^"\\]|\\.)*)"(?=\s*(?:[,;|\]\r\n\t/]|$))|'((?:[^'\\]|\\.)*)'(?=\s*(?:[,;|\]\r\n\t/]|$))""", re.S)
_QUOTED = re.compile(r'"((?:[^"]|"")*)"(?=\s*(?:[,;|\r\n\t/]|$))', re.S)
_OPENS = re.compile(r"(?:^|[\[,;|\r\n\t/])\s*[\"']")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_RANK = {c: i for i, c in enumerate(" ,/;|tn")}
_CLASS = {"\r": "n", "\n": "n", "\t": "t", " \r": "n", " \n": "n", " \t": "t"}


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return storable(_ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _NAMED.get(m[1], m[1]), text))


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """Quoted spans (unescaped, True) and the text between them (False)."""
    bare = text.lstrip()
    listed = bare[:1] in "[{" and bare[:1] != ""
    if '"' not in text and "'" not in text or not _OPENS.search(text):
        yield (bare[1:] if listed else text), False
        return
    at = text.find(bare[0]) if listed else 0
    pattern = _LISTED if listed else _QUOTED
    while opened := _OPENS.search(text, at):
        quote = opened.end() - 1
        if text[quote] == "'" and not listed:
            nxt = _DELIMITER.search(text, quote)
            if not nxt:
                break
            yield text[at : nxt.start()], False
            at = nxt.start()
            continue
        m = pattern.match(text, quote)
        between = text[at:quote].lstrip(" [{")
        if between.strip(_BLANKS):
            yield between, False
        if not m:
            at = quote + 1
            break
        if listed:
            yield _unescape(m[1] if m[1] is not None else m[2]), True
        else:
            yield m[1].replace('""', '"'), True
        at = m.end()
    if at < len(text):
        yield text[at:], False


def pieces(text: str) -> tuple[str, str, list[int], list[int]]:
    """Kinds of the pieces of a stretch, the delimiter class before each one, and where they start and end.

    A piece ends with its id, or before a delimiter. An arrow with nothing
    behind it is followed by an empty piece, so that the break is seen.
    """
    text = text.rstrip(_TAIL)
    kinds, before, starts, ends = [], [], [], []
    between, at = " ", 0
    for lead, body, entity, tail in _PLAIN.findall(text) if text[:1] not in ("Q", "<") else ():
        kinds.append("E" if entity == "Q" else "P")
        before.append(between)
        at += len(lead)
        starts.append(at)
        at += len(body)
        ends.append(at)
        if tail:
            at += len(tail)
            c = tail[-1]
            between = c if c in ",|;/" else _CLASS.get(c) or ">"
        else:
            between = " "
    if at == len(text) and kinds and between != ">":
        return "".join(kinds), "".join(before), starts, ends
    kinds, before, starts, ends = [], [], [], []
    between, at = " ", 0  # the delimiter class so far, and where the text behind it starts
    parts = iter(_TOKEN.split(text))
    for chars, token, entity, chain, after, delimiter, angle in zip(*[parts] * 7):
        start = at + len(chars)
        at = start + len(token)
        body = chars.lstrip(_BLANKS)
        if entity:
            kinds.append("E" if entity == "Q" else "P")
            before.append(between)
            starts.append(start - len(body))
            if after:
                between = _CLASS.get(after) or after[-1]
                ends.append(at - len(after))
            elif chain:
                between = ">"
                ends.append(at - len(chain))
            else:
                between = " "
                ends.append(at)
            continue
        if body or (delimiter and between == ">"):
            kinds.append("X")
            before.append(between)
            starts.append(start - len(body))
            ends.append(starts[-1] + len(body.rstrip()))
            between = " "
        if delimiter:
            c = _CLASS.get(delimiter, delimiter)
            if _RANK[c] > _RANK[between]:
                between = c
        else:
            kinds.append("B" if not angle else "T" if angle.count(",") >= 2 else "X")
            before.append(between)
            starts.append(start)
            ends.append(at)
            between = " "
    body = text[at:].lstrip(_BLANKS)
    if body or between == ">":
        kinds.append("X")
        before.append(between)
        starts.append(len(text) - len(body) if body else at)
        ends.append(len(text) if body else at)
    return "".join(kinds), "".join(before), starts, ends


#: Every counted move: state, move, delimiter class and kind of the next piece; an end of the text has neither.
COUNTED = [(s, m, d, k) for s in MOVES for m in ("V", *MOVES[s]) for d in DELIMITERS for k in KINDS if m == "V" or k in MOVES[s][m]]
COUNTED += [(s, "V", "", "") for s in MOVES]
_COUNTED = {c: i for i, c in enumerate(COUNTED)}
#: What a value can be, as counted to see what a field holds: text, with an id, with a complete triple.
SORTS = ("any", "entity", "path")


def buckets(member: str) -> tuple[int, ...]:
    """A member's counter in each row of counters."""
    digest = xxhash.xxh3_64_intdigest(member)
    return tuple((digest >> (22 * h)) % BUCKETS for h in range(HASHES))


class Model:
    """Probabilities of moves, delimiters and kinds, and frequencies of members, from (expected) counts of one field."""

    def __init__(self, counts: np.ndarray | None = None, members: np.ndarray | None = None, sorts: np.ndarray | None = None):
        self.counts = np.zeros(len(COUNTED)) if counts is None else counts
        self.members, self.sorts = members, sorts
        self.total = float(members[0].sum()) if members is not None else 0.0
        self.lattices: dict = {}
        self.ways: dict = {}
        self.counts_of: dict = {}
        self.cut: dict = {}
        self.ends: dict[str, float] = {}
        self._arcs: dict = {}
        go, stop, shares = Counter(), Counter(), Counter()
        for (s, m, d, k), n in zip(COUNTED, self.counts.tolist()):
            (stop if m == "V" else go)[s] += n
            if d:
                own = "V" if m == "V" else s + m  # ends of values share their counts over all states
                shares[own] += n
                shares[own, "d", d] += n
                shares[own, "k", k] += n
        self._shares = shares
        for s, moves in MOVES.items():
            prior = _PRIOR_ENDS.get(s, 0.1 if s in LABELS else 1.0)
            self.ends[s] = (stop[s] + PRIOR_WEIGHT * prior) / (stop[s] + go[s] + PRIOR_WEIGHT) if moves else 1.0

    def __reduce__(self):
        if self.members is None:
            return Model, (self.counts, None, self.sorts)
        at = np.flatnonzero(self.members)
        if 2 * len(at) > self.members.size:
            return Model, (self.counts, self.members, self.sorts)
        return _sparse, (self.counts, at.astype(np.int32), self.members.ravel()[at], self.sorts)

    def arcs(self, state: str, delimiter: str, kind: str) -> list[tuple[str, str, float]]:
        """(move, next state, probability) of all moves from ``state`` over ``delimiter`` to a piece of ``kind``."""
        known = self._arcs.get((state, delimiter, kind))
        if known is None:
            end = self.ends[state]
            known = [("V", FIRST[kind], end * self._share(state, "V", delimiter, kind))]
            known += [(m, to[kind], (1 - end) * self._share(state, m, delimiter, kind)) for m, to in MOVES[state].items() if kind in to]
            self._arcs[state, delimiter, kind] = known
        return known

    def _share(self, state: str, move: str, delimiter: str, kind: str) -> float:
        own = "V" if move == "V" else state + move
        d0 = _PRIOR_DELIMITERS[own if own in _PRIOR_DELIMITERS else move][DELIMITERS.index(delimiter)]
        k0 = _PRIOR_KINDS[own if own in _PRIOR_KINDS else move].get(kind, 0.01)
        n, w = self._shares[own], PRIOR_WEIGHT
        return (self._shares[own, "d", delimiter] + w * d0) / (n + w) * (self._shares[own, "k", kind] + w * k0) / (n + w)

    def weight(self, member: str) -> float:
        """How much likelier a member's frequency is than its words by chance."""
        if not self.total:
            return UNSEEN
        n = min(self.members[h, b] for h, b in enumerate(buckets(member)))
        n = max(0.0, (n - 1.0) / self.total - 1 / BUCKETS)  # what occurs once is no evidence for itself
        return UNSEEN + n * WORD ** min(len(member.split()), MOST_WORDS)

    def holds(self) -> str:
        """What the field holds: paths or entities if at least half of its values are such, else anything."""
        if self.sorts is None or not self.sorts[0]:
            return "any"
        return "path" if 2 * self.sorts[2] >= self.sorts[0] else "entity" if 2 * self.sorts[1] >= self.sorts[0] else "any"


def _sparse(counts: np.ndarray, at: np.ndarray, n: np.ndarray, sorts: np.ndarray) -> Model:
    """A model that was sent with its counters above zero only."""
    members = np.zeros(HASHES * BUCKETS, dtype=np.float32)
    members[at] = n
    return Model(counts, members.reshape(HASHES, BUCKETS), sorts)


class Lattice:
    """All ways through pieces of given kinds and delimiters.

    ``columns[i]`` are the hypotheses (state, first piece of the label being
    read) behind piece i; ``arcs[i]`` lead there from ``columns[i - 1]`` as
    (from, to, probability, move counter, move, members finished by it). A
    member is a number in ``spans``, its (first, last) piece; their weights are
    given when a way is asked for, so equal shapes share a lattice.
    """

    def __init__(self, kinds: str, before: str, model: Model, atomic: bool):
        numbers: dict[tuple[int, int], int] = {}

        def member(first: int, last: int) -> tuple[tuple[int, ...], float]:
            return ((numbers.setdefault((first, last), len(numbers)),), 1.0) if first >= 0 else ((), UNSEEN)

        self.opening = member(0, 0)[0] if kinds[0] in "EP" else ()
        here = [(FIRST[kinds[0]], 0)]
        self.columns, self.arcs = [here], []
        for i in range(1, len(kinds)):
            kind, delimiter = kinds[i], before[i]
            onward: dict[tuple[str, int], int] = {}
            arcs = []
            for n, (state, first) in enumerate(here):
                for move, state_2, p in model.arcs(state, delimiter, kind):
                    spans: tuple = ()
                    start = i
                    if move == "L":
                        start = first if i - first < LONGEST else -1
                    elif move == "V" and state in LABELS:
                        spans, w = member(first, i - 1)
                        p *= w
                    if kind in "EP":
                        own, w = member(start, i)
                        spans, p = spans + own, p * w
                    to = onward.setdefault((state_2, start if state_2 in LABELS else i), len(onward))
                    arcs.append((n, to, p, _COUNTED[state, move, delimiter, kind], move, spans))
            if atomic and any(a[4] != "V" for a in arcs):  # nothing ends inside, as long as anything else is possible
                arcs = [a for a in arcs if a[4] != "V"]
            self.arcs.append(arcs)
            here = list(onward)
            self.columns.append(here)
        ends = [member(first, len(kinds) - 1) if state in LABELS else ((), 1.0) for state, first in here]
        self.ends = [(model.ends[state] * w, spans, _COUNTED[state, "V", "", ""]) for (state, _), (spans, w) in zip(here, ends)]
        self.spans = list(numbers)
        #: Spans that only some ways hold: the weights of all others change no choice.
        self.open = sorted({n for arcs in self.arcs if len({a[5] for a in arcs}) > 1 for a in arcs for n in a[5]} | {n for _, s, _ in self.ends for n in s})

    def _weighed(self, weights: list[float]) -> tuple[list[list[tuple]], list[float]]:
        steps = []
        for arcs in self.arcs:
            step = []
            for arc in arcs:
                p = arc[2]
                for n in arc[5]:
                    p *= weights[n]
                step.append((arc[0], arc[1], p, arc))
            steps.append(step)
        ends = []
        for p, spans, _ in self.ends:
            for n in spans:
                p *= weights[n]
            ends.append(p)
        return steps, ends

    def best(self, weights: list[float]) -> list[tuple[str, str]]:
        """(state, move into it) of every piece on the most probable way."""
        steps, ends = self._weighed(weights)
        score, back = [1.0], []
        for step, column in zip(steps, self.columns[1:]):
            top, origin = [0.0] * len(column), [None] * len(column)
            for source, to, p, arc in step:
                p *= score[source]
                if p > top[to]:
                    top[to], origin[to] = p, arc
            scale = max(top) or 1.0
            score = [p / scale for p in top]
            back.append(origin)
        at = max(range(len(score)), key=lambda n: score[n] * ends[n])
        way = []
        for column, origin in zip(self.columns[:0:-1], back[::-1]):
            arc = origin[at]
            way.append((column[at][0], arc[4]))
            at = arc[0]
        return [(self.columns[0][0][0], "V"), *way[::-1]]

    def expected(self, weights: list[float]) -> tuple[dict[int, float], dict[int, float]]:
        """Expected counts of moves and of members over all ways, each by its probability (forward and backward)."""
        steps, ends = self._weighed(weights)
        forward = [[1.0]]
        for step, column in zip(steps, self.columns[1:]):
            sums, now = [0.0] * len(column), forward[-1]
            for source, to, p, _ in step:
                sums[to] += now[source] * p
            scale = sum(sums) or 1.0
            forward.append([p / scale for p in sums])
        moves: dict[int, float] = {}
        members: dict[int, float] = dict.fromkeys(self.opening, 1.0)
        whole = sum(f * e for f, e in zip(forward[-1], ends)) or 1.0
        later = [e / whole for e in ends]
        for f, e, (_, spans, counter) in zip(forward[-1], later, self.ends):
            moves[counter] = moves.get(counter, 0.0) + f * e
            for n in spans:
                members[n] = members.get(n, 0.0) + f * e
        for i in range(len(steps) - 1, -1, -1):
            now = forward[i]
            mass = [0.0] * len(now)
            through = []
            total = 0.0
            for source, to, p, arc in steps[i]:
                p *= later[to]
                mass[source] += p
                p *= now[source]
                total += p
                through.append((p, arc))
            total = total or 1.0
            for g, arc in through:
                g /= total
                moves[arc[3]] = moves.get(arc[3], 0.0) + g
                for n in arc[5]:
                    members[n] = members.get(n, 0.0) + g
            scale = max(mass) or 1.0
            later = [m / scale for m in mass]
        return moves, members


def _marks(text: str, starts: list[int], ends: list[int]) -> list[int]:
    """Where each piece starts behind its list mark."""
    out = starts
    for i, s in enumerate(starts):
        if text[s : s + 1] in _MARKS and (m := _MARK.match(text, s, ends[i])):
            if out is starts:
                out = starts.copy()
            out[i] = m.end()
    return out


def _lattice(kinds: str, before: str, model: Model, atomic: bool) -> Lattice:
    known = model.lattices.get((kinds, before, atomic))
    if known is None:
        if len(model.lattices) >= REMEMBERED:
            model.lattices.clear()
        known = model.lattices[kinds, before, atomic] = Lattice(kinds, before, model, atomic)
    return known


def _solve(text: str, read: tuple, marks: list[int], model: Model, atomic: bool, expect: bool):
    """The most probable way through the pieces of a stretch, or the expected counts of moves and of (first, last) members.

    Where no label has several pieces no choice depends on a member, so the
    result is that of the kinds and delimiters alone and is remembered; so it
    is as long as no frequency has been learned.
    """
    kinds, before, _, ends = read
    shared = not model.total or "X" not in kinds or kinds == "X"
    memory = model.counts_of if expect else model.ways
    known = memory.get((kinds, before, atomic)) if shared else None
    if known is None:
        lattice = _lattice(kinds, before, model, atomic)
        if shared:
            weights = [UNSEEN] * len(lattice.spans)
        else:
            weights = [UNSEEN] * len(lattice.spans)
            for n in lattice.open:
                f, e = lattice.spans[n]
                weights[n] = model.weight(text[marks[f] : ends[e]])
        if expect:
            moves, members = lattice.expected(weights)
            known = moves, [(*lattice.spans[n], p) for n, p in members.items()]
        else:
            known = lattice.best(weights)
        if shared:
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[kinds, before, atomic] = known
    return known


def _values(way: list[tuple[str, str]], kinds: str) -> list[tuple[int, int, int, str]]:
    """(first piece, last piece, last piece of the first member, sort) of each value on a way."""
    out = []
    first = last_id = 0
    sort = "any"
    for i, (state, move) in enumerate(way):
        if move == "V":
            first, sort = i, "any"
        if kinds[i] in "EB":
            last_id, sort = i, sort if sort == "path" else "entity"
        if state in COMPLETE:
            sort = "path"
        if i + 1 == len(way) or way[i + 1][1] == "V":
            last = last_id if sort == "entity" else i
            head = next((j for j in range(first, last + 1) if kinds[j] != "X"), last)
            out.append((first, last, head, sort))
    return out


def read_values(text: str | None, model: Model, sorts: tuple[str, ...] = SORTS) -> list[tuple[str, str, str]]:
    """(value, its first member, sort) of every value of a cell in order, of those ``sorts``."""
    out: list[tuple[str, str, str]] = []
    for stretch, quoted in stretches(text) if text else ():
        read = pieces(stretch)
        kinds, before, starts, ends = read
        if not kinds:
            continue
        marks = _marks(stretch, starts, ends)
        known = model.cut.get((kinds, before, quoted))
        if known is None:
            known = _values(_solve(stretch, read, marks, model, quoted, False), kinds)
            if "X" not in kinds:
                if len(model.cut) >= REMEMBERED:
                    model.cut.clear()
                model.cut[kinds, before, quoted] = known
        if quoted:
            whole = stretch.strip()
            sort = max((v[3] for v in known), key=SORTS.index)
            if sort in sorts:
                out.append((whole, whole, sort))
        else:
            out += [(stretch[marks[f] : ends[e]], stretch[marks[f] : ends[h]], sort) for f, e, h, sort in known if sort in sorts]
    return [v for v in out if v[2] != "any" or v[0].strip().lower() not in PLACEHOLDERS]


def split_cell(text: str | None, paths: bool, model: Model | None = None) -> list[list[tuple[str, str]]]:
    """The kept values of one cell with their first members: paths, or else entities, under ``model`` or before any learning."""
    sorts = SORTS[2:] if paths else SORTS[1:]
    return [[(value, head)] for value, head, _ in read_values(text, model or Model(), sorts)]


#: Counters of a field: moves and sorts first, members behind them.
_HEAD = len(COUNTED) + len(SORTS)
_WIDTH = _HEAD + HASHES * BUCKETS


def _sorts_in(kinds: str) -> tuple[int, bool, bool]:
    return 1, "E" in kinds or "B" in kinds, "T" in kinds or "EPE" in kinds


#: A survey's rows are sums of member counters, shapes without a choice of labels with their number, or contested stretches.
_SURVEY = "field int, counter int, n double, kinds string, before string, atomic boolean, text string"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rounds of learning need of a partition's cells; the columns are the fields."""

    def rows(field: int, count: int, **columns) -> pa.RecordBatch:
        kinds = {"counter": pa.int32(), "n": pa.float64(), "kinds": pa.string(), "before": pa.string(), "atomic": pa.bool_(), "text": pa.string()}
        arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(count, field), pa.int32()), *arrays], names=["field", *kinds])

    members: list[np.ndarray] = []
    shapes: list[Counter] = []

    def shape_rows() -> Iterator[pa.RecordBatch]:
        for k, found in enumerate(shapes):
            if found:
                kinds, before, atomic = zip(*found)
                yield rows(k, len(found), n=list(map(float, found.values())), kinds=kinds, before=before, atomic=atomic)
                found.clear()

    for batch in batches:
        for k, column in enumerate(batch.columns):
            if k == len(members):
                members.append(np.zeros((HASHES, BUCKETS)))
                shapes.append(Counter())
            listed: list[str] = []
            texts, atomic = [], []
            found = shapes[k]
            for text in column.to_pylist():
                for stretch, quoted in stretches(text) if text else ():
                    kinds, before, starts, ends = pieces(stretch)
                    if "X" in kinds and kinds != "X":
                        texts.append(stretch)
                        atomic.append(quoted)
                    elif kinds:
                        found[kinds, before, quoted] += 1
                        listed += [stretch[m:e] for m, e in zip(_marks(stretch, starts, ends), ends)]
            _add(members[k], Counter(listed))
            if texts:
                yield rows(k, len(texts), atomic=atomic, text=texts)
        if sum(map(len, shapes)) > REMEMBERED:
            yield from shape_rows()
    yield from shape_rows()
    for k, own in enumerate(members):
        at = np.flatnonzero(own)
        yield rows(k, len(at), counter=at, n=own.ravel()[at])


def _add(members: np.ndarray, named: Mapping[str, float]) -> None:
    """Add the counts of ``named`` to their counters."""
    if named:
        n = np.fromiter(named.values(), dtype=np.float64, count=len(named))
        at = np.array([buckets(m) for m in named], dtype=np.int64)
        for h in range(HASHES):
            np.add.at(members[h], at[:, h], n)


def _count(models):
    """A mapInArrow function: expected counts of surveyed shapes and stretches under the current models, as (field, counter, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(_WIDTH) for _ in models.value]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("field", "n", "kinds", "before", "atomic", "text")]
            named: list[dict[str, float]] = [{} for _ in counts]
            for k, n, kinds, before, atomic, text in zip(*columns):
                flat, model = counts[k], models.value[k]
                if text is None:
                    moves = _solve("", (kinds, before, [], []), [], model, atomic, True)[0]
                else:
                    n, own = 1.0, named[k]
                    read = pieces(text)
                    kinds, _, starts, ends = read
                    marks = _marks(text, starts, ends)
                    moves, members = _solve(text, read, marks, model, atomic, True)
                    for f, e, p in members:
                        name = text[marks[f] : ends[e]]
                        own[name] = own.get(name, 0.0) + p
                for i, p in moves.items():
                    flat[i] += n * p
                flat[len(COUNTED) : _HEAD] += np.multiply(n, _sorts_in(kinds))
            for flat, own in zip(counts, named):
                _add(flat[_HEAD:].reshape(HASHES, BUCKETS), own)
        for k, flat in enumerate(counts):
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(flat[at])], names=["field", "counter", "n"])

    return run


def learn(cells: DataFrame, fields: list[str], rounds: int = EM_ROUNDS) -> dict[str, Model]:
    """A model of each field by expectation-maximisation over all of its cells.

    One scan surveys the cells; the rounds read its shapes, with their
    numbers, and its contested stretches. A partition sends at most its sums of
    the ``HASHES * BUCKETS`` member counters and the moves of a field, and so
    much reaches the driver and is broadcast, however large the column.
    """
    if not fields:
        return {}
    sc = cells.sparkSession.sparkContext
    survey = written(cells.select(*fields).mapInArrow(_survey, _SURVEY))

    def sums(counters: DataFrame) -> np.ndarray:
        table = counters.groupBy("field", "counter").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((len(fields), _WIDTH))
        out[table["field"].to_numpy(), table["counter"].to_numpy()] = table["n"].to_numpy()
        return out

    certain = sums(survey.filter("counter is not null").select("field", F.col("counter") + _HEAD, "n").toDF("field", "counter", "n"))
    shape = ["field", "kinds", "before", "atomic"]
    shapes = survey.filter("kinds is not null").groupBy(*shape).agg(F.sum("n").alias("n"))
    rest = shapes.unionByName(survey.filter("text is not null").select("field", "atomic", "text"), allowMissingColumns=True)
    models = [Model() for _ in fields]
    for _ in range(rounds):
        shared = sc.broadcast(models)
        flat = certain + sums(rest.mapInArrow(_count(shared), "field int, counter int, n double"))
        shared.destroy()
        models = [
            Model(own[: len(COUNTED)], own[_HEAD:].reshape(HASHES, BUCKETS).astype(np.float32), own[len(COUNTED) : _HEAD]) for own in flat
        ]
    return dict(zip(fields, models))


def _split(models, keep: dict[str, str]):
    """A mapInArrow function: the kept values of every cell on its best way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, field_no, pos, items = [], [], [], []
            for k, (field, model) in enumerate(models.value.items()):
                sorts = SORTS[SORTS.index(keep[field]) :]
                for i, text in enumerate(batch.column(batch.schema.get_field_index(field)).to_pylist()):
                    kept = [v[0] for v in read_values(text, model, sorts)] if text else ()
                    row += [i] * len(kept)
                    field_no += [k] * len(kept)
                    pos += range(1, len(kept) + 1)
                    items += kept
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(list(models.value), pa.string()).take(pa.array(field_no, pa.int64())),
                    batch.column(1).take(at),
                    pa.array(pos, pa.int32()),
                    pa.array(items, pa.string()),
                ],
                names=["pair_id", "field", "variant", "pos", "item"],
            )

    return run


def split_packed(cells: DataFrame, keep: Mapping[str, str] | None = None, rounds: int = EM_ROUNDS) -> DataFrame:
    """``(pair_id, field, variant, pos, item)``: one row per value of every packed field of ``cells``.

    ``cells`` has ``pair_id``, ``variant`` and any number of string columns.
    ``keep`` says what a field's values must be to be kept: ``any`` text,
    an ``entity`` (with an id) or a ``path`` (with a complete triple); a field
    it does not name keeps what most of its values are. Null, empty and
    placeholder cells give no rows, other pieces are dropped, ``pos`` counts
    the kept ones. Repeated cells come out once.
    """
    fields = [c for c in cells.columns if c not in ("pair_id", "variant")]
    models = learn(cells, fields, rounds)
    sorts = {f: (keep or {}).get(f) or models[f].holds() for f in fields}
    for f, sort in sorts.items():
        if sort not in SORTS:
            raise ValueError(f"unknown sort {sort!r} of {f}, expected one of {SORTS}")
    shared = cells.sparkSession.sparkContext.broadcast(models)
    kind = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in ("pair_id", "variant"))
    kind = kind.replace(", variant", ", field string, variant") + ", pos int, item string"
    return cells.select("pair_id", "variant", *fields).mapInArrow(_split(shared, sorts), kind).distinct()

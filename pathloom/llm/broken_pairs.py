"""Question-answer pairs whose answer does not properly answer.

A pushdown parser reads the answer once: fences, brackets, quotations, list
marks and the path grammar (entity, property, entity, chained by arrows) push
and pop, so the state it ends in says whether the text broke off inside a path
and which labels were read. Beside it stand placeholder signs, greedy string
tiling against the question, refusal grammars and a small language model of
character n-grams with script checks. The pairs themselves never meet each
other: the operator is one pass over the table.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")
#: The rest: answers without a path that are none of these.
NO_PATH = "no_path"
#: Labelled rows for the language model: at most so many of each language, chosen by a hash of the text.
EXAMPLES_PER_LANGUAGE = 400
#: Least length of a tile in words, and the share of the answer that tiles must cover to make it a copy.
TILE_WORDS, COPIED_SHARE = 3, 0.7
#: Most words of an answer that broke off within its first label, before any id.
LABEL_WORDS = 8
#: How much likelier (natural log) another language must be than the question's.
LANGUAGE_MARGIN = 3.0

# Signs and words that stand for nothing.
PLACEHOLDERS = {"", "nan", "null", "none", "n/a", "na", "nil", "undefined", "no path found", "empty"}

# Refusal grammars, as sentence patterns by language. They apply to text without a complete path.
_EN_SELF = r"(?:i|we|my guidelines|the system|as an? (?:ai |language )?(?:assistant|model))"
_EN_NOT = r"(?:can\s?not|can'?t|could ?n[o']t|won'?t|will not|do(?:es)? not|don'?t|may not|must not|am not|are not|is not|isn'?t|unable|refuse|decline|must decline)"
_EN_DO = r"(?:help|assist|answer|provide|comment|discuss|produce|offer|give|guess|look|able|allowed|permitted|access|determine|do|share|respond|say|tell|fulfil?l(?:ed)?)"
REFUSALS = [
    rf"\b{_EN_SELF}\b.{{0,60}}\b{_EN_NOT}\b.{{0,80}}\b{_EN_DO}\b",
    rf"\b{_EN_SELF}\b.{{0,40}}\b(?:unable|decline|refuse|not able|not allowed|not permitted)\b",
    r"\b(?:sorry|apologies|apologise|apologize|unfortunately|regret)\b",
    r"\b(?:no (?:answer|path|paths|reply|response) (?:will|can|may) be)\b",
    r"\b(?:impossible|inappropriate|not possible|not appropriate)\b.{0,40}\b(?:for me|to)\b",
    r"\b(?:cannot|can ?not|can't|could not|will not|won't) be (?:fulfilled|answered|completed|processed|provided|given|done)\b",
    r"\b(?:my|the) (?:guidelines|policy|policies|rules) (?:keep|prevent|forbid|stop|do not|don't)\b",
    r"\b(?:outside|beyond) (?:of )?(?:what i may|my (?:scope|remit|abilities|task))\b",
    r"\b(?:tut mir (?:sehr )?leid|bedaure|bedauerlicherweise|leider|entschuldigung)\b",
    r"\b(?:darf|kann|werde|möchte|muss) (?:ich|wir)\b.{0,80}\b(?:nicht|kein\w*|ablehnen|verweigern)\b",
    r"\b(?:ich|wir) (?:darf|kann|können|dürfen|werde|möchte|muss|habe)\b.{0,80}\b(?:nicht|kein\w*|ablehnen|verweigern)\b",
    r"\b(?:außerhalb meiner|kein\w* zugriff|keine (?:auskunft|antwort)|nicht (?:möglich|erlaubt|gestattet|beantworten))\b",
    r"\b(?:lo siento|lamento|lamentablemente|perdón|disculpe|desgraciadamente)\b",
    r"\b(?:no (?:puedo|podemos|debo|estoy (?:autorizad|en condiciones)\w*|me es posible|voy a|tengo (?:acceso|permiso)))\b",
    r"\b(?:sin acceso al?|me resulta imposible|debo (?:negarme|rechazar|declinar)|no se puede (?:responder|contestar)|ninguna respuesta)\b",
    r"\b(?:désolée?|je regrette|malheureusement|pardon|excusez)\b",
    r"\bje (?:ne|n')\s?.{0,40}\b(?:pas|aucun\w*|rien|point)\b",
    r"\b(?:je dois (?:refuser|décliner)|il m'est impossible|n'ayant pas accès|aucune réponse|je refuse|hors de mon)\b",
    r"\b(?:przykro mi|przepraszam|niestety|nie mogę|nie jestem w stanie|muszę odmówić)\b",
    r"\b(?:извините|к сожалению|не могу|не имею|вынужден\w* отказать)",
    r"(?:申し訳|お答え(?:でき|しかね)|回答(?:でき|しかね)|すみません)",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.I | re.S)

_WORD = re.compile(r"[^\W_]+(?:[-_'’][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_NAME = re.compile(r"\S*_\S*")
_SENTENCE = re.compile(r"[.!?:;,。、]")
_IDS = re.compile(r"\([QP]\d*\)?|\b[QP]\d+\b")
_TOKEN = re.compile(
    r"(?P<fence>```\w*)|(?P<member>\((?P<kind>[QP])\d+\))|(?P<arrow>-+>|=+>|→)|(?P<open>[\[{<])|(?P<close>[\]}>])"
    r"|(?P<quote>\\?[\"'])|(?P<hard>[\r\n\t]+|[|;]+)|(?P<comma>,)|(?P<text>[^\[\]{}<>\"',;|\r\n\t()=→`\\-]+|[(=`\\)-])"
)


@dataclass
class Parsed:
    """What the parser found: complete triples, labels of all members, and whether it ended inside a path."""

    complete: int = 0
    cut: bool = False
    text_after: str = ""
    labels: tuple[str, ...] = ()


def parse_answer(text: str) -> Parsed:
    """Run the pushdown parser over an answer.

    The stack holds what is open (fence, bracket, quotation, path). A path is
    pushed by its first word and moves from member to member; a delimiter, a
    closing quotation or bracket of its own level, or a line break pops it.
    """
    stack: list[str] = []
    done, label, labels = 0, [], []
    state = 0  # members read of the current triple; 3 when it is complete
    chained = False  # an arrow has been read behind a complete triple
    angle: list[str] | None = None
    after: list[str] = []  # text since the last complete triple

    def in_path() -> bool:
        return bool(stack) and stack[-1] == "path"

    def pop() -> None:
        nonlocal state, chained, label
        if in_path():
            stack.pop()
        state, chained, label = 0, False, []

    n = len(text)
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup != "kind" else "member"
        piece = m[0]
        if angle is not None:
            if kind == "close" and piece == ">":
                if sum(a == "," for a in angle) >= 2:
                    done += 1
                    labels += " ".join(a for a in angle if a != ",").split(",")
                    after = []
                angle = None
                pop()
            elif kind in ("hard",) and "\n" in piece:
                angle = None
                pop()
            else:
                angle.append(piece)
            continue
        if kind == "fence":
            pop()
            if "fence" in stack:
                while stack.pop() != "fence":
                    pass
            else:
                stack.append("fence")
        elif kind == "open":
            if piece == "<":
                angle = []
                if not in_path():
                    stack.append("path")
                state = 0
            elif piece == "[" and in_path() and not label and text[m.start() - 1 : m.start()] == "-":
                stack[-1] = "path"  # the label of a hop, as in --[label]
            elif not in_path():
                stack.append(piece)
        elif kind == "close":
            pair = {"]": "[", "}": "{"}.get(piece)
            if pair and pair in stack and not (in_path() and text[m.start() + 1 : m.start() + 3] == " ("):
                pop()
                if pair in stack:
                    while stack.pop() != pair:
                        pass
        elif kind == "quote":
            q = piece[-1]
            if len(piece) == 1 and q in stack and _ends(text, m.end(), n):
                pop()
                while stack and stack[-1] != q:
                    stack.pop()
                if stack:
                    stack.pop()
            elif len(piece) == 1 and not in_path() and (q == '"' or "[" in stack):
                stack.append(q)
            else:
                label.append(piece)
                after.append(piece)
        elif kind == "hard":
            inside = any(s in stack for s in ('"', "'"))
            strong = "\n" in piece or "\r" in piece or "\t" in piece
            if in_path() and not strong and state in (1, 2) and "".join(label).strip():
                label.append(piece)  # a label of an open triple may contain it
            elif not inside or (strong and '"' not in stack):
                pop()
                if strong or done:
                    after = []
            else:
                label.append(piece)
        elif kind == "arrow":
            if state == 3:
                chained, state, label = True, 0, []
            elif state == 2:
                label = []
            after.append(piece)
        elif kind == "member":
            name = "".join(label).strip(" -[],")
            if not in_path():
                stack.append("path")
            if name:
                labels.append(name)
            want = "P" if state in (1, 3) else "Q"
            if m["kind"] == want or (state == 3 and m["kind"] == "P"):
                state = {0: 1, 1: 2, 2: 3, 3: 2}[state]
            else:
                state = 1 if m["kind"] == "Q" else 0
            if state == 3:
                done, chained, after = done + 1, False, []
            else:
                after.append(piece)
            label = []
        elif kind == "comma":
            if label:
                label.append(piece)
        elif in_path():
            label.append(piece)
            after.append(piece)
        elif not piece.isspace():
            stack.append("path")
            state = 0
            label.append(piece)
            after.append(piece)
    rest = "".join(label).strip(" -,[]")
    open_path = in_path() or angle is not None
    cut = open_path and (angle is not None or state in (1, 2) or chained or bool(rest) or (state == 3 and bool("".join(after).strip(" .,"))))
    return Parsed(done, cut, rest, tuple(labels))


def _ends(text: str, at: int, n: int) -> bool:
    """Whether a quotation may end before ``at``: only delimiters, closing signs or the end follow."""
    while at < n and text[at] in "  ":
        at += 1
    return at >= n or text[at] in ",;|]}\r\n\t/`"


def is_placeholder(answer: str | None) -> bool:
    """Nothing, or only signs, quotes and brackets around a word that stands for nothing."""
    if answer is None:
        return True
    core = answer.strip().strip("[](){}<>\"'`.,;:|-–—_*#?!/\\ \t\r\n ​﻿").strip().lower()
    return core in PLACEHOLDERS


class SuffixAutomaton:
    """All runs of words of a sequence; built and walked in time linear in its length."""

    def __init__(self, words: list[str]):
        self.onward: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            new = len(self.link)
            self.onward.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            at = last
            while at >= 0 and w not in self.onward[at]:
                self.onward[at][w] = new
                at = self.link[at]
            if at >= 0:
                to = self.onward[at][w]
                if self.length[to] == self.length[at] + 1:
                    self.link[new] = to
                else:
                    twin = len(self.link)
                    self.onward.append(self.onward[to].copy())
                    self.link.append(self.link[to])
                    self.length.append(self.length[at] + 1)
                    while at >= 0 and self.onward[at].get(w) == to:
                        self.onward[at][w] = twin
                        at = self.link[at]
                    self.link[to] = self.link[new] = twin
            last = new

    def matches(self, words: list[str], least: int) -> list[tuple[int, int]]:
        """(length, start) of every run of ``words`` of at least ``least`` words that occurs here and cannot go on."""
        found = []
        state = length = 0
        for i, w in enumerate(words):
            before = length
            while state > 0 and w not in self.onward[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.onward[state]:
                state, length = self.onward[state][w], length + 1
            if length <= before and before >= least:
                found.append((before, i - before))
        if length >= least:
            found.append((length, len(words) - length))
        return found


def tiled_share(answer: list[str], question: list[str], least: int = TILE_WORDS) -> float:
    """Share of ``answer`` that greedy string tiling covers with tiles of ``question``.

    The longest common runs are laid first; a word of the answer lies in one
    tile at most, runs that overlap a laid tile shrink to what is free. The
    question may be used again, so answers repeated in full reach 1 too. A run
    shrinks at most once at each end, so the time is that of sorting the runs
    of a suffix automaton, also where both sides are long and repetitive.
    """
    if not answer or not question:
        return 0.0
    queue = [(-n, start) for n, start in SuffixAutomaton(question).matches(answer, least)]
    heapq.heapify(queue)
    free = bytearray(b"\1") * len(answer)
    covered = 0
    while queue:
        n, start = heapq.heappop(queue)
        first, end = start, start - n
        if not free[first]:
            first = free.find(1, first, end)
            if first < 0:
                continue
        if not free[end - 1]:
            end = free.rfind(1, first, end) + 1
        if end - first == -n:
            free[first:end] = bytes(end - first)
            covered += end - first
        elif end - first >= least:
            heapq.heappush(queue, (first - end, first))
    return covered / len(answer)


class LanguageModel:
    """Naive Bayes over character n-grams of words; scripts decide where a language has its own."""

    ORDERS = (1, 2, 3, 4)

    def __init__(self, examples: list[tuple[str, str]]):
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, language in examples:
            for w in self.words(text):
                counts[language].update(self.grams(w))
        self.languages = sorted(counts)
        vocabulary = set().union(*counts.values()) if counts else set()
        self.floor, self.table = {}, {}
        for language in self.languages:
            total = sum(counts[language].values()) + 0.1 * (len(vocabulary) + 1)
            self.floor[language] = math.log(0.1 / total)
            self.table[language] = {g: math.log((n + 0.1) / total) for g, n in counts[language].items()}
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        plain = unicodedata.normalize("NFC", _IDS.sub(" ", _NAME.sub(" ", text)))
        return [w.lower() for w in _LETTERS.findall(plain)]

    @classmethod
    def grams(cls, word: str) -> list[str]:
        padded = f" {word} "
        return [padded[i : i + n] for n in cls.ORDERS for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]

    def scores(self, text: str) -> dict[str, float]:
        """Log likelihood of the text's words by language; a word counts once however often it occurs."""
        rows = [np.zeros(len(self.languages))]
        for w in dict.fromkeys(self.words(text)):
            score = self.known.get(w)
            if score is None:
                grams = self.grams(w)
                score = np.array([sum(self.table[x].get(g, self.floor[x]) for g in grams) for x in self.languages]) / len(self.ORDERS)
                if len(self.known) < 200_000:
                    self.known[w] = score
            rows.append(score)
        return dict(zip(self.languages, np.sum(rows, axis=0).tolist()))

    def differs(self, answer: str, question: str, margin: float = LANGUAGE_MARGIN) -> bool:
        """Whether the answer is in another language than the question, by more than ``margin``."""
        if len(self.languages) < 2:
            return script(answer) != script(question) and bool(script(answer))
        if not answer.isascii() and script(answer) != script(question):
            return True
        own, theirs = self.scores(answer), self.scores(question)
        if not any(own.values()) or not any(theirs.values()):
            return False
        asked = max(theirs, key=theirs.get)
        said = max(own, key=own.get)
        return said != asked and own[said] - own[asked] > margin


def script(text: str) -> str:
    """The script most letters of a text belong to, by the first word of their Unicode names."""
    found = Counter()
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0]
            found["CJK" if name in ("CJK", "HIRAGANA", "KATAKANA") else name] += 1
    return found.most_common(1)[0][0] if found else ""


def classify(question: str | None, answer: str | None, model: LanguageModel) -> str | None:
    """The defect of one pair, or None where the answer is sound.

    Null, blank and placeholder answers are ``empty``. A null question only
    leaves the checks that need none. An answer without a path is a refusal
    only where a grammar matches it, and truncated only where a path has begun:
    an id was read, or all of it can be the start of a label. Any other answer
    without a path is ``NO_PATH``.
    """
    if is_placeholder(answer):
        return "empty"
    asked = question or ""
    answer = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), answer) if "\\u" in answer else answer
    parsed = parse_answer(answer)
    if parsed.complete == 0:
        words = [w.lower() for w in _WORD.findall(answer)]
        if tiled_share(words, [w.lower() for w in _WORD.findall(asked)]) >= COPIED_SHARE:
            return "copied_question"
        if _IDS.search(answer) is None and _REFUSAL.search(answer.replace("’", "'")):
            return "refusal"
        if asked and model.differs(answer, asked):
            return "other_language"
        if _IDS.search(answer) is not None:
            return "truncated"
        return "truncated" if parsed.cut and len(words) <= LABEL_WORDS and not _SENTENCE.search(answer) else NO_PATH
    if parsed.cut and not parsed.text_after.endswith((".", "!", "?", "。")):
        return "truncated"
    if asked and model.differs(" ".join(parsed.labels), asked):
        return "other_language"
    return None


def language_examples(labelled: DataFrame, text_col: str, lang_col: str, per_language: int = EXAMPLES_PER_LANGUAGE) -> list[tuple[str, str]]:
    """A bounded sample of whole labelled texts, the same at every run: the smallest text hashes of each language."""
    code = F.lower(F.regexp_extract(F.col(lang_col), r"^\s*([A-Za-z]{2})(?:[-_].*)?\s*$", 1))
    order = Window.partitionBy("code").orderBy("h", "text")
    rows = (
        labelled.select(F.col(text_col).alias("text"), code.alias("code"))
        .filter("code <> '' and text is not null")
        .withColumn("h", F.xxhash64("text"))
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= per_language)
        .select("text", "code")
    )
    return [(r["text"], r["code"]) for r in rows.collect()]


def broken_pairs(
    pairs: DataFrame,
    examples: list[tuple[str, str]],
    id_col: str = "pair_id",
    question_col: str = "question",
    answer_col: str = "wikidata_paths_llm",
) -> DataFrame:
    """Distinct ``(id_col, defect)`` of the pairs with a defective answer.

    ``examples`` are (text, language) rows for the language model; with fewer
    than two languages only scripts are compared. Repeated rows come out once;
    a pair with several different answers has a row for each defect among
    them. Extra columns are pruned. See ``classify`` for nulls and empty texts.
    """
    model = pairs.sparkSession.sparkContext.broadcast(LanguageModel(examples))
    kind = pairs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (q, a) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                defect = classify(q, a, model.value)
                if defect:
                    at.append(i)
                    found.append(defect)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["key", "defect"]
            )

    narrow = pairs.select(F.col(id_col).alias("key"), F.col(question_col), F.col(answer_col))
    return narrow.mapInArrow(run, f"key {kind}, defect string").distinct().withColumnRenamed("key", id_col)

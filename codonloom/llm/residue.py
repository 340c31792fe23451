"""Template residue, filler, error-page text and script notices in documents."""

from __future__ import annotations

import html
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import residue_lexicon as L

CODE = re.compile(r"`[^`\n]*`|```.*?```", re.S)
TAG = re.compile(r"</?(?:html|head|body|title|h[1-6]|p|br|hr|div|span|ul|ol|li|b|i|em|strong|a|table|tr|td|th|noscript|script|meta|center|pre|code|sup|sub)\b[^<>\n]*>", re.I)
ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\[nt\"/]")
BREAK = re.compile(r"[\n\r\x0b\x0c  ]+|(?<=[.!?…])[\s ]+|(?<=[a-zß-ÿ][.!?])(?=[A-ZÀ-Þ])|[•·]|\|(?![^{}\n]*\}\})|\s-\s|\s--\s|\s—\s")
WORD = re.compile(r"[^\W_]+", re.U)
NUMBER = re.compile(r"[0-9a-f]*[0-9][0-9a-f]*|\d+")
DIGIT = re.compile(r"\d")
MARK = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
DELIMITER = re.compile(r"[{\[<%$_«@#]")
SPAN = re.compile("\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]")
QUOTED = re.compile("[\"“”„‟»«‘’']")

NAME = r"[^\W\d_][\w.\-]*(?: [\w\-]+){0,3}"
FILTER = r"(?: ?\| ?\w[\w ,.:'\"()\-]{0,60}?)*"
#: Delimiters that hardly serve anything but templates.
STRONG = re.compile(
    rf"\{{\{{\{{? ?[#/&>]?{NAME}{FILTER} ?\}}?\}}\}}|\$\{{ ?{NAME} ?\}}|#\{{ ?{NAME} ?\}}|<%[=\-]? ?{NAME} ?-?%>|@@{NAME}@@|\{{% ?[^%\n]{{1,80}} ?%\}}|<\?=? ?[^?\n]{{1,60}} ?\?>"
)
#: Delimiters with other uses: only around a known field name or a name in capitals or snake case.
WEAK = re.compile(rf"\[\[ ?({NAME}) ?\]\]|\[({NAME})\]|<({NAME})>|\{{({NAME})\}}|%({NAME})%|\$({NAME})\$|__([^\W\d_][^\W_ ]*(?:[ _][^\W_]+)*)__|«({NAME})»|<<({NAME})>>")
TRACE = re.compile(r"^\W*(?:[A-Za-z_.]*(?:Error|Exception|Warning)\s*:\s*\S.{0,200}|Traceback \(most recent call last\).*|File \"[^\"]+\", line \d+.*|Segmentation fault.*|core dumped.*)$")
EMPTY_VALUE = re.compile(r"^\W*[^\W\d_][\w ]{0,30}\s?:\s*(?:NaN|undefined|null|NULL|\[object Object\]|NoneType|%s|%d)\W*$", re.I)
OPEN_NOTE = re.compile(r"^\W*(?:todo|fixme|tbd|tba|tbc)\s*[:\-–]\s*\S.{0,80}$", re.I)
LATIN_END = ("us", "um", "is", "am", "em", "or", "ur", "it", "at", "et", "nt", "ae", "i", "a", "e", "o")
REPEATED = re.compile(r"^\W*(x{3,}|tbd|todo|fixme|tba|asdf|qwerty|blah?)(?:\W+\1)*\W*$", re.I)
INSERT = re.compile(r"^\W*(?:insert|enter|add|type|put|einfugen|inserer|inserez|inserte|introduzca|ecrivez|escriba)\b(?: [^\W_]+){1,8} (?:here|hier|ici|aqui)\W*$")
HERE = {"here", "hier", "ici", "aqui"}
JSON_ERROR = re.compile(r"^\s*\{\s*\"error\"\s*:\s*(?:\{|\")", re.M)
PURPOSE = re.compile(r"^(?:to|for|before|in order to|um|fur|bevor|pour|avant|afin|para|antes)\b(?: [^\W_]+){1,9}?(?= (?:please|bitte|veuillez|por favor)\b)")


def plain(text: str) -> str:
    """Lower case without accents; words and numbers (as ``#``) with single blanks between."""
    if not text.isascii():
        text = MARK.sub("", unicodedata.normalize("NFKD", text))
    words = WORD.findall(text.casefold())
    if DIGIT.search(text):
        words = [w if w.isalpha() or not NUMBER.fullmatch(w) else "#" for w in words]
    return " ".join(words)


def _phrases(block: str) -> list[str]:
    """The phrases of a list, with each ``{a|b}`` in all its alternatives."""
    out = []
    for phrase in re.split(r"\n|\|(?![^{}]*\})", block):
        parts = [x.strip("{}").split("|") if x[:1] == "{" else [x] for x in re.findall(r"\{[^}]*\}|[^{}]+", phrase)]
        out += [" ".join("".join(x).split()) for x in itertools.product(*parts)] if parts else []
    return [x for x in dict.fromkeys(out) if x]


class Scanner:
    """Multi-pattern automaton over all phrases, and the rules on its coverage of a passage.

    A passage is a line or sentence.  It is residue when a phrase carries a message and phrases,
    numbers and the usual words around them cover at least ``coverage`` of it, when it is a short
    note that content is to come, dummy text, an unfilled field, a bare trace line, or a serialised
    error.  A passage that explains, quotes or reports such text is covered to a small part only.
    """

    def __init__(self, coverage: float = 0.7):
        self.coverage = coverage
        self.words = ahocorasick.Automaton()
        for p in {p for block in L.CORE.values() for p in _phrases(block)}:
            self.words.add_word(f" {p} ", len(p) + 2)
        self.words.make_automaton()
        self.usual = {w for block in L.WORDS.values() for w in block.split()} | {"#"}
        self.ends: dict[str, list[str]] = {}  # by last word, the longest first
        for end in sorted(_phrases(L.FILLER_END), key=len, reverse=True):
            self.ends.setdefault(end.split()[-1], []).append(end)
        self.latin = set(L.LATIN.split())
        self.stems = {w[:3] for w in self.latin if len(w) > 2}
        self.fields = set(_phrases(L.FIELDS))
        self.about = re.compile(r"\b(?:" + "|".join(map(re.escape, _phrases(L.ABOUT))) + r")\b")

    def covered(self, text: str) -> tuple[float, bool]:
        """Share of ``text`` (plain form) under phrases, numbers and usual words, and whether a
        phrase is in it."""
        padded = f" {text} "
        mask = bytearray(len(padded))
        for end, n in self.words.iter(padded):
            mask[end - n + 2 : end] = b"\x01" * (n - 2)
        if not any(mask):
            return 0.0, False
        hit = total = at = 0
        for word in text.split(" "):
            total += len(word)
            if mask[at + 1] or word in self.usual:
                hit += len(word)
            at += len(word) + 1
        return hit / max(1, total), True

    def dummy(self, word: str) -> bool:
        """A word of dummy Latin, also in another inflection."""
        return word in self.latin or (len(word) > 3 and word[:3] in self.stems and word.endswith(LATIN_END))

    def known(self, name: str, bracket: str) -> bool:
        """A usual field name, one in snake case or capitals, or (but for square brackets, which
        also hold remarks) one in title case that ends in a usual field name."""
        flat = re.sub(r"[_\s.\-]+", " ", name).strip().casefold()
        if flat in self.fields or (("_" in name or (name.isupper() and len(name) > 3)) and len(flat) > 3):
            return True
        words = name.split()
        return len(words) > 1 and bracket != "[" and all(w[0].isupper() for w in words) and bool({flat.split()[-1], flat.split()[-1].removesuffix("s")} & self.fields)

    def field(self, passage: str, text: str, whole: str) -> bool:
        """An unfilled template field that the passage does not itself explain."""
        if not DELIMITER.search(passage):
            return False
        if len(text.split()) > 6:  # a string quoted in a sentence is spoken about
            passage = SPAN.sub(" ", passage)
        hit = bool(STRONG.search(passage))
        for m in WEAK.finditer(passage) if not hit else ():
            name = next(g for g in m.groups() if g is not None)
            if not self.known(name, m.group()[: m.group().index(name)].strip()):
                continue
            if m.group().startswith("<") and not m.group().startswith("<<") and f"</{name}" in whole:
                continue
            hit = True
            break
        return hit and not self.about.search(plain(STRONG.sub(" ", passage)))

    def kinds(self, passage: str, whole: str) -> str | None:
        if REPEATED.match(passage) or OPEN_NOTE.match(passage):
            return "filler"
        if TRACE.match(passage):
            return "error"
        if ":" in passage and EMPTY_VALUE.match(passage):
            return "template"
        text = plain(passage)
        if not text:
            return None
        words = text.split()
        if self.field(passage, text, whole):
            return "template"
        latin = [w for w in words if w in self.latin or (w[:3] in self.stems and self.dummy(w))]
        if len(latin) >= 0.6 * len(words) and len({w for w in latin if len(w) > 3}) >= 3 and any(w in self.latin for w in latin if len(w) > 3):
            return "filler"
        quoted = len(QUOTED.findall(passage)) >= 2 and len(words) > 8
        first = next((c for c in passage if c.isalnum()), "")
        noted = passage.lstrip()[:1] in "[<({*" or first.isupper() or first.isdigit()
        if len(words) <= 12 and noted and not quoted:
            if words[-1] in HERE and INSERT.match(text):
                return "filler"
            for end in self.ends.get(words[-1], ()):
                if text == end or text.endswith(" " + end):
                    if len(words) - len(end.split()) <= (2 if " " not in end and passage.lstrip()[:1] not in "[<({*" else 6):
                        return "filler"
        if len(words) > 8 and SPAN.search(passage):  # a message in quotes is spoken about
            text = plain(SPAN.sub(" ... ", passage))
        share, core = self.covered(text)
        if quoted and text != " ".join(words):
            share *= len(text) / max(1, len(" ".join(words)))
        if core and share < self.coverage:
            rest = PURPOSE.sub("", text)
            head, comma, tail = passage.partition(",")
            if rest == text and comma and len(head.split()) <= 9 and PURPOSE.match(plain(head) + " please"):
                rest = plain(tail)
            if rest != text:
                share, core = self.covered(rest)
        return "error" if core and share >= self.coverage else None

    def scan(self, text: str | None) -> tuple[bool, float, list[str], str | None]:
        """Whether the text holds residue, its share of residue letters, kinds, first passage."""
        if not text or not text.strip():
            return False, 0.0, [], None
        body = CODE.sub(" ", text)
        kinds: set[str] = set()
        if JSON_ERROR.search(body):
            kinds.add("error")
        if "\\" in body:
            body = ESCAPE.sub(_unescape, body)
        body = TAG.sub("\n", html.unescape(body)).replace("­", "")
        hit = total = 0
        shown = None
        for part in BREAK.split(body):
            part = part.strip() if part else ""
            if not part:
                continue
            total += len(part)
            kind = self.kinds(part, text)
            if kind:
                kinds.add(kind)
                hit += len(part)
                shown = shown or part
        return bool(kinds), hit / max(1, total), sorted(kinds), shown


def _unescape(m: re.Match) -> str:
    try:
        return json.loads(f'"{m.group()}"')
    except ValueError:
        return " "


OUT = "is_residue boolean, residue_share double, residue_kinds array<string>, residue_passage string"


def scan_residue(docs: DataFrame, id_col: str | Column = "doc_id", text_col: str = "text", coverage: float = 0.7) -> DataFrame:
    """``id`` with ``is_residue, residue_share, residue_kinds, residue_passage`` of every row.

    A document is residue when any of its passages is; ``residue_share`` is the part of its
    letters that lies in such passages.  Null, empty and blank texts are never residue; repeated
    rows and null ids are judged each on their own; texts are read whole.  An empty table gives
    an empty result.
    """
    rows = docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(coverage)
        for batch in batches:
            got = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([g[0] for g in got], pa.bool_()),
                    pa.array([g[1] for g in got], pa.float64()),
                    pa.array([g[2] for g in got], pa.list_(pa.string())),
                    pa.array([g[3] for g in got], pa.string()),
                ],
                names=["id", "is_residue", "residue_share", "residue_kinds", "residue_passage"],
            )

    return rows.mapInArrow(run, f"id {kind}, {OUT}")


def drop_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.0) -> DataFrame:
    """The documents without those whose residue share exceeds ``max_share`` (0: any residue)."""
    bad = scan_residue(docs, id_col, text_col).filter(F.col("is_residue") & (F.col("residue_share") > max_share)).select("id").distinct()
    return docs.join(bad, docs[id_col] == bad["id"], "left_anti")

"""Personal data, also where it is disguised, by transducers that keep offsets.

Base spans are found in the text as it is. Then transducers rewrite a copy of it: characters
that look like ASCII ones, spelled digits, and words or brackets that stand for @ and the full
stop. Each one yields edits (start, stop, replacement); a ``Rewriting`` applies them and takes a span
of its result back to the characters it came from. The detectors run once more on the rewritten
text, and every span that rests on an edit is mapped back through all transducers.

Detectors are linear in the text: they start at a character that a match must have (@, +) or at
the beginning of a run of digits, and runs that no match shares are read once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, prepare

KINDS = ("email", "ip", "card", "phone")
KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))
DDL = "array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>"

Span = tuple[int, int]

# ---- detectors: the contract's patterns -------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, end))
    return out


def addresses(text: str) -> list[Span]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 4 and int(part or "0") <= 255

    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


DETECTORS = dict(zip(KINDS, (emails, addresses, cards, phones)))

# ---- transducers ------------------------------------------------------------------------------

# Letters of other alphabets and the ASCII letters that look like them.
ALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}
# Signs that stand for ASCII ones, and signs without a width.
SIGNS = {
    "․": ".", "‧": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
NO_WIDTH = "­​‌‍⁠﻿"


def _alike() -> dict[str, str]:
    """Every character with its ASCII one: the table above, full-width forms and the digits of all scripts."""
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    out |= {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, 0x1FBFA) if unicodedata.category(chr(c)) == "Nd"}
    # letters and digits of the mathematical alphabets
    out |= {chr(c): k for c in range(0x1D400, 0x1D800) if len(k := unicodedata.normalize("NFKC", chr(c))) == 1 and k.isascii()}
    return out | ALIKE | SIGNS | dict.fromkeys(NO_WIDTH, "")


_CHARS = _alike()
_WIDE_BLANK = re.compile("[" + "".join(c for c, to in SIGNS.items() if to == " ") + "]")
_TOKEN, _ASCII_SIGN = re.compile(r"\S+"), re.compile(r"[A-Za-z0-9@]")

# The digits as words (English, German, French, Spanish).
SPELLED = {
    "0": "zero oh null nul zéro cero", "1": "one eins ein un une uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_DIGIT = {w: d for d, words in SPELLED.items() for w in words.split()}
# Words for @ and the full stop, and the last parts of names that count where only words tell.
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arobase|arroba|klammeraffe", "dot|punkt|point|punto", "plus|más"
ENDINGS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|us|eu|at|ch|it|nl|mx|ar|ca|au|biz|app|dev|me|mil|int|example|invalid|test"

_OPEN, _SHUT = r"[ ]{0,2}[\[({<][ ]{0,2}", r"[ ]{0,2}[\])}>][ ]{0,2}"
_AT_SIGN = rf"{_OPEN}(?:{AT_WORDS}|@){_SHUT}"
_DOT_SIGN = rf"{_OPEN}(?:{DOT_WORDS}|\.){_SHUT}"
_DOT_WORD = rf"[ ]{{1,2}}(?:{DOT_WORDS})[ ]{{1,2}}"
_AT_WORD = rf"[ ]{{1,2}}(?:{AT_WORDS})[ ]{{1,2}}"
_NUMBER = rf"(?:{'|'.join(sorted(_DIGIT, key=len, reverse=True))}|[0-9])"
#: Four digits or more, at least one of them a word: blanks between them go, what stands for a full stop is one.
_CHAIN = re.compile(rf"(?<!\w)(?:(?:{PLUS_WORDS})[ ]{{1,2}})?{_NUMBER}(?:(?:{_DOT_SIGN}|{_DOT_WORD}|[ -]{{0,2}}){_NUMBER}){{3,}}(?!\w)", re.I)
_CHAIN_PARTS = re.compile(rf"(?P<plus>(?:{PLUS_WORDS})[ ]{{1,2}})|(?P<digit>{_NUMBER})|(?P<dot>{_DOT_SIGN}|{_DOT_WORD})|(?P<gap>[ -]+)", re.I)
_HAS_WORD = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_DIGIT, key=len, reverse=True))})(?!\w)", re.I)
_DOT_IN_NUMBERS = re.compile(rf"[0-9]({_DOT_SIGN}|{_DOT_WORD})(?=[0-9])", re.I)
_LETTER_IN_NUMBER = re.compile(r"(?<=[0-9])[OoIl]+(?=[0-9])|(?<=[0-9][ -])[OoIl]+(?=[0-9]{2})")
_LABEL = r"[A-Za-z0-9-]+"
_ANY_DOT = rf"(?:{_DOT_SIGN}|{_DOT_WORD}|\.)"
#: What one of the transducers after the first needs, for a linear scan of all texts of a batch.
HINT = (rf"@|{_AT_SIGN}|{_DOT_SIGN}|{_DOT_WORD}|(?:{_NUMBER}[ -]{{0,2}}){{3}}{_NUMBER}"
        rf"|[0-9][ -]?[OoIl]+[0-9]")
#: After a plain word for @, a word or bracket must stand for a full stop as well, before a known ending.
_MAIL = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])(?:(?P<sign>{_AT_SIGN}|[ ]{{1,2}}@[ ]{{1,2}}|@)(?={_LABEL}{_ANY_DOT}[A-Za-z])"
    rf"|(?P<word>{_AT_WORD})(?={_LABEL}(?:{_ANY_DOT}{_LABEL}){{0,6}}?(?:{_DOT_SIGN}|{_DOT_WORD})(?:{ENDINGS})(?!\w)))", re.I)
#: The next full stop of a domain; a plain word for one only before a known ending or another part.
_AFTER = re.compile(rf"{_LABEL}(?:(?P<sign>{_DOT_SIGN}|\.)(?={_LABEL})|(?P<word>{_DOT_WORD})(?=(?:{ENDINGS})(?!\w)|{_LABEL}(?:{_DOT_SIGN}|{_DOT_WORD}){_LABEL}))", re.I)
_BEFORE = re.compile(rf"(?:{_DOT_SIGN}|{_DOT_WORD})\Z", re.I)

Edit = tuple[int, int, str]


def alike(text: str) -> Iterator[Edit]:
    """Characters that look like ASCII ones; signs without a width go. Letters of other alphabets
    count only beside ASCII letters, digits or @, so words of their own languages stay."""
    if text.isascii() or _CHARS.keys().isdisjoint(set(text)):
        return
    edits = [(m.start(), m.end(), " ") for m in _WIDE_BLANK.finditer(text)]
    for token in _TOKEN.finditer(text):
        if token[0].isascii() or _CHARS.keys().isdisjoint(token[0]):
            continue
        mixed = _ASCII_SIGN.search(token[0])
        edits += [(i, i + 1, _CHARS[c]) for i, c in enumerate(token[0], token.start()) if c in _CHARS and (mixed or c not in ALIKE)]
    yield from sorted(edits)


def spelled(text: str) -> Iterator[Edit]:
    """Chains of digits of which some are words; letters that look like digits inside a number."""
    for chain in _CHAIN.finditer(text):
        if not _HAS_WORD.search(chain[0]):
            continue
        for m in _CHAIN_PARTS.finditer(text, chain.start(), chain.end()):
            kind = m.lastgroup
            to = {"plus": "+", "dot": ".", "gap": ""}.get(kind) if kind != "digit" else _DIGIT.get(m[0].lower(), m[0])
            if to != m[0]:
                yield m.start(), m.end(), to


def misread(text: str) -> Iterator[Edit]:
    """O, o, I and l inside a number."""
    for m in _LETTER_IN_NUMBER.finditer(text):
        yield m.start(), m.end(), "".join("0" if c in "Oo" else "1" for c in m[0])


def at_and_dot(text: str) -> Iterator[Edit]:
    """Words and brackets that stand for @ and the full stop, in addresses and between numbers."""
    edits = {m.span(1): "." for m in _DOT_IN_NUMBERS.finditer(text)}
    for m in _MAIL.finditer(text):
        edits[m.span()] = "@"
        at = m.end()
        while part := _AFTER.match(text, at):  # the rest of the domain
            edits[part.span(part.lastgroup)] = "."
            at = part.end()
        back = m.start()
        while True:  # the name before: parts joined by a word or bracket for a full stop
            begin = back
            while begin and text[begin - 1] in LOCAL:
                begin -= 1
            part = _BEFORE.search(text, max(0, begin - 16), begin) if begin < back else None
            if not part or part.start() == 0 or text[part.start() - 1] not in LOCAL:
                break
            edits[part.span()] = "."
            back = part.start()
    end = 0
    for (a, b), to in sorted(edits.items()):
        if a >= end and text[a:b] != to:
            yield a, b, to
            end = b


class Rewriting:
    """A text after a transducer's edits, and the way back for its spans."""

    def __init__(self, text: str, edits: list[Edit]):
        self.edits, self.at = edits, []
        parts, end, size = [], 0, 0
        for a, b, to in edits:
            parts += [text[end:a], to]
            size += a - end
            self.at.append(size)  # where the edit's replacement begins
            size += len(to)
            end = b
        self.text = "".join([*parts, text[end:]])

    def back(self, start: int, stop: int) -> tuple[int, int, bool]:
        """The span's first and last source character, and whether it rests on an edit."""
        return self._char(start)[0], self._char(stop - 1)[1], bisect_right(self.at, stop - 1) > self._before(start)

    def _before(self, start: int) -> int:
        """Edits that end at or before the character ``start``."""
        k = bisect_right(self.at, start)
        while k and self.at[k - 1] + len(self.edits[k - 1][2]) > start:
            k -= 1
        return k

    def _char(self, i: int) -> Span:
        k = bisect_right(self.at, i) - 1
        if k < 0:
            return i, i + 1
        a, b, to = self.edits[k]
        past = i - self.at[k] - len(to)
        return (a, b) if past < 0 else (b + past, b + past + 1)


TRANSDUCERS = (alike, spelled, misread, at_and_dot)


def spans(text: str, hint: bool = True) -> list[tuple[str, int, int, bool]]:
    """(kind, start, stop, base) in order of kind, start and stop. A span that rests on an edit is
    added unless it lies within a base span of its kind. Without ``hint`` (``HINT`` is not in the text)
    only the first transducer is tried, and the others on what it changed."""
    base = {k: find(text) for k, find in DETECTORS.items()}
    stages, now = [], text
    for rewrite in TRANSDUCERS:
        edits = list(rewrite(now)) if hint or stages or rewrite is alike else []
        if edits:
            stages.append(Rewriting(now, edits))
            now = stages[-1].text
    out = [(k, a, b, True) for k, found in base.items() for a, b in found]
    if stages:
        for k, find in DETECTORS.items():
            starts = [a for a, _ in base[k]]
            for a, b in find(now):
                changed = False
                for s in reversed(stages):
                    a, b, here = s.back(a, b)
                    changed |= here
                n = bisect_right(starts, a)
                if changed and not (n and base[k][n - 1][1] >= b):
                    out.append((k, a, b, False))
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (order[s[0]], s[1], s[2]))


def personal_data(text: Column) -> Column:
    """array<struct(kind, start, stop, base)> of a text; empty for a null or empty one."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            hints = pc.fill_null(pc.match_substring_regex(texts, HINT, ignore_case=True), False)
            found = (spans(t.as_py() or "", h.as_py()) for t, h in zip(texts, hints))
            yield pa.array([[{"kind": k, "start": a, "stop": b, "base": y} for k, a, b, y in x] for x in found], KIND)

    return F.arrow_udf(run, DDL).asNondeterministic()(text)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and its spans. Null ids and repeated rows are carried; an
    empty table gives no rows; other columns are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), personal_data(F.col(text_col)).alias("spans"))


def masked(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that overlap the first, longest counts."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for t, own in zip(texts.to_pylist(), lists.to_pylist()):
                parts, end = [], 0
                for s in sorted(own or [], key=lambda s: (s["start"], -s["stop"])):
                    if s["start"] >= end:
                        parts += [t[end:s["start"]], f"[{s['kind']}]"]
                    end = max(end, s["stop"])
                out.append(None if t is None else "".join(parts) + t[end:])
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, found)


def _written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = find_personal_data(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(_written(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


QUERIES = {"op12_pii": op12_pii}

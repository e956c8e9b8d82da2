"""Personal data behind disguises, found by transducers that keep offsets.

Three transducers run one after the other: homoglyphs and invisible characters to plain ones, runs of
spelled digits to digits, disguised at and dot signs to @ and full stop. Each notes which stretches
it rewrote. Identifiers are detected in the last text and their spans mapped back, transducer by
transducer, to the characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import documents_only, sliced


class Rewriting:
    """A text rewritten in places. ``edits`` are (start, end, replacement), sorted and apart."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.edits = edits
        self.begins: list[int] = []  # of each replacement in the new text
        out, at, length = [], 0, 0
        for start, end, new in edits:
            out += [text[at:start], new]
            length += start - at
            self.begins.append(length)
            length += len(new)
            at = end
        self.text = "".join([*out, text[at:]]) if edits else text

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The span of the old text that a span of the new one, not empty, comes from."""
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.begins, i) - 1
        # Replacements may be empty: the last that begins at i or before is the one that counts.
        if k < 0:
            return i, i + 1
        start, end, new = self.edits[k]
        if i < self.begins[k] + len(new):
            return start, end
        j = end + i - self.begins[k] - len(new)
        return j, j + 1


def _fold_table() -> dict[str, str]:
    table = {}
    for cp in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2474), *range(0x2070, 0x208A), 0xB2, 0xB3, 0xB9, 0xFE6B, 0x2024]:
        plain = unicodedata.normalize("NFKC", chr(cp))
        if plain.isascii() and plain != chr(cp):
            table[chr(cp)] = plain
    for cp in range(0x660, 0x11000):
        if unicodedata.category(chr(cp)) == "Nd":
            table[chr(cp)] = str(unicodedata.decimal(chr(cp)))
    looks = "аaеeоoрpсcуyхxіiјjѕsԁdһhԛqԝwѵvӏlАAВBЕEКKМMНHОOРPСCТTУYХXІIЈJЅSΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXοoαaνvρpιiϲcɡgıi"
    table |= dict(zip(looks[::2], looks[1::2]))
    table |= dict.fromkeys("​‌‍‎‏⁠﻿­᠎", "")
    table |= dict.fromkeys("           　", " ")
    table |= dict.fromkeys("‐‑‒–—―−﹣⁃", "-")
    table |= dict.fromkeys("。｡‧·∙܁ꓸ", ".")
    return table


_FOLD = _fold_table()
_FOLDED = re.compile("[" + "".join(map(re.escape, _FOLD)) + "]")

_DIGITS = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf fuenf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_VALUE = {w: d for d, words in _DIGITS.items() for w in words.split()}
_TIMES = {"double": 2, "triple": 3}
_SPELLED = "|".join(sorted(_VALUE, key=len, reverse=True))
_UNIT = rf"(?:(?:double|triple)\s+)?(?:{_SPELLED})"
#: Between spelled digits: a space, a comma, a hyphen or such.
_BETWEEN = r"(?:\s?[,;/-]\s?|\s+)"
_RUN = re.compile(rf"\b(?:plus\s+)?(?:{_UNIT}|\d{{1,4}}){_BETWEEN}(?:(?:dash|hyphen|dot|point)\s+)?(?:{_UNIT}|\d{{1,4}})(?:{_BETWEEN}(?:(?:dash|hyphen|dot|point)\s+)?(?:{_UNIT}|\d{{1,4}}))+\b", re.I)
_PIECE = re.compile(rf"(?:(double|triple)\s+)?\b({_SPELLED})\b|(\d+)|\b(plus)\b|\b(dash|hyphen)\b|\b(dot|point)\b", re.I)
#: A spelled digit beside a spelled one or figures, on either side: every run with two spelled digits has such.
_SIGN = r"(?:(?:dash|hyphen|dot|point|double|triple)\s+)*"
_NEIGHBOURS = re.compile(rf"\b(?:{_SPELLED}){_BETWEEN}{_SIGN}(?:(?:{_SPELLED})\b|\d)|\d{_BETWEEN}{_SIGN}(?:{_SPELLED})\b", re.I)

_AT_WORD, _DOT_WORD = r"(?:at|ät|arobase|arroba)", r"(?:dot|punkt|point|punto)"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_MARKED_AT = rf"(?:\s*{_OPEN}\s*(?:{_AT_WORD}|@)\s*{_SHUT}\s*|&#64;|&commat;|%40)"
_MARKED_DOT = rf"(?:\s*{_OPEN}\s*(?:{_DOT_WORD}|\.)\s*{_SHUT}\s*|&#46;|&period;|[_-]{_DOT_WORD}[_-])"
_BARE_AT = rf"(?:\s+{_AT_WORD}\s+|[_-]{_AT_WORD}[_-])"
_AT = rf"(?:{_MARKED_AT}|{_BARE_AT}|\s+@\s+|\s+@|@\s+|@)"
_DOT = rf"(?:{_MARKED_DOT}|\s+{_DOT_WORD}\s+|\s+\.\s+|\.)"
_NAME, _LABEL = r"[^\W_](?:[\w%+-]*\w)?", r"[^\W_](?:[\w-]*[^\W_])?"
_TAIL = re.compile(rf"(?P<at>{_AT})(?P<domain>{_LABEL}(?:{_DOT}{_LABEL})+)", re.I)
_LAST_DOT_WORD = re.compile(rf"(?:^|(?<=\W)){_DOT_WORD}\Z|\.\Z", re.I)
_ENTITY = re.compile(r"&#46;\Z|&period;\Z", re.I)
_HINT = re.compile(rf"\b{_AT_WORD}\b|[_-]{_AT_WORD}[_-]|@|&#64;|&commat;|%40", re.I)
_TOP_LEVEL = re.compile(r"[^\W\d_]{2,}$")
_PLAIN_AT = re.compile(_BARE_AT, re.I)
_DOT_PART, _ANY_DOT = re.compile(_DOT, re.I), re.compile(rf"{_MARKED_DOT}|\s+{_DOT_WORD}\s+", re.I)


def fold_homoglyphs(text: str) -> Rewriting:
    if text.isascii() or _FOLD.keys().isdisjoint(text):  # far faster than the search, and true of nearly all texts
        return Rewriting(text, [])
    return Rewriting(text, [(m.start(), m.end(), _FOLD[m[0]]) for m in _FOLDED.finditer(text)])


def spelled_digits(text: str) -> Rewriting:
    """Runs of three or more digits of which two are spelled, neighbours or not, in English, German, French or Spanish."""
    edits = []
    if _NEIGHBOURS.search(text):
        for m in _RUN.finditer(text):
            out, spelled = [], 0
            for p in _PIECE.finditer(m[0]):
                times, word, digits, plus, dash, dot = p.groups()
                spelled += word is not None
                out.append(_VALUE[word.lower()] * _TIMES.get((times or "").lower(), 1) if word else digits or (plus and "+") or (dash and "-") or (dot and "."))
            if spelled >= 2:
                edits.append((m.start(), m.end(), "".join(out)))
    return Rewriting(text, edits)


def _before_spaces(text: str, at: int, low: int) -> int:
    while at > low and text[at - 1].isspace():
        at -= 1
    return at


def _before_dot(text: str, at: int, low: int) -> int | None:
    """Where the dot sign, disguised or plain, begins that ends at ``at``."""
    bare = _before_spaces(text, at, low)
    if bare > low and text[bare - 1] in "])}>":
        inner = _before_spaces(text, bare - 1, low)
        m = _LAST_DOT_WORD.search(text[max(low, inner - 8) : inner])
        if not m:
            return None
        start = _before_spaces(text, inner - len(m[0]), low)
        return _before_spaces(text, start - 1, low) if start > low and text[start - 1] in "[({<" else None
    if bare == at:
        m = _ENTITY.search(text[max(low, at - 8) : at])
        if m:
            return at - len(m[0])
        return at - 1 if at > low and text[at - 1] == "." else None
    m = _LAST_DOT_WORD.search(text[max(low, bare - 8) : bare])
    start = bare - len(m[0]) if m else bare
    spaces = _before_spaces(text, start, low)
    return spaces if m and spaces < start else None


def _head_start(text: str, end: int, low: int) -> int | None:
    """Where the names, parted by dot signs, begin that end at ``end``; read backwards, so that none is too long."""
    best, at = None, end
    while at > low and (text[at - 1].isalnum() or text[at - 1] == "_"):
        first = at
        while first > low and (text[first - 1].isalnum() or text[first - 1] in "_%+-"):
            first -= 1
        # A name begins with a letter or digit, the first of all names at the edge of a word.
        for i in range(first, at):
            if text[i].isalnum() and (i == low or not (text[i - 1].isalnum() or text[i - 1] == "_")):
                best = i
                break
        dot = _before_dot(text, first, low) if text[first].isalnum() else None
        if dot is None:
            break
        at = dot
    return best


def at_and_dot(text: str) -> Rewriting:
    """Signs of addresses: a bare word "at" counts only if a dot of the domain is disguised as well."""
    edits: list[tuple[int, int, str]] = []
    for hint in _HINT.finditer(text):
        begin, done = hint.start(), edits[-1][1] if edits else 0
        while begin > done and (text[begin - 1].isspace() or text[begin - 1] in "[({<"):
            begin -= 1
        if begin < done:
            continue
        m = _TAIL.match(text, begin) or _TAIL.match(text, hint.start())
        if not m or not _TOP_LEVEL.search(m["domain"]) or (_PLAIN_AT.fullmatch(m["at"]) and not _ANY_DOT.search(m["domain"])):
            continue
        head = _head_start(text, m.start(), done)
        if head is None:
            continue
        spots = [(d.start(), d.end(), ".") for d in _DOT_PART.finditer(text, head, m.start())]
        spots.append((m.start("at"), m.end("at"), "@"))
        spots += [(d.start(), d.end(), ".") for d in _DOT_PART.finditer(text, m.start("domain"), m.end())]
        edits += [(s, e, new) for s, e, new in spots if text[s:e] != new]
    return Rewriting(text, edits)


_EMAIL = re.compile(r"(?<![\w.+-])[^\W_](?:[\w.%+-]*[\w])?@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,24}(?![\w-])")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
_CARD = re.compile(r"(?<![\w-])[2-6]\d{3}(?:[ -]?\d){8,14}\d(?![\w-]?\d)")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?:1[ .-])?\(\d{3}\) ?\d{3}[ .-]?\d{4}|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}|\d{10,11})(?![\w-]|\.\d)")


_DIGITS_THERE = re.compile(r"\d{2}|\d\.\d")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _iban(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


#: Characters of an IBAN by country.
_IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def _ends(text: str, start: int, end: int, separators: str) -> Iterator[int]:
    """``end``, then the ends of the groups before it, longest first."""
    yield end
    for at in range(end - 1, start, -1):
        if text[at] in separators:
            yield at


def _iban_at(text: str, start: int, end: int) -> tuple[int, str] | None:
    """End and code of the IBAN that a run begins with: the whole run, or what ends at a group and is as long as its country's."""
    for e in _ends(text, start, end, " "):
        code = text[start:e].replace(" ", "")
        if len(code) < 15:
            break
        if len(code) <= 34 and (e == end or _IBAN_LENGTH.get(code[:2], len(code)) == len(code)) and _iban(code):
            return e, code
    return None


def _card_at(text: str, start: int, end: int) -> tuple[int, str] | None:
    for e in _ends(text, start, end, " -"):
        digits = re.sub(r"\D", "", text[start:e])
        if 13 <= len(digits) <= 19 and luhn(digits):
            return e, digits
    return None


def _free(spans: list[tuple[int, int, str, str]], start: int, end: int) -> int | None:
    """The place of a span among ``spans``, which are in order and apart; None where it overlaps one."""
    i = bisect_right(spans, start, key=lambda s: s[0])
    if i and spans[i - 1][1] > start or i < len(spans) and spans[i][0] < end:
        return None
    return i


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the identifiers in plain text; where kinds overlap the first named stays."""
    found: list[tuple[int, int, str, str]] = []  # in order and apart

    def put(start: int, end: int, kind: str, form: str) -> None:
        i = _free(found, start, end)
        if i is not None:
            found.insert(i, (start, end, kind, form))

    def add(m: re.Match, kind: str, form: str) -> None:
        put(m.start(), m.end(), kind, form)

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m, "email", m[0].lower())
    if not _DIGITS_THERE.search(text):
        return found
    # A run may take in what follows an identifier, or begin before one: the search goes on where one ends or may begin.
    m = _IBAN.search(text)
    while m:
        one = _iban_at(text, *m.span())
        if one:
            put(m.start(), one[0], "iban", one[1])
        m = _IBAN.search(text, one[0] if one else m.start() + 1)
    m = _CARD.search(text)
    while m:
        one = _card_at(text, *m.span())
        if one:
            put(m.start(), one[0], "card", one[1])
        m = _CARD.search(text, one[0] if one else m.end())
    for m in _IP.finditer(text):
        add(m, "ip", m[0])
    for m in _SSN.finditer(text):
        add(m, "ssn", m[0])
    for m in _PHONE.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        if 8 <= len(digits) <= 15:
            add(m, "phone", ("+" if m[0].startswith("+") else "") + digits)
    return found


def find_pii(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) with spans in characters of the source text."""
    if not text:
        return []
    steps, now = [], text
    for transducer in (fold_homoglyphs, spelled_digits, at_and_dot):
        steps.append(transducer(now))
        now = steps[-1].text
    out = []
    for start, end, kind, form in detect(now):
        for step in reversed(steps):
            start, end = step.back(start, end)
        if kind == "phone" and re.fullmatch(r"\d{10,11}", text[start:end]):
            continue  # bare digits are as likely some other number
        out.append((start, end, kind, form))
    return sorted([*out, *_spelled_numbers(steps, out)])


def _spelled_numbers(steps: list[Rewriting], known: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Runs of seven to fifteen digits that were spelled out and are nothing else: telephone numbers, unless they only count up."""
    out, known = [], sorted(known)
    for start, end, new in steps[1].edits:
        digits = re.sub(r"\D", "", new)
        start, end = steps[0].back(start, end)
        if 7 <= len(digits) <= 15 and digits not in "01234567890123456789" and _free(known, start, end) is not None:
            out.append((start, end, "phone", ("+" if new.startswith("+") else "") + digits))
    return out


_SPANS = "doc_id long, kind string, start int, end int, found string, normal string"


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, found, normal), one row per identifier.

    ``start`` and ``end`` count characters (code points) of the source text, ``found`` is what stands
    there, ``normal`` the identifier without its disguise. Kinds: email, iban, card (Luhn), ip, ssn,
    phone. Needs doc_id and text; other columns are ignored whatever their names. Null and empty
    texts have none. Repeated rows and repeated identifiers give as many rows. Identifiers never
    overlap; where kinds compete, the one first in this list stays. Whole texts are searched, however
    long. An empty table gives no rows.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                rows += [(doc_id, kind, s, e, text[s:e], form) for s, e, kind, form in find_pii(text)]
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "kind", "start", "end", "found", "normal"])

    return documents_only(docs).select("doc_id", "text").mapInArrow(spans, _SPANS)


def redact(text: str) -> str:
    """The text with each identifier replaced by its kind in angle brackets."""
    out, at = [], 0
    for start, end, kind, _ in find_pii(text):
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])

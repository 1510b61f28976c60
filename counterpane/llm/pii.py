"""Personal data, also in disguise: offset-preserving deobfuscation.

Base spans (email, ip, card, phone) are found in the source text. Then transducers rewrite the text: look-alike and
full-width characters, invisible ones, digits written as words, and at/dot disguises. Each keeps, for every character it
writes, the span of the source it came from. The same finders run over the rewritten text, and what they find is mapped
back; a span that was rewritten somewhere is added unless a base span of its kind covers it, so a base span that holds
only the plain end of a disguised address stays beside the whole one. Texts without any trigger (nearly all) are not
rewritten.

Finders work around the rare signs (`@`, `+`, dots between digits), so that long runs of letters or digits cost linear
time. Defined results: null and empty texts have no spans, digests of the empty text and an empty `spans`; null ids
stay null; repeated rows repeat; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from .common import frame, map_texts
from .toxicity import INVISIBLE, LOOKALIKES

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run that starts in the middle ends where the whole run ends: looking back loses no match and saves the retries
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterable[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of all kinds by start, then kind."""
    found = list(emails(text))
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = "".join(_DIGIT.findall(m[0]))
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text)
                      if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# The digits as words in English, German, French and Spanish.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_PLAIN = {ord(k): v for k, v in (LOOKALIKES | {k.upper(): v.upper() for k, v in LOOKALIKES.items()
                                                if len(k.upper()) == 1 and not k.upper().isascii()}).items()}
_PLAIN |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_PLAIN |= {ord(c): None for c in INVISIBLE}
_PLAIN |= dict.fromkeys([*range(0x2010, 0x2016), 0x2212], "-") | dict.fromkeys([0x2024, 0x3002, 0xFF61], ".")
_PLAIN |= dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000], " ")
for _c in [*range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x2070, 0x208A), *range(0x0660, 0x066A),
           *range(0x06F0, 0x06FA), *range(0x0966, 0x0970)]:
    _digit = unicodedata.digit(chr(_c), None)
    _form = str(_digit) if _digit is not None else unicodedata.normalize("NFKC", chr(_c))
    if len(_form) == 1 and _form.isascii():
        _PLAIN[_c] = _form
# one class for the basic plane (a bit table in `re`) and one range beyond it: together they would be searched one by one
_ODD_LOW = re.compile("[" + "".join(map(re.escape, map(chr, sorted(c for c in _PLAIN if c < 0x10000)))) + "]")
_ODD_HIGH = re.compile("[\U0001d400-\U0001d7ff]")


def odd(text: str) -> bool:
    """Whether a text holds a character that a plain one stands for."""
    return not text.isascii() and (_ODD_LOW.search(text) is not None or _ODD_HIGH.search(text) is not None)



_WORDS = "|".join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w)))
#: Three or more digits in words or figures, one of them a word, parted by blanks, dots, dashes or commas.
_SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|\+)[\s-]*)?(?:(?:{_WORDS}|[0-9]+)(?:\s*(?:[-.,]|dot|punto|punkt|point)\s*|\s+))"
                      rf"{{2,}}(?:{_WORDS}|[0-9]+)(?!\w)", re.I)
_TOKEN = re.compile(rf"(plus)(?!\w)|({_WORDS})(?!\w)|([0-9])|(dot|punto|punkt|point)(?!\w)|(.)", re.I | re.S)
_OPEN, _CLOSE = r"[\(\[\{<]", r"[\)\]\}>]"
# An @ in disguise, and a dot, without the blanks around them; the spelled ones stand between blanks.
_AT = re.compile(rf"(?P<hard>{_OPEN}\s*(?:at|@)\s*{_CLOSE}|[_*-]at[_*-]|&\#64;)|(?P<word>(?<=\s)at(?=\s))|@", re.I)
_DOT = re.compile(rf"(?P<hard>{_OPEN}\s*(?:dot|\.)\s*{_CLOSE}|[_*-]dot[_*-]|&\#46;)|(?P<word>(?<=\s)dot(?=\s))|\.", re.I)
_MAIL_CHARS = _LOCAL - {"."}
_HOST_CHARS = _LOCAL - frozenset("._%+")
_LETTER_DIGITS = re.compile(r"(?<=[0-9])[OoIl](?=[0-9\x20().-]*[0-9])|(?<=[0-9][\x20-])[OoIl](?=[0-9])")
_NUMBER_DOT = re.compile(rf"(?<=[0-9])(?:\s*{_OPEN}\s*(?:dot|\.)\s*{_CLOSE}\s*|\s+dot\s+)(?=[0-9])", re.I)


# Triggers look at the set of words first: cheap on bytes, and few texts hold these words.
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))
_NUMBERS = frozenset(w.encode() for w in NUMBER_WORDS)
_AT_SIGNS = re.compile(rf"{_OPEN}\s*(?:at|dot|@|\.)\s*{_CLOSE}|[_*-](?:at|dot)[_*-]", re.I)


def triggers(text: str) -> tuple[bool, bool, bool, bool]:
    """Whether a text may hold look-alikes, digits as words, mail disguises, letters within digits."""
    words = set(text.lower().encode().translate(_LETTERS).split())
    spelled = not words.isdisjoint(_NUMBERS) and _SPELLED.search(text) is not None
    mail = b"dot" in words or " @" in text or "@ " in text or "&#" in text or (
        (b"at" in words or "@" in text or "." in text) and _AT_SIGNS.search(text) is not None)
    return odd(text), spelled, mail, _LETTER_DIGITS.search(text) is not None


class Tape:
    """A text with, for each character, the source offsets it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replace non-overlapping spans, given in order; what is written stands for the whole span."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts = starts + self.starts[at:]
        self.ends = ends + self.ends[at:]


def plain_edits(text: str) -> Iterable[tuple[int, int, str]]:
    """Look-alikes inside words that hold ASCII letters, digits or signs, other forms of digits, invisible characters."""
    for m in re.finditer(r"\S+", text):
        word = m[0]
        if not odd(word):
            continue
        new = [(_PLAIN.get(ord(c), c) or "") for c in word]
        if all(c.isascii() for x in new for c in x):  # a word of a foreign script keeps letters of its own
            for i, (c, x) in enumerate(zip(word, new)):
                if c != x:
                    yield m.start() + i, m.start() + i + 1, x


def spelled_edits(text: str) -> Iterable[tuple[int, int, str]]:
    """Runs of digit words become digits; the signs between stay where they part numbers."""
    for m in _SPELLED.finditer(text):
        words = [t for t in _TOKEN.finditer(text, m.start(), m.end())]
        if not any(t[2] for t in words):
            continue
        for t in words:
            if t[1]:
                yield *t.span(), "+"
            elif t[2]:
                yield *t.span(), NUMBER_WORDS[t[2].lower()]
            elif t[4]:
                yield *t.span(), "."
            elif t[5] and t[5] not in ".+":
                yield *t.span(), ""


def _with_blanks(text: str, a: int, b: int) -> tuple[int, int]:
    while a > 0 and text[a - 1].isspace():
        a -= 1
    while b < len(text) and text[b].isspace():
        b += 1
    return a, b


def _grow(text: str, at: int, bound: int, step: int, allowed: frozenset[str], dots: dict[int, int]) -> tuple[int, list[int]]:
    """From an at sign outwards: characters of names with dots between them, up to `bound`; the end and the dots passed."""
    end, passed = at, []
    while True:
        here = at
        while here != bound and text[here if step > 0 else here - 1] in allowed:
            here += step
        if here == at:  # a dot needs a name behind it
            return end, passed[:-1]
        end = here
        beyond = dots.get(here)
        if beyond is None or (bound - beyond) * step < 0:
            return end, passed
        passed.append(here)
        at = beyond


def mail_edits(text: str) -> Iterable[tuple[int, int, str]]:
    """`name at host dot org` and its like; a bare `at` needs a disguised dot beside it.

    The signs come first and names grow outwards from each, up to the signs beside it, so that long runs of dots or signs
    cost linear time.
    """
    signs = [(m, *_with_blanks(text, *m.span())) for m in _AT.finditer(text)]
    if not signs:
        return
    dots = {}
    for m in _DOT.finditer(text):
        a, b = m.span() if m[0] == "." else _with_blanks(text, *m.span())
        dots[a, b] = m[0] != "."
    after, before = {a: b for a, b in dots}, {b: a for a, b in dots}
    floor = 0
    for k, (sign, a, b) in enumerate(signs):
        ceiling = signs[k + 1][1] if k + 1 < len(signs) else len(text)
        start, left = _grow(text, a, floor, -1, _MAIL_CHARS, before)
        end, right = _grow(text, b, max(b, ceiling), 1, _HOST_CHARS, after)
        floor = max(floor, b)
        if start == a or not right:
            continue
        spans = [(before[i], i) for i in reversed(left)] + [(a, b)] + [(i, after[i]) for i in right]
        hard = any(dots.get(s) for s in spans)
        if (sign["word"] or (a, b) == sign.span() and sign[0] == "@") and not hard:
            continue
        for s in spans:
            if s == (a, b):
                yield *s, "@"
            elif dots[s]:
                yield *s, "."
        floor = max(floor, end)


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans found only in the rewritten text, in source offsets."""
    strange, spelled, mail, letters = triggers(text)
    if not (strange or spelled or mail or letters):
        return []
    tape = Tape(text)
    if strange:
        tape.rewrite(plain_edits(tape.text))
    if strange or letters:
        tape.rewrite((*m.span(), "0" if m[0] in "Oo" else "1") for m in _LETTER_DIGITS.finditer(tape.text))
    if strange or spelled:
        tape.rewrite(spelled_edits(tape.text))
    if strange or mail:
        tape.rewrite((*m.span(), ".") for m in _NUMBER_DOT.finditer(tape.text))
        tape.rewrite(mail_edits(tape.text))
    if tape.text == text:
        return []
    taken = {kind: sorted((s, e) for k, s, e in base if k == kind) for kind in KINDS}
    out = []
    for kind, a, b in base_spans(tape.text):
        start, end = tape.starts[a], tape.ends[b - 1]
        if tape.text[a:b] == text[start:end]:
            continue
        own = taken[kind]
        at = bisect_right(own, (start, len(text) + 1))
        if at and own[at - 1][1] >= end:  # a base span says it all
            continue
        out.append((kind, start, end))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone` (base spans), `base_sha256`, `spans` (all spans), `n_hidden`, `found` (any span)."""

    def make() -> Callable[[list[str]], Iterable[tuple]]:
        def work(texts: list[str]) -> Iterable[tuple]:
            for text in texts:
                base = base_spans(text)
                hidden = hidden_spans(text, base)
                kinds = [k for k, *_ in base]
                yield (*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(),
                       written(base + hidden), len(hidden), bool(base or hidden))
        return work

    return map_texts(frame(docs, id_col, text_col), make, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                     "base_sha256 string, spans string, n_hidden bigint, found boolean")

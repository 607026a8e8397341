"""Personal data behind disguises, found with offsets into the source text.

A text passes a chain of transducers. Each rewrites some spans and keeps, for
every character of its output, the source span that it came from:

1. homoglyphs, full-width and styled letters and digits become ASCII, invisible
   characters vanish;
2. spelled digits ("four one double five") become digits;
3. at/dot disguises ("name (at) mail [dot] org") become an address.

Detectors then run on the normalised text, and what they find is mapped back to
the smallest source span that covers it.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm import names

# ---- alphabets -------------------------------------------------------------------

_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏոԛԝАВЕКМНОРСТУХІЈЅԌΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονικρτυχ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९ıɡℓ‐‑‒–—−⁻﹣․‚ꓸ",
        "aeopcyxijsdhlnqwABEKMHOPCTYXIJSGABEZHIKMNOPTYXaovikptuxO123456789O123456789O123456789igl--------.,.",
        strict=True,
    )
)
for _c in "٠۰०":
    _LOOKALIKES[_c] = "0"
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤︎️﻿"


def _table() -> dict[int, str]:
    out = {ord(k): v for k, v in _LOOKALIKES.items()}
    for lo, hi in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x2460, 0x24EB), (0x2070, 0x209D), (0x1F100, 0x1F190), (0x2100, 0x214F), (0xFE50, 0xFE6F)):
        for c in range(lo, hi):
            plain = unicodedata.normalize("NFKC", chr(c))
            plain = plain.strip("().") if len(plain) > 1 else plain
            if len(plain) == 1 and ord(plain) < 128:
                out.setdefault(c, plain)
    for c in (0x00A0, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x205F, 0x3000):
        out[c] = " "
    return out


GLYPHS = _table()
_HIDDEN = re.compile(f"[{_INVISIBLE}]")

_WORDS = {
    "0": "zero oh null nul cero zéro",
    "1": "one eins ein une un uno",
    "2": "two zwei zwo deux dos",
    "3": "three drei trois tres",
    "4": "four vier quatre cuatro",
    "5": "five fünf fuenf cinq cinco",
    "6": "six sechs seis",
    "7": "seven sieben sept siete",
    "8": "eight acht huit ocho",
    "9": "nine neun neuf nueve",
}
_DIGIT = {w: d for d, ws in _WORDS.items() for w in ws.split()}
_MARK = {"plus": "+", "dash": "-", "hyphen": "-", "minus": "-", "tiret": "-", "guion": "-", "strich": "-"}
_TIMES = {"double": 2, "triple": 3, "doppel": 2, "doble": 2}
_SPOKEN = "|".join(sorted([*_DIGIT, *_MARK, *_TIMES], key=len, reverse=True))
_STRONG = "|".join(sorted(_DIGIT, key=len, reverse=True))
_TOKEN = re.compile(rf"(?<![^\W\d_])(?:{_SPOKEN})(?![^\W\d_])|\d+", re.I)
_GAP = r"[ \t.,\-_/()]*"
#: A run of spelled digits, digits and marks; ``_spell`` says which count.
_RUN = re.compile(rf"(?<![^\W_])(?:\+?(?:{_SPOKEN}|\d)(?![^\W\d_])(?:{_GAP}(?:(?:{_SPOKEN})(?![^\W\d_])|\d))*)", re.I)

_AT = r"(?:at|arroba|ät|aet|arobase)"
_DOT = r"(?:dot|punkt|punto|point|punt)"
_OPEN, _CLOSE = r"[(\[{<|*]", r"[)\]}>|*]"
#: Blanks are only scanned from the start of their run, so that a long run is read once.
_LEAD = r"(?<!\s)\s"
_AT_ANY = rf"(?:(?<!\s)\s+|(?<!\s))(?:@|{_OPEN}\s*(?:{_AT}|@)\s*{_CLOSE})\s*|{_LEAD}+{_AT}\s+"
_DOT_ANY = rf"\.|(?:(?<!\s)\s+|(?<!\s)){_OPEN}\s*(?:{_DOT}|\.)\s*{_CLOSE}\s*|{_LEAD}+{_DOT}\s+"
_LABEL = r"[^\W_](?:[\w\-]{0,61}[^\W_])?"
#: An at sign or its disguise with a host behind it; what stands before is looked at only then.
_HOST = re.compile(rf"(?P<at>{_AT_ANY})(?P<host>{_LABEL}(?:(?:{_DOT_ANY}){_LABEL})+)", re.I)
_LOCAL = re.compile(rf"[^\W_](?:[\w.+%\-]*\w)?(?:(?:{_LEAD}+{_DOT}\s+|(?:(?<!\s)\s+|(?<!\s)){_OPEN}\s*(?:{_DOT}|\.)\s*{_CLOSE}\s*)[\w+%\-]+)*\Z", re.I)
_LOCAL_LOOK, _DISGUISE = 160, 8
_DOT_FIND = re.compile(_DOT_ANY, re.I)
_PLAIN_AT = re.compile(rf"\s+{_AT}\s+", re.I)

# RE2 pre-filters, run by Arrow over whole columns: a text that they all miss has nothing to find
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"  # what Python's \s takes
HAS_SIGN = rf"[@\p{{Nd}}]|(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key){_BLANK}*[=:]"
#: Every character that ``normalise`` undoes, and the capital I with a dot, which Python's re takes for an i.
HAS_GLYPH = "[" + "".join(rf"\x{{{c:X}}}" for c in sorted({*GLYPHS, *map(ord, _INVISIBLE), 0x130}) if c > 127) + "]"
HAS_DISGUISE = rf"(?i:(?:{_BLANK}|{_OPEN}{_BLANK}*){_DOT}(?:{_BLANK}|{_BLANK}*{_CLOSE})|{_OPEN}{_BLANK}*(?:\.|@|{_AT}){_BLANK}*{_CLOSE})"
# a run that counts has four members or more, one of them a spelled digit
_MEMBER = rf"(?:{_SPOKEN}|\p{{Nd}})"
_NEXT = rf"(?:{_GAP}{_MEMBER})"
_BEFORE = rf"(?:{_MEMBER}\+?{_GAP}\+?)"
HAS_SPELLED = "(?i:" + "|".join(rf"{_BEFORE}{{{n}}}(?:{_STRONG}){_NEXT}{{{3 - n}}}" for n in range(4)) + ")"


class Mapped:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        # pieces: start in text, start in source, source length; equal lengths map 1:1
        self._at, self._src, self._len = [0], [0], [len(text)]
        self._end = [len(text)]

    def rewrite(self, spans: list[tuple[int, int, str]]) -> "Mapped":
        """Replaces disjoint, ascending spans (start, end, new text)."""
        if not spans:
            return self
        out = Mapped("")
        out._at, out._src, out._len, out._end = [], [], [], []
        parts, pos, size = [], 0, 0

        def copy(a, b):
            nonlocal size
            while a < b:
                k = bisect_right(self._at, a) - 1
                stop = min(b, self._end[k])
                piece = stop - a
                one = self._end[k] - self._at[k] == self._len[k]
                out._at.append(size)
                out._src.append(self._src[k] + (a - self._at[k]) if one else self._src[k])
                out._len.append(piece if one else self._len[k])
                size += piece
                out._end.append(size)
                a = stop
            return

        for a, b, new in spans:
            copy(pos, a)
            parts += [self.text[pos:a], new]
            if new:
                lo, hi = self.source(a, b)
                out._at.append(size)
                out._src.append(lo)
                out._len.append(hi - lo)
                size += len(new)
                out._end.append(size)
            pos = b
        copy(pos, len(self.text))
        parts.append(self.text[pos:])
        out.text = "".join(parts)
        return out

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of text[start:end]; a piece that isn't 1:1 comes whole."""
        i, j = bisect_right(self._at, start) - 1, bisect_right(self._at, end - 1) - 1
        one = lambda k: self._end[k] - self._at[k] == self._len[k]
        lo = self._src[i] + (start - self._at[i] if one(i) else 0)
        hi = self._src[j] + (end - self._at[j] if one(j) else self._len[j])
        return lo, hi


_NUMBER = re.compile(r"\d{10}|[01]\d{10}")


def _digits(tokens: list[re.Match]) -> str:
    out, times = "", 1
    for t in tokens:
        w = t.group(0).lower()
        if w not in _TIMES and w not in _MARK:
            out += _DIGIT.get(w, w) * times
        times = _TIMES.get(w, 1)
    return out


def _plain(text: str) -> bool:
    """Whether a detector finds something in the text as it is."""
    return any(check(m.group(1 if p.groups else 0)) is not None for _, p, check in DETECTORS for m in p.finditer(text))


def _spell(m: re.Match) -> list[tuple[int, int, str]]:
    """Rewrites of one run of spelled digits: a digit a word, gaps between digits closed.

    A run counts with four spelled words, or with fewer if its digits are as
    many as a phone number's and it doesn't hold an identifier as it stands.
    """
    run = m.group(0)  # taken once: a run may be as long as the text
    tokens = list(_TOKEN.finditer(run))
    words = sum(t.group(0).lower() in _DIGIT for t in tokens)
    if not words or words < 4 and (not _NUMBER.fullmatch(_digits(tokens)) or _plain(run)):
        return []
    spans, times, before = [], 1, None
    for t in tokens:
        w = t.group(0).lower()
        if w in _TIMES:
            times = _TIMES[w]
            new = ""
        else:
            new = (_DIGIT.get(w) or _MARK.get(w) or w) * (times if w not in _MARK else 1)
            times = 1
        gap = run[before : t.start()] if before is not None else ""
        if before is not None and gap and not re.search(r"[.\-()/]", gap):
            # a comma tells groups of digits apart
            spans.append((m.start() + before, m.start() + t.start(), "-" if "," in gap else ""))
        if new != t.group(0):
            spans.append((m.start() + t.start(), m.start() + t.end(), new))
        before = t.end()
    return spans


def _address(text: str, m: re.Match) -> list[tuple[int, int, str]]:
    host, labels, dots, spelled, last = m.group("host"), [], [], False, 0
    for d in _DOT_FIND.finditer(host):
        labels.append(host[last : d.start()])
        dots.append(d)
        spelled |= d.group(0) != "."
        last = d.end()
    labels.append(host[last:])
    if _PLAIN_AT.fullmatch(m.group("at")) and not spelled:
        return []  # "look at example.com" is no address
    if not re.fullmatch(r"[^\W\d_]{2,24}", labels[-1]):
        return []
    at, look = m.start("at"), _LOCAL_LOOK
    while True:
        low = max(0, at - look)
        local = next(_LOCAL.finditer(text[low:at]), None)
        # it may go on before what was looked at, where less stands before it than a dot's disguise
        if local is None or not low or len("".join(text[low : low + local.start()].split())) > _DISGUISE:
            break
        look *= 4
    if local is None:
        return []
    spans = [(low + local.start() + d.start(), low + local.start() + d.end(), ".") for d in _DOT_FIND.finditer(local.group(0)) if d.group(0) != "."]
    if m.group("at") != "@":
        spans.append((*m.span("at"), "@"))
    return spans + [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in dots if d.group(0) != "."]


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Rewrites of all disguised addresses, disjoint and ascending."""
    out, end = [], 0
    for m in _HOST.finditer(text):
        for s in _address(text, m):
            if s[0] >= end:
                out.append(s)
                end = s[1]
    return out


def normalise(text: str, spelled: bool = True, disguised: bool = True) -> Mapped:
    """The text with its disguises undone; those that it is known not to have needn't be looked for."""
    plain = text.translate(GLYPHS) if not text.isascii() else text
    out = Mapped(plain)  # the table maps one character to one
    if not text.isascii():
        out = out.rewrite([(m.start(), m.end(), "") for m in _HIDDEN.finditer(plain)])
    if spelled:
        out = out.rewrite([s for m in _RUN.finditer(out.text) if len(m.group(0)) > 9 for s in _spell(m)])
    return out.rewrite(_addresses(out.text)) if disguised else out


# ---- detectors -------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


_ISSUER = re.compile(
    r"4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|(?:6011|65\d\d|64[4-9]\d)\d{12}|35(?:2[89]|[3-8]\d)\d{12}|62\d{14,17}"
)


def _card(s: str) -> str | None:
    d = re.sub(r"[ \-.]", "", s)
    return d if _ISSUER.fullmatch(d) and luhn(d) else None


def _iban(s: str) -> str | None:
    v = re.sub(r"[ \-]", "", s).upper()
    if not 15 <= len(v) <= 34:
        return None
    return v if int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 else None


def _ip(s: str) -> str | None:
    try:
        return str(ipaddress.ip_address(s))
    except ValueError:
        return None


def _phone(s: str) -> str | None:
    d = re.sub(r"\D", "", s)
    return ("+" if s.startswith("+") else "") + d if 10 <= len(d) <= 15 else None


def _spelled_phone(s: str) -> str | None:
    d = re.sub(r"\D", "", s)
    return d if len(set(d)) > 1 else None  # "un un un ..." is a word said again


def _ssn(s: str) -> str | None:
    a, b, c = s.split("-")
    return None if a in ("000", "666") or a > "899" or b == "00" or c == "0000" else s


DETECTORS = [
    ("secret", re.compile(r"(?<!\w)(?:(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\s*[=:]\s*[\"']?)([A-Za-z0-9_\-+/]{16,}={0,2})", re.I), str),
    ("email", re.compile(r"(?<![\w.+%\-])[^\W_](?:[\w.+%\-]{0,63}\w)?@(?:[^\W_](?:[\w\-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?![\w\-])"), str.lower),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ \-]?[A-Z0-9]{4}){2,7}(?:[ \-]?[A-Z0-9]{1,3})?(?!\w)"), _iban),
    ("card", re.compile(r"(?<![\w.+\-])\d(?:[ \-.]?\d){12,18}(?![\w\-]|\.\d)"), _card),
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"), _ip),
    ("ssn", re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"), _ssn),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|(?<!\d )[2-9]\d{2} [2-9]\d{2} \d{4}(?! \d))(?![\w\-]|\.\d)"), _phone),
]
_SEP = r"[ .\-()/]{0,3}"
#: A phone number without a plus or groups; it counts only where words stood for digits.
_SPELLED_PHONE = re.compile(rf"(?<![\w+])(?:(?:[01]{_SEP})?\d(?:{_SEP}\d){{9}}|\d{{11}})(?!\w|{_SEP}\d)")


def find(text: str, spelled: bool = True, disguised: bool = True) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value): source offsets in characters, normalised value.

    Where findings overlap the one of the earlier detector stays.
    """
    norm = normalise(text, spelled, disguised)
    taken: list[tuple[int, int]] = []  # ascending and disjoint
    out = []
    for kind, pattern, check in [*DETECTORS, ("phone", _SPELLED_PHONE, _spelled_phone)] if spelled else DETECTORS:
        if kind == "email" and "@" not in norm.text:
            continue
        for m in pattern.finditer(norm.text):
            g = 1 if pattern.groups else 0
            value = check(m.group(g))
            if value is None:
                continue
            a, b = m.span(g)
            if pattern is _SPELLED_PHONE and not re.search(r"[^\W\d_]", text[slice(*norm.source(a, b))]):
                continue
            k = bisect_right(taken, (a, b))
            if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                continue
            taken.insert(k, (a, b))
            out.append((kind, *norm.source(a, b), value))
    return sorted(out, key=lambda f: (f[1], f[2]))


def _rows(batches):
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        has = [pc.fill_null(pc.match_substring_regex(texts, x), False) for x in (HAS_SIGN, HAS_GLYPH, HAS_DISGUISE, HAS_SPELLED)]
        sign, glyph, disguise, spelled = has
        at = pc.indices_nonzero(pc.or_(pc.or_(sign, glyph), pc.or_(disguise, spelled)))
        row, kind, start, end, value, source = [], [], [], [], [], []
        spell, address = pc.or_(glyph, spelled).take(at).to_pylist(), pc.or_(glyph, disguise).take(at).to_pylist()
        for i, text, s, d in zip(at.to_pylist(), texts.take(at).to_pylist(), spell, address):
            for k, a, z, v in find(text, s, d):
                row.append(i), kind.append(k), start.append(a), end.append(z), value.append(v), source.append(text[a:z])
        if row:
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(kind), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value), pa.array(source)], ["doc_id", "kind", "start", "end", "value", "source_text"]
            )


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kind, start, end, value, source_text) of every identifier.

    ``start`` and ``end`` count characters of the source text from 0, ``end``
    exclusive; ``source_text`` is what stands there, ``value`` its plain form.
    Kinds: secret, email, iban, card, ip, ssn, phone.

    Null and empty texts have none. A null id stays null; repeated rows are
    reported each. Other columns are ignored; an empty table gives no rows.
    Texts are read whole; nothing is shuffled.
    """
    rows = docs.select(names.col(docs, doc_id).cast("long").alias("doc_id"), names.col(docs, text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(_rows, "doc_id long, kind string, start int, end int, value string, source_text string")

"""Personal information in free text: find it, and replace it by typed placeholders.

Items are found by the formats of e-mail addresses, telephone numbers, identity
numbers and street addresses, written, disguised or spoken, and names by the
words that introduce or follow them.  Cheap tests decide which of the patterns a
text is searched for; each is implied by a match of its pattern, so none is lost.

Replacement is format-preserving: digits and letters of numbers and dates run
through a keyed Feistel permutation of their format, separators stay, and valid
values (numbering plan, areas, check digits, dates) become valid ones.  E-mail
addresses, addresses and names get a keyed tag.  Equal values thus keep equal
placeholders in every document, and the key undoes the numbers.

Defined results: null and blank texts have no items and stay as they are; a
repeated row counts once; offsets count code points, end exclusive; of
overlapping items the longer stays, then the earlier; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- formats ----------------------------------------------------------------------------------------------------------

_I = re.IGNORECASE
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s)"
_EMAIL = re.compile(
    rf"[a-z0-9][a-z0-9._+'-]*\s?(?:@|＠|&#64;|&commat;|[\[({{]\s?at\s?[\])}}])\s?[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}(?![a-z0-9])",
    _I | re.ASCII,
)
_JOIN = r"\s(?:dot|underscore|dash|hyphen|minus|plus)\s"
_EMAIL_SAID = re.compile(
    rf"(?<![a-z0-9._+-])[a-z0-9][a-z0-9._+-]*(?:{_JOIN}[a-z0-9._+-]+)*\sat\s[a-z0-9-]+(?:{_JOIN}[a-z0-9-]+)*\sdot\s[a-z]{{2,}}(?![a-z0-9])(?!{_JOIN}|\sat\s)",
    _I | re.ASCII,
)

_EXT = r"(?:,?\s?(?:ext\.?|extension|x)\s?\d{1,6})"
_L, _R = r"(?<![0-9a-zA-Z_$#/.,§-])", r"(?![0-9a-zA-Z_%]|[-/.,]\d)"
_PHONE = re.compile(
    rf"(?<![0-9a-zA-Z_$#§/-])(?:\+\d{{1,3}}(?:[ .\-/]?\(?\d{{1,5}}\)?){{2,5}}"
    rf"|(?:1[ .-])?\(\d{{3}}\)\s?\d{{3}}[ .-]\d{{4}}|(?:1[ .-])?\d{{3}}([ ./-])\d{{3}}\1\d{{4}}|0\d{{2,4}} \d{{3,4}} \d{{3,4}}"
    rf"|1?\d{{10}}){_EXT}?{_R}|{_L}\d{{3}}[ .-]\d{{4}}{_EXT}{_R}",
    _I,
)
_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple)"
_PAUSE = r"(?:[\s,.-]+(?:(?:u+h+|u+m+|e+r+m*|a+h+|h+m+|like|you know|i mean|kind of)[\s,]+)*)"
_PHONE_SAID = re.compile(rf"(?<!\w){_DIGIT}(?:{_PAUSE}{_DIGIT}){{6,14}}(?!\w)(?:,?\s(?:extension|ext\.?)\s{_DIGIT}(?:{_PAUSE}{_DIGIT}){{0,4}})?", _I)

_ID_SAID = re.compile(r"\b(?:file|case|passport|social(?: security)?|receipt|record|id|identity|permit|alien|visa) (?:number|no\.?|card)?", _I)

_ID = re.compile(
    rf"{_L}(?:[a-z]{{3}}-\d{{2}}-\d{{3}}-\d{{5}}|[a-z]{{3}}\d{{10}}|[a-z]-\d{{3}}-\d{{3}}-\d{{3}}|[a-z]-\d{{7}}-[a-z]|[a-z] ?\d{{2}} \d{{4}} \d{{4}}|[a-z] \d{{3}} \d{{3}} \d{{3}}|[a-z]{{3}} \d{{2}} \d{{3}} \d{{5}}"
    rf"|[a-z]{{2}} ?\d{{7}}|[a-z]\d{{7,10}}|\d{{3}}([ .-])\d{{2}}\1\d{{4}}|\d{{4}}(?P<gap>[ -])\d{{4}}(?P=gap)\d{{4}}(?P=gap)\d{{4}}|\d{{4}} \d{{4}} \d{{4}}(?! \d{{4}}(?!\d))|\d{{9}}){_R}",
    _I,
)

#: What streets are called.
_STREETS = "street|st|avenue|ave|road|rd|row|lane|ln|boulevard|blvd|court|ct|crescent|way|drive|dr|terrace|place|square|close|parkway"
#: Words before "place" and "close" that make them no street.
_NO_STREET = r"(?:takes?|taken|taking|took|in|first|a|to|will|would|could|can|is|are|was|were|be|so|too|very|not)\s(?:place|close)\b"
#: Words after an address that are no place.
_NO_PLACE = r"(?!(?:near|not|but|and|from|who|the|which|or|in|for|so|until|while|where|with|evenings|to|is|was|at|on|since|we|i|my|it)\b)"
_PLACE = rf"{_NO_PLACE}[^\W\d_][\w'’-]+"
_POST = r"(?:[a-z]{2}\s)?\d{5,6}(?!\d)"
#: What is counted rather than numbered.
_COUNTED = r"(?:days?|weeks?|months?|years?|semesters?|hours?|pages?|percent|million|students?|schools?|people|of|jours?|semaines?|mois|ans|d[ií]as|semanas|meses|años|tage|wochen)\b"
_UNIT = r"(?:apt|apartment|unit|suite|flat|room|floor|no)\.?\s?#?\w{1,5}"
_TAIL = rf"(?:,?\s{_UNIT}(?!\w))?(?:,\s{_PLACE}(?:,?\s{_POST})?|\sin\s(?-i:[A-Z])[\w'’-]+)?"
_FLAT_BEFORE = re.compile(r"(?<!\w)(?:flat|apt\.?|unit|room)\s\d+\w?,\s$", _I)
#: (substrings of the lower-cased text, one of which any match has; pattern); without substrings the pattern begins with a digit, so that scanning jumps from number to number.
_ADDRESSES = [
    (
        (),
        re.compile(
            rf"\d(?<![\w$#.,/-]\d)\d{{0,4}}[a-z]?\s(?!{_COUNTED})(?:[nsew]\.?\s)?(?:(?!(?:{_STREETS})\b|{_NO_STREET})[^\W\d_][\w'’-]*\s){{1,3}}(?:{_STREETS})\b\.?{_TAIL}",
            _I,
        ),
    ),
    (("colony", "nagar", "enclave", "layout", "vihar"), re.compile(rf"(?<!\w)h\.?\s?no\.?\s?\d[\d/-]*,\s[^\W\d_]\w*\s(?:colony|nagar|enclave|layout|vihar)(?:,\s{_PLACE}(?:\s{_POST})?)?", _I)),
    (("box",), re.compile(rf"(?<!\w)p\.?\s?o\.?\sbox\s\d+(?:,\s{_PLACE}(?:,?\s{_POST})?)?", _I)),
    (("weg", "straße", "strasse", "gasse", "allee", "platz"), re.compile(rf"(?<!\w)[^\W\d_]+(?:weg|straße|strasse|gasse|allee|platz)\s\d+\w?(?:,\s(?:\d{{5}}\s)?{_PLACE})?", _I)),
    (
        ("calle", "avenida", "paseo", "plaza"),
        re.compile(rf"(?<!\w)(?:calle|avenida|paseo|plaza)\s(?:del?\s|la\s|las\s|los\s)*[^\W\d_]+\s\d+(?:,\s\d+\s?[ºª°]\s?\w)?(?:,\s(?:\d{{5}}\s)?{_PLACE})?", _I),
    ),
    (
        (),
        re.compile(rf"\d(?<![\w$#.,/-]\d)\d{{0,3}}(?:\s(?:bis|ter))?,\s(?:rue|avenue|boulevard|place|quai|chemin)\s(?:du\s|de\s|des\s|la\s|l['’])*[^\W\d_][\w'’-]*(?:,\s(?:\d{{5}}\s)?{_PLACE})?", _I),
    ),
]

# -- names ------------------------------------------------------------------------------------------------------------

#: Words that start sentences after a signature and are no surnames.
_NO_NAME = (
    "the|a|an|i|we|my|our|your|his|her|it|its|it's|if|in|at|as|to|by|for|from|no|not|nobody|please|do|don't|let|this|that|these|those|why|who|what|when|"
    "thank|thanks|call|text|pages|receipt|passport|old|new|use|section|fee|and|or|but|with|on|of|is|are|was|were|three|families|small|good|fraud|security|schools|"
    "however|frankly|again|meanwhile|about|after|before|regards|sincerely|signed|respectfully|send|forward|write|reply|doctoral|visiting|visitors|students|nursing|"
    "exchange|community|program|laboratory|language|first-year|foreign|host|postdoctoral|advisers|until|took|take|they|there|you|whatsapp|docket|form|dr|mr|mrs|ms|"
    "prof|wake|lol|mark-my|stop|shut|go|kiss|round|only|every|people|hot|bend|someone|women|while|since|many|most|some|all|has|have|can|will|would|should|ask|near|"
    "br|nbsp|p|here|left|lost|cite|security|apoyo|pido|soy|las|los|je|ich|die|das|bitte|les|veuillez|una|el|la|le|der|und|me|mi|su"
)
_G = rf"(?!(?:{_NO_NAME})(?![\w'’-]))[^\W\d_](?:[\w'’-]*[^\W\d_])"
_IN = r"[^\W\d_]\."
_PART = r"(?:(?:de la|de los|van der|van den|van|von|de|del|da|di|al|bin|ter) )"
_N = rf"(?:{_PART}?{_G}, {_G}(?: {_IN})*|{_G}(?: {_IN}){{1,2}} {_PART}?{_G}|(?:{_IN} ?){{1,2}}{_PART}?{_G}|{_G} {_PART}?{_G}|{_G})"
_TITLE = r"(?:(?:dr|prof|mr|mrs|ms|miss|sir|rev)\.?\s)?"
_ID_AHEAD = r"(?=\s\([a-z]{0,3}[\d -])"


def _cue(before: str, after: str = r"(?![\w'’-])") -> re.Pattern[str]:
    return re.compile(rf"{before}{_TITLE}(?P<n>{_N}){after}", _I)


_KIN = "wife|husband|partner|spouse|son|daughter|brother|sister|mother|father|roommate|neighbo(?:u)?r|friend|colleague|lawyer|attorney|adviser|advisor|student|cousin|boss|landlord|landlady|supervisor|professor|client|patient|tenant"
#: (substrings of the lower-cased text, one of which any match has, or a pattern that it has; pattern).
_NAME_CUES: list[tuple[tuple[str, ...] | re.Pattern[str], re.Pattern[str]]] = [
    (("name is",), _cue(r"\bname is ", r"(?=[,.;]?\s|$)")),
    (("me llamo",), _cue(r"\bme llamo ", r"(?=\sy\b|[,.])")),
    (("mein name", "ich heiße"), _cue(r"\b(?:mein name ist|ich heiße) ", r"(?=[,.])")),
    (("m'appelle", "m’appelle"), _cue(r"\bm['’]appelle ", r"(?=[,.])")),
    (("меня зовут",), _cue(r"меня зовут ", r"(?=[,.])")),
    (("मेरा नाम",), re.compile(r"मेरा नाम (?P<n>[ऀ-ॿ]+(?: [ऀ-ॿ]+){0,2}?) है")),
    (("我叫", "我是", "找"), re.compile(r"(?:我叫|电话[^，。]{5,40}找)(?P<n>[一-鿿·]{2,5}?)(?=[，。,. ]|$)")),
    (("私は", "名前は"), re.compile(r"(?:名前は|私は)(?P<n>[一-鿿ァ-ヶー ]{2,9}?)(?:です|と申)")),
    (("sincerely", "regards", "signed", "yours", "wishes", "cheers"), _cue(r"(?:sincerely|regards|signed|yours|yours truly|best wishes|cheers)[,:]\s*(?:<br ?/?>)?\s*")),
    (("submitted by",), _cue(r"\bsubmitted by ", r"(?=,)")),
    (("—", "–", "--"), _cue(rf"(?:—|–|--)(?:(?=\s{_N}\s*(?:$|\n|<))|" r"(?<=[\n>.!?)] .)|(?<=[\n>.!?)].)|(?<=^.)|(?<=[\n>.!?)]  .))\s", r"(?=\s*(?:$|[\n<]|[.!]|\s[^\W\d_]))")),
    (("thanks, ",), _cue(r"\bthanks, ", rf"(?:{_ID_AHEAD}|(?=\s*(?:$|[\n<.])))")),
    (re.compile(r"\s\((?:[a-z]{0,3}[-\d][\d -]{5}|[a-z]{2} \d{7}|[a-z]-\d{7})"), _cue(r"(?:^|[\n>.!?]\s*)", r"(?=\s\((?:[a-z]{0,3}[-\d][\d -]{5,}[a-z]?|[a-z]{2} \d{7}|[a-z]-\d{7}-[a-z])\))")),
    (re.compile(r"\|\s[+(]?\d"), _cue(r"(?<![\w'’-])", r"(?=\s\|\s[+(]?\d)")),
    (re.compile(rf"my (?:{_KIN}) \("), _cue(rf"\bmy (?:{_KIN}) \(", r"(?=\))")),
    (("my ",), _cue(rf"\bmy (?:{_KIN}),? ", r"(?=,?\s(?:lost|has|had|is|was|left|got|works|wrote|said|told|can|could|will|would|and)\b)")),
    (("of mine, ", "of ours, "), _cue(r"\bof (?:mine|ours), ", r"(?=,)")),
    (("i'm ", "i’m ", "this is "), re.compile(rf"\b(?:i['’]m|this is) {_TITLE}(?P<n>(?={_G} |{_IN} ?){_N})(?=,? and i\b|,? (?:from|here|calling|speaking)\b|, (?:an?|the|your)\b)", _I)),
    (("since ",), _cue(r"\bsince ", r"(?=\s(?:left|moved|retired|is|was|has)\b)")),
    (("share a", "live with", "room with"), _cue(r"\b(?:share an? [a-z]+ with|live with|room with) ", r"(?=\s(?:at|in|on)\b|[,.])")),
    (("for the file", "for the record"), _cue(r"\bfor the (?:file|record): ", r"(?=,)")),
    (("ask ",), _cue(r"\bask ", r"(?=,?\swho\b)")),
    (re.compile(r"(?:can|will)\s(?:confirm|vouch)"), _cue(r"(?<![\w'’,-])", r"(?=\s(?:can|will)\s(?:confirm|vouch)\b)")),
    ((" here, a ", " here, an "), re.compile(rf"(?<![\w'’,-])(?P<n>(?={_G},? (?:{_IN} )*{_PART}?{_G} here|{_IN} {_PART}?{_G} here){_N})(?= here, an? )", _I)),
    (re.compile(r"here,\s(?:an?|the|one)"), _cue(r"(?:^|[\n>.!?)]\s*)", r"(?=\shere,\s(?:an?|the|one)\b)")),
    (re.compile(r"(?:were|are|have|had)\sboth"), re.compile(rf"(?<![\w'’,-])(?P<n>{_N}) and (?P<m>{_N})(?=\s(?:were|are|have|had)\sboth\b)", _I)),
]
_FROM = re.compile(rf"\sfrom\s{_TITLE}(?P<n>{_N})(?=\s*(?:[.,<\n]|$)|\s(?-i:[A-Z]))", _I)
_LINE_NAME = re.compile(rf"(?P<n>{_N})\s*$", _I)

_LONG_NUMBER = re.compile(r"\d(?:[^\w\n]{0,3}\w?\d){6}")
_AT_IN_BRACKETS = re.compile(r"[\[({]\s?at\s?[\])}]")
_DIGIT_WORDS = tuple(_DIGIT[3:-1].split("|"))
#: Letters that match another one without regard to case but aren't lower-cased to it; a text with one is searched for all patterns.
_ODD = re.compile("[İıſﬅﬆ\u1c80-\u1c88]")

Item = tuple[int, int, str]


def _signature_names(text: str, low: str, out: list[Item]) -> None:
    """A line that is nothing but a name, right before or after a line that is nothing but an item."""
    lines, at = [], 0
    for line in re.split(r"(\n+|<br ?/?>)", text):
        lines.append((at, line))
        at += len(line)
    starts = {a for a, _, kind in out if kind != "NAME"}
    for n, (start, line) in enumerate(lines[:-2]):
        below = lines[n + 2]
        if below[0] in starts and (m := _LINE_NAME.match(line)):
            out.append((start + m.start("n"), start + m.end("n"), "NAME"))


def find(text: str | None) -> list[Item]:
    """(start, end, type) of every item, in order, none overlapping."""
    if not text:
        return []
    low = text.lower()
    odd = not text.isascii() and _ODD.search(text) is not None
    out: list[Item] = []
    if "@" in text or "&#64;" in text or "＠" in text or "&commat;" in low or _AT_IN_BRACKETS.search(low):
        out += [(*m.span(), "EMAIL") for m in _EMAIL.finditer(text)]
    if "dot" in low:
        out += [(*m.span(), "EMAIL") for m in _EMAIL_SAID.finditer(text)]
    long = _LONG_NUMBER.search(text) is not None
    if long:
        out += [(*m.span(), "ID_NUMBER") for m in _ID.finditer(text)]
    if long or "+" in text:
        for m in _PHONE.finditer(text):
            a, b = m.span()
            if 7 <= sum(c.isdigit() for c in m[0]) <= 18:
                out.append((a, b, "PHONE"))
    if odd or sum(map(low.count, _DIGIT_WORDS)) >= 7:
        for m in _PHONE_SAID.finditer(text):
            n = len(re.findall(_DIGIT, m[0], _I)) + len(re.findall("double|triple", m[0], _I))
            called = _ID_SAID.search(text, max(0, m.start() - 60), m.start())
            out.append((*m.span(), "ID_NUMBER" if called or n in (8, 9) else "PHONE"))
    for gates, pattern in _ADDRESSES:
        if odd or not gates or any(g in low for g in gates):
            for m in pattern.finditer(text):
                a, b = m.span()
                if (f := _FLAT_BEFORE.search(text, max(0, a - 16), a)) is not None:
                    a = f.start()
                out.append((a, b, "ADDRESS"))
                if (f := _FROM.match(text, b)) is not None:
                    out.append((f.start("n"), f.end("n"), "NAME"))
    if out and ("\n" in text or "<br" in low):
        _signature_names(text, low, out)
    for gates, pattern in _NAME_CUES:
        if odd or (any(g in low for g in gates) if isinstance(gates, tuple) else gates.search(low)):
            for m in pattern.finditer(text):
                out.append((m.start("n"), m.end("n"), "NAME"))
                if "m" in pattern.groupindex:
                    out.append((m.start("m"), m.end("m"), "NAME"))
    if len(out) < 2:
        return out
    out.sort(key=lambda x: (x[2] == "NAME", x[0] - x[1], x[0]))
    kept: list[Item] = []
    for a, b, kind in out:
        if all(b <= c or a >= d for c, d, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


# -- pseudonyms -------------------------------------------------------------------------------------------------------

_ROUNDS = 8


def _feistel(digits: str, key: bytes, undo: bool = False) -> str:
    """A keyed permutation of the digit strings of this length."""
    return "".join(map(str, _permuted([int(c) for c in digits], [10] * len(digits), key, undo)))


def _permuted(values: list[int], radices: list[int], key: bytes, undo: bool = False) -> list[int]:
    """A keyed permutation of all values of these radices (unbalanced Feistel network over the halves, in mixed radix)."""
    n = len(values)
    if n < 2:
        return values
    u = n // 2
    parts = [(values[:u], radices[:u]), (values[u:], radices[u:])]
    mod = [math.prod(r) for _, r in parts]
    a, b = (functools.reduce(lambda x, vr: x * vr[1] + vr[0], zip(v, r), 0) for v, r in parts)
    shape = "".join("d" if r == 10 else "a" for r in radices).encode()
    for i in reversed(range(_ROUNDS)) if undo else range(_ROUNDS):
        # Even rounds change the left half by the right one, odd rounds the other way round.
        source = b if i % 2 == 0 else a
        f = int.from_bytes(hmac.digest(key, b"%s|%d|%d" % (shape, i, source), "sha256")[:16], "big")
        if i % 2 == 0:
            a = (a - f if undo else a + f) % mod[0]
        else:
            b = (b - f if undo else b + f) % mod[1]
    out: list[int] = []
    for x, (_, rs) in zip((b, a), reversed(parts)):
        for r in reversed(rs):
            x, v = divmod(x, r)
            out.append(v)
    return out[::-1]


def _luhn(d: str) -> bool:
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


#: Validators of digit strings, by (kind, number of digits): numbering plan, areas of social numbers, check digits of cards.
_VALID = {
    ("PHONE", 10): lambda d: d[0] > "1" and d[3] > "1",
    ("ID_NUMBER", 9): lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000",
    ("ID_NUMBER", 16): _luhn,
}


def permute_digits(digits: str, kind: str, key: bytes, undo: bool = False) -> str:
    """A digit string for a digit string of its length: a valid one for a valid one, another for another (walking on until one is met)."""
    valid = _VALID.get((kind, len(digits)), lambda d: True)
    want = valid(digits)
    while True:
        digits = _feistel(digits, key, undo)
        if valid(digits) == want:
            return digits


_COUNTRY = re.compile(r"\+(?:1(?!\d{0,2}[ .\-/(]?\d{0,2}$)|7|\d{1,3}(?=[ .\-/(])|\d\d)|1(?=[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d))")
_EXTENSION = re.compile(rf"{_EXT}$", _I)


def permute_number(value: str, key: bytes, undo: bool = False, kind: str = "PHONE") -> str:
    """The value with its digits and, in identity numbers, letters permuted; other characters stay where they are.

    The country code of a telephone number stays, and its extension is permuted on its own, so a number is linked to
    itself with and without them.
    """
    start, end = 0, len(value)
    tail = ""
    if kind == "PHONE":
        if m := _EXTENSION.search(value):
            end = m.start()
            tail = permute_number(value[end:], key, undo, "EXTENSION")
        if m := _COUNTRY.match(value):
            start = m.end()
    head, body = value[:start], value[start:end]
    if kind == "ID_NUMBER" and any(c.isascii() and c.isalpha() for c in body):
        at = [i for i, c in enumerate(body) if c.isascii() and c.isalnum()]
        letter = [body[i].isalpha() for i in at]
        values = [ord(body[i].lower()) - 97 if x else int(body[i]) for i, x in zip(at, letter)]
        new = _permuted(values, [26 if x else 10 for x in letter], key, undo)
        chars = list(body)
        for i, x, v in zip(at, letter, new):
            chars[i] = (chr(v + 97).upper() if body[i].isupper() else chr(v + 97)) if x else str(v)
        return head + "".join(chars) + tail
    digits = "".join(str(int(c)) for c in body if c.isdecimal())
    new_digits = iter(permute_digits(digits, kind, key, undo))
    return head + "".join(next(new_digits) if c.isdecimal() else c for c in body) + tail


def said_digits(value: str) -> str:
    """The digits of a spoken number; ``double`` and ``triple`` repeat the next one."""
    out, times = "", 1
    for w in re.findall(r"[a-z]+", value.lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        elif w in _WORDS:
            out, times = out + _WORDS[w] * times, 1
    return out


def permute_date(year: int, month: int, day: int, key: bytes, undo: bool = False) -> tuple[int, int, int]:
    """A valid date for a valid date: the day of the century is permuted, walking on until it falls inside the century."""
    import datetime

    first = datetime.date(year - year % 100, 1, 1)
    days = (datetime.date(first.year + 100, 1, 1) - first).days
    d = (datetime.date(year, month, day) - first).days
    while True:
        d = int(_feistel(f"{d:05d}", key, undo))
        if d < days:
            new = first + datetime.timedelta(d)
            return new.year, new.month, new.day


_WORDS = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "|".join(_MONTHS)
_BORN = re.compile(
    rf"\b(?:born(?:\son)?|date\sof\sbirth:?|dob:?)\s(?:(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}})|(?P<d2>\d{{1,2}})\s(?P<m2>{_MONTH})\s(?P<y2>\d{{4}})|(?P<m3>{_MONTH})\s(?P<d3>\d{{1,2}}),?\s(?P<y3>\d{{4}})"
    r"|(?P<m4>\d{1,2})/(?P<d4>\d{1,2})/(?P<y4>\d{4}))\b",
    _I,
)


def placeholder(value: str, kind: str, key: bytes) -> str:
    """Typed placeholder; its digits and letters are equal for values that are equal but for case, spacing, separators and spelling."""
    if kind in ("PHONE", "ID_NUMBER"):
        if any(c.isdecimal() for c in value):
            return f"[{kind} {permute_number(value, key, kind=kind)}]"
        number, *extension = re.split(r",?\s(?:extension|ext\.?)\s", value, flags=_I)
        return f"[{kind} {' x'.join([permute_digits(said_digits(number), kind, key), *(_feistel(said_digits(e), key) for e in extension)])}]"
    plain = value.lower()
    if kind == "EMAIL":
        plain = re.sub(r"\s?(?:&#64;|&commat;|＠|[\[({]\s?at\s?[\])}]|\bat\b)\s?", "@", plain)
        plain = re.sub(r"\s?(?:[\[({]\s?dot\s?[\])}]|\bdot\b)\s?", ".", plain).replace(" underscore ", "_").replace(" dash ", "-").replace(" ", "")
    elif kind == "NAME" and "," in plain:
        plain = " ".join(reversed([p.strip() for p in plain.split(",", 1)]))
    tag = hmac.new(key, f"{kind}|{re.sub(r'[\s,.]+', ' ', plain).strip()}".encode(), hashlib.sha256).hexdigest()[:8]
    return f"[{kind} {tag}]"


def redact(text: str | None, key: bytes) -> str | None:
    """The text with every item replaced, and dates of birth permuted."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find(text):
        out += [text[at:a], placeholder(text[a:b], kind, key)]
        at = b
    out.append(text[at:])

    def born(m: re.Match[str]) -> str:
        which = next(k for k in ("", "2", "3", "4") if m[f"y{k}"])
        year, month, day = (m[f"{c}{which}"] for c in "ymd")
        named = not month.isdigit()
        try:
            new = permute_date(int(year), _MONTHS.index(month.lower()) + 1 if named else int(month), int(day), key)
        except ValueError:
            return m[0]
        y, mo, d = new
        shown = {"y": f"{y:04d}", "m": _MONTHS[mo - 1].capitalize() if named else f"{mo:0{len(month)}d}", "d": f"{d:0{len(day)}d}"}
        out = m[0]
        for c in sorted("ymd", key=lambda c: -m.start(f"{c}{which}")):
            a, b = (x - m.start() for x in m.span(f"{c}{which}"))
            out = out[:a] + shown[c] + out[b:]
        return out

    return _BORN.sub(born, "".join(out))


# -- Spark ------------------------------------------------------------------------------------------------------------

_FOUND = pa.schema([("rec_id", pa.string()), ("pii_type", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())])


def _find_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        memo: dict[str | None, list[Item]] = {}
        ids, kinds, starts, ends = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            items = memo.get(text)
            if items is None:
                items = memo[text] = find(text)
            for a, b, kind in items:
                ids.append(key)
                kinds.append(kind)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=_FOUND
        )


def items(table: DataFrame, rec_table: str, id_column: str, text_column: str) -> DataFrame:
    """(rec_table, rec_id, pii_type, start_char, end_char), repeated rows counted once."""
    return (
        table.filter(F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
        .select(F.col(id_column).cast("string").alias("rec_id"), F.col(text_column).alias("text"))
        .mapInArrow(_find_rows, "rec_id string, pii_type string, start_char int, end_char int")
        .select(F.lit(rec_table).alias("rec_table"), "rec_id", "pii_type", "start_char", "end_char")
        .distinct()
    )


def redacted(table: DataFrame, rec_table: str, id_column: str, text_column: str, key: bytes) -> DataFrame:
    """(rec_table, rec_id, text) with placeholders, one row per distinct record and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, key) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["rec_id", "text"])

    return (
        table.filter(F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("string").alias("rec_id"), F.col(text_column).alias("text"))
        .mapInArrow(run, "rec_id string, text string")
        .select(F.lit(rec_table).alias("rec_table"), "rec_id", "text")
        .distinct()
    )

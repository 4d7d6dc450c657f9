"""Personal data replaced by keyed surrogates.

Every detected entity gets a surrogate that only depends on the secret key, its type
and its normal form, so an entity has the same surrogate wherever it occurs. Numbers are
permuted inside their own format by a keyed Feistel network, which keeps different
numbers different. Addresses, secrets and names are drawn from keyed digests within their
format. A collision check over all entities of the corpus, of every kind, finds surrogates that
two entities share or that an entity has as its real value, and gives all but one of
them a further draw. A number without a free draw keeps its first one, which no other number has.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import look_up, map_text, read, saved

KEY = b"tidewise surrogate key: replace in production"
#: Draws of an entity; the last one is unique: it carries a keyed number of its own, or is a number's first permutation again.
DRAWS = 4
#: Dates of birth are permuted inside these years.
FIRST_DATE, LAST_DATE = datetime.date(1900, 1, 1), datetime.date(2030, 1, 1)

# Titles by the gender that they tell, and syllables of invented names by script.
TITLES = {"m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа"],
          "n": ["Dr", "Prof", "Mx"]}
# Common given names by gender; with a surname they are a person also without a title.
GIVEN = {
    "f": "Anna Anne Maria Marie Sophie Julia Laura Sarah Emma Emily Olivia Charlotte Elizabeth Jennifer Linda Barbara Susan Jessica Karen Nancy Margaret Ursula "
         "Monika Petra Sabine Renate Claudia Birgit Heike Katharina Johanna Carmen Josefa Isabel Dolores Pilar Teresa Cristina Lucía Camille Nathalie "
         "Isabelle Sylvie Catherine Françoise Monique Giulia Francesca Chiara Елена Ольга Наталья Татьяна Ирина Светлана Мария Анна",
    "m": "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Peter Paul Hans Klaus Jürgen Wolfgang Stefan "
         "Andreas Matthias Sebastian Johannes José Antonio Manuel Francisco Javier Carlos Miguel Pedro Jean Pierre Jacques Philippe François Nicolas Julien "
         "Giuseppe Giovanni Marco Luca Александр Сергей Дмитрий Андрей Иван Михаил Владимир Пётр"}
GENDER = {n.casefold(): g for g, names in GIVEN.items() for n in names.split()}
# Words between given name and surname, and words that begin the date of a birth or the number of a passport.
PARTICLES = "van von vom zu zum zur de del della di da dos das do du le la los der den des ten ter af av bin ibn al el y"
BIRTH = r"born(?: on)?|date of birth|d\.?o\.?b\.?|geb\.?(?:oren)?(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento"
PASSPORT = r"passport|reisepass|passnummer|pasaporte|passeport|passaporto"
SYLLABLES = {
    "latin": (["ba", "be", "bo", "da", "de", "do", "fa", "fi", "ga", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne",
               "no", "pa", "pe", "ra", "re", "ri", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vi"], {"m": "n", "f": "a", "n": "r", "s": "r"}),
    "cyrillic": (["ба", "ве", "го", "да", "же", "за", "ка", "ле", "ми", "но", "па", "ре", "са", "то", "фи", "ха"], {"m": "н", "f": "а", "n": "р", "s": "в"}),
    "greek": (["βα", "γε", "δο", "ζα", "κα", "λε", "μι", "νο", "πα", "ρε", "σα", "το", "φι", "χα"], {"m": "ς", "f": "α", "n": "ς", "s": "ς"}),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CAPITALISED = r"[^\W\d_a-zа-яα-ω][^\W\d_]+"
_GENDER_OF_TITLE = {x: g for g, names in TITLES.items() for t in names for x in (t, t.upper())}
_TITLE = "|".join(sorted(_GENDER_OF_TITLE, key=len, reverse=True))
_LISTED = "|".join(x for names in GIVEN.values() for n in names.split() for x in (n, n.upper()))
_NAME_WORD = rf"(?:[OoDdLl]['’](?=[^\W\d_a-zа-яα-ω]))?{_CAPITALISED}"
_BETWEEN = rf"(?:[^\W\d_a-zа-яα-ω]\. ){{0,2}}(?:(?:{PARTICLES.replace(' ', '|')}) ){{0,2}}"
_FULL_NAME = rf"{_BETWEEN}{_NAME_WORD}(?:[ -]{_BETWEEN}{_NAME_WORD}){{0,2}}"
_HEX = "[0-9A-Fa-f]"
PATTERNS = [  # of matches that overlap, the first kind wins
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<a>[0-9A-Z]{16})(?![0-9A-Za-z])|(?<!\w)(?:gh[pousr]_|sk-|xox[abp]-)(?P<b>[\w-]{16,})"
                          r"|(?<!\w)eyJ(?P<c>[\w-]+\.[\w-]+\.[\w-]+)"
                          r"|(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key)\s*[:=]\s*[\"']?(?P<d>[^\s\"']{6,})")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?!\w)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("ip6", re.compile(rf"(?<![\w:.])(?:{_HEX}{{1,4}}|:)(?::{_HEX}{{0,4}}){{2,7}}(?![\w:])")),
    ("ip", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)")),
    ("passport", re.compile(rf"(?i:{PASSPORT})(?:\s*(?i:no|number|nr|num|n[°º]|#)\.?)?\s*[:=]?\s*(?P<id>(?=[A-Z0-9]*[0-9])[A-Z0-9]{{6,9}})(?!\w)")),
    ("birth", re.compile(rf"(?<!\w)(?i:{BIRTH})\s*:?\s*(?P<date>[0-9]{{1,2}}([./-])[0-9]{{1,2}}\2[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?![0-9])")),
    ("place", re.compile(rf"(?<!\w)(?P<a>[^\W\d_a-z][^\W\d_]*?)(?:straße|strasse|str\.|gasse|allee|platz|weg) (?P<na>[0-9]{{1,4}})(?![0-9])"
                         rf"|(?<!\w)(?P<nb>[0-9]{{1,5}}) (?P<b>{_CAPITALISED}(?: {_CAPITALISED}){{0,2}}) (?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Lane|Ln\.|Boulevard|Blvd\.|Drive|Square)(?!\w)"
                         rf"|(?<!\w)(?:Calle|Avenida|Plaza|Rue|Avenue|Via|Piazza)(?: (?:de|del|du|des|della|dei)(?: (?:la|las|los|l'))?)? (?P<c>{_CAPITALISED}(?: {_CAPITALISED}){{0,2}}),? (?P<nc>[0-9]{{1,4}})(?![0-9])")),
    ("phone", re.compile(r"(?<![\w.+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
                         r"|(?:\(0\d{1,4}\) ?|0\d{2,4}[ /-])\d{3,4}(?:[ -]?\d{2,4}){1,2})(?![\d])")),
    ("person", re.compile(rf"(?<!\w)(?P<titles>(?:{_TITLE})\.?(?: (?:{_TITLE})(?:\.|(?= ))){{0,3}}) (?P<name>{_FULL_NAME})")),
    ("listed", re.compile(rf"(?<!\w)(?P<name>(?:{_LISTED})(?:[ -](?:{_LISTED}))? {_BETWEEN}{_NAME_WORD})(?!\w)")),
]
#: A word that may be a name seen elsewhere in its text.
_UNTITLED = re.compile(rf"(?<!\w){_NAME_WORD}(?!\w)")
#: Country codes of one and two digits; all others have three.
CODES = {"1", "7", "20", "27", *(str(x) for x in (*range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67),
                                                  81, 82, 84, 86, *range(90, 96), 98))}
#: What a text must have to be searched at all: wider than every pattern, without boundaries, which RE2 knows for ASCII only.
_HINT = r"\p{Nd}|@|AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|eyJ|(?i:pass|pwd|secret|token|key)|:[0-9A-Fa-f]*:|(?:" + _TITLE + r")\.? |(?:" + _LISTED + ")"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _decimal(text: str) -> str:
    """Digits of any script as 0 to 9."""
    return text if text.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in text)


def _iban_check(body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body)) % 97


@dataclass(frozen=True)
class Mention:
    """A stretch of a text that is one entity; ``form`` is the entity's normal form."""

    kind: str
    start: int
    end: int
    form: str


def _iban_length(text: str) -> int:
    """Length of the longest prefix of whole groups whose check digits are right, 0 if none."""
    for end in [*(m.end() for m in re.finditer(r"\w(?!\w)", text))][::-1]:
        body = text[:end].replace(" ", "")
        if 15 <= len(body) <= 34 and _iban_check(body[4:] + body[:4]) == 1:
            return end
    return 0


def _length(kind: str, text: str) -> int:
    """How much of a match is an entity, 0 if it is none."""
    digits = re.sub(r"\D", "", text)
    if kind == "iban":
        return _iban_length(text)
    if kind == "ip6":
        return len(text) if _is_ip6(text) else 0
    if kind == "card" and not (_luhn(digits) or len(digits) == 16 and digits[0] in "3456"):
        return 0
    if kind == "phone" and not 7 <= len(digits) <= 15:
        return 0
    return len(text)


def _script(name: str) -> str:
    c = ord(name[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def _is_ip6(text: str) -> bool:
    """An address with three groups or a common first one: others, as a::b, are rather code."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    groups = [g for g in text.split(":") if g]
    return len(groups) >= 3 or bool(groups) and bool(re.fullmatch("(?:[23]|f[cde])[0-9a-f]{2,3}", groups[0].lower()))


def _date(text: str) -> datetime.date | None:
    """The date of D.M.Y, D/M/Y, M/D/Y (if the second number is no month) or Y-M-D."""
    a, b, c = map(int, re.split("[./-]", text))
    y, m, d = (a, b, c) if len(text) == 10 and text[4] == "-" else (c, b, a) if b <= 12 else (c, a, b)
    try:
        return datetime.date(y, m, d)
    except ValueError:
        return None


def _name_parts(kind: str, text: str, start: int, last: str, first: str) -> Iterator[Mention]:
    """The words of a name but its particles and initials: all but the last are given names."""
    words = list(re.finditer(_NAME_WORD, text))
    for i, w in enumerate(words):
        part = last if i == len(words) - 1 else first
        yield Mention(f"{kind}-{part}-{_script(w.group())}", start + w.start(), start + w.end(), w.group().casefold())


def _parts(kind: str, m: re.Match, end: int) -> Iterator[Mention]:
    if kind == "secret":
        group = next(g for g in "abcd" if m.group(g) is not None)
        yield Mention("secret", m.start(group), m.end(group), m.group(group))
    elif kind == "person":
        genders = [_GENDER_OF_TITLE[t.strip(".")] for t in m.group("titles").split()]
        yield from _name_parts("name", m.group("name"), m.start("name"), "s", next((g for g in genders if g != "n"), "n"))
    elif kind == "listed":
        yield from _name_parts("name", m.group("name"), m.start("name"), "s", "n")
    elif kind == "passport":
        yield Mention("passport", m.start("id"), m.end("id"), m.group("id"))
    elif kind == "birth":
        date = _date(m.group("date"))
        if date and FIRST_DATE <= date < LAST_DATE:
            yield Mention("birth", m.start("date"), m.end("date"), date.isoformat())
    elif kind == "place":
        group = next(g for g in "abc" if m.group(g) is not None)
        stem = m.group(group)
        if group == "a":
            yield Mention(f"place-s-{_script(stem)}", m.start("a"), m.end("a"), stem.casefold())
        else:
            yield from _name_parts("place", stem, m.start(group), "s", "s")
        yield Mention("house", m.start("n" + group), m.end("n" + group), m.group("n" + group))
    else:
        text = m.string[m.start():end]
        number = _decimal(text)
        form = {"email": text.casefold(), "iban": number.replace(" ", ""), "ip": number}.get(kind) or re.sub(r"\D", "", number)
        if kind == "ip6":
            form = ipaddress.IPv6Address(text).exploded
        if kind == "phone" and text[0] == "+":
            form = "+" + form
        yield Mention(kind, m.start(), end, form)


def mentions(text: str) -> list[Mention]:
    """Entities of a text in order, without overlaps.

    A given name is one entity in all of a text: its gender is that of the first title that tells one, at any mention,
    else that of the list of given names.
    """
    taken: list[tuple[int, int]] = []
    out: list[Mention] = []
    for kind, pattern in PATTERNS:
        new = []
        for m in pattern.finditer(text):
            end = m.start() + _length(kind, m.group())
            if end > m.start() and _free(taken, m.start(), end):
                new.append((m.start(), end))
                out += _parts(kind, m, end)
        if new:
            taken = sorted(taken + new)
    out.sort(key=lambda x: x.start)
    out = sorted(out + list(_untitled(text, out, taken)), key=lambda x: x.start)
    told: dict[str, str] = {}
    for m in out:
        if m.kind.startswith(("name-m", "name-f")):
            told.setdefault(m.form, m.kind[5])
    return [replace(m, kind=f"name-{told.get(m.form) or GENDER.get(m.form, 'n')}{m.kind[6:]}") if m.kind.startswith("name-") and m.kind[5] != "s" else m
            for m in out]


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """No span of the sorted ones, which do not overlap, meets the stretch."""
    before = bisect_left(taken, (end,)) - 1
    return before < 0 or taken[before][1] <= start


def _untitled(text: str, found: list[Mention], taken: list[tuple[int, int]]) -> Iterator[Mention]:
    """Capitalised words outside other entities that are parts of a name with a title in the same text, before or after it.

    A part that is both a first name and a surname there counts as the first of them.
    """
    kinds: dict[str, str] = {}
    for m in found:
        if m.kind.startswith("name-"):
            kinds.setdefault(m.form, m.kind)
    for w in _UNTITLED.finditer(text) if kinds else ():
        kind = kinds.get(w.group().casefold())
        if kind and _free(taken, w.start(), w.end()):
            yield Mention(kind, w.start(), w.end(), w.group().casefold())


class Surrogates:
    """Keyed surrogates of normal forms."""

    def __init__(self, key: bytes):
        self.key = key

    def digest(self, *parts: str) -> bytes:
        return hmac.new(self.key, "\x1f".join(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()

    def name_of(self, kind: str, form: str) -> str:
        """What stands for an entity in work tables: no real value is stored in them."""
        return self.digest("entity", kind, form).hex()[:32]

    def _permute(self, tag: str, x: int, size: int) -> int:
        """Keyed permutation of range(size): a Feistel network, walked until it is inside."""
        half = max(2, (max(size - 1, 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in range(6):
                a, b = b, a ^ (int.from_bytes(self.digest(tag, str(r), str(b))[:8]) & mask)
            x = (a << half) | b
            if x < size:
                return x

    def _digits(self, tag: str, digits: str) -> str:
        return str(self._permute(f"{tag}{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits)) if digits else ""

    def _like(self, stream: Iterator[int], text: str) -> str:
        """Random characters of the same classes; hexadecimal stays hexadecimal."""
        if re.fullmatch("[0-9a-f]{16,}", text):
            return "".join(f"{next(stream) % 16:x}" for _ in text)
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(next(stream) % 10))
            elif c.isalpha():
                out.append(chr((65 if c.isupper() else 97) + next(stream) % 26))
            else:
                out.append(c)
        return "".join(out)

    def _stream(self, *parts: str) -> Iterator[int]:
        block = 0
        while True:
            yield from self.digest("stream", str(block), *parts)
            block += 1

    def form(self, kind: str, form: str, draw: int) -> str:
        """Normal form of the surrogate. Numbers have one permutation a draw, the last draw is the first one again."""
        stream = self._stream(kind, form, str(draw))
        own = self.digest("own", kind, form).hex()[:16]
        if kind == "email":
            local, _, domain = form.partition("@")
            host = self._like(stream, domain.split(".")[0])
            return f"{self._like(stream, local)}{'.' + own if draw == DRAWS - 1 else ''}@{host}.example.org"
        if kind == "secret":
            out = self._like(stream, form)
            return out if draw < DRAWS - 1 else (out + own)[-max(len(out), 16):]
        if kind.startswith(("name-", "place-")):
            _, part, script = kind.split("-")
            syllables, ending = SYLLABLES[script]
            size = 2 + next(stream) % 2 + draw
            out = "".join(syllables[next(stream) % len(syllables)] for _ in range(size)) + ending[part]
            return out if draw < DRAWS - 1 else out + "".join(syllables[int(c, 16) % len(syllables)] for c in own) + ending[part]
        again = f"/{draw}" if 0 < draw < DRAWS - 1 else ""
        if kind == "card" and _luhn(form):
            body = self._digits(f"card{form[0]}{again}", form[1:-1])
            return next(x for x in (f"{form[0]}{body}{c}" for c in range(10)) if _luhn(x))
        if kind == "card":  # walked inside the numbers with a wrong check digit
            while True:
                form = form[0] + self._digits(f"no-luhn{form[0]}{again}", form[1:])
                if not _luhn(form):
                    return form
        if kind == "iban":
            body = "".join(self._digits(f"iban{again}", p) if p.isdigit() else p for p in re.findall(r"\d+|\D+", form[4:]))
            return f"{form[:2]}{98 - _iban_check(body + form[:2] + '00'):02d}{body}"
        if kind == "ip":
            x = 0
            for o in form.split("."):
                x = x * 256 + int(o)
            x = self._permute(f"ip{again}", x, 1 << 32)
            return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
        if kind == "ip6":
            x = self._permute(f"ip6{again}", int(ipaddress.IPv6Address(form)), 1 << 128)
            return ipaddress.IPv6Address(x).exploded
        if kind == "birth":
            days = self._permute(f"birth{again}", (datetime.date.fromisoformat(form) - FIRST_DATE).days, (LAST_DATE - FIRST_DATE).days)
            return (FIRST_DATE + datetime.timedelta(days)).isoformat()
        if kind == "passport":  # letters and digits are permuted for themselves, where they stand
            letters, digits = re.sub("[0-9]", "", form), re.sub("[^0-9]", "", form)
            layout = re.sub("[A-Z]", "A", re.sub("[0-9]", "9", form))
            x = sum((ord(c) - 65) * 26 ** i for i, c in enumerate(letters))
            x = self._permute(f"letters{layout}{again}", x, 26 ** len(letters)) if letters else 0
            new_letters, new_digits = iter([chr(65 + x // 26 ** i % 26) for i in range(len(letters))]), iter(self._digits(f"passport{layout}{again}", digits))
            return "".join(next(new_digits) if c == "9" else next(new_letters) for c in layout)
        if kind == "house":
            low = 10 ** (len(form) - 1)
            return str(low + self._permute(f"house{len(form)}{again}", int(form) - low, 9 * low)) if form[0] != "0" else self._digits(f"house0{again}", form)
        if kind == "phone" and form[0] == "0":
            return "0" + self._digits(f"phone0{again}", form[1:])
        if kind == "phone" and form[0] == "+":
            code = next((form[1:1 + k] for k in (1, 2) if form[1:1 + k] in CODES), form[1:4])
            return f"+{code}" + self._digits(f"phone{code}{again}", form[1 + len(code):])
        return self._digits(f"{kind}{again}", form)  # ssn, phone without a country code

    def render(self, m: Mention, real: str, form: str) -> str:
        """The surrogate in the mention's own format: grouping, country code and case."""
        if m.kind in ("card", "ssn", "phone", "iban"):
            chars = iter(form.removeprefix("+"))
            return "".join(next(chars) if c.isalnum() else c for c in real)
        if m.kind.startswith(("name-", "place-")):
            return form.upper() if real.isupper() and len(real) > 1 else form.capitalize()
        if m.kind == "ip6":
            return str(ipaddress.IPv6Address(form)) if "::" in real else form
        if m.kind == "birth":
            return _like_date(real, datetime.date.fromisoformat(form))
        return form.upper() if m.kind == "email" and real.isupper() else form


def _like_date(real: str, date: datetime.date) -> str:
    """A date in the order, separators and padding of another."""
    if real[4:5] == "-" and len(real) == 10:
        return date.isoformat()
    first, mark, second = re.match(r"([0-9]+)([./-])([0-9]+)", real).groups()
    numbers = (date.day, date.month) if int(second) <= 12 else (date.month, date.day)
    padded = len(first) == 2 and len(second) == 2
    return mark.join([*(f"{x:02d}" if padded else str(x) for x in numbers), str(date.year)])


def _hinted(t: pa.Array) -> np.ndarray:
    """Rows that may hold an entity."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(t, _HINT), False).to_numpy(zero_copy_only=False))


def _entities_of(key: bytes):
    def run(t: pa.Array) -> list[pa.Array]:
        s = Surrogates(key)
        out: list[list[dict]] = [[] for _ in range(len(t))]
        for i in _hinted(t).tolist():
            seen = {(m.kind, m.form) for m in mentions(t[i].as_py())}
            out[i] = [{"kind": k, "entity": s.name_of(k, f), "draws": [s.name_of(k, s.form(k, f, d)) for d in range(DRAWS)]} for k, f in sorted(seen)]
        return [pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("draws", pa.list_(pa.string()))])))]

    return run


ENTITY = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("entity", T.StringType()),
                                   T.StructField("draws", T.ArrayType(T.StringType()))]))


def later_draws(entities: DataFrame) -> DataFrame:
    """(entity, draw) of the entities whose first draw collides, from (entity, draws) rows.

    In each round the smallest entity of those that draw a surrogate has it, unless
    it is settled already, is the real value of an entity or another one's first draw; the others draw again. The last draw is unique.
    """
    known = saved(entities.groupBy("entity").agg(F.first("draws").alias("draws")), "entities")
    settled, pending = None, known.select("entity", F.lit(0).alias("draw"), F.element_at("draws", 1).alias("drawn"))
    for draw in range(DRAWS):
        first = pending.groupBy("drawn").agg(F.min("entity").alias("winner"))
        if draw < DRAWS - 1:
            first = first.join(known.select(F.col("entity").alias("drawn")), "drawn", "left_anti")
            if settled is not None:
                first = first.join(settled.select("drawn"), "drawn", "left_anti")
                first = first.join(known.select(F.element_at("draws", 1).alias("drawn")), "drawn", "left_anti")
        won = pending.join(first, "drawn", "left").withColumn(
            "won", (F.col("winner") == F.col("entity")) if draw < DRAWS - 1 else F.lit(True)).fillna(False, ["won"])
        won = saved(won.select("entity", "draw", "drawn", "won"), f"draw-{draw}")
        mine = won.filter("won").select("entity", "draw", "drawn")
        settled = mine if settled is None else settled.unionByName(mine)
        lost = won.filter("not won").select("entity")
        if lost.isEmpty():
            break
        pending = lost.join(known, "entity").select("entity", F.lit(draw + 1).alias("draw"), F.element_at("draws", draw + 2).alias("drawn"))
    return saved(settled.filter("draw > 0").select("entity", "draw"), "later")


FIELDS = [T.StructField("__new_text", T.StringType()), T.StructField("n_entities", T.LongType()),
          T.StructField("kinds", T.ArrayType(T.StringType())),
          T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                                           T.StructField("end", T.LongType())])))]


def rewrite(text: str, s: Surrogates, draws: dict[str, int]) -> tuple[str, list[dict]]:
    """The text with surrogates, and their spans in it."""
    out, spans, at, size = [], [], 0, 0
    for m in mentions(text):
        real = text[m.start:m.end]
        draw = draws.get(s.name_of(m.kind, m.form), 0) if draws else 0
        new = s.render(m, real, s.form(m.kind, m.form, draw))
        size += m.start - at
        out += [text[at:m.start], new]
        spans.append({"kind": m.kind.split("-")[0], "start": size, "end": size + len(new)})
        size += len(new)
        at = m.end
    return "".join([*out, text[at:]]), spans


def pii_surrogates(docs: DataFrame, key: bytes = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, kinds, spans) for each row: the text with surrogates.

    ``spans`` gives kind, first and end character of each surrogate in the new text. A null text stays
    null, a text without entities is unchanged. Rows with equal or null doc_ids are
    rewritten each for itself. ``key`` is the secret; with the same key runs agree
    unless the corpus brings new collisions. Persons are names after a title or chain of titles, given names of the list with a
    surname, and the same words elsewhere in the text; initials and particles stay. A text is held whole, its work
    grows with its length.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keyed = own.withColumn("digest", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    found = map_text(keyed, "text", ["digest"], [T.StructField("entities", ENTITY)], _entities_of(key)).filter(F.size("entities") > 0)
    found = saved(found.select("digest", F.explode("entities").alias("e")).select("digest", "e.entity", "e.draws"), "mentions")
    later = later_draws(found)
    if later.isEmpty():
        rows = own.select("doc_id", "text", F.lit(None).cast("string").alias("draws"))
    else:
        # the map of a text has its own entities only, and equal texts have one
        texts = saved(found.groupBy("digest", "entity").agg(F.count(F.lit(1)).alias("rows")), "texts")
        drawn = later.join(texts.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity")
        own_draws = look_up(texts, "entity", saved(drawn, "drawn"), "n", "drawn").filter("draw is not null").groupBy("digest").agg(
            F.to_json(F.map_from_entries(F.collect_list(F.struct("entity", "draw")))).alias("draws"), F.max("rows").alias("n"))
        rows = look_up(keyed, "digest", saved(own_draws, "text-draws"), "n", "draws").select("doc_id", "text", "draws")
    return rows.mapInArrow(_rewriter(key), T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType()), *FIELDS[1:]]))


def _rewriter(key: bytes):
    import json

    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        s = Surrogates(key)
        for b in batches:
            t, draws = b.column(1), b.column(2)
            n = len(t)
            texts, spans = {}, [[] for _ in range(n)]
            for i in _hinted(t).tolist():
                later = json.loads(draws[i].as_py()) if draws[i].is_valid else {}
                texts[i], spans[i] = rewrite(t[i].as_py(), s, later)
            if texts:
                changed = np.zeros(n, bool)
                changed[list(texts)] = True
                t = pc.replace_with_mask(t, pa.array(changed), pa.array([texts[i] for i in sorted(texts)], t.type))
            kinds = [sorted({x["kind"] for x in r}) for r in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), t.cast(pa.string()), pa.array([len(r) for r in spans], pa.int64()),
                                              pa.array(kinds, pa.list_(pa.string())), pa.array(spans, spans_type)],
                                             names=["doc_id", "text", "n_entities", "kinds", "spans"])

    return run


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates(read(spark, sf_dir, "documents"))

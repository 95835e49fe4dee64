"""Personal data replaced by keyed surrogates.

E-mail and network addresses, phone, card and bank account numbers, social security numbers, secrets and names of people
are found by patterns and replaced by values of the same type and format: a phone number keeps its country, punctuation
and length, a card number its first digit and the state of its check digit, an account number its country, a network
address its class, a name its gender, script and capitals; digits stay in their script. The replacement is a keyed
permutation without fixed points (a secret rotation between a Feistel network and its inverse, over as many values as the
format has, walked until it lands among them), so equal entities get equal surrogates in all documents (coreference, also
across ways to write a phone number, the case of an e-mail address, and a surname with or without a first name), and
distinct ones of a format distinct surrogates, without any table that grows with the corpus. A format with a single
value, as 0.0.0.0 has, keeps it. surrogates() checks both over all distinct entities before it returns, by verify();
collisions() and splits() list what fails.

People are found by a first name of the lists before a surname (also both in capitals), by two capitalised words after a title or
words that lead to a name, and by a surname alone where the same text has it otherwise. Surnames may have any Latin, Greek
or Cyrillic letter. The lists are a parameter. Values are secrets behind a key word, also as part of a longer name. What looks like an
account number and fails its check is looked at for other types, of card numbers those whose check digit holds. No entity has a greatest length.

A null text is empty and stays null in the result; texts without entities stay as they are. Rows don't meet, so repeated
rows get the same; an empty table gives an empty one; columns of the input that have the name of a new one give way.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import cut, in_lots

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
#: First names by gender and script; surrogates come from the same list.
NAMES = {
    "female": "Aisha Alice Amelia Anna Beatrice Camille Carla Carmen Charlotte Chloe Clara Diana Agnieszka Ana Claire Elena Elise Elizabeth Emily Emma Eva Ewa Fatima Fiona Grace Greta Hannah Helen Ingrid Irene Isabel Jane Jennifer Jessica Julia Karen Katarzyna Katherine Laura Leila Linda Lucia Mei Michelle Nadia Priya Yuki Zofia Maria Marie Marta Mary Nina Olivia Patricia Paula Rosa Sarah Sofia Sophie Susan Teresa Ursula Vera".split(),
    "male": "Ben Christopher Fernando Giovanni Hiroshi Jan Joseph Kenji Krzysztof Luigi Łukasz Ming Piotr Raj Sergio Stephen Tom Wei Adam Ahmed Albert Alexander Ali Andrew Anton Antonio Bruno Carlos Charles Christian Daniel David Edward Eric Felix Francisco Frank Fritz George Hans Henry Hugo Ibrahim Ivan Jack James Jean John Jorge José Juan Karl Klaus Louis Lucas Mark Martin Matthew Michael Miguel Muhammad Oliver Omar Oscar Paul Pedro Peter Pierre Richard Robert Simon Stefan Thomas Victor William".split(),
    "female Cyrillic": "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана".split(),
    "male Cyrillic": "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
#: Titles before surnames.
TITLES = "Mr Mrs Ms Dr Prof Professor Herr Frau Monsieur Madame Señor Señora".split()
#: Prefixes that secrets keep.
TOKENS = r"AKIA(?=[A-Z0-9]{16}(?![A-Za-z0-9]))|gh[pousr]_(?=[A-Za-z0-9]{36})|glpat-(?=[A-Za-z0-9_-]{20})|xox[abprs]-(?=[A-Za-z0-9-]{10})|AIza(?=[A-Za-z0-9_-]{35})|sk-(?=[A-Za-z0-9_-]{20})"
#: How a signed token begins, and words before the value of a secret, alone or as parts of a longer name.
JWT = r"eyJ(?=[A-Za-z0-9_-]+\.)"
ASSIGNED = r"(?i:(?:password|passwd|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key)(?:[_-][A-Za-z0-9]{1,20}){0,4})"
#: Country calling codes of one and two digits; all others have three.
CALLING = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Words before a name of two capitalised words, whatever they are.
CUES = r"(?i:\b(?:dear|my name is|signed|sincerely|regards)\b,?|\b(?:name|author|contact|attn)[ \t]*[:=])[ \t]{1,3}"
#: Letters that names are made of: those of Latin, Greek and Cyrillic writing with one capital each, and small ones without.
_SCRIPTS = {"Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x17F)], "Greek": [(0x386, 0x3CE)], "Cyrillic": [(0x400, 0x45F)]}
_LETTERS = {k: [c for a, b in some for c in map(chr, range(a, b + 1)) if c.isalpha()] for k, some in _SCRIPTS.items()}
_CAPS = "".join(c for some in _LETTERS.values() for c in some if c.isupper() and len(c.lower()) == 1 and c.lower().upper() == c)
_SMALL = "".join(c for some in _LETTERS.values() for c in some if c.islower())
_SURNAME = rf"[{_CAPS}](?:[{_SMALL}]+|['’](?=[{_CAPS}]))(?:[-'’]?[{_CAPS}][{_SMALL}]+)*"
_SHOUTED = rf"[{_CAPS}]{{2,}}(?:[-'’][{_CAPS}]{{2,}})*"
#: Characters that stand between the digits of a number.
_GAP = " .\u00a0-"


def patterns(names: dict[str, list[str]]) -> dict[str, str]:
    listed = sorted((n for some in names.values() for n in some), key=len, reverse=True)
    first, loud = ("|".join(re.escape(f(n)) for n in listed) or r"(?!)" for f in (str, str.upper))
    return {
        "email": r"(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])",
        "secret": rf"(?<![A-Za-z0-9])(?:(?:{TOKENS})[A-Za-z0-9_-]*[A-Za-z0-9]|{JWT}[A-Za-z0-9_-]{{5,}}\.[A-Za-z0-9_-]{{5,}}(?:\.[A-Za-z0-9_-]+)?)",
        "assigned": rf"(?:(?:(?<![A-Za-z0-9])|(?<=[a-z])(?=[A-Z])){ASSIGNED}(?:\\?[\"'])?\s{{0,4}}[=:]\s{{0,4}}(?:\\?[\"'])?|(?i:\bbearer\s{{1,4}})(?=[A-Za-z._~+/-]*\d)(?=[A-Za-z0-9._~+/-]{{16}}))(?P<value>[A-Za-z0-9+/_@!#$%^*~?-]{{8,}}(?:\.[A-Za-z0-9+/_@!#$%^*~?-]+)*)",
        "ip6": r"(?<![\w:.])(?i:[23][0-9a-f]{3}|f[cdef][0-9a-f]{2})(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])",
        "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?![\w]|\.\d)",
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w]|[.-]\d)",
        "card": r"(?<![\w.-])(?!\d{3}[ \u00a0-]\d{3}[ \u00a0-]\d{4}\b)\d(?:[ \u00a0-]?\d){12,18}(?![\w]|[.-]\d)",
        "phone": rf"(?<![\w.])(?:\+\d{{1,3}}[{_GAP}]?)?(?:\(\d{{3}}\)[{_GAP}]?|\d{{3}}[{_GAP}])\d{{3}}[{_GAP}]\d{{4}}(?![\w]|[.-]\d)|(?<![\w.])\+\d(?:[{_GAP}]?\(?\d\)?){{7,14}}(?![\w]|[.-]\d)",
        "name": rf"(?<!\w)(?P<first>{first})(?P<middle> (?:(?:{first}|[{_CAPS}]\.) )*)(?P<last>{_SURNAME})(?!\w)",
        "capitals": rf"(?<!\w)(?P<loud>{loud}) (?P<shouted>{_SHOUTED})(?!\w)",
        "cued": rf"{CUES}(?P<given>{_SURNAME}) (?P<family>{_SURNAME})(?!\w)",
        "titled": rf"(?<!\w)(?:{'|'.join(TITLES)})\.? (?P<before>(?:(?:{_SURNAME}|[{_CAPS}]\.) )?)(?P<lone>{_SURNAME})(?!\w)",
    }


#: What is called a person's name.
PEOPLE = ("name", "capitals", "cued", "titled")
PATTERNS = patterns(NAMES)
#: What any number and any account number that is looked for holds.
_NUMBER, _ACCOUNT = re.compile(r"\d[\d .()\u00a0-]{5,}\d"), re.compile(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{8}")
#: First names and titles begin so.
_CAPITAL = re.compile(rf"[{_CAPS}]\w+")
_CUE = re.compile(CUES)
_LONE = re.compile(rf"(?<!\w){_SURNAME}(?!\w)")
WHOLE = {k: re.compile(p) for k, p in PATTERNS.items()}
#: Classes of network addresses: a surrogate is of the class of its address; all that no network names are public.
NETWORKS = {
    "unspecified": ["0.0.0.0/32"], "loopback": ["127.0.0.0/8"], "link-local": ["169.254.0.0/16"], "multicast": ["224.0.0.0/4"], "reserved": ["240.0.0.0/4"],
    "private": ["0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24"],
}


def ranges() -> dict[str, list[tuple[int, int]]]:
    """Of each class the (first, past the last) address of its ranges, in order; the unspecified address is not private."""
    named = sorted((max(int(n[0]), kind == "private"), int(n[-1]) + 1, kind) for kind, some in NETWORKS.items() for n in map(ipaddress.IPv4Network, some))
    out: dict[str, list[tuple[int, int]]] = {"public": []}
    at = 0
    for first, past, kind in [*named, (1 << 32, 1 << 32, "public")]:
        if at < first:
            out["public"].append((at, first))
        out.setdefault(kind, []).append((first, past))
        at = past
    return out


RANGES = ranges()
#: Texts of more letters and digits are permuted place by place, as the numbers that they stand for get too large.
LONG = 64
#: What surnames are made of, by script: groups of consonants that go for each other, then single letters.
SOUNDS = {
    "Latin": ["sch str ndr rst nst", "ch ck sh st th ph tt ll nn rr ss mm ff pp nd nt rt rn rg ng nk lt ld lm br dr gr kr pr tr fr bl kl fl gl sp sk", "a e i o u", "b c d f g h j k l m n p q r s t v w x y z", "ä ö ü", "á é í ó ú", "à è ì ò ù", "â ê î ô û", "ç ñ"],
    "Greek": ["α ε η ι ο υ ω", "β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ ψ"],
    "Cyrillic": ["ст тр пр кр гр бр др нн", "а е и о у ы э ю я", "б в г д ж з й к л м н п р с т ф х ц ч ш щ", "ъ ь"],
}


def all_sounds() -> dict[str, list[list[str]]]:
    """SOUNDS and, for every letter that names are made of and SOUNDS lacks, a group: of those with a capital, and of those without."""
    out = {}
    for script, groups in SOUNDS.items():
        known = {x for some in groups for x in some.split()}
        left = [c for c in _LETTERS[script] if c.islower() and c not in known]
        own = [[c for c in left if (c.upper() in _CAPS) == capital] for capital in (True, False)]
        out[script] = [some.split() for some in groups] + [g for g in own if g]
    return out


_SOUND = {script: (groups, re.compile("|".join(x for some in groups for x in some) + "|.", re.S)) for script, groups in all_sounds().items()}


def plain_digits(text: str) -> str:
    """The decimal digits of a text, whatever their script, as ASCII."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def like(text: str, digits: str) -> str:
    """text with its digits replaced in order, each in its own script."""
    rest = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(rest))) if c.isdecimal() else c for c in text)


def sort_of(value: str) -> str:
    """By what permutation an assigned value is replaced, the same wherever it stands: that of a type, or of the hexadecimal or other ones."""
    for kind in ("secret", "card", "ssn", "phone"):
        if WHOLE[kind].fullmatch(value):
            return kind
    return "hex" if set(value) <= set(HEX) else "other"


def text_of(m: re.Match, start: int, end: int) -> str:
    return m.string[start:end]


def is_ip6(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def iban_check(text: str) -> int:
    """97 if the check digits of a bank account number hold."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 or 97


class Surrogates:
    def __init__(self, key: bytes, names: dict[str, list[str]] | None = None) -> None:
        self.key, self.names = key, names or NAMES
        self.kind_of = {n: (k, i) for k, some in self.names.items() for i, n in enumerate(some)}
        self.own, self.compiled = {k: re.sub(r"P<(value|first|middle|last|loud|shouted|given|family|before|lone)>", rf"P<{k}_\1>", p) for k, p in patterns(self.names).items()}, {}
        self.first = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, self.kind_of), key=len, reverse=True)) + r")(?!\w)")
        self.loud = {n.upper() for n in self.kind_of}
        self.odd = not all(map(_CAPITAL.fullmatch, self.kind_of))
        self.one = lru_cache(1 << 14)(self.make)

    def rounds(self, left: int, right: int, half: int, tweak: str, back: bool) -> tuple[int, int]:
        mask = (1 << half) - 1
        told = lambda turn, x: int.from_bytes(hmac.digest(self.key, f"{tweak}|{turn}|{x}".encode(), hashlib.sha256), "big") & mask
        for turn in (range(5, -1, -1) if back else range(6)):
            left, right = (right ^ told(turn, left), left) if back else (right, left ^ told(turn, right))
        return left, right

    def feistel(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """A permutation of range(size), or its inverse: a Feistel network over the next even number of bits, walked into the range."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            left, right = self.rounds(value >> half, value & ((1 << half) - 1), half, f"{tweak}|{size}", back)
            value = left << half | right
            if value < size:
                return value

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A permutation of range(size) that leaves nothing in its place, if size is over 1: there, a secret rotation, and back."""
        if size < 2:
            return value
        step = 1 + int.from_bytes(hmac.digest(self.key, f"step|{tweak}|{size}".encode(), hashlib.sha256), "big") % (size - 1)
        return self.feistel((self.feistel(value, size, tweak) + step) % size, size, tweak, back=True)

    def places(self, at: list[int], sizes: list[int], tweak: str) -> list[int]:
        """A number below its size for each place, permuted as a whole."""
        value = size = 0
        size = 1
        for x, n in zip(at, sizes):
            value, size = value * n + x, size * n
        value, out = self.permute(value, size, tweak), []
        for n in reversed(sizes):
            value, x = divmod(value, n)
            out.append(x)
        return out[::-1]

    def shaped(self, text: str, tweak: str, classes: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> str:
        """Each letter and digit replaced by one of its class, the text as a whole permuted among those of its shape."""
        kinds = [next((c for c in classes if x in c), None) for x in text]
        shape = "".join("." if c is None else "dlu"[classes.index(c)] if len(classes) == 3 else "h" for c in kinds)
        tweak = f"{tweak}|{shape}|" + "".join(x for x, c in zip(text, kinds) if c is None)
        if sum(c is not None for c in kinds) > LONG:
            return self.long(text, kinds, tweak)
        own = [(x, c) for x, c in zip(text, kinds) if c is not None]
        new = iter(self.places([c.index(x) for x, c in own], [len(c) for _, c in own], tweak))
        return "".join(x if c is None else c[next(new)] for x, c in zip(text, kinds))

    def long(self, text: str, kinds: list[str | None], tweak: str) -> str:
        """The same for long texts, in time that grows with their length: each half in turn is shifted by what the other tells."""
        at = [i for i, c in enumerate(kinds) if c is not None]
        values = [kinds[i].index(text[i]) for i in at]
        half = len(at) // 2
        for turn in range(6):
            (a, b), other = ((0, half), values[half:]) if turn % 2 == 0 else ((half, len(at)), values[:half])
            seed = hmac.digest(self.key, f"{tweak}|{turn}|".encode() + bytes(other), hashlib.sha256)
            told = hashlib.shake_256(seed).digest(4 * (b - a))
            for n in range(a, b):
                values[n] = (values[n] + int.from_bytes(told[4 * (n - a) : 4 * (n - a) + 4], "big")) % len(kinds[at[n]])
        out = list(text)
        for i, v in zip(at, values):
            out[i] = kinds[i][v]
        return "".join(out)

    def email(self, text: str) -> str:
        local, _, host = text.lower().rpartition("@")
        return self.shaped(local, f"email@{host}") + "@" + text.rpartition("@")[2]

    def secret(self, text: str) -> str:
        keep = re.match(f"{TOKENS}|{JWT}", text).end()
        return text[:keep] + self.shaped(text[keep:], f"secret|{text[:keep]}")

    def assigned(self, text: str) -> str:
        """A value that is of another type by itself is replaced as that; the others' surrogates stay among their own sort."""
        sort = sort_of(text)
        if sort in PATTERNS:
            return getattr(self, sort)(text)
        new = text
        while True:
            new = self.shaped(new, "hex", (HEX,)) if sort == "hex" else self.shaped(new, "assigned")
            if sort_of(new) == sort:
                return new

    def ip(self, text: str) -> str:
        octets = text.split(".")
        value = int.from_bytes(bytes(map(int, octets)), "big")
        kind, own = next((k, r) for k, r in RANGES.items() if any(first <= value < past for first, past in r))
        at = 0
        for first, past in own:
            if first <= value < past:
                at += value - first
                break
            at += past - first
        at = self.permute(at, sum(past - first for first, past in own), f"ip {kind}")
        for first, past in own:
            if at < past - first:
                break
            at -= past - first
        # an octet with leading zeros keeps its width, all keep their script
        made = [str(x).zfill(len(o) if unicodedata.decimal(o[0]) == 0 else 1) for x, o in zip((first + at).to_bytes(4, "big"), octets)]
        return ".".join("".join(chr(ord(o[0]) - unicodedata.decimal(o[0]) + int(c)) for c in m) for m, o in zip(made, octets))

    def ip6(self, text: str) -> str:
        """The first group stays; the rest is permuted as a number, so that all spellings of an address have one surrogate."""
        value = int(ipaddress.IPv6Address(text))
        new = str(ipaddress.IPv6Address(value >> 112 << 112 | self.permute(value & ((1 << 112) - 1), 1 << 112, f"ip6 {value >> 112}")))
        return new.upper() if text.isupper() else new

    def iban(self, text: str) -> str:
        bare = text.replace(" ", "")
        body = self.shaped(bare[4:], f"iban {bare[:2]}")
        # check digits run from 02 to 98
        new = iter(f"{bare[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + bare[:2] + '00')) % 97:02}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def ssn(self, text: str) -> str:
        return like(text, self.shaped(plain_digits(text), "ssn"))

    @staticmethod
    def check(digits: str) -> int:
        twice = [2 * int(x) for x in digits[::-2]]
        return -(sum(x - 9 * (x > 9) for x in twice) + sum(map(int, digits[-2::-2]))) % 10

    def card(self, text: str) -> str:
        digits = plain_digits(text)
        body = digits[0] + self.shaped(digits[1:-1], f"card{digits[0]}")
        off = (int(digits[-1]) - self.check(digits[:-1])) % 10
        return like(text, body + str((self.check(body) + off) % 10))

    def phone(self, text: str) -> str:
        """The country's code stays; a number is the same with and without the code 1."""
        digits, code = plain_digits(text), ""
        if text.startswith("+"):
            code = next((digits[:n] for n in (1, 2) if digits[:n] in CALLING), digits[:3])
        local = digits[len(code) :]
        return like(text, code + self.shaped(local, "phone" + ("" if code == "1" and len(local) == 10 else "+" + code if code else "")))

    def given(self, text: str) -> str:
        """A first name of the lists, in whatever capitals, goes for another, initials stay, and others are replaced as surnames are."""
        if text.endswith("."):
            return text
        own = text if text in self.kind_of else text.capitalize()
        if own not in self.kind_of:
            new = self.one("surname", text)
            while new.capitalize() in self.kind_of:  # those of the lists stand for each other
                new = self.one("surname", new)
            return new
        new = self.one("forename", own)
        return new.upper() if text.isupper() and len(text) > 1 else new

    def forename(self, text: str) -> str:
        kind, at = self.kind_of[text]
        return self.names[kind][self.permute(at, len(self.names[kind]), f"first {kind}")]

    def surname(self, text: str) -> str:
        """Groups of consonants and single letters go for others of their kind; capitals stay where they are."""
        groups, sounds = _SOUND[next((k for k in ("Cyrillic", "Greek") if any(c in _LETTERS[k] for c in text)), "Latin")]
        kind_of = {x: (i, g.index(x)) for i, g in enumerate(groups) for x in g}
        lower, new = text.lower(), text.lower()
        if len(lower) != len(text):
            lower = new = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        shape = lambda s: [kind_of.get(x, (x,))[0] for x in sounds.findall(s)]
        own = shape(lower)
        if not any(isinstance(k, int) for k in own):
            return text
        while True:
            parts = sounds.findall(new)
            at = [kind_of[x][1] for x in parts if x in kind_of]
            made = iter(self.places(at, [len(groups[k]) for k in own if isinstance(k, int)], f"surname {own}"))
            new = "".join(groups[k][next(made)] if isinstance(k, int) else k for k in own)
            if shape(new) == own:  # else letters have made a group by chance: walk on
                return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, text))

    def make(self, kind: str, entity: str) -> str:
        return getattr(self, kind)(entity)

    def replace(self, m: re.Match) -> Iterator[tuple[str, int, int, str, str]]:
        """(type, start, end, entity, surrogate) of what a match holds."""
        held = m.groupdict()
        kind = next(k for k in PATTERNS if held.get(k) is not None)
        if kind == "assigned":
            value, sort = m["assigned_value"], sort_of(m["assigned_value"])
            yield sort if sort in PATTERNS else kind, m.start("assigned_value"), m.end("assigned_value"), value, self.one("assigned", value)
        elif kind == "name":
            first, middle, last = m["name_first"], m["name_middle"], m["name_last"]
            new = self.one("forename", first) + self.first.sub(lambda x: self.one("forename", x[0]), middle) + self.one("surname", last)
            yield kind, m.start(kind), m.end(kind), m[kind], new
        elif kind in PEOPLE:
            before, last = {"titled": ("titled_before", "titled_lone"), "capitals": ("capitals_loud", "capitals_shouted"), "cued": ("cued_given", "cued_family")}[kind]
            start = m.start(before) if m[before] else m.start(last)
            words = text_of(m, start, m.end(last)).split(" ")
            yield "name", start, m.end(last), " ".join(words), " ".join([*map(self.given, words[:-1]), self.one("surname", words[-1])])
        elif kind == "ip6":
            if is_ip6(m[kind]):
                yield kind, m.start(kind), m.end(kind), m[kind], self.one(kind, m[kind])
        else:
            yield kind, m.start(kind), m.end(kind), m[kind], self.one(kind, m[kind])

    def kinds(self, text: str) -> tuple[str, ...]:
        """What a text may hold, by signs that are cheap to look for."""
        has = lambda some: any(x in text for x in some)
        found = ["email"] * ("@" in text) + ["secret"] * has(("AKIA", "gh", "glpat-", "xox", "AIza", "sk-", "eyJ"))
        if "=" in text or ":" in text:
            low = text.lower()
            found += ["assigned"] * any(x in low for x in ("passw", "pwd", "secret", "token", "key", "credential"))
        if "assigned" not in found and ("earer" in text or "EARER" in text):
            found.append("assigned")
        found += ["ip6"] * (text.count(":") > 1)
        if _NUMBER.search(text):
            found += ["ip", "iban", "ssn", "card", "phone"]
        elif _ACCOUNT.search(text):
            found.append("iban")
        capital = set(_CAPITAL.findall(text))
        return (*found, *["name"] * (self.odd or not capital.isdisjoint(self.kind_of)), *["capitals"] * (not capital.isdisjoint(self.loud)), *["cued"] * (_CUE.search(text) is not None), *["titled"] * (not capital.isdisjoint(TITLES)))

    def pattern(self, kinds: tuple[str, ...]) -> re.Pattern:
        if kinds not in self.compiled:
            self.compiled[kinds] = re.compile("|".join(f"(?P<{k}>{self.own[k]})" for k in PATTERNS if k in kinds) or r"(?!)")
        return self.compiled[kinds]

    def entities(self, text: str) -> list[tuple[str, int, int, str, str]]:
        kinds = self.kinds(text)
        if not kinds:
            return []
        found, last, at = [], set(), 0
        while m := self.pattern(kinds).search(text, at):
            if m.groupdict().get("iban") and iban_check(m["iban"].replace(" ", "")) != 1:  # no account: something else may be in it
                other = self.pattern(tuple(k for k in kinds if k != "iban")).search(text, m.start())
                digits = plain_digits(other[0]) if other and other.groupdict().get("card") else None
                if other is None or other.start() >= m.end() or digits and self.check(digits[:-1]) != int(digits[-1]):
                    at = m.end()
                    continue
                m = other
            found += self.replace(m)
            at = m.end() if m.end() > m.start() else m.end() + 1
            last |= {x for g in ("name_last", "cued_family", "titled_lone") if (x := m.groupdict().get(g))}
        if last:  # the same people by their surnames alone
            taken = [(s, e) for _, s, e, _, _ in found]
            starts = [s for s, _ in taken]
            for m in _LONE.finditer(text):
                if m[0] in last and ((i := bisect_right(starts, m.start())) == 0 or taken[i - 1][1] <= m.start()):
                    found.append(("name", m.start(), m.end(), m[0], self.one("surname", m[0])))
            found.sort(key=lambda x: x[1])
        return found


def replace_text(text: str, key: Surrogates) -> tuple[str, list[dict]]:
    """The text with surrogates, and the entities with their places in the original, by code point."""
    parts, told, at = [], [], 0
    for kind, start, end, entity, new in key.entities(text):
        parts += [text[at:start], new]
        told.append({"type": kind, "start": start, "end": end, "entity": entity, "surrogate": new})
        at = end
    return ("".join(parts) + text[at:], told) if told else (text, [])


SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity", T.StringType()), T.StructField("surrogate", T.StringType())]))
_ARROW = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("surrogate", pa.string())]))


def surrogates(df: DataFrame, key: bytes, text: str = "text", out: str = "text", spans: str = "entities", names: dict[str, list[str]] | None = None) -> DataFrame:
    """df with each text's personal data replaced, in column out, and what was found in column spans.

    names are lists of first names by gender and script, in place of NAMES. The result is made once, as a table, whose
    entities verify() looks at before it is returned.
    """
    made = cut(replacement(df, key, text, out, spans, names), "surrogates")
    verify(made, spans)
    return made


def replacement(df: DataFrame, key: bytes, text: str, out: str, spans: str, names: dict[str, list[str]] | None = None) -> DataFrame:
    """What surrogates() returns, not verified."""
    kept = [c for c in df.columns if c not in (out, spans)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.StringType()), T.StructField(spans, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Surrogates(key, names)
        for batch in in_lots(batches, text):
            made = [replace_text(t, own) if t is not None else (None, []) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array([t for t, _ in made], pa.string()), pa.array([s for _, s in made], _ARROW)], names=[*kept, out, spans])

    return df.mapInArrow(run, schema)


def normal(kind: str, entity: str, surrogate: str) -> Iterator[tuple[str, str, str]]:
    """(type, entity, surrogate) in one spelling: addresses in lower case, of numbers the digits, without the code 1, of people each part by itself."""
    if kind == "name":
        old, new = entity.split(" "), surrogate.split(" ")
        yield "surname", old[-1].lower(), new[-1].lower()
        yield from (("forename", a.lower(), b.lower()) for a, b in zip(old[:-1], new[:-1]) if not a.endswith("."))
        return
    spell: Callable[[str], str] = {
        "email": str.lower, "iban": lambda x: x.replace(" ", ""), "ssn": plain_digits, "card": plain_digits,
        "phone": lambda x: re.sub(r"^1(?=\d{10}$)", "", plain_digits(x)), "ip": lambda x: ".".join(str(int(o)) for o in x.split(".")), "ip6": lambda x: str(ipaddress.IPv6Address(x)),
    }.get(kind, str)
    a, b = spell(entity), spell(surrogate)
    if not (kind == "ip" and a == b == "0.0.0.0"):
        yield "assigned" if kind == "secret" else kind, a, b


def entities(replaced: DataFrame, spans: str = "entities") -> DataFrame:
    """Distinct (type, entity, surrogate), each in one spelling; assigned values and bare secrets are one type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {x for some in batch.column(0).to_pylist() for e in some or () for x in normal(e["type"], e["entity"], e["surrogate"])}
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*sorted(rows)) if rows else ((), (), ()))], names=["type", "entity", "surrogate"])

    return replaced.select(spans).mapInArrow(run, "type string, entity string, surrogate string").distinct()


def collisions(replaced: DataFrame, spans: str = "entities") -> DataFrame:
    """(type, surrogate, entities): surrogates that stand for more than one entity. Entities are made distinct map-side."""
    return entities(replaced, spans).groupBy("type", "surrogate").agg(F.count(F.lit(1)).alias("entities")).where("entities > 1")


def splits(replaced: DataFrame, spans: str = "entities") -> DataFrame:
    """(type, entity, surrogates): entities that have more than one surrogate."""
    return entities(replaced, spans).groupBy("type", "entity").agg(F.count(F.lit(1)).alias("surrogates")).where("surrogates > 1")


def verify(replaced: DataFrame, spans: str = "entities") -> None:
    """Raises an error if two entities share a surrogate, one has two, or one is its own; nothing of an entity is told but its type."""
    sides = F.array_compact(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("value")) for side in ("surrogate", "entity")], F.when(F.col("entity") == F.col("surrogate"), F.struct(F.lit("same").alias("side"), F.col("entity").alias("value")))))
    each = entities(replaced, spans).select("type", F.explode(sides).alias("s")).groupBy("type", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or s.side = 'same'")
    bad = each.groupBy("type", "s.side").agg(F.count(F.lit(1)).alias("n")).collect()
    if bad:
        told = {"surrogate": "stand for several entities", "entity": "have several surrogates", "same": "stay as they are"}
        raise ValueError("surrogates: " + "; ".join(f"{r.n} of type {r.type} {told[r.side]}" for r in bad))

"""Personal data: detection and surrogate generation.

Entities (e-mail addresses, phone numbers, IPv4 addresses, card and account
numbers, social security numbers, IBANs, secrets, titled person names) are replaced by
keyed surrogates of the same type and format:

* digits, letters and codes go through a keyed Feistel permutation of all strings
  of their format, so different values always get different surrogates and
  equal values the same one everywhere, without a table; layout, country codes, the
  case and script of letters, and the validity of check digits stay;
* names become made-up names of the same script, number of parts and gender (as
  the title tells; the ending of the first of several parts), part by part. A part's
  letters, as a number, go through a keyed permutation too and are written in syllables
  (Latin, Cyrillic and Greek) or letters of the script, followed by keyed check syllables or letters. So a
  surrogate follows from the key, the part and the gender alone, different parts never share one, and a name
  of the corpus that looks made up is one with a chance below a thousandth at most.
* That chance is checked for: a first pass joins hashes of all parts of names with those of all their
  surrogates. A part whose surrogate is another's real name takes a surrogate from a second domain, which is written in two
  halves. There are hardly ever any; more than `most_moved` are an error.

Equal after normalising means same person or account: case in e-mail addresses, layout of
numbers, leading zeros in IPv4 addresses, spaces and case in names.

A name is found after a title, as all capitalised words that follow it in the line. In scripts without
spaces it ends with the script's run of letters, and after no more than names usually have (RUNS), so the sentence that follows
stays, at the price of names that are cut short or end in a particle. Further mentions
in the same text, of the whole name or its last word, get the same parts. Not
found are names without a title anywhere in their text, given names or initials alone, words after
a lower-case particle ("van", "de"), and names in other texts that give no title.

Where spans overlap, the kind that comes first in KINDS wins. No shuffle of texts;
a task's memory is one batch.

Defined results: a null text stays null, with no entities; an empty one stays empty;
repeated rows are treated alike; other columns are kept, but for one that has the name of the spans'
column (entities), which is replaced if spans are asked for; an empty table gives an empty result.

The key is the parameter Surrogates.key, or the session's spark.leadloom.surrogate.key if that is set; the
default is for tests. Surrogate e-mail addresses keep their top-level domain, so some might exist:
`reserved` appends a domain that can't.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import small_batches

#: Titles by gender (f, m or any).
TITLES = {"Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Madame": "f", "Sra.": "f", "Señora": "f", "г-жа": "f", "κυρία": "f", "Mr.": "m", "Mr": "m", "Herr": "m", "Herrn": "m", "M.": "m", "Monsieur": "m", "Sr.": "m", "Señor": "m", "г-н": "m", "κύριος": "m", "Dr.": "any", "Prof.": "any"}
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
#: A word of a name; a possessive s isn't part of it.
_NAME = r"[^\W\d_a-z](?:\w+(?:[-'’](?!s\b)\w+)*|(?:[-'’](?!s\b)\w+)+)"
_WORD = re.compile(rf"(?<!\w){_NAME}")
#: In order of precedence. Digits are ASCII only.
KINDS = {
    "secret": re.compile(r"""(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd))\s*[=:]\s*["']?(?P<v>[A-Za-z0-9+/_.~-]{8,})|\b(?P<w>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})\b"""),
    "email": re.compile(r"(?<![\w.+%-])(?P<v>[\w.+%-]+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})"),
    "iban": re.compile(r"\b(?P<v>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b", re.ASCII),
    "ip": re.compile(r"(?<![0-9.])(?P<v>(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9]))(?![0-9]|\.[0-9])"),
    "ssn": re.compile(r"(?<![0-9-])(?P<v>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "phone": re.compile(r"(?<![0-9+])(?P<v>\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"),
    "card": re.compile(r"(?<![0-9+])(?P<v>[0-9](?:[ -]?[0-9]){12,18})(?![0-9])"),
    "name": re.compile(rf"(?<!\w)(?P<t>{_TITLE})\s+(?P<v>{_NAME}(?:[ ]{_NAME})*)"),
}
#: Texts without any of these can't hold a secret; searching for them is far cheaper than the pattern.
_SECRET_SIGNS = ("=", ":", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")


@dataclass(frozen=True)
class Surrogates:
    key: str = "change-me"
    #: The fewest syllables (or letters, in scripts without) of a made-up name, but for those that check it.
    syllables: int = 2
    #: Appended to addresses, such as ".example".
    reserved: str = ""
    kinds: tuple[str, ...] = tuple(KINDS)
    #: Hashes of parts of names that take the second domain, as `checked` finds them.
    moved: frozenset[int] = frozenset()
    most_moved: int = 10_000


#: Scripts without spaces: a run of so many letters is a name as a whole; of a longer run the name has so many.
RUNS = {"CJK": (4, 3), "HIRAGANA": (4, 4), "KATAKANA": (12, 12), "HANGUL": (3, 3), "THAI": (12, 12)}


def _bounded(value: str, after: str) -> str:
    """A name up to the end of what may be one in a script without spaces. after: the character that follows."""
    words = value.split(" ")
    for n, word in enumerate(words):
        script = _script(word[0])
        if script not in RUNS:
            continue
        run = next((i for i, c in enumerate(word) if _script(c) != script and c not in "ー・"), len(word))
        whole, cut = RUNS[script]
        ends = run == len(word) and (n + 1 < len(words) or not after.isalpha())
        size = run if run <= whole + (script == "CJK" and ends) else cut
        if size < len(word):
            return " ".join([*words[:n], word[:size]])
    return value


def find(text: str, kinds: tuple[str, ...] = tuple(KINDS)) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, value, gender) of entities, in order, without overlaps."""
    digits = any(d in text for d in "0123456789")
    can = {"secret": any(x in text for x in _SECRET_SIGNS), "email": "@" in text, "name": any(t in text for t in TITLES)}
    spans: list = []
    for kind in kinds:
        if can.get(kind, digits):
            found = len(spans)
            for m in KINDS[kind].finditer(text):
                group = "w" if kind == "secret" and m["v"] is None else "v"
                value = m[group]
                if kind == "phone":  # a number that follows isn't part of it
                    while sum(map(str.isdigit, value)) > 15 and (shorter := re.match(r"(.*[0-9)])[ .-][^ .-]*$", value)):
                        value = shorter[1]
                    if not 7 <= sum(map(str.isdigit, value)) <= 15:
                        continue
                if kind == "name":  # ends before a word that begins in lower case
                    value = " ".join([value.split(" ")[0], *takewhile(lambda w: not w[0].islower(), value.split(" ")[1:])])
                    value = _bounded(value, text[m.start(group) + len(value) : m.start(group) + len(value) + 1])
                spans.append((m.start(group), m.start(group) + len(value), kind, value, TITLES[m["t"]] if kind == "name" else ""))
            text = _hidden(text, spans[found:])  # from the kinds that follow
            if kind == "name" and len(spans) > found:
                spans[found:] = _mentions(text, spans[found:])
    return sorted(spans)


def _hidden(text: str, spans: list[tuple]) -> str:
    """The text with zeros in these spans, which are in order."""
    out, at = [], 0
    for start, end, *_ in spans:
        out += [text[at:start], "\0" * (end - start)]
        at = end
    return "".join(out) + text[at:] if spans else text


def _mentions(text: str, titled: list[tuple]) -> list[tuple]:
    """Names with titles, and further mentions of them in the text: of whole names and of their last
    words. A name takes the gender that one of its titles tells, if they don't differ."""
    told: dict[tuple, set[str]] = {}
    for _, _, _, value, gender in titled:
        told.setdefault(tuple(value.lower().split()), set()).add(gender)
    genders = {name: (g - {"any"}).pop() if len(g - {"any"}) == 1 else "any" for name, g in told.items()}
    out = [(start, end, kind, value, genders[tuple(value.lower().split())] if gender == "any" else gender) for start, end, kind, value, gender in titled]
    known = {**{name[-1:]: "any" for name in genders}, **genders}
    lengths = sorted({len(name) for name in known}, reverse=True)
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]  # titled names are hidden
    low = [text[start:end].lower() for start, end in words]
    at = 0
    while at < len(words):
        for n in lengths:
            name = tuple(low[at : at + n])
            if name in known and all(text[words[i][1] : words[i + 1][0]].isspace() for i in range(at, at + len(name) - 1)):
                start, end = words[at][0], words[at + len(name) - 1][1]
                out.append((start, end, "name", text[start:end], known[name]))
                at += len(name) - 1
                break
        at += 1
    # Names in scripts without spaces also stand inside of runs of letters.
    inside = {name[0]: g for name, g in genders.items() if len(name) == 1 and len(name[0]) > 1 and _script(name[0]) in RUNS}
    if inside:
        text = _hidden(text, sorted(out[len(titled) :]))
        sizes = sorted({len(n) for n in inside}, reverse=True)
        at = 0
        while at < len(text):
            size = next((n for n in sizes if text[at : at + n] in inside), 0)
            if size:
                out.append((at, at + size, "name", text[at : at + size], inside[text[at : at + size]]))
            at += size or 1
    return out


# --- permutations of formats ---

#: Alphabets whose letters replace each other.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŒ",
    "".join(map(chr, range(0x430, 0x450))),
    "".join(map(chr, range(0x410, 0x430))),
    "".join(map(chr, range(0x3B1, 0x3CA))),
    "".join(map(chr, range(0x391, 0x3A2))) + "".join(map(chr, range(0x3A3, 0x3AA))),
    "".join(map(chr, range(0x4E00, 0x9FA6))),
    "".join(map(chr, range(0x3041, 0x3097))),
    "".join(map(chr, range(0x30A1, 0x30FB))),
    "".join(map(chr, range(0xAC00, 0xD7A4))),
]
_PLACE = {c: (a, i) for a, letters in enumerate(ALPHABETS) for i, c in enumerate(letters)}


def _round(key: bytes, tweak: str, n: int, value: int) -> int:
    data = f"{tweak}|{n}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big")


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network over a square that
    holds it, walked until it comes back into the range."""
    if size < 2:
        return value
    side = int(size**0.5) + 1 if size < 1 << 100 else 1 << ((size.bit_length() + 1) // 2)
    while side * side < size:
        side += 1
    rounds = 10
    while True:
        a, b = divmod(value, side)
        for n in range(rounds):
            a, b = b, (a + _round(key, f"{tweak}|{size}", n, b)) % side
        value = a * side + b
        if value < size:
            return value


def permuted_text(text: str, key: bytes, tweak: str, alphabets=None) -> str:
    """Permutes the strings with the same letters' alphabets in the same places."""
    place = _PLACE if alphabets is None else {c: (a, i) for a, s in enumerate(alphabets) for i, c in enumerate(s)}
    letters = ALPHABETS if alphabets is None else alphabets
    shape = "".join(chr(0xE000 + place[c][0]) if c in place else c for c in text)
    number, size = 0, 1
    for c in text:
        if c in place:
            a, i = place[c]
            number, size = number * len(letters[a]) + i, size * len(letters[a])
    number = permuted(number, size, key, f"{tweak}|{shape}")
    out = []
    for c in reversed(text):
        if c in place:
            number, i = divmod(number, len(letters[place[c][0]]))
            c = letters[place[c][0]][i]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit for a number without one."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _into(layout: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in layout)


# --- names ---

def _syllables(consonants: str, vowels: str) -> list[str]:
    return [c + v for c in consonants for v in vowels]


#: Syllables, and fixed values: endings of made-up names, by script. No consonant of an ending that is one letter (or begins
#: one of more) makes a word that could also be read otherwise.
SYLLABLES = {
    "LATIN": (_syllables("bdfghklmnpvz", "aeiou"), {"f": ["na", "la", "ra", "lia"], "m": ["n", "r", "s", "tor"], "any": ["n", "l", "ri", "m"]}),
    "CYRILLIC": (_syllables("бвгджзклмнпф", "аеиоу"), {"f": ["на", "ла", "ра", "лия"], "m": ["н", "р", "с", "тор"], "any": ["н", "л", "ри", "м"]}),
    "GREEK": (_syllables("βγδζθκλμνπφχ", "αειου"), {"f": ["να", "λα", "ρα", "λια"], "m": ["νος", "ρος", "σος", "τος"], "any": ["ν", "λ", "ρι", "μ"]}),
}


def _script(name: str) -> str:
    for c in name:
        first = unicodedata.name(c, "").split(" ")[0]
        if c.isalpha():
            return first
    return ""


#: Letters of names by script, in two tiers: the usual ones and further ones. Names with others are numbered
#: by their UTF-8 bytes.
_LETTERS = {
    "LATIN": ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz-'’àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßąćęłńśźżăâîșțčďěňřšťůžğışőű"),
    "CYRILLIC": ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", ""),
    "GREEK": ("αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ", ""),
}
#: Scripts whose names are made up of letters, with ranges of their usual ones.
_RANGES = {
    "CJK": (0x4E00, 0x9FA5), "HIRAGANA": (0x3042, 0x3093), "KATAKANA": (0x30A2, 0x30F3), "HANGUL": (0xAC00, 0xD7A3), "ARABIC": (0x628, 0x63A), "HEBREW": (0x5D0, 0x5EA),
    "DEVANAGARI": (0x905, 0x939), "BENGALI": (0x995, 0x9A8), "THAI": (0xE01, 0xE2E), "ARMENIAN": (0x561, 0x586), "GEORGIAN": (0x10D0, 0x10F0),
}


def _number(part: str, script: str) -> int:
    """A number of its own for each lower-case string, small for short ones of usual letters."""
    if script in _RANGES:
        first, last = _RANGES[script]
        if all(first <= ord(c) <= last for c in part):
            n = 0
            for c in part:
                n = n * (last - first + 1) + ord(c) - first + 1
            return 3 * n
    for tier, letters in enumerate(_LETTERS.get(script, ())):
        if all(c in letters for c in part):
            n = 0
            for c in part:
                n = n * len(letters) + letters.index(c) + 1
            return 3 * n + tier
    return 3 * int.from_bytes(b"\1" + part.encode("utf-8", "surrogatepass"), "big") + 2


def part_hash(part: str) -> int:
    return int.from_bytes(hashlib.blake2b(part.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _made_up(part: str, gender: str, key: bytes, fewest: int, moved: frozenset[int] = frozenset()) -> str:
    """The number of syllables follows from the part's number, which is permuted among those with as many; check
    syllables follow from these. Syllables and endings can be told apart, so no two parts meet."""
    low = part.lower()
    script = _script(part)
    # Surrogates in scripts that aren't known are Latin too, so they are numbered by their bytes among the Latin ones.
    script = script if script in SYLLABLES or script in _RANGES else "LATIN"
    syllables, endings = SYLLABLES[script] if script in SYLLABLES else ([chr(c) for c in range(_RANGES[script][0], _RANGES[script][1] + 1)], None)
    number, many = _number(low, script), fewest
    while len(syllables) ** many <= number:
        many += 1
    second = part_hash(part) in moved
    number = permuted(number, len(syllables) ** many, key, f"name|{script}|{many}{'|second' * second}")
    end, rest, out = endings[gender][number % len(endings[gender])] if endings else "", number, []
    for _ in range(many):
        rest, i = divmod(rest, len(syllables))
        out.append(syllables[i])
    checks = next(n for n in range(1, 9) if len(syllables) ** n >= 1000)
    check = _round(key, f"check|{script}|{many}", 0, number)
    for _ in range(checks):
        check, i = divmod(check, len(syllables))
        out.append(syllables[i])
    word = "".join(out) + end
    if second:  # nothing else has such a mark after its first syllable
        word = out[0] + ("-" if endings else "·") + word[len(out[0]) :]
    return word.upper() if part.isupper() and len(part) > 1 else word[0].upper() + word[1:]


def normal(kind: str, value: str) -> str:
    """What two mentions of the same entity have in common."""
    if kind == "email":
        return value.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind in ("phone", "card", "ssn"):
        return re.sub("[^0-9]", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return " ".join(value.lower().split()) if kind == "name" else value


def surrogate(kind: str, value: str, gender: str, s: Surrogates) -> str:
    key = hashlib.blake2b(s.key.encode(), digest_size=32).digest()
    if kind == "email":
        head, _, top = value.lower().rpartition(".")
        return permuted_text(head, key, f"email|{top}") + f".{top}{s.reserved}"
    if kind == "ip":
        n = 0
        for x in value.split("."):
            n = n * 256 + int(x)
        n = permuted(n, 1 << 32, key, "ip")
        return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))
    if kind == "card":
        digits = normal(kind, value)
        off = (int(digits[-1]) - _luhn(digits[:-1])) % 10
        body = permuted_text(digits[:-1], key, f"card|{off}")
        return _into(value, body + str((_luhn(body) + off) % 10))
    if kind == "phone":
        country = re.match(r"\+([0-9]{1,3})(?![0-9])", value)
        digits = normal(kind, value)
        # A country code stays if the layout sets it apart; otherwise the first digit does.
        n = len(country[1]) if country else int(value[0] == "+")
        return _into(value, digits[:n] + permuted_text(digits[n:], key, f"phone|{digits[:n]}"))
    if kind == "ssn":
        return _into(value, permuted_text(normal(kind, value), key, "ssn"))
    if kind == "iban":
        bare = normal(kind, value)
        body = permuted_text(bare[4:], key, f"iban|{bare[:4]}")
        rest = lambda b: int("".join(str(int(c, 36)) for c in b + bare[:2] + "00")) % 97
        off = (int(bare[2:4]) + rest(bare[4:])) % 97
        # The remainder of the check stays what it was, so valid numbers stay valid.
        it = iter(bare[:2] + f"{(off - rest(body)) % 97:02d}" + body)
        return "".join(c if c == " " else next(it) for c in value)
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", value):
            return permuted_text(value, key, "hex", ["0123456789abcdef"])
        return permuted_text(value, key, "secret")
    parts = value.split()
    return " ".join(_made_up(p, "any" if n or len(parts) == 1 else gender, key, s.syllables, s.moved) for n, p in enumerate(parts))


def replaced(text: str, s: Surrogates, known: dict) -> tuple[str, list[dict]]:
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, value, gender in find(text, s.kinds):
        new = known.get((kind, value, gender))
        if new is None:
            if len(known) > 50_000:
                known.clear()
            new = known[kind, value, gender] = surrogate(kind, value, gender, s)
        out += [text[at:start], new]
        size += start - at
        spans.append({"start": size, "end": size + len(new), "kind": kind})
        size += len(new)
        at = end
    return "".join(out) + text[at:], spans


def checked(docs: DataFrame, s: Surrogates, gathered: int = 100_000) -> Surrogates:
    """`s`, and the parts of names in `docs` whose surrogate is the real name of another: hashes of all parts of names are joined with
    those of all their surrogates, each task sending what is distinct in it. Only what collides comes to the driver."""
    if "name" not in s.kinds:
        return s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.blake2b(s.key.encode(), digest_size=32).digest()
        seen: set[tuple[str, str]] = set()

        def sent() -> pa.RecordBatch:
            rows = {(part_hash(part), None) for part, _ in seen} | {(part_hash(_made_up(part, g, key, s.syllables)), part_hash(part)) for part, g in seen}
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.int64())], ["h", "part"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and any(x in text for x in TITLES):
                    for _, _, kind, value, gender in find(text, s.kinds):
                        if kind == "name":
                            parts = value.lower().split()
                            seen.update((p, "any" if n or len(parts) == 1 else gender) for n, p in enumerate(parts))
                    if len(seen) > gathered:
                        yield sent()
                        seen = set()
        yield sent()

    rows = docs.select("text").mapInArrow(run, "h long, part long").groupBy("h").agg(F.max(F.col("part").isNull()).alias("real"), F.max("part").alias("part"), F.min("part").alias("other"))
    found = rows.filter("real AND part IS NOT NULL").select(F.explode(F.array("part", "other")).alias("part")).distinct().limit(s.most_moved + 1).collect()
    if len(found) > s.most_moved:
        raise ValueError(f"more than {s.most_moved} surrogates are names of the corpus: take another key")
    return replace(s, moved=s.moved | {r.part for r in found})


def protect(docs: DataFrame, s: Surrogates | None = None, spans: str | None = "entities") -> DataFrame:
    """`docs` with its texts rewritten, and (unless `spans` is None) a column array<struct<start, end, kind>>
    with the places of the surrogates in the new text (in code points)."""
    if s is None:
        s = Surrogates(key=docs.sparkSession.conf.get("spark.leadloom.surrogate.key", Surrogates.key))
    now = checked(small_batches(docs), s)
    rest = docs.drop(spans) if spans else docs
    names = rest.schema.names
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())])
    schema = StructType([*rest.schema.fields, *([StructField(spans, ArrayType(span))] if spans else [])])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                k = names.index("text")
                done = [(None, []) if t is None else replaced(t, now, known) for t in part.column(k).to_pylist()]
                columns = list(part.columns)
                columns[k] = pa.array([t for t, _ in done], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([e for _, e in done], arrow)] if spans else [])], schema.names)

    return rest.mapInArrow(run, schema)

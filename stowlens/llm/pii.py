"""PII surrogates: each detected entity gets a keyed replacement of its own kind and form.

A surrogate is drawn by HMAC from the key, the entity's kind and its canonical form, so all
mentions of an entity, in whatever spelling, get the same one (coreference): a phone number with +,
with 00 or, in the North American plan, with neither; a name in capitals; hexadecimal in either case.
It keeps what the kind needs: a card its first digit and Luhn state, a phone its country code, trunk 0
and 555 exchange, an e-mail address a reserved domain, IPv6 the documentation prefix, a name its script
and, as the title or a known first name tells it, its gender. Letters are redrawn in their own script.
Case, separators and length of the mention stay.

A name is found after a title, or where a known first name begins it. Its words are then looked up in
the whole document, so that mentions without a title get the same surrogates; a name that has neither
in its document, a mention in small letters and initials stay.

Collision checks keep distinct entities distinct, whatever their kinds: an entity whose surrogate
equals another's, or equals an entity that occurs in the texts, draws again, until none is left. The
space of names is chosen by how many names there are, and grows with every draw, as do other forms
after SAME_FORM draws, so that a few draws are enough; only the entities that draw again are rewritten.

Defined results: a null text stays null, a text without entities is returned as it is; repeated
rows are rewritten alike; further columns pass through; n_chars, where there is one, follows the
new text; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import functools
import hmac
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowlens.llm.common import Scratch, map_batches, ship, written

#: Draws of an entity that keep its form; later ones add a digit or letter each.
SAME_FORM = 3
#: A space of names has so many names for each entity, at least.
SPACE = 32

#: Titles and the gender they tell, n if none (fixed values).
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "господин": "m", "κύριος": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "madame": "f", "mme": "f", "mlle": "f", "señora": "f", "sra": "f", "srta": "f",
    "госпожа": "f", "κυρία": "f",
    "dr": "n", "prof": "n", "doctor": "n", "professor": "n", "doktor": "n",
}
#: First names that tell a name without a title, and their gender (own list, fixed values).
FIRST_NAMES = {
    **dict.fromkeys(
        "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Kenneth George Kevin Brian Edward Peter Henry Jack Oliver Harry"
        " Hans Klaus Jürgen Wolfgang Stefan Andreas Anton Friedrich Heinrich Jean Pierre Philippe Jacques Luc Antoine Carlos José Juan Luis Miguel Pedro Pablo Diego Javier"
        " Иван Сергей Алексей Дмитрий Николай Γιώργος Δημήτρης Νίκος".split(), "m"),
    **dict.fromkeys(
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Emily Emma Anna Laura Julia Alice Helen Margaret Maria Catherine Rachel Sophie"
        " Petra Sabine Ursula Monika Ingrid Heike Claudia Marie Camille Chloé Isabelle Nathalie Sylvie María Carmen Lucía Sofía Elena Ana Isabel Rosa"
        " Мария Ольга Наталья Татьяна Елена Μαρία Ελένη Κατερίνα".split(), "f"),
}
#: Syllables of names by script, and endings by gender; l is for last names (fixed values).
SYLLABLES = {
    "latin": ["ba", "den", "fa", "gor", "hel", "jo", "ka", "lin", "mar", "ne", "or", "pe", "ras", "sel", "tor", "ul", "vi", "wen", "ya", "zan"],
    "cyrillic": ["ба", "вен", "го", "дар", "же", "за", "ки", "лом", "ми", "нор", "пе", "рас", "со", "тил", "фе", "ша"],
    "greek": ["αλ", "βε", "γιο", "δη", "ερ", "ζω", "θα", "κο", "λιν", "μαρ", "νε", "πολ", "ρα", "σω", "τε", "φι"],
}
ENDINGS = {
    "latin": {"m": "o", "f": "a", "n": "i", "l": "er"}, "cyrillic": {"m": "ий", "f": "а", "n": "и", "l": "ин"}, "greek": {"m": "ος", "f": "η", "n": "ι", "l": "ης"},
    "han": {"m": "伟", "f": "丽"}, "arabic": {"f": "ة"}, "hebrew": {"f": "ה"},
}
#: Letters that are drawn for one of a script, by code points; of any other script those of the letter's kind near it (fixed values).
LETTER_RANGES = {
    "latin": (0x61, 0x7A), "greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "hebrew": (0x5D0, 0x5EA), "arabic": (0x628, 0x648),
    "devanagari": (0x915, 0x939), "thai": (0xE01, 0xE2E), "hiragana": (0x3042, 0x3093), "katakana": (0x30A2, 0x30F3), "han": (0x4E00, 0x5FFF), "hangul": (0xAC00, 0xD7A3),
}
#: What a letter's Unicode name begins with in each script (fixed values).
SCRIPT_NAMES = {"CJK": "han", **{k.upper(): k for k in LETTER_RANGES if k != "han"}}
#: Country calling codes of two digits; those that begin with 1 or 7 have one digit, others three (fixed values).
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
#: A word of a name, which may have an apostrophe, and what may stand between two: initials and small words.
_WORD = rf"(?!(?i:{_TITLE})\b)[^\W\d_a-zа-яα-ω](?:[^\W\d_]+(?:['’](?=[^\W\d_a-zа-яα-ω][^\W\d_])[^\W\d_]+)?|['’][^\W\d_a-zа-яα-ω][^\W\d_]+)"
_INITIAL = r"[^\W\d_a-zа-яα-ω]\."
_SMALL = r"(?:van|von|vom|der|den|ter|ten|zu|zur|de|del|della|di|da|dos|du|la|le|bin|ibn|y|af|av)"
#: The kinds of words of names.
NAMES = ("first_m", "first_f", "first_n", "last")
#: Kinds in order of precedence; group v is the entity where there is one.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")),
    ("secret", re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|password|passwd|pwd)\b[\"']?\s*[:=]\s*[\"']?(?P<v>[^\s\"'<>]{8,}\b|(?=[^\s\"'<>]*\d)[^\s\"'<>]{5,7}\b)")),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|(?=[0-9a-f]*\d)[0-9a-f]{32,128}|(?=[0-9A-F]*\d)[0-9A-F]{32,128})\b")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")),
    ("phone", re.compile(r"(?<![\w+.-])00[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)")),
    ("card", re.compile(r"(?<![\d-])(?:[1-9]\d{12,18}|[1-9]\d{3}([ -])\d{4}\1\d{4}\1\d{1,7}|[1-9]\d{3}([ -])\d{6}\2\d{5})(?![\d-])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)")),
    ("phone", re.compile(r"(?<![\w(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)")),
    ("phone", re.compile(r"(?<![\w+./-])(?:0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4} \d{6}|0\d(?: \d\d){4}|0\d{2,4}[/-]\d{5,8})(?![\d-])")),
    ("name", re.compile(rf"\b(?P<t>(?:(?i:{_TITLE})\.?[ \u00a0])+)(?P<v>(?:(?:{_INITIAL} ?|{_SMALL} )*)(?P<w>{_WORD})(?:(?:-| (?:(?:{_INITIAL} ?|{_SMALL} )*)){_WORD})*)")),
]
#: A known first name and the capitalised words after it; initials and small words may stand between.
KNOWN = re.compile(rf"\b(?P<v>(?:{'|'.join(FIRST_NAMES)})(?:(?:-| (?:(?:{_INITIAL} ?|{_SMALL} )*)){_WORD})+)")
_JOINS = str.maketrans(dict.fromkeys("-([{\"'“„«¿¡/", " "))
NAME_WORD = re.compile(_WORD)
#: Words of letters, in which untitled mentions of the names found are looked up.
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
TITLED = re.compile(rf"(?i)\b(?:{_TITLE})\b")
CONTEXT = re.compile(r"(?i)key|secret|token|pass|pwd")
DIGIT = re.compile(r"\d")
HEXLIKE = re.compile(r"[0-9a-fA-F]{32,128}")


@functools.cache
def script_of(letter: str) -> str:
    """The script of a letter; "" of one that LETTER_RANGES lacks."""
    return SCRIPT_NAMES.get(unicodedata.name(letter, "").split(" ")[0], "")


@functools.cache
def alphabet(script: str, letter: str) -> list[str]:
    """Letters of a script in small letters; of an unnamed script those near a letter that are of its kind."""
    if script:
        a, b = LETTER_RANGES[script]
        return [chr(c) for c in range(a, b + 1) if unicodedata.category(chr(c)) in ("Ll", "Lo") and chr(c) != "ς"]
    near, kind = ord(letter) & ~0x7F, unicodedata.category(letter)
    return [chr(c) for c in range(near, near + 128) if unicodedata.category(chr(c)) == kind]


def country_code(digits: str) -> str:
    """The calling code that an international number begins with."""
    return digits[: 1 if digits[:1] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3]


def canonical(kind: str, value: str) -> str | None:
    """One form for all spellings of an entity; None if a closer look says that it isn't one."""
    if kind == "email":
        return value.lower()
    if kind == "ip":
        if ":" not in value:
            return value
        try:
            return ipaddress.IPv6Address(value).compressed if len(value) > 5 and DIGIT.search(value) else None
        except ValueError:
            return None
    plain = value if kind == "secret" else "".join(c for c in value if c.isalnum())
    if kind == "phone":
        if len(plain) > 17:  # more than 15 digits after 00
            return None
        if value[0] == "+" or plain[:2] == "00":
            return "+" + plain.removeprefix("00")
        return plain if plain[0] == "0" else "+1" + plain
    return plain.lower() if kind == "secret" and HEXLIKE.fullmatch(plain) else plain


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 is valid."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10


def _named(text: str) -> list[list[tuple[str, int, int, str]]]:
    """The names of a text after a title or a known first name, each as its words with kinds: first ones with their gender, then a last one."""

    def words_of(span: tuple[int, int]) -> list[tuple[int, int, str]]:
        return [(a, b, text[a:b].lower().replace("’", "'")) for a, b in (w.span() for w in NAME_WORD.finditer(text, *span))]

    names = []
    for m in PATTERNS[-1][1].finditer(text) if TITLED.search(text) else ():
        told = {TITLES[w.lower()] for w in LETTERS.findall(m["t"]) if w.lower() in TITLES} - {"n"}
        gender = told.pop() if len(told) == 1 else "n"
        words = words_of(m.span("v"))
        names.append([("first_" + gender, *w) for w in words[:-1]] + [("last", *words[-1])])
    for m in () if FIRST_NAMES.keys().isdisjoint(text.translate(_JOINS).split()) else KNOWN.finditer(text):
        gender = FIRST_NAMES[text[m.start() :].split(" ", 1)[0].split("-", 1)[0]]
        words = words_of(m.span("v"))
        names.append([("first_" + gender, *w) for w in words[:-1]] + [("last", *words[-1])])
    # what the other mentions tell: the gender of a first name after Dr or Prof, and that a single word is a first name
    kinds: dict[str, str] = {}
    lasts = {n[-1][3] for n in names if len(n) > 1}
    for kind, *_, value in (w for n in names for w in n[:-1]):
        if kinds.get(value, "first_n") == "first_n":
            kinds[value] = kind
    for n in names:
        if len(n) == 1 and n[0][3] in kinds and n[0][3] not in lasts:
            n[0] = (kinds[n[0][3]], *n[0][1:])
        n[:] = [(kinds[value] if kind == "first_n" else kind, a, b, value) for kind, a, b, value in n]
    return names


def _untitled(text: str, names: list[list[tuple[str, int, int, str]]]) -> Iterator[tuple[str, int, int, str]]:
    """Capitalised words of a text that are words of its names; a first name if they are both and another word of a name follows."""
    first = {value: kind for n in names for kind, *_, value in n if kind != "last"}
    last = {value for n in names for kind, *_, value in n if kind == "last"}
    hits = []
    for m in LETTERS.finditer(text):
        word = m[0]
        if word[0].islower():
            continue
        value = word.lower().replace("’", "'")
        while value not in first and value not in last and (cut := value.rfind("'")) > 0:  # Smith's
            value = value[:cut]
        if value in first or value in last:
            hits.append((m.start(), m.start() + len(value), value))
    for k, (a, b, value) in enumerate(hits):
        follows = k + 1 < len(hits) and hits[k + 1][0] - b == 1
        yield (first[value] if value in first and (value not in last or follows) else "last"), a, b, value


def entities(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, canonical form) of the entities of a text, in order, without overlaps."""
    digits, at = DIGIT.search(text) is not None, "@" in text
    found: list[tuple[str, int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, a: int, b: int, value: str) -> None:
        k = bisect.bisect_left(taken, (b,))  # the spans before it begin before b; only the last of them can reach a
        if not (k and taken[k - 1][1] > a):
            taken.insert(k, (a, b))
            found.append((kind, a, b, value))

    for kind, pattern in PATTERNS:
        if kind == "email" and not at or kind in ("ip", "card", "ssn", "phone", "iban") and not digits:
            continue
        if kind == "secret" and not (CONTEXT.search(text) if "v" in pattern.groupindex else digits):
            continue
        if kind == "name":
            names = _named(text)
            for word in (w for n in names for w in n):
                add(*word)
            if names:
                for word in _untitled(text, names):
                    add(*word)
            continue
        for m in pattern.finditer(text) if kind != "ip" or "." in text or ":" in text else ():
            group = "v" if "v" in pattern.groupindex else 0
            if (value := canonical(kind, m[group])) is not None:
                add(kind, *m.span(group), value)
    return sorted(found, key=lambda e: e[1])


class Draw:
    """A stream of numbers from a key and a label."""

    def __init__(self, key: bytes, label: str):
        self.key, self.label, self.n = key, label, 0
        self.block = b""

    def below(self, n: int) -> int:
        if len(self.block) < 8:
            self.block = hmac.digest(self.key, f"{self.n}\0{self.label}".encode(), "sha256")
            self.n += 1
        out, self.block = int.from_bytes(self.block[:8], "big") % n, self.block[8:]
        return out

    def like(self, c: str) -> str:
        """A character of c's class and script."""
        if c.isdigit():
            return str(self.below(10))
        if not c.isalpha():
            return c
        script = script_of(c)
        letters = alphabet(script, "" if script else c)
        new = letters[self.below(len(letters))]
        return new.upper() if c.isupper() else new


def surrogate(kind: str, value: str, key: bytes, draw: int, syllables: int = 2) -> str:
    """The draw-th surrogate of an entity, in canonical form; syllables says how long its space of names needs them."""
    d = Draw(key, f"{kind}\0{value}\0{draw}")
    extra = max(0, draw - SAME_FORM + 1)  # a full space is widened
    if kind == "email":
        local, _, domain = value.rpartition("@")
        new = "".join(map(d.like, local)) + "".join(d.like("0") for _ in range(8 * extra))
        kept = re.search(r"(?:^|\.)(example\.(?:com|net|org))$", domain)
        head = domain[: -len(kept[1])] if kept else domain.rpartition(".")[0] + "."
        return f"{new}@{''.join(map(d.like, head))}{kept[1] if kept else 'example'}"
    if kind == "ip":
        if ":" in value:
            return ipaddress.IPv6Address((0x20010DB8 << 96) + (d.below(1 << 48) << 48) + d.below(1 << 48)).compressed
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind in NAMES:
        script, role = script_of(value[0]), kind[-1] if kind[0] == "f" else "l"
        end = ENDINGS.get(script, {}).get(role, "")
        if script in SYLLABLES:
            return "".join(SYLLABLES[script][d.below(len(SYLLABLES[script]))] for _ in range(syllables + draw)) + end
        letters = alphabet(script, "" if script else value[0])
        n = max(1, syllables, len(value) - len(end)) + draw
        return "".join(letters[d.below(len(letters))] for _ in range(n)) + end
    if kind == "card":
        body = value[0] + "".join(d.like("0") for _ in range(len(value) - 2 + extra))
        ends = [c for c in "0123456789" if (luhn(body + c) == 0) == (luhn(value) == 0)]
        return body + ends[d.below(len(ends))]
    if kind == "phone":
        keep = 1 + len(country_code(value[1:])) if value[0] == "+" else 1  # or the trunk 0
        new = list(value[:keep]) + [d.like("0") for _ in value[keep:]]
        if value[-7:-4] == "555" and len(value) - 7 >= keep:
            new[-7:-4] = "555"
        return "".join(new) + "".join(d.like("0") for _ in range(extra))
    if kind == "iban":
        return value[:2] + "".join(map(d.like, value[2:])) + "".join(d.like("0") for _ in range(extra))
    if kind == "secret" and HEXLIKE.fullmatch(value):
        return "".join("0123456789abcdef"[d.below(16)] for _ in range(len(value) + extra))
    return "".join(map(d.like, value)) + "".join(d.like("0") for _ in range(extra))


def render(kind: str, mention: str, new: str) -> str:
    """The surrogate in the form of a mention: its separators, and its case where all letters agree."""
    if kind in ("email", "ip"):
        return new.upper() if mention.isupper() else new
    if kind in NAMES:
        return new.upper() if len(mention) > 1 and mention.isupper() else new.capitalize()
    if kind == "secret":
        letters = [c for c in mention if c.isalpha()]
        return new.upper() if re.fullmatch(r"[0-9a-f]+", new) and letters and all(c.isupper() for c in letters) else new
    begin = ""
    if kind == "phone" and new[0] == "+":  # the mention has 00, +, or neither of North America's numbers
        begin = "00" if mention[:2] == "00" else ""
        new = new[1:] if begin or mention[0] == "+" else new[2:]
    rest = list(reversed(begin + new))
    return "".join(rest.pop() if c.isalnum() and rest else c for c in mention) + "".join(reversed(rest))


_SPANS = "array<struct<kind: string, first: int, last: int, value: string>>"


def with_entities(docs: DataFrame) -> DataFrame:
    """docs with a column pii_entities of the spans found in `text`."""
    at = docs.columns.index("text")
    span = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("value", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[dict(zip(("kind", "first", "last", "value"), e, strict=True)) for e in entities(t)] if t else [] for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(span))], [*batch.schema.names, "pii_entities"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"pii_entities {_SPANS}"])
    return map_batches(docs, run, schema)


def syllables_for(count: int, letters: int) -> int:
    """The least length, of 2 at least, at which a space of so many letters or syllables has SPACE names for each entity."""
    n = 2
    while letters**n < SPACE * count:
        n += 1
    return n


def _draw(table: DataFrame, key: bytes, lengths: dict[tuple[str, str], int]) -> DataFrame:
    """(kind, value, draw) with their surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            new = [surrogate(k, v, key, n, lengths.get((k, script_of(v[0])), 2) if k in NAMES else 2) for k, v, n in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], ["kind", "value", "draw", "surrogate"])

    ship(table.sparkSession)
    return table.select("kind", "value", "draw").mapInArrow(run, "kind string, value string, draw int, surrogate string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) of distinct entities: no two surrogates agree, of whatever kinds, and none is a real entity."""
    work = Scratch(found.sparkSession)
    real = work.written(found.select("kind", "value").distinct())
    # how many names each kind has in each script, and so how long they must be
    per = real.where(F.col("kind").isin(*NAMES)).groupBy("kind", F.substring("value", 1, 1).alias("letter")).count().collect()
    counts: Counter = Counter()
    for r in per:
        counts[r.kind, script_of(r.letter)] += r["count"]
    lengths = {(kind, script): syllables_for(n, len(SYLLABLES.get(script) or (alphabet(script, "") if script else "x" * 16))) for (kind, script), n in counts.items()}
    values = real.select(F.col("value").alias("surrogate")).distinct()
    draw, settled = 0, []
    new = work.written(_draw(real.withColumn("draw", F.lit(draw)), key, lengths))
    while True:
        # the first of those that drew the same keeps it, unless an entity or an earlier surrogate has it
        taken = values
        for done in settled:
            taken = taken.unionByName(done.select("surrogate"))
        first = new.groupBy("surrogate").agg(F.min(F.concat("kind", F.lit("\0"), "value")).alias("owner"))
        first = first.join(taken, "surrogate", "left_anti")
        marked = new.join(work.written(first), "surrogate", "left")
        marked = work.written(marked.withColumn("stays", F.coalesce(F.col("owner") == F.concat("kind", F.lit("\0"), "value"), F.lit(False))))
        settled.append(marked.where("stays").select("kind", "value", "surrogate"))
        again = marked.where("not stays").select("kind", "value")
        if again.isEmpty():
            break
        draw += 1
        new = work.written(_draw(again.withColumn("draw", F.lit(draw)), key, lengths))
    out = settled[0]
    for done in settled[1:]:
        out = out.unionByName(done)
    out = written(out)
    work.clear()
    return out


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with `text` rewritten, and n_replaced. Texts are searched once; what was found is written with them."""
    names = [c for c in docs.columns if c not in ("n_replaced", "pii_entities", "pii_uid")]
    docs = docs.select(*names)
    seen = written(with_entities(docs).withColumn("pii_uid", F.monotonically_increasing_id()))
    spans = seen.where(F.size("pii_entities") > 0).select("pii_uid", F.inline("pii_entities"))
    new = spans.join(assign(spans, key), ["kind", "value"])
    new = new.groupBy("pii_uid").agg(F.array_sort(F.collect_list(F.struct("first", "last", "kind", "surrogate"))).alias("pii_new"))
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
            parts, end = [], 0
            for s in spans:
                parts += [text[end : s["first"]], render(s["kind"], text[s["first"] : s["last"]], s["surrogate"])]
                end = s["last"]
            texts.append("".join([*parts, text[end:]]))
            counts.append(len(spans))
        columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[: len(names)])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*names, "n_replaced"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "n_replaced int"])
    some = seen.where(F.size("pii_entities") > 0)
    rewritten = map_batches(some.join(new, "pii_uid").select(*names, "pii_new"), run, schema)
    if "n_chars" in names:
        rewritten = rewritten.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    untouched = seen.where(F.size("pii_entities") == 0).select(*names, F.lit(0).alias("n_replaced"))
    return untouched.unionByName(rewritten)

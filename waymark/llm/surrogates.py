"""Personal data replaced by surrogates: keyed, of the same type and format, distinct and consistent.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, long numbers such as cards (13 to 19 digits), secrets
(values given to token, password, key and the like, and long hexadecimal strings) and names after a title. What is
detected becomes an entity, its type and normalised value, so the same number written in two ways, or a surname after two
titles, is one entity and gets one surrogate everywhere. A later pattern is tried again in what earlier ones left free, so
a number that would reach into an address is still found. Names have up to four parts, which begin with a capital of any
script and may hold apostrophes, hyphens and further capitals; initials and small words such as "von" stay.

A surrogate follows from a keyed hash (HMAC-SHA256) of type, value and attempt. It keeps the format: digits stay digits
of the same script, letters letters of the same case, separators stay; country codes, top-level domains and valid check
digits of cards are kept; octets of addresses stay in range; names come from lists by the title's gender and the script.
What is kept of a value follows from the value alone, so all spellings of an entity show the same surrogate.

Collision checks run over the entities of all documents, one row for each: a surrogate that two entities share, or that
is itself the value of an entity, is drawn again for all but the smallest, until no collision is left. Where the values
of a format are nearly used up (version-like addresses, say), that would not end; so from the attempt `WIDER` on the format
widens: octets of any length, then a part more; numbers, addresses and secrets grow at the end, by one for each attempt.
Documents then compute first attempts themselves; the few entities that needed more come by a join.

Cases: null texts stay null, empty ones empty. Whole texts are searched, however long. Repeated rows change alike. Null
ids are allowed: nothing depends on ids. No rows give no rows. Other columns pass through, whatever their names; `text`
is replaced and `n_entities` added (or replaced).
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import CAPITALS, spare_names, stage

#: The attempt from which on formats widen.
WIDER = 4
#: Titles by gender, and names to draw from by script and gender.
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr г-н господин".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra г-жа госпожа".split(),
    "n": "Dr Prof".split(),
}
NAMES = {
    "latin": {
        "m": "Adam Bruno Carl David Erik Felix Georg Henry Ivan Jonas Kevin Louis Martin Noah Oscar Paul".split(),
        "f": "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula".split(),
        "n": "Alex Robin Kim Sasha Noel Jules Luca Mika".split(),
        "last": "Abel Brandt Carver Duval Ebert Fisher Garnier Haas Iversen Jansen Keller Lambert Moreno Novak Ortiz".split(),
    },
    "cyrillic": {
        "m": "Алексей Борис Виктор Григорий Дмитрий Егор Иван Кирилл".split(),
        "f": "Анна Вера Галина Дарья Елена Жанна Ирина Ксения".split(),
        "n": "Саша Женя Валя".split(),
        "last": "Азаров Беляев Власов Громов Дорохов Ершов Жуков Зимин".split(),
    },
}


_GENDER = {title.lower(): gender for gender, titles in TITLES.items() for title in titles}
_TITLES = "|".join(sorted(_GENDER, key=len, reverse=True))
#: Letters of any script; letters may be followed by combining marks.
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])"
_BETWEEN = r"[^\S\r\n]+"
#: Small words inside names, and ones that are joined to the next part.
_SMALL = rf"(?:(?:von|vom|zu|zur|zum|van|der|den|de|del|della|da|das|do|dos|di|du|la|las|le|los|ter|ten|bin|ibn|al|el|y|и){_BETWEEN}){{0,3}}"
_JOINED = r"(?:(?:[dl]|al|el)['’ʼ\-])?"
_PART = rf"(?!(?i:{_TITLES})\b){_JOINED}[{CAPITALS}](?:{_LETTER}+(?:['’ʼ‐‑\-]{_LETTER}+)*|(?:['’ʼ‐‑\-]{_LETTER}+)+)"
_INITIALS = rf"(?:[{CAPITALS}]\.(?:{_BETWEEN}|-)?){{0,3}}"
_SOLE = rf"{_INITIALS}{_SMALL}{_PART}"
_TITLED = rf"\b(?:(?i:{_TITLES})\b\.?{_BETWEEN})+"
_GROUP = r"\+\d{1,3}[ .\-]?"
#: In order: a later pattern looks only into what the earlier ones left free.
PATTERNS = {
    "email": re.compile(r"[\w.%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    "secret": re.compile(
        r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)\b\s*[=:]\s*[\"']?([A-Za-z0-9_\-+/]{12,})"
    ),
    "hex": re.compile(r"\b(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)"),
    # groups of two digits after a country code, groups of three or four, mixed groups, five pairs with a leading zero
    "phone": re.compile(
        rf"(?<![\w+])(?:{_GROUP}(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .\-]?\d{{3,4}})?(?:[ .\-]\d\d){{2,6}}(?![ .\-]?\d|\w)"
        rf"|(?:{_GROUP}(?:\(\d{{2,4}}\)|\d{{2,4}})|\(\d{{3}}\)|\d{{3}}-)(?:[ .\-]?\d{{3,4}}){{1,3}}(?!\w)"
        rf"|{_GROUP}(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .\-]?\d{{2,4}}){{2,6}}(?!\w)"
        r"|0\d(?:[ .\-]\d\d){4}(?![ .\-]?\d|\w))"
    ),
    "number": re.compile(r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\w)"),
    "name": re.compile(rf"({_TITLED})({_SOLE}(?:{_BETWEEN}{_SOLE}){{0,3}})"),
}
#: What every match of a pattern holds, a cheap look at the whole text.
_PAIR = re.compile(r"\d[ .\-]?\d")
NEEDS = {
    "email": re.compile("@"), "secret": re.compile("[=:]"), "hex": re.compile("[0-9a-fA-F]{32}"), "ip": re.compile(r"\d\.\d"),
    "phone": _PAIR, "number": _PAIR,
}
#: A group of digits that goes on a telephone number of less than `SHORT` digits with a country code.
_MORE, SHORT = re.compile(r"[ .\-]\d{2,4}(?!\w)"), 10
_NAME = re.compile(rf"{_PART}")


#: Country calling codes of one and two digits; all others have three.
CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 "
    "94 95 98".split()
)


def _value(kind: str, text: str) -> str:
    if kind in ("phone", "number"):
        digits = "".join(str(int(c)) for c in text if c.isdecimal())
        return f"+{digits}" if kind == "phone" and text.startswith("+") else digits
    return re.sub("[’ʼ]", "'", re.sub("[‐‑]", "-", text.lower())) if kind.startswith(("first", "last")) else text.lower()


def _parts(kind: str, match: re.Match, stop: int) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a match."""
    start, end = match.span(1 if kind == "secret" else 0)
    if kind == "phone" and match.group().startswith("+"):
        while sum(map(str.isdecimal, match.string[start:end])) < SHORT and (more := _MORE.match(match.string, end, stop)):
            end = more.end()
    if kind != "name":
        return [(start, end, "secret" if kind == "hex" else kind)]
    genders = [_GENDER[title.rstrip(".").lower()] for title in match.group(1).split()]
    gender = next((gender for gender in genders if gender != "n"), "n")
    spans = [m.span() for m in _NAME.finditer(match.string, *match.span(2))]
    kinds = [f"first_{gender}"] * (len(spans) - 1) + ["last"]
    return [(*span, own) for span, own in zip(spans, kinds, strict=True)]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of each entity, in order and without overlap. Names give one entity for each part."""
    found: list[tuple[int, int, str, str]] = []
    free = [(0, len(text))]
    for kind, pattern in PATTERNS.items():
        if kind in NEEDS and not NEEDS[kind].search(text):
            continue
        left = []
        for at, stop in free:
            while match := pattern.search(text, at, stop):
                for start, end, own in _parts(kind, match, stop):
                    found.append((start, end, own, _value(own, text[start:end])))
                    left.append((at, start))
                    at = end
            left.append((at, stop))
        free = [(start, stop) for start, stop in left if start < stop]
    return sorted(found)


class _Stream:
    """An endless keyed sequence of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int) -> None:
        self.key, self.seed, self.count, self.bytes = key, f"{kind}\0{value}\0{attempt}".encode(), 0, b""

    def below(self, most: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hmac.new(self.key, self.seed + self.count.to_bytes(4, "little"), hashlib.sha256).digest()
            self.count += 1
        number, self.bytes = int.from_bytes(self.bytes[:4], "little"), self.bytes[4:]
        return number % most


def _letter(stream: _Stream, c: str) -> str:
    if c.isdecimal():
        return chr(ord(c) - int(c) + stream.below(10))
    for first, count in (("a", 26), ("A", 26), ("а", 32), ("А", 32)):
        if ord(first) <= ord(c) < ord(first) + count:
            return chr(ord(first) + stream.below(count))
    return chr(ord("a") + stream.below(26)) if c.isalpha() else c


def _luhn(digits: str) -> int:
    doubled = [int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
    return -sum(doubled) % 10


def _calling_code(value: str) -> int:
    """Length of the plus sign and country code that a telephone number begins with."""
    if not value.startswith("+"):
        return 0
    return next((n + 1 for n in (1, 2) if value[1 : n + 1] in CALLING), 4)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The normalised surrogate of an entity."""
    stream = _Stream(key, kind, value, attempt)
    more = max(0, attempt - WIDER + 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        labels[-2] = "".join(_letter(stream, c) for c in labels[-2])
        return "".join(_letter(stream, c) for c in local + "a" * more) + "@" + ".".join(labels)
    if kind == "ip":
        octets = []
        for octet in value.split("."):
            low, high = (1, 223) if more else {1: (1, 9), 2: (10, 99)}.get(len(octet), (100, 223 if not octets else 255))
            octets.append(str(low + stream.below(high - low + 1)))
        return ".".join([*octets, *(str(1 + stream.below(255)) for _ in range(more - 1))])
    if kind == "number":
        digits = value[0] + "".join(str(stream.below(10)) for _ in value[1:] + "0" * more)
        return digits[:-1] + str(_luhn(digits[:-1])) if _luhn(value[:-1]) == int(value[-1]) else digits
    if kind == "phone":
        kept = _calling_code(value)
        return value[:kept] + "".join(str(stream.below(10)) for _ in value[kept:] + "0" * more)
    if kind == "secret":
        hexadecimal = all(c in "0123456789abcdef" for c in value)
        longer = value + "a0" * more
        return "".join("abcdef"[stream.below(6)] if hexadecimal and c.isalpha() else _letter(stream, c) for c in longer)
    names = NAMES["cyrillic" if re.search("[а-яё]", value) else "latin"]
    pool = names["last"] if kind == "last" else names[kind[-1]]
    parts = [pool[stream.below(len(pool))]]
    for _ in range(attempt):  # the lists are short: further attempts join two names, then more
        parts.append(pool[stream.below(len(pool))])
    return "-".join(parts).lower()


def written(kind: str, original: str, plain: str) -> str:
    """A normalised surrogate in the format of the text it replaces; what it is longer stands at the end."""
    if kind in ("phone", "number"):
        digits = iter(plain.removeprefix("+"))
        zero = next(ord(c) - int(c) for c in original if c.isdecimal())
        out = [chr(ord(c) - int(c) + int(next(digits))) if c.isdecimal() else c for c in original]
        return "".join(out) + "".join(chr(zero + int(digit)) for digit in digits)
    if kind.startswith(("first", "last")):
        return plain.upper() if original.isupper() else "-".join(part.capitalize() for part in plain.split("-"))
    if len(plain) == len(original):
        return "".join(p.upper() if c.isupper() else p for p, c in zip(plain, original, strict=True))
    return plain.upper() if original.isupper() else plain


def _plain(kind: str, value: str, original: str, made: str) -> str:
    """What a reader sees as the entity after the replacement."""
    return _value(kind, written(kind, original, made))


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and the number of entities."""
    out, at, spans = [], 0, detect(text)
    for start, end, kind, value in spans:
        made = surrogate(key, kind, value, attempts.get((kind, value), 0))
        out += [text[at:start], written(kind, text[start:end], made)]
        at = end
    return "".join([*out, text[at:]]), len(spans)


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = {(kind, value, text[start:end]) for text in batch["text"] for start, end, kind, value in detect(text)}
        yield pd.DataFrame(sorted(rows), columns=["kind", "value", "shown"])


def attempts(docs: DataFrame, key: bytes, folder: str) -> DataFrame:
    """kind, value and attempt of the entities whose first surrogate collides. Nearly always few rows."""
    found = docs.where("text IS NOT NULL").select("text").mapInPandas(_entities, "kind string, value string, shown string")
    entities = stage(found.groupBy("kind", "value").agg(F.min("shown").alias("shown")), folder, "entities")
    family = F.substring_index("kind", "_", 1)  # first names of all genders must differ too

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["kind"], batch["value"], batch["shown"], batch["attempt"], strict=True)
            made = [_plain(kind, value, shown, surrogate(key, kind, value, n)) for kind, value, shown, n in rows]
            yield batch.assign(made=made)

    made = _stamped(entities.withColumn("attempt", F.lit(0)).mapInPandas(make, MADE), family, folder, 0)
    originals = entities.select(family.alias("family"), F.col("value").alias("made")).distinct()
    for round_ in itertools.count(1):
        same = made.groupBy("family", "made").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "kind", "value")).alias("first"))
        real = originals.withColumn("real", F.lit(True))
        clash = stage(same.join(real, ["family", "made"], "left").where("n > 1 OR real"), folder, f"clash-{round_}")
        if clash.isEmpty():
            return made.where("attempt > 0").select("kind", "value", "attempt")
        own = F.struct("attempt", "kind", "value")
        again = F.col("n").isNotNull() & (F.coalesce("real", F.lit(False)) | (own != F.col("first")))
        marked = made.join(clash, ["family", "made"], "left").withColumn("again", again)
        drawn = marked.where("again").select("kind", "value", "shown", (F.col("attempt") + 1).alias("attempt"))
        kept = marked.where("NOT again").select(*made.columns)
        made = _stamped(drawn.mapInPandas(make, MADE), family, folder, round_, kept)


MADE = "kind string, value string, shown string, attempt int, made string"


def _stamped(made: DataFrame, family: Column, folder: str, round_: int, kept: DataFrame | None = None) -> DataFrame:
    fresh = made.withColumn("family", family)
    return stage(fresh if kept is None else fresh.unionByName(kept), folder, f"made-{round_}")


def anonymise(docs: DataFrame, key: bytes, folder: str) -> DataFrame:
    """The documents with surrogates in `text`, and `n_entities`."""
    later = stage(attempts(docs, key, folder), folder, "attempts")
    docs = docs.drop("n_entities")
    names = docs.columns
    its, listed = spare_names(docs, 2)
    if later.isEmpty():
        carried = docs.withColumn(listed, F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        texts = docs.where("text IS NOT NULL").select("text").mapInPandas(_per_text, "text_key string, kind string, value string")
        per_text = texts.distinct().join(later, ["kind", "value"]).groupBy(F.col("text_key").alias(its))
        per_text = stage(per_text.agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(listed)), folder, "per_text")
        keyed = docs.withColumn(its, F.md5(F.col("text").cast("binary")))
        carried = keyed.join(per_text, its, "left").select(*names, listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            listed = batch.column(len(names)).to_pylist()
            done = [
                (None, 0) if text is None else replace(text, key, {(x["kind"], x["value"]): x["attempt"] for x in more or ()})
                for text, more in zip(batch.column(at).to_pylist(), listed, strict=True)
            ]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array([text for text, _ in done], pa.string())
            counts = pa.array([count for _, count in done], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, counts], [*names, "n_entities"])

    return carried.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_entities", T.IntegerType())]))


def _per_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            (hashlib.md5(text.encode()).hexdigest(), kind, value)
            for text in batch["text"] for _, _, kind, value in detect(text)
        ]
        yield pd.DataFrame(rows, columns=["text_key", "kind", "value"])

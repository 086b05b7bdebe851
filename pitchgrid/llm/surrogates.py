"""Personal data replaced by surrogates: keyed, of the same type, format, gender and script, one to one."""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchgrid.llm.common import arrow_session, stored, unused

DIGITS, LOWER, UPPER, HEX, KEYED = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC, GREEK = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
ALPHABETS = (DIGITS, LOWER, UPPER, CYRILLIC, CYRILLIC.upper(), GREEK, GREEK.upper())
#: Rounds of re-keying before a surrogate that still collides is made longer.
ATTEMPTS = 12

# Words before a name, and the gender that they tell.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Госпожа", "г-жа")
OPEN_TITLES = ("Dr", "Prof", "Professor", "Doctor", "Doktor")
INTRODUCTIONS = ("my name is", "name:", "mein Name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "меня зовут")

_PART = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)*"
_CYRILLIC = r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)*"
_NAMES = rf"(?:{_PART}(?:[ ]{_PART}){{0,2}}|{_CYRILLIC}(?:[ ]{_CYRILLIC}){{0,2}})"
# The patterns start with literals or small sets, which the search skips to; borders before them are checked afterwards.
TITLED = re.compile(rf"(?P<title>{'|'.join(sorted(MALE_TITLES + FEMALE_TITLES + OPEN_TITLES, key=len, reverse=True))})\.?[ ](?P<name>{_NAMES})")
INTRODUCED = re.compile(rf"(?<!\w)(?i:{'|'.join(map(re.escape, INTRODUCTIONS))})[ ]*(?P<name>{_NAMES})")
INTRODUCING = {v for i in INTRODUCTIONS for v in (i, i[0].upper() + i[1:], i.upper())}
EMAIL = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+")
ASSIGNED = re.compile("[=:]")
SECRET_NAME = re.compile(r"""(?i)(?<![a-z0-9])(?:password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key)["']?[ ]*$""")
SECRET_VALUE = re.compile(r"""[ ]*["']?(?P<value>[^\s"'<>,;]{6,})""")
NUMBER_RUN = re.compile(r"[0-9][0-9 .()+-]*")
NUMBERS = re.compile(
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w))"
    r"|(?P<card>(?<![\w+])(?:\d{4}[ -]){3}\d{4}(?!\w)|(?<![\w+])3[47]\d{2}[ -]\d{6}[ -]\d{5}(?!\w)|(?<![\w+])\d{13,19}(?!\w))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){1,6}(?!\w)|(?<![\w(])\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))")
KEYS = re.compile(r"(?P<aws>A(?:KIA|SIA)[0-9A-Z]{16})(?!\w)|(?P<secret>(?:gh[po]|xox[bp]|[sp]k)[_-][\w-]{16,})")
IBAN = re.compile(r"[A-Z][A-Z][0-9][0-9](?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?!\w)")
#: Candidates with the usual hexadecimal groups, compressed or not; the address itself is checked afterwards.
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    value: str  # canonical: equal for all mentions of one thing


def iban_valid(compact: str) -> bool:
    return int("".join(str(KEYED.index(c)) for c in compact[4:] + compact[:4])) % 97 == 1


def full_address(written: str) -> str | None:
    """All eight groups of an IPv6 address; None for what is none, or could as well be words or a time of day."""
    groups = [g for g in written.split(":") if g]
    if len(groups) < 2 or not any(c.isdigit() for c in written):
        return None
    try:
        return ipaddress.IPv6Address(written).exploded
    except ValueError:
        return None


def free(text: str, at: int) -> bool:
    """No letter, digit or underscore stands before place ``at``."""
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")


def find_entities(text: str) -> list[Entity]:
    """Entities of a text in order, without overlaps; the earlier and then the longer one wins."""
    found: list[Entity] = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            found.append(Entity(m.start(), m.end(), "email", m[0].lower()))
    for m in ASSIGNED.finditer(text):
        if SECRET_NAME.search(text, max(0, m.start() - 24), m.start()) and (v := SECRET_VALUE.match(text, m.end())):
            found.append(Entity(*v.span("value"), "secret", v["value"]))
    for m in KEYS.finditer(text):
        if free(text, m.start()):
            found.append(Entity(m.start(), m.end(), m.lastgroup, m[0]))
    for m in IBAN.finditer(text):
        compact = m[0].replace(" ", "")
        if free(text, m.start()) and iban_valid(compact):
            found.append(Entity(m.start(), m.end(), "iban", compact))
    if ":" in text:
        for m in IPV6.finditer(text):
            if full := full_address(m[0]):
                found.append(Entity(m.start(), m.end(), "ipv6", full))
    for m in (m for run in NUMBER_RUN.finditer(text) if run.end() - run.start() > 6 for m in NUMBERS.finditer(text, max(0, run.start() - 2), run.end() + 2)):
        digits = re.sub(r"\D", "", m[0])
        if m.lastgroup == "ip" and any(int(x) > 255 for x in m[0].split(".")):
            continue
        if m.lastgroup == "card" and luhn(digits[:-1]) != int(digits[-1]):
            continue
        if m.lastgroup == "phone" and not 8 <= len(digits) <= 15:
            continue
        value = m[0] if m.lastgroup == "ip" else ("+" if m[0][0] == "+" else "") + digits
        found.append(Entity(m.start(), m.end(), m.lastgroup, value))
    names: dict[str, str] = {}
    for pattern in (TITLED, INTRODUCED) if any(i in text for i in INTRODUCING) else (TITLED,):
        for m in pattern.finditer(text):
            if not free(text, m.start()):
                continue
            title = m.groupdict().get("title")
            gender = "m" if title in MALE_TITLES else "f" if title in FEMALE_TITLES else "u"
            at, parts = m.start("name"), m["name"].split(" ")
            for i, part in enumerate(parts):
                last = i == len(parts) - 1 and (i > 0 or title is not None)
                names.setdefault(part.lower(), name_kind("surname" if last else f"given-{gender}", part))
                found.append(Entity(at, at + len(part), names[part.lower()], part.lower()))
                at += len(part) + 1
    if names:  # later mentions without a title
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted({p for p in names}, key=len, reverse=True)))})(?!\w)", re.IGNORECASE)
        for m in again.finditer(text):
            if m[0][0].isupper():
                found.append(Entity(m.start(), m.end(), names[m[0].lower()], m[0].lower()))
    found.sort(key=lambda e: (e.start, -e.end))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def name_kind(part: str, word: str) -> str:
    return f"{part}-{'cyrillic' if re.search('[А-яЁё]', word) else 'latin'}"


def _round(key: bytes, tweak: str, n: int, value: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{tweak}|{n}|{value}".encode(), "sha256")[:16], "big")


def permuted(size: int, value: int, key: bytes, tweak: str) -> int:
    """A keyed one-to-one map of 0..size-1: a Feistel network that is walked until it lands inside."""
    if size < 2:
        return value
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for n in range(8):
            a, b = b, a ^ (_round(key, tweak, n, b) & mask)
        value = a << half | b
        if value < size:
            return value


@lru_cache(maxsize=4096)
def letters_like(c: str) -> str:
    """The characters that may stand for ``c``: of its case, script block and category; "" for signs and white space.

    These sets divide all characters, so a permutation inside each is one-to-one.
    """
    for known in ALPHABETS:
        if c in known:
            return known
    kind = unicodedata.category(c)
    if c.isascii() or kind[0] not in "LN":
        return ""

    def alike(x: str) -> tuple:
        other = x.upper() if kind == "Ll" else x.lower()
        back = other.lower() if kind == "Ll" else other.upper()
        return unicodedata.category(x), len(other) == 1 and back == x, unicodedata.normalize("NFC", x) == x

    # Neighbours of the code chart belong to one script; 128 of them, but for those of a known alphabet, are one.
    first, own = ord(c) & ~127, alike(c)
    near = (chr(i) for i in range(first, first + 128))
    return "".join(x for x in near if not x.isascii() and not any(x in known for known in ALPHABETS) and alike(x) == own)


def same_shape(value: str, key: bytes, tweak: str, alphabet: str | None = None) -> str:
    """``value`` with its digits and letters permuted within their kind, all else in place: one-to-one among equal shapes."""
    sets = [alphabet if alphabet and c in alphabet else letters_like(c) for c in value]
    size, number = 1, 0
    for c, s in zip(value, sets):
        if s:
            size, number = size * len(s), number * len(s) + s.index(c)
    shape = "".join({DIGITS: "9", LOWER: "a", UPPER: "A"}.get(s, s[0] if s != alphabet else "x") if s else c for c, s in zip(value, sets))
    number = permuted(size, number, key, f"{tweak}|{shape}")
    out = []
    for c, s in zip(reversed(value), reversed(sets)):
        if s:
            number, d = divmod(number, len(s))
            c = s[d]
        out.append(c)
    return "".join(reversed(out))


def luhn(payload: str) -> int:
    """The digit that makes payload + digit a valid card number."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(payload)))
    return -total % 10


SYLLABLES = {
    "latin": (("b", "br", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "st", "t", "v", "w"), ("a", "e", "i", "o", "u", "ai", "ea"), {"m": ("n", "r", "s", "d", "l", "k"), "f": ("a", "ia", "ina", "ella"), "": ("er", "man", "son", "ley", "ton", "ez")}),
    "cyrillic": (("б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т"), ("а", "е", "и", "о", "у", "я"), {"m": ("н", "р", "й", "с"), "f": ("а", "я", "ия"), "": ("ов", "ин", "ский", "ко")}),
}


def invented_name(kind: str, value: str, key: bytes, attempt: int) -> str:
    """A name of the kind's script and gender from a keyed hash; later attempts have more syllables."""
    part, _, script = kind.rpartition("-")
    onsets, vowels, ends = SYLLABLES[script]
    h = _round(key, f"{kind}|{attempt}", 0, int.from_bytes(value.encode(), "big"))
    gender = part[-1] if part.startswith("given") else ""
    if gender == "u":
        gender = "mf"[h & 1]
    h >>= 1
    out = []
    for _ in range(2 + (h & 1) + attempt // 3):
        h, a = divmod(h, len(onsets))
        h, b = divmod(h, len(vowels))
        out.append(onsets[a] + vowels[b])
    return "".join(out) + ends[gender][h % len(ends[gender])]


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of an entity; one-to-one among values of one kind and shape (names: almost).

    Where the shape has no free value, or nothing in it can be permuted, it is an opaque one.
    """
    if kind.startswith(("given", "surname")):
        return invented_name(kind, value, key, attempt)
    new = shaped(kind, value, key, attempt) if attempt <= ATTEMPTS else value
    return opaque(kind, value, key, attempt) if value in new else new


def shaped(kind: str, value: str, key: bytes, attempt: int) -> str:
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = value.partition("@")
        labels, dot, top = domain.rpartition(".")
        return f"{same_shape(local, key, tweak)}@{same_shape(labels, key, f'domain|{attempt}')}{dot}{top}"
    if kind == "card":
        body = value[0] + same_shape(value[1:-1], key, f"{tweak}|{value[0]}")
        return body + str((luhn(body) + int(value[-1]) - luhn(value[:-1])) % 10)
    if kind == "phone":
        country = (2 if value[1] in "17" else 3) if value[0] == "+" else 0
        return value[:country] + same_shape(value[country:], key, f"{tweak}|{value[:country]}")
    if kind == "ssn":
        return same_shape(value, key, tweak)
    if kind == "ip":
        a, b, c, d = map(int, value.split("."))
        n = permuted(1 << 24, b << 16 | c << 8 | d, key, f"{tweak}|{a}")
        return f"{a}.{n >> 16}.{n >> 8 & 255}.{n & 255}"
    if kind == "ipv6":  # groups of zeros stay, so that it can be written as short as before
        return same_shape(value.replace("0000", "----"), key, tweak, HEX).replace("----", "0000")
    if kind == "aws":
        return value[:4] + same_shape(value[4:], key, tweak, KEYED)
    if kind == "iban":
        body = same_shape(value[4:], key, f"{tweak}|{value[:2]}")
        check = 98 - int("".join(str(KEYED.index(c)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    return same_shape(value, key, tweak, HEX if set(value) <= set(HEX) else None)


def opaque(kind: str, value: str, key: bytes, attempt: int) -> str:
    """A surrogate that has nothing of ``value`` in it: digits or letters from a keyed hash, as long as needed to be free."""
    number = _round(key, f"{kind}|{value}|{attempt}", 0, attempt)
    figures = DIGITS if kind in ("card", "phone", "ssn", "iban", "ip") else LOWER
    out = []
    for _ in range(max(len(value), 8) + max(0, attempt - ATTEMPTS)):
        number, d = divmod(number, len(figures))
        number = number or _round(key, "more", len(out), len(value))
        out.append(figures[d])
    token = "".join(out)
    if kind == "email":
        return f"{token}@{token[::-1]}.{value.rpartition('.')[2]}"
    return "-".join(token[i:i + 4] for i in range(0, len(token), 4)) if value in token else token


def in_format(original: str, canonical: str, kind: str) -> str:
    """The canonical surrogate written as the mention was: its separators and its case."""
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(canonical.lstrip("+"))
        out = "".join(next(rest, "") if c.isalnum() else c for c in original)
        return out + "".join(rest)
    if kind.startswith(("given", "surname")):
        return canonical.upper() if original.isupper() and len(original) > 1 else canonical.capitalize()
    if kind == "ipv6":
        try:
            address = ipaddress.IPv6Address(canonical)
        except ValueError:  # an opaque one
            return canonical
        groups = canonical.split(":")
        written = address.compressed if "::" in original else canonical if len(original) == 39 else ":".join(g.lstrip("0") or "0" for g in groups)
        return written.upper() if original.isupper() else written
    if kind == "email":
        if original.isupper():
            return canonical.upper()
        return "".join(c.upper() if i < len(original) and original[i].isupper() else c for i, c in enumerate(canonical))
    return canonical


def replaced(text: str, key: bytes, other: dict[tuple[str, str], str]) -> tuple[str, int]:
    """``text`` with surrogates for its entities (``other``: those that were re-keyed), and their number."""
    out, at, entities = [], 0, find_entities(text)
    for e in entities:
        new = other.get((e.kind, e.value)) or surrogate(e.kind, e.value, key)
        out += [text[at:e.start], in_format(text[e.start:e.end], new, e.kind)]
        at = e.end
    return "".join([*out, text[at:]]), len(entities)


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and the distinct entities of each document that has any."""
    arrow_session(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted({(e.kind, e.value) for e in find_entities(t.as_py() or "")}) for t in batch.column(1)]
            keep = [i for i, s in enumerate(sets) if s]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([[{"kind": k, "value": v} for k, v in sets[i]] for i in keep], kind)], names=["row_key", "entities"])

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, entities array<struct<kind:string,value:string>>")


def _keyed(values: DataFrame, key: bytes, attempt: int) -> DataFrame:
    """kind, value and the surrogate of this attempt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, v, key, attempt) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "value", "surrogate"])

    return values.select("kind", "value").mapInArrow(run, "kind string, value string, surrogate string")


def family(kind):
    """Kinds whose surrogates must differ from each other: all parts of names together, others by themselves."""
    return F.when(kind.startswith("given") | kind.startswith("surname"), F.lit("name")).otherwise(kind)


def rekeyed(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, surrogate of the entities whose first surrogate is an original of the corpus or another's surrogate.

    ``entities`` has each (kind, value) once. Every round joins new surrogates with all originals and those given
    before; the smallest value keeps a contested one, the rest take the next attempt, which after ATTEMPTS rounds has
    its own length. Rounds end when none collides.
    """
    originals = entities.select(family(F.col("kind")).alias("f"), F.col("value").alias("s")).distinct()
    waiting, attempt, changed = entities, 0, None
    taken = originals
    while True:
        offered = stored(_keyed(waiting, key, attempt), "offered").withColumn("f", family(F.col("kind")))
        free = offered.join(taken.withColumnRenamed("s", "surrogate"), ["f", "surrogate"], "left_anti")
        winners = free.groupBy("f", "surrogate").agg(F.min(F.struct("kind", "value")).alias("w")).select("w.kind", "w.value", "surrogate", "f")
        winners = stored(winners, "accepted")
        losers = stored(offered.join(winners.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value"), "collided")
        if attempt:
            won = winners.select("kind", "value", "surrogate")
            changed = won if changed is None else changed.union(won)
        if not losers.limit(1).count():
            return changed if changed is not None else winners.limit(0).select("kind", "value", "surrogate")
        taken = taken.union(winners.select("f", F.col("surrogate").alias("s")))
        waiting, attempt = losers, attempt + 1


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text`` and their number in ``n_entities``.

    Mail addresses, phone numbers, card numbers with a right check digit, IBANs, social security numbers, IP addresses (version 6
    compressed too), access keys, passwords and tokens, and names after a title or an introduction are replaced, the
    names' later mentions in the document too. Letters of any script are replaced by others of it. The same thing gets the
    same surrogate in the whole corpus under one key (a name: the same part, given name or surname, of the same
    gender); different things get different ones, no surrogate holds its original, and none
    is an original of the corpus: distinct originals (a small table) are checked by joins, and those that had to be
    re-keyed reach their documents by a join on the row, small unless the corpus fills a format. All others are
    computed from the key where the text is read, so texts need no exchange.

    A null text stays null with 0 entities; repeated rows are replaced alike; an empty table gives an empty table;
    other columns stay (``n_entities`` is replaced). Whole texts are looked at whatever their length.
    """
    spark = docs.sparkSession
    arrow_session(spark)
    docs = docs.drop("n_entities")
    row, note_row, noted_as = (unused(n, docs.columns) for n in ("surrogate_row", "note_row", "surrogate_notes"))
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id"), F.col("text")))
    found = stored(_found(keyed.select(F.col(row).alias("row_key"), "text")), "entities")
    each = found.select("row_key", F.explode("entities").alias("e")).select("row_key", "e.kind", "e.value")
    changed = stored(rekeyed(stored(each.select("kind", "value").distinct(), "entity-values"), key), "rekeyed")
    notes = each.distinct().join(changed, ["kind", "value"]).groupBy("row_key").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(noted_as))
    notes = stored(notes.withColumnRenamed("row_key", note_row), "rekeyed-rows")
    noted = keyed.join(notes, F.col(row) == F.col(note_row), "left").drop(row, note_row)
    at, last = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, own in zip(batch.column(at), batch.column(last)):
                new, n = (None, 0) if not text.is_valid else replaced(text.as_py(), key, {(o["kind"], o["value"]): o["surrogate"] for o in own.as_py() or ()})
                texts.append(new)
                counts.append(n)
            columns = list(batch.columns[:last])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*batch.schema.names[:last], "n_entities"])

    return noted.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "n_entities long"]))

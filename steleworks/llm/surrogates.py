"""PII surrogates: keyed, type-consistent replacements for detected entities.

A replacement is a keyed permutation of the entity's own format: digits stay digits,
vowels vowels, a card keeps its issuer and a valid check digit, a first name comes
from the pool of the same gender and script. A permutation maps different entities
to different surrogates and one entity always to the same one, in every document
and task, without a table. It is conjugated with a shift, so nothing maps to itself.
A pass over all entities checks that no two share a surrogate; if two did, another
salt would be taken.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

KEY = b"steleworks-surrogates"
ROUNDS = 8

# Name pools by script and gender; a surrogate comes from the pool of the name it replaces.
POOLS = {
    ("latin", "f"): "Alice Anna Barbara Camille Carmen Charlotte Clara Diana Elena Elisabeth Emily Emma Eva Hannah Helen Ingrid Isabel Jane Julia Karen Laura Linda Lucia Margaret Maria Marie Martha Mary Monika Nancy Olivia Patricia Paula Rosa Ruth Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Adam Albert Andrew Antonio Benjamin Carlos Charles Daniel David Edward Eric Francis Frank Friedrich George Hans Henry Hugo Jacques James Javier John Joseph Juan Karl Klaus Louis Luis Mark Martin Michael Miguel Oliver Oscar Paul Peter Philip Pierre Robert Thomas Walter William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("han", "s"): list("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"),
    ("hangul", "s"): list("김이박최정강조윤장임한오서신권황안송류홍"),
}
# Words that announce a person.
TITLES = ["Mr.", "Mrs.", "Ms.", "Miss", "Mr", "Mrs", "Ms", "Dr.", "Prof.", "Herr", "Frau", "Señor", "Señora", "Sr.", "Sra.", "Monsieur", "Madame", "Mme", "Mlle", "г-н", "г-жа"]
HAN_TITLES = "先生女士小姐教授博士"
HANGUL_TITLES = "씨님"
# Domains kept for examples by RFC 2606; nobody owns an address there.
RESERVED = {"example.com", "example.net", "example.org"}

# Country calling codes of one and of two digits (ITU-T E.164); all others have three.
CALLING = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóú", "àèìòù", "âêîôû", "äëïöü", "ÁÉÍÓÚ", "ÄËÏÖÜ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]
_CLASS_OF = {ch: own for own in _CLASSES for ch in own}
_HEX, _UPPER, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _noise(key: bytes, turn: int, value: int, modulus: int) -> int:
    size = (modulus.bit_length() + 7) // 8 + 8
    data, out = turn.to_bytes(1, "big") + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big"), b""
    while len(out) < size:
        out += hashlib.blake2b(data + bytes([len(out) // 64 % 256]), key=key).digest()
    return int.from_bytes(out[:size], "big") % modulus


def permuted(value: int, left: int, right: int, key: bytes) -> int:
    """A keyed permutation of range(left * right) that moves every value (if there are two or more)."""
    n = left * right
    if n < 2:
        return value
    a, b = divmod(value, right)
    for turn in range(0, ROUNDS, 2):
        a = (a + _noise(key, turn, b, left)) % left
        b = (b + _noise(key, turn + 1, a, right)) % right
    value = (a * right + b + 1 + _noise(key, 255, n, n - 1)) % n
    a, b = divmod(value, right)
    for turn in reversed(range(0, ROUNDS, 2)):
        b = (b - _noise(key, turn + 1, a, right)) % right
        a = (a - _noise(key, turn, b, left)) % left
    return a * right + b


def reshaped(text: str, alphabets: list[str | None], key: bytes) -> str:
    """text with the characters that have an alphabet permuted, as one number, within these alphabets."""
    at = [i for i, own in enumerate(alphabets) if own and text[i] in own]
    # The format is part of the key, so that formats don't give away each other.
    form = "".join(own[0] if own else text[i] for i, own in enumerate(alphabets))
    key = hashlib.blake2b(form.encode(), key=key[:64], digest_size=32).digest()
    sizes = [len(alphabets[i]) for i in at]
    half = (len(at) + 1) // 2
    value = 0
    for i, n in zip(at, sizes, strict=True):
        value = value * n + alphabets[i].index(text[i])
    value = permuted(value, math.prod(sizes[:half]), math.prod(sizes[half:]), key)
    out = list(text)
    for i, n in zip(reversed(at), reversed(sizes), strict=True):
        value, k = divmod(value, n)
        out[i] = alphabets[i][k]
    return "".join(out)


def _classes(text: str) -> list[str | None]:
    return [_CLASS_OF.get(ch) for ch in text]


def _cased(text: str, like: str) -> str:
    return "".join(c.upper() if o.isupper() else c for c, o in zip(text, like, strict=True))


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def calling_code(number: str) -> str:
    """The country's code at the start of an international number's digits, however they are grouped."""
    return next((number[:k] for k in (1, 2) if number[:k] in CALLING), number[:3])


def _refilled(like: str, digits: str) -> str:
    """like with its digits and letters replaced in turn."""
    left = iter(digits)
    return "".join(next(left) if c.isalnum() else c for c in like)


class Entity(NamedTuple):
    kind: str
    start: int
    end: int
    canonical: str
    surrogate: str


@lru_cache(100_000)
def _canonical_surrogate(kind: str, canonical: str, key: bytes) -> str:
    key = hashlib.blake2b(kind.encode(), key=key[:64], digest_size=32).digest()
    digits = "0123456789"
    if kind == "EMAIL":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        if ".".join(labels[-2:]) not in RESERVED:
            host = ".".join(labels[:-1])
            domain = reshaped(host, _classes(host), key) + "." + labels[-1]
        return reshaped(local, _classes(local), key) + "@" + domain
    if kind == "PHONE":  # the country's code and what follows it: no first digit below 2 where there was none
        code, _, rest = canonical.rpartition(" ")
        high = {0, 3} if len(rest) == 10 else set()
        return code + reshaped(rest, ["23456789" if i in high and c in "23456789" else digits for i, c in enumerate(rest)], key)
    if kind == "CARD":
        body = canonical[:2] + reshaped(canonical[2:-1], [digits] * (len(canonical) - 3), key)
        return next(body + d for d in digits if luhn(body + d))
    if kind == "IP":
        octets = [int(x) for x in canonical.split(".")]
        low, size = (1, 223) if 1 <= octets[0] <= 223 else (224, 32) if octets[0] else (0, 1)
        value = octets[0] - low
        for o in octets[1:]:
            value = value * 256 + o
        value = permuted(value, size * 256, 65_536, key + bytes([low]))
        return f"{low + (value >> 24)}.{value >> 16 & 255}.{value >> 8 & 255}.{value & 255}"
    if kind == "SSN":
        return reshaped(canonical, [digits] * 9, key)
    if kind == "IBAN":
        body = reshaped(canonical[4:], [digits if c.isdigit() else _UPPER[:26] for c in canonical[4:]], key)
        number = int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00"))
        return f"{canonical[:2]}{98 - number % 97:02d}{body}"
    if kind == "SECRET":
        fixed = next((p for p in ("AKIA", "ASIA", "ghp_", "gho_", "sk-") if canonical.startswith(p)), "")
        rest = canonical[len(fixed) :]
        own = _HEX if re.fullmatch("[0-9a-f]+", rest) else _UPPER if re.fullmatch("[0-9A-Z]+", rest) else _ALNUM
        return fixed + reshaped(rest, [own if c in own else None for c in rest], key)
    return reshaped(canonical, _classes(canonical), key)


#: The names that pools replace, first names and surnames.
_POOLED = {given: {w.casefold() for (_, gender), pool in POOLS.items() if given or gender == "s" for w in pool} for given in (True, False)}


@lru_cache(100_000)
def name_part(word: str, given: bool, key: bytes) -> str:
    """A first or last name's surrogate; one known to a pool stays in the pool, any other outside of all.

    A permutation of a name's own form that leads into a pool is followed on until it is
    out again. So two names never share a surrogate, whichever of them a pool knows.
    """
    low = word.casefold()
    for (script, gender), pool in POOLS.items():
        known = [w.casefold() for w in pool]
        if low in known and (given or gender == "s"):
            pick = pool[permuted(known.index(low), len(pool), 1, key + script.encode() + gender.encode())]
            return pick.upper() if word.isupper() and len(word) > 1 else pick
    small = low if len(low) == len(word) else word
    han, hangul = all("一" <= c <= "鿿" for c in word), all("가" <= c <= "힣" for c in word)
    # The ending stays: in many languages it tells the gender.
    keep = 1 if given and len(small) > 2 and not han and not hangul else 0

    def turned(x: str) -> str:
        if han:
            return "".join(chr(0x4E00 + permuted(ord(c) - 0x4E00, 144, 144, key)) for c in x)
        if hangul:
            return "".join(chr(0xAC00 + permuted(ord(c) - 0xAC00, 196, 57, key)) for c in x)
        body = x[: len(x) - keep]
        return reshaped(body, _classes(body), key) + x[len(x) - keep :]

    out = turned(small)
    while out.casefold() in _POOLED[given]:
        out = turned(out)
    return _cased(out, word)


_RE = {
    "EMAIL": re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    "IBAN": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "CARD": re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)"),
    "PHONE": re.compile(r"(?<![\w.])(?:\+(\d{1,3})[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\w|\.\d)"),
    "SSN": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "IP": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"),
    "NAMED": re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\b[\"']?\s*[:=]\s*(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;]{6,}))"),
    "SECRET": re.compile(r"\b(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b"),
}
_WORD = r"[A-ZÀ-ÖØ-ÞА-Я][\w'’-]*"
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))}) ({_WORD})(?: ({_WORD}))?")
# A lookahead, so that pairs may overlap: the word before a name doesn't swallow its first part.
_PAIR = re.compile(rf"(?<![\w.])(?=({_WORD}) ({_WORD})(?!\w))")
_EAST = re.compile(rf"([{''.join(POOLS['han', 's'])}])([一-鿿]{{1,2}})(?={'|'.join(HAN_TITLES[i : i + 2] for i in range(0, len(HAN_TITLES), 2))})|([{''.join(POOLS['hangul', 's'])}])([가-힣]{{1,2}})(?=[{HANGUL_TITLES}])")
_FIRST = {w for (_, g), pool in POOLS.items() if g in "fm" for w in pool}
_KNOWN_FIRST = re.compile("|".join(sorted(_FIRST)))


def _found(text: str) -> Iterator[tuple[str, int, int]]:
    digits = any(d in text for d in "0123456789")
    if "@" in text:
        yield from (("EMAIL", *m.span()) for m in _RE["EMAIL"].finditer(text))
    if "=" in text or ":" in text:
        for m in _RE["NAMED"].finditer(text):
            yield ("SECRET", *m.span(m.lastindex))
    if digits:
        yield from (("SECRET", *m.span()) for m in _RE["SECRET"].finditer(text))
        for m in _RE["IBAN"].finditer(text):
            raw = m.group().replace(" ", "")
            if 15 <= len(raw) <= 34 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1:
                yield ("IBAN", *m.span())
        for m in _RE["CARD"].finditer(text):
            raw = re.sub(r"\D", "", m.group())
            if 13 <= len(raw) <= 19 and luhn(raw):
                yield ("CARD", *m.span())
        yield from (("IP", *m.span()) for m in _RE["IP"].finditer(text))
        yield from (("SSN", *m.span()) for m in _RE["SSN"].finditer(text))
        for m in _RE["PHONE"].finditer(text):
            n = sum(c.isdigit() for c in m.group())
            # Without a country's code or brackets, only groups that are set apart by one kind of mark.
            if 9 <= n <= 15 and (m.group(1) or "(" in m.group() or re.fullmatch(r"\d{3}([.-])\d{3}\1\d{4}", m.group())):
                yield ("PHONE", *m.span())
    if any(t in text for t in TITLES):
        for m in _TITLED.finditer(text):
            yield from ([("LAST", *m.span(1))] if m.group(2) is None else [("GIVEN", *m.span(1)), ("LAST", *m.span(2))])
    if _KNOWN_FIRST.search(text):
        for m in _PAIR.finditer(text):
            if m.group(1) in _FIRST:
                yield from (("GIVEN", *m.span(1)), ("LAST", *m.span(2)))
    if not text.isascii() and _EAST.search(text):
        for m in _EAST.finditer(text):
            k = 1 if m.group(1) else 3
            yield from (("LAST", *m.span(k)), ("GIVEN", *m.span(k + 1)))


def _spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities in order, without overlaps: the one that starts first wins, then the longer.

    Where a text names a person, its other mentions of that name's parts are entities, too.
    """

    def apart(found) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        for kind, s, e in sorted(set(found), key=lambda x: (x[1], -x[2], x[0])):
            if not out or s >= out[-1][2]:
                out.append((kind, s, e))
        return out

    out = apart(_found(text))
    parts: dict[str, str] = {}
    for kind, s, e in out:
        if kind in ("GIVEN", "LAST") and e - s > 2:
            parts.setdefault(text[s:e], kind)
    if parts:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(p) for p in sorted(parts, key=len, reverse=True))})(?!\w)")
        taken = set(out)
        more = [(parts[m.group()], *m.span()) for m in again.finditer(text)]
        starts = [s for _, s, _ in out]
        for kind, s, e in more:
            i = bisect.bisect_right(starts, s)
            if (not i or out[i - 1][2] <= s) and (i == len(out) or out[i][1] >= e):
                taken.add((kind, s, e))
        out = sorted(taken, key=lambda x: x[1])
    return out


def entities(text: str | None, key: bytes = KEY) -> list[Entity]:
    """The entities of a text, as _spans() finds them, with their surrogates."""
    out: list[Entity] = []
    for kind, s, e in _spans(text or ""):
        raw = text[s:e]
        if kind in ("GIVEN", "LAST"):
            own = hashlib.blake2b(kind.encode(), key=key[:64], digest_size=32).digest()
            new = name_part(raw, kind == "GIVEN", own)
            out.append(Entity(kind, s, e, raw.casefold(), new))
            continue
        canonical = raw
        if kind == "EMAIL":
            canonical = raw.lower()
        elif kind == "PHONE":
            number = re.sub(r"\D", "", raw)
            code = calling_code(number) if raw.startswith("+") else None
            canonical = f"{code} {number[len(code):]}" if code else f" {number}"
        elif kind in ("CARD", "SSN", "IBAN"):
            canonical = re.sub(r"[ -]", "", raw)
        new = _canonical_surrogate(kind, canonical, key)
        if kind == "EMAIL":
            new = _cased(new, raw)
        elif kind in ("PHONE", "CARD", "SSN", "IBAN"):
            new = _refilled(raw, new)
        out.append(Entity(kind, s, e, canonical, new))
    return out


def replaced(text: str | None, found: list[Entity]) -> str | None:
    if not found:
        return text
    at, parts = 0, []
    for x in found:
        parts += [text[at : x.start], x.surrogate]
        at = x.end
    return "".join([*parts, text[at:]])


def _salted(key: bytes, salt: int) -> bytes:
    return key if not salt else hashlib.blake2b(bytes([salt]), key=key[:64], digest_size=32).digest()


def collisions(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, surrogate) that two different entities of docs share; empty unless something is broken."""

    def run(batches):
        for b in slices(batches, 512):
            rows = {(x.kind, x.canonical, x.surrogate.casefold()) for t in b.column(0).to_pylist() for x in entities(t, key)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "canonical", "surrogate"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, canonical string, surrogate string")
    # One canonical form may have several spellings (a phone number's marks); only its digits and letters count.
    plain = rows.select("kind", F.regexp_replace("surrogate", r"[ ().+-]", "").alias("plain"), F.regexp_replace("canonical", r"[ ().+-]", "").alias("canonical"))
    marks = rows.filter(F.col("kind").isin("EMAIL", "IP", "SECRET")).select("kind", F.col("surrogate").alias("plain"), "canonical")
    both = plain.filter(~F.col("kind").isin("EMAIL", "IP", "SECRET")).unionByName(marks)
    return both.groupBy("kind", "plain").agg(F.min("canonical").alias("least"), F.max("canonical").alias("most")).filter("least <> most")


def safe_key(docs: DataFrame, key: bytes = KEY) -> bytes:
    """The key, salted until no two entities of docs share a surrogate (as a rule the first one is safe)."""
    for salt in range(8):
        if collisions(docs, _salted(key, salt)).isEmpty():
            return _salted(key, salt)
    raise RuntimeError("surrogates collide under every salt")


def pseudonymized(docs: DataFrame, key: bytes = KEY, extra: bool = True) -> DataFrame:
    """docs with the entities in `text` replaced and, if extra, n_entities and entities (kind, start, end, surrogate).

    Positions are code points of the old text. A null text stays null without
    entities. Columns of docs named as the added ones are replaced. Repeated rows get equal
    surrogates; a very long text is held by one task; an empty table gives none.
    """
    rest = docs.drop("n_entities", "entities") if extra else docs
    at = rest.columns.index("text")
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])

    def run(batches):
        for b in slices(batches, 512):
            texts = b.column(at).to_pylist()
            found = [entities(t, key) for t in texts]
            cols = list(b.columns)
            cols[at] = pa.array([replaced(t, x) for t, x in zip(texts, found, strict=True)], pa.string())
            if extra:
                cols.append(pa.array(list(map(len, found)), pa.int32()))
                cols.append(pa.array([[{"kind": x.kind, "start": x.start, "end": x.end, "surrogate": x.surrogate} for x in own] for own in found], pa.list_(kind)))
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *(["n_entities", "entities"] if extra else [])])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, schema + (", n_entities int, entities array<struct<kind:string,start:int,end:int,surrogate:string>>" if extra else ""))


def op2_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudonymized(docs.select("doc_id", "text"), safe_key(docs))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: entities in the texts get surrogates; all documents stay."""
    out = pseudonymized(docs, safe_key(docs), extra=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

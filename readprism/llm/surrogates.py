"""Personal data replaced by keyed surrogates of the same type, script and format.

A surrogate comes from a keyed permutation of all values of the entity's own
shape: a Feistel network over mixed radices, conjugated with a shift, so it has
no fixed point. As it is one to one, distinct entities of a type get distinct
surrogates, and the same entity gets the same surrogate in every document,
without any table of entities. Values that would break a type's rules (a listed
name from an unlisted one, another Luhn verdict) are walked past: the
permutation is applied again until a permitted value comes, which stays one to
one. ``checked_key`` holds that against all entities of a corpus before it is
changed, and goes on to a derived key if any two would collide or one would get
several surrogates. The key is a required argument; ``session_key`` takes it
from the session's settings.

Types: ``secret`` (assigned tokens, keys, passwords), ``email``, ``iban``, ``ip``,
``card``, ``ssn``, ``phone``, ``name``. Formats: separators, letter case,
lengths, country codes, top-level domains, Luhn and mod-97 verdicts stay. Names
after a title or with a listed given name keep script and gender: listed names
become listed names of the same script and gender, others change letter by
letter within vowels and consonants of their script and keep their last letter.

Defined results: null and empty texts stay as they are; a text without entities
is returned unchanged; texts are searched whole. Rows are independent, so
repeats, null ids and further columns, whatever their names, don't matter. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readprism.llm.shared import free_name

KEY_SETTING = "spark.readprism.surrogateKey"
ROUNDS = 8

GIVEN = {
    ("latin", "f"): "Alice Anna Carmen Charlotte Claire Elena Elisabeth Emma Frieda Hannah Ingrid Isabel Julia Katharina Laura Linda Lucia Margaret Maria Mary Nina Olivia Patricia Sarah Sofia Susan Ursula".split(),
    ("latin", "m"): "Alexander Andreas Antonio Carlos Charles Daniel David Edward Francisco George Hans Henry Jacques James John Joseph Juan Karl Louis Manuel Michael Miguel Paul Peter Pierre Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("greek", "f"): "Άννα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Παύλος".split(),
    ("cyrillic", "m"): "Александр Андрей Борис Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madam Madame Mme Frau Señora Sra г-жа госпожа κυρία".split(),
    "m": "Mr Sir Monsieur Herr Señor г-н господин κύριος".split(),
    "": "Dr Prof".split(),
}
#: Country codes of one and two digits; all others have three.
ONE_DIGIT = "17"
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Words within names that stay as they are.
PARTICLES = frozenset("af al bin da das de del della den der di do dos du el ibn la las le los ten ter van von y zu zum zur".split())
_ALPHABETS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "cyrillic": ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
}
_LATIN_MORE = ("àáâãäåæèéêëìíîïòóôõöøùúûü", "çñß")

# --- keyed permutations ------------------------------------------------------


def _prf(key: bytes, tweak: str, step: int, value: int, size: int) -> int:
    data = f"{tweak}|{step}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=hashlib.sha256(key).digest(), digest_size=24).digest()) % size


def _feistel(key: bytes, tweak: str, a: int, b: int, m: int, n: int, back: bool) -> tuple[int, int]:
    sign = -1 if back else 1
    for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if step % 2 == 0:
            a = (a + sign * _prf(key, tweak, step, b, m)) % m
        else:
            b = (b + sign * _prf(key, tweak, step, a, n)) % n
    return a, b


def permute(key: bytes, tweak: str, digits: list[int], radices: list[int]) -> list[int]:
    """Permute a mixed-radix number; no number maps to itself if there are two or more."""
    half = len(digits) // 2
    m = n = 1
    a = b = 0
    for d, r in zip(digits[:half], radices[:half]):
        a, m = a * r + d, m * r
    for d, r in zip(digits[half:], radices[half:]):
        b, n = b * r + d, n * r
    size = m * n
    if size < 2:
        return digits
    tweak = f"{tweak}|{','.join(map(str, radices))}"
    a, b = _feistel(key, tweak, a, b, m, n, False)
    shifted = (a * n + b + 1 + _prf(key, tweak, ROUNDS, 0, size - 1)) % size
    a, b = _feistel(key, tweak, shifted // n, shifted % n, m, n, True)
    out = []
    for value, part in ((b, radices[half:]), (a, radices[:half])):
        for r in reversed(part):
            out.append(value % r)
            value //= r
    return out[::-1]


@lru_cache(maxsize=None)
def _class_of(char: str) -> str:
    """The ordered set of characters that ``char`` may turn into; only itself if it is in none."""
    low = char.lower()
    for chars in ("0123456789", *_ALPHABETS["cyrillic"], *_ALPHABETS["greek"], *_LATIN_MORE):
        if low in chars:
            return chars
    return "abcdefghijklmnopqrstuvwxyz" if "a" <= low <= "z" else char


def permute_text(key: bytes, tweak: str, text: str, classes: Callable[[str], str] = _class_of) -> str:
    """Permute a lower-case text; every character stays within its class."""
    sets = [classes(c) for c in text]
    moved = permute(key, tweak, [s.index(c) for s, c in zip(sets, text)], [len(s) for s in sets])
    return "".join(s[i] for s, i in zip(sets, moved))


def walk(step: Callable[[str], str], value: str, fits: Callable[[str], bool]) -> str:
    """Apply ``step`` until ``fits`` holds; ``value`` itself must fit, so the walk ends."""
    value = step(value)
    while not fits(value):
        value = step(value)
    return value


def _case_like(value: str, model: str) -> str:
    return "".join(v.upper() if c.isupper() and len(v.upper()) == 1 else v for v, c in zip(value, model))


# --- types -------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(model: str, digits: str) -> str:
    """``model`` with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), model)


def _secret(key: bytes, text: str) -> str:
    issuer = _ISSUER.match(text)
    if issuer:
        return issuer[0] + _secret(key, text[issuer.end() :]) if issuer.end() < len(text) else text
    if text.isdecimal() and text.isascii():
        return permute_text(key, "digits", text)
    if _HEX.fullmatch(text):
        moved = walk(lambda x: permute_text(key, "hex", x, lambda c: "0123456789abcdef"), text.lower(), lambda x: not x.isdecimal())
        return moved.upper() if text.upper() == text else moved

    def classes(c: str) -> str:
        for chars in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            if c in chars:
                return chars
        return c

    return walk(lambda x: permute_text(key, "secret", x, classes), text, lambda x: not _HEX.fullmatch(x) and not _ISSUER.match(x))


def _email(key: bytes, text: str) -> str:
    local, _, domain = text.lower().rpartition("@")
    name, dot, top = domain.rpartition(".")
    head, _, reserved = name.rpartition("example")
    if name == "example" or name.endswith(".example"):
        moved = permute_text(key, "example", head) + "example"
    else:
        moved = walk(lambda x: permute_text(key, "domain", x), name, lambda x: x != "example" and not x.endswith(".example"))
    surrogate = f"{permute_text(key, 'local|' + domain, local)}@{moved}{dot}{top}"
    return surrogate.upper() if text.isupper() else _case_like(surrogate, text)


def _ip(key: bytes, text: str) -> str:
    def fits(octets: str) -> bool:
        return octets.split(".")[0] not in ("0", "127", "255")

    def step(octets: str) -> str:
        return ".".join(map(str, permute(key, "ip", [int(o) for o in octets.split(".")], [256] * 4)))

    if ":" in text:
        groups = [int(g, 16) for g in ipaddress.IPv6Address(text).exploded.split(":")]
        moved = permute(key, f"ipv6|{groups[0]}", groups[1:], [65536] * 7)
        out = ipaddress.IPv6Address(":".join(f"{g:x}" for g in [groups[0], *moved])).compressed
        return out.upper() if text.upper() == text and text.lower() != text else out
    plain = ".".join(str(int(o)) for o in text.split("."))
    return walk(step, plain, fits if fits(plain) else lambda x: not fits(x))


def _card(key: bytes, text: str) -> str:
    digits = re.sub(r"\D", "", text)
    if luhn(digits):
        body = digits[0] + permute_text(key, "card|" + digits[0], digits[1:-1])
        return _refill(text, body + next(c for c in "0123456789" if luhn(body + c)))
    return _refill(text, walk(lambda x: permute_text(key, "number", x), digits, lambda x: not luhn(x)))


def _ssn(key: bytes, text: str) -> str:
    return _refill(text, permute_text(key, "ssn", re.sub(r"\D", "", text)))


def _country(text: str) -> int:
    """How many characters of an international number are ``+`` and its country code, whether or not a separator follows."""
    return 0 if text[0] != "+" else 2 if text[1] in ONE_DIGIT else 3 if text[1:3] in TWO_DIGITS else 4


def _phone(key: bytes, text: str) -> str:
    start = _country(text)
    national = re.sub(r"\D", "", text[start:])
    return text[:start] + _refill(text[start:], permute_text(key, "phone", national))


def _iban(key: bytes, text: str) -> str:
    plain = text.replace(" ", "")

    def check(body: str) -> str:
        return f"{98 - int(''.join(str(int(c, 36)) for c in body + plain[:2] + '00')) % 97:02d}"

    body = plain[4:]
    moved = permute_text(key, "iban|" + plain[:2], body.lower()).upper()
    # The old verdict stays: a wrong check sum is as wrong as it was.
    wrong = (int(plain[2:4]) - int(check(body))) % 97
    out = iter(plain[:2] + f"{(int(check(moved)) + wrong - 2) % 97 + 2:02d}" + moved)
    return "".join(" " if c == " " else next(out) for c in text)


_LISTED = {name.lower(): (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}


def _name_letter(char: str) -> str:
    for vowels, consonants in (*_ALPHABETS.values(), _LATIN_MORE):
        if char in vowels:
            return vowels
        if char in consonants:
            return consonants
    return char


def _name_word(key: bytes, word: str) -> str:
    """One word of a name; the gender is that of the list it is in or of its last letter, which stays."""
    low = word.lower()
    if low in _LISTED:
        (script, gender), i = _LISTED[low]
        names = GIVEN[script, gender]
        moved = names[permute(key, f"given|{script}|{gender}", [i], [len(names)])[0]]
        return moved.upper() if word.isupper() else moved
    if len(low) < 2 or low in PARTICLES:
        return word
    moved = walk(lambda x: permute_text(key, "name|" + low[-1], x[:-1], _name_letter) + low[-1], low, lambda x: x not in _LISTED and x not in PARTICLES)
    return _case_like(moved, word)


def _name(key: bytes, text: str) -> str:
    return re.sub(r"[^\W\d_]+", lambda m: _name_word(key, m[0]), text)


MAKERS: dict[str, Callable[[bytes, str], str]] = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone, "name": _name}

# --- detection ---------------------------------------------------------------

_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈ-Ώ", "a-zß-öø-ÿа-яёα-ωά-ώ"
_NAME_WORD = f"[{_UPPER}][{_LOWER}]+(?:-[{_UPPER}][{_LOWER}]+)?"
_SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|secret[_-]?key)\s*[=:]\s*(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([A-Za-z0-9_+/=-]{16,}))")
_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{4,39}(?![\w:]|\.\d)")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_ISSUER = re.compile(r"AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ")
_ISSUED = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{16,}|sk-[A-Za-z0-9]{20,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})(?![A-Za-z0-9_-])")
_CARD = re.compile(r"(?<![\w+.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w|[.-]\d)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d{9,14})(?!\w|[.-]\d)")
_TITLES = "|".join(re.escape(t) for titles in TITLES.values() for t in titles)
#: A further word of a name, after any particles; names may have any number of them.
_MORE = rf"(?: (?:(?:{'|'.join(sorted(PARTICLES))}) )*{_NAME_WORD})"
_TITLED = re.compile(rf"(?<!\w)(?:{_TITLES})\.? ({_NAME_WORD}{_MORE}*)")
_GIVEN = re.compile(rf"(?<!\w)(?:{'|'.join(n for names in GIVEN.values() for n in names)}){_MORE}+(?!\w)")
_HINT = re.compile(r"[0-9@]")


def _is_ipv6(text: str) -> bool:
    """Whether it is an address with at least two groups of digits (``::1`` and the like are no one's)."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return len([g for g in text.split(":") if g]) > 2


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of entities, in order and without overlaps; the type that comes first wins."""
    spans: list[tuple[int, int, str]] = []

    def add(pattern: re.Pattern, kind: str, fits: Callable[[str], bool] = lambda _: True) -> None:
        for m in pattern.finditer(text):
            group = m.lastindex or 0
            a, b = m.span(group)
            at = bisect(spans, (a, b))
            if fits(m[group]) and (at == 0 or spans[at - 1][1] <= a) and (at == len(spans) or b <= spans[at][0]):
                spans.insert(at, (a, b, kind))

    low = text.lower()
    if any(w in low for w in ("token", "secret", "passw", "pwd", "key")):
        add(_SECRET, "secret")
    if any(x in text for x in ("AKIA", "gh", "xox", "sk-", "eyJ")):
        add(_ISSUED, "secret")
    if _HINT.search(text):
        if "@" in text:
            add(_EMAIL, "email")
        add(_IBAN, "iban", lambda x: 15 <= len(x.replace(" ", "")) <= 34)
        add(_IP, "ip")
        if "::" in text or text.count(":") > 6:
            add(_IPV6, "ip", _is_ipv6)
        add(_CARD, "card", lambda x: 13 <= len(re.sub(r"\D", "", x)) <= 19)
        add(_SSN, "ssn")
        add(_PHONE, "phone", lambda x: 7 <= len(re.sub(r"\D", "", x)) <= 15)
    add(_TITLED, "name")
    add(_GIVEN, "name")
    return spans


def replace(text: str, key: bytes) -> tuple[str, list[dict]]:
    """The text with surrogates, and what was replaced: type, span in the original, keyed tag of the entity, surrogate."""
    out, entities, at = [], [], 0
    for a, b, kind in find(text):
        surrogate = MAKERS[kind](key, text[a:b])
        entities.append({"type": kind, "start": a, "end": b, "tag": tag_of(key, kind, text[a:b]), "surrogate": surrogate})
        out += [text[at:a], surrogate]
        at = b
    return "".join([*out, text[at:]]), entities


def tag_of(key: bytes, kind: str, value: str) -> str:
    """A keyed tag of an entity: equal for mentions of the same one."""
    return hmac.new(key, f"{kind}|{identity(kind, value)}".encode(), hashlib.sha256).hexdigest()[:32]


def identity(kind: str, value: str) -> str:
    """What makes two mentions the same entity: letter case and separators don't."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        return re.sub(r"[^\d+]", "", value)
    if kind == "ip" and ":" in value:
        return ipaddress.IPv6Address(value).exploded
    if kind == "ip":
        return ".".join(str(int(o)) for o in value.split("."))
    return value.replace(" ", "").upper() if kind == "iban" else value if kind == "secret" else value.lower()


ENTITIES = "array<struct<type:string,start:int,end:int,tag:string,surrogate:string>>"


def surrogates(text: Column, key: bytes) -> Column:
    """struct(text, entities); the text is null where nothing was replaced, so unchanged texts don't travel back."""

    @F.pandas_udf(f"text string, entities {ENTITIES}")
    def change(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            done = [replace(t, key) if t else (None, []) for t in texts]
            yield pd.DataFrame({"text": [t if e else None for t, e in done], "entities": [e for _, e in done]})

    return change(text)


def session_key(spark: SparkSession) -> bytes:
    """The key that the setting ``KEY_SETTING`` has; without it, a random one that is set for the rest of the session."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found.encode()


def pseudonymize(docs: DataFrame, *, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text`` and a last column ``entities`` (``shared.free_name`` if that name is taken).

    One projection; nothing is shuffled.
    """
    packed = docs.select(F.struct("*").alias("row"), surrogates(F.col("text"), key).alias("found"))
    columns = [F.coalesce("found.text", "row.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return packed.select(*columns, F.col("found.entities").alias(free_name("entities", docs.columns)))


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """(type, what, tag, n): surrogates that stand for several entities, and entities with several surrogates, over all of ``docs``.

    Mentions are compared by what makes them the same entity (``identity``), in
    the original and in the surrogate. Each task passes on what is distinct in
    its batches, as keyed tags, so an entity that very many documents name is a
    few rows.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch.column("text"):
                if text.is_valid:
                    seen |= {(e["type"], e["tag"], tag_of(key, e["type"], e["surrogate"])) for e in replace(text.as_py(), key)[1]}
            rows = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(3)], ["type", "entity", "surrogate"])

    each = docs.select("text").mapInArrow(pairs, "type string, entity string, surrogate string").distinct()
    sides = each.select("type", F.explode(F.array(F.struct(F.lit("surrogate").alias("what"), F.col("surrogate").alias("tag")), F.struct(F.lit("entity").alias("what"), F.col("entity").alias("tag")))).alias("s"))
    return sides.groupBy("type", "s.what", "s.tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_key(docs: DataFrame, key: bytes, *, tries: int = 8) -> bytes:
    """``key``, or the first of a row of keys derived from it, under which ``docs`` have no collisions."""
    for i in range(tries):
        tried = key if i == 0 else hmac.new(key, str(i).encode(), hashlib.sha256).digest()
        if collisions(docs, tried).isEmpty():
            return tried
    raise ValueError(f"surrogates collide under {tries} keys")

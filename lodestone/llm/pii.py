"""Personal data replaced by surrogates: each detected entity gets a keyed replacement of its own type and format
(length, case, script, separators, check digits), the same wherever it occurs and different for different entities. Common given
names become others of their script and gender, by a keyed cycle; other names keep the endings that carry gender, and each of
their letters becomes another of its script and sort.

A surrogate is a keyed permutation of the entity's format (a Feistel network over the characters that may change),
so equal entities agree and different ones differ without any table. What a permutation cannot see is checked on the
table of distinct entities: a surrogate that is a real entity of the corpus, or that two entities share, is drawn
again under another tweak until none is left, and only documents with such an entity are joined to the few exceptions.

Found: e-mail addresses, keys and tokens, IPv4 and IPv6 addresses, IBANs, payment cards, social security numbers (dashed, or
after their name), telephone numbers (international, with an area code in brackets, in the dashed form, or after a word that
announces one), and names after an honorific (in any script, whole: with particles, initials, capitals and any spaces between), with all that
repeats them in the same text. Particles and initials stay. Plain numbers are left alone. Street
addresses, birth dates, and names without any honorific in their text are not found.

Scale: two scans of whole texts, each linear in the text; between them only distinct entities are shuffled, with map-side
aggregation."""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, passes, settle

#: Draws before a surrogate may be longer than its entity.
SAME_LENGTH = 4
#: Characters that one permutation takes.
BLOCK = 512
#: Honorifics before names.
HONORIFICS = ("Mr", "Mrs", "Ms", "Miss", "Mister", "Herr", "Frau", "Señor", "Señora", "Señorita", "Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle", "Dr", "Prof", "г-н", "г-жа", "господин", "госпожа")
#: Endings of names that carry gender.
ENDINGS = ("ovna", "evna", "ovich", "evich", "ova", "eva", "ina", "aya", "ска", "ова", "ева", "ина", "ая", "ов", "ев", "ин", "ий", "ov", "ev", "iy")
#: Common given names, by script and gender.
GIVEN = (
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew george kevin brian hans peter klaus jürgen wolfgang stefan jean pierre michel jacques luc josé juan carlos luis miguel antonio pedro marco giovanni paolo max".split(),
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily anna laura julia emma ursula monika petra sabine claudia marie sophie camille chloé isabelle maría carmen ana lucía elena rosa giulia chiara francesca paola eva".split(),
    "александр дмитрий сергей андрей алексей иван михаил николай владимир павел егор артём максим олег игорь".split(),
    "анна мария елена ольга наталья екатерина татьяна ирина светлана юлия дарья софия полина вера людмила".split(),
)
_GIVEN = {name: k for k, names in enumerate(GIVEN) for name in names}

PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+\-])[^\W_][\w.%+\-]*+@[^\W_][\w\-]*+(?:\.[\w\-]++)*\.[^\W\d_]{2,})"
    r"|(?P<key>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+\b|\bsk-[A-Za-z0-9]{20,}+\b)"
    r"|(?P<hex>\b(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,128}\b)"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]{0,6}:)[0-9A-Fa-f:]{2,39}+(?![\w:]|\.\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<card>(?<![\w.+-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{4,5})(?![\w:-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<=\bSSN )\d{9}(?!\w)|(?<=\bSSN: )\d{9}(?!\w))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    r"|(?<![\w+])\+(?!1[ .(-])\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,3}(?!\w|[.,:/]\d)"
    r"|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.-])\d{3}-\d{3}-\d{4}(?![\w-])"
    r"|(?:(?<=\b[Tt]el: )|(?<=\b[Tt]el\. )|(?<=\b[Pp]hone )|(?<=\b[Pp]hone: )|(?<=\b[Cc]all )|(?<=\b[Mm]obile: )|(?<=\bTelefon: ))\d{3,5}[ .-]?\d{3,4}[ .-]?\d{2,4}(?![\w-]))"
)
#: Words between an honorific and a name, or within a name, that are no name of their own.
PARTICLES = ("van", "der", "den", "de", "het", "ter", "ten", "von", "vom", "zu", "zum", "zur", "del", "della", "di", "da", "das", "do", "dos", "du", "des", "la", "las", "le", "los", "el", "al", "bin", "ibn", "ben", "bint", "abu", "san", "st", "y", "e")
#: Scripts that part no words: a name in them is the whole run of letters after the honorific, with the dots that part its names, and is
#: found again within longer runs.
UNPARTED = re.compile("[\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\uac00-\ud7a3\U00020000-\U000323af]")
_DOTS = "・･·"
_TOKEN = rf"(?:[^\W\d_a-z](?:['’]?[^\W\d_]+(?:[-{_DOTS}'’][^\W\d_]+)*)?)"
_GAP = r"[^\S\n]+"
_BETWEEN = rf"(?:(?:(?i:{'|'.join(PARTICLES)})\.?{_GAP}|[dl]['’]|[^\W\d_a-z]\.(?:{_GAP})?)*)"
#: An honorific as it is listed or in capitals, with or without a dot, or an abbreviated one in small letters with it.
_TITLE = "|".join(f"{re.escape(h)}\\.?|{re.escape(h.upper())}\\.?" + (f"|{re.escape(h.lower())}\\." if len(h) < 5 and h not in ("Miss", "Herr", "Frau", "г-н") else "") for h in HONORIFICS)
NAMED = re.compile(rf"(?<!\w)(?:(?:{_TITLE})(?:\s+|(?<=\.)))+({_BETWEEN}{_TOKEN}(?:{_GAP}{_BETWEEN}{_TOKEN}){{0,2}})")
_ELIDED = re.compile(r"^[dlDL]['’](?=[^\W\d_a-z])")
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_HINTS = tuple(sorted({x for h in HONORIFICS for x in (h[:3], h[:3].upper(), *((h.lower() + ".",) if len(h) < 5 else ()))}))
_NO_NAMES = {x for w in (*HONORIFICS, *PARTICLES) for x in (w, w.upper(), w.lower(), w.capitalize())}
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> int:
    """The check digit that follows."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def mod97(country: str, rest: str) -> str:
    """The two check digits of an IBAN."""
    n = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - n % 97:02d}"


def is_ip6(value: str) -> bool:
    """An address, and no clock or name of a program: with a digit, and three groups or a first one of four characters."""
    groups = [g for g in value.split(":") if g]
    if value.count(":") < 2 or not groups or (len(groups) < 3 and len(groups[0]) < 4) or not _DIGIT.search(value):
        return False
    try:
        return bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


def right(kind: str, value: str) -> bool:
    """Whether check digits and the like agree."""
    if kind == "iban":
        return mod97(value[:2], value[4:].replace(" ", "")) == value[2:4]
    if kind == "card":
        return luhn(re.sub(r"\D", "", value)[:-1]) == int(value[-1])
    return kind != "ip6" or is_ip6(value)


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value), in order, without overlaps. Names follow honorifics; a name found so is
    also found wherever else the text has it alone."""
    out = []
    if "@" in text or _DIGIT.search(text) or "sk-" in text or "AKIA" in text or "::" in text:
        at = 0
        while m := PATTERN.search(text, at):
            kind = m.lastgroup
            if right(kind, m[0]):
                out.append((m.start(), m.end(), kind, canonical(kind, m[0])))
                at = m.end()
            else:  # what was read so far may hold another
                at = m.start() + 1
    if any(h in text for h in _HINTS):
        names, parts, found = set(), set(), []
        for m in NAMED.finditer(text):
            for w in re.finditer(r"[^\s]+", m[1]):
                n = w[0].strip(".,")
                if UNPARTED.match(n):
                    parts.update((n, *(x for x in re.split(f"[{_DOTS}]", n) if len(x) > 1)))
                    continue
                n = _bare(n).rsplit(".", 1)[-1]  # J.R.R.Tolkien: initials stay
                n = _ELIDED.sub("", n)
                for n in {n, *n.split("-")}:  # parts of a double name may stand alone
                    if len(n) > 1 and not "a" <= n[0] <= "z":
                        names.update((n, n.upper(), *((n.capitalize(),) if n.isupper() else ())))
        names -= _NO_NAMES
        starts, ends = [s for s, _, _, _ in out], [e for _, e, _, _ in out]
        if names:
            for m in WORD.finditer(text):
                if (w := _bare(m[0])) in names or (w := _ELIDED.sub("", w)) in names:
                    at = m.start() + m[0].index(w)
                    found.append((at, at + len(w)))
                elif "-" in w:
                    found += [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer("[^-]+", w) if p[0] in names]
        if parts:
            lengths, end = sorted({len(p) for p in parts}, reverse=True), 0
            for m in re.finditer("[" + "".join(sorted({p[0] for p in parts})) + "]", text):
                if m.start() >= end and (n := next((n for n in lengths if text[m.start() : m.start() + n] in parts), 0)):
                    end = m.start() + n
                    found.append((m.start(), end))
        last = -1
        for s, e in sorted(set(found), key=lambda x: (x[0], -x[1])):
            if s < last:
                continue
            last = e
            k = bisect.bisect_left(ends, s + 1)  # the first that ends beyond the start
            if k == len(starts) or starts[k] >= e:
                out.append((s, e, "given" if text[s:e].lower() in _GIVEN else "name", canonical("name", text[s:e])))
    return sorted(out)


def _bare(word: str) -> str:
    """A name without the 's that English adds."""
    return word[:-2] if word[-2:] in ("'s", "’s") else word


def canonical(kind: str, value: str) -> str:
    """One form for all the ways to write an entity."""
    if kind in ("email", "name"):
        return value.lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "phone":
        return re.sub(r"\D", "", _national(value)[1])
    if kind in ("iban", "card", "ssn"):
        return re.sub(r"[ -]", "", value)
    return value


def _national(value: str) -> tuple[str, str]:
    """A phone number's country code, with what follows it, and the rest."""
    m = re.match(r"\+\d{1,3}(?=[ .(-])[ .-]?|\+(?:1|7|[2-9]\d)(?=\d)", value)
    return (m[0], value[m.end() :]) if m else ("", value)


class Cipher:
    """Keyed permutations."""

    def __init__(self, key: bytes):
        self.key = key

    def number(self, x: int, n: int, tweak: str) -> int:
        """A permutation of range(n): eight Feistel rounds on the next domain a * b, walked until the result is in range."""
        if n < 2:
            return x
        a = 1 << ((n - 1).bit_length() + 1) // 2
        b = -(-n // a)
        size = (max(a, b).bit_length() + 7) // 8 + 8
        while True:
            left, right = x // a, x % a  # left < b
            p, q = b, a
            for i in range(8):
                seed = hashlib.shake_256(b"%b|%b|%d|%d|%d" % (self.key, tweak.encode(), n, i, right)).digest(size)
                left, right = right, (left + int.from_bytes(seed)) % p
                p, q = q, p
            x = left * a + right
            if x < n:
                return x

    def text(self, value: str, sets: list[str], tweak: str) -> str:
        """A permutation of the texts whose i-th character is of the i-th set (the set itself says which); of long ones, in blocks."""
        if len(value) > BLOCK:
            return "".join(self.text(value[i : i + BLOCK], sets[i : i + BLOCK], f"{tweak}|{i}") for i in range(0, len(value), BLOCK))
        x, n = 0, 1
        for c, s in zip(value, sets, strict=True):
            x, n = x * len(s) + s.index(c), n * len(s)
        x = self.number(x, n, tweak + "|" + "".join(s[0] + str(len(s)) for s in sets))
        out = []
        for s in reversed(sets):
            out.append(s[x % len(s)])
            x //= len(s)
        return "".join(reversed(out))


DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Vowels and consonants of scripts.
SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")


#: Letters of the Latin script that do not decompose, and what they sound like.
_LIKE = {"ø": "o", "æ": "a", "œ": "o", "ı": "i", "ð": "d", "þ": "t", "ł": "l", "đ": "d"}


def _sort(c: str) -> tuple:
    """What two letters must share to stand for each other: script, sort (vowel or not, as far as it is known)."""
    plain = _LIKE.get(c) or unicodedata.normalize("NFD", c)[0]
    return unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), next((k for k, s in enumerate(SOUNDS) if plain in s), -1)


@functools.lru_cache(maxsize=4096)
def _of(sets: tuple[str, ...], c: str) -> str:
    """The characters that c may become, itself among them: its set, or the letters of its sort in its block of 128 codes
    (256 of an ideographic or syllabic script) that have one upper case. A character that is no letter stays."""
    found = next((s for s in sets if c in s), None)
    if found or not c.isalpha():
        return found or c
    width, sort = (256 if ord(c) >= 0x3040 else 128), _sort(c)
    first = ord(c) // width * width
    some = [x for x in map(chr, range(first, first + width)) if x.isalpha() and x == x.lower() and len(x.upper()) == 1 and x.upper().lower() == x and _sort(x) == sort]
    return "".join(some) if c in some else c


@functools.lru_cache(maxsize=64)
def _cycle(key: bytes, k: int) -> dict[str, str]:
    """Each of the given names of a table and the next of its length in an order that the key decides; names that are alone with
    their length go round among themselves. None keeps its own."""
    sizes = Counter(map(len, GIVEN[k]))
    out = {}
    for size in {len(n) if sizes[len(n)] > 1 else 0 for n in GIVEN[k]}:
        order = [n for n in GIVEN[k] if (len(n) if sizes[len(n)] > 1 else 0) == size]
        order.sort(key=lambda n: hmac.digest(key, n.encode(), "sha256"))
        out |= dict(zip(order, [*order[1:], order[0]], strict=True))
    return out


def surrogate(cipher: Cipher, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value."""
    if kind == "given":
        return _cycle(cipher.key, _GIVEN[value])[value]
    tweak = f"{kind}|{attempt}"
    more = max(0, attempt - SAME_LENGTH + 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        plain = lambda s, t: cipher.text(s, [_of((DIGITS, LOWER), c) for c in s], t)
        return plain(local, tweak) + cipher.text(LOWER[:1] * more, [LOWER] * more, f"{tweak}|{value}") + "@" + plain(host, f"host|{attempt}") + "." + top
    if kind == "ip6":
        return value[:5] + cipher.text(value[5:], [_of(("0123456789abcdef",), c) for c in value[5:]], tweak + value[:5])
    if kind == "name" and "-" in value:  # part by part, as they are where they stand alone
        return "-".join(surrogate(cipher, "given" if p in _GIVEN else "name", p, attempt) if p else p for p in value.split("-"))
    if kind == "name":
        end = next((e for e in ENDINGS if value.endswith(e) and len(value) > len(e) + 2), value[-1:] if value[-1:] in "aeoiаяαη" and len(value) > 2 else "")
        stem = value[: len(value) - len(end)]
        sets = [_of(SOUNDS, c) for c in stem]
        last = next((s for s in reversed(sets) if len(s) > 1), SOUNDS[1])  # what is added is of the name's own script
        like = next((SOUNDS[k : k + 2] for k in (0, 2, 4) if last in SOUNDS[k : k + 2]), (last,))
        extra = cipher.text("".join(s[0] for s in like) * more, list(like) * more, f"{tweak}|{value}") if more else ""
        while True:  # never a given name of the tables: those are others' surrogates
            stem = cipher.text(stem, sets, tweak)
            if (new := stem + extra + end) not in _GIVEN or all(len(s) == 1 for s in sets):
                return new
    if kind == "key":
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", value)[0]
        some = DIGITS + UPPER if head in ("AKIA", "ASIA") else DIGITS + UPPER + LOWER
        return head + cipher.text(value[len(head) :], [some] * (len(value) - len(head)), tweak)
    if kind == "hex":
        return cipher.text(value, ["0123456789abcdef"] * len(value), tweak)
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, value.split("."))))
        place = next(((lo, n) for lo, n in ((10 << 24, 1 << 24), (127 << 24, 1 << 24), (2886729728, 1 << 20), (3232235520, 1 << 16)) if lo <= x < lo + n), None)
        if place:
            x = place[0] + cipher.number(x - place[0], place[1], tweak)
        else:
            usual = 1 << 24 <= x < 224 << 24
            while True:
                x = cipher.number(x, 1 << 32, tweak)
                inside = any(lo <= x < lo + n for lo, n in ((10 << 24, 1 << 24), (127 << 24, 1 << 24), (2886729728, 1 << 20), (3232235520, 1 << 16)))
                if not inside and (1 << 24 <= x < 224 << 24) == usual:
                    break
        return ".".join(map(str, x.to_bytes(4)))
    if kind == "iban":
        rest = cipher.text(value[4:], [_of((DIGITS, UPPER), c) for c in value[4:]], tweak + value[:2])
        return value[:2] + mod97(value[:2], rest) + rest
    if kind == "card":
        if luhn(value[:-1]) == int(value[-1]):
            body = value[0] + cipher.text(value[1:-1], [DIGITS] * (len(value) - 2), tweak + value[0])
            return body + str(luhn(body))
        while True:
            value = value[0] + cipher.text(value[1:], [DIGITS] * (len(value) - 1), tweak + value[0])
            if luhn(value[:-1]) != int(value[-1]):
                return value
    first = value[:1] in ("0", "1")  # phone, ssn: digits
    while True:
        value = cipher.text(value, [DIGITS] * len(value), tweak)
        if (value[:1] in ("0", "1")) == first:
            return value


def written(kind: str, value: str, new: str) -> str:
    """A canonical surrogate in the form in which the entity was written: separators, case, country code."""
    head, rest = _national(value) if kind == "phone" else ("", value)
    if kind == "ip6":
        new = ipaddress.IPv6Address(new).compressed if "::" in value else new
        return new.upper() if value.upper() == value else new
    if kind in ("phone", "ssn", "card", "iban"):
        it = iter(new)
        return head + "".join(next(it) if c.isalnum() else c for c in rest)
    if kind in ("email", "name", "given"):
        if value.isupper() and len(value) > 1:
            return new.upper()
        return "".join(n.upper() if i < len(value) and value[i].isupper() else n for i, n in enumerate(new))
    return new


def replaced(cipher: Cipher, text: str, exceptions: dict | None = None) -> tuple[str, int]:
    found = mentions(text)
    if not found:
        return text, 0
    out, at, known = [], 0, dict(exceptions or {})
    for start, end, kind, value in found:
        if (new := known.get((kind, value))) is None:
            new = known[kind, value] = surrogate(cipher, kind, value)
        out += [text[at:start], written(kind, text[start:end], new)]
        at = end
    return "".join([*out, text[at:]]), len(found)


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, value) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = set()
            for _, texts in passes(batch, "text"):
                for text in texts.to_pylist():
                    got.update((k, v) for _, _, k, v in mentions(text))
            if got:
                kind, value = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(value)], ["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind string, value string").distinct()


def drawn(cipher: Cipher, some: DataFrame, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, value = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [surrogate(cipher, k, v, attempt) for k, v in zip(kind, value, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(new, pa.string()), pa.array([attempt] * len(new), pa.int32())], ["kind", "value", "new", "attempt"])

    return some.select("kind", "value").mapInArrow(run, "kind string, value string, new string, attempt int")


def exceptions(spark: SparkSession, cipher: Cipher, docs: DataFrame) -> DataFrame | None:
    """(kind, value, new) of entities whose first surrogate is a real entity or another's; None where there is none."""
    real = settle(spark, entities(docs).where("kind <> 'given'"), "entities", few=True)  # given names go round in a cycle, which never clashes
    plain = real.select("kind", F.col("value").alias("new"))
    chosen, attempt = settle(spark, drawn(cipher, real, 0), "surrogates"), 0
    while True:
        shared = chosen.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min_by("value", F.struct("attempt", "value")).alias("first")).where("n > 1").drop("n")
        clash = chosen.join(plain, ["kind", "new"], "left_semi").select("kind", "value").unionByName(chosen.join(shared, ["kind", "new"]).where("value <> first").select("kind", "value")).distinct()
        clash = settle(spark, clash, "clashes", few=True)
        if clash.isEmpty():
            break
        attempt += 1
        chosen = settle(spark, chosen.join(clash, ["kind", "value"], "left_anti").unionByName(drawn(cipher, clash, attempt)), "surrogates")
    return settle(spark, chosen.where("attempt > 0").select("kind", "value", "new"), "exceptions") if attempt else None


def pseudonymised(spark: SparkSession, docs: DataFrame, key: bytes, id_col: str = "doc_id") -> DataFrame:
    """docs with its own columns, `text` rewritten, and `n_replaced` last. Null texts stay null, empty ones empty; very long texts
    take time and memory in proportion. Rows are rewritten row by row, also where ids are null or repeat; a clashing column
    n_replaced of docs is kept under its name and the count is called n_replaced_ (and so on). An empty table gives an empty table.
    Whoever has the key can undo the surrogates; an empty key is refused."""
    if not key:
        raise ValueError("surrogates need a key")
    cipher = Cipher(key)
    few = exceptions(spark, cipher, docs)
    name, digest, held = (fresh(n, docs.columns) for n in ("n_replaced", "digest", "own"))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.IntegerType())])
    at = docs.columns.index("text")
    if few is None:
        return _rewritten(cipher, docs, schema, at, held)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in passes(batch, "text"):
                got = {(hashlib.sha256(t.encode("utf-8", "replace")).digest(), k, v) for t in texts.to_pylist() for _, _, k, v in mentions(t)}
                if got:
                    d, k, v = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(k), pa.array(v)], ["digest", "kind", "value"])

    rows = docs.select("text").mapInArrow(named, "digest binary, kind string, value string").join(few, ["kind", "value"])
    own = settle(spark, rows.distinct().groupBy("digest").agg(F.collect_list(F.struct("kind", "value", "new")).alias(held)), "own-exceptions")
    keyed = docs.withColumn(digest, F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    return _rewritten(cipher, keyed.join(own.withColumnRenamed("digest", digest), digest, "left").select(*docs.columns, held), schema, at, held)


def _rewritten(cipher: Cipher, rows: DataFrame, schema: T.StructType, at: int, held: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.names[at]
            own = batch.schema.get_field_index(held)
            for part, _ in passes(batch, column):
                texts = part.column(at).to_pylist()
                extra = part.column(own).to_pylist() if own >= 0 else [None] * len(texts)
                new = [(None, 0) if t is None else replaced(cipher, t, {(e["kind"], e["value"]): e["new"] for e in x or ()}) for t, x in zip(texts, extra, strict=True)]
                columns = [c for i, c in enumerate(part.columns) if i != own]
                columns[at] = pa.array([t for t, _ in new], part.column(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in new], pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)

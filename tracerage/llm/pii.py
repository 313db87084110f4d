"""Personal data: keyed, type-consistent surrogates (operator 9)."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_columns, lean, materialise, small_batches, worker_cache

#: Session setting that holds the secret key of surrogates.
KEY_SETTING = "spark.tracerage.surrogates.key"
#: For the synthetic sample tables alone: whoever knows a key can undo its surrogates.
SAMPLE_KEY = b"key of the sample tables"

#: First names by gender in Latin, Cyrillic and Greek script, and titles.
FEMALE = "Alice Amanda Amy Angela Anna Barbara Beatrice Carmen Carol Charlotte Clara Deborah Donna Elena Elisabeth Elizabeth Emily Emma Eva Greta Hannah Irene Isabel Jennifer Jessica Julia Karen Karin Laura Linda Lisa Lucia Margaret Maria Marie Martha Mary Mia Michelle Nadia Nancy Nora Olivia Patricia Paula Petra Rebecca Rosa Sandra Sara Sarah Sharon Sophie Stephanie Susan".split()
MALE = "Adam Alexander Andreas Andrew Anthony Anton Brian Carlos Charles Daniel David Diego Donald Edward Emil Eric Felix Frank Georg George Hans Hugo Ivan Jack Jacob James Jeffrey John Jonathan Jorge Joseph Karl Kenneth Kevin Louis Luis Marc Martin Matthew Max Michael Nicholas Oscar Paul Peter Richard Robert Ronald Ryan Stephen Steven Thomas Timothy Victor William".split()
FEMALE_CYRILLIC = "Анна Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split()
MALE_CYRILLIC = "Александр Алексей Андрей Дмитрий Иван Михаил Николай Олег Павел Сергей".split()
FEMALE_GREEK = "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split()
MALE_GREEK = "Αλέξανδρος Ανδρέας Βασίλης Γιάννης Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος".split()
FIRST_NAMES = [FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC, FEMALE_GREEK, MALE_GREEK]
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora Господин Госпожа Доктор Κύριος Κυρία Δρ".split()
PARTICLES = "van von der den de la le du di da del dos bin al ter ten zu".split()
_GIVEN = {name: names for names in FIRST_NAMES for name in names}
#: First names all in capitals: short ones are left to other words, such as MAX.
_CAPITALS = {name.upper(): name for name in [*FEMALE, *MALE] if len(name) > 3}


def _letters(first: int, last: int, kind: str) -> str:
    return "".join(c for c in map(chr, range(first, last)) if unicodedata.category(c) == kind)


#: Ranges of lower and upper case letters: Latin, Greek, Cyrillic.
_LOWER = [_letters(lo, hi, "Ll") for lo, hi in ((0x61, 0x7B), (0xDF, 0x100), (0x100, 0x180), (0x3AC, 0x3CF), (0x430, 0x460))]
_UPPER = [_letters(lo, hi, "Lu") for lo, hi in ((0x41, 0x5B), (0xC0, 0xDF), (0x100, 0x180), (0x386, 0x3AC), (0x400, 0x430))]
_CASES = [(f"[{''.join(_UPPER[i:j])}]", f"[{''.join(_LOWER[i:j])}]+") for i, j in ((0, 3), (3, 4), (4, 5))]
#: A name's word: "Smith", "Müller-Lüdenscheidt", "O'Brien", "McDonald".
_WORD = "(?:" + "|".join(f"{head}{u}{low}(?:-{u}{low})?" for head, (u, low) in zip(("(?:[A-Z]['’]|Mac|Mc)?", "", ""), _CASES, strict=True)) + ")"
#: A surname, particles and initials before it included: "van der Berg", "F. Kennedy".
_NAME = rf"(?:(?:[A-Z]\. ){{0,2}}(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_WORD})"
_LOUD = "(?:(?:[A-Z]['’])?[A-Z]{2,}(?:-[A-Z]{2,})?)"
#: Kinds in order of precedence. A match of an earlier one hides later ones that overlap it.
PATTERNS = [
    ("email", r"(?<![\w.+%-])[\w.+%-]+@[A-Za-z0-9\u00C0-\u024F-]+(?:\.[A-Za-z0-9\u00C0-\u024F-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:ghp|gho|ghs)_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("mac", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:])"),
    ("ipv6", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ipv4", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"),
    ("card", r"(?<![\d.])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3\d{3}[ -]\d{6}[ -]\d{5})(?!\d)"),
    (
        "phone",
        r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{1,8}){2,6}(?!\d)"
        r"|(?<![\d.-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\w.,-])0\d(?:[ .]\d{2}){4}(?![\d-])|(?<![\w.,-])0\d{2,4}[ /-]\d{6,8}(?![\d-])",
    ),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    (
        "name",
        rf"(?<!\w)(?:{'|'.join(TITLES)})\.? (?:(?:(?:{'|'.join(_GIVEN)}) ){{1,2}}{_NAME}|{_NAME}(?: {_NAME})?|{_LOUD}(?: {_LOUD})?)(?!\w)"
        rf"|(?<!\w)(?:{'|'.join(_GIVEN)}) (?:(?:{'|'.join(_GIVEN)}) )?{_NAME}(?!\w)|(?<!\w)(?:{'|'.join(_CAPITALS)}) {_LOUD}(?!\w)",
    ),
]
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
#: For texts without any title or first name, most of them: the long lists aren't tried at each place.
_NAMELESS = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS if k != "name"))
_DIGIT, _PAIR = re.compile(r"\d"), re.compile("[0-9A-Fa-f]:[0-9A-Fa-f:]")


@lru_cache(1)
def _words():
    """Aho-Corasick over titles and first names."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in [*TITLES, *_GIVEN, *_CAPITALS]:
        found.add_word(word, len(word))
    found.make_automaton()
    return found


def _named(text: str) -> bool:
    """Whether a title or first name stands in the text as a word: a name has one."""
    for last, n in _words().iter(text):
        if text[last + 1 : last + 2] in (" ", ".") and not text[max(0, last - n) : last - n + 1].isalnum():
            return True
    return False


def _signed(text: str) -> bool:
    """Whether the text has a digit, an at sign or hexadecimal groups: all entities but names have one."""
    return "@" in text or bool(_DIGIT.search(text)) or (":" in text and bool(_PAIR.search(text)))


def hinted(text: str) -> bool:
    """Any entity has a sign, or a title or first name; this settles most texts."""
    return _signed(text) or _named(text)


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans of personal data as ``(start, end, kind)``, in order, without overlap."""
    named = _named(text)
    if not named and not _signed(text):
        return []
    out, at = [], 0
    for m in (FINDER if named else _NAMELESS).finditer(text):
        start, end = m.span()
        if m.lastgroup == "email":  # a full stop or a sign before the address isn't part of it
            start += len(m[0]) - len(m[0].lstrip(".+%-"))
        if start >= at:
            out.append((start, end, m.lastgroup))
            at = end
    return _with_bare_names(text, out)


def _parts(name: str) -> list[tuple[str, str]]:
    """A name's words as ``(role, word)``: title, given, initial, particle or surname."""
    out = []
    for i, word in enumerate(name.split(" ")):
        if not i and word.rstrip(".") in TITLES:
            role = "title"
        elif word in _GIVEN or word in _CAPITALS:
            role = "given"
        elif len(word) == 2 and word[1] == ".":
            role = "initial"
        else:
            role = "particle" if word in PARTICLES else "surname"
        out.append((role, word))
    return out


def _with_bare_names(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``found`` and, wherever a found person's first name or surname stands by itself in the text, that too."""
    words = {w for a, b, kind in found if kind == "name" for role, w in _parts(text[a:b]) if role in ("given", "surname")}
    # Longest first: of "Anna" and "Anna-Lena" the whole word is met.
    words = sorted((w for w in words if len(w) > 2), key=lambda w: (-len(w), w))
    if not words:
        return found
    bare = re.compile(rf"(?<![\w@.-])(?:{'|'.join(map(re.escape, words))})(?![\w@-])")
    out, k = [], 0
    for m in bare.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            out.append(found[k])
            k += 1
        if k == len(found) or found[k][0] >= m.end():
            out.append((*m.span(), "name"))
    return out + found[k:]


def _alphabets() -> dict[str, str]:
    """Each letter's or digit's alphabet: characters of one script, case and kind stay among each other."""
    rows = [*_LOWER, *_UPPER]
    rows += ["".join(map(chr, r)) for r in (range(0x5D0, 0x5EB), range(0x621, 0x63B), range(0x905, 0x93A), range(0x3041, 0x3097), range(0x30A1, 0x30F7), range(0x4E00, 0x9FA6), range(0xAC00, 0xD7A4))]
    return {c: row for row in rows for c in row}


_LETTERS = _alphabets()


def alphabet_of(c: str) -> str | None:
    """The characters that may take the place of ``c``, itself among them; decimal digits stay in their script."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    return _LETTERS.get(c)


HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"


def _random(key: bytes, tweak: str, turn: int, value: int, below: int) -> int:
    size = (below.bit_length() + 7) // 8 + 8
    data = f"{tweak}\0{turn}\0{value}".encode()
    out, block = b"", 0
    while len(out) < size:
        out += hashlib.blake2b(data + bytes([block]), key=key[:64], digest_size=64).digest()
        block += 1
    return int.from_bytes(out[:size], "big") % below


def permute(value: int, below_left: int, below_right: int, key: bytes, tweak: str, rounds: int = 8) -> int:
    """A keyed permutation of the numbers under below_left * below_right: an unbalanced Feistel net."""
    left, right = divmod(value, below_right)
    for turn in range(rounds):
        if turn % 2:
            right = (right + _random(key, tweak, turn, left, below_right)) % below_right
        else:
            left = (left + _random(key, tweak, turn, right, below_left)) % below_left
    return left * below_right + right


def scramble(text: str, key: bytes, tweak: str, alphabet=alphabet_of) -> str:
    """Another text of the same layout: each letter or digit from its own alphabet, the rest as it is.

    One-to-one among texts of a layout, so distinct texts keep distinct surrogates.
    """
    places = [(i, a) for i, c in enumerate(text) if (a := alphabet(c))]
    if not places:
        return text
    sizes = [len(a) for _, a in places]
    left = right = 1
    for n in sizes[: len(sizes) // 2]:
        left *= n
    for n in sizes[len(sizes) // 2 :]:
        right *= n
    value = 0
    for i, a in places:
        value = value * len(a) + a.index(text[i])
    layout = "".join("?" if alphabet(c) else c for c in text) + "".join(a[0] for _, a in places)
    value = permute(value, left, right, key, f"{tweak}\0{layout}")
    out = list(text)
    for i, a in reversed(places):
        value, digit = divmod(value, len(a))
        out[i] = a[digit]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _walk(value, step, good):
    """The first following image that ``good`` accepts: a permutation of the accepted ones.

    It ends, as ``step`` is one-to-one and ``good`` accepts ``value``, which closes the cycle.
    """
    out = step(value)
    while not good(out):
        out = step(out)
    return out


#: First address and number of addresses of each class that isn't public.
_CLASSES = [(10 << 24, 1 << 24), (100 << 24 | 64 << 16, 1 << 22), (127 << 24, 1 << 24), (192 << 24 | 168 << 16, 1 << 16), (172 << 24 | 16 << 16, 1 << 20), (224 << 24, 1 << 29), (0, 1 << 24), (169 << 24 | 254 << 16, 1 << 16)]


def _address_class(v: int) -> tuple[int, int] | None:
    return next(((low, n) for low, n in _CLASSES if low <= v < low + n), None)


def _permute_ip(ip: str, key: bytes, tweak: str) -> str:
    """Another address of the class: permuted over the class's own range; public ones walk past the classes."""
    a, b, c, d = map(int, ip.split("."))
    v = (a << 24) + (b << 16) + (c << 8) + d
    if found := _address_class(v):
        low, n = found
        right = 1 << (n.bit_length() - 1) // 2
        v = low + permute(v - low, n // right, right, key, f"{tweak}\0{low}")
    else:
        v = _walk(v, lambda x: permute(x, 1 << 16, 1 << 16, key, tweak), lambda x: not _address_class(x))
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


def _mod97(iban: str) -> int:
    """An account number's remainder, with the country and its check digits moved to the end."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _permute_iban(text: str, key: bytes, tweak: str) -> str:
    """Another account of the country and layout, with right check digits if and only if ``text`` has them."""
    head, body = text[:4], text[4:]
    if _mod97(text.replace(" ", "")) == 1:
        body = scramble(body, key, tweak)
        plain = body.replace(" ", "")
        return f"{head[:2]}{98 - _mod97(head[:2] + '00' + plain):02d}{body}"
    return _walk(text, lambda x: x[:2] + scramble(x[2:], key, tweak), lambda x: _mod97(x.replace(" ", "")) != 1)


def units(kind: str, text: str) -> list[tuple[str, str]]:
    """What of an entity is drawn, and drawn again on a collision, as one: a name's surnames, else all of it.

    First names and initials need no second draw: they take places in a cycle of their list.
    """
    if kind != "name":
        return [(kind, text)]
    return [("surname", _plain(w)) for role, w in _parts(text) if role == "surname"]


def _plain(surname: str) -> str:
    """The form that all spellings of a surname share: "SMITH" is "Smith", a curly apostrophe is a straight one."""
    surname = surname.replace("’", "'")
    return re.sub(r"[A-Z]+", lambda m: m[0].capitalize(), surname) if surname.isascii() and surname.isupper() and len(surname) > 1 else surname


@lru_cache(1024)
def _cycle(items: str, key: bytes, tweak: str) -> dict[str, str]:
    """Each of the space-separated items and its successor in a keyed order: one-to-one, none stays itself."""
    order = sorted(items.split(" "), key=lambda x: hashlib.blake2b(f"{tweak}\0{x}".encode(), key=key[:64], digest_size=16).digest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


def draw(kind: str, text: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a unit. Units of a kind and layout are permuted: distinct ones stay distinct.

    From attempt 8 on, surnames and mailboxes get a letter more for every eight attempts, so that
    short layouts can't run out.
    """
    tweak = f"{kind}{attempt}"
    longer = attempt // 8
    if kind == "surname":
        # No surname becomes a listed first name, which would be another name's surrogate.
        return scramble(text + text[-1] * longer, key, tweak) if longer else _walk(text, lambda x: scramble(x, key, tweak), lambda x: x not in _GIVEN or text in _GIVEN)
    if kind == "email":
        name, _, host = text.rpartition("@")
        site, _, top = host.rpartition(".")
        return f"{scramble(name + 'a' * longer, key, tweak + 'name')}@{scramble(site, key, tweak + 'site')}.{top}"
    if kind == "secret":
        body = re.search(r"(?:AKIA|gh[pos]_|sk-)?", text).end()
        hexes = HEX_LOWER if re.fullmatch("[0-9a-f]+", text) else HEX_UPPER if re.fullmatch("[0-9A-F]+", text) else None
        return scramble(text, key, tweak, (lambda c: hexes)) if hexes else text[:body] + scramble(text[body:], key, tweak)
    if kind == "iban":
        return _permute_iban(text, key, tweak)
    if kind in ("mac", "ipv6"):
        hexes = HEX_LOWER if text == text.lower() else HEX_UPPER
        head = 4 if kind == "ipv6" and re.match("(?i)f[cdef]|0*:", text) else 1 if kind == "ipv6" else 0  # local prefixes stay
        return text[:head] + scramble(text[head:], key, tweak + text[:head], lambda c: None if c in ":-" else hexes)
    if kind == "ipv4":
        return _permute_ip(text, key, tweak)
    if kind == "card":
        ok = luhn(re.sub(r"\D", "", text))
        return _walk(text, lambda x: scramble(x, key, tweak), lambda x: luhn(re.sub(r"\D", "", x)) == ok)
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        at = country.end() if country else 0
        return text[:at] + scramble(text[at:], key, tweak)
    return scramble(text, key, tweak)


def surrogate(kind: str, text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> str:
    """The replacement of an entity. The same text always gets the same one.

    In a name the title and particles stay, and each other word is replaced by itself: a listed first
    name by another one of its gender and script, an initial by another letter, a surname by its own
    surrogate. So "Dr Smith", "Anna SMITH", "Anna" and "Smith" of one person stay one person's.
    """
    tries = attempts or {}
    if kind != "name":
        return draw(kind, text, key, tries.get((kind, text), 0))
    out = []
    for role, word in _parts(text):
        if role == "given":
            name = _CAPITALS.get(word, word)
            new = _cycle(" ".join(_GIVEN[name]), key, "first")[name]
            out.append(new if name == word else new.upper())
        elif role == "initial":
            out.append(_cycle(" ".join(alphabet_of(word[0])), key, "initial")[word[0]] + ".")
        elif role == "surname":
            plain = _plain(word)
            new = draw("surname", plain, key, tries.get(("surname", plain), 0))
            new = new.replace("'", "’") if "’" in word else new
            out.append(new.upper() if plain != word.replace("’", "'") else new)
        else:
            out.append(word)
    return " ".join(out)


def unbound(kind: str, text: str) -> bool:
    """Whether a surrogate may also be a real value: an address that isn't public means nothing elsewhere."""
    if kind != "ipv4":
        return False
    a, b, c, d = map(int, text.split("."))
    return _address_class((a << 24) + (b << 16) + (c << 8) + d) is not None


def digest(kind: str, text: str, key: bytes) -> bytes:
    """128 keyed bits that stand for a unit where it is stored."""
    return hashlib.blake2b(f"{kind}\0{text}".encode(), key=key[:64], digest_size=16).digest()


def session_key(spark: SparkSession) -> bytes:
    """The key that the session is set to; without one there are no surrogates."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret: surrogates are made with it")
    return key.encode()


def sample_key(spark: SparkSession) -> bytes:
    """The session's key, or the open one of the sample tables."""
    return session_key(spark) if spark.conf.get(KEY_SETTING, None) else SAMPLE_KEY


ENTITY = "array<struct<start:int,length:int,kind:string,value:string>>"
_ENTITY_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, entities`` of the documents that have any: places in code points, kinds, values.

    For reports; pseudonymise() never stores values. Null and empty texts have none; repeated rows
    and null doc_ids are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            ids, out = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and (spans := find(text)):
                    ids.append(doc_id)
                    out.append([{"start": a, "length": b - a, "kind": k, "value": text[a:b]} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, _ENTITY_TYPE)], ["doc_id", "entities"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(lean(run), f"doc_id long, entities {ENTITY}")


DRAWN = "doc_id long, kind string, value binary, drawn binary, attempt int, free boolean"


def drawn_units(docs: DataFrame, key: bytes, make=draw) -> DataFrame:
    """``doc_id, kind, value, drawn, attempt, free``: digests of the units of each document and of their surrogates.

    A text in ``__tries`` (digests and attempts as JSON) says which units are drawn again; a
    document with that column gives those units alone.
    """
    has = "__tries" in docs.columns
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(["__tries"] if has else []))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            tries = batch.column("__tries").to_pylist() if has else [None] * batch.num_rows
            rows = []
            for doc_id, text, again in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), tries, strict=True):
                wanted = _tries(again)
                found = dict.fromkeys(u for a, b, k in (find(text) if text else ()) for u in units(k, text[a:b]))
                for kind, value in found:
                    own = digest(kind, value, key)
                    if again is None or own in wanted:
                        attempt = wanted.get(own, 0)
                        rows.append((doc_id, kind, own, digest(kind, make(kind, value, key, attempt), key), attempt, unbound(kind, value)))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "kind", "value", "drawn", "attempt", "free"])

    return read.mapInArrow(lean(run), DRAWN)


def _tries(text: str | None) -> dict[bytes, int]:
    """Attempts by digest, from the JSON that the plan carries."""
    return {bytes.fromhex(x["value"]): x["attempt"] for x in json.loads(text)} if text else {}


def _with_tries(docs: DataFrame, where: DataFrame, tries: DataFrame, how: str) -> DataFrame:
    """``docs`` with ``__tries`` of the documents in ``where`` (doc_id, kind, value) that ``tries`` names."""
    lists = where.select("doc_id", "kind", "value").distinct().join(tries.select("kind", "value", "attempt"), ["kind", "value"])
    lists = lists.groupBy(F.col("doc_id").alias("__doc")).agg(F.to_json(F.collect_set(F.struct(F.hex("value").alias("value"), "attempt"))).alias("__tries"))
    return docs.join(lists, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), how).drop("__doc")


def further_attempts(docs: DataFrame, units_of: DataFrame, key: bytes, make=draw, rounds: int = 64) -> DataFrame:
    """``kind, value, attempt``: the units (by digest) whose first surrogates collide.

    A surrogate collides if another unit of its kind has it too (of equals, the least attempt and
    then digest keeps it), or if the corpus has it as a real value. Such units draw again until no
    surrogate collides; only their documents are read for that. Fails, rather than leave a
    collision, if that takes more than ``rounds`` rounds.
    """
    now = materialise(units_of.groupBy("kind", "value").agg(F.first("drawn").alias("drawn"), F.first("free").alias("free")).withColumn("attempt", F.lit(0)), "surrogates")
    real = now.select("kind", F.col("value").alias("drawn"), F.lit(True).alias("real"))
    for _ in range(rounds):
        first = now.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "value")).alias("keeps"), F.count("*").alias("n"))
        judged = now.join(first, ["kind", "drawn"]).join(real, ["kind", "drawn"], "left")
        clash = (F.col("n") > 1) & (F.struct("attempt", "value") != F.col("keeps")) | (F.col("real").isNotNull() & ~F.col("free"))
        again = materialise(judged.where(clash).select("kind", "value", "free", (F.col("attempt") + 1).alias("attempt")), "surrogates")
        if again.limit(1).count() == 0:
            return now.where("attempt > 0").select("kind", "value", "attempt")
        redrawn = drawn_units(_with_tries(docs, units_of, again, "inner"), key, make).groupBy("kind", "value").agg(F.first("drawn").alias("drawn"), F.first("free").alias("free"), F.first("attempt").alias("attempt"))
        now = materialise(now.join(again.select("kind", "value"), ["kind", "value"], "leftanti").unionByName(redrawn), "surrogates")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def pseudonymise(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """All columns of ``docs`` with surrogates in ``text``, and ``entities``: what was replaced.

    ``entities`` has start (in the new text, in code points), length, kind and the surrogate. Equal
    values get equal surrogates everywhere, different ones different ones. The key is the session's
    (KEY_SETTING) unless given. What is stored on the way are keyed digests, never values.

    A null text stays null; a text without entities stays as it is with an empty list. Rows stay
    one to one, repeated ones and null doc_ids too; a table without rows gives none. A column
    named entities is replaced.
    """
    key = key or session_key(docs.sparkSession)
    plain = docs.drop("entities")
    met = materialise(drawn_units(plain, key), "units")
    odd = further_attempts(plain, met, key)
    kept = _with_tries(plain, met, odd, "left") if odd.limit(1).count() else plain.withColumn("__tries", F.lit(None).cast("string"))
    schema = T.StructType([*plain.schema.fields, *T.StructType.fromDDL(f"entities {ENTITY}").fields])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[str, str], str] = worker_cache(("surrogates", key), dict)
        for batch in batches:
            texts, lists = [], []
            for text, again in zip(batch.column("text").to_pylist(), batch.column("__tries").to_pylist(), strict=True):
                spans = find(text) if text else []
                wanted = _tries(again)
                parts, found, at, size = [], [], 0, 0
                for a, b, what in spans:
                    old = text[a:b]
                    if wanted:
                        new = surrogate(what, old, key, {u: wanted.get(digest(*u, key), 0) for u in units(what, old)})
                    elif (new := made.get((what, old))) is None:
                        if len(made) >= 50_000:
                            made.clear()
                        new = surrogate(what, old, key)
                        if len(old) <= 200:
                            made[what, old] = new
                    parts += [text[at:a], new]
                    size += a - at
                    found.append({"start": size, "length": len(new), "kind": what, "value": new})
                    size += len(new)
                    at = b
                texts.append("".join([*parts, text[at:]]) if spans else text)
                lists.append(found)
            names = [n for n in batch.schema.names if n != "__tries"]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, _ENTITY_TYPE)], [*names, "entities"])

    return kept.mapInArrow(lean(run), schema)

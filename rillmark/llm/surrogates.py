"""Personal data: keyed surrogates of the same type and format.

Entities (e-mail, phone, IPv4, card or account number, IBAN, national id, person names after a
title or a known given name) are brought to a canonical value, which a keyed permutation of all
values of that kind and shape replaces; the image is then written in the entity's own format (its
blanks, marks and case).  So one entity has one surrogate however it is written, in every document
and without a table (coreference), and distinct ones stay distinct.  As the step is "the next in
keyed order", no entity is its own surrogate.

Known given names become other given names of their script and gender and known surnames other
surnames, by a permutation of the list; other name words are permuted letter by letter, vowels to
vowels in their own script, keep their last letter (which often carries the gender) and never
become a listed name.  Titles stay.  Card numbers keep their checksum's validity, and IBANs how far
their check digits are from the right ones; phones keep their country code, and a ten-digit one without code is taken as +1.

A grouped count over all replaced entities checks that no two met in one surrogate; if some did,
all are drawn again under the next key derived from the user's.  The key is the user's: there is
no default, and ``session_key`` reads ``spark.rillmark.surrogateKey`` or draws one for the session.

Defined cases: a null text stays null, an empty one empty; text without entities is unchanged;
repeated rows are handled each; an empty table gives no rows; other columns are kept, but for one
named ``pii_entities``, which the result replaces.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from rillmark.llm import storage

KINDS = ("email", "phone", "ip", "iban", "national_id", "card", "person")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles with the gender they state.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "", "Prof": "", "г-н": "m", "г-жа": "f"}
#: Common given names by script and gender, and surnames by script.
GIVEN = {
    ("latin", "f"): "Anna Maria Sophie Emma Laura Julia Clara Helena Marta Lucia Camille Elise Ingrid Johanna Katharina Susan Linda Emily Alice Margaret",
    ("latin", "m"): "Peter Thomas Michael David Robert James Daniel Andreas Stefan Martin Pierre Antoine Carlos Miguel Javier Paolo Henrik William Richard Edward",
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Екатерина Людмила",
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил Владимир Александр",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Δήμητρα",
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης",
}
SURNAMES = {
    "latin": "Smith Jones Brown Taylor Wilson Müller Schmidt Schneider Fischer Weber García Martínez López Fernández Dupont Martin Bernard Rossi Ferrari Hansen",
    "cyrillic": "Иванов Петров Смирнов Кузнецов Попов Соколов Лебедев Козлов",
    "greek": "Παπαδόπουλος Γεωργίου Δημητρίου Νικολάου Βασιλείου Ιωάννου",
}
_LISTS = {f"given {script} {gender}": names.split() for (script, gender), names in GIVEN.items()} | {f"surname {script}": names.split() for script, names in SURNAMES.items()}
#: A word of two lists counts for the first.
LISTED = {word: (label, [w for w in words if next(k for k, v in _LISTS.items() if w in v) == label]) for label, words in reversed(_LISTS.items()) for word in words}
#: The two-digit country codes of telephone numbers; 1 and 7 have one digit, others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][a-zà-öø-ÿа-яёα-ωά-ώ]+"
_PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),  # what comes before is read backwards
    "phone": re.compile(r"(?<![\w+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?!\d)"),
    "ip": re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)", re.ASCII),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.ASCII),
    "card": re.compile(r"(?<![\d.])(?<![0-9a-f][0-9a-f])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?!\d)(?![0-9a-f][0-9a-f])"),
    "person": re.compile(rf"(?<!\w)(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ({_NAME}(?:[ -]{_NAME}){{0,2}})|((?:{'|'.join(w for k, v in _LISTS.items() if k[0] == 'g' for w in v)})(?:[ -]{_NAME}){{1,2}}))(?!\w)"),
}
_LOCAL, _LOCAL_FIRST = re.compile(r"[\w.%+-]*"), re.compile(r"[\w%+]")
#: Sets within which a character is replaced.
_VOWELS = ("aeiou", "AEIOU", "аеиоу", "АЕИОУ", "αεηιο", "ΑΕΗΙΟ", "àáâãäèéêëìíîïòóôõöùúûü", "ÀÁÂÃÄÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ")
_CONSONANTS = ("bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", "бвгджзклмнпрстфхцчшщ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "βγδζθκλμνξπρστφχψ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")
_DIGITS = "0123456789"
PERMUTED = 64
SPOKEN = {c: s for s in (*_VOWELS, *_CONSONANTS, _DIGITS) for c in s}
WRITTEN = {c: s for s in (_VOWELS[0] + _CONSONANTS[0], _VOWELS[1] + _CONSONANTS[1], _VOWELS[2] + _CONSONANTS[2], _VOWELS[3] + _CONSONANTS[3], _VOWELS[4] + _CONSONANTS[4], _VOWELS[5] + _CONSONANTS[5], _VOWELS[6], _VOWELS[7], _DIGITS) for c in s}


class Permutation:
    """Keyed permutation of the integers below ``n``: a Feistel network with cycle walking."""

    def __init__(self, key: bytes, label: str, n: int):
        self.key, self.label, self.n = hashlib.blake2b(label.encode(), key=key[:64], digest_size=32).digest(), label, n
        self.low = 1 << (max(1, (n - 1).bit_length()) + 1) // 2

    def _round(self, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d:%x" % (i, half), key=self.key, digest_size=(self.low.bit_length() + 14) // 8 + 1).digest(), "big") % self.low

    def forward(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.low)
            for i in range(8):
                a, b = b, a ^ self._round(i, b)
            x = a * self.low + b
            if x < self.n:
                return x

    def backward(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.low)
            for i in reversed(range(8)):
                a, b = b ^ self._round(i, a), a
            x = a * self.low + b
            if x < self.n:
                return x

    def successor(self, x: int) -> int:
        """The next in keyed order: a permutation without a fixed point, but for n = 1."""
        return self.backward((self.forward(x) + 1) % self.n)


def permuted(key: bytes, kind: str, text: str, sets: dict[str, str]) -> str:
    """The surrogate among all texts of the same format: each character of a set, within its set.

    A text of more than ``PERMUTED`` characters is replaced in pieces of that size, each by its place.
    """
    if len(text) > PERMUTED:
        return "".join(permuted(key, f"{kind}:{i}", text[i : i + PERMUTED], sets) for i in range(0, len(text), PERMUTED))
    form = "".join(sets[c][0] if c in sets else c for c in text)
    n, x = 1, 0
    for c in text:
        if c in sets:
            n, x = n * len(sets[c]), x * len(sets[c]) + sets[c].index(c)
    if n == 1:
        return text
    x = Permutation(key, f"{kind}:{form}", n).successor(x)
    out = []
    for c in reversed(text):
        if c in sets:
            x, i = divmod(x, len(sets[c]))
            c = sets[c][i]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_check(country: str, body: str) -> int:
    """The check digits that belong to a country and an account."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97


def canonical(kind: str, text: str) -> str:
    """The value that all writings of an entity share."""
    if kind == "email":
        return "".join(low if len(low := c.lower()) == 1 else c for c in text)
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        return f"+{digits}" if text.startswith("+") else f"+1{digits}"
    if kind in ("card", "national_id"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    return text


def name_word(word: str, key: bytes) -> str:
    """Another name of the same list, or an unlisted one of the same shape."""
    if word in LISTED:
        label, words = LISTED[word]
        return words[Permutation(key, label, len(words)).successor(words.index(word))]
    out = word
    while True:
        out = permuted(key, f"person{word[-1]}", out[:-1], SPOKEN) + word[-1]
        if out not in LISTED:
            return out


def image(kind: str, value: str, key: bytes) -> str:
    """The canonical value that replaces a canonical value."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2] == "example" else 1  # reserved domains stay reserved
        return f"{permuted(key, 'local@' + domain, local, WRITTEN)}@{'.'.join([*(permuted(key, 'label', x, WRITTEN) for x in labels[:-keep]), *labels[-keep:]])}"
    if kind == "phone":
        cut = 2 if value[1:2] in ("1", "7") else 3 if value[1:3] in TWO_DIGIT_CODES else 4
        return value[:cut] + permuted(key, f"phone{value[:cut]}", value[cut:], SPOKEN)
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, Permutation(key, kind, 1 << 32).successor(x).to_bytes(4, "big")))
    if kind == "iban":
        letters = {c: s for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _DIGITS) for c in s}
        body = permuted(key, f"iban{value[:2]}", value[4:], letters)
        off = int(value[2:4]) - iban_check(value[:2], value[4:])
        return f"{value[:2]}{(iban_check(value[:2], body) + off) % 100:02d}{body}"
    if kind == "card":
        valid, out = luhn(value), value
        while True:
            out = permuted(key, kind, out, SPOKEN)
            if luhn(out) == valid:
                return out
    if kind == "person":
        return "".join(name_word(w, key) if w not in " -" else w for w in re.split("([ -])", value))
    return permuted(key, kind, value, SPOKEN)


def written(kind: str, text: str, value: str) -> str:
    """``value`` in the writing of ``text``: its blanks, marks and case."""
    if kind == "email":
        return "".join(up if t.isupper() and len(up := c.upper()) == 1 else c for t, c in zip(text, value, strict=True))
    if kind == "phone":
        digits = iter(value[1:] if text.startswith("+") else value[2:])
    elif kind in ("card", "national_id", "iban"):
        digits = iter(value)
    else:
        return value
    return "".join(next(digits) if t.isalnum() else t for t in text)


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement for one entity."""
    return written(kind, text, image(kind, canonical(kind, text), key))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of e-mail addresses: from each @ forwards and backwards, never beyond the one before."""
    last = 0
    for m in _PATTERNS["email"].finditer(text):
        begin = max(last, text.rfind("@", 0, m.start()) + 1)
        run = _LOCAL.match(text[begin : m.start()][::-1]).end()
        if run and text[m.start() - 1] != "." and (first := _LOCAL_FIRST.search(text, m.start() - run, m.start())):
            yield first.start(), m.end()
            last = m.end()


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of entities, none overlapping; kinds listed first go first."""
    digits = any(map(text.__contains__, _DIGITS))
    out: list[tuple[int, int, str]] = []
    for kind, pattern in _PATTERNS.items():
        if kind == "email" and "@" not in text or kind not in ("email", "person") and not digits:
            continue
        found = []
        spans = emails(text) if kind == "email" else (m.span(m.lastindex or 0) for m in pattern.finditer(text))
        for s, e in spans:
            i = bisect_left(out, (s,))
            if (i == 0 or out[i - 1][1] <= s) and (i == len(out) or e <= out[i][0]):
                found.append((s, e, kind))
        out = sorted(out + found)
    return out


def replaced(text: str | None, key: bytes, known: dict | None = None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, keyed digest of the entity, its image) of each."""
    if not text or not (spans := find(text)):
        return text, []
    known = {} if known is None else known
    out, at, entities = [], 0, []
    for s, e, kind in spans:
        own = (kind, canonical(kind, text[s:e]))
        if own not in known:
            if len(known) > 100_000:
                known.clear()
            known[own] = image(*own, key), hashlib.blake2b(own[1].encode("utf-8", "replace"), key=key[:64], digest_size=16).hexdigest()
        out += [text[at:s], written(kind, text[s:e], known[own][0])]
        entities.append((kind, known[own][1], known[own][0]))
        at = e
    return "".join([*out, text[at:]]), entities


def session_key(spark: SparkSession) -> bytes:
    """``spark.rillmark.surrogateKey`` (any text); where it is unset, a random one for this session."""
    name = "spark.rillmark.surrogateKey"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return hashlib.blake2b(spark.conf.get(name).encode()).digest()


ENTITIES = ArrayType(StructType([StructField(n, StringType()) for n in ("kind", "entity", "surrogate")]))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, and ``pii_entities`` (replacing one so named)."""
    storage.small_batches(docs.sparkSession)
    docs = docs.withColumn(text, F.col(text).cast("string")).drop("pii_entities")
    schema = StructType([*docs.schema.fields, StructField("pii_entities", ENTITIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "entity", "surrogate")]))
        for batch in batches:
            done = [replaced(t, key, known) for t in batch.column(text).to_pylist()]
            entities = [[dict(zip(("kind", "entity", "surrogate"), x, strict=True)) for x in e] for _, e in done]
            columns = [pa.array([t for t, _ in done], pa.string()) if n == text else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(entities, kind)], [*batch.schema.names, "pii_entities"])

    return docs.mapInArrow(run, schema)


def check_distinct(rewritten: DataFrame) -> DataFrame:
    """Rows (kind, surrogate, entities) where several entities share a surrogate; empty if all is well."""
    one = rewritten.select(F.explode("pii_entities").alias("e")).select("e.kind", "e.entity", "e.surrogate")
    return one.distinct().groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


def checked(docs: DataFrame, key: bytes, tries: int = 3) -> DataFrame:
    """``pseudonymise`` written out and checked; where two entities met in one surrogate, again with the next key."""
    spark = docs.sparkSession
    for i in range(tries):
        path = storage.new_path(spark, "surrogates")
        out = storage.write_table(pseudonymise(docs, hashlib.blake2b(b"%d" % i, key=key[:64]).digest()), path)
        if check_distinct(out).isEmpty():
            return out
        storage.drop_table(spark, path)
    raise ValueError("two entities share a surrogate")


def pseudonymised_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_entities and the count of each kind, for every row."""
    out = checked(docs.select("doc_id", "text"), key)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return out.select("doc_id", "text", F.size("pii_entities").cast("long").alias("n_entities"), *counts)

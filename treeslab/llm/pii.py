"""PII surrogates: keyed, format-preserving replacements, in SQL functions only.

Entities (e-mail addresses, phone numbers, card numbers, IP addresses, access keys, passwords,
tokens, names with a title or a listed given name) are found by one pattern; then the family names of the persons found in a text are
found wherever else they stand in it. Each is replaced by a surrogate of its own type:

- a name keeps its title and script; a given name becomes another of the same gender and script, a family name letters of the same case and script
- an e-mail address keeps its last domain and its form; the words of its local part take the surrogates of the names they spell, so john.smith@.. goes with John Smith
- a phone number keeps its country code; its digits don't depend on how they are grouped
- a card keeps its issuer's six digits, and its check digit holds if it held before
- an IP address keeps its first octet (two, where ranges of special use are cut finer), so a private one stays private
- a social security number stays within the numbers that can be given
- in all others letters become letters of the same case and script, digits become digits, and punctuation stays

The text is cut at the entities and put together again, so everything else stays byte for byte.

A surrogate is a keyed permutation of the strings of one format: two rounds of shifts, forwards and backwards over the
characters, each by a keyed hash of what was put out before; then every character moves on by one in its alphabet, and the rounds are undone.
A permutation never gives two entities one surrogate, and one that is
conjugate to a move by one gives no entity itself. The same entity always has the same one, in every document, without a table of all entities.
The words in front of a name decide nothing, so a person is the same with a title or without.
``collisions`` checks distinctness over all entities of a corpus; ``checked`` raises if there is one, and both the query and the pipeline call it.

Who has the key can turn surrogates back, so there is none by default; see ``key_of``.

Defined cases: a null text stays null, an empty one empty. Entities are replaced wherever they stand, in repeated rows
alike, in texts of any length. Of two entities that overlap the first is taken, of two at one place the first type. Extra columns stay. Characters in
no listed alphabet stay. An unlisted given name without a title isn't found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeslab.llm.shared import every_column

#: Types and patterns, in the order they are tried at a place. (Fixed values.)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"(?=A)\bAKIA[0-9A-Z]{16}\b",
    "password": r"(?=[Pp])\b(?i:password|passwd|pwd)\s*[=:]\s*[^\s\"']+",
    "token": r"(?=[TtSsAa])\b(?i:token|secret|api_key|apikey)\s*[=:]\s*\"[^\"\s]+\"",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?=\d)(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[+(])(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?=\+)(?<![\d+])\+(?=(?:[ .()-]{0,2}\d){7,15}(?!\d))\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){1,7}(?!\d)"
    r"|(?=\+)(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
}
#: Country codes of phone numbers. (Fixed values, as a rule: one digit, the codes of two, else three.)
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d{1,2}(?!\d))"
#: Given names by gender and script; one of a list is replaced by another of the same list. (Fixed values.)
MALE = ["Adam", "Carl", "David", "Felix", "Henry", "Ivan", "James", "John", "Luis", "Marc", "Oscar", "Paul", "Peter", "Robert", "Thomas", "Victor", "Andrew", "Antonio", "Charles", "Daniel", "Edward", "Ernst", "Francisco", "Friedrich", "George", "Giovanni", "Heinrich", "Joseph", "Juan", "Lukas", "Manuel", "Matthew", "Michael", "Miguel", "Patrick", "Pierre", "Richard", "Samuel", "Stefan", "William"]
FEMALE = ["Alice", "Anna", "Carla", "Diana", "Elena", "Emma", "Helen", "Julia", "Laura", "Lucia", "Maria", "Mary", "Nina", "Olga", "Rosa", "Sarah", "Amelia", "Barbara", "Beatrice", "Carmen", "Catherine", "Charlotte", "Christine", "Claudia", "Elizabeth", "Emily", "Franziska", "Gabriela", "Hannah", "Isabel", "Jennifer", "Linda", "Margaret", "Monika", "Patricia", "Rebecca", "Sabine", "Sophie", "Susanne", "Victoria"]
MALE_CYRILLIC = ["Александр", "Алексей", "Андрей", "Борис", "Виктор", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Пётр", "Сергей", "Степан", "Юрий"]
FEMALE_CYRILLIC = ["Анастасия", "Анна", "Вера", "Галина", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Наталья", "Ольга", "Светлана", "София", "Татьяна", "Юлия"]
MALE_GREEK = ["Αλέξανδρος", "Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Παύλος", "Πέτρος"]
FEMALE_GREEK = ["Αικατερίνη", "Άννα", "Βασιλική", "Γεωργία", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία"]
GIVEN = [MALE, FEMALE, MALE_CYRILLIC, FEMALE_CYRILLIC, MALE_GREEK, FEMALE_GREEK]
_EVERY = [x for names in GIVEN for x in names]
_TITLES = "Mr|Mrs|Ms|Herr|Frau|Señor|Señora|Monsieur|Madame"
_NAME = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)?"
PATTERNS["person"] = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|(?:{'|'.join(_EVERY)}) {_NAME})(?!\p{{L}})"
#: What every text with an entity holds; other texts are left alone after one cheap scan.
TRIGGER = rf"[0-9@=:]|AKIA|(?=\p{{Lu}})(?:{_TITLES}|{'|'.join(_EVERY)})[. ]"
ANY = "|".join(f"(?:{x})" for x in PATTERNS.values())
#: Letters that are shifted within their own row. (Fixed values.)
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß", "ÀÂÄÁÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÕØŒÙÚÛÜÝŸ", "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ", "αβγδεζηθικλμνξοπρστυφχψως", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "άέήίόύώϊϋ", "ΆΈΉΊΌΎΏ"]
#: Walks past listed names at most, for a family name; the chance of needing more is below 1e-20.
WALKS = 8


def key_of(spark: SparkSession) -> str | None:
    """The key in the session's setting spark.treeslab.pii.key; it belongs to the caller, and is none of the code."""
    return spark.conf.get("spark.treeslab.pii.key", None)


def kind(entity: Column) -> Column:
    """The type of an entity: the first pattern that fits it whole; family for a name alone."""
    out = F.when(entity.rlike(f"^{_NAME}$"), F.lit("family"))
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _hashed(key: Column, done: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(key, done), 256), 1, 8), 16, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{x}'" for x in values) + ")")


#: All alphabets in a row, the row of each letter as A, B, .., and the rows' starts and sizes.
_LETTERS, _ROWS = "".join(ALPHABETS), "".join(chr(65 + k) * len(row) for k, row in enumerate(ALPHABETS))
_STARTS, _SIZES = [len("".join(ALPHABETS[:k])) for k in range(len(ALPHABETS))], [len(row) for row in ALPHABETS]


def _shifted(c: Column, by: Column) -> Column:
    """A character moved along its own alphabet; others as they are."""
    row = F.ascii(F.translate(c, _LETTERS, _ROWS)) - 65
    start, size = (F.get(F.expr(f"array({', '.join(map(str, x))})"), row) for x in (_STARTS, _SIZES))
    moved = F.substring(F.lit(_LETTERS), (start + F.pmod(F.instr(F.lit(_LETTERS), c) - 1 - start + by, size) + 1).cast("int"), F.lit(1))
    return F.when((c != "") & (F.instr(F.lit(_LETTERS), c) > 0), moved).otherwise(c)


def _round(text: Column, key: Column) -> Column:
    """Shift each character by a keyed hash of all characters put out before it."""
    return F.aggregate(F.split(text, ""), F.lit(""), lambda done, c: F.concat(done, _shifted(c, _hashed(key, done))))


def _undone(text: Column, key: Column) -> Column:
    """What _round made a text of."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _shifted(c, -_hashed(key, F.substring(text, F.lit(1), i)))), "")


def _scrambled(text: Column, key: Column) -> Column:
    """The permutation: two rounds, every character moved on by one, the rounds undone. None of a format's strings stays."""
    one, two = F.concat(key, F.lit("/1/")), F.concat(key, F.lit("/2/"))
    there = F.reverse(_round(F.reverse(_round(text, one)), two))
    moved = F.translate(there, _LETTERS, "".join(row[1:] + row[0] for row in ALPHABETS))
    return _let(F.reverse(moved), lambda x: _let(F.reverse(_undone(x, two)), lambda y: _undone(y, one)))


def _numbers(values: Column, sizes: Column, key: Column) -> Column:
    """The same permutation of lists of numbers, each below its size; a number of size 1 stays."""
    one, two = F.concat(key, F.lit("/n1/")), F.concat(key, F.lit("/n2/"))

    def chained(values: Column, sizes: Column, salt: Column) -> Column:
        step = lambda done, x: F.concat(done, F.array(F.pmod(x["v"] + _hashed(salt, F.array_join(done.cast("array<string>"), ".")), x["m"])))
        return F.aggregate(F.zip_with(values, sizes, lambda v, m: F.struct(v.cast("long").alias("v"), m.cast("long").alias("m"))), F.array().cast("array<bigint>"), step)

    def back(values: Column, sizes: Column, salt: Column) -> Column:
        before = lambda values, i: F.array_join(F.slice(values, F.lit(1), i).cast("array<string>"), ".")
        return _let(values, lambda x: F.transform(x, lambda v, i: F.pmod(v - _hashed(salt, before(x, i)), F.get(sizes, i).cast("long"))))

    turned = F.reverse(sizes)
    there = chained(F.reverse(chained(values, sizes, one)), turned, two)
    moved = F.zip_with(there, turned, lambda v, m: F.pmod(v + 1, m.cast("long")))
    return back(F.reverse(back(moved, turned, two)), sizes, one)


def _number_parts(entity: Column, what: Column, key: str) -> Column:
    """Surrogates of IP addresses and social security numbers.

    The first octets of an address stay; the others move within 0..255, or within 00..09. Areas but 000, 666 and 9xx, groups but 00 and serials
    but 0000 move among themselves; others stay.
    """
    parts = F.split(entity, r"[.-]")
    kept = F.when(what == "ssn", 0).when(F.get(parts, F.lit(0)).isin("100", "169", "172", "192"), 2).otherwise(1)
    rest = F.slice(parts, kept + 1, F.lit(4))
    area, group, serial = (F.get(parts, F.lit(k)).cast("int") for k in range(3))
    given = (area > 0) & (area != 666) & (area < 900)
    ssn = F.array(F.when(given, area - F.when(area > 666, 2).otherwise(1)).otherwise(0), F.greatest(group - 1, F.lit(0)), F.greatest(serial - 1, F.lit(0)))
    sizes = F.array(F.when(given, 898).otherwise(1), F.when(group > 0, 99).otherwise(1), F.when(serial > 0, 9999).otherwise(1))
    values = F.when(what == "ssn", ssn.cast("array<bigint>")).otherwise(F.transform(rest, lambda c: c.cast("long")))
    sizes = F.when(what == "ssn", sizes.cast("array<bigint>")).otherwise(F.transform(rest, lambda c: F.when(c.rlike("^0."), 10).otherwise(256).cast("long")))

    def put(moved: Column) -> Column:
        at = lambda k: F.get(moved, F.lit(k))
        number = F.concat_ws(
            "-",
            F.when(given, F.lpad((at(0) + F.when(at(0) >= 665, 2).otherwise(1)).cast("string"), 3, "0")).otherwise(F.get(parts, F.lit(0))),
            F.when(group > 0, F.lpad((at(1) + 1).cast("string"), 2, "0")).otherwise(F.lit("00")),
            F.when(serial > 0, F.lpad((at(2) + 1).cast("string"), 4, "0")).otherwise(F.lit("0000")),
        )
        octets = F.zip_with(rest, moved, lambda c, v: F.concat(F.when(c.rlike("^0."), "0").otherwise(""), v.cast("string")))
        return F.when(what == "ssn", number).otherwise(F.array_join(F.concat(F.slice(parts, F.lit(1), kept), octets), "."))

    return _let(_numbers(values, sizes, F.concat(F.lit(key + "/"), what)), put)


def _refilled(form: Column, digits: Column) -> Column:
    """A text with its digits replaced one after another."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    step = lambda x, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(x["out"], F.substring(digits, x["k"] + 1, F.lit(1))).alias("out"), (x["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(x["out"], c).alias("out"), x["k"].alias("k")))
    return F.aggregate(F.split(form, ""), start, step)["out"]


def _check_digit(digits: Column) -> Column:
    """The check digit that makes 15 digits a card number."""
    doubled = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda x, y: x + y), F.lit(10))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(entity: Column, middle: Column) -> Column:
    """A card number with other middle digits, whose check digit is as right or wrong as it was."""
    digits = _digits(entity)
    off = F.substring(digits, 16, 1).cast("int") - _check_digit(F.substring(digits, 1, 15))
    return _let(F.concat(F.substring(digits, 1, 6), middle), lambda fresh: _refilled(entity, F.concat(fresh, F.pmod(_check_digit(fresh) + off, F.lit(10)).cast("string"))))


def _parts(entity: Column, what: Column) -> Column:
    """An entity as parts (how, text, form, salt): what stays (keep), and texts that are permuted under a salt and put in a form.

    name: a name, whose form has its own case. digits, card: digits, for the form's.
    """
    none = F.lit(None).cast("string")
    part = lambda how, text, form=none, salt="": F.struct(F.lit(how).alias("how"), text.alias("text"), form.alias("form"), F.lit(salt).alias("salt"))
    after = lambda head: F.substr(entity, F.length(head) + 1)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    last = F.regexp_extract(domain, r"\.[A-Za-z]{2,}$", 0)
    name = lambda t: F.when(t.rlike("^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$"), part("name", F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2)))), t, "/name")).otherwise(part("plain", t, salt="/local"))
    email = F.concat(
        F.transform(F.regexp_extract_all(local, F.lit("([A-Za-z]+|[0-9]+|[^A-Za-z0-9]+)"), F.lit(1)), name),
        F.array(part("keep", F.lit("@")), part("plain", F.substr(domain, F.lit(1), F.length(domain) - F.length(last)), salt="/domain"), part("keep", last)),
    )
    title = F.regexp_extract(entity, rf"^(?:(?:{_TITLES})\.? )?", 0)
    word = lambda n: F.when(n == " ", part("keep", n)).otherwise(part("name", n, n, "/name"))
    person = F.concat(F.array(part("keep", title)), F.transform(F.regexp_extract_all(after(title), F.lit("( |[^ ]+)"), F.lit(1)), word))
    code = F.regexp_extract(entity, rf"^(?:\+{COUNTRY})?", 0)
    phone = F.array(part("keep", code), part("digits", _digits(after(code)), after(code), "/phone"))
    card = F.array(part("card", F.substring(_digits(entity), 7, 9), entity, "/card"))
    fixed = F.when(what == "access_key", F.lit("AKIA")).otherwise(F.regexp_extract(entity, r"^[A-Za-z_]+\s*[=:]\s*\"?", 0))
    other = F.array(part("keep", fixed), part("plain", after(fixed)))
    return F.when(what == "email", email).when(what.isin("person", "family"), person).when(what == "phone", phone).when(what == "card", card).otherwise(other)


def _permuted(part: Column, key: str) -> Column:
    """A part's surrogate. A given name moves within its list by a keyed step; any other name is scrambled until it is no listed one."""
    listed = lambda x: F.array_contains(_strings(_EVERY), x)
    own = F.concat(F.lit(key), part["salt"])
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), part["text"], lambda x, k: F.when((k == 0) | (part["how"] == "name") & listed(x), _scrambled(x, own)).otherwise(x))
    lost = F.raise_error(F.lit("a name found no surrogate of its own: take another key")).cast("string")

    def put(x: Column) -> Column:
        name = F.when((listed(x) | (x == part["text"])) & x.rlike("[A-Za-z]"), lost).otherwise(x)
        for names in GIVEN:
            step = int(hashlib.sha256((key + "/given/" + names[0]).encode()).hexdigest()[:8], 16) % (len(names) - 1) + 1
            at = F.array_position(_strings(names), part["text"])
            name = F.when(at > 0, F.get(_strings(names[step:] + names[:step]), (at - 1).cast("int"))).otherwise(name)
        form = part["form"]
        cased = _let(name, lambda y: F.when(form.rlike("^[a-z]+$"), F.lower(y)).when(form.rlike("^[A-Z]+$"), F.upper(y)).otherwise(y))
        return F.when(part["how"] == "name", cased).when(part["how"] == "digits", _refilled(form, x)).when(part["how"] == "card", _card(form, x)).otherwise(x)

    return F.when(part["how"] == "keep", part["text"]).otherwise(_let(walk, put))


def surrogate(entity: Column, key: str) -> Column:
    """The surrogate of an entity."""

    def made(what: Column) -> Column:
        by_parts = F.array_join(F.transform(_parts(entity, what), lambda p: _permuted(p, key)), "")
        return F.when(what.isin("ip", "ssn"), _number_parts(entity, what, key)).otherwise(by_parts)

    return _let(kind(entity), made)


def _families(found: Column) -> Column:
    """The family names of the persons among entities: the last word of each."""
    persons = F.filter(found, lambda e: e.rlike(f"^(?:{PATTERNS['person']})$"))
    return F.array_distinct(F.transform(persons, lambda e: F.substring_index(e, " ", -1)))


def _pattern(text: Column) -> Column:
    """The pattern of a text's entities: the common one, and the family names of its persons."""
    names = _families(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    alone = F.concat(F.lit(r"|(?=\p{Lu})(?<!\p{L})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
    return F.concat(F.lit(ANY), F.when(F.size(names) > 0, alone).otherwise(""))


def entities(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.regexp_extract_all(text, F.concat(F.lit("("), _pattern(text), F.lit(")")), F.lit(1))


def replaced(text: Column, key: str) -> Column:
    """The text with every entity replaced."""

    def cut(pattern: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1)), lambda e: surrogate(e, key))
        return F.concat_ws("", F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))))

    whole = _let(_pattern(text), cut)
    return F.when(text.rlike(TRIGGER), F.when(text.rlike(ANY), whole).otherwise(text)).otherwise(text)


def mask(docs: DataFrame, key: str) -> DataFrame:
    """docs with the entities in text replaced. No shuffle, no join."""
    return docs.select([replaced(c.cast("string"), key).alias("text") if name == "text" else c for name, c in every_column(docs)])


def _text(docs: DataFrame) -> Column:
    return F.col("text").cast("string")


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """(kind, replacement, n): surrogates that stand for several entities of a type, over all of docs, or for themselves (n = 1).

    Entities are made distinct before the shuffle, so a common entity costs a row a task.
    """
    text = _text(docs)
    found = docs.where(text.rlike(TRIGGER)).select(F.explode(entities(text)).alias("entity")).distinct()
    pairs = found.select(kind(F.col("entity")).alias("kind"), "entity", surrogate(F.col("entity"), key).alias("replacement"))
    sums = pairs.groupBy("kind", "replacement").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("entity") == F.col("replacement")).alias("same"))
    return sums.where((F.col("n") > 1) | F.col("same") & F.col("replacement").rlike("[1-9A-Za-z]")).select("kind", "replacement", "n")


def checked(docs: DataFrame, key: str) -> DataFrame:
    """docs, if no two of their entities share a surrogate under the key, and none is its own; else ValueError names the types."""
    bad = collisions(docs, key).groupBy("kind").agg(F.sum("n").alias("n")).collect()  # a row for each type
    if bad:
        raise ValueError(f"surrogates are not distinct: {sorted((r.kind, r.n) for r in bad)}")
    return docs


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, the number of entities, and their types in order, for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(docs).alias("text"))
    found = F.when(F.col("text").rlike(TRIGGER), F.when(F.col("text").rlike(ANY), entities(F.col("text")))).otherwise(F.array().cast("array<string>"))
    found = F.coalesce(found, F.array().cast("array<string>"))
    return rows.select("doc_id", replaced(F.col("text"), key).alias("text"), F.size(found).cast("long").alias("n_entities"), F.transform(found, kind).alias("kinds"))

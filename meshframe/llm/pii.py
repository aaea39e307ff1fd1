"""PII surrogates: detected entities get keyed replacements of the same type, by DataFrame functions only.

* *Detection*: one regular expression of named kinds.
* *Surrogates* come from SHA-256 of a secret key, the kind, the canonical value and an attempt number: phone and
  card numbers keep their length and punctuation (cards their first digit and a valid check digit), addresses
  their number and class of characters under a reserved domain, IPv4 addresses move to the reserved class E, IPv6
  addresses to the documentation prefix, account numbers (IBAN) keep country and shape with valid check digits, social
  security numbers move to the area 9xx, which is never given out, secrets keep prefix and alphabet, names keep gender, script and letter case.
* *Coreference*: canonical values (digits only, lower case, name part by name part) make all spellings of one
  entity get one surrogate, in every document.
* *Distinctness*: surrogates are checked against each other and against the originals of the corpus; whoever
  loses is drawn anew with the next attempt until no collision is left. Where a shape has few values, they grow with
  the attempt: surnames get further syllables, addresses one more host label, secrets letters for signs. Given names
  are detected by a list and mapped one to one to another list of the same script and gender, in an order that the
  key decides.

The pattern runs over each text once: what it finds is marked in the text, and the marked texts are written, so that
finding and replacing read the same marks. Equal texts are replaced once. Only rows with an entity are shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .rules import let

#: Given names by script and gender, and syllables of surrogate surnames.
GIVEN = {
    ("latin", "f"): ["Anna", "Maria", "Laura", "Julia", "Sarah", "Emma", "Claire", "Sophie", "Elena", "Carmen", "Ingrid", "Paula", "Marta", "Alice", "Emily", "Nora"],
    ("latin", "m"): ["John", "Peter", "Thomas", "Michael", "David", "Carlos", "Pierre", "Hans", "Jorge", "Martin", "Stefan", "Louis", "Robert", "Daniel", "Henry", "Oscar"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Татьяна", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Николай", "Андрей", "Михаил"],
}
#: The given names that replace them, as many of each script and gender, all others.
STAND_INS = {
    ("latin", "f"): ["Amelia", "Beatrice", "Diana", "Estelle", "Frieda", "Greta", "Helena", "Irma", "Judith", "Karla", "Lydia", "Miriam", "Olivia", "Renata", "Silvia", "Vera"],
    ("latin", "m"): ["Albert", "Bruno", "Conrad", "Dennis", "Edgar", "Felix", "Gustav", "Hugo", "Ivan", "Julian", "Karl", "Leonard", "Marcus", "Norman", "Oliver", "Victor"],
    ("cyrillic", "f"): ["Вера", "Галина", "Дарья", "Евгения", "Лидия", "Нина", "Полина", "Софья"],
    ("cyrillic", "m"): ["Борис", "Виктор", "Григорий", "Евгений", "Игорь", "Константин", "Леонид", "Павел"],
}
SYLLABLES = {
    "latin": ["bel", "cor", "dan", "fal", "gar", "hol", "kem", "lin", "mar", "nor", "pel", "ros", "sal", "tor", "ven", "wel"],
    "cyrillic": ["бел", "вор", "гал", "дон", "зим", "кар", "лес", "мор", "нов", "пет", "рос", "сол", "тих", "фед", "хол", "чер"],
    "greek": ["αλ", "βεν", "γαρ", "δελ", "ζαν", "θεο", "καρ", "λαμ", "μαν", "νικ", "παλ", "ραν", "σαρ", "ταν", "φιλ", "χρι"],
}
#: Titles that, before a capitalised word, mark it as a surname.
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Mme", "Sr.", "Sra."]


def _any(words: list[str]) -> str:
    return "|".join(w.replace(".", "\\.") for w in words)


_ALL_GIVEN = [n for names in GIVEN.values() for n in names]
_CAPITAL = "\\p{Lu}\\p{L}+(?:-\\p{Lu}\\p{L}+)?"
#: Names in capitals throughout: the surname, too, must have capitals only.
_CAPITALS = "\\p{Lu}{2,}(?:-\\p{Lu}{2,})?"


def _names(given: list[str], titles: list[str], surname: str) -> str:
    return f"(?:{_any(titles)}) (?:(?:{_any(given)}) )?{surname}|(?:{_any(given)}) {surname}"


def _upper(words: list[str]) -> list[str]:
    return [w.upper() for w in words]


#: Kinds in order of precedence, as Java patterns.
KINDS = {
    "email": "(?<![\\p{L}0-9._%+-])[._%+-]*+[\\p{L}0-9][\\p{L}0-9._%+-]*+@[\\p{L}0-9-][\\p{L}0-9.-]*\\.\\p{L}{2,}",
    "ip": "(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\\.[0-9])",
    "ipv6": "(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "hex": "(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])",
    "secret": "(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}+)(?![0-9A-Za-z])",
    "iban": "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,4})?)(?![0-9A-Za-z])",
    "ssn": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": "(?<![0-9A-Za-z+])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9A-Za-z])",
    "phone": "(?<![0-9A-Za-z])(?:\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\\([0-9]{3}\\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{4}|[0-9]{3}\\.[0-9]{3}\\.[0-9]{4})(?![0-9A-Za-z])",
    "name": f"(?<!\\p{{L}})(?=\\p{{Lu}})(?:{_names(_ALL_GIVEN, TITLES, _CAPITAL)}|{_names(_upper(_ALL_GIVEN), _upper(TITLES), _CAPITALS)})(?!\\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Signs before an address, which aren't part of it, and the ending that a surname has in the feminine.
LEADING, FEMININE = "^[._%+-]+", "(?<=(?:ов|ев|ёв|ин))а$"


#: Signs that no text should hold (noncharacters): MARK stands at both ends of an entity; where a text does hold one,
#: QUOTE and a letter stand for it.
MARK, QUOTE = "\ufdd0", "\ufdd1"


def marked(text: Column) -> Column:
    """The text with marks around every detected entity: split at MARK, entities have the odd places."""
    quoted = F.when(text.rlike(f"[{MARK}{QUOTE}]"), F.replace(F.replace(text, F.lit(QUOTE), F.lit(QUOTE + "q")), F.lit(MARK), F.lit(QUOTE + "m"))).otherwise(text)
    return F.regexp_replace(quoted, PATTERN, f"{MARK}$0{MARK}")


def unquoted(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(QUOTE + "m"), F.lit(MARK)), F.lit(QUOTE + "q"), F.lit(QUOTE))


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _script(word: Column) -> Column:
    """Other scripts than these three count as Latin."""
    return F.when(word.rlike("\\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike("\\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def parts_of(entity: Column, kind: Column) -> Column:
    """The parts of an entity that get surrogates of their own: array of (kind, canonical value, text)."""

    def part(k: Column, canon: Column, text: Column) -> Column:
        return F.struct(k.alias("kind"), canon.alias("canon"), text.alias("text"))

    def name_part(word: Column) -> Column:
        k = F.when(word.isin(TITLES + _upper(TITLES)), F.lit("title"))
        for (script, gender), names in GIVEN.items():
            k = k.when(word.isin(names + _upper(names)), F.lit(f"given:{script}:{gender}"))
        is_given = word.isin(_ALL_GIVEN + _upper(_ALL_GIVEN) + TITLES + _upper(TITLES))
        # both forms of a surname with gender are one
        one = F.regexp_replace(F.regexp_replace(F.lower(word), FEMININE, ""), "ск(?:ая|ий)$", "ск")
        return part(k.otherwise(F.concat(F.lit("surname:"), _script(word))), F.when(is_given, F.lower(word)).otherwise(one), word)

    canon = (
        F.when(kind.isin("phone", "card", "ssn"), _digits(entity))
        .when(kind == "email", F.regexp_replace(F.lower(entity), LEADING, ""))
        .when(kind.isin("hex", "ipv6"), F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .otherwise(entity)
    )
    return F.when(kind == "name", F.transform(F.split(entity, " "), name_part)).otherwise(F.array(part(kind, canon, entity)))


def _stream(secret: str, kind: Column, canon: Column, attempt: Column, n: Column) -> Column:
    """At least ``n`` keyed pseudorandom numbers of 16 bits."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(secret), kind, canon, attempt.cast("string")), 256)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), lambda i: F.sha2(F.concat_ws("\x1f", F.lit(secret), seed, i.cast("string")), 256))
    text = F.array_join(blocks, "")
    return let(text, lambda t: F.transform(F.sequence(F.lit(0), (F.length(t) / 4).cast("int") - 1), lambda i: F.conv(F.substring(t, (i * 4 + 1).cast("int"), 4), 16, 10).cast("int")))


def _shuffled(names: list[str], secret: str) -> list[str]:
    return sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{secret}\x1f{n}".encode()).digest())


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))) + 1)


def _joined(values: list[str], numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: _pick(values, x)), "")


_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def _alike(text: Column, numbers: Column, hexadecimal: bool = False, signs: Column | None = None) -> Column:
    """Each digit or letter replaced by another of its class; signs stay, but become letters where ``signs`` holds."""

    def char(c: Column, i: Column) -> Column:
        r = F.element_at(numbers, i + 1)
        if hexadecimal:
            return F.substring(F.lit("0123456789abcdef"), F.pmod(r, F.lit(16)) + 1, 1)
        digits, lower, upper = (F.substring(F.lit(x), F.pmod(r, F.lit(len(x))) + 1, 1) for x in _CLASSES)
        out = F.when(c.rlike("[0-9]"), digits).when(c.rlike("\\p{Lu}"), upper).when(c.rlike("\\p{L}"), lower)
        return (out if signs is None else out.when(signs & (c != ""), lower)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def _check_digit(number: Column) -> Column:
    """The digit that makes a number valid by the Luhn rule."""
    n = F.length(number)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(number, i, 1).cast("int"), lambda d: F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)))
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + d)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _iban(canon: Column, numbers: Column) -> Column:
    """Another account of the same country and shape, with valid check digits."""
    account = F.substring(_alike(canon, numbers), F.lit(5), F.length(canon))
    country = F.substring(canon, 1, 2)
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def surrogate(secret: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical value."""

    def made(r: Column) -> Column:
        at = lambda i: F.element_at(r, F.lit(i))
        cut = F.length(canon) - 1
        card = F.concat(F.substring(canon, 1, 1), F.substring(_alike(canon, r), F.lit(2), cut - 1))
        octet = lambda i: F.pmod(at(i), F.lit(256)).cast("string")
        local = F.substring_index(canon, "@", 1)
        further = F.transform(F.slice(r, F.length(local) + 1, attempt), lambda x: F.substring(F.lit(_CLASSES[1]), F.pmod(x, F.lit(26)) + 1, 1))  # numbers that neither side takes
        label = F.when(attempt > 0, F.concat(F.lit("."), F.array_join(further, ""))).otherwise(F.lit(""))
        out = (
            F.when(kind == "email", F.concat(_alike(local, r), F.lit("@"), _alike(F.regexp_replace(F.substring_index(canon, "@", -1), "\\.[^.]*$", ""), F.reverse(r)), label, F.lit(".example")))
            .when(kind == "ip", F.concat_ws(".", (240 + F.pmod(at(1), F.lit(16))).cast("string"), octet(2), octet(3), octet(4)))
            .when(kind == "ipv6", F.concat(F.lit("2001:db8"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit(":"), F.lower(F.hex(F.element_at(r, i))))), "")))
            .when(kind == "iban", let(_iban(canon, r), lambda x: x))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_alike(canon, r), F.lit(2), F.length(canon))))
            .when(kind == "hex", _alike(canon, r, True))
            .when(kind == "secret", F.concat(F.substring(canon, 1, 4), F.substring(_alike(canon, r, signs=attempt > 0), F.lit(5), F.length(canon))))
            .when(kind == "card", F.concat(card, _check_digit(card)))
            .when(kind == "phone", F.concat(F.substring(canon, 1, 1), F.substring(_alike(canon, r), F.lit(2), F.length(canon))))
        )
        for group, names in GIVEN.items():
            stand_in = dict(zip((n.lower() for n in names), _shuffled(STAND_INS[group], secret), strict=True))
            out = out.when(kind == "given:" + ":".join(group), F.create_map(*(F.lit(x) for pair in stand_in.items() for x in pair))[canon])
        for script, syllables in SYLLABLES.items():
            end = "ов" if script == "cyrillic" else ""  # so that it has a feminine
            out = out.when(kind == f"surname:{script}", F.concat(_joined(syllables, F.slice(r, 1, 3 + F.least(attempt, F.lit(13)))), F.lit(end)))
        return out.otherwise(canon)

    return let(_stream(secret, kind, canon, attempt, F.length(canon) + 8 + attempt), made)


def render(kind: Column, text: Column, sur: Column) -> Column:
    """A canonical surrogate in the format of the text that it replaces."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9A-Z]")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(sur, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + digit.cast("int")).alias("k"))

    dialled = F.aggregate(F.split(text, ""), start, put, lambda acc: acc["out"])
    form = F.when((kind == "surname:cyrillic") & F.lower(text).rlike(FEMININE + "|ская$"), F.concat(sur, F.lit("а"))).otherwise(sur)
    letters = F.when(text == F.upper(text), F.upper(form)).otherwise(F.initcap(form))
    capitals = (text == F.upper(text)) & (text != F.lower(text))
    address = F.concat(F.regexp_extract(text, LEADING, 0), F.when(capitals, F.upper(sur)).otherwise(sur))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), dialled).when(kind == "email", address).when(kind == "title", text).when(kind.rlike("^(given|surname)"), letters).when(kind.isin("hex", "ipv6") & capitals, F.upper(sur)).otherwise(sur)


def surrogates(atoms: DataFrame, secret: str, max_rounds: int = 40) -> DataFrame:
    """``kind, canon, sur`` for distinct (``kind``, ``canon``): distinct surrogates within a kind, none equal to an original
    of the corpus. Given names have that by their lists; titles stay."""
    free = F.col("kind").rlike("^(given|title)")
    make = lambda df: df.withColumn("sur", surrogate(secret, F.col("kind"), F.col("canon"), F.col("attempt")))
    now = scratch.written(make(atoms.withColumn("attempt", F.lit(0))), "surrogates")
    for _ in range(max_rounds):
        checked = now.where(~free)
        first = checked.groupBy("kind", "sur").agg(F.min(F.struct("attempt", "canon")).alias("w"), F.count("*").alias("c")).where("c > 1")
        double = checked.join(first, ["kind", "sur"]).where("canon <> w.canon").select("kind", "canon")
        real = checked.join(checked.select("kind", F.col("canon").alias("sur")), ["kind", "sur"], "left_semi").select("kind", "canon")
        bad = double.union(real).distinct()
        if bad.isEmpty():
            break
        again = now.join(bad, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = scratch.written(now.join(bad, ["kind", "canon"], "left_anti").union(make(again)), "surrogates")
    else:
        raise ValueError(f"surrogates still collide after {max_rounds} rounds: a kind has too few values")
    return now.select("kind", "canon", "sur")


def replace_entities(docs: DataFrame, secret: str) -> DataFrame:
    """``docs`` with every detected entity of ``text`` replaced and ``n_entities`` (0 where none).

    Null and empty texts stay; all rows and other columns are kept as they are, whatever their names (an
    ``n_entities`` column is replaced); the same entity gets the same surrogate wherever it occurs and equal texts
    stay equal. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != "text"])
    scanned = docs.select(others.alias("row"), let(marked(F.col("text").cast("string")), lambda m: F.struct(m.alias("m"), F.contains(m, F.lit(MARK)).alias("has"))).alias("s"), "text")
    held = F.when(F.col("s")["has"], F.col("s")["m"])
    table = scratch.written(scanned.select("row", F.sha2(held, 256).alias("key"), held.alias("marked"), F.when(held.isNull(), F.col("text")).alias("text")), "marked")
    hits = table.where("key is not null")
    found = F.filter(F.split("marked", MARK, -1), lambda x, i: F.pmod(i, F.lit(2)) == 1)
    seen = scratch.written(hits.select("key", F.posexplode(found).alias("pos", "entity")).distinct(), "entities")
    kinds = seen.select("entity").distinct().withColumn("k", kind_of(F.col("entity")))
    parts = scratch.written(kinds.select("entity", F.posexplode(parts_of(F.col("entity"), F.col("k"))).alias("i", "p")).select("entity", "i", "p.*"), "parts")
    named = surrogates(parts.select("kind", "canon").distinct(), secret)
    put = parts.join(named, ["kind", "canon"]).select("entity", "i", render(F.col("kind"), F.col("text"), F.col("sur")).alias("new"))
    new = put.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]), " ").alias("new"))
    told = seen.join(new, "entity").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("news"))
    pieces = F.transform(F.split("marked", MARK, -1), lambda x, i: F.when(F.pmod(i, F.lit(2)) == 0, unquoted(x)).otherwise(F.get(F.col("news"), F.floor(i / 2).cast("int"))))
    changed = hits.join(told, "key").select("row", F.array_join(pieces, "").alias("text"), F.size("news").alias("n_entities"))
    same = table.where("key is null").select("row", "text", F.lit(0).alias("n_entities"))
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return changed.union(same).select(*columns, "n_entities")

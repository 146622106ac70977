r"""Personal data replaced by surrogates.

Entities are found by one pattern: e-mail addresses, phone numbers, payment cards (with a
valid check digit), social security numbers, IBANs (with valid check digits), IPv4 and IPv6
addresses, names (after titles, after words like "my name is", and common given names with a
family name), access keys, and values assigned to words like ``password``.

A surrogate is a keyed function (HMAC) of the entity's kind and canonical form, so all
mentions of an entity, however written, have the same one, in each mention's own format. It
is of the same kind: cards and IBANs have valid check digits, names have the gender of the
given name or title and the script of the original, hexadecimal values stay hexadecimal.
Canonical forms are gathered in a dictionary, and a surrogate that two entities share, or
that is itself an entity of the input, is drawn again; in the rest, nothing but the key is
needed.

Everything is DataFrame functions. Texts are searched once: the rows are written with each
text cut at its mentions, and both the dictionary and the replacement read that table. Texts
are never shuffled unless some entity had to be drawn again, and then only those that
mention it. No pattern repeats a group that Java's matcher would handle by recursion, so
the stack that a match needs doesn't grow with the text.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, written

#: Where the session's configuration has the key of surrogates.
KEY_SETTING = "spark.rasterflow.pii.key"
BROADCAST_ROWS = 20_000
#: Times that colliding surrogates are drawn again before the kind's space is called full.
DRAWS = 40
#: Stands around mentions while a text is cut; a character that Unicode reserves for such use.
MARK = "\uffff"

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
NEUTRAL = ("Dr", "Prof", "Professor")
TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
#: Common given names that leave no doubt about gender.
MALE_NAMES = (
    "Aaron", "Adam", "Albert", "Alejandro", "Alexander", "Andreas", "Andrew", "Anthony", "Antonio", "Benjamin", "Bernd", "Carlos", "Charles", "Christoph", "Christopher", "Daniel",
    "David", "Diego", "Dieter", "Edward", "Eric", "Fernando", "Florian", "Frank", "François", "Georg", "George", "Hans", "Heinrich", "Henri", "Jacques", "James", "Jason", "Javier",
    "Jean", "Johann", "Johannes", "John", "Jonas", "Jorge", "Joseph", "José", "Juan", "Jürgen", "Kevin", "Klaus", "Lukas", "Luis", "Manuel", "Mark", "Markus", "Martin", "Matthew",
    "Michael", "Michel", "Miguel", "Nicolas", "Pablo", "Patrick", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Ralf", "Richard", "Robert", "Stefan", "Steven", "Thomas", "Timothy",
    "Tobias", "William", "Wolfgang", "Александр", "Алексей", "Андрей", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Пётр", "Сергей",
)
FEMALE_NAMES = (
    "Alice", "Amanda", "Ana", "Angela", "Anna", "Anne", "Barbara", "Beatriz", "Birgit", "Carmen", "Carolina", "Catherine", "Charlotte", "Christina", "Claudia", "Elena", "Elisabeth",
    "Elizabeth", "Emily", "Emma", "Eva", "Florence", "Françoise", "Gabriele", "Gisela", "Hannah", "Heike", "Helen", "Ingrid", "Isabel", "Isabelle", "Jane", "Jennifer",
    "Jessica", "Julia", "Julie", "Karin", "Katharina", "Laura", "Linda", "Lisa", "Lucía", "Margaret", "Maria", "Marie", "María", "Martina", "Mary", "Monika", "Nancy", "Nathalie",
    "Nicole", "Olga", "Patricia", "Petra", "Pilar", "Rebecca", "Renate", "Sabine", "Sandra", "Sarah", "Sofía", "Sophie", "Stefanie", "Susan", "Sylvie", "Teresa", "Ursula", "Valérie",
    "Анна", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна",
)
#: Words after which a full name stands.
CUES = ("name is ", "Name: ", "Regards, ", "Sincerely, ", "signed by ", "heiße ", "Name ist ", "m'appelle ", "me llamo ", "Atentamente, ")
SECRETS, WORDS = r"password|passwd|pwd|api[_\-]?key|access[_\-]?key", "token|secret"
#: What stands between a key word, in any case, and its value's opening quote.
SIGN = r"[\"']?[ \t]{0,8}(?:=>|:=|={1,3}|:)[ \t]{0,8}"
HEAD = rf"(?=[pPaAtTsS])(?i:{SECRETS}|{WORDS}){SIGN}"
#: A value ends at its closing quote, else at white space or a quote, without the punctuation before that.
VALUE = r"(?:\"(?!\")[^\"\\\r\n]*+(?:\\.[^\"\\\r\n]*+)*+(?=\")|'(?!')[^'\\\r\n]*+(?:\\.[^'\\\r\n]*+)*+(?=')|[\"']?[^\s\"']*[^\s\"'.,;:)\]}>])"
#: "token" and "secret" are also words of prose: a value of fewer than eight letters and nothing else is none after them.
PROSE = r"(?!\"[A-Za-z]{1,7}\"|'[A-Za-z]{1,7}'|[\"']?[A-Za-z]{1,7}(?:[\"']|[.,;:)\]}>]*(?:\s|$)))"
H4 = "[0-9A-Fa-f]{1,4}"
SHORT_IPV6 = "|".join([*(rf"(?:{H4}:){{1,{7 - n}}}(?::{H4}){{1,{n}}}" for n in range(1, 7)), rf"(?:{H4}:){{1,7}}:", rf":(?::{H4}){{1,7}}"])
#: Letters and digits of the scripts that set words apart by spaces.
LETTER = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}0-9"
#: An apostrophe and what follows belong to a name, as in O'Neill, unless it is a genitive's s.
SURNAME = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\-]{1,40}+(?:['’](?!s(?!\p{L}))[\p{L}\-]{1,40}+)?"


def by_initial(words: tuple[str, ...]) -> str:
    """Alternatives grouped by first letter, so that a place is ruled out by one look; longer words first."""
    groups: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(groups.items()))


ANY_CUE = rf"(?:{by_initial(CUES)})"
#: One title or several, as in "Herr Prof. Dr. Weber", or a cue.
LEAD = rf"(?:{ANY_CUE}(?:(?:{TITLES})\.? ){{0,4}}|(?:(?:{TITLES})\.? ){{1,4}})"
NAME = "|".join([
    rf"(?:(?:{TITLES})\.? ){{1,4}}\p{{Lu}}(?:['’]\p{{Lu}})?\p{{L}}+(?: \p{{Lu}}\.)?(?: {SURNAME})?",
    rf"{ANY_CUE}(?:(?:{TITLES})\.? ){{0,4}}\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\.)? {SURNAME}",
    rf"(?:{by_initial(MALE_NAMES + FEMALE_NAMES)})(?: \p{{Lu}}\.)? {SURNAME}",
])
NAME = rf"(?=[{''.join(sorted({w[0] for w in (*MALE, *FEMALE, *NEUTRAL, *MALE_NAMES, *FEMALE_NAMES, *CUES)}))}])(?<!\p{{L}})(?:{NAME})"
#: Alternatives in the order in which they are tried at a place; each begins with what rules most places out.
PATTERNS = {
    "email": rf"(?<![{LETTER}._%+\-])[{LETTER}][{LETTER}._%+\-]*+@[{LETTER}](?:[{LETTER}.\-]*)\.\p{{L}}{{2,}}",
    "secret": rf"(?=[pPaAtTsS])(?:(?i:{SECRETS}){SIGN}|(?i:{WORDS}){SIGN}{PROSE}){VALUE}",
    "key": r"(?=A)(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ipv4": rf"(?=[0-9])(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?=[0-9A-Fa-f:])(?<![0-9A-Za-z:])(?:(?:{H4}:){{7}}{H4}|{SHORT_IPV6})(?![0-9A-Za-z:]|\.[0-9])",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?=[0-9])(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?=[0-9+(])(?:(?<![0-9A-Za-z])(?:\+?1[ .\-]?)?\([0-9]{3}\)[ ]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.\-])(?:\+?1[ .\-])?[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])(?=\+(?:[ .\-/()]{0,2}[0-9]){7,15}(?![0-9]))\+[1-9][0-9]{0,2}(?:[ .\-/]\(?[0-9]{1,8}\)?){1,6}(?![0-9])|(?<![0-9A-Za-z])\+[1-9][0-9]{7,14}(?![0-9])|(?<![0-9A-Za-z.,/\-])(?:0[1-9][0-9]{1,3}[/ ]|\(0[1-9][0-9]{1,3}\) ?)[1-9][0-9]{2,3}[ \-]?[0-9]{2,5}(?![0-9]|[.,][0-9]))",
    "card": r"(?=[0-9])(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])",
    "name": NAME,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these, and without what an assigned secret needs, has no entity; tested before the whole pattern is.
HINT = f"[0-9@]|{NAME}"

#: Syllables of surrogate names by script; names end as the gender wants.
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "jo", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo", "wa", "zo"],
    "cyrillic": ["ба", "бо", "ва", "ве", "га", "го", "да", "де", "до", "за", "зо", "ка", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "па", "ро", "са", "со", "та", "те", "то", "фа"],
    "greek": ["βα", "γα", "γο", "δα", "δο", "θα", "κα", "κο", "λα", "λο", "μα", "με", "μο", "να", "νο", "πα", "πο", "ρα", "ρο", "σα", "σο", "τα", "το", "φα"],
}
ENDINGS = {"latin": ("n", "lia", "ski"), "cyrillic": ("н", "ня", "ский"), "greek": ("ς", "νια", "κης")}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def between(lo: int, column: Column, n: int) -> Column:
    return F.pmod(column, F.lit(n)) + lo


def key_of(spark: SparkSession) -> str:
    """The key in ``spark.rasterflow.pii.key``; without one a random key is made and kept for this session alone.

    Who has the key can rebuild surrogates from originals. Give one to have the same
    surrogates in several sessions.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def stream(key: str, *parts: Column | str) -> Column:
    """128 hexadecimal digits that depend on the key and all parts: HMAC-SHA-256, twice."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    mac = lambda end: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.concat(text, F.lit(end)).cast("binary")), 256))), 256)
    return F.concat(mac("|1"), mac("|2"))


def number(h: Column, i: Column | int, width: int = 2) -> Column:
    """The i-th number of a stream, ``width`` digits wide; streams repeat at their end."""
    at = F.pmod((F.lit(i) if isinstance(i, int) else i) * width, F.lit(128 - width)) + 1
    return F.conv(F.substring(h, at.cast("int"), F.lit(width)), 16, 10).cast("int")


def pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


#: Letters beside a-z that stand for each other: those of Latin with marks, Cyrillic and Greek.
OTHER_LETTERS = {r"\p{IsLatin}": "àáâäèéêëìíîïòóôöùúûüñç", r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя", r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω"}


def like(s: Column, h: Column) -> Column:
    """Each letter and digit of ``s`` replaced by one of its class: of its script and case."""

    def one(c: Column, i: Column) -> Column:
        n = number(h, i)
        plain = F.when(c.rlike("[0-9]"), pick("0123456789", n)).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", n)).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
        for script, letters in OTHER_LETTERS.items():
            plain = plain.when(c.rlike(rf"[{script}&&\p{{Lu}}]"), pick(letters.upper(), n)).when(c.rlike(rf"[{script}&&\p{{L}}]"), pick(letters, n))
        return plain.when(c.rlike(r"\p{M}"), F.lit("")).when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", n)).otherwise(c)

    return F.array_join(F.transform(chars(s), one), "")


def hexadecimal(s: Column, h: Column) -> Column:
    return F.array_join(F.transform(chars(s), lambda c, i: F.when(c.rlike("[0-9a-f]"), pick("0123456789abcdef", number(h, i))).when(c.rlike("[A-F]"), pick("ABCDEF", number(h, i))).otherwise(c)), "")


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn's sum; the last digit is doubled if ``shift`` is 1."""

    def total(s: Column) -> Column:
        n = F.length(s)

        def add(t: Column, i: Column) -> Column:
            doubled = F.pmod(i + shift, F.lit(2)) == 1
            return t + let(F.substring(s, n - i, F.lit(1)).cast("int") * F.when(doubled, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)

    return let(digits, total)


def mod97(s: Column) -> Column:
    """Of letters and digits read as a number, A is 10."""

    def add(m: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return F.pmod(m * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(chars(s), F.lit(0), add)


def kind_of(mention: Column) -> Column:
    """A mention's kind, or null where its check digits are wrong."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    bare = F.regexp_replace(mention, " ", "")
    whole = {k: mention.rlike(f"^(?:{p})$") for k, p in PATTERNS.items() if k != "secret"}
    iban = F.when(mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1, "iban")
    card = F.when(F.pmod(luhn_sum(digits, 0), F.lit(10)) == 0, "card")
    kind = F.when(mention.rlike(f"^{HEAD}"), "secret").when(mention.contains("@"), "email")
    for k in ("key", "ipv4", "ipv6"):
        kind = kind.when(whole[k], k)
    return kind.when(whole["iban"], iban).when(whole["ssn"], "ssn").when(whole["phone"], "phone").when(whole["card"], card).otherwise("name")


def whole_ipv6(mention: Column) -> Column:
    """An address as eight groups of four digits in lower case."""
    halves = F.split(F.lower(mention), "::", -1)
    groups = lambda i: F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(groups(1)) - F.size(groups(2)))
    return F.array_join(F.transform(F.concat(groups(1), zeros, groups(2)), lambda g: F.lpad(g, 4, "0")), ":")


def title_gender(mention: Column) -> Column:
    """``m`` or ``f`` by a name's titles, null where these don't show it."""
    among = lambda titles: mention.rlike(rf"^{ANY_CUE}?(?:(?:{TITLES})\.? ){{0,3}}(?:{'|'.join(titles)})\.? ")
    return F.when(among(MALE), "m").when(among(FEMALE), "f")


def gendered(kind: Column, canon: Column, known: Column) -> Column:
    """The kind of a word with the gender of a given name: as listed, else as ``known`` from titles."""
    listed = lambda names: canon.isin([n.lower() for n in names])
    gender = F.when(listed(MALE_NAMES), "m").when(listed(FEMALE_NAMES), "f").otherwise(known)
    return F.when((kind == "given") & gender.isNotNull(), F.concat(F.lit("given-"), gender)).otherwise(kind)


def units(mention: Column, kind: Column) -> Column:
    """``(kind, canon)`` of what a mention names: for names each word, for the rest one."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    words = F.split(F.regexp_extract(mention, rf"^{LEAD}?(.*)$", 1), " ")
    part = lambda w, i: F.when(w.endswith("."), INITIAL).when((F.size(words) > 1) & (i == 0), "given").otherwise("family")
    names = F.transform(words, lambda w, i: F.struct(part(w, i).alias("kind"), F.lower(w).alias("canon")))
    canon = (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "phone", F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "secret", F.regexp_replace(mention, rf"^{HEAD}[\"']?", ""))
        .when(kind == "ipv6", whole_ipv6(mention))
        .when(kind.isin("given", "family"), F.lower(mention))
        .otherwise(mention)
    )
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


#: Kind of a middle initial; it is replaced, but is no entity of its own.
INITIAL = "initial"


def name_word(kind: Column, canon: Column, h: Column) -> Column:
    def made(script: str) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        parts = [F.element_at(syllables, between(1, number(h, i, 4), len(SYLLABLES[script]))) for i in range(4)]
        male, female, family = ENDINGS[script]
        return F.concat(*parts, F.when(kind == "given-m", male).when(kind == "given-f", female).otherwise(family))

    return F.when(canon.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def surrogate(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """The canonical form that stands for ``canon`` at a draw."""

    def made(h: Column, digits: Column) -> Column:
        n = F.length(canon)
        email = let(
            stream(key, "domain", F.substring_index(canon, "@", -1)),
            lambda d: F.concat(like(F.substring_index(canon, "@", 1), h), F.lit("@mail"), F.substring(d, 1, 8), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), between(1, number(d, 5), 3))),
        )
        north = F.concat(F.lit("1"), between(2, number(h, 40), 8).cast("string"), F.substring(digits, 2, 2), between(2, number(h, 41), 8).cast("string"), F.substring(digits, 4, 6))
        phone = F.when((n == 11) & canon.startswith("1"), north).otherwise(F.concat(F.substring(canon, 1, 2), F.substring(digits, F.lit(3), n - 2)))
        card = let(F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(2), n - 2)), lambda b: F.concat(b, F.pmod(-luhn_sum(b, 1), F.lit(10)).cast("string")))
        country = F.substring(canon, 1, 2)
        iban = let(like(F.substring(canon, F.lit(5), n), h), lambda rest: F.concat(country, F.lpad((F.lit(98) - mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0"), rest))
        octets = F.array_join(F.array(*[between(1, number(h, i, 4), 254).cast("string") for i in range(4)]), ".")
        # short values have too few of their like, and other letters would stay
        initial = F.when(canon.rlike(r"\p{IsCyrillic}"), pick("абвгдезиклмнопрст", number(h, 3, 4))).when(canon.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνπρστ", number(h, 3, 4))).otherwise(pick("abcdefghijklmnoprstw", number(h, 3, 4)))
        odd = (F.length(F.regexp_replace(canon, "[^0-9A-Za-z]", "")) < 8) | canon.rlike(r"[^\x00-\x7F]")
        secret = F.when(odd, F.substring(h, 1, 16)).when(canon.rlike("^(?:[^g-zG-ZA-F]+|[^g-zG-Za-f]+)$"), hexadecimal(canon, h)).otherwise(like(canon, h))
        return (
            F.when(kind == "email", email)
            .when(kind == "phone", phone)
            .when(kind == "card", card)
            .when(kind == "ssn", F.concat(between(1, number(h, 40), 5).cast("string"), F.substring(digits, 2, 8)))
            .when(kind == "iban", iban)
            .when(kind == "ipv4", octets)
            .when(kind == "ipv6", hexadecimal(canon, h))
            .when(kind == "key", F.concat(F.lit("AKIA"), like(F.substring(canon, 5, 16), h)))
            .when(kind == "secret", secret)
            .when(kind == INITIAL, F.concat(initial, F.lit(".")))
            .otherwise(name_word(kind, canon, h))
        )

    tens = F.sequence(F.lit(0), F.lit(31))
    # a given name's gender shows in its end only, so that its surrogate is the same name
    return let(stream(key, F.when(kind.startswith("given"), "given").otherwise(kind), canon, draw), lambda h: let(F.array_join(F.transform(tens, lambda i: pick("0123456789", number(h, i))), ""), lambda d: made(h, d)))


def fill(mention: Column, canon: Column) -> Column:
    """The letters and digits of ``mention`` replaced in order by the last characters of ``canon``."""
    have = F.length(F.regexp_replace(mention, "[^0-9A-Za-z]", ""))

    def put(own: Column) -> Column:
        def add(s: Column, c: Column) -> Column:
            takes = c.rlike("[0-9A-Za-z]")
            return F.struct((s["i"] + takes.cast("int")).alias("i"), F.concat(s["out"], F.when(takes, F.substring(own, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(chars(mention), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), add)["out"]

    return let(F.substring(canon, F.greatest(F.length(canon) - have + 1, F.lit(1)), have), put)


def replaced(found: Column, told: Callable[[Column, Column], tuple[Column, Column]], key: str) -> Column:
    """What stands for each ``(m, k)`` of an array, a piece of text and its kind; a piece without a kind stands for itself.

    ``told`` gives an entity's draw and, for a given name, the gender known from titles.
    """
    named = F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), F.when(x["k"].isNotNull(), units(x["m"], x["k"])).alias("u")))

    def drawn(u: Column) -> Column:
        draw, gender = told(u["kind"], u["canon"])
        return surrogate(gendered(u["kind"], u["canon"], gender), u["canon"], draw, key)

    new = F.transform(named, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), F.when(x["k"].isNotNull(), F.transform(x["u"], drawn)).alias("n")))

    def form(x: Column) -> Column:
        mention, kind, one = x["m"], x["k"], F.try_element_at(x["n"], F.lit(1))
        title = F.regexp_extract(mention, rf"^({LEAD}?)", 1)
        return (
            F.when(kind.isNull(), mention)
            .when(kind == "email", F.when(mention == F.upper(mention), F.upper(one)).otherwise(one))
            .when(kind.isin("phone", "card", "ssn", "iban"), fill(mention, one))
            .when(kind == "secret", F.concat(F.regexp_extract(mention, rf"^({HEAD}[\"']?)", 1), one))
            .when(kind == "ipv6", F.when(mention == F.upper(mention), F.upper(one)).otherwise(one))
            .when(kind == "name", F.concat(title, F.array_join(F.transform(x["n"], capital), " ")))
            .when(kind.isin("given", "family"), capital(one))
            .otherwise(one)
        )

    return F.transform(new, form)


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def may_have(text: Column) -> Column:
    """False for texts that surely have no entity."""
    low = F.lower(text)
    word = reduce(lambda a, b: a | b, [low.contains(w) for w in ("passw", "pwd", "key", "token", "secret")])
    return text.contains("::") | ((text.contains("=") | text.contains(":")) & word & text.rlike(HEAD)) | text.rlike(HINT)


def cut_at_mentions(text: Column) -> Column:
    """A text as an array of plain pieces (even places) and mentions (odd places); null if it has no mention.

    Mentions are cut out by one pass that puts marks around them. A text that has the mark
    itself is searched twice instead.
    """
    marked = F.split(F.regexp_replace(text, F.lit(f"(?:{ANY})"), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    pieces = F.split(text, ANY, -1)
    twice = let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda found: F.flatten(F.transform(pieces, lambda p, i: F.when(i < F.size(found), F.array(p, F.try_element_at(found, i + 1))).otherwise(F.array(p)))))
    parts = F.when(text.contains(MARK), twice).otherwise(marked)
    return F.when(may_have(text), let(parts, lambda p: F.when(F.size(p) > 1, p)))


def names_again(piece: Column, given: Column, family: Column) -> Column:
    """A piece of plain text, cut at words that are names elsewhere in its text: ``(m, k)`` with kinds given and family."""
    words = F.split(F.regexp_replace(piece, F.lit(rf"(?<!\p{{L}}){SURNAME}"), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    kind = lambda w: let(F.lower(w), lambda c: F.when(F.array_contains(given, c), "given").when(F.array_contains(family, c), "family"))
    cut = F.transform(words, lambda w, i: F.struct(w.alias("m"), F.when(i % 2 == 1, kind(w)).alias("k")))
    return F.when(piece.contains(MARK), F.array(F.struct(piece.alias("m"), F.lit(None).cast("string").alias("k")))).otherwise(cut)


def with_mentions(docs: DataFrame, text: str, plain: str, pieces: str, row: str) -> DataFrame:
    """The written rows of ``docs`` without ``text``: it is in ``plain``, or, if it has mentions, cut up in ``pieces``.

    ``pieces`` are ``(m, k)``: text and the kind of what it mentions, null for plain text
    and for mentions with wrong check digits. Words of a name that was found are mentions
    wherever they stand in the text. ``row`` is a number of the row, only where there are
    mentions.
    """
    parts, names, pairs = fresh(docs, "_parts", "_names", "_pairs")
    cut = docs.select(*[F.col(f"`{c}`") for c in docs.columns], cut_at_mentions(F.col(f"`{text}`")).alias(parts))
    paired = F.transform(parts, lambda p, i: F.struct(p.alias("m"), F.when(i % 2 == 1, kind_of(p)).alias("k")))
    cut = cut.withColumn(pairs, F.when(F.col(parts).isNotNull(), paired))
    known = F.flatten(F.transform(F.filter(pairs, lambda x: x["k"] == "name"), lambda x: units(x["m"], F.lit("name"))))
    of = lambda kind: F.array_distinct(F.transform(F.filter(names, lambda u: u["kind"] == kind), lambda u: u["canon"]))
    cut = cut.withColumn(names, F.array_distinct(known))
    again = let(of("given"), lambda given: let(of("family"), lambda family: F.flatten(F.transform(pairs, lambda x: F.when(x["k"].isNull(), names_again(x["m"], given, family)).otherwise(F.array(x))))))
    has = F.col(parts).isNotNull()
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    whole = F.when(has, F.when(F.size(names) > 0, again).otherwise(F.col(pairs)))
    return written(cut.select(*rest, F.when(~has, F.col(f"`{text}`")).alias(plain), whole.alias(pieces), F.when(has, F.monotonically_increasing_id()).alias(row)), "mentions", compression="zstd")


def mentions_of(pieces: Column) -> Column:
    return F.filter(pieces, lambda x: x["k"].isNotNull())


def dictionary(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``(kind, canon, gender, draw, surrogate)``: every entity of ``docs`` once, surrogates distinct within a kind, those of names among all names.

    No surrogate is the canonical form of an entity of ``docs`` of its kind. ``gender`` is
    what titles tell of a given name that no list has, null if nothing or as much for
    either. A kind whose space is too small for its entities raises ``RuntimeError``. An
    empty table, and one without entities, gives an empty dictionary.
    """
    rows = with_mentions(docs.select(text), text, "plain", "pieces", "row")
    return _dictionary(rows.where("pieces is not null").select(mentions_of(F.col("pieces")).alias("m")), key or key_of(docs.sparkSession)).drop("space")


def _dictionary(found: DataFrame, key: str) -> DataFrame:
    # equal mentions collapse before anything is worked out for them
    mentioned = written(found.select(F.explode("m").alias("m")).select("m.m", "m.k").distinct(), "mentioned")
    each = mentioned.select(F.explode(units(F.col("m"), F.col("k"))).alias("u"), F.when(F.col("k") == "name", title_gender(F.col("m"))).alias("g")).select("u.kind", "u.canon", "g").where(F.col("kind") != INITIAL)
    votes = F.count(F.when(F.col("g") == "m", 1)) - F.count(F.when(F.col("g") == "f", 1))
    unlisted = (F.col("kind") == "given") & ~F.col("canon").isin([n.lower() for n in MALE_NAMES + FEMALE_NAMES])
    entities = each.groupBy("kind", "canon").agg(votes.alias("votes")).select("kind", "canon", F.when(unlisted & (F.col("votes") > 0), "m").when(unlisted & (F.col("votes") < 0), "f").alias("gender"))
    space = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    make = lambda d: d.withColumn("surrogate", surrogate(gendered(F.col("kind"), F.col("canon"), F.col("gender")), F.col("canon"), F.col("draw"), key))
    table = written(make(entities.withColumns({"space": space, "draw": F.lit(0)})), "surrogates")
    columns = ["kind", "canon", "gender", "space"]
    for _ in range(DRAWS):
        own = F.struct("canon", "kind")
        first = table.groupBy("space", "surrogate").agg(F.count("*").alias("n"), F.min(own).alias("keeps")).where("n > 1")
        twice = table.join(first, ["space", "surrogate"]).where(own != F.col("keeps")).select("kind", "canon")
        taken = table.join(table.select(F.col("space").alias("s2"), F.col("canon").alias("c2")), (F.col("space") == F.col("s2")) & (F.col("surrogate") == F.col("c2")), "left_semi").select("kind", "canon")
        again = written(twice.union(taken).distinct().withColumn("more", F.lit(1)), "redrawn")
        if again.isEmpty():
            return table
        table = written(make(table.join(again, ["kind", "canon"], "left").select(*columns, (F.col("draw") + F.coalesce("more", F.lit(0))).alias("draw"))), "surrogates")
    raise RuntimeError("some kind of entity has too few surrogates for its entities")


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced; ``count`` names a column for their number.

    The key comes from the session's configuration unless given, see :func:`key_of`. Texts
    without entities, null and empty ones are unchanged; the number of entities of a null
    text is 0. Repeated rows are treated alike. Only ``text`` changes (and ``count`` is
    added or replaced); other columns pass, whatever their names. An empty table gives an
    empty result.
    """
    key = key or key_of(docs.sparkSession)
    plain, pieces, row, drawn, told_ = fresh(docs, "_plain", "_pieces", "_row", "_drawn", "_told")
    rows = with_mentions(docs, text, plain, pieces, row)
    own = mentions_of(F.col(pieces))
    table = _dictionary(rows.where(F.col(pieces).isNotNull()).select(own.alias("m")), key)
    special = written(table.where("draw > 0 or gender is not null").select(F.concat_ws("|", "kind", "canon").alias("entity"), F.struct("draw", "gender").alias("how")), "special")

    def put(df: DataFrame, told: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
        columns = {text: F.when(F.col(pieces).isNotNull(), F.array_join(replaced(F.col(pieces), told, key), "")).otherwise(F.col(plain))}
        if count:
            columns[count] = F.coalesce(F.size(own), F.lit(0))
        return df.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns], *[columns[c].alias(c) for c in columns if c not in docs.columns])

    first = lambda kind, canon: (F.lit(0), F.lit(None).cast("string"))
    if special.isEmpty():
        return put(rows, first)
    # rows that mention an entity of which there is more to know are joined with those entities, by the row's number
    named = rows.where(F.col(pieces).isNotNull()).select(F.col(row).alias("r"), F.explode(own).alias("m")).select("r", "m.m", "m.k")
    named = named.select("r", F.explode(units(F.col("m"), F.col("k"))).alias("u")).select("r", F.concat_ws("|", "u.kind", "u.canon").alias("entity")).distinct()
    hows = written(named.join(special, "entity").groupBy(F.col("r").alias(drawn)).agg(F.map_from_entries(F.collect_list(F.struct("entity", "how"))).alias(told_)), "draws")
    hows = F.broadcast(hows) if hows.count() <= BROADCAST_ROWS else hows

    def looked_up(kind: Column, canon: Column) -> tuple[Column, Column]:
        how = F.try_element_at(F.col(told_), F.concat_ws("|", kind, canon))
        return F.coalesce(how["draw"], F.lit(0)), how["gender"]

    without, having = rows.where(F.col(row).isNull()), rows.where(F.col(row).isNotNull())
    return put(without, first).unionByName(put(having.join(hows, F.col(row) == F.col(drawn), "left"), looked_up))

"""Personal data replaced by surrogates, in DataFrame functions only.

Detected entities (e-mail addresses, telephone numbers, card numbers, social security numbers,
IP addresses, IBANs, secret tokens, names of persons) get keyed replacements of their own type.
Every digit gives a digit, every letter one of its own script and case, other characters stay.  In
detail: an e-mail address keeps its top-level domain, and addresses of one domain stay in one
domain; a valid card number stays valid and keeps its first digit; an IBAN keeps its country and
gets valid check digits; a private, loopback or link-local IP address stays in its range and a
public one public; a telephone number keeps its country code.

Names are found after a title, after a known first name, and, in a document that introduces a name
by title, wherever its parts come again.  First name and surname are entities of their own, without
title or punctuation, so 'Mr. John Smith', 'Mr Smith', 'Smith' and 'Dr John Smith' stay one person.
A surrogate first name has the same gender and script; the gender comes from the title, else from a
titled mention in the same document, else from the known first names, else from the ending.

Coreference: the replacement depends on a key and the entity's canonical form (lower case, or its
digits), not on the document or the spelling, so one number written in two formats is still one
number.  Distinctness: the distinct entities of the whole corpus get their replacements in a table,
where those that coincide with another's, or with an entity that really occurs, are drawn again
until none do.  Later draws of names and addresses grow longer, much later ones of numbers too, so
this ends however few replacements a format has; only IP addresses of a range that the corpus
nearly exhausts may still coincide after ``MAX_DRAWS``.  Few or no entities are redrawn, as a rule:
up to ``REDRAWN`` of them are a constant of the scan that rewrites the rows, more are joined back to
the rows that hold them.

The key comes from the argument, else from the session setting ``KEY_SETTING``, else it is
``KEY``, which is public: set one wherever surrogates must not be repeatable by others.

Defined results: a null text stays null, with no entities; rows with equal id and text are
rewritten alike; an empty table gives an empty result; all input columns are kept but those that
have the name of an added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import cluster

KEY = "halyard surrogate key"
KEY_SETTING = "spark.halyard.surrogate.key"
MAX_DRAWS = 40
#: From these draws on an e-mail address, and a number, grows by a character with each draw.
WIDER_EMAIL, WIDER_NUMBER = 4, 12
#: Redrawn entities, and characters of all of them, that a scan carries as a constant.
REDRAWN, REDRAWN_CHARS = 4_096, 1 << 18

_LATIN_F = "Anna Maria Laura Julia Clara Emma Helen Alice Sofia Nora Elena Lucy Marta Irene Paula Vera Rosa Ella Diana Carmen".split()
_LATIN_M = "Peter Paul Martin Thomas Henry David Simon Oscar Felix Hugo Victor Daniel Robert Arthur Louis Bruno Edgar Adam Leo Marco".split()
_CYRILLIC_F = "Анна Мария Елена Ольга Ирина Вера Нина Юлия Дарья Софья".split()
_CYRILLIC_M = "Иван Пётр Павел Андрей Сергей Борис Виктор Антон Олег Максим".split()
_GREEK_F = "Μαρία Ελένη Άννα Σοφία Ειρήνη Κατερίνα".split()
_GREEK_M = "Γιώργος Νίκος Πέτρος Παύλος Ανδρέας Κώστας".split()
#: First names that are known as such besides those above.
_KNOWN_F = "Mary Elizabeth Susan Sarah Jane Margaret Linda Karen Marie Sophie Claire Ingrid Ursula Monika Sabine Lucía Pilar Isabel Mercedes Ines".split()
_KNOWN_M = "John James Michael William George Charles Richard Joseph Jean Pierre Jacques Hans Klaus Jürgen Wolfgang Juan José Carlos Miguel Pedro".split()
_LATIN_START = "Bar Ben Cal Dor Fer Gar Hal Kel Lan Mar Nor Pel Ros Sal Tor Val Wen Ber Cor Del".split()
_CYRILLIC_START = "Бел Вол Гор Дал Зор Кал Лес Мар Нов Сев".split()
_GREEK_START = "Αλε Βασ Γεω Δημ Καρ Λαμ Μαν Νικ Παπ Σταθ".split()
_LATIN_MORE = "ber den ford gan land ler man mer ner rich rod ser ston ter ton vard vin well wick zer".split()
_CYRILLIC_MORE = "ан ен ин ов ар ор ел ил ук ич".split()
_GREEK_MORE = "αν εν ιν ον αρ ορ ελ ιλ ακ ιδ".split()
FEMALE_NAMES = [*_LATIN_F, *_KNOWN_F, *_CYRILLIC_F, *_GREEK_F]
MALE_NAMES = [*_LATIN_M, *_KNOWN_M, *_CYRILLIC_M, *_GREEK_M]

_FREE = r"(?<![\p{L}\p{N}_])"
_DONE = r"(?![\p{L}\p{N}_])"
_FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra|Г-жа|Κα"
_MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Г-н|Κος"
_TITLE = rf"(?:{_FEMALE_TITLES}|{_MALE_TITLES}|Dr|Prof)"
_NAME_PART = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_GIVEN_NAMES = f"(?:{'|'.join([*FEMALE_NAMES, *MALE_NAMES])})"
TITLED = _FREE + _TITLE + r"\.? " + _NAME_PART + r"(?: " + _NAME_PART + r")?" + _DONE
#: Type and pattern, in order of precedence.  What follows an underscore only tells patterns of a type apart.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": _FREE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _DONE,
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    "ssn": _FREE + r"\d{3}-\d{2}-\d{4}" + _DONE,
    "card": _FREE + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})" + _DONE,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}" + _DONE,
    "phone_plus": r"(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}" + _DONE,
    "phone_ten": r"(?<![\p{L}\p{N}_.,+-])[2-9]\d{9}(?![\p{L}\p{N}_]|[.,-]\d)",
    "secret": _FREE + r"(?=[0-9A-Fa-f]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})" + _DONE,
    "access_key": _FREE + r"(?:AKIA|ASIA|ghp_|sk_live_)[0-9A-Za-z]{16,}" + _DONE,
    "name": TITLED,
    "name_known": _FREE + r"(?=\p{Lu})" + _GIVEN_NAMES + " " + _NAME_PART + _DONE,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity holds one of these, or is a name of a text that does; most texts are spared the long
#: pattern.  A capital letter is looked for first, because that is quickly told.
_CAPITAL = r"(?=\p{Lu})" + _FREE
TITLE_SIGN = _CAPITAL + _TITLE + _DONE
SIGN = rf"[0-9@]|{_CAPITAL}(?:{_TITLE}{_DONE}|{_GIVEN_NAMES} \p{{Lu}}|AKIA|ASIA)|ghp_|sk_live_"
#: Surnames with a male and a female form.
_SLAVIC = "(?<=ов|ев|ёв|ин|ын)"
_COUNTRY = r"^\+\d{1,3}[ .-]?(?=[(\d])"

#: Alphabets within which characters are exchanged, and blocks of letters of scripts without case.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_BLOCKS = {
    "CJK": (0x4E00, 0x9FA5), "Hiragana": (0x3041, 0x3096), "Katakana": (0x30A1, 0x30FA), "Hangul": (0xAC00, 0xD7A3), "Arabic": (0x0621, 0x063A), "Arabic, second part": (0x0641, 0x064A),
    "Hebrew": (0x05D0, 0x05EA), "Devanagari": (0x0905, 0x0939), "Bengali": (0x0995, 0x09A8), "Tamil": (0x0B95, 0x0BB9), "Thai": (0x0E01, 0x0E2E), "Armenian": (0x0561, 0x0586), "Georgian": (0x10D0, 0x10F0),
    "Arabic-Indic digits": (0x0660, 0x0669), "Persian digits": (0x06F0, 0x06F9), "Devanagari digits": (0x0966, 0x096F),
}
#: Beginnings of IP addresses that stay, with the octets that then stay.
_RANGES = {r"^10\.": 1, r"^127\.": 1, r"^169\.254\.": 2, r"^192\.168\.": 2, r"^172\.(?:1[6-9]|2\d|3[01])\.": 2}
_PUBLIC = [n for n in range(1, 224) if n not in (10, 127, 169, 172, 192)]
_TEXT = "array<struct<given:string,surname:string,female:boolean>>"


def entity_type(match: Column) -> Column:
    """The type by the patterns; what only its document makes an entity is a name."""
    kind = F.lit("name")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(name.split("_")[0] if name != "access_key" else name)).otherwise(kind)
    return kind


def canonical(match: Column, kind: Column) -> Column:
    """What all spellings of an entity have in common; for names see ``family`` and ``_parts``."""
    digits = F.regexp_replace(F.when(kind == "phone", F.regexp_replace(match, _COUNTRY, "")).otherwise(match), r"[^0-9]", "")
    plain = F.lower(F.translate(match, "İ", "I"))  # the one letter that lower case makes two of
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.upper(F.regexp_replace(match, " ", ""))).when(kind == "surname", family(match)).otherwise(plain)


def family(surname: Column) -> Column:
    """A surname in lower case; of Slavic pairs of forms the male one."""
    return F.regexp_replace(F.lower(surname), _SLAVIC + "а$", "")


def _number(stream: Column, i: Column | int) -> Column:
    """The i-th (from 0, around) of 64 numbers from 0 to 255."""
    return stream[i % 64] if isinstance(i, int) else F.element_at(stream, F.pmod(i, F.lit(64)) + 1)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pick(words: list, number: Column) -> Column:
    """One of the words; they are a constant, written as one text."""
    return F.element_at(F.split(F.lit("\x1f".join(map(str, words))), "\x1f"), F.pmod(number, F.lit(len(words))).cast("int") + 1)


def _stream(key: str, kind, canon: Column, draw) -> Column:
    """64 numbers that follow from the key and the entity: the bytes of a SHA-512."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, draw), 512)
    return _let(digest, lambda d: F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda i: F.conv(F.substring(d, i, F.lit(2)), 16, 10).cast("int")))


def _moved(x: Column) -> Column:
    """The replacement in lower case of the character x.c: another of its alphabet or block, as
    x.shift and x.wide say.  Other letters give a Latin one, other numerals a digit; what is neither
    stays."""
    low, point = F.lower(x.c), F.ascii(x.c)
    out = F.when(x.c.rlike(r"\p{L}"), _pick(list(_ALPHABETS[1]), x["shift"])).when(x.c.rlike(r"\p{N}"), _pick(list(_ALPHABETS[0]), x["shift"])).otherwise(x.c)
    for a, b in _BLOCKS.values():
        new = F.lit(a) + F.pmod(point - a + x.wide, F.lit(b - a + 1))
        out = F.when(point.between(a, b), F.decode(F.unhex(F.lpad(F.hex(new), 4, "0")), "UTF-16BE")).otherwise(out)
    for letters in reversed(_ALPHABETS):
        size = F.when(x.hexadecimal & F.lit(letters == _ALPHABETS[1]), 6).otherwise(len(letters))
        place = F.instr(F.lit(letters), low)
        out = F.when((place > 0) & (low != ""), F.substring(F.lit(letters), F.pmod(place - 1 + x["shift"], size) + 1, F.lit(1))).otherwise(out)
    return out


def _letters(x, key: str) -> Column:
    """The characters of the canonical form, each moved; of an e-mail address those before the
    top-level domain, where the domain moves as the domain alone says."""
    is_email, local = x.kind == "email", F.length(F.substring_index(x.canon, "@", 1))
    domain = F.substring_index(x.canon, "@", -1)
    text = F.when(is_email, F.substring(x.canon, F.lit(1), F.length(x.canon) - F.length(F.substring_index(domain, ".", -1)))).otherwise(x.canon)

    def drawn(at, stream):
        return lambda c: F.struct(c.alias("c"), _number(stream, at).alias("shift"), (_number(stream, at) * 256 + _number(stream, at + 17)).alias("wide"), x.kind.isin("secret", "ipv6").alias("hexadecimal"))

    def moved(streams):
        by_domain = lambda i: is_email & (i > local)
        return F.transform(F.split(text, ""), lambda c, i: _let(drawn(F.when(by_domain(i), i - local - 1).otherwise(i), F.when(by_domain(i), streams.domain).otherwise(streams.own))(c), _moved))

    return _let(F.struct(x.stream.alias("own"), F.when(is_email, _stream(key, F.lit("domain"), domain, F.lit("0"))).otherwise(x.stream).alias("domain")), moved)


def _poured(match: Column, letters: Column, whole: Column) -> Column:
    """The new letters in the match's own format: its other characters and its case stay.  ``whole``:
    the canonical form has all characters of the match, not only digits and letters."""
    step = lambda a, c: F.when(
        c.rlike(r"[\p{L}\p{N}]"),
        F.struct((a.at + 1).alias("at"), F.concat(a.out, F.when(c.rlike(r"\p{Lu}"), F.upper(F.element_at(letters, a.at))).otherwise(F.lower(F.element_at(letters, a.at)))).alias("out")),
    ).otherwise(F.struct((a.at + F.when(whole, 1).otherwise(0)).alias("at"), F.concat(a.out, c).alias("out")))
    return F.aggregate(F.split(match, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step, lambda a: a.out)


def _more(draw: Column, wider: int, stream: Column, letters: str) -> Column:
    """A character for each draw from ``wider`` on."""
    count = draw - wider + 1
    return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: _pick(list(letters), _number(stream, i + 40))), "")).otherwise("")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, n: a + n)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of an array of digits, modulo 10."""
    size = F.size(digits)

    def weighed(d, i):
        twice = d.cast("int") * F.when((size - i) % 2 == 0, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return _sum(F.transform(digits, weighed)) % 10


def _card(canon: Column, new: Column) -> Column:
    """The first digit stays, and the last makes a valid number if it was one."""
    body = F.concat(F.array(F.substring(canon, 1, 1)), F.slice(new, 2, F.size(new) - 2))
    check = lambda x: ((10 - _luhn(F.concat(x, F.array(F.lit("0"))))) % 10).cast("string")
    return _let(body, lambda x: F.concat(x, F.array(F.when(_luhn(F.split(canon, "")) == 0, check(x)).otherwise(F.element_at(new, -1)))))


def _iban(canon: Column, new: Column) -> Column:
    """The country stays, and the check digits belong to the new account."""
    country = F.split(F.substring(canon, 1, 2), "")

    def value(rest, c):  # ten for A and so on, written behind what was there
        point = F.ascii(c)
        return F.when(point < 58, rest * 10 + point - 48).otherwise(rest * 100 + point - 55) % 97

    def checked(account):
        rest = F.aggregate(F.concat(account, country, F.array(F.lit("0"), F.lit("0"))), F.lit(0), value)
        return F.concat(country, F.split(F.lpad((98 - rest).cast("string"), 2, "0"), ""), account)

    return _let(F.slice(F.transform(new, F.upper), 5, 40), checked)


def _phone(canon: Column, new: Column, stream: Column) -> Column:
    """The leading digits of a national number of ten stay from 2 to 9."""
    leads = lambda c, i: (F.length(canon) == 10) & i.isin(0, 3) & (F.substring(canon, i + 1, F.lit(1)) >= "2") & (c < "2")
    return F.transform(new, lambda c, i: F.when(leads(c, i), (F.pmod(_number(stream, i + 30), F.lit(8)) + 2).cast("string")).otherwise(c))


def _ip(match: Column, stream: Column, draw: Column) -> Column:
    octet = lambda i: (F.pmod(_number(stream, 2 * i) * 256 + _number(stream, 2 * i + 1), F.lit(254)) + 1).cast("string")
    out = F.concat_ws(".", _pick(_PUBLIC, _number(stream, 0)), octet(1), octet(2), octet(3))
    for pattern, stay in _RANGES.items():
        out = F.when(match.rlike(pattern), F.concat_ws(".", F.substring_index(match, ".", stay), *[octet(i) for i in range(stay, 4)])).otherwise(out)
    # the smaller ranges give way to the largest private one when they are full
    return F.when((draw >= WIDER_EMAIL) & match.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2\d|3[01]))\."), F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))).otherwise(out)


def _by_script(text: Column, latin, cyrillic, greek) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), cyrillic).when(text.rlike(r"\p{IsGreek}"), greek).otherwise(latin)


def _given(text: Column, canon: Column, stream: Column, draw: Column) -> Column:
    """A first name of the gender and script; one more with every draw."""

    def made(f, m):
        names = lambda words: F.array_join(F.transform(F.sequence(F.lit(0), draw), lambda i: _pick(words, _number(stream, i))), "-")
        return F.when(canon.startswith("f:"), names(f)).otherwise(names(m))

    return _by_script(text, made(_LATIN_F, _LATIN_M), made(_CYRILLIC_F, _CYRILLIC_M), made(_GREEK_F, _GREEK_M))


def _surname(text: Column, stream: Column, draw: Column) -> Column:
    """A surname of the script; a syllable longer with every draw.  Slavic and Greek ones keep the
    gender that the ending shows."""

    def made(start, more, female, end_f, end_m):
        tail = F.array_join(F.transform(F.sequence(F.lit(0), draw), lambda i: _pick(more, _number(stream, i + 4))), "")
        return F.concat(_pick(start, _number(stream, 2)), _pick(more, _number(stream, 3)), tail, F.when(female, F.lit(end_f)).otherwise(F.lit(end_m)))

    latin = made(_LATIN_START, _LATIN_MORE, F.lit(False), "", "")
    return _by_script(text, latin, made(_CYRILLIC_START, _CYRILLIC_MORE, text.rlike("[ая]$"), "ова", "ов"), made(_GREEK_START, _GREEK_MORE, text.rlike("(?:ου|α|ά|η)$"), "ου", "ος"))


def surrogate(match: Column, kind: Column, canon: Column, draw: Column, key: str = KEY) -> Column:
    """The replacement of one entity; kind is a type, "surname" or "given"."""

    def shaped(x):  # x: match, kind, canonical form, draw and the keyed stream of bytes
        country = F.when(x.kind == "phone", F.regexp_extract(x.match, _COUNTRY, 0)).otherwise("")  # a country code stays
        rest = F.substring(x.match, F.length(country) + 1, F.length(x.match))
        is_email, whole = x.kind == "email", x.kind.isin("email", "ipv6", "secret", "access_key")
        typed = lambda new: (
            F.when(x.kind == "card", _card(x.canon, new)).when(x.kind == "iban", _iban(x.canon, new)).when(x.kind == "phone", _phone(x.canon, new, x.stream)).when(is_email, F.concat(new, F.split(F.substring_index(x.canon, ".", -1), ""))).otherwise(new)
        )
        poured = _let(_letters(x, key), lambda new: _let(typed(new), lambda letters: _poured(rest, letters, whole)))

        def wider(new):
            email = F.concat(F.substring_index(new, "@", 1), _more(x.draw, WIDER_EMAIL, x.stream, _ALPHABETS[1] + _ALPHABETS[0]), F.lit("@"), F.substring_index(new, "@", -1))
            return F.when(is_email, email).otherwise(F.concat(country, new, F.when(whole, F.lit("")).otherwise(_more(x.draw, WIDER_NUMBER, x.stream, _ALPHABETS[0]))))

        return _let(poured, wider)

    def given(x):
        return F.when(x.kind == "surname", _surname(x.match, x.stream, x.draw)).when(x.kind == "given", _given(x.match, x.canon, x.stream, x.draw)).when(x.kind == "ip", _ip(x.match, x.stream, x.draw)).otherwise(shaped(x))

    return _let(F.struct(match.alias("match"), kind.alias("kind"), canon.alias("canon"), draw.alias("draw"), _stream(key, kind, canon, draw.cast("string")).alias("stream")), given)


# ---------------------------------------------------------------- entities of a text


def _split_name(match: Column) -> tuple[Column, Column, Column]:
    """(title, words, whether there are two) of a name."""
    title = F.regexp_extract(match, rf"^{_TITLE}\.? ", 0)
    words = F.split(F.substring(match, F.length(title) + 1, F.length(match)), " ")
    return title, words, F.size(words) > 1


def introduced(text: Column) -> Column:
    """The names that a text introduces by title: given, surname, and whether the title is a woman's
    (null if it tells nothing)."""

    def one(match):
        title, words, two = _split_name(match)
        female = F.when(title.rlike(rf"^(?:{_FEMALE_TITLES})[. ]"), True).when(title.rlike(rf"^(?:{_MALE_TITLES})[. ]"), False)
        return F.struct(F.when(two, words[0]).otherwise("").alias("given"), F.element_at(words, -1).alias("surname"), female.alias("female"))

    found = F.transform(F.regexp_extract_all(text, F.lit(TITLED), F.lit(0)), one)
    return F.when(text.rlike(TITLE_SIGN), found).otherwise(F.array().cast(_TEXT))


def pattern_of(own: Column) -> Column:
    """The pattern of all entities of a text that introduces the names ``own``."""
    male = lambda x: F.regexp_replace(x.surname, _SLAVIC + "а$", "")
    forms = F.transform(own, lambda x: F.array(x.given, x.surname, F.when(x.surname.rlike(_SLAVIC + "а?$"), male(x)).otherwise(""), F.when(x.surname.rlike(_SLAVIC + "а?$"), F.concat(male(x), F.lit("а"))).otherwise("")))
    names = F.array_sort(F.array_distinct(F.filter(F.flatten(forms), lambda n: n != "")))
    some = _let(F.array_join(names, "|"), lambda n: F.concat(F.lit(f"{ANY}|{_FREE}(?=\\p{{Lu}})(?:"), n, F.lit(")(?: (?:"), n, F.lit(f"))?{_DONE}")))
    return F.when(F.size(own) > 0, some).otherwise(F.lit(ANY))


def _parts(match: Column, own: Column) -> Column:
    """match, kind, and of a name its title, given, surname and whether it is a woman's."""

    def typed(kind):
        title, words, two = _split_name(match)
        alone = F.element_at(words, -1)
        only_given = ~two & (title == "") & F.exists(own, lambda x: x.given == alone) & ~F.exists(own, lambda x: x.surname == alone)
        given = F.when(two, words[0]).when(only_given, alone).otherwise("")
        surname = F.when(only_given, "").otherwise(alone)
        says = F.when(title.rlike(rf"^(?:{_FEMALE_TITLES})[. ]"), True).when(title.rlike(rf"^(?:{_MALE_TITLES})[. ]"), False)
        told = F.get(F.filter(own, lambda x: x.female.isNotNull() & (x.given == given)), 0).female
        listed = lambda names: F.array_contains(F.split(F.lit(" ".join(names)), " "), given)
        known = F.when(listed(FEMALE_NAMES), True).when(listed(MALE_NAMES), False)
        female = F.coalesce(says, told, known, given.rlike("[aáàαάηήая]$"))
        named = lambda c, name: F.when(kind == "name", c).otherwise("").alias(name)
        return F.struct(match.alias("match"), kind.alias("kind"), named(title, "title"), named(given, "given"), named(surname, "surname"), ((kind == "name") & female).alias("female"))

    return _let(entity_type(match), typed)


def _given_canon(x) -> Column:
    return F.concat(F.when(x.female, F.lit("f:")).otherwise(F.lit("m:")), F.lower(x.given))


def _singles(x) -> Column:
    """The entities (kind, canon, match) of one match: a name has up to two."""
    one = lambda kind, canon, match: F.struct(kind.alias("kind"), canon.alias("canon"), match.alias("match"))
    name = F.filter(F.array(one(F.lit("surname"), family(x.surname), x.surname), one(F.lit("given"), _given_canon(x), x.given)), lambda e: e.match != "")
    return F.when(x.kind == "name", name).otherwise(F.array(one(x.kind, canonical(x.match, x.kind), x.match)))


def _with_matches(docs: DataFrame, text_col: str, own: str, matches: str) -> DataFrame:
    """The rows with their entities; null where the text holds no sign of any."""
    text = F.col(text_col)
    rows = docs.withColumn(own, F.when(F.coalesce(text.rlike(SIGN), F.lit(False)), introduced(text)))
    found = F.transform(F.regexp_extract_all(text, pattern_of(F.col(own)), F.lit(0)), lambda m: _parts(m, F.col(own)))
    return rows.withColumn(matches, F.when(F.col(own).isNotNull(), found))


def draws(docs: DataFrame, text_col: str, key: str = KEY) -> DataFrame:
    """(kind, canon, draw) of the entities whose first surrogate would not be theirs alone."""
    n = cluster.partitions(docs.sparkSession)
    own, m = cluster.unused(docs, "pii_own", "pii_match")
    each = _with_matches(docs.select(text_col), text_col, own, m).where(F.size(m) > 0).select(F.explode(F.flatten(F.transform(m, _singles))).alias("e"))
    now = cluster.saved(each.groupBy("e.kind", "e.canon").agg(F.min("e.match").alias("match")).withColumn("draw", F.lit(0)))
    new = surrogate(F.col("match"), F.col("kind"), F.col("canon"), F.col("draw"), key)
    for _ in range(MAX_DRAWS):
        form = F.when(F.col("kind") == "given", F.concat(F.substring("canon", 1, 2), F.lower("made"))).otherwise(canonical(F.col("made"), F.col("kind")))
        given = now.repartition(n).withColumn("made", new).withColumn("new", form).drop("made")
        owner = given.groupBy("kind", "new").agg(F.min("canon").alias("owner"))
        real = now.select("kind", F.col("canon").alias("new"), F.lit(True).alias("real"))
        judged = given.join(owner, ["kind", "new"]).join(real, ["kind", "new"], "left")
        clash = F.col("real").isNotNull() | (F.col("owner") != F.col("canon"))
        now = cluster.saved(judged.select("kind", "canon", "match", (F.col("draw") + clash.cast("int")).alias("draw"), clash.alias("clash")))
        if not now.where("clash").limit(1).count():
            break
    return now.where("draw > 0").select("kind", "canon", "draw")


def _constant(again: DataFrame) -> Column | None:
    """The draws of redrawn entities as a constant map, or None if there are too many for that."""
    size = again.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("canon")).alias("chars")).first()
    if size.rows > REDRAWN or (size.chars or 0) > REDRAWN_CHARS:
        return None
    rows = again.collect()  # at most REDRAWN
    if not rows:
        return F.lit(None).cast("map<string,int>")
    listed = lambda texts: F.split(F.lit("\x1e".join(texts)), "\x1e")
    return F.map_from_arrays(listed(f"{r.kind}\x1f{r.canon}" for r in rows), listed(str(r.draw) for r in rows).cast("array<int>"))


def replace_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None, out: str = "clean_text", found: str = "n_entities", kinds: str = "entity_kinds") -> DataFrame:
    """The documents with three more columns: the rewritten text, the number of entities replaced, and
    their sorted distinct kinds."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    docs = cluster.without(docs, out, found, kinds)
    own, m, row, of, redrawn = cluster.unused(docs, "pii_own", "pii_match", "pii_row", "pii_of", "pii_draw")
    again = cluster.saved(draws(docs, text_col, key))
    rows = _with_matches(docs, text_col, own, m)
    known = _constant(again)
    if known is None:
        rows = rows.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")))
        held = rows.where(F.size(m) > 0).select(row, F.explode(F.flatten(F.transform(m, _singles))).alias("e")).select(row, "e.kind", "e.canon").join(again, ["kind", "canon"])
        held = held.groupBy(row).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "canon"), "draw"))).alias(redrawn)).withColumnRenamed(row, of)
        rows = rows.join(held, F.col(row).eqNullSafe(F.col(of)), "left").drop(of, row)
        known = F.col(redrawn)

    def single(e):
        draw = F.coalesce(F.element_at(known, F.concat_ws("\x1f", e.kind, e.canon)), F.lit(0))
        return surrogate(e.match, e.kind, e.canon, draw, key)

    def replaced(x):
        # of a name's entities the surname comes first, in the text it comes last
        new = F.reverse(F.transform(_singles(x), single))
        return F.concat(x.title, F.array_join(new, " "))

    between = F.split(F.col(text_col), pattern_of(F.col(own)), -1)
    new = F.concat(F.transform(m, replaced), F.array(F.lit("")))
    text = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), "")
    rows = rows.withColumn(out, F.when(F.size(m) > 0, text).otherwise(F.col(text_col)))
    rows = rows.withColumn(found, F.greatest(F.coalesce(F.size(m), F.lit(0)), F.lit(0)).cast("bigint"))
    rows = rows.withColumn(kinds, F.when(F.size(m) > 0, F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x.kind))), ",")).otherwise(F.lit("")))
    return rows.drop(own, m, redrawn)

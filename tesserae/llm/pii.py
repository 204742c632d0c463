"""PII surrogates: found entities get keyed replacements of the same type and format, in SQL functions only.

One regular expression finds all types in a pass; a text is split at the entities, each is replaced
by itself, and the parts are joined again, so nothing is shuffled and no table of entities is needed.

Replacements are keyed and depend only on the key and the entity's canonical form: the same
entity gets the same one everywhere (coreference), in the case and separators of each mention. There is one key for
the whole corpus, and nothing is drawn twice.

What is replaced of an entity is a string of signs, each with a place in an alphabet: a digit, a letter of its
script, an octet. A Feistel network on the two halves of the whole string permutes all strings of that shape, each
sign by a keyed hash of the other half. The network is run, the first sign moved on by a keyed step
that isn't zero, and the network run back. So every shape is permuted without a fixed point: different entities
never meet (distinctness), and none keeps its value. Each word of a name gets its
letters permuted in their alphabets, behind a first name of the title's gender. The n_collisions of replacements() counts, in each
text, replacements that stand for two entities (none, by the above) or that are another entity of the
text (which happens by chance in small shapes; that one is replaced as well). collisions() lists what two entities of a whole table share.

Types: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, card numbers (13 to 19 digits; numbers with a
right check digit get one, others don't), secrets after an assignment (token, key, password, secret) and access key
ids, social security numbers, and whole names after a title, whose gender the title tells; words of such names are
found without a title as well in the same text.

Defined results: a null text stays null, an empty or clean text stays as it is; very long texts are searched whole; repeated rows
get the same result; an empty table gives no rows; other columns are kept by anonymise(). A letter of a script without an
alphabet here moves among the 16 code points around it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of entities. Each is one alternative; none has a capturing group.
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{N}][\p{L}\p{M}\p{N}.-]*(?<=\.\p{L}{2,24})"
IPV4 = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])"
    rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}}))(?![0-9A-Za-z:]|\.[0-9])"
)
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}"
# a group of digits in a phone number, unless another number begins there
_GROUP = rf"(?: (?!{IPV4}|{SSN}|{CARD}|{DATE})|[.-])?[0-9]{{1,5}}"
#: North American, other international (7 to 15 digits), area codes in brackets, three groups with signs, leading zero (9 to 12 digits).
PHONE = (
    r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    rf"|(?<![0-9+])\+(?=(?:[ .()-]{{0,2}}[0-9]){{7}})[0-9]{{1,3}}(?:[ .-]?\([0-9]{{1,5}}\))?(?:{_GROUP}){{1,8}}(?![0-9])"
    r"|(?<![0-9(])\([0-9]{2,5}\)[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"
    r"|(?<![0-9.+-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9]|[.-][0-9])"
    rf"|(?<![0-9.,+:/-])(?!{DATE})0(?=(?:[ ./-]?[0-9]){{8,11}}(?![0-9]))[0-9]{{1,4}}[ /.-](?:[0-9]{{2,8}}(?:[ .-][0-9]{{2,4}}){{0,4}})(?![0-9])"
)
SECRET_NAME = r"(?i:(?:token|api[_-]?key|secret|password|passwd))"
#: Quoted values of any length. Without quotes, up to white space: after = any, after : one with a digit.
SECRET = rf"{SECRET_NAME}[\"']?\s{{0,3}}[=:]\s{{0,3}}(?:[\"'][^\"'\s]{{6,}}+[\"']|(?:(?<==)|(?<==\s)|(?<==\s\s)|(?<==\s\s\s)|(?=[^\"'\s,;&]*[0-9]))[^\"'\s,;&]{{5,}}[^\"'\s,;&.!?)#%*$])"
TITLE = r"(?<![\p{L}\p{M}\p{N}_])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|MR|MRS|MS|MISS|DR|PROF|HERR|FRAU|MONSIEUR|MADAME|SEÑOR|SEÑORA|[Гг]-н|[Гг]-жа|[Гг]осподин|[Гг]оспожа)(?:\. ?| )"
NAME_WORD = r"[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}]*+(?:[-‐'’](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]++)*+|[dl]['’]\p{Lu}[\p{L}\p{M}]*+"
PARTICLE = r"(?:von|van|vom|zu|zur|zum|der|den|des|del|della|de|di|da|do|dos|du|la|le|ter|ten|bin|ibn|al|el|y|e)"
NAME = rf"{TITLE}(?:{PARTICLE} ){{0,3}}(?:{NAME_WORD})(?: (?:{PARTICLE} ){{0,3}}(?:{NAME_WORD})){{0,7}}+"
ENTITY = "|".join([SECRET, EMAIL, NAME, PHONE, IPV4, IPV6, SSN, CARD, ACCESS_KEY])

# First names by the gender that the title tells.
FEMALE = ["Ada", "Berta", "Clara", "Dora", "Elsa", "Flora", "Greta", "Hanna", "Ida", "Julia", "Klara", "Lena", "Marta", "Nora", "Olga", "Paula"]
MALE = ["Adam", "Bert", "Carl", "Dirk", "Emil", "Frank", "Gustav", "Hans", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Otto", "Paul"]
# Letters that replace each other; lower case, or of scripts without case.
ALPHABETS = [
    "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøœùúûüýÿāăąēĕėęěĩīĭįōŏőũūŭůűų", "çðñþćĉċčďđĝğġģĥħĵķĺļľłńņňŋŕŗřśŝşšţťŧŵźżž",
    "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ", "аеиоуыэюяёієї", "бвгджзйклмнпрстфхцчшщґђјљњћўџ", "ъь",
]
# First and last letter of scripts without case: Armenian (small), Hebrew, Arabic, Devanagari, Bengali, Thai, Georgian, kana, Han, Hangul.
RANGES = [
    (0x561, 0x586), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x914), (0x915, 0x939), (0x995, 0x9A8), (0xE01, 0xE2E), (0x10D0, 0x10F0),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]
FEMALE_TITLES = ["mrs", "ms", "miss", "frau", "madame", "señora", "г-жа", "госпожа"]
#: Titles that tell no gender: the name's hash chooses.
OPEN_TITLES = ["dr", "prof"]
# Signs of a kind that are no letters of a script, in order.
DIGITS, HEX, CODE, LATIN, MARKS = "0123456789", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "!#$%*+/=?@^~"
CARRIED = "array<struct<word:string,female:boolean>>"

#: Only texts with one of these can hold an entity; a cheap test before the expression of all forms.
HINT = r"[@0-9\"'=]|A[KS]IA|M(?:rs?|s|iss|RS?|S|ISS|onsieur|adame|ONSIEUR|ADAME)[. ]|Herr|Frau|HERR|FRAU|Señor|SEÑOR|D[rR][. ]|Prof|PROF|[Гг]-|[Гг]оспо"

#: Rounds of the permutation; four make it strong against chosen inputs.
ROUNDS = 4
def kind_of(entity: Column) -> Column:
    """The type of an entity that ENTITY found."""
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    return (
        F.when(entity.contains("@") & whole(EMAIL), "email")
        .when(whole(SECRET), "secret")
        .when(whole(IPV4), "ip")
        .when(whole(IPV6), "ip6")
        .when(whole(ACCESS_KEY), "access key")
        .when(whole(SSN), "ssn")
        .when(whole(CARD), "card")
        .when(entity.rlike("^[+(0-9]"), "phone")
        .otherwise("name")
    )


def _number(key: str, *parts: Column) -> Column:
    """A keyed number below 2^52 from strings: the first 13 hex digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256), 1, 13), 16, 10).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Alphabets in the order of their numbers, and the ways of reading a string in which each is used.
TABLES = [(DIGITS, ("digits", "signs")), (HEX, ("hex",)), (CODE, ("code",)), (LATIN, ("signs",)), (MARKS, ("marks",))]
TABLES += [(letters, ("name",) if k < 2 else ("name", "signs")) for k, letters in enumerate(ALPHABETS)]
STAYS, OCTET, POINT = -1, -2, -3


def _place(sign: Column, mode: Column) -> Column:
    """A sign's alphabet (or STAYS, OCTET, POINT: a range of code points from low), its size, and the sign's place in it."""
    low = F.when(mode == "code", sign).otherwise(F.translate(F.lower(sign), "ς", "σ"))
    found = lambda table, size, at, first=0: F.struct(F.lit(table).alias("table"), F.lit(size).alias("size"), at.cast("int").alias("at"), (first if isinstance(first, Column) else F.lit(first)).cast("int").alias("low"))
    out = F.when(mode == "octet", found(OCTET, 256, sign))
    for k, (letters, modes) in enumerate(TABLES):
        at = F.instr(F.lit(letters), low)
        out = out.when(mode.isin(*modes) & (at > 0), found(k, len(letters), at - 1))
    code, letters = F.ascii(low), mode.isin("signs", "name")
    for first, last in RANGES:
        out = out.when(letters & code.between(first, last), found(POINT, last - first + 1, code - first, first))
    other = letters & (code > 127) & low.rlike(r"^\p{L}$") & (low != "ß")
    return out.when(other, found(POINT, 16, code % 16, code - code % 16)).otherwise(found(STAYS, 1, F.lit(0)))


def _sign(original: Column, place: Column, at: Column) -> Column:
    """The sign at another place of the original's alphabet, in its case."""
    tables = F.array(*[F.lit(letters) for letters, _ in TABLES])
    new = (
        F.when(place["table"] == OCTET, at.cast("string"))
        .when(place["table"] == POINT, F.decode(F.unhex(F.lpad(F.hex((place["low"] + at).cast("long")), 8, "0")), "UTF-32"))
        .otherwise(F.substr(F.element_at(tables, F.greatest(place["table"], F.lit(0)) + 1), at + 1, F.lit(1)))
    )
    upper = (original != F.lower(original)) & (place["table"] >= 0) & (place["table"] != 2)
    return F.when(place["table"] == STAYS, original).when(upper, F.upper(new)).otherwise(new)


def _round(halves: Column, sizes: Column, k: Column, sign: int, key: str, tweak: Column) -> Column:
    """One half's places moved by a keyed hash of the other half; the halves change in turn."""
    even = k % 2 == 0
    fixed, moving = F.when(even, halves["b"]).otherwise(halves["a"]), F.when(even, halves["a"]).otherwise(halves["b"])
    own = F.when(even, sizes["a"]).otherwise(sizes["b"])
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), tweak, k.cast("string"), F.array_join(fixed.cast("array<string>"), ",")), 256)
    # ten steps of 24 bits from each hash
    blocks = _let(seed, lambda d: F.transform(F.sequence(F.lit(0), F.floor(F.size(moving) / 10).cast("int")), lambda j: F.sha2(F.concat(d, F.lit(":"), j.cast("string")), 256)))

    def moved(steps: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            step = F.conv(F.substr(steps[F.floor(i / 10).cast("int")], (i % 10) * 6 + 1, F.lit(6)), 16, 10).cast("long")
            return F.pmod(x + sign * step, own[i]).cast("int")

        return F.transform(moving, one)

    return _let(_let(blocks, moved), lambda new: F.struct(F.when(even, new).otherwise(halves["a"]).alias("a"), F.when(even, halves["b"]).otherwise(new).alias("b")))


def _permuted_places(at: Column, size: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation without a fixed point of all arrays of places below the sizes."""
    half = F.floor(F.size(at) / 2).cast("int")
    cut = lambda x: F.struct(F.slice(x, F.lit(1), half).alias("a"), F.slice(x, half + 1, F.size(x)).alias("b"))
    rounds = F.array(*[F.lit(k) for k in range(ROUNDS)])
    first = F.array_position(F.transform(size, lambda n: n > 1), F.lit(True)).cast("int") - 1
    step = _number(key, tweak, F.lit("step"))

    def run(sizes: Column) -> Column:
        there = F.aggregate(rounds, cut(at), lambda h, k: _round(h, sizes, k, 1, key, tweak), lambda h: F.concat(h["a"], h["b"]))
        on = lambda x, i: F.when(i == first, F.pmod(x + 1 + F.pmod(step, F.greatest(size[i] - 1, F.lit(1))), size[i]).cast("int")).otherwise(x)
        back = lambda x: F.aggregate(F.reverse(rounds), cut(x), lambda h, k: _round(h, sizes, k, -1, key, tweak), lambda h: F.concat(h["a"], h["b"]))
        return _let(F.transform(there, on), back)

    return _let(cut(size), run)


def permuted(text: Column, mode: Column, key: str, kind: Column) -> Column:
    """The text's signs permuted among all texts of its shape; a text without a sign that has an alphabet stays.

    mode: digits, hex, code (capitals and digits), octet (numbers between dots), marks, signs (digits and letters), name (letters).
    """
    signs = F.when(mode == "octet", F.split(text, r"\.")).otherwise(F.filter(F.split(text, ""), lambda c: c != ""))

    def use(x: Column) -> Column:
        places, shape = x["places"], F.concat_ws(";", F.transform(x["places"], lambda p: F.concat_ws(":", p["table"].cast("string"), p["low"].cast("string"))))
        new = _permuted_places(F.transform(places, lambda p: p["at"]), F.transform(places, lambda p: p["size"]), key, F.concat_ws("\x1f", kind, F.sha2(shape, 256)))
        made = _let(new, lambda at: F.zip_with(x["signs"], F.arrays_zip(places.alias("p"), at.alias("n")), lambda c, y: _sign(c, y["p"], y["n"])))
        return F.when(F.exists(places, lambda p: p["size"] > 1), F.when(mode == "octet", F.array_join(made, ".")).otherwise(F.array_join(made, ""))).otherwise(text)

    return _let(_let(signs, lambda c: F.struct(c.alias("signs"), F.transform(c, lambda x: _place(x, mode)).alias("places"))), use)


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string with its check digit."""
    signs = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(
        F.transform(signs, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))),
        F.lit(0),
        lambda a, x: a + x,
    )


def _same_form(original: Column, digits: Column) -> Column:
    """The digits in the places where the original has digits."""
    parts = F.split(original, "")
    # how many digits stand before each sign
    at = F.transform(parts, lambda c, i: F.length(F.regexp_replace(F.substr(original, F.lit(1), i), "[^0-9]", "")))
    return F.array_join(F.zip_with(parts, at, lambda c, k: F.when(c.rlike("^[0-9]$"), F.substr(digits, k + 1, F.lit(1))).otherwise(c)), "")


def _secret_value(assignment: Column) -> tuple[Column, Column, Column]:
    """Name and opening quote, value, and closing quote of a secret."""
    head = F.regexp_extract(assignment, rf"^{SECRET_NAME}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?", 0)
    quote = F.regexp_extract(assignment, "[\"']$", 0)
    return head, F.substr(assignment, F.length(head) + 1, F.length(assignment) - F.length(head) - F.length(quote)), quote


def _card_check(number: Column, body: Column, key: str) -> Column:
    """The last digit behind a permuted body: right if the number's own was, and wrong if it was wrong."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    own = F.substr(digits, F.lit(1), F.length(digits) - 1)
    check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    # how far the last digit is from the right one: 0 stays 0, and 1 to 9 are moved among themselves
    off = F.pmod(F.right(digits, F.lit(1)).cast("int") + _luhn_sum(F.concat(own, F.lit("0"))), F.lit(10))
    moved = F.when(off == 0, F.lit(0)).otherwise(F.pmod(off - 1 + _number(key, F.lit("wrong card"), own), F.lit(9)) + 1)
    return F.pmod(check + moved, F.lit(10)).cast("string")


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, f"^{TITLE}", 0)


def _female(title: Column, name: Column) -> Column:
    """Whether a title's bearer is female; an open title leaves it to the name's last word."""
    plain = F.lower(F.regexp_replace(title, "[. ]", ""))
    return F.when(plain.isin(OPEN_TITLES), F.pmod(F.crc32(F.lower(F.substring_index(name, " ", -1))), F.lit(2)) == 0).otherwise(plain.isin(FEMALE_TITLES))


def _particle(words: Column, w: Column, i: Column) -> Column:
    """Whether a name's word is a particle: not its last one, and in lower or upper case."""
    return F.lower(w).rlike(f"^{PARTICLE}$") & (i < F.size(words) - 1) & ((w == F.lower(w)) | (w == F.upper(w)))


def _split_name(mention: Column) -> Column:
    return F.split(F.substr(mention, F.length(_title(mention)) + 1, F.length(mention)), " ")


def name_words(mention: Column) -> Column:
    """The words of a name, without its title and without particles, in lower case."""
    words = _split_name(mention)
    return F.transform(F.filter(words, lambda w, i: ~_particle(words, w, i)), F.lower)


def _name(mention: Column, letters: Column, key: str, carried: Column) -> Column:
    """Title and particles stay; each word gets a first name of the title's gender and its own letters permuted (letters: by word).

    In other scripts the letters alone are permuted. Without a title the gender is that of the word's first titled mention.
    """
    title = _title(mention)
    words = _split_name(mention)

    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        first = F.try_element_at(F.filter(carried, lambda c: c["word"] == low), F.lit(1))
        female = F.when(title != "", _female(title, mention)).otherwise(F.coalesce(first["female"], F.lit(False)))
        at = (F.pmod(_number(key, F.lit("name"), low), F.lit(16)) + 1).cast("int")
        given = F.element_at(F.when(female, F.array(*map(F.lit, FEMALE))).otherwise(F.array(*map(F.lit, MALE))), at)
        own = letters[i]
        own = F.concat(F.upper(F.substr(own, F.lit(1), F.lit(1))), F.substr(own, F.lit(2), F.length(own)))
        new = F.when(w.rlike(r"\p{IsLatin}"), F.concat(given, F.lit("-"), own)).otherwise(own)
        return F.when(_particle(words, w, i), w).when((F.length(w) > 1) & (w == F.upper(w)), F.upper(new)).otherwise(new)

    return F.concat(title, F.array_join(F.transform(words, word), " "))


def surrogate(entity: Column, key: str, carried: Column | None = None) -> Column:
    """The keyed replacement of an entity; carried: the words of its text's titled names."""
    carried = F.array().cast(CARRIED) if carried is None else carried
    low = F.lower(entity)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    # an address: the last label stays; a phone number: the country code, or a national number's first digit
    label = F.substring_index(low, ".", -1)
    code = F.regexp_extract(entity, r"^(?:\+[0-9]{1,3}(?=[^0-9])|\(?[0-9])", 0)
    rest = F.substr(entity, F.length(code) + 1, F.length(entity))
    head, value, quote = _secret_value(entity)
    hexadecimal = value.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")

    def cores(kind: Column) -> Column:
        """What is permuted, and how its signs are read."""
        one = lambda text, mode: F.array(F.struct(text.alias("text"), (F.lit(mode) if isinstance(mode, str) else mode).alias("mode")))
        return (
            F.when(kind == "email", one(F.substr(low, F.lit(1), F.length(low) - F.length(label)), "signs"))
            .when(kind == "secret", one(value, F.when(hexadecimal, "hex").when(value.rlike(r"[\p{L}\p{N}]"), "signs").otherwise("marks")))
            .when(kind == "ip", one(entity, "octet"))
            .when(kind == "ip6", one(low, "hex"))
            .when(kind == "phone", one(F.regexp_replace(rest, "[^0-9]", ""), "digits"))
            .when(kind == "ssn", one(digits, "digits"))
            .when(kind == "card", one(F.substr(digits, F.lit(1), F.length(digits) - 1), "digits"))
            .when(kind == "access key", one(F.substr(entity, F.lit(5), F.length(entity)), "code"))
            .otherwise(F.transform(_split_name(entity), lambda w: F.struct(F.lower(w).alias("text"), F.lit("name").alias("mode"))))
        )

    def whole(kind: Column, new: Column) -> Column:
        capitals = entity == F.upper(entity)
        return (
            F.when(kind == "email", _let(F.concat(new[0], label), lambda x: F.when(capitals, F.upper(x)).otherwise(x)))
            .when(kind == "secret", F.concat(head, F.when(hexadecimal & value.rlike("[A-F]"), F.upper(new[0])).otherwise(new[0]), quote))
            .when(kind == "ip", new[0])
            .when(kind == "ip6", F.when(capitals, F.upper(new[0])).otherwise(new[0]))
            .when(kind == "phone", F.concat(code, _same_form(rest, new[0])))
            .when(kind == "ssn", _same_form(entity, new[0]))
            .when(kind == "card", _same_form(entity, F.concat(new[0], _card_check(entity, new[0], key))))
            .when(kind == "access key", F.concat(F.substr(entity, F.lit(1), F.lit(4)), new[0]))
            .otherwise(_name(entity, new, key, carried))
        )

    return _let(kind_of(entity), lambda kind: _let(F.transform(cores(kind), lambda c: permuted(c["text"], c["mode"], key, kind)), lambda new: whole(kind, new)))


def carried_words(text: Column) -> Column:
    """The words of a text's titled names, with the gender of their first title."""
    names = F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1))
    words = F.flatten(F.transform(names, lambda n: F.transform(name_words(n), lambda w: F.struct(w.alias("word"), _female(_title(n), n).alias("female")))))
    return F.when(text.rlike(NAME), words).otherwise(F.array()).cast(CARRIED)


def forms(carried: Column) -> Column:
    """The expression of a text's entities: ENTITY, and mentions of its titled names without a title."""
    # letters, hyphens and apostrophes only, so nothing in a word needs quoting; single letters aren't carried
    words = F.array_distinct(F.filter(F.transform(carried, lambda c: c["word"]), lambda w: w.rlike(r"^(?:..|\p{Lo})")))
    longest_first = F.transform(F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), lambda x: x["w"])
    untitled = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_])(?=[\p{Lu}\p{Lt}\p{Lo}])(?iu:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}_])"))
    return F.when(F.size(words) > 0, F.concat(F.lit(f"{ENTITY}|"), untitled)).otherwise(F.lit(ENTITY))


def entities(text: Column, carried: Column | None = None) -> Column:
    """All entities of a text in order; with its carried words, mentions of names without a title as well."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1))
    if carried is not None:
        found = F.when(F.size(carried) > 0, F.regexp_extract_all(text, F.concat(F.lit("("), forms(carried), F.lit(")")), F.lit(1))).otherwise(found)
    return F.when(text.rlike(HINT), found).when(text.isNotNull(), none)


def _meets(found: Column, new: Column) -> Column:
    """For each replacement whether it is an entity of the text, or stands for another entity too."""
    before, after = F.transform(found, canonical), F.transform(new, canonical)
    pairs = F.array_distinct(F.arrays_zip(before.alias("b"), after.alias("a")))
    clear = (F.size(F.array_distinct(before)) == F.size(F.array_distinct(pairs["a"]))) & ~F.arrays_overlap(before, after)
    each = F.zip_with(before, after, lambda b, a: F.array_contains(before, a) | F.exists(pairs, lambda p: (p["a"] == a) & (p["b"] != b)))
    return F.when(clear | (F.size(found) == 0), F.transform(found, lambda e: F.lit(False))).otherwise(each)


def with_replacements(rows: DataFrame, key: str, text: str) -> DataFrame:
    """rows with _entities, _new (their replacements), _meets (whether each is or stands for another entity) and _anonymous (the text with them)."""
    out = rows.withColumn("_carried", carried_words(F.col(text)))
    out = out.withColumn("_entities", entities(F.col(text), F.col("_carried")))
    out = out.withColumn("_new", F.transform("_entities", lambda e: surrogate(e, key, F.col("_carried"))))
    between = F.when(F.size("_carried") > 0, F.split(F.col(text), forms(F.col("_carried")), -1)).otherwise(F.split(F.col(text), ENTITY, -1))
    parts = F.zip_with(between, F.concat("_new", F.array(F.lit(""))), lambda b, n: F.concat(b, n))
    out = out.withColumn("_meets", _meets(F.col("_entities"), F.col("_new")))
    return out.withColumn("_anonymous", F.when(F.size("_entities") > 0, F.array_join(parts, "")).otherwise(F.col(text)))


def anonymise(documents: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with entities in their texts replaced."""
    columns = documents.columns
    rows = documents.select(F.struct(*[F.col(c) for c in columns]).alias("_row"), F.col(text_col).alias("_text"))
    out = with_replacements(rows, key, "_text")
    return out.select(*[F.col("_anonymous").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns])


def replacements(documents: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_entities, n_collisions (see above) and the text with surrogates of every row."""
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = with_replacements(rows, key, "_text")
    counted = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return out.select(F.col("_id").alias(id_col), counted(F.col("_entities")).alias("n_entities"), counted(F.filter("_meets", lambda m: m)).alias("n_collisions"), F.col("_anonymous").alias("text"))


def canonical(entity: Column) -> Column:
    """What mentions of one entity share: lower case, digits alone for numbers, and names without title."""
    kind = kind_of(entity)
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, "[^0-9]", "")).when(kind == "name", F.array_join(name_words(entity), " ")).otherwise(F.lower(entity))


def collisions(documents: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, n): replacements that stand for more than one entity of the table, and how many."""
    found = documents.select(F.explode(entities(F.col(text_col))).alias("e")).distinct()
    found = found.withColumn("s", surrogate(F.col("e"), key))
    pairs = found.select(kind_of(F.col("e")).alias("kind"), canonical(F.col("s")).alias("surrogate"), canonical(F.col("e")).alias("entity")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")

"""Personal data replaced by keyed surrogates, with DataFrame functions alone.

Detection is one pattern over the whole text; what it finds is cut out by position, so nothing is replaced twice. What
only looks like personal data stays: a card number needs a right check digit and a first digit that is issued, an IBAN
its check digits (words in capitals behind it are left out), a social security number an area, group and serial that are
issued; four numbers behind the word version or release are no address.

An entity is a type and a normalised value (an address without case, the last ten digits of a phone number): all its
spellings, in all documents, get the same surrogate, in the spelling's own format. A surrogate is drawn with
HMAC-SHA-512 under the caller's key, from what is allowed for its type:

  email     same shape of name and first label, a reserved example domain
  ip        a private address stays in its block, a public one stays public
  card      same first digit and length, right check digit
  phone     last ten digits, the area not beginning with 0 or 1; country code and punctuation stay
  ssn       issued area, group and serial
  iban      same shape, the country stays, right check digits
  secret    same shape; the fixed beginning of a key stays
  name      each word for itself: same script, length and case; the last letter goes with the gender

People: a name is found behind a title. Its words are the entities, so "Mr. John Smith", "Mr. Smith" and, in the same
document, a bare "Smith" or "John" get the same words. Without a gender of their own ("Dr. Smith", "Smith") they take
that of the nearest earlier titled mention of the word in the document, else of the first later one, else none. Two
people of one surname share the beginning of the surrogate, as they share the name.

Distinctness is checked, not assumed: in every round all candidates are grouped with the surrogates given so far and
with all real entities of the corpus; of equal candidates the smallest entity keeps it, and none may be a real one. The
others draw again. Types without a fixed length get one more letter with each try from the fifth on. Addresses leave a
block that is full: private ones for 10/8 from the seventh try on, all for the reserved 240/4 from the 13th and for the
IPv6 addresses of documentation (2001:db8::/32) from the 21st. Other numbers get a digit more with each try from the 25th
on, so every entity ends with a surrogate. No list of entities reaches the driver, only whether some are left.

Hot entities: entities are counted distinct with a combine before the shuffle; occurrences meet their surrogate in a
join whose right side is unique, broadcast when its measured table is small and with salted hot keys otherwise. Documents
without an entity pass by all joins.

Defined cases: a null text stays null, with 0 entities; an empty one stays empty. Repeated rows are treated alike.
A name is only recognised behind a title. An entity with fewer than two characters to draw cannot always differ from
itself; then it gets longer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelattice.llm.common import restored, slim, stored
from notelattice.operators.skew import if_small, salted_join

#: Titles, by the gender they say.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A word of a name, without the ending of a genitive.
_WORD = r"\p{Lu}(?:\p{L}++|'\p{L}{2,}+)(?:'\p{L}{2,}+)*+"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))

#: What an entity of each type looks like, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}",
    "secret": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)"
    r"|(?<=\bpassword=|\bpasswd=|\bpwd=|\bsecret=|\bapi_key=)[^\s\"']{6,}"
    r"|(?<=\btoken = \"|\btoken=\"|\bsecret = \"|\bapi_key = \")[^\s\"]{8,}(?=\")",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": rf"(?<![\w.])(?<![Vv]ersion |[Rr]elease )(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)|(?<![\w:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![\w:])",
    "card": r"(?<![\w-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])|(?<![\w-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"
    r"|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?[ ]{_WORD}(?:[ -]{_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has one of these; a look for them costs far less than the whole pattern.
HINT = rf"[@\d]|\b(?:{_TITLE})\b|(?:password|passwd|pwd|secret|api_key)=|(?:token|secret|api_key) ?= ?\""

ALPHABETS = [
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"(?=\p{IsCyrillic})\p{Ll}", "абвгдежзиклмнопрстуфхцчшщэюя"),
    (r"(?=\p{IsCyrillic})\p{Lu}", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"),
    (r"(?=\p{IsGreek})\p{Ll}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"(?=\p{IsGreek})\p{Lu}", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{Ll}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
]
#: Consonants, vowels, and endings by gender, of the scripts in which names are made.
SOUNDS = {
    r"\p{IsCyrillic}": ("бвгдзклмнпрст", "аеиоу", {"m": "нрлв", "f": "а", "n": "нра"}),
    r"\p{IsGreek}": ("βγδζθκλμνπρστ", "αειου", {"m": "ς", "f": "α", "n": "ςα"}),
    r"\p{L}": ("bdfgklmnprstv", "aeiou", {"m": "nrls", "f": "a", "n": "nra"}),
}


def hmac512(key: str, message: Column) -> Column:
    """Hex digits of the HMAC of a text; the key is known to the driver alone, but for its two padded blocks."""
    raw = key.encode("utf-8")
    raw = hashlib.sha512(raw).digest() if len(raw) > 128 else raw
    raw = raw.ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512)
    return F.sha2(F.concat(outer, F.unhex(first)), 512)


def number(digest: Column, i: Column | int) -> Column:
    """A number from 0 to 65535 for place i of a drawing; 124 places, then shifted ones."""
    place = F.pmod(i if isinstance(i, Column) else F.lit(i), F.lit(125))
    return F.conv(F.substr(digest, place + 1, F.lit(4)), 16, 10).cast("int")


def pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))).cast("int") + 1, F.lit(1))


def characters(text: Column) -> Column:
    return F.when(F.char_length(text) > 0, F.split(text, "", F.char_length(text))).otherwise(F.array().cast("array<string>"))


def same_shape(shape: Column, digest: Column, salt: int = 0) -> Column:
    """Letters and digits drawn anew in their own script and case; the rest stays."""

    def drawn(c: Column, i: Column) -> Column:
        n = number(digest, i * 3 + salt)
        out = c
        for pattern, letters in reversed(ALPHABETS):
            out = F.when(c.rlike(f"^{pattern}$"), pick(letters, n)).otherwise(out)
        return out

    return F.array_join(F.transform(characters(shape), drawn), "")


def spoken_stem(shape: Column, digest: Column) -> Column:
    """Consonants and vowels in turn, in the script of the word, for all its letters but the last."""

    def drawn(c: Column, i: Column) -> Column:
        n = number(digest, i * 3)
        out = c
        for script, (consonants, vowels, _) in reversed(SOUNDS.items()):
            sound = F.when(i % 2 == 0, pick(consonants, n)).otherwise(pick(vowels, n))
            out = F.when(c.rlike(f"^{script}$"), sound).otherwise(out)
        return out

    return F.array_join(F.transform(characters(without_last(shape)), drawn), "")


def without_last(word: Column) -> Column:
    return F.substr(word, F.lit(1), F.char_length(word) - 1)


def with_ending(stem: Column, gender: Column) -> Column:
    """The stem and a last letter that goes with the gender."""
    n = F.crc32(F.encode(stem, "UTF-8"))
    out = stem
    for script, (_, _, ends) in reversed(SOUNDS.items()):
        ending = F.when(gender == "m", pick(ends["m"], n)).when(gender == "f", pick(ends["f"], n)).otherwise(pick(ends["n"], n))
        out = F.when(stem.rlike(script), F.concat(stem, ending)).otherwise(out)
    return out


def luhn_sum(digits: Column) -> Column:
    """Of all digits, the last one weighing once."""
    n = F.char_length(digits)

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - 1 - i) % 2 == 0, d).otherwise(twice)

    return F.aggregate(F.transform(characters(digits), part), F.lit(0), lambda a, b: a + b)


def mod97(text: Column) -> Column:
    """Remainder of the number that digits and capital letters (A is 10) spell."""

    def step(rest: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return (F.when(value < 10, rest * 10).otherwise(rest * 100) + value) % 97

    return F.aggregate(characters(text), F.lit(0), step)


def iban_core(surface: Column) -> Column:
    """The longest run of groups from the beginning whose check digits are right, else null."""
    groups = F.split(surface, " ")

    def right(n: Column) -> Column:
        plain = F.array_join(F.slice(groups, 1, n), "")
        turned = F.concat(F.substr(plain, F.lit(5), F.char_length(plain)), F.substr(plain, F.lit(1), F.lit(4)))
        return F.char_length(plain).between(15, 34) & (mod97(turned) == 1)

    n = F.array_max(F.filter(F.sequence(F.lit(1), F.size(groups)), right))
    return F.array_join(F.slice(groups, 1, n), " ")


def entity_core(kind: Column, surface: Column) -> Column:
    """The part of what was found that is an entity; null if none is."""
    digits = digits_of(surface)
    card = digits.rlike("^[2-6]") & (luhn_sum(digits) % 10 == 0)
    return (
        F.when(kind == "iban", iban_core(surface))
        .when(kind == "card", F.when(card, surface))
        .when(kind == "ssn", F.when(~surface.rlike("^(000|666|9..)-|-00-|-0000$"), surface))
        .otherwise(surface)
    )


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def entity_type(surface: Column) -> Column:
    """The first type whose pattern the whole surface fits. Surroundings were checked when it was found."""
    out = F.lit("secret")
    bare = {t: p for t, p in PATTERNS.items() if t != "secret"}
    for name, pattern in reversed(bare.items()):
        out = F.when(surface.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return F.when(surface.rlike("^AKIA[0-9A-Z]{16}$"), F.lit("secret")).otherwise(out)


def gender_of(surface: Column) -> Column:
    """What the title says; null if nothing."""
    title = F.regexp_extract(surface, rf"^({_TITLE})\.?[ ]", 1)
    return F.when(title.isin(TITLES["m"]), F.lit("m")).when(title.isin(TITLES["f"]), F.lit("f"))


def bare_name(surface: Column) -> Column:
    return F.regexp_replace(surface, rf"^(?:{_TITLE})\.?[ ]", "")


def entity_key(kind: Column, surface: Column) -> Column:
    """What makes spellings one entity."""
    return (
        F.when(kind == "email", F.lower(surface))
        .when(kind == "phone", F.regexp_extract(digits_of(surface), "([0-9]{1,10})$", 1))
        .when(kind.isin("card", "ssn"), digits_of(surface))
        .when(kind == "iban", F.regexp_replace(surface, " ", ""))
        .when(kind == "ip", F.lower(surface))
        .when(kind == "name", F.lower(surface))
        .otherwise(surface)
    )


def drawn_key(kind: Column, key: Column, digest: Column, attempt: int) -> Column:
    """The candidate for an entity, as the key that the surrogate itself would have (of a name: without its last letter)."""
    more, digits = max(0, attempt - 3), F.concat(key, F.lit("0" * max(0, attempt - 23)))
    # email: the name grows if it has to
    name, domain = F.substring_index(key, "@", 1), F.substring_index(key, "@", -1)
    label, top = F.substring_index(domain, ".", 1), F.substring_index(domain, ".", -1)
    top = F.when(top.isin("com", "net", "org"), top).otherwise(F.lit("com"))
    label = same_shape(F.regexp_replace(label, "^-+|-+$", "x"), digest, 1)
    email = F.concat(same_shape(F.concat(name, F.lit("a" * more)), digest), F.lit("@"), label, F.lit(".example."), top)
    # ip
    octet = [F.pmod(number(digest, 5 * i), F.lit(254)) + 1 for i in range(4)]
    public = F.array(*[F.lit(x) for x in [*range(11, 100), *range(101, 127), *range(128, 169), *range(173, 192)]])
    ten = F.concat_ws(".", F.lit("10"), octet[1])
    wider = key.rlike(r"^(192\.168|172\.(1[6-9]|2\d|3[01]))\.") & F.lit(attempt >= 6)
    front = (
        F.when(F.lit(attempt >= 12), F.concat_ws(".", F.pmod(octet[0], F.lit(16)) + 240, octet[1]))
        .when(key.startswith("10.") | wider, ten)
        .when(key.startswith("192.168."), F.lit("192.168"))
        .when(key.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), F.concat_ws(".", F.lit("172"), F.pmod(octet[1], F.lit(16)) + 16))
        .when(key.startswith("127."), F.concat_ws(".", F.lit("127"), octet[1]))
        .otherwise(F.concat_ws(".", F.element_at(public, F.pmod(octet[0], F.size(public)) + 1), octet[1]))
    )
    hexed = F.array_join(
        F.transform(characters(key), lambda c, i: F.when(c == ":", c).otherwise(F.substr(digest, F.pmod(i * 3, F.lit(128)) + 1, F.lit(1)))),
        "",
    )
    if attempt >= 20:
        hexed = F.concat_ws(":", F.lit("2001:db8"), *[F.lower(F.substr(digest, F.lit(4 * i + 1), F.lit(4))) for i in range(6)])
    ip = F.when(key.contains(":") | F.lit(attempt >= 20), hexed).otherwise(F.concat_ws(".", front, octet[2], octet[3]))
    # card
    body = F.concat(
        F.substr(key, F.lit(1), F.lit(1)), same_shape(F.substr(digits, F.lit(2), F.char_length(digits) - 2), digest)
    )
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    card = F.concat(body, check.cast("string"))
    # phone
    head = F.when(F.char_length(key) == 10, pick("23456789", number(digest, 90)))
    drawn = same_shape(digits, digest)
    phone = F.when(head.isNull(), drawn).otherwise(F.concat(head, F.substr(drawn, F.lit(2), F.char_length(drawn))))
    # social security number
    fields = [(100, 566, 3, 0), (1, 99, 2, 1), (1, 9999, 4, 2)]  # of first value, number of values, digits, place
    issued = [F.lpad((F.pmod(number(digest, 5 * i), F.lit(n)) + first).cast("string"), w, "0") for first, n, w, i in fields]
    rest = same_shape(F.substr(digits, F.lit(10), F.char_length(digits)), digest)
    ssn = F.when(F.char_length(key) == 9, F.concat(*issued, rest)).otherwise(drawn)
    # name
    person = spoken_stem(F.concat(key, F.repeat(F.substr(key, F.lit(-1), F.lit(1)), F.lit(more))), digest)
    fixed = F.regexp_extract(key, "^(AKIA)?", 0)
    secret = F.concat(
        fixed, same_shape(F.concat(F.substr(key, F.char_length(fixed) + 1, F.char_length(key)), F.lit("a" * more)), digest)
    )
    country, account = F.substr(key, F.lit(1), F.lit(2)), same_shape(F.substr(digits, F.lit(5), F.char_length(digits)), digest)
    check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(country, check, account)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "ssn", ssn)
        .when(kind == "iban", iban)
        .when(kind == "name", person)
        .otherwise(secret)
    )


def title_case(name: Column) -> Column:
    parts = F.regexp_extract_all(name, F.lit(r"[\p{L}']+|[^\p{L}']+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2), F.char_length(p)))), "")


def rendered(kind: Column, surface: Column, drawn: Column) -> Column:
    """The surrogate in the format of one spelling."""
    plain = F.regexp_replace(surface, "[^A-Za-z0-9]", "")
    full = F.concat(F.substr(plain, F.lit(1), F.char_length(plain) - F.char_length(drawn)), drawn)

    def placed(c: Column, i: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substr(surface, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
        return F.when(c.rlike("^[A-Za-z0-9]$"), F.substr(full, before, F.lit(1))).otherwise(c)

    spaced = F.array_join(F.transform(characters(surface), placed), "")
    spaced = F.concat(spaced, F.substr(full, F.char_length(plain) + 1, F.char_length(full)))
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), spaced)
        .when((kind == "email") & (F.upper(surface) == surface), F.upper(drawn))
        .otherwise(drawn)
    )


def rendered_name(word: Column, stem: Column, gender: Column) -> Column:
    """The surrogate of a word of a name, in its case."""
    whole = with_ending(stem, gender)
    return F.when(F.upper(word) == word, F.upper(whole)).otherwise(title_case(whole))


def name_key(word: Column) -> Column:
    """Words that differ in their last letter alone count as one place: the last letter goes with the gender."""
    return F.when(F.col("kind") == "name", without_last(word)).otherwise(word)


def surrogates(entities: DataFrame, key: str, max_tries: int = 64) -> DataFrame:
    """``entities(kind, key)``, distinct, with ``drawn``: distinct by kind and none of them a key of ``entities``."""
    entities = stored(entities.select("kind", "key"), "entities")
    left, given = entities, None
    for attempt in range(max_tries):
        message = F.concat_ws("\x01", "kind", "key", F.lit(str(attempt)))
        candidates = left.withColumn("_digest", hmac512(key, message))
        candidates = candidates.select(
            "kind", "key", drawn_key(F.col("kind"), F.col("key"), F.col("_digest"), attempt).alias("drawn")
        )
        candidates = stored(candidates, "candidates")
        taken = entities.select("kind", name_key(F.col("key")).alias("drawn"))
        taken = taken if given is None else taken.unionByName(given.select("kind", "drawn"))
        everyone = candidates.select("kind", "drawn", "key", F.lit(False).alias("taken")).unionByName(
            taken.select("kind", "drawn", F.lit(None).cast("string").alias("key"), F.lit(True).alias("taken"))
        )
        free = everyone.groupBy("kind", "drawn").agg(F.min("key").alias("_winner"), F.max("taken").alias("taken"))
        free = free.where("not taken").select("kind", "drawn", F.col("_winner").alias("key"))
        won = stored(free, "surrogates")
        given = won if given is None else given.unionByName(won)
        left = stored(candidates.select("kind", "key").join(won, ["kind", "key"], "left_anti"), "left")
        if left.isEmpty():
            return given
    raise ValueError(f"{left.count()} entities found no surrogate of their own in {max_tries} tries")


def bare_mentions(words: Column) -> Column:
    """The pattern of all that is looked for in a document whose names consist of ``words``."""
    spellings = F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), title_case(F.lower(w)))))
    longest = F.reverse(F.array_sort(F.transform(F.array_distinct(spellings), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))))
    joined = F.array_join(F.transform(longest, lambda w: w["w"]), "|")
    return F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), joined, F.lit(r")(?![\p{L}\p{N}])"))


def name_words(names: DataFrame) -> DataFrame:
    """``(_row, _place, _at, before, word, gender)`` of ``names(_row, _place, surface)``: each word with what stands before it.

    The window runs over the mentions of one word in one document.
    """
    own = names.withColumn("bare", bare_name(F.col("surface"))).withColumn("own", gender_of(F.col("surface")))
    title = F.substr("surface", F.lit(1), F.char_length("surface") - F.char_length("bare"))
    words = own.select("_row", "_place", "own", title.alias("title"), F.posexplode(F.split("bare", " ")).alias("_at", "word"))
    mentions = Window.partitionBy("_row", F.lower("word")).orderBy("_place", "_at")
    earlier = F.last("own", ignorenulls=True).over(mentions.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first("own", ignorenulls=True).over(mentions.rowsBetween(0, Window.unboundedFollowing))
    before = F.when(F.col("_at") == 0, F.col("title")).otherwise(F.lit(" "))
    return words.select(
        "_row", "_place", "_at", before.alias("before"), "word", F.coalesce(earlier, later, F.lit("n")).alias("gender")
    )


def met(places: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Every place with what is written there."""
    written = stored(written, "rendered")
    small = if_small(written)
    return salted_join(places, written, key, "inner") if small is written else places.join(small, key)


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and ``n_entities``, the number of places that were replaced."""
    own, text = slim(docs, {"text": text_col}, ["n_entities"]), F.col("text")
    found = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    clean = own.where(~found)
    hits = own.where(found).withColumn("_found", F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    titled = F.filter("_found", lambda s: s.rlike(rf"^(?:{_TITLE})\.?[ ]"))
    hits = hits.withColumn("_words", F.array_distinct(F.flatten(F.transform(titled, lambda s: F.split(bare_name(s), " ")))))
    named = F.size("_words") > 0
    hits = hits.withColumn("_pattern", F.when(named, bare_mentions(F.col("_words"))).otherwise(F.lit(ANY)))
    again = F.when(named, F.regexp_extract_all(text, F.col("_pattern"), F.lit(0))).otherwise(F.col("_found"))
    hits = hits.withColumn("_found", again).withColumn("_words", F.transform("_words", F.lower))
    hits = stored(hits.withColumn("_row", F.monotonically_increasing_id()), "hits")

    def place(s: Column) -> Column:
        is_name = s.rlike(rf"^(?:{_TITLE})\.?[ ]") | F.array_contains("_words", F.lower(s))
        return F.struct(s.alias("surface"), is_name.alias("named"))

    places = hits.select("_row", F.posexplode(F.transform("_found", place)).alias("_place", "_it"))
    places = places.select("_row", "_place", "_it.*")
    words = stored(name_words(places.where("named").drop("named")), "names")
    surfaces = places.where("not named").select("surface").distinct().withColumn("kind", entity_type(F.col("surface")))
    surfaces = stored(surfaces.withColumn("core", entity_core(F.col("kind"), F.col("surface"))), "surfaces")
    surfaces = surfaces.withColumn("key", entity_key(F.col("kind"), F.col("core")))
    spelled = words.select("word", "gender").distinct().withColumn("key", F.lower("word"))
    entities = surfaces.where("core is not null").select("kind", "key")
    given = surrogates(entities.unionByName(spelled.select(F.lit("name").alias("kind"), "key")).distinct(), key)
    behind = F.substr("surface", F.char_length("core") + 1, F.char_length("surface"))
    replaced = F.concat(rendered(F.col("kind"), F.col("core"), F.col("drawn")), behind)
    others = surfaces.join(given, ["kind", "key"], "left").select(
        "surface", F.coalesce(replaced, "surface").alias("_new"), F.col("core").isNotNull().alias("_real")
    )
    people = spelled.join(given.where("kind = 'name'"), "key").select(
        F.concat("gender", "word").alias("_spelling"),
        rendered_name(F.col("word"), F.col("drawn"), F.col("gender")).alias("_person"),
    )
    at_names = met(words.withColumn("_spelling", F.concat("gender", "word")), people, "_spelling")
    parts = met(places.where("not named").drop("named"), others, "surface").select(
        "_row", F.struct("_place", F.lit(0).alias("_at"), "_new", "_real").alias("_part")
    )
    parts = parts.unionByName(
        at_names.select(
            "_row", F.struct("_place", F.col("_at"), F.concat("before", "_person").alias("_new"), F.lit(True).alias("_real")).alias("_part")
        )
    )
    lists = parts.groupBy("_row").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    gaps = F.split(text, F.col("_pattern"), -1)
    woven = hits.join(lists, "_row").withColumn("_gaps", gaps)
    pieces = F.transform(
        "_parts", lambda p: F.concat(F.when(p["_at"] == 0, F.get("_gaps", p["_place"])).otherwise(F.lit("")), p["_new"])
    )
    whole = F.concat(F.array_join(pieces, ""), F.element_at("_gaps", -1))
    count = F.size(F.filter("_parts", lambda p: (p["_at"] == 0) & p["_real"])).cast("long")
    replaced = woven.select(*restored(docs, {text_col: whole}, ["n_entities"]), count.alias("n_entities"))
    unchanged = clean.select(*restored(docs, {text_col: "text"}, ["n_entities"]), F.lit(0).cast("long").alias("n_entities"))
    return unchanged.unionByName(replaced)

"""Surrogates for personal data and secrets, with DataFrame functions only.

Every entity gets a keyed replacement of its own kind: digits stand for digits, letters for letters of the same case
and script, honorifics, country codes and the ends of mail addresses stay, card and account numbers keep valid check
digits, names keep script and gender. Draws depend on the key and the entity's canonical form, so all mentions of one
entity, also in other formats, in all documents agree. Replacements that coincide with each other, or with any entity of
the corpus, are drawn anew until all entities stay distinct; only the distinct entities take part in that, and which of
them draws again depends on the others.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.llm.decontaminate import digest
from edulake.session import settle

# Honorifics by gender, and given and family names that replace others.
FEMALE = "Mrs Ms Miss Madam Lady Frau Madame Mme Mademoiselle Mlle Señora Sra Doña Signora Госпожа госпожа г-жа Κυρία κυρία".split()
MALE = "Mr Mister Sir Herr Monsieur Señor Sr Don Signor Господин господин г-н Κύριος κύριος".split()
EITHER = "Dr Prof Professor Rev Доктор Профессор".split()
FEMALE_NAMES = (
    "Alice Anna Bella Carla Clara Diana Edith Elena Emma Eva Fiona Greta Hanna Helen Ida Irene Jana Julia Karla Laura "
    "Lea Lena Lucy Maria Marta Mila Mona Nadia Nina Nora Olga Paula Petra Rita Rosa Ruth Sara Sofia Tessa Vera"
).split()
MALE_NAMES = (
    "Adam Alan Anton Bruno Carl Daniel David Edgar Emil Erik Felix Frank Georg Hans Henry Hugo Ivan Jakob Jan Joel "
    "Karl Leo Louis Lukas Marc Martin Max Milo Noah Oscar Otto Paul Peter Ralph Robin Simon Theo Thomas Victor Walter"
).split()
FAMILY_NAMES = (
    "Adler Baker Bauer Bell Berger Blanc Brandt Brooks Carter Costa Cruz Dubois Ellis Fischer Fox Garcia Girard Gray "
    "Hahn Hill Hoffman Keller King Klein Lambert Lang Lopez Martin Meyer Moreau Morris Novak Ortiz Parker Perez Reed "
    "Richter Rivera Romero Rossi Roth Russo Schmidt Simon Stone Torres Vidal Wagner Weber Winter Wolf Young"
).split()
CYRILLIC_FEMALE = "Анна Вера Галина Дарья Елена Ирина Ксения Лариса Мария Нина Ольга Полина Раиса София Татьяна".split()
CYRILLIC_MALE = "Андрей Борис Виктор Глеб Дмитрий Егор Игорь Кирилл Лев Максим Николай Олег Павел Роман Сергей".split()
#: Capitalised words that may follow a name and belong to none.
NO_NAMES = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February July September October November December "
    "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar Juli Oktober Dezember"
).split()
#: Syllables of family names beyond the list: beginnings, vowels, middles and ends.
SYLLABLES = ("B Br D Dr F G Gr H K Kr L M N P R S St T V W".split(), "a e i o u".split(), "d g k l m n r s t v".split(), "ber feld ger hart ler man mer ner ring sen son ster ton well win".split())
CYRILLIC_SYLLABLES = ("Б В Г Д З К Л М Н П Р С Т Ф Ч Ш".split(), "а е и о у".split(), "б в г д ж з к л м н р с т".split(), "анов енов инов ков лов нов ров сов тов чев".split())
CYRILLIC_NAMES = "Иванов Петров Сидоров Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков Павлов".split()

_HONORIFIC = rf"(?:{'|'.join([*FEMALE, *MALE, *EITHER])})\.?"
# A part of a name, as in McDonald, O'Brien and Smith-Jones without the 's of a genitive; small words before a part; and
# an initial with its dot before another part. Honorifics begin another mention.
_PART = rf"(?!(?:{'|'.join([*FEMALE, *MALE, *EITHER])})(?![\p{{L}}\p{{M}}'’-]))\p{{Lu}}[\p{{L}}\p{{M}}]*(?:['’-](?!s\b)[\p{{L}}\p{{M}}]+)*(?![\p{{L}}\p{{M}}])"
_SMALL = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|bin|al|zu) ){0,3}"
_GIVEN = rf"(?:\p{{Lu}}\.(?= \p{{Lu}})|{_SMALL}{_PART})"
_FURTHER = rf"(?!(?:{'|'.join(NO_NAMES)})(?![\p{{L}}\p{{M}}])){_GIVEN}"
# The country codes of phone numbers, none of which begins another.
_COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: What stays before the national digits of a phone number.
_PHONE_HEAD = rf"^(?:{_COUNTRY}[ .-]?)?\(?0*"
#: Kinds of entities with their patterns, the more specific first.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[ ]?[=:][ ]?[\"']?)[^\s\"']{6,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "address6": r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}\b"
    r"|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}\b",
    "address": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "hex_key": r"\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}\b",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_HONORIFIC} {_GIVEN}(?: {_FURTHER}){{0,3}}",
}
#: Kinds of the names within a mention: the family's, and given names by the honorific's gender.
NAMES = ["name", "given_f", "given_m", "given"]
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_HONORIFICS = [*FEMALE, *MALE, *EITHER]
_SECRET_STARTS, _HONORIFIC_STARTS = "pPsStTkK", "".join(dict.fromkeys(h[0] for h in _HONORIFICS))
#: A quick look that no text with an entity fails. Most places of a text fail on one look at their first character.
_HINT = (
    rf"(?=[0-9@:{_SECRET_STARTS}{_HONORIFIC_STARTS}])(?:[0-9@]|::"
    rf"|(?=[{_SECRET_STARTS}])(?i:password|passwd|pwd|secret|token|key)"
    rf"|(?=[{_HONORIFIC_STARTS}])(?:{'|'.join(_HONORIFICS)})(?!\p{{L}}))"
)
#: A secret that stands hidden already: one sign over and over, and what ends the sentence.
_MASKED = r"^([^\p{L}\p{N}])\1{4,}[^\p{L}\p{N}]{0,2}$"
_SECRET_HEAD = r"^(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?[\"']?)"
#: Rounds of drawing anew; what is undecided by then gets a keyed number as well.
_ROUNDS = 64


def _array(names: list[str]) -> Column:
    return F.array(*map(F.lit, names))


def _kind(mention: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = F.when(mention.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _canonical(kind: Column, mention: Column) -> Column:
    """One form for all formats of an entity."""
    return (
        F.when(kind.isin("card", "ssn"), _digits(mention))
        # The national digits, with or without the country's code.
        .when(kind == "phone", _digits(F.regexp_replace(mention, _PHONE_HEAD, "")))
        .when(kind.isin("email", "address6"), F.lower(mention))
        .when(kind == "secret", F.regexp_replace(mention, _SECRET_HEAD, ""))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(mention)
    )


def _draw(key: str, canonical: Column, attempt: Column, place: Column) -> Column:
    """A keyed number from 0 to 2 ** 52 - 1 for a place of the replacement."""
    parts = F.concat_ws("\x1f", F.lit(key), canonical, attempt.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.sha2(parts, 256), 1, 13), 16, 10).cast("bigint")


_LOWER, _UPPER, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Lower-case letters of scripts beyond ASCII: their first code point and their number.
_SCRIPTS = {
    "Greek": (0x3B1, 17),
    "Cyrillic": (0x430, 32),
    "Hebrew": (0x5D0, 27),
    "Arabic": (0x628, 19),
    "Devanagari": (0x915, 37),
    "Hiragana": (0x3042, 81),
    "Katakana": (0x30A2, 81),
    "Hangul": (0xAC00, 588),
    "Han": (0x4E00, 1024),
}


def _pick(letters: str, draw: Column) -> Column:
    return F.substring(F.lit(letters), (draw % len(letters) + 1).cast("int"), F.lit(1))


def _like(char: Column, draw: Column, digits: str = "0123456789") -> Column:
    """A character of the same class: digit, letter of either case and script, or the character itself if no letter."""
    found = (
        F.when(char.rlike("[0-9]"), _pick(digits, draw))
        .when(char.rlike("[a-z]"), _pick(_LOWER, draw))
        .when(char.rlike("[A-Z]"), _pick(_UPPER, draw))
    )
    for script, (first, number) in _SCRIPTS.items():
        letters = "".join(chr(first + n) for n in range(number))
        found = found.when(char.rlike(rf"^\p{{Is{script}}}$"), _pick(letters, draw))
    other = F.when(char.rlike(r"\p{N}"), _pick(digits, draw)).when(char.rlike(r"\p{L}"), _pick(_LOWER, draw))
    return found.otherwise(other.otherwise(char))


def _characters(key: str, canonical: Column, attempt: Column, keep_first: int | Column = 0) -> Column:
    """Every character replaced by one of its class, but the first ``keep_first``."""
    each = F.transform(
        F.split(canonical, ""),
        lambda c, i: F.when(i < keep_first, c).otherwise(_like(c, _draw(key, canonical, attempt, i))),
    )
    return F.array_join(each, "")


def _check_digit(digits: Column) -> Column:
    """The last digit that makes a card number of these digits valid (Luhn)."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(
                d.cast("int")
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _card(key: str, canonical: Column, attempt: Column) -> Column:
    """The first digit stays, which names the network, and a valid number stays valid."""
    new = _characters(key, canonical, attempt, keep_first=1)
    old_body = F.substring(canonical, F.lit(1), F.length(canonical) - 1)
    valid = F.substring(canonical, F.length(canonical), F.lit(1)) == _check_digit(old_body)
    whole = F.substring(new, F.lit(1), F.length(new) - 1)
    return F.when(valid, F.concat(whole, _check_digit(whole))).otherwise(new)


def _account(key: str, canonical: Column, attempt: Column) -> Column:
    """The country stays, and the two digits behind it check the rest (modulo 97)."""
    new = _characters(key, canonical, attempt, keep_first=2)
    country, body = F.substring(new, 1, 2), F.substring(new, F.lit(5), F.length(new))
    rest = F.aggregate(
        F.split(F.concat(body, country, F.lit("00")), ""),
        F.lit(0),
        lambda sum_, c: F.when(c.rlike("[0-9]"), sum_ * 10 + c.cast("int")).otherwise(sum_ * 100 + F.ascii(c) - 55) % 97,
    )
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _octets(key: str, canonical: Column, attempt: Column) -> Column:
    each = F.transform(
        F.split(canonical, r"\."), lambda o, i: (_draw(key, canonical, attempt, i) % 254 + 1).cast("string")
    )
    return F.array_join(each, ".")


def _email(key: str, canonical: Column, attempt: Column) -> Column:
    """Name and domain are replaced; the last part of the domain stays."""
    end = F.regexp_extract(canonical, r"\.[a-z]+$", 0)
    front = F.substring(canonical, F.lit(1), F.length(canonical) - F.length(end))
    return F.concat(_characters(key, front, attempt), end)


def _entities(kind: Column, mention: Column) -> Column:
    """Kinds and canonical forms of what is replaced on its own: given and family names, or the whole mention.

    A family name is one entity whatever honorific and given names stand before it; given names are one by gender.
    """
    honorific = F.regexp_extract(mention, rf"^{_HONORIFIC}", 0)
    bare = F.regexp_replace(honorific, r"\.", "")
    rest = F.trim(F.substring(mention, F.length(honorific) + 1, F.length(mention)))
    family = F.regexp_extract(rest, rf"{_SMALL}{_PART}$", 0)
    given = F.trim(F.substring(rest, F.lit(1), F.length(rest) - F.length(family)))
    gender = F.when(bare.isin(FEMALE), "given_f").when(bare.isin(MALE), "given_m").otherwise("given")

    def entity(kind: Column, canonical: Column) -> Column:
        return F.struct(kind.alias("kind"), canonical.alias("canonical"))

    # A woman's form of a Russian family name is the same family.
    stem = F.regexp_replace(F.lower(family), "(?<=[вн])а$", "")
    names = F.array(entity(F.lit("name"), stem), entity(gender, F.lower(given)))
    whole = F.array(entity(kind, _canonical(kind, mention)))
    return F.when(kind == "name", F.filter(names, lambda e: e.canonical != "")).otherwise(whole)


def _name(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """A family name of the script, or a given name of the gender and script."""

    def drawn(names: list[str], place: int) -> Column:
        at = (_draw(key, canonical, attempt, F.lit(place)) % len(names) + 1).cast("int")
        return F.element_at(_array(names), at)

    def made(syllables: tuple[list[str], ...]) -> Column:
        """Names beyond the list: one or, later, two middles."""
        first, vowels, middles, ends = syllables
        longer = F.when(attempt > 6, F.concat(drawn(middles, 7), drawn(vowels, 8))).otherwise("")
        return F.concat(drawn(first, 3), drawn(vowels, 4), longer, drawn(middles, 5), drawn(vowels, 9), drawn(ends, 6))

    def of(female: list[str], male: list[str], family: list[str], syllables: tuple[list[str], ...]) -> Column:
        first = _draw(key, canonical, F.lit(0), F.lit(2)) % 2 == 0
        either = F.when(first, drawn(female, 0)).otherwise(drawn(male, 0))
        given = F.when(kind == "given_f", drawn(female, 0)).when(kind == "given_m", drawn(male, 0)).otherwise(either)
        # Names are few: from the third round on family names are made, and given ones get a second one.
        further = F.when(attempt > 2, F.concat(F.lit("-"), made(syllables))).otherwise("")
        return F.when(kind != "name", F.concat(given, further)).when(attempt > 2, made(syllables)).otherwise(drawn(family, 1))

    latin = of(FEMALE_NAMES, MALE_NAMES, FAMILY_NAMES, SYLLABLES)
    cyrillic = of(CYRILLIC_FEMALE, CYRILLIC_MALE, CYRILLIC_NAMES, CYRILLIC_SYLLABLES)
    # Names in other scripts are made of letters of theirs.
    other = F.initcap(_characters(key, canonical, attempt))
    return F.when(canonical.rlike(r"\p{IsCyrillic}"), cyrillic).when(canonical.rlike(r"\p{IsLatin}"), latin).otherwise(other)


def _replacement(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    hexed = F.array_join(
        F.transform(F.split(canonical, ""), lambda c, i: _pick(_HEX, _draw(key, canonical, attempt, i))), ""
    )
    letters = F.array_join(
        F.transform(F.split(canonical, ""), lambda c, i: _pick(_LOWER, _draw(key, canonical, attempt, i))), ""
    )
    return (
        F.when(kind == "email", _email(key, canonical, attempt))
        .when(kind == "card", _card(key, canonical, attempt))
        .when(kind == "address", _octets(key, canonical, attempt))
        .when(kind == "phone", _characters(key, canonical, attempt))
        .when(kind == "hex_key", hexed)
        .when((kind == "secret") & canonical.rlike("^[0-9a-f]{16,}$"), hexed)
        # Signs alone have nothing to replace one by one.
        .when((kind == "secret") & ~canonical.rlike(r"[\p{L}\p{N}]"), letters)
        .when(kind == "access_key", _characters(key, canonical, attempt, keep_first=4))
        .when(kind == "iban", _account(key, canonical, attempt))
        .when(kind == "address6", F.array_join(F.transform(F.split(canonical, ""), lambda c, i: F.when(c == ":", c).otherwise(_pick(_HEX, _draw(key, canonical, attempt, i)))), ""))
        .when(kind.isin(*NAMES), _name(key, kind, canonical, attempt))
        .otherwise(_characters(key, canonical, attempt))
    )


def _longer(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """A replacement with a keyed number, for those whose own kind has too few."""
    found = _replacement(key, kind, canonical, attempt)
    number = F.lpad(_draw(key, canonical, attempt, F.lit(-1)).cast("string"), 16, "0")
    return F.when(kind == "email", F.concat(number, found)).when(
        kind == "address", F.concat(found, F.lit("."), number)
    ).otherwise(F.concat(found, number))


def surrogates(entities: DataFrame, key: str, rounds: int = _ROUNDS) -> DataFrame:
    """``canonical``, ``kind`` and ``surrogate`` for distinct entities (``canonical``, ``kind``).

    No two entities share a surrogate and no surrogate is an entity. In every round the undecided draw; those whose
    draw is taken, is an entity, or is also drawn by a smaller entity, draw again in the next. After ``rounds`` of them
    draws get a long number too, so that no kind of entities runs out of replacements.
    """
    waiting = settle(entities.select("kind", "canonical").distinct())
    # Names are known in lower case.
    folded = F.lower("surrogate").alias("folded")
    taken = waiting.select(F.lower("canonical").alias("folded"))
    done: DataFrame | None = None
    for attempt in count():
        draw = _replacement if attempt < rounds else _longer
        drawn = waiting.withColumn("surrogate", draw(key, F.col("kind"), F.col("canonical"), F.lit(attempt)))
        drawn = settle(drawn)
        free = drawn.withColumn("folded", folded).join(taken, "folded", "left_anti")
        first = free.groupBy("surrogate").agg(F.min(F.struct("canonical", "kind")).alias("own"))
        won = settle(first.select("own.kind", "own.canonical", "surrogate"))
        done = won if done is None else done.unionByName(won)
        waiting = settle(waiting.join(won.select("kind", "canonical"), ["kind", "canonical"], "left_anti"))
        if waiting.isEmpty():
            return done
        taken = taken.unionByName(won.select(folded))


def _rendered(kind: Column, mention: Column, surrogate: Column, given: Column) -> Column:
    """The surrogate in the format of the mention; that of a name with ``given`` names, if any."""
    head = F.when(kind == "phone", F.regexp_extract(mention, _PHONE_HEAD, 0)).otherwise("")
    mention = F.substring(mention, F.length(head) + 1, F.length(mention))
    # The n-th digit of the mention becomes the n-th of the surrogate; all else stays.
    seen = F.transform(
        F.split(mention, ""),
        lambda c, i: F.when(
            c.rlike("[0-9]"),
            F.substring(surrogate, F.length(_digits(F.substring(mention, F.lit(1), i + 1))), F.lit(1)),
        ).otherwise(c),
    )
    cased = F.transform(
        F.split(surrogate, ""),
        lambda c, i: F.when(F.substring(mention, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c),
    )
    spaced = F.transform(
        F.split(mention, ""),
        lambda c, i: F.when(c == " ", c).otherwise(
            F.substring(
                surrogate, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), " ", "")), F.lit(1)
            )
        ),
    )

    def rest(places: Column) -> Column:
        """What a surrogate with a number has beyond the places of the mention."""
        return F.substring(surrogate, F.length(places) + 1, F.length(surrogate))

    # A woman's form where the mention has one.
    form = F.when(mention.rlike("[вн]а$") & surrogate.rlike("[вн]$"), F.concat(surrogate, F.lit("а"))).otherwise(surrogate)
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.concat(head, F.array_join(seen, ""), rest(_digits(mention))))
        .when(kind == "name", F.concat_ws(" ", F.regexp_extract(mention, rf"^{_HONORIFIC}", 0), given, form))
        .when(kind == "email", F.array_join(cased, ""))
        .when(kind == "iban", F.concat(F.array_join(spaced, ""), rest(F.regexp_replace(mention, " ", ""))))
        .when(kind == "secret", F.concat(F.regexp_extract(mention, _SECRET_HEAD, 0), surrogate))
        .otherwise(surrogate)
    )


def _one_gender(forms: DataFrame) -> DataFrame:
    """Given names as one entity under all honorifics: of the gender that their honorifics tell, if they agree."""
    is_given = F.col("kind").isin(*NAMES[1:])
    told = [F.max(F.col("kind") == k).alias(k) for k in ("given_f", "given_m")]
    genders = forms.where(is_given).groupBy("canonical").agg(*told)
    kind = F.when(F.col("given_f") & ~F.col("given_m"), "given_f").when(F.col("given_m") & ~F.col("given_f"), "given_m")
    genders = genders.select("canonical", kind.alias("told"))
    own = F.when(is_given, F.coalesce("told", F.lit("given"))).otherwise(F.col("kind"))
    return forms.join(genders, "canonical", "left").select("mention", "whole", own.alias("kind"), "canonical")


def replace_personal_data(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``row`` (the whole input row), ``text`` with surrogates and ``n_replaced``.

    Texts without entities come back as they are, and null texts stay null with nothing replaced. Repeated rows and
    repeated mentions get the same surrogates; other keys give others. Masked secrets stay. No rows give none.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    hinted = F.coalesce(F.col("text").rlike(_HINT), F.lit(False))
    found = F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))
    looked = rows.where(hinted).select(*digest(F.col("text")), F.explode(F.array_distinct(found)).alias("mention"))
    mentions = settle(looked.distinct())
    forms = mentions.select("mention").distinct().withColumn("kind", _kind(F.col("mention")))
    forms = forms.select("mention", F.col("kind").alias("whole"), F.inline(_entities(F.col("kind"), F.col("mention"))))
    forms = settle(forms.where(~((F.col("kind") == "secret") & F.col("canonical").rlike(_MASKED))))
    forms = settle(_one_gender(forms))
    chosen = surrogates(forms, key)
    met = forms.join(chosen, ["kind", "canonical"]).groupBy("mention", "whole")
    is_given = F.col("kind").isin(*NAMES[1:])
    whole = met.agg(
        F.max(F.when(~is_given, F.col("surrogate"))).alias("surrogate"),
        F.max(F.when(is_given, F.col("surrogate"))).alias("given"),
    )
    rendered = whole.select(
        "mention", _rendered(F.col("whole"), F.col("mention"), F.col("surrogate"), F.col("given")).alias("new")
    )
    named = mentions.join(settle(rendered), "mention").groupBy("d0", "d1")
    # As large as the distinct entities of one text.
    maps = settle(named.agg(F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("new")))
    with_hint = rows.where(hinted).select("row", "text", *digest(F.col("text"))).join(maps, ["d0", "d1"], "left")
    parts = F.split(F.col("text"), PATTERN, -1)
    pieces = F.zip_with(
        parts, found, lambda p, f: F.concat(p, F.coalesce(F.element_at(F.col("new"), f), f, F.lit("")))
    )
    changed = with_hint.select(
        "row",
        F.when(F.col("new").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"),
        F.when(F.col("new").isNull(), 0)
        .otherwise(F.size(F.filter(found, lambda f: F.map_contains_key(F.col("new"), f))))
        .cast("bigint")
        .alias("n_replaced"),
    )
    same = rows.where(~hinted).select("row", "text", F.lit(0).cast("bigint").alias("n_replaced"))
    return same.unionByName(changed)

"""Text functions as Column expressions: stripping, normalising, tokens, keywords, numbers, word counts.

Patterns spell out the Unicode classes, because the JVM's short classes cover ASCII only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from edulake.functions.lexicon import NUMBER_WORDS
from edulake.functions.numeric import round_exact

#: Unicode white space, as characters for trimming and as a class for patterns.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_\t-\r\x1c-\x1f \x85\p{Z}]"
HAN = "[\u4e00-\u9fff]"
NUMBER = r"\p{Nd}+\.?\p{Nd}*"
_HAN_WORD = re.compile("[\u4e00-\u9fff]+")


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.regexp_extract_all(text, F.lit(r"[^\t-\r\x1c-\x1f \x85\p{Z}]+"), F.lit(0))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """True when at least one needle occurs in the text."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def java_pattern(pattern: str) -> str:
    """Spell Unicode digits and spaces out, and let a dot match all but a line feed."""
    inside = pattern.replace(r"\d", r"\p{Nd}")
    return "(?d)" + inside.replace(r"\s", SPACE)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java_pattern(pattern))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """True when at least one pattern occurs: one pass over the text with all patterns as alternatives."""
    return matches(text, "|".join(f"(?:{pattern})" for pattern in patterns))


def count_matching(text: Column, patterns: Iterable[str]) -> Column:
    """How many of the patterns occur at least once."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + matches(text, pattern).cast("int")
    return total


def count_occurrences(text: Column, needles: Iterable[str]) -> Column:
    """Non-overlapping occurrences of every needle, summed, from the bytes that removing it saves."""
    total = F.lit(0)
    needles = list(needles)
    for needle in needles:
        removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
        total = total + (removed / F.lit(len(needle.encode()))).cast("int")
    if all(re.search(HAN, needle) for needle in needles):
        # A text without Han characters holds none of the words, which one look tells.
        return F.when(text.rlike(HAN), total).otherwise(F.lit(0))
    return total


def count_chars(text: Column, chars: str) -> Column:
    """Characters of the text that belong to ``chars``."""
    return F.regexp_count(text, F.lit("[" + "".join("\\" + c for c in chars) + "]"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it as often as ``body`` likes.

    Inside a lambda an outer expression is evaluated again for every element, so it has to be bound first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number_words(text: Column, numbers: Sequence[tuple[str, str]] = NUMBER_WORDS) -> Column:
    """Write number words as digits; pairs are applied in order."""
    mapped = text
    for word, digits in numbers:
        mapped = F.replace(mapped, F.lit(word), F.lit(digits))
    if all(_HAN_WORD.fullmatch(word) for word, _ in numbers):
        # Texts without Han characters hold none of the words.
        return F.when(text.rlike(HAN), mapped).otherwise(text)
    return mapped


def normalize_text(text: Column, numbers: Sequence[tuple[str, str]] = NUMBER_WORDS) -> Column:
    """Write number words as digits, collapse white space, blank out punctuation, strip."""
    text = F.regexp_replace(number_words(text, numbers), SPACE + "+", " ")
    return strip(F.regexp_replace(text, NON_WORD, " "))


def latin_runs(text: Column) -> Column:
    """Lower-case Latin runs, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def keywords(text: Column, latin: Column | None = None) -> Column:
    """Distinct Han runs and lower-case Latin runs of two characters or more."""
    han = F.regexp_extract_all(text, F.lit(HAN + "{2,}"), F.lit(0))
    latin = latin_runs(text) if latin is None else latin
    return F.array_distinct(F.concat(han, F.filter(latin, lambda w: F.length(w) > 1)))


def tokens(text: Column) -> Column:
    """Single Han characters, lower-case Latin runs and numbers, with repeats."""
    han = F.regexp_extract_all(text, F.lit(HAN), F.lit(0))
    return F.concat(han, latin_runs(text), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def normal_tokens(
    text: Column, numbers: Sequence[tuple[str, str]] = NUMBER_WORDS, latin: Column | None = None
) -> Column:
    """The tokens of the normalised text, without building that text.

    Normalising turns all but letters, digits and underscores into spaces. That changes no Han character and no
    Latin run, and of numbers it only cuts the decimal point. ``latin`` may hold the text's Latin runs when they
    are known already.
    """
    mapped = number_words(text, numbers)
    if latin is None or any(re.search("[A-Za-z]", word + digits) for word, digits in numbers):
        latin = latin_runs(mapped)
    return let(
        mapped,
        lambda m: F.concat(
            F.regexp_extract_all(m, F.lit(HAN), F.lit(0)),
            latin,
            F.regexp_extract_all(m, F.lit(r"\p{Nd}+"), F.lit(0)),
        ),
    )


def numbers(text: Column) -> Column:
    """Distinct numbers of the text, as written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def lettered(choices: Column) -> Column:
    """``A. first`` / ``B. second`` lines of a list of choices."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(". "), c.cast("string"))), "\n")


def letter(index: Column) -> Column:
    """0 becomes A, 1 becomes B, and so on."""
    return F.chr(F.lit(65) + index)


def literal_list(text: Column) -> Column:
    """Read a list that arrived as text such as ``['a', 'b']``."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def first_truthy(*values: Column) -> Column:
    """First value that is neither null nor empty text; the last value is kept as it is."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def first_present(*values: Column) -> Column:
    """First value that is not null."""
    return F.coalesce(*values)


def truthy(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def fixed(value: Column, digits: int, flags: str = "") -> Column:
    """The value with so many decimals."""
    return F.format_string(f"%{flags}.{digits}f", round_exact(value, digits))


def percent(value: Column) -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.concat(fixed(value * 100, 1), F.lit("%"))), F.lit("N/A"))


def signed(value: Column, digits: int = 4) -> Column:
    return fixed(value, digits, "+")


def bar(value: Column, width: int = 20) -> Column:
    """A text bar for a value between 0 and 1; a missing value gives an empty bar."""
    filled = F.least(F.greatest(F.floor(F.coalesce(value, F.lit(0.0)) * width).cast("int"), F.lit(0)), F.lit(width))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))

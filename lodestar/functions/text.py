"""Normalisation of recognised text and n-gram similarity as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters each script keeps, the languages and which of them are written in Latin letters.
KEEP = {"ja": "[ぁ-んァ-ヶー一-龯]", "ko": "[가-힣]", "zh": "[一-鿿]", "latin": "[a-z]"}
LANGUAGES = ("ja", "en", "de", "fr", "ko", "zh")
LATIN = ("en", "de", "fr")


def _marked_letters() -> tuple[str, str]:
    """Letters with marks that decompose to one of a-z, and those letters; from the Unicode tables."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, base) for c, base in pairs if c != base and c == c.lower() and "a" <= base <= "z"]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _marked_letters()


def script_of(lang: Column) -> Column:
    """Latin for languages written so, else the language's own code."""
    return F.when(lang.isin(*LATIN), "latin").otherwise(lang)


def is_language(code: Column) -> Column:
    return F.coalesce(code.isin(*LANGUAGES), F.lit(False))


def pick_language(saved: Column, browser: Column) -> Column:
    """The saved code if known, else the first browser language, by its first two letters, that is known, else en."""
    known = F.filter(F.transform(browser, lambda b: F.lower(F.substring(b, 1, 2))), is_language)
    return F.coalesce(F.when(is_language(saved), saved), F.get(known, F.lit(0)), F.lit("en"))


def normalise(text: Column, script: str) -> Column:
    """Only the characters of the script; Latin text in lower case, ß as ss, without marks."""
    if script == "latin":
        text = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _MARKED, _PLAIN)
        return F.regexp_replace(text, "[^a-z]", "")
    return F.array_join(F.regexp_extract_all(text, F.lit(KEEP[script]), F.lit(0)), "")


def grams(text: Column, n: int) -> Column:
    """All runs of n characters, in order."""
    count = F.length(text) - (n - 1)
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def dice_n(a: Column, b: Column, n: int) -> Column:
    """Dice coefficient of the n-gram bags; 0 if either is empty."""
    ga, gb = grams(a, n), grams(b, n)
    count = lambda g, x: F.size(F.filter(g, lambda y: y == x))
    both = F.aggregate(F.array_distinct(ga), F.lit(0), lambda acc, x: acc + F.least(count(ga, x), count(gb, x)))
    return F.when((F.size(ga) == 0) | (F.size(gb) == 0), 0.0).otherwise(2.0 * both / F.nullif(F.size(ga) + F.size(gb), F.lit(0)))


def dice(a: Column, b: Column) -> Column:
    """Bigram Dice, unigram if either text has fewer than two characters."""
    return F.when((F.length(a) >= 2) & (F.length(b) >= 2), dice_n(a, b, 2)).otherwise(dice_n(a, b, 1))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common beginning."""
    n = F.least(F.length(a), F.length(b))
    ok = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(n > 0, F.size(ok)).otherwise(0)


def filled(template: Column, params: dict[str, Column]) -> Column:
    """A message with each {name} replaced wherever it stands."""
    for name, value in params.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x.cast("double"))


def location_text(zone: Column, x: Column, y: Column) -> Column:
    return F.concat(zone, F.lit(" (X:"), one_decimal(x), F.lit(", Y:"), one_decimal(y), F.lit(")"))


def is_image_mime(kind: Column) -> Column:
    return F.startswith(kind, F.lit("image/"))

"""Text and number normalisation of vendor cells, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from girthline import vocab

_SEPARATORS = r"""[\s_\-/.,()\[\]{}'"`²°*:%]+"""


def _no_value() -> str:
    """Texts whose ``norm`` is one of ``NOT_AVAILABLE``, as one pattern that fails at the first other character."""
    gap = r"""[\s_\-/.,()\[\]{}'"`°*:%\x{a0}\x{2009}\x{202f}]"""

    def word(w: str) -> str:
        return "".join(f"[{x}{x.upper()}]" if x.isascii() and x.isalpha() else re.escape(x) for x in w)

    # A key has no separators but single spaces, so texts with others are no keys.
    keys = [t for t in vocab.NOT_AVAILABLE if t and not re.search(_SEPARATORS, t.replace(" ", ""))]
    return f"^{gap}*+(?:(?:" + "|".join(f"{gap}+".join(word(w) for w in k.split(" ")) for k in keys) + rf"){gap}*+)?\z"


_NO_VALUE = _no_value()
_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"


def swapped(c: Column, old: str, new: str) -> Column:
    """Single characters for others, like ``translate``; a text without any of them costs a byte search each."""
    for a, b in zip(old, new, strict=True):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def norm(c: Column) -> Column:
    """Comparison key of a header or value: compatibility forms folded, lower case, separators to one space."""
    folded = swapped(c, "²³¹   ", "231   ")
    return F.trim(F.regexp_replace(F.lower(folded), _SEPARATORS, " "))


def norm_plain(c: Column) -> Column:
    """The converter's key: as ``norm`` but a superscript is dropped, not folded."""
    return F.lower(F.trim(F.regexp_replace(c, _SEPARATORS, " ")))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def is_na(c: Column) -> Column:
    """A cell that carries no value. ``n/a`` does carry one here: its key is ``n a``."""
    return c.isNull() | c.rlike(_NO_VALUE)


def strict_number(c: Column) -> Column:
    """A plain decimal literal, or null."""
    # The cast reads nearly every literal; casting other texts would raise and catch an error for each row.
    found = F.nullif(F.regexp_extract(c, _NUMBER, 1), F.lit("")).try_cast("double")
    return F.when(c.rlike(_NUMBER), F.coalesce(c.try_cast("double"), found))


def to_float(c: Column) -> Column:
    """Reader number: a comma is the decimal sign only where there is no point; typographic minus allowed."""
    # A comma next to a point gives two points, which is no number.
    return strict_number(swapped(c, "−–,", "--."))


def to_int(c: Column) -> Column:
    """Reader integer: the nearest whole number, halves to even."""
    return F.bround(to_float(c), 0).try_cast("int")


def to_str(c: Column) -> Column:
    return F.when(~is_na(c), F.nullif(strip(c), F.lit("")))


def lenient_number(c: Column) -> Column:
    """Converter number: trailing percent, thousands separators and a lone decimal comma are accepted."""
    text = F.regexp_replace(c, r"[%\s]+$", "")
    text = F.regexp_replace(text, r"^(\s*-?\d+),(\d+)$", "$1.$2")
    # Commas left beside a point separate thousands.
    return strict_number(F.when(text.contains("."), F.replace(text, F.lit(","), F.lit(""))).otherwise(text))


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a fixed vocabulary, null where the key is not in it."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def invert(table: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """{code: texts} to {text: code}; the last code that lists a text wins."""
    return {text: code for code, texts in table.items() for text in texts}


def map_values(c: Column, mapping: Column) -> Column:
    """Vendor text to canonical text through a map keyed by ``norm_plain``; anything else passes."""
    return F.coalesce(F.try_element_at(mapping, norm_plain(c)), c)


def parse_date(c: Column) -> Column:
    """Date text in any of the eleven report formats, ordinal suffixes and commas ignored."""
    plain = F.regexp_replace(c, r"(?i)(\d+)(st|nd|rd|th)", "$1")
    plain = strip(F.regexp_replace(F.replace(plain, F.lit(","), F.lit(" ")), r"\s+", " "))
    formats = (
        "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "yyyy-M-d", "d-M-yyyy", "d/M/yyyy",
        "d-MMM-yyyy", "d-MMMM-yyyy", "d.M.yyyy", "yyyy.M.d",
    )
    return F.coalesce(*[F.try_to_date(plain, f) for f in formats])


def project_slug(name: Column, diameter_mm: Column) -> Column:
    """Project tag from a line name and its outer diameter, e.g. ``FFP_NorthRoad_IP-2_16in``.

    Of the name's words those before ``IPS`` and from the geometry or the word for the line on go, as do remarks in brackets. Words written in
    capitals get a capital first letter unless they are short codes.
    """
    words = F.filter(F.split(F.regexp_replace(name, r"\([^)]*\)", " "), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, ",+$", ""))
    sized = F.array_position(F.slice(bare, 1, 3), "IPS").cast("int")
    # Where the name ends: its geometry comes behind a comma.
    after_comma = lambda i: F.coalesce(F.get(words, i - 1).endswith(","), F.lit(False))
    ends = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (
        F.get(bare, i).isin("Pipeline", "section") & (i > 0) | F.get(bare, i).isin("OD", "L") & after_comma(i) | (i == F.size(words))))
    kept = F.slice(words, sized + 1, F.greatest(F.get(ends, F.lit(0)) - sized, F.lit(0)))

    def cased(word: Column) -> Column:
        letters = F.regexp_replace(word, "[^A-Za-z]", "")
        shouted = (F.length(letters) > 2) & (letters == F.upper(letters))
        return F.when(shouted, F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2))))).otherwise(word)

    plain = F.transform(kept, lambda w: F.regexp_replace(F.regexp_replace(cased(w), r"[^A-Za-z0-9_\-]", ""), r"^[\-]+|[\-_]+$", ""))
    slug = F.array_join(F.filter(plain, lambda w: w != ""), "_")
    inches = F.bround(diameter_mm / 25.4, 0).cast("int")
    tail = F.when(inches > 0, F.concat(F.lit("_"), inches.cast("string"), F.lit("in"))).otherwise(F.lit(""))
    return F.when(slug != "", F.concat(F.lit("FFP_"), slug, tail))

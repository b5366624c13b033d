"""Small column helpers shared by the extraction, rule and scoring expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flags for Java regular expressions: case-insensitive, Unicode classes, only "\n" ends a line.
NOCASE = "(?iUd)"
NOCASE_LINES = "(?iUdm)"
CASED = "(?Ud)"

NUMBER_IN_TEXT = r"[-+]?\d*\.?\d+"


def quoted(text: str) -> str:
    """Escape ``text`` for use inside a regular expression."""
    special = set(r"\.^$|?*+()[]{}&-#~")
    return "".join("\\" + ch if ch in special else ch for ch in text)


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """Group ``index`` of the first match, or null when there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def first_group(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[group(text, p) for p in patterns])


def not_blank(value: Column) -> Column:
    """``value`` unless it is null or only white space."""
    return F.when(F.trim(value) != "", value)


def no_zero(value: Column) -> Column:
    return F.when(value != 0, value)


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def keyed(mapping: dict) -> Column:
    """A literal map; use ``keyed({...})[column]``."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict, key: Column) -> Column:
    return F.try_element_at(keyed(mapping), key)


def first_true(pairs, otherwise=None) -> Column:
    """Value of the first condition that holds, in the given order."""
    chain = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if otherwise is None:
        return chain
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def number_in(text: Column) -> Column:
    """First signed number in a text (numbers held as text pass through)."""
    return group(text, NUMBER_IN_TEXT, 0).try_cast("double")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def lines_of(text: Column) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(
        F.transform(F.split(text, r"\r\n|[\n\r\u000B\u000C\u0085  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")),
        lambda x: x != "",
    )


def last_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def item(array: Column, index) -> Column:
    """Element at a 1-based index, null when out of range."""
    return F.try_element_at(array, index if isinstance(index, Column) else F.lit(index))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, for values that many branches look at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))

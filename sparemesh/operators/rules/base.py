"""Building blocks of the compatibility rules.

A rule is a column: an ordered list of (condition, outcome) in which the first hit counts. An
outcome is ``struct<tier,score,code,note>``; a filled ``code`` is a violation whose fixed texts are in
``violations.VIOLATIONS``. Property bags are ``map<string,string>`` with numbers and booleans as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.values import first_true, number_in

OUTCOME = "struct<tier:int,score:double,code:string,note:string>"
FALSE_TEXTS = ("", "false", "0", "0.0")


def outcome(tier: int, score, code: str | None = None, note=None) -> Column:
    def column(v, kind):
        return v.cast(kind) if isinstance(v, Column) else F.lit(v).cast(kind)

    return F.struct(
        F.lit(tier).cast("int").alias("tier"),
        column(score, "double").alias("score"),
        column(code, "string").alias("code"),
        column(note, "string").alias("note"),
    )


def same() -> Column:
    return outcome(1, 1.0)


def substitute(score) -> Column:
    return outcome(2, score)


def safe(score) -> Column:
    return outcome(1, score)


def reject(code: str, *note) -> Column:
    parts = [n if isinstance(n, Column) else F.lit(n) for n in note]
    return outcome(3, 0.0, code, F.concat_ws("", *parts) if parts else None)


def decide(*branches, otherwise: Column | None = None) -> Column:
    return first_true(branches, otherwise if otherwise is not None else same())


def position(ladder, value: Column) -> Column:
    """Zero-based place on a ladder, null when the value is not on it."""
    at = F.array_position(F.array(*[F.lit(x) for x in ladder]), value)
    return F.when(at > 0, at - 1)


class Side:
    """The query or the candidate of a pair."""

    def __init__(self, prefix: str, props: str = "props", bag: str | None = None):
        self.prefix = prefix
        self.bag_text = None if bag is None else F.col(prefix + bag)
        self.props = F.col(prefix + props)
        self.item_type = F.coalesce(F.col(prefix + "item_type"), F.lit(""))
        self.kind = F.upper(self.item_type)

    def column(self, name: str) -> Column:
        return F.col(self.prefix + name)

    def has(self, *keys: str) -> Column:
        out = None
        for key in keys:
            hit = F.coalesce(F.map_contains_key(self.props, F.lit(key)), F.lit(False))
            out = hit if out is None else out | hit
        return out

    def raw(self, key: str) -> Column:
        return F.try_element_at(self.props, F.lit(key))

    def filled(self, *keys: str) -> Column:
        """First of the values that counts as true (not blank, not zero, not false), else null."""
        return F.coalesce(*[F.when(~F.coalesce(F.lower(self.raw(k)), F.lit("")).isin(*FALSE_TEXTS), self.raw(k)) for k in keys])

    def flag(self, *keys: str) -> Column:
        return self.filled(*keys).isNotNull()

    def flag_or(self, key: str, default: bool) -> Column:
        """Truth of a value, with a default that counts only when the key is absent."""
        return F.when(self.has(key), self.flag(key)).otherwise(default)

    def text(self, *keys: str) -> Column:
        """Upper-case text of the first filled value, else an empty text."""
        return F.upper(F.coalesce(self.filled(*keys) if len(keys) > 1 else self.raw(keys[0]), F.lit("")))

    def first_present(self, *keys: str) -> Column:
        """Upper-case text of the first key that is present, even if it is blank."""
        return F.upper(
            F.coalesce(first_true([(self.has(k), F.coalesce(self.raw(k), F.lit(""))) for k in keys]), F.lit(""))
        )

    def number(self, *keys: str) -> Column:
        """A value that must be a number as a whole, else null."""
        value = self.filled(*keys) if len(keys) > 1 else self.raw(keys[0])
        return value.try_cast("double")

    def parsed(self, *keys: str) -> Column:
        """First number inside the first filled value."""
        value = self.filled(*keys) if len(keys) > 1 else self.raw(keys[0])
        return number_in(value)

    def bag(self) -> Column:
        """All keys and values as one text, for rules that search the whole bag."""
        return self.bag_text if self.bag_text is not None else bag_text(self.props)


def bag_text(props: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat_ws(" ", F.coalesce(F.map_keys(props), none), F.coalesce(F.map_values(props), none))


def has_text(text: Column, *words: str) -> Column:
    out = None
    for word in words:
        hit = text.contains(word)
        out = hit if out is None else out | hit
    return out

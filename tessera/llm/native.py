"""Small builders of JVM-side expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` any number of times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null text has none."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda inner: F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN)),
    )


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, characters: str) -> Column:
    """How often any of some characters occurs: a byte search for each, no regular expression."""

    def one(c: str) -> Column:
        fewer = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
        n_bytes = len(c.encode())
        return fewer if n_bytes == 1 else F.floor(fewer / n_bytes)

    parts = [one(c) for c in characters]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("long")


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name

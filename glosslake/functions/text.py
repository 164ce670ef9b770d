"""Sentences and small text functions, as Spark expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import WS

# Words before a full stop that don't end a sentence.
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "St", "Gen", "Fig", "Eq", "No", "Vol", "Sec", "Ch", "Art", "Ref", "pp", "p",
    "Inc", "Co", "Corp", "Ltd", "al", "vs", "etc", "cf", "ca", "e", "i",
)

#: A sentence's last character: ! or ?, or a full stop that ends neither an abbreviation nor an initial and isn't a short
#: decimal's point; then a capital, an opening bracket or quote, or the end of the text.
BOUNDARY = (
    r"(?:[!?]"
    rf"|(?<!(?<![A-Za-z])(?:{'|'.join(ABBREVIATIONS)}))"
    rf"(?<!(?<![A-Za-z])[A-Za-z](?=\.[{WS}]{{0,99}}[A-Z]))"
    r"\.(?!(?<=(?<![0-9])[0-9]{1,2}\.)[0-9]{1,3}(?![0-9])))"
    rf"(?=[{WS}]*(?:\z|[A-Z(\[\"'¿]))"
)


def sentences(text: Column) -> Column:
    """array<string>: the text cut after every boundary; white space stays where it is."""
    # The boundary's own character is put back by a mark that no text holds at this place: split just behind it.
    behind = rf"(?<=[.!?])(?<={BOUNDARY})"
    return F.filter(F.split(text, behind, -1), lambda s: s != "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def trimmed(text: Column) -> Column:
    """Without the dialect's white space at both ends."""
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")


def normalised(text: Column) -> Column:
    """The dedupe key: lower case, single spaces, no version suffix after a digit."""
    return F.regexp_replace(squeezed(F.lower(text)), r"([0-9])v[0-9]+\z", "$1")


def shortened(text: Column, limit: int = 80) -> Column:
    """A text of more than ``limit`` characters loses its end to an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("…"))).otherwise(text)


def display_id(category: Column, pattern_id: Column) -> Column:
    return F.concat_ws(".", category, F.element_at(F.split(pattern_id, r"\."), -1))


def safe_name(text: Column, limit: int = 80) -> Column:
    """Letters, digits, dash and underscore only."""
    return F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), 1, limit)


def fixed(x: Column, digits: int) -> Column:
    """A ratio between 0 and 1 with so many decimals, rounded from its exact binary value, an exact half to the even side.

    ``format_string`` rounds the shortest decimal that stands for the number, which may lie on the other side of a half.
    """
    # The number as a count of 2**-72, in two parts that are exact: a long, and what is left of a small number.
    unit, whole, long = F.lit(10**digits), F.lit(Decimal(2**72)), lambda c: c.cast("long")
    high = long(x * float(2**62))
    low = long((x * float(2**62) - high.cast("double")) * 1024.0)
    scaled = (high.cast("decimal(20,0)") * F.lit(Decimal(1024)) + low.cast("decimal(5,0)")) * unit.cast("decimal(5,0)")
    down = F.call_function("div", scaled, whole)
    twice = (scaled - down.cast("decimal(5,0)") * whole) * F.lit(2)
    up = (twice > whole) | ((twice == whole) & (down % 2 == 1))
    shown = down + up.cast("long")
    return F.concat(F.floor(shown / unit).cast("string"), F.lit("."), F.lpad((shown % unit).cast("string"), digits, "0"))

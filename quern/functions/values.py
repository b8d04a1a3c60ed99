"""Exact numbers and instants: what doesn't fit the declared shape is an error or null, never rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ticks of 100 ns between 0001-01-01 and 1970-01-01.
UNIX_TICKS = 621_355_968_000_000_000
_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,7})?(Z|[+-]\d{2}:\d{2})$"


def exact_decimal(lexeme: Column, precision: int, scale: int) -> Column:
    """Text as decimal(precision, scale); null where digits would be lost or don't fit."""
    kind = f"decimal({precision},{scale})"
    plain = lexeme.rlike(rf"^[+-]?\d+(\.\d{{0,{scale}}}0*)?$")  # no digit beyond the scale: a cast loses none
    wide = lexeme.try_cast("decimal(38,18)")
    narrow = wide.try_cast(kind)
    return F.when(plain, lexeme.try_cast(kind)).when(narrow.cast("decimal(38,18)") == wide, narrow)


def exact_integer(lexeme: Column, kind: str = "bigint") -> Column:
    """Text of an integer (a fraction of zeros counts) as int or bigint; null otherwise. Never by way of a double."""
    wide = lexeme.try_cast("decimal(38,18)")
    whole = wide.try_cast("decimal(20,0)")
    return F.when(whole.cast("decimal(38,18)") == wide, whole.try_cast(kind))


def ticks(instant: Column) -> Column:
    """Ticks of a timestamp."""
    return F.unix_micros(instant) * 10 + UNIX_TICKS


def instant(text: Column) -> Column:
    """An ISO instant with its offset as a timestamp, a seventh digit of its fraction cut off; null for anything else, as a zone would have to be guessed."""
    return F.when(text.rlike(_INSTANT), F.regexp_replace(text, r"(\.\d{6})\d", "$1").try_cast("timestamp"))


def ticks_of_text(text: Column) -> Column:
    """Ticks of an ISO instant with its offset and at most seven digits of fraction; null for anything else."""
    seventh = F.coalesce(F.regexp_extract(text, r"\.\d{6}(\d)", 1).try_cast("int"), F.lit(0))
    micros = F.regexp_replace(text, r"(\.\d{6})\d", "$1")
    return F.when(text.rlike(_INSTANT), F.unix_micros(micros.try_cast("timestamp")) * 10 + UNIX_TICKS + seventh)


def checked_sum(value: Column) -> Column:
    """Exact sum of 64-bit integers in a wider domain; a result that doesn't fit is an error."""
    return F.sum(value.cast("decimal(38,0)")).cast("bigint")

"""String comparison policies as Column expressions.

Ordinal order is that of UTF-16 code units, which differs from Spark's byte order above U+FFFF; keys are hexadecimal,
so their byte order is the order of what they stand for.
"""

from __future__ import annotations

import enum

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Policy(enum.Enum):
    ORDINAL = "ordinal"
    ASCII_IGNORE_CASE = "ascii ignore case"
    UNICODE_IGNORE_CASE = "unicode ignore case"


def ordinal_key(text: Column) -> Column:
    """Four upper-case hexadecimal digits for every UTF-16 code unit."""
    return F.hex(F.encode(text, "UTF-16BE"))


def fold_scalar(c: str) -> str:
    """The simple upper-case mapping of one character; a mapping to several characters leaves it as it is."""
    up = c.upper()
    return up if len(up) == 1 else c


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else "".join(map(fold_scalar, s)))


def fold(text: Column) -> Column:
    """Simple upper-casing of every character. ASCII texts stay in the JVM; only others go to Python."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.upper(text)).otherwise(_folded(text))


def comparison_key(text: Column, policy: Policy = Policy.ORDINAL) -> Column:
    """Equal keys mean equal under the policy, and keys order as the policy does. ASCII texts only, where the policy says so."""
    if policy is Policy.ORDINAL:
        return ordinal_key(text)
    if policy is Policy.ASCII_IGNORE_CASE:
        outside = F.raise_error(F.concat(F.lit("not printable ASCII: "), text)).cast("string")
        return F.when(text.isNull(), F.lit(None).cast("string")).when(text.rlike(r"^[ -~]*$"), ordinal_key(F.lower(text))).otherwise(outside)
    return F.hex(F.encode(fold(text), "UTF-32"))


def key_of(text: str, policy: Policy = Policy.ORDINAL) -> str:
    """The key of a literal, without a job."""
    if policy is Policy.ORDINAL:
        return text.encode("utf-16-be").hex().upper()
    if policy is Policy.ASCII_IGNORE_CASE:
        if not all(" " <= c <= "~" for c in text):
            raise ValueError(f"not printable ASCII: {text!r}")
        return text.lower().encode("utf-16-be").hex().upper()
    return "".join(map(fold_scalar, text)).encode("utf-32-be").hex().upper()


def lookup_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def contains_ignore_case(text: Column, part: str) -> Column:
    """Literal substring without regard to case; null for a null text."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def starts_ignore_case(text: Column, part: str) -> Column:
    return F.startswith(F.lower(text), F.lit(part.lower()))


def key_contains(key: Column, part_key: str, unit: int) -> Column:
    """Substring of keys on unit boundaries (4 digits for UTF-16 units, 6 or 8 for scalars)."""
    if not part_key:
        return key.isNotNull()
    marked = F.regexp_replace(key, f"(.{{{unit}}})", "|$1")
    return F.contains(F.concat(marked, F.lit("|")), F.lit("|" + "|".join(part_key[i : i + unit] for i in range(0, len(part_key), unit)) + "|"))


def key_unit(policy: Policy) -> int:
    return 8 if policy is Policy.UNICODE_IGNORE_CASE else 4

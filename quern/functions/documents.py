"""Members of JSON documents."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands before the digits of a number while its document is an object; a private character.
_MARK = "\ue000"
_NUMBER = re.compile(f'"{_MARK}([^"]*)"')


def with_member(document: str, path: str, value: object) -> str:
    """The document with value at the dotted path, objects made where there are none. Other numbers keep their digits."""
    keep = _MARK not in document
    held = json.loads(document, parse_float=(lambda x: _MARK + x) if keep else float)
    if not isinstance(held, dict):
        return document
    *parents, last = path.split(".")
    at = held
    for key in parents:
        if not isinstance(at.get(key), dict):
            at[key] = {}
        at = at[key]
    at[last] = value
    out = json.dumps(held, separators=(",", ":"), ensure_ascii=False)
    return _NUMBER.sub(r"\1", out) if keep else out


def set_member(document: Column, path: str, value: object) -> Column:
    """with_member of every document; nulls stay. Only rows that are changed should be handed over, as they go to Python."""
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat()
    if isinstance(value, decimal.Decimal):
        value = _MARK + str(value)

    @F.pandas_udf("string")
    def put(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else with_member(d, path, value))

    return put(document)

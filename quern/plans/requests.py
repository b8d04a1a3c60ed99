"""Requests, fingerprints and continuation tokens."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import hashlib
import json
from dataclasses import dataclass

from quern.plans.declarations import Declared, Op, Paging, Query, Unit

PREFIX, MAX_TOKEN = "qk1.", 16 * 1024


@dataclass(frozen=True)
class Compare:
    path: str
    op: Op
    value: object = None


#: All clauses must hold; of a clause, any comparison. No clause matches all rows, an empty clause none.
Filter = tuple[tuple[Compare, ...], ...]


@dataclass(frozen=True)
class Request:
    query: str
    where: Filter = ()
    order: tuple[tuple[str, bool], ...] | None = None
    skip: int = 0
    take: int | None = None
    after: str | None = None


def resolve_order(query: Query, asked: tuple[tuple[str, bool], ...] | None) -> tuple[tuple[str, bool], ...]:
    """The declared order, of which what is asked must be a beginning."""
    if asked and tuple(asked) != query.order[: len(asked)]:
        raise Declared(f"{query.name}: the order must be a beginning of the declared one")
    return query.order


def check(unit: Unit, request: Request) -> Query:
    """The declared query, if the request fits it."""
    query = unit.query(request.query)
    for clause in request.where:
        if len(clause) > 1 and not query.disjunction:
            raise Declared(f"{query.name}: alternatives are not declared")
        for c in clause:
            if c.op not in query.predicates.get(c.path, ()):
                raise Declared(f"{query.name}: {c.op.value} is not declared for {c.path}")
            if c.op is Op.HAS_ALL and not c.value:
                raise Declared(f"{query.name}: has all needs values")
    restricted = {c.path for clause in request.where for c in clause}
    if query.required - restricted:
        raise Declared(f"{query.name}: {', '.join(sorted(query.required - restricted))} must be restricted")
    if request.after is not None and query.paging is not Paging.CURSOR:
        raise Declared(f"{query.name}: no cursor is declared")
    if request.skip and query.paging is not Paging.OFFSET:
        raise Declared(f"{query.name}: no offset is declared")
    if request.skip < 0 or (request.take is not None and not 0 <= request.take <= query.max_take):
        raise Declared(f"{query.name}: skip and take must be from 0 to {query.max_take}")
    resolve_order(query, request.order)
    return query


def _plain(v: object) -> object:
    if isinstance(v, (dt.datetime, dt.date)):
        return {"t": v.isoformat()}
    if isinstance(v, decimal.Decimal):
        return {"n": str(v)}
    if isinstance(v, (bytes, bytearray)):
        return {"b": base64.b64encode(bytes(v)).decode()}
    return v


def _back(v: object) -> object:
    if not isinstance(v, dict):
        return v
    (k, x), *_ = v.items()
    return dt.datetime.fromisoformat(x) if k == "t" else decimal.Decimal(x) if k == "n" else base64.b64decode(x)


def fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, default=lambda x: _plain(x) if _plain(x) is not x else str(x), sort_keys=True).encode()).hexdigest()


def request_fingerprint(unit: Unit, request: Request, scope: str | None) -> str:
    """Alike for alternatives and members in any order. The declared order is part of it, as boundaries are values of it."""
    where = sorted(sorted([c.path, c.op.value, sorted(map(repr, c.value)) if isinstance(c.value, (list, tuple)) else repr(c.value)] for c in clause) for clause in request.where)
    return fingerprint(unit.name, request.query, unit.query(request.query).order, where, scope)


def encode_token(bound_to: str, values: list[object]) -> str:
    body = json.dumps({"f": bound_to, "v": [_plain(v) for v in values]}, separators=(",", ":")).encode()
    token = PREFIX + base64.urlsafe_b64encode(body + hashlib.sha256(body).digest()).decode().rstrip("=")
    if len(token) > MAX_TOKEN:
        raise Declared("the continuation token is too long")
    return token


def decode_token(token: str, bound_to: str) -> list[object]:
    """The boundary's values, if the token is whole and belongs to this query, filter and scope."""
    try:
        if not token.startswith(PREFIX) or len(token) > MAX_TOKEN:
            raise ValueError
        raw = base64.urlsafe_b64decode(token[len(PREFIX) :] + "=" * (-(len(token) - len(PREFIX)) % 4))
        body, digest = raw[:-32], raw[-32:]
        if hashlib.sha256(body).digest() != digest:
            raise ValueError
        held = json.loads(body)
    except ValueError as e:
        raise Declared("not a continuation token") from e
    if held["f"] != bound_to:
        raise Declared("the continuation token belongs to another query")
    return [_back(v) for v in held["v"]]

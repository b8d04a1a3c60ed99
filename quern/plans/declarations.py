"""What an application declares: document units with typed fields and closed queries, and record streams."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

from quern.functions.text import Policy


class Type(enum.Enum):
    STRING = "string"
    INT32 = "int"
    INT64 = "bigint"
    DECIMAL = "decimal"
    BOOLEAN = "boolean"
    DATETIME = "timestamp"
    GUID = "guid"
    BINARY = "binary"
    JSON = "json"


class Op(enum.Enum):
    EQUAL = "equal"
    NOT_EQUAL = "not equal"
    IN = "in"
    CONTAINS = "contains"
    NOT_CONTAINS = "not contains"
    STARTS_WITH = "starts with"
    GREATER = "greater"
    GREATER_EQUAL = "greater or equal"
    LESS = "less"
    LESS_EQUAL = "less or equal"
    HAS = "has"
    HAS_ALL = "has all"


class Paging(enum.Enum):
    NONE = "none"
    OFFSET = "offset"
    CURSOR = "cursor"


_EQUALITY = {Op.EQUAL, Op.NOT_EQUAL, Op.IN}
_TEXT = {Op.CONTAINS, Op.NOT_CONTAINS, Op.STARTS_WITH}
_RANGE = {Op.GREATER, Op.GREATER_EQUAL, Op.LESS, Op.LESS_EQUAL}
_MEMBER = {Op.HAS, Op.HAS_ALL}
_ORDERED = {Type.STRING, Type.INT32, Type.INT64, Type.DECIMAL, Type.DATETIME}


def operations(kind: Type, collection: bool = False) -> set[Op]:
    """What a type can be asked."""
    if collection:
        return set() if kind is Type.JSON else set(_MEMBER)
    return _EQUALITY | (_TEXT if kind is Type.STRING else set()) | (_RANGE if kind in _ORDERED else set())


@dataclass(frozen=True)
class Field:
    """A typed column of a unit. unique: no two documents of a scope share a value; nulls don't count."""

    path: str
    type: Type
    collection: bool = False
    unique: bool = False
    length: int | None = None
    precision: int = 18
    scale: int = 0


def sql_type(f: Field) -> str:
    """The SQL type of a field's values, or of its members."""
    return f"decimal({f.precision},{f.scale})" if f.type is Type.DECIMAL else "string" if f.type in (Type.GUID, Type.JSON) else f.type.value


@dataclass(frozen=True)
class Query:
    """A closed query. predicates: allowed operations by path; required: paths that every request must restrict."""

    name: str
    predicates: dict[str, frozenset[Op]] = field(default_factory=dict)
    order: tuple[tuple[str, bool], ...] = ()  # (path, descending)
    paging: Paging = Paging.OFFSET
    required: frozenset[str] = frozenset()
    disjunction: bool = False
    latest_key: str | None = None
    max_take: int = 1000


@dataclass(frozen=True)
class NoReferences:
    """Holds for a row whose id no row of the unit has in its reference field."""

    unit: str
    reference: str


@dataclass(frozen=True)
class RelatedNotEqual:
    """Holds for a row whose reference field is the id of a row of the unit with another value in the path (null is another one)."""

    reference: str
    unit: str
    path: str
    value: object


Guard = NoReferences | RelatedNotEqual


@dataclass(frozen=True)
class Mutation:
    """A declared bulk change of the rows that a query selects. sources: only rows with these values move to the target.

    guards: a deletion leaves the rows for which one of them doesn't hold.
    """

    name: str
    query: str
    action: str  # delete, assign or transition
    path: str | None = None
    value: object = None
    sources: tuple = ()
    guards: tuple[Guard, ...] = ()


@dataclass(frozen=True)
class Unit:
    name: str
    fields: tuple[Field, ...]
    queries: tuple[Query, ...] = ()
    mutations: tuple[Mutation, ...] = ()
    scoped: bool = False
    id_policy: Policy = Policy.ORDINAL
    append_only: bool = False

    def field(self, path: str) -> Field:
        found = next((f for f in self.fields if f.path == path), None)
        if found is None:
            raise ValueError(f"{self.name} has no field {path}")
        return found

    def query(self, name: str) -> Query:
        found = next((q for q in self.queries if q.name == name), None)
        if found is None:
            raise ValueError(f"{self.name} declares no query {name}")
        return found

    def mutation(self, name: str) -> Mutation:
        found = next((m for m in self.mutations if m.name == name), None)
        if found is None:
            raise ValueError(f"{self.name} declares no mutation {name}")
        return found


@dataclass(frozen=True)
class Problem:
    at: str
    what: str


def problems(unit: Unit) -> list[Problem]:
    """Everything that is wrong with a declaration, found before any query runs."""
    out: list[Problem] = []
    paths = [f.path for f in unit.fields]
    out += [Problem(p, "declared twice") for p in sorted({p for p in paths if paths.count(p) > 1})]
    out += [Problem(f.path, "a collection of JSON") for f in unit.fields if f.collection and f.type is Type.JSON]
    out += [Problem(f.path, "a unique collection") for f in unit.fields if f.collection and f.unique]
    out += [Problem(f.path, "scale outside precision") for f in unit.fields if f.type is Type.DECIMAL and not 0 <= f.scale <= f.precision <= 38]
    known = {f.path: f for f in unit.fields}
    for q in unit.queries:
        for path, ops in q.predicates.items():
            if path == "id":
                bad = ops & {Op.CONTAINS, Op.NOT_CONTAINS, *_MEMBER}
            elif path not in known:
                out.append(Problem(f"{q.name}.{path}", "no such field"))
                continue
            else:
                bad = set(ops) - operations(known[path].type, known[path].collection)
            out += [Problem(f"{q.name}.{path}", f"can't be asked {op.value}") for op in sorted(bad, key=lambda x: x.value)]
        out += [Problem(f"{q.name}.{p}", "can't be ordered by") for p, _ in q.order if p not in known or known[p].collection or known[p].type not in _ORDERED | {Type.BOOLEAN}]
        out += [Problem(f"{q.name}.{p}", "required but no predicate") for p in sorted(q.required - set(q.predicates))]
        if q.latest_key and (not q.order or q.order[0][0] != q.latest_key):
            out.append(Problem(q.name, "the key of latest-per-key must lead the order"))
        if q.latest_key and q.paging is Paging.CURSOR:
            out.append(Problem(q.name, "latest-per-key can't be paged by cursor"))
    names = {q.name: q for q in unit.queries}
    for m in unit.mutations:
        q = names.get(m.query)
        if q is None:
            out.append(Problem(m.name, "no such query"))
            continue
        if not q.predicates:
            out.append(Problem(m.name, "a mutation must select by a predicate"))
        if any(known[p].collection for p in q.predicates if p in known):
            out.append(Problem(m.name, "a mutation can't select by membership"))
        if m.action != "delete" and m.path not in known:
            out.append(Problem(m.name, "no field to change"))
        if m.guards and m.action != "delete":
            out.append(Problem(m.name, "only deletions are guarded"))
        out += [Problem(f"{m.name}.{g.reference}", "no field that can refer") for g in m.guards if isinstance(g, RelatedNotEqual) and (g.reference not in known or known[g.reference].type is not Type.STRING or known[g.reference].collection)]
        if m.action == "transition" and (not m.sources or m.value in m.sources):
            out.append(Problem(m.name, "a transition needs sources other than its target"))
    return out


class Declared(ValueError):
    """A declaration or a request that doesn't fit its declaration."""


def admitted(unit: Unit) -> Unit:
    found = problems(unit)
    if found:
        raise Declared("; ".join(f"{p.at}: {p.what}" for p in found))
    return unit


def compose(*groups: tuple[Unit, ...]) -> tuple[Unit, ...]:
    """The units of several owners together; no two may share a name, and guards must name units and fields among them."""
    units = tuple(u for g in groups for u in g)
    names = [u.name for u in units]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise Declared(f"declared twice: {', '.join(twice)}")
    known = {u.name: u for u in units}
    for u in units:
        for g in (g for m in u.mutations for g in m.guards):
            if g.unit not in known:
                raise Declared(f"{u.name}: no unit {g.unit} for a guard")
            f = known[g.unit].field(g.reference if isinstance(g, NoReferences) else g.path)
            if f.collection or isinstance(g, NoReferences) and f.type is not Type.STRING:
                raise Declared(f"{u.name}: {g.unit}.{f.path} can't guard")
            if known[g.unit].scoped and not u.scoped:
                raise Declared(f"{u.name}: a global unit can't be guarded by a scoped one")
    return tuple(map(admitted, units))


@dataclass(frozen=True)
class StreamField:
    name: str
    type: Type
    multiple: bool = False
    policy: Policy = Policy.ORDINAL
    orderable: bool = False
    latest: bool = False


@dataclass(frozen=True)
class Reducer:
    """kind: min_instant, max_instant, sum, max, union or first; order: (field, descending) for first."""

    alias: str
    kind: str
    source: str
    order: tuple[str, bool] | None = None


@dataclass(frozen=True)
class Profile:
    """A declared grouped reduction of a stream: of its input_limit newest records, or of all if that is None."""

    name: str
    group: str
    reducers: tuple[Reducer, ...]
    orderable: frozenset[str] = frozenset()
    input_limit: int | None = None
    max_take: int = 100
    max_union: int = 1000


@dataclass(frozen=True)
class Stream:
    """A record stream. Records have cursor (long), record_id, occurred_at, and a column for every field."""

    name: str
    fields: tuple[StreamField, ...]
    profiles: tuple[Profile, ...] = ()
    max_limit: int = 1000
    max_nodes: int = 64
    max_values: int = 256
    max_batch: int = 100_000
    high_water: str | None = None

    def field(self, name: str) -> StreamField:
        if name == OCCURRED:
            return StreamField(OCCURRED, Type.DATETIME, orderable=True)
        found = next((f for f in self.fields if f.name == name), None)
        if found is None:
            raise Declared(f"{self.name} has no field {name}")
        return found


OCCURRED = "occurred_at"

"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, which a template writes.

A layout is named by the nested paths of its fields. The fingerprint of a record is the hash of those of its paths
that any layout knows, so that other fields don't matter; it selects the layout's mapping to (conv_id, turn, role,
text). The template is "### Role: text</turn>" and a line feed for every turn. Backslashes, "#" and "</turn>" inside
texts are escaped, so neither mark occurs in a text and the escape is reversible.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import small_batches, stage

#: Fixed values of the template.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """paths: the fields; rows: (role, path) of flat texts in order, or of one array of messages its role and text fields."""

    name: str
    paths: tuple[str, ...]
    flat: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Roles as other layouts name them.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Layout("prompt and response", ("prompt", "response"), flat=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", ("prompt", "completion"), flat=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system, prompt and response", ("system", "prompt", "response"), flat=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction and output", ("instruction", "output"), flat=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction, input and output", ("instruction", "input", "output"), flat=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question and answer", ("question", "answer"), flat=(("user", "question"), ("assistant", "answer"))),
)
BY_FINGERPRINT = {x.fingerprint: x for x in LAYOUTS}
KNOWN = sorted({p for x in LAYOUTS for p in x.paths})
_TURNS = "conv_id long, turn long, role string, text string"


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested paths of a schema's leaves; arrays as []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def layout_of(df: DataFrame) -> Layout | None:
    """The layout of a typed table, by the fingerprint of its schema."""
    return BY_FINGERPRINT.get(fingerprint([p for p in schema_paths(df.schema) if p in KNOWN]))


def _turns(df: DataFrame, layout: Layout, conv_id: Column) -> DataFrame:
    if layout.messages:
        array, role, text = layout.messages
        rows = df.select(conv_id.alias("conv_id"), F.posexplode(array).alias("turn", "m"))
        rows = rows.select("conv_id", "turn", F.col(f"m.{role}").alias("role"), F.col(f"m.{text}").alias("text"))
    elif layout.flat:
        parts = F.array(*[F.struct(F.lit(r).alias("role"), F.col(p).alias("text")) for r, p in layout.flat])
        rows = df.select(conv_id.alias("conv_id"), F.posexplode(parts).alias("turn", "m")).select("conv_id", "turn", "m.role", "m.text")
    else:
        rows = df.select(conv_id.alias("conv_id"), "turn", "role", "text")
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    role = F.coalesce(names[F.col("role")], F.col("role"), F.lit("")) if layout.messages else F.coalesce("role", F.lit(""))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a typed table in a known layout. Null roles and texts become empty; an unknown layout is an error."""
    layout = layout_of(df)
    if layout is None:
        raise ValueError(f"no layout has the paths {[p for p in schema_paths(df.schema) if p in KNOWN]}")
    return _turns(df, layout, F.col(id_col))


def json_fingerprints(records: DataFrame, json_col: str) -> DataFrame:
    """records with the column fingerprint: of the known paths that each JSON object has; null if it is no object.

    Of an array, the paths of all its elements count, those that any layout's messages have. An element without any,
    or one that is no object, adds a path that no layout knows: nothing in it could be kept.
    """
    doc = F.col(json_col)
    paths = F.json_object_keys(doc)
    nested = F.array(*[F.lit(k) for k in sorted({k for x in LAYOUTS if x.messages for k in x.messages[1:]})])
    for array in sorted({x.messages[0] for x in LAYOUTS if x.messages}):
        lead = F.lit(f"{array}[].")
        elements = F.from_json(F.get_json_object(doc, f"$.{array}"), "array<string>")
        own = lambda e: F.coalesce(F.array_intersect(F.json_object_keys(e), nested), F.array().cast("array<string>"))  # noqa: B023, E731
        named = F.transform(elements, lambda e: F.when(F.size(own(e)) > 0, own(e)).otherwise(F.array(F.lit(""))))  # noqa: B023
        paths = F.concat(paths, F.coalesce(F.transform(F.array_distinct(F.flatten(named)), lambda k: F.concat(lead, k)), F.array().cast("array<string>")))  # noqa: B023
    top, inner = F.array(*[F.lit(p) for p in KNOWN]), F.filter(paths, lambda p: F.contains(p, F.lit("[].")))
    known = F.array_sort(F.array_distinct(F.concat(F.array_intersect(paths, top), inner)))
    return records.withColumn("fingerprint", F.when(paths.isNotNull(), F.sha2(F.concat_ws("\n", known), 256)))


def canonical_turns_json(records: DataFrame, json_col: str, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(turns, records of no known layout with their fingerprint) of records in any mix of layouts.

    A record is parsed once, by the union of the layouts' fields. Messages that mix the fields of several layouts, or
    hold an element with none, make their record one of no known layout; a missing field beside a known one is empty.
    """
    marked = json_fingerprints(records, json_col)
    arrays = {x.messages for x in LAYOUTS if x.messages}
    flat = sorted({p for x in LAYOUTS if not x.messages for p in x.paths})
    kind = ", ".join([f"`{p}` string" for p in flat] + [f"`{a}` array<struct<`{r}`: string, `{t}`: string>>" for a, r, t in sorted(arrays)])
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    turn = lambda at, role, text: F.struct(at.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    found = None
    for layout in LAYOUTS:
        j = lambda p: F.col("_json")[p]
        if layout.messages:
            array, role, text = layout.messages
            made = F.transform(j(array), lambda m, i: turn(i, F.coalesce(names[m[role]], m[role]), m[text]))  # noqa: B023
        elif layout.flat:
            made = F.array(*[turn(F.lit(i), F.lit(r), j(p)) for i, (r, p) in enumerate(layout.flat)])
        else:
            made = F.array(turn(j("turn"), j("role"), j("text")))
        own = F.col("fingerprint") == layout.fingerprint
        found = F.when(own, made) if found is None else found.when(own, made)
    parsed = marked.select(F.col(id_col).cast("long").alias("conv_id"), "fingerprint", F.from_json(json_col, kind).alias("_json"))
    turns = parsed.select("conv_id", F.explode(found).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")
    return turns, marked.filter(F.coalesce(~F.col("fingerprint").isin([x.fingerprint for x in LAYOUTS]), F.lit(True)))


def escape(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, piece, loss_start, loss_chars: a row per turn. The pieces of a conversation by turn, ties by piece, are its text.

    The loss mask covers loss_chars code points from loss_start of the piece: the escaped text of an assistant's turn.
    Other roles than the known ones are written after "=", with their colons escaped.
    """
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    name = F.coalesce(names[F.col("role")], F.concat(F.lit("="), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:"))))
    head, body = F.concat(F.lit(OPEN), name, F.lit(COLON)), escape(F.col("text"))
    learn = F.col("role") == LOSS_ROLE
    return turns.select(
        "conv_id",
        "turn",
        F.concat(head, body, F.lit(CLOSE)).alias("piece"),
        F.when(learn, F.length(head)).otherwise(0).cast("long").alias("loss_start"),
        F.when(learn, F.length(body)).otherwise(0).cast("long").alias("loss_chars"),
    )


_PIECE = re.compile(rf"{re.escape(OPEN)}((?:\\.|[^\\:])*){re.escape(COLON)}(.*){re.escape(CLOSE)}", re.S)
_ROLES = {v: k for k, v in NAMES.items()}


def parse_piece(piece: str) -> tuple[str, str]:
    """The role and the text of a formatted turn."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError("not a formatted turn")
    name, body = found.groups()
    return (unescape(name[1:]) if name.startswith("=") else _ROLES[name]), unescape(body)


def digest_pieces(pieces: DataFrame) -> DataFrame:
    """A row per conversation, from its pieces alone; the hashes run over the sorted pieces, of which few are held at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, n, chars, loss, turns_hash, loss_hash, done = (), 0, 0, 0, None, None, []
        close = lambda: done.append((now[0], n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))
        for b in batches:
            for conv, piece, start, length in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if now != (conv,):
                    if now:
                        close()
                    now, n, chars, loss, turns_hash, loss_hash = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = parse_piece(piece)
                learnt = unescape(piece[start : start + length])
                turns_hash.update(f"{role}\n{text}\n".encode())
                loss_hash.update(learnt.encode())
                n, chars, loss = n + 1, chars + len(piece), loss + len(learnt)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done.clear()
        if now:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    small_batches(pieces.sparkSession)
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").select("conv_id", "piece", "loss_start", "loss_chars")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_and_digest(conversations: DataFrame) -> DataFrame:
    """Writes the formatted pieces of a table in a known layout and digests them as read back.

    Turns go by turn, nulls first, ties by role and text as formatted; repeated rows are turns of their own. Null texts
    and roles are empty; rows with a null conv_id are one conversation. No rows give no rows. A conversation's hashes
    run through one task, which holds a batch of its turns at a time.
    """
    return digest_pieces(stage(format_turns(canonical_turns(conversations)), "chat-pieces"))


#: Fixed value: a conversation whose texts hold the template's own marks.
PLANTED_ID, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    rows = [(PLANTED_ID, 0, "user", PLANTED_TEXT), (PLANTED_ID, 1, "assistant", PLANTED_TEXT)]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(conversations.sparkSession.createDataFrame(rows, _TURNS))

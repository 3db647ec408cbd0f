"""Chat formatting: heterogeneous conversation layouts become canonical turns, turns become text.

A layout is a declarative mapping with the field paths it needs. The paths of a table's schema, or of
one JSON record, are cut to those that some layout knows and hashed; the hash selects the layout. Where
extra fields spoil the hash, the layout with the most paths that are all there is taken, the first of
equals. Other fields are left alone.

The text of a conversation is its pieces in order, one for each turn: start marker, role, line break,
text, end marker, line break. A control string inside a text gets a backslash behind its first
character, one more than it has already, so the text comes back exactly. The loss mask of a piece is
the range of code points of an assistant's (escaped) text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
# The markers of the template and of other common ones, first character and rest.
FIRST_CHARACTERS = r"[<\[]"
RESTS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\]"
_PLAIN = rf"({FIRST_CHARACTERS})(\\*)({RESTS})"
_ESCAPED = re.compile(rf"({FIRST_CHARACTERS})\\(\\*)({RESTS})")


@dataclass(frozen=True)
class Layout:
    """``rows``: one row is one turn, with the paths of number, role and text. ``messages``: paths of a
    list, and of role and text in its elements. ``fields``: (role, paths) in the order of the turns;
    the texts of several paths are parted by an empty line, absent ones left out."""

    name: str
    rows: tuple[str, str, str] | None = None
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> frozenset[str]:
        if self.rows:
            return frozenset(self.rows)
        if self.messages:
            name, role, text = self.messages
            return frozenset({f"{name}[].{role}", f"{name}[].{text}"})
        return frozenset(p for _, paths in self.fields for p in paths) - set(self.optional)

    def fingerprints(self) -> Iterator[str]:
        for chosen in range(1 << len(self.optional)):
            extra = {p for i, p in enumerate(self.optional) if chosen >> i & 1}
            yield fingerprint(self.paths | extra)


LAYOUTS = (
    Layout("turn rows", rows=("turn", "role", "text")),
    Layout("messages", messages=("messages", "role", "content")),
    Layout(
        "from and value", messages=("conversations", "from", "value"),
        roles={"human": "user", "gpt": "assistant"},
    ),
    Layout(
        "instruction", optional=("input", "system"),
        fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout(
        "prompt and response", optional=("system",),
        fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
    ),
    Layout("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question and answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def schema_paths(kind: T.DataType, path: str = "") -> set[str]:
    """The field paths of a schema: ``a``, ``a.b``, ``a[].b``."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in schema_paths(f.dataType, f"{path}.{f.name}" if path else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{path}[]")
    return {path}


def value_paths(value: object, path: str = "") -> set[str]:
    """The same of one JSON value; nulls are absent."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{path}.{k}" if path else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{path}[]")}
    return set() if value is None else {path}


def select_layout(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout of a set of paths, by the hash of those that any layout knows."""
    known = set().union(*(x.paths | set(x.optional) for x in layouts))
    index = {h: x for x in reversed(layouts) for h in x.fingerprints()}
    found = index.get(fingerprint(paths & known))
    fitting = [x for x in layouts if x.paths <= paths]
    return found or max(fitting, key=lambda x: len(x.paths), default=None)


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n\n")


def canonical_turns(df: DataFrame, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, turn, role, text) of a table in any of the layouts; raises ValueError for others.

    A null role or text is empty. Fields that are null make no turn; a null or empty list has none.
    """
    paths = schema_paths(df.drop(key).schema)
    layout = select_layout(paths, layouts)
    if layout is None:
        raise ValueError(f"no layout has all its paths among {sorted(paths)}")
    empty = F.lit("")
    if layout.rows:
        turn, role, text = (F.col(c) for c in layout.rows)
        out = df.select(key, turn.alias("turn"), role.alias("role"), text.alias("text"))
    elif layout.messages:
        name, role, text = layout.messages
        out = df.select(key, F.posexplode(name).alias("turn", "_m")).select(
            key, "turn", F.col("_m").getField(role).alias("role"), F.col("_m").getField(text).alias("text")
        )
    else:
        there = [(r, [F.col(p) for p in ps if p in paths]) for r, ps in layout.fields]
        turns = [
            F.when(F.coalesce(*columns).isNotNull(), F.struct(F.lit(r).alias("role"), _joined(columns).alias("text")))
            for r, columns in there if columns
        ]
        present = F.filter(F.array(*turns), lambda t: t.isNotNull())
        out = df.select(key, F.posexplode(present).alias("turn", "_t")).select(key, "turn", "_t.role", "_t.text")
    role = F.coalesce("role", empty)
    for given, meant in layout.roles.items():
        role = F.when(F.col("role") == given, meant).otherwise(role)
    return out.select(key, F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", empty).alias("text"))


def _value_turns(value: dict, layout: Layout) -> list[tuple[str, str]]:
    if layout.rows:
        _, role, text = layout.rows
        return [(str(value[role]), str(value[text]))]
    if layout.messages:
        name, role, text = layout.messages
        found = [((m or {}).get(role), (m or {}).get(text)) for m in value[name]]
        return [(layout.roles.get(r, r or ""), "" if t is None else str(t)) for r, t in found]
    out = []
    for role, paths in layout.fields:
        parts = [str(value[p]) for p in paths if value.get(p) is not None]
        if parts:
            out.append((role, "\n\n".join(parts)))
    return out


def canonical_json_turns(df: DataFrame, key: str, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, turn, role, text) of JSON records of mixed layouts. A record that is null, no JSON
    object or of no known layout gives one row with a null layout, turn, role and text."""
    kind = df.schema[key].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[frozenset[str], Layout | None] = {}
        for rows in batches:
            at: list[int] = []
            out: list[tuple[str | None, int | None, str | None, str | None]] = []
            for i, raw in enumerate(rows.column(1).to_pylist()):
                try:
                    value = json.loads(raw) if raw else None
                except ValueError:
                    value = None
                layout = None
                if isinstance(value, dict):
                    paths = frozenset(value_paths(value))
                    if paths not in chosen:
                        chosen[paths] = select_layout(set(paths), layouts)
                        if len(chosen) > 10_000:
                            chosen = {paths: chosen[paths]}
                    layout = chosen[paths]
                turns = _value_turns(value, layout) if layout else [(None, None)]
                at += [i] * len(turns)
                out += [(layout and layout.name, n if layout else None, r, t) for n, (r, t) in enumerate(turns)]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.string()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                [key, "layout", "turn", "role", "text"],
            )

    return df.select(key, column).mapInArrow(
        convert, f"`{key}` {kind}, layout string, turn long, role string, text string"
    )


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _escaped_role(role: Column) -> Column:
    """A role in one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def format_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, piece, loss_start, loss_end): the formatted text of each turn and its part under the
    loss mask, in code points of the piece; both are 0 for turns of others than the assistant.

    The pieces of a conversation follow one another in a partition, ordered by turn (nulls first),
    role and text, so that a conversation of any length can be read as a stream. Rows without a key
    are one conversation; repeated rows are turns of their own; an empty table has no pieces.
    """
    ordered = turns.select(key, "turn", "role", "text").repartition(key).sortWithinPartitions(
        key, F.col("turn").asc_nulls_first(), "role", "text"
    )
    parts = ordered.select(
        key, "turn", (F.col("role") == "assistant").alias("_own"), _escaped_role(F.col("role")).alias("_role"),
        escaped(F.col("text")).alias("_text"),
    )
    start = F.length("_role") + len(START) + 1
    none = F.lit(0)
    return parts.select(
        key, "turn", F.concat(F.lit(START), "_role", F.lit("\n"), "_text", F.lit(f"{END}\n")).alias("piece"),
        F.when(F.col("_own"), start).otherwise(none).alias("loss_start"),
        F.when(F.col("_own"), start + F.length("_text")).otherwise(none).alias("loss_end"),
    )


def read_piece(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    role, body = piece[len(START) : -len(END) - 1].split("\n", 1)
    return _unescaped_role(role), unescaped(body)


def chat_digests(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """What is read back from the pieces of each conversation, as ``format_turns`` leaves them: number
    of turns, digest of roles and texts, length and digest of the text under the loss mask, length of
    the formatted text. A task holds one piece at a time."""
    kind = pieces.schema[key].dataType.simpleString()
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started = None, False
        keys, done = [], []
        sums, turns_hash, loss_hash = [0, 0, 0], hashlib.sha256(), hashlib.sha256()
        key_type = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *arrays], names)

        def close() -> None:
            keys.append(current)
            done.append((sums[0], turns_hash.hexdigest(), sums[1], loss_hash.hexdigest(), sums[2]))

        for rows in batches:
            key_type = rows.column(0).type
            columns = (rows.column(i).to_pylist() for i in range(4))
            for k, piece, a, b in zip(*columns, strict=True):
                if started and k != current:
                    close()
                    sums, turns_hash, loss_hash = [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                current, started = k, True
                role, text = read_piece(piece)
                learnt = unescaped(piece[a:b])
                turns_hash.update(f"{role}\n{text}\n".encode())
                loss_hash.update(learnt.encode())
                sums = [sums[0] + 1, sums[1] + len(learnt), sums[2] + len(piece)]
            if len(keys) >= 10_000:
                yield flush()
                keys, done = [], []
        if started:
            close()
            yield flush()

    return pieces.select(key, "piece", "loss_start", "loss_end").mapInArrow(
        read, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def chat_records(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss): one row for each conversation that fits into a row, with the ranges under
    the loss mask in code points of the whole text."""
    part = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "piece", "loss_start", "loss_end")
    gathered = pieces.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("_p"))
    spans = F.aggregate(
        "_p", F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<start: int, end: int>>").alias("found")),
        lambda done, p: F.struct(
            (done["at"] + F.length(p["piece"])).alias("at"),
            F.when(
                p["loss_start"] > 0,
                F.concat(
                    F.coalesce(done["found"], F.array().cast("array<struct<start: int, end: int>>")),
                    F.array(F.struct((done["at"] + p["loss_start"]).alias("start"), (done["at"] + p["loss_end"]).alias("end"))),
                ),
            ).otherwise(done["found"]).alias("found"),
        ),
    )
    text = F.array_join(F.transform("_p", lambda p: p["piece"]), "")
    return gathered.select(key, text.alias("formatted"), spans["found"].alias("loss"))

"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

The nested field paths of a layout, types left out, are hashed. A table of mappings, keyed by that
fingerprint, says where turns, roles and texts lie. Typed tables have one fingerprint, taken from
their schema; JSON records have one each, taken from their value. Turns are then rendered with
control strings around them; control strings inside texts are escaped reversibly, and the assistant
texts are marked in a loss mask. All in DataFrame functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:bigint,end:bigint>>"
LEVELS = 4  # of nesting that is spelled in paths; what lies deeper keeps its types


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``paths``: the layout's nested field paths. ``turns``: path of an array of turns, with the names
    of their role and text fields. ``fields``: else (role, paths to join with a blank line) in order.
    ``order``: of a table with a row per turn, the field that orders the rows.
    """

    name: str
    paths: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: Sequence[tuple[str, Sequence[str]]] = ()
    order: str | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.paths.encode()).hexdigest()


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn_rows", "{conv_id,role,text,turn}", text="text", order="turn"),
    Mapping("messages", "{messages:[{content,role}]}", turns="messages", roles=_NAMES),
    Mapping("speakers", "{conversations:[{from,value}]}", turns="conversations", role="from", text="value", roles=_NAMES),
    Mapping("prompt", "{completion,prompt}", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("response", "{prompt,response}", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question", "{answer,question}", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", "{instruction,output}", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", "{input,instruction,output}", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction_system", "{instruction,output,system}", fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
)


def schema_paths(kind: T.DataType) -> str:
    """Field paths of a typed schema: fields sorted in braces, elements in brackets."""
    if isinstance(kind, T.StructType):
        return "{" + ",".join(sorted(f.name + (":" + inner if (inner := schema_paths(f.dataType)) else "") for f in kind.fields)) + "}"
    return f"[{schema_paths(kind.elementType)}]" if isinstance(kind, T.ArrayType) else ""


def value_paths(value: Column) -> Column:
    """The same paths of a variant value; its schema lists fields in order of names."""
    scalar = "[A-Z][A-Z0-9_]*(\\([0-9, ]+\\))?"
    text = F.regexp_replace(F.schema_of_variant(value), f": (?!OBJECT<|ARRAY<){scalar}", "")
    text = F.replace(F.replace(F.regexp_replace(text, f"ARRAY<(?!OBJECT<|ARRAY<){scalar}>", "[]"), F.lit(", "), F.lit(",")), F.lit(": "), F.lit(":"))
    for _ in range(LEVELS):  # the innermost brackets first
        text = F.regexp_replace(F.regexp_replace(text, "OBJECT<([^<>]*)>", "{$1}"), "ARRAY<([^<>]*)>", "[$1]")
    return text


def _part(value: Column, m: Mapping) -> Column:
    """Whether the part of a record that a mapping needs has the mapping's fingerprint."""
    inner = lambda p: F.try_variant_get(value, f"$.{p}", "variant")
    if m.turns:
        paths = F.concat(F.lit(f"{{{m.turns}:"), value_paths(inner(m.turns)), F.lit("}"))
    else:
        names = [p for _, own in m.fields for p in own]
        plain = [F.coalesce(F.schema_of_variant(inner(p)).rlike("^[A-Z][A-Z0-9_]*(\\([0-9, ]+\\))?$"), F.lit(False)) for p in names]
        paths = F.when(reduce(Column.__and__, plain), "{" + ",".join(sorted(names)) + "}")
    return F.coalesce(F.sha2(paths, 256) == m.fingerprint, F.lit(False))


def _turn(role: Column, text: Column, roles: dict[str, str]) -> Column:
    role = F.coalesce(role, F.lit(""))
    for name, canonical in roles.items():
        role = F.when(role == name, canonical).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _reader(m: Mapping):
    return lambda x: _turn(x[m.role], x[m.text], m.roles)


def canonical_rows(table: DataFrame, conv_id: str = "conv_id", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """(conv_id, turns) from a table with a row per turn, whose layout has a mapping.

    Rows of one turn number come in order of role and text; rows without a number come first; null
    roles and texts are empty. Columns beyond the layout's own must be dropped before. A
    conversation's turns are gathered, as its formatted text is one value.
    """
    known = {m.fingerprint: m for m in mappings if m.order}
    mapping = known.get(hashlib.sha256(schema_paths(table.schema).encode()).hexdigest())
    if mapping is None:
        raise ValueError(f"no mapping for {schema_paths(table.schema)}")
    row = F.struct(F.col(mapping.order).alias("at"), _turn(F.col(mapping.role), F.col(mapping.text), mapping.roles).alias("turn"))
    return table.groupBy(conv_id).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["turn"]).alias("turns"))


def canonical_json(records: DataFrame, record: str = "record", conv_id: str = "conv_id", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """(conv_id, layout, turns) of JSON records of mixed layouts, a row each.

    A record whose whole fingerprint is unknown takes the mapping of the most fields whose own part of the
    record, other keys left out, has the mapping's fingerprint; of equally many the later one. Records that
    are null, no JSON or of an unknown layout have a null ``layout`` and no turns.
    """
    value = F.col("_value")
    parsed = records.select(F.col(conv_id), F.try_parse_json(F.col(record)).alias("_value")).withColumn("_print", F.sha2(value_paths(value), 256))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    parts = sorted((m for m in mappings if m.turns or m.fields), key=lambda m: len([p for _, paths in m.fields for p in paths]))
    # Parts first, whole layouts after them: the last that holds is taken.
    for m, here in [(m, _part(value, m)) for m in parts] + [(m, F.col("_print") == m.fingerprint) for m in mappings]:
        if m.turns:
            kind = f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
            found = F.transform(F.try_variant_get(value, f"$.{m.turns}", kind), _reader(m))
        elif m.fields:
            text = lambda paths: F.array_join(F.filter(F.array(*[F.try_variant_get(value, f"$.{p}", "string") for p in paths]), lambda x: x != ""), "\n\n")
            found = F.array(*[_turn(F.lit(role), text(paths), {}) for role, paths in m.fields])
        else:
            continue
        layout, turns = F.when(here, m.name).otherwise(layout), F.when(here, found).otherwise(turns)
    return parsed.select(conv_id, layout.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def escaped(text: Column) -> Column:
    """No ``<|`` is left: one more backslash stands between the two."""
    return F.regexp_replace(text, "<(\\\\*)\\|", "<\\\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "<\\\\(\\\\*)\\|", "<$1|")


def _role_out(role: Column) -> Column:
    """A role is one line: backslash and newline become \\s and \\n."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def formatted(conversations: DataFrame, conv_id: str = "conv_id", turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """(conv_id, ``formatted``, ``loss_spans``): spans of the trained role's texts in code points, end exclusive."""
    safe = conversations.select(F.col(conv_id), F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == trained).alias("loss"),
    )).alias("_turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))
    begin = lambda s, t: s["at"] + F.length(t["head"])
    step = lambda s, t: F.struct(
        (begin(s, t) + F.length(t["body"]) + len(END) + 1).alias("at"),
        F.when(t["loss"], F.array_append(s["spans"], F.struct(begin(s, t).alias("start"), (begin(s, t) + F.length(t["body"])).alias("end")))).otherwise(s["spans"]).alias("spans"),
    )
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return safe.select(conv_id, text.alias("formatted"), F.aggregate("_turns", start, step, lambda s: s["spans"]).alias("loss_spans"))


def read_back(chats: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, ``turns``, ``loss_text``, ``formatted_chars``) from formatted text and its mask alone."""
    parts = F.split("formatted", START.replace("|", "\\|"), -1)
    body = lambda x: F.substring(x, (F.instr(x, "\n") + 1).cast("int"), (F.length(x) - F.instr(x, "\n") - (len(END) + 1)).cast("int"))
    turns = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda x: F.struct(_role_in(F.substring_index(x, "\n", 1)).alias("role"), unescaped(body(x)).alias("text")),
    )
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.select(conv_id, turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))

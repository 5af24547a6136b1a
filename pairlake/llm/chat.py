"""Operator 11: chat formatting by schema fingerprints, in DataFrame functions only.

Conversations come in many layouts: lists of messages, instruction and output
fields, prompt and completion, one row a turn.  A record's layout is told by
the *paths* of its nested fields (``messages[].role``).  Each declared
:class:`Layout` names the paths it needs and those it can use; the SHA-256 of
a record's paths among them is its fingerprint under that layout, and a layout
whose list holds the fingerprint maps the record to canonical turns (role,
text).  Where several do, the first one declared wins.  A table with columns
has one fingerprint, that of its schema, taken once; JSON records are
fingerprinted row by row from the schema of their parsed value.

:func:`format_turns` writes the turns of a conversation with the marks of a
:class:`Template` and lists the spans that a model is to learn (the loss mask).
Control strings inside texts are broken by a backslash after their first
character, one more where backslashes stand there already, so that no text can
hold a control string and :func:`read_turns` gives every text back.

Only a conversation's own turns meet in one row (its formatted text is one
value, which Spark bounds to 2 GB); everything before is row by row and a sum
over the turns of a conversation.

Defined results: a null role or text is empty; rows without a conversation id
are one conversation without id; turns are ordered by turn (null first), then
role, then text, and repeated rows are turns of their own; a record that is no
JSON or has no known layout gives no turns (``recognise`` shows it with a null
layout); other columns, whatever their names, are left out; an empty table
gives an empty table.
"""

import hashlib
import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlake.llm.text import pick

TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """How the fields of one kind of record become turns.

    ``each`` names an array with a turn an element, whose ``role`` and
    ``text`` are fields of it.  Without ``each``, ``role`` and ``text`` are
    fields of the record, which is a single turn at place ``turn``; or
    ``parts`` lists (role, fields): a turn of the fields that are there, joined
    by a line break.  ``needs`` are the parts that must be there.
    """

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    needs: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def required(self) -> list[str]:
        if self.each:
            return [f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"]
        return list(self.needs) or [self.turn, self.role, self.text]

    def optional(self) -> list[str]:
        return [p for _, paths in self.parts for p in paths if p not in self.needs]

    def fingerprints(self) -> list[str]:
        """Those of the required paths with any of the optional ones."""
        more = self.optional()
        return [fingerprint([*self.required(), *some])
                for k in range(len(more) + 1) for some in itertools.combinations(more, k)]


def fingerprint(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


_SPEAKERS = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "chatgpt": "assistant"}

LAYOUTS = (
    Layout("messages", each="messages", role="role", text="content"),
    Layout("conversations", each="conversations", role="from", text="value", roles=_SPEAKERS),
    Layout("conversation", each="conversation", role="role", text="content"),
    Layout("turns", each="turns", role="speaker", text="text", roles=_SPEAKERS),
    Layout("instruction", needs=("instruction", "output"),
           parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction_response", needs=("instruction", "response"),
           parts=(("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",)))),
    Layout("prompt", needs=("prompt", "completion"),
           parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", needs=("prompt", "response"),
           parts=(("system", ("system_prompt",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question", needs=("question", "answer"),
           parts=(("system", ("system_prompt",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
    Layout("turn_rows", turn="turn", role="role", text="text"),
)


# --- paths of nested fields

def schema_paths(schema: T.StructType) -> list[str]:
    """Paths of the leaves of a table's schema."""
    def walk(kind: T.DataType, at: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in walk(f.dataType, f"{at}.{f.name}" if at else f.name)]
        return walk(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else [at]
    return walk(schema, "")


_TOKEN = r"(?:`(?:[^`]++|``)*+`|[A-Za-z0-9_]++): |OBJECT<|ARRAY<|>|[A-Z]++(?:\(\d+,\d+\))?"


def record_paths(value: Column) -> Column:
    """Paths of the leaves of a variant, by one walk over its written schema:
    a stack of the open objects and lists, and the path of the field at hand."""
    tokens = F.regexp_extract_all(F.schema_of_variant(value), F.lit(_TOKEN), F.lit(0))
    state = "struct<open: array<string>, at: string, paths: array<string>>"

    def step(s: Column, token: Column) -> Column:
        outer = F.try_element_at(s["open"], F.lit(-1))
        name = F.regexp_replace(F.regexp_replace(token, ": $", ""), "^`|`$", "")
        name = F.when(token.startswith("`"), F.replace(name, F.lit("``"), F.lit("`"))).otherwise(name)
        within = F.concat(F.when(F.length(outer) > 0, F.concat(outer, F.lit("."))).otherwise(""), name)

        def to(opened, at, paths=s["paths"]):
            return F.struct(opened.alias("open"), at.alias("at"), paths.alias("paths")).cast(state)
        return (F.when(token == "OBJECT<", to(F.array_append(s["open"], s["at"]), s["at"]))
                .when(token == "ARRAY<", to(F.array_append(s["open"], s["at"]), F.concat(s["at"], F.lit("[]"))))
                .when(token == ">", to(F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1), outer))
                .when(token.endswith(": "), to(s["open"], within))
                .otherwise(to(s["open"], s["at"], F.array_append(s["paths"], s["at"]))))

    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("at"),
                     F.array().cast("array<string>").alias("paths")).cast(state)
    return F.aggregate(tokens, start, step, lambda s: s["paths"])


def _layout_of(paths: Column, layouts: Sequence[Layout]) -> Column:
    """Name of the first layout whose fingerprints hold that of the paths."""
    out = F.lit(None).cast("string")
    for m in reversed(layouts):
        known = F.array(*[F.lit(p) for p in sorted({*m.required(), *m.optional()})])
        seen = F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, known)), "\n").cast("binary"), 256)
        out = F.when(seen.isin(m.fingerprints()), m.name).otherwise(out)
    return out


# --- records to turns

def _turns(m: Layout, get, elements) -> Column:
    """The turns of a record of layout ``m``; ``get`` gives a field as a
    string and ``elements`` the (role, text) pairs of an array."""
    def role(x):
        return F.coalesce(*[F.when(x == a, F.lit(b)) for a, b in m.roles.items()], x) if m.roles else x

    def turn(r, t):
        return F.struct(F.coalesce(role(r), F.lit("")).alias("role"), F.coalesce(t, F.lit("")).alias("text"))
    if m.each:
        return F.transform(elements(m), lambda e: turn(e["role"], e["text"]))
    if not m.parts:
        return F.array(turn(get(m.role), get(m.text)))
    turns = [F.when(F.coalesce(*map(get, paths)).isNotNull(),
                    turn(F.lit(r), F.array_join(F.filter(F.array(*map(get, paths)), lambda t: t != ""), "\n")))
             for r, paths in m.parts]
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def recognise(records: DataFrame, record: str, key: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """JSON records -> (key, layout, first, turns): the layout's name (null if
    none fits), the place of the first turn and the canonical turns."""
    value = F.try_parse_json("record")

    def get(path):
        return F.try_variant_get("value", f"$.{path}", "string")

    def content(x):  # a text, or a list of parts that hold texts
        parts = F.transform(F.try_variant_get(x, "$", "array<struct<text: string>>"), lambda p: p["text"])
        return F.when(F.schema_of_variant(x).startswith("ARRAY<"), F.array_join(parts, "\n")).otherwise(
            F.try_variant_get(x, "$", "string"))

    def elements(m):
        kind = f"array<struct<`{m.role}`: string, `{m.text}`: variant>>"
        return F.transform(F.try_variant_get("value", f"$.{m.each}", kind),
                           lambda e: F.struct(e[m.role].alias("role"), content(e[m.text]).alias("text")))
    # an array of parts shows as messages[].content[].text
    paths = F.transform(record_paths(F.col("value")), lambda p: F.regexp_replace(p, r"(\.content)\[\]\.text$", "$1"))
    known = pick(records, key=key, record=record).select("key", value.alias("value")).select(
        "key", "value", _layout_of(paths, layouts).alias("layout"))
    turns, first = F.lit(None).cast(TURNS), F.lit(0).cast("long")
    for m in layouts:
        turns = F.when(F.col("layout") == m.name, _turns(m, get, elements)).otherwise(turns)
        if m.turn:
            first = F.when(F.col("layout") == m.name, F.try_variant_get("value", f"$.{m.turn}", "bigint")).otherwise(first)
    return known.select("key", "layout", first.alias("first"), turns.alias("turns"))


def turns_of_records(records: DataFrame, record: str, key: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Canonical turns (key, turn, role, text) of JSON records."""
    rows = recognise(records, record, key, layouts).select("key", "first", F.posexplode("turns").alias("n", "t"))
    return rows.select("key", (F.col("first") + F.col("n")).alias("turn"), "t.role", "t.text")


def turns_of_table(table: DataFrame, key: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Canonical turns (key, turn, role, text) of a table with columns, whose
    layout is told by the fingerprint of its schema."""
    paths = [re.sub(r"(\.content)\[\]\.text$", r"\1", p) for p in schema_paths(table.schema)]
    fits = [m for m in layouts
            if fingerprint([p for p in paths if p in {*m.required(), *m.optional()}]) in m.fingerprints()]
    if not fits:
        raise ValueError(f"no layout fits the fields {paths}")
    m = fits[0]
    there = [p.split("[]")[0] for p in [*m.required(), *m.optional()] if p in paths]
    inside = pick(table, key=key, **{f"f{i}": p for i, p in enumerate(there)})
    place = {p: f"f{i}" for i, p in enumerate(there)}

    def get(path):
        return F.col(place[path]).cast("string") if path in place else F.lit(None).cast("string")

    def elements(m):
        kind = inside.schema[place[m.each]].dataType.elementType[m.text].dataType

        def content(x):
            if isinstance(kind, T.ArrayType):
                return F.array_join(F.transform(x, lambda p: p["text"].cast("string")), "\n")
            return x.cast("string")
        return F.transform(F.col(place[m.each]), lambda e: F.struct(
            e[m.role].cast("string").alias("role"), content(e[m.text]).alias("text")))
    if m.turn:
        first = F.col(place[m.turn]).cast("long")
        only = _turns(m, get, elements)[0]
        return inside.select("key", first.alias("turn"), only["role"].alias("role"), only["text"].alias("text"))
    rows = inside.select("key", F.posexplode(_turns(m, get, elements)).alias("n", "t"))
    return rows.select("key", F.col("n").cast("long").alias("turn"), "t.role", "t.text")


# --- template

@dataclass(frozen=True)
class Template:
    """Marks around the texts: ``start`` of a conversation, (before, after) by
    role, and (before, between, after) for any other role and its text.  No
    control string may hold a backslash or another control string."""

    start: str = "<s>"
    marks: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>\n", "\n<</SYS>>\n\n"), ("user", "[INST] ", " [/INST]"), ("assistant", " ", " </s>"))
    other: tuple[str, str, str] = ("<<ROLE>> ", " <</ROLE>> ", " </s>")
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")

    def __post_init__(self):
        for a, b in itertools.permutations(self.controls, 2):
            if "\\" in a or a in b:
                raise ValueError(f"control strings must not hold a backslash or one another: {a!r}, {b!r}")

    def _look_alike(self, least: str) -> str:
        """First character of a control string, with at least the backslashes
        ``least``, where the rest of it follows."""
        first = {c[0]: [d[1:] for d in self.controls if d[0] == c[0]] for c in self.controls}
        return "|".join(rf"(?:\Q{c}\E)(?={least}\\*(?:{'|'.join(rf'\Q{r}\E' for r in rest)}))" for c, rest in first.items())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self._look_alike('')})", "$1\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self._look_alike(r'\\')})" + r"\\", "$1")

    def before(self, role: Column) -> Column:
        """All of a turn that stands before its text."""
        a, b, _ = self.other
        out = F.concat(F.lit(a), self.escape(role), F.lit(b))
        for name, mark, _ in self.marks:
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def after(self, role: Column) -> Column:
        out = F.lit(self.other[2])
        for name, _, mark in self.marks:
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def pattern(self) -> str:
        """One turn; groups: the texts of the known roles, then another role and its text."""
        one = [rf"\Q{a}\E(.*?)\Q{b}\E" for _, a, b in sorted(self.marks, key=lambda m: -len(m[1]))]
        a, b, c = self.other
        return "(?s)" + "|".join([rf"\Q{a}\E(.*?)\Q{b}\E(.*?)\Q{c}\E", *one])


def format_turns(turns: DataFrame, template: Template = Template(), learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """Canonical turns (key, turn, role, text) -> (key, formatted, loss): one
    text a conversation and the spans (start, end: code points, end exclusive)
    of the texts of the roles to ``learn``, in order."""
    inside = Window.partitionBy("key").orderBy("turn", "role", "text")
    rows = (turns.select("key", "turn", "role", "text", template.before(F.col("role")).alias("a"),
                         template.escape(F.col("text")).alias("t"), template.after(F.col("role")).alias("b"))
            .withColumn("n", F.row_number().over(inside))
            .withColumn("end", F.sum(F.length("a") + F.length("t") + F.length("b")).over(
                inside.rowsBetween(Window.unboundedPreceding, 0)) + len(template.start) - F.length("b")))
    span = F.when(F.col("role").isin(*learn), F.struct(
        (F.col("end") - F.length("t")).cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    grouped = rows.groupBy("key").agg(F.sort_array(F.collect_list(
        F.struct("n", F.concat("a", "t", "b").alias("piece"), span.alias("span")))).alias("p"))
    return grouped.select("key", F.concat(F.lit(template.start), F.array_join(
        F.transform("p", lambda x: x["piece"]), "")).alias("formatted"),
        F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (array of role, text) of a formatted conversation."""
    body = F.substring(formatted, F.lit(len(template.start) + 1), F.length(formatted))
    a, b, c = template.other

    def cut(piece, before, after):
        return F.substring(piece, F.lit(len(before) + 1), F.length(piece) - len(before) - len(after))

    def turn(piece: Column) -> Column:
        both = cut(piece, a, c)
        role = F.substring_index(both, b, 1)
        out = F.struct(template.unescape(role).alias("role"), template.unescape(
            F.substring(both, F.length(role) + len(b) + 1, F.length(both))).alias("text"))
        for name, before, after in sorted(template.marks, key=lambda m: len(m[1])):
            is_other = piece.startswith(a)
            out = F.when(piece.startswith(before) & ~is_other, F.struct(
                F.lit(name).alias("role"), template.unescape(cut(piece, before, after)).alias("text"))).otherwise(out)
        return out
    return F.transform(F.regexp_extract_all(body, F.lit(template.pattern()), F.lit(0)), turn)


def learned_text(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(loss, lambda s: template.unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")

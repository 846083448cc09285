"""Chat formatting: schema fingerprints select mappings to canonical turns, which a template turns into text with a loss mask.

A fingerprint is the hash of sorted nested field paths, types left out. Typed tables have their paths in their schema;
JSON records have theirs each (through the variant type), so that one column may mix layouts. A table or record is held
against a layout by the fingerprint of those of its paths that the layout knows, so further fields don't matter; of several
that fit, the one with most fields counts. ``LAYOUTS`` and ``TABLES`` say where turns, roles and texts are. A record with
an empty list of turns has none; records of no known layout give null turns, and tables of none raise ValueError.

The template writes a turn as ``### role: text</turn>`` and a line feed. Where a control string occurs inside a text, a
backslash is put after its first character, and backslashes are doubled; so no text can end or begin a turn, and
``unescaped`` gives it back exactly. The mask lists the spans of assistant texts. DataFrame functions only.

Defined cases: null roles and texts are empty; turns of a conversation are ordered by (turn, role, text), equal rows
stay as many as they are; rows without a conversation id form one conversation; an empty table gives an empty result;
columns besides those a layout names are ignored. A conversation becomes one string, so one row must hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Listed:
    """Turns in a list of objects."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        return sorted((f"{self.path}[]", f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"))

    def turns(self, record: Column) -> Column:
        kind = f"array<struct<`{self.role}`:string,`{self.text}`:string>>"
        found = F.try_variant_get(record, f"$.{self.path}", kind)

        def turn(x: Column) -> Column:
            role = F.coalesce(x[self.role], F.lit(""))
            for name, canonical in self.roles:
                role = F.when(role == name, F.lit(canonical)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(x[self.text], F.lit("")).alias("text"))

        return F.transform(found, turn)


@dataclass(frozen=True)
class Flat:
    """A turn for each (role, fields); the texts of several fields are joined by line feeds, empty turns left out."""

    parts: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> list[str]:
        return sorted(f for _, fields in self.parts for f in fields)

    def turns(self, record: Column) -> Column:
        made = []
        for role, fields in self.parts:
            texts = F.array(*(F.coalesce(F.try_variant_get(record, f"$.{f}", "string"), F.lit("")) for f in fields))
            text = F.array_join(F.filter(texts, lambda x: x != ""), "\n") if len(fields) > 1 else texts[0]
            made.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
        return F.filter(F.array(*made), lambda x: (x["text"] != "") | (x["role"] == "assistant"))


#: Layouts of JSON records by name.
LAYOUTS: dict[str, Listed | Flat] = {
    "messages": Listed("messages", "role", "content"),
    "turns": Listed("turns", "speaker", "text"),
    "conversations": Listed("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    "prompt_completion": Flat((("user", ("prompt",)), ("assistant", ("completion",)))),
    "prompt_response": Flat((("user", ("prompt",)), ("assistant", ("response",)))),
    "instruction": Flat((("user", ("instruction",)), ("assistant", ("output",)))),
    "instruction_input": Flat((("user", ("instruction", "input")), ("assistant", ("output",)))),
    "system_prompt": Flat((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
}


def _fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _each_after(head: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.concat(F.lit(head), x))


def record_paths(record: Column, lists: list[str]) -> Column:
    """The field paths of a variant: its own fields, and those inside the objects of the named lists."""
    keys = lambda x: F.coalesce(F.json_object_keys(F.to_json(x)), F.array().cast("array<string>"))
    found = [keys(record)]
    for name in lists:
        items = F.try_variant_get(record, f"$.{name}", "array<variant>")
        inner = F.array_distinct(F.flatten(F.transform(items, keys)))
        paths = F.concat(F.array(F.lit(f"{name}[]")), _each_after(f"{name}[].", inner))
        found.append(F.coalesce(paths, F.array().cast("array<string>")))
    return F.concat(*found)


def from_json(records: DataFrame, payload: str, layouts: dict[str, Listed | Flat] | None = None) -> DataFrame:
    """The records with ``layout`` (its name, null where unknown) and ``turns`` (canonical) instead of the JSON column."""
    layouts = LAYOUTS if layouts is None else layouts
    lists = [x.path for x in layouts.values() if isinstance(x, Listed)]
    own = [c for c in records.columns if c != payload]
    record = F.try_parse_json(F.col(f"`{payload}`"))
    rows = records.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), record.alias("record")) if own else records.select(record.alias("record"))
    rows = rows.withColumn("paths", record_paths(F.col("record"), lists))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for key, layout in sorted(layouts.items(), key=lambda x: len(x[1].paths())):  # what has more fields comes later and prevails
        wanted = F.array(*map(F.lit, layout.paths()))
        mine = _fingerprint(F.array_intersect("paths", wanted))
        known = mine == _fingerprint(wanted)
        if isinstance(layout, Listed):
            known = known | ((mine == _fingerprint(F.array(F.lit(f"{layout.path}[]")))) & (F.size(F.try_variant_get("record", f"$.{layout.path}", "array<variant>")) == 0))
        name = F.when(known, F.lit(key)).otherwise(name)
        turns = F.when(known, layout.turns(F.col("record")).cast(TURNS)).otherwise(turns)
    return rows.select(*(F.col("own")[c].alias(c) for c in own if c not in ("layout", "turns")), name.alias("layout"), turns.alias("turns"))


@dataclass(frozen=True)
class Rows:
    """A table with a row for each turn."""

    key: str
    order: str
    role: str
    text: str

    def paths(self) -> list[str]:
        return sorted((self.key, self.order, self.role, self.text))


@dataclass(frozen=True)
class Nested:
    """A table with a list of turns in each row."""

    key: str
    turns: str
    role: str
    text: str

    def paths(self) -> list[str]:
        return sorted((self.key, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"))


#: Layouts of tables.
TABLES: dict[str, Rows | Nested] = {
    "turn_rows": Rows("conv_id", "turn", "role", "text"),
    "nested_messages": Nested("conv_id", "messages", "role", "content"),
}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type; ``[]`` steps into a list."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def path_fingerprint(paths: Iterable[str]) -> str:
    """Hash of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def table_layout(df: DataFrame, layouts: dict[str, Rows | Nested] | None = None) -> Rows | Nested:
    """The layout whose fingerprint the table's paths, as far as the layout knows them, have; the one with most fields first."""
    layouts, have = TABLES if layouts is None else layouts, set(schema_paths(df.schema))
    known = {path_fingerprint(x.paths()): x for x in layouts.values()}
    found = [known.get(path_fingerprint(have.intersection(x.paths()))) for x in sorted(layouts.values(), key=lambda x: (-len(x.paths()), x.paths()))]
    for layout in filter(None, found):
        return layout
    raise ValueError(f"no layout has the fields of {sorted(have)}")


def from_table(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a typed table, by its schema's layout."""
    layout = table_layout(df)
    empty = F.lit("")
    if isinstance(layout, Nested):
        turn = lambda x: F.struct(F.coalesce(x[layout.role], empty).alias("role"), F.coalesce(x[layout.text], empty).alias("text"))
        return df.select(F.col(layout.key).alias("conv_id"), F.transform(layout.turns, turn).alias("turns"))
    row = F.struct(F.col(layout.order).alias("turn"), F.coalesce(layout.role, empty).alias("role"), F.coalesce(layout.text, empty).alias("text"))
    grouped = df.groupBy(F.col(layout.key).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return grouped.select("conv_id", F.transform("_rows", lambda x: F.struct(x["role"], x["text"])).alias("turns"))


OPEN, COLON, CLOSE = "### ", ": ", "</turn>"


def _broken(text: Column, control: str) -> Column:
    return F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))


def escaped(text: Column) -> Column:
    """A text in which no control string occurs."""
    return _broken(_broken(F.replace(text, F.lit("\\"), F.lit("\\\\")), OPEN), CLOSE)


def unescaped(text: Column) -> Column:
    """What ``escaped`` made it from: of backslashes in pairs one stays, single ones go."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(chats: DataFrame, learnt: str = "assistant") -> DataFrame:
    """(conv_id, text, mask): the template filled in, and the spans [begin, end) of code points under the loss mask."""
    parts = F.transform(
        "turns",
        lambda x: F.struct(
            F.concat(F.lit(OPEN), _broken(escaped(x["role"]), COLON), F.lit(COLON)).alias("head"),
            escaped(x["text"]).alias("body"),
            (x["role"] == learnt).alias("learnt"),
        ),
    )
    rows = chats.select("conv_id", parts.alias("_parts"))
    close = f"{CLOSE}\n"
    text = F.array_join(F.transform("_parts", lambda x: F.concat(x["head"], x["body"], F.lit(close))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["head"])
        end = begin + F.char_length(x["body"])
        span = F.array(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end")))
        return F.struct((end + len(close)).cast("long").alias("at"), F.when(x["learnt"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return rows.select("conv_id", text.alias("text"), F.aggregate("_parts", zero, step)["spans"].alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, text, mask, turns): the turns as the formatted text has them."""
    pieces = F.filter(F.split("text", f"{CLOSE}\n"), lambda x: x != "")

    def turn(x: Column) -> Column:
        rest = F.substring(x, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(rest, COLON, 1)
        text = F.substring(rest, F.char_length(role) + len(COLON) + 1, F.lit(2**31 - 1))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return chats.select("conv_id", "text", "mask", F.transform(pieces, turn).alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from formatted chats."""
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda s: unescaped(F.substring(F.col("text"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
    rows = read_back(chats).select("conv_id", "text", F.size("turns").cast("long").alias("n_turns"), spoken.alias("_spoken"), loss.alias("_loss"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select(
        "conv_id",
        "n_turns",
        sha("_spoken").alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        sha("_loss").alias("loss_sha256"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )

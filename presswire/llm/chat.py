"""Chat formatting: schema fingerprints choose declarative mappings; a template with reversible escapes. Native functions only."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"

#: The template. A turn is OPEN role NEWLINE text CLOSE; each control string has an escape that no text can hold by itself.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
ESCAPES = (("\\", "\\b"), ("<|", "\\c"), ("<s>", "\\s"), ("</s>", "\\e"), ("[INST]", "\\i"), ("[/INST]", "\\j"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    """Backslashes first; what replaces a control string holds no control string and no two of them overlap."""
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    """Every backslash in escaped text starts a code, so codes can be undone one kind at a time, backslashes last."""
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with their leaf kinds, e.g. messages[].role:string. Numbers count as one kind; order does not matter."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{at}[]")
    kind = "number" if isinstance(schema, T.NumericType) else "string" if isinstance(schema, T.StringType) else schema.simpleString()
    return [f"{at}:{kind}"]


def fingerprint(field_paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """A layout: its paths, the fields that must be there for it to match, and SQL that gives the turns (TURNS)."""

    name: str
    field_paths: tuple[str, ...]
    turns: str
    per_row: bool = False  # a row is a turn, not a conversation

    @property
    def key(self) -> str:
        return fingerprint(list(self.field_paths))


#: Role names of other layouts, in canonical names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
ROLE_SQL = "coalesce(element_at(map(" + ", ".join(f"'{a}', '{b}'" for a, b in ROLES.items()) + "), lower({0})), {0})"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', coalesce({text}, ''))"


LAYOUTS = (
    Layout("turn rows", ("conv_id:number", "turn:number", "role:string", "text:string"), f"array({_turn('role', 'text')})", per_row=True),
    Layout("messages", ("conv_id:number", "messages[].role:string", "messages[].content:string"), f"transform(messages, m -> {_turn(ROLE_SQL.format('m.role'), 'm.content')})"),
    Layout("from and value", ("conv_id:number", "conversations[].from:string", "conversations[].value:string"), f"transform(conversations, m -> {_turn(ROLE_SQL.format('m.from'), 'm.value')})"),
    Layout("prompt and completion", ("conv_id:number", "prompt:string", "completion:string"), f"array({_turn("'user'", 'prompt')}, {_turn("'assistant'", 'completion')})"),
    Layout("prompt and response", ("conv_id:number", "prompt:string", "response:string"), f"array({_turn("'user'", 'prompt')}, {_turn("'assistant'", 'response')})"),
    Layout("instruction", ("conv_id:number", "instruction:string", "output:string"), f"array({_turn("'user'", 'instruction')}, {_turn("'assistant'", 'output')})"),
    Layout(
        "instruction with input", ("conv_id:number", "instruction:string", "input:string", "output:string"),
        f"array({_turn("'user'", "concat_ws('\\n\\n', instruction, nullif(input, ''))")}, {_turn("'assistant'", 'output')})",
    ),
    Layout(
        "instruction with system", ("conv_id:number", "system:string", "instruction:string", "output:string"),
        f"array({_turn("'system'", 'system')}, {_turn("'user'", 'instruction')}, {_turn("'assistant'", 'output')})",
    ),
)


def canonical(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turns (TURNS) of a table whose layout is not known beforehand.

    The fingerprint of all nested paths is looked up first; if extra columns hide it, each layout's own paths are taken
    out of the table's, and the layout with most paths among those that match wins. No match raises ValueError.

    Rows of one conversation are ordered by turn, then role and text; null turns last; null text is empty, null role is
    ''. A conversation is one value here as in the output, so it must fit in one string (2 GB).
    """
    known = {x.key: x for x in layouts}
    have = paths(df.schema)
    layout = known.get(fingerprint(have)) or max((x for x in layouts if set(x.field_paths) <= set(have)), key=lambda x: len(x.field_paths), default=None)
    if layout is None:
        raise ValueError(f"no layout for {have}")
    if not layout.per_row:
        turns = F.transform(F.expr(layout.turns), lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), m["text"].alias("text")))
        return df.select("conv_id", F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))
    turn = F.expr(layout.turns)[0]
    row = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.coalesce(turn["role"], F.lit("")).alias("role"), turn["text"].alias("text"))
    rows = df.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return rows.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def shape(field_paths: tuple[str, ...]) -> str:
    """The paths as schema_of_variant() writes an object, without leaf kinds: OBJECT<conv_id, messages: ARRAY<OBJECT<content, role>>>."""
    below: dict[str, list[str]] = {}
    for p in field_paths:
        head, _, rest = p.split(":")[0].partition(".")
        below.setdefault(head, []).append(rest)

    def field(head: str) -> str:
        name, rests = head.removesuffix("[]"), tuple(r for r in below[head] if r)
        inner = shape(rests) if rests else ""
        return f"{name}: ARRAY<{inner}>" if head.endswith("[]") else f"{name}: {inner}" if inner else name

    return "OBJECT<" + ", ".join(field(h) for h in sorted(below)) + ">"


def canonical_json(df: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turns of JSON records of mixed layouts in one column: the fingerprint of each record's own nested paths chooses its layout.

    conv_id is read from the record. A record that is null, no JSON, or of no known layout (another path, at any depth, more or less) gives
    turns null. Null leaves keep their path; null texts are empty. Other columns are ignored.
    """
    rows = df.select(F.col(column).alias("record"))
    paths_of = F.regexp_replace(F.schema_of_variant(F.try_parse_json("record")), r": (?!ARRAY<|OBJECT<)[A-Z_]+(\(\d+,\d+\))?", "")
    rows = rows.withColumn("key", F.sha2(paths_of, 256))
    known = [x for x in layouts if not x.per_row]
    parsed = []
    for i, layout in enumerate(known):
        heads = sorted({p.split(":")[0].split("[")[0] for p in layout.field_paths})
        nested = {h: [p.split("[].")[1].split(":")[0] for p in layout.field_paths if p.startswith(f"{h}[]")] for h in heads}
        kinds = [f"`{h}` " + (f"array<struct<{','.join(f'`{n}`:string' for n in nested[h])}>>" if nested[h] else "bigint" if h == "conv_id" else "string") for h in heads]
        own = F.col("key") == hashlib.sha256(shape(layout.field_paths).encode()).hexdigest()
        parsed.append(F.when(own, F.from_json("record", ", ".join(kinds))).alias(f"layout_{i}"))
    rows = rows.select("record", *parsed)
    turns = [F.when(F.col(f"layout_{i}").isNotNull(), F.expr(_qualify(x, f"layout_{i}"))) for i, x in enumerate(known)]
    return rows.select(F.get_json_object("record", "$.conv_id").try_cast("long").alias("conv_id"), F.coalesce(*turns, F.lit(None).cast(TURNS)).alias("turns"))


def _qualify(layout: Layout, record: str) -> str:
    """The layout's SQL with its fields taken from a struct column."""
    heads = "|".join({p.split(":")[0].split("[")[0] for p in layout.field_paths})
    return re.sub(rf"(?<![\w.'])({heads})(?![\w'])", rf"{record}.`\1`", layout.turns)


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of conv_id, turns. A span is (start, length) in code points of formatted, from 0.

    The loss mask covers the escaped text of each assistant turn, without role line and CLOSE.
    """
    coded = F.transform("turns", lambda m: F.struct(escape(m["role"], ROLE_ESCAPES).alias("role"), escape(m["text"]).alias("text"), (m["role"] == "assistant").alias("loss")))
    head = lambda m: F.concat(F.lit(OPEN), m["role"], F.lit("\n"))
    df = conversations.select("conv_id", coded.alias("coded"))
    text = F.array_join(F.transform("coded", lambda m: F.concat(head(m), m["text"], F.lit(CLOSE))), "")
    # Running length: an aggregate over the turns carries (position, spans).
    spans = F.aggregate(
        "coded",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(head(m)) + F.length(m["text"]) + len(CLOSE)).cast("long").alias("at"),
            F.concat(acc["spans"], F.when(m["loss"], F.array(F.struct((acc["at"] + F.length(head(m))).cast("long").alias("start"), F.length(m["text"]).cast("long").alias("length")))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return df.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Turns (TURNS) of formatted text, unescaped: the inverse of render()."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda b: b != "")

    def turn(b: Column) -> Column:
        body = F.substring(b, F.lit(1), F.length(b) - len(CLOSE))
        cut = F.instr(body, "\n")
        return F.struct(unescape(F.substring(body, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("text"))

    return F.transform(blocks, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_digest(conversations: DataFrame) -> DataFrame:
    """What op6 reports of each conversation of any layout, read back from the formatted text."""
    out = render(canonical(conversations)).withColumns({"turns": parse(F.col("formatted")), "loss": masked(F.col("formatted"), F.col("loss_spans"))})
    log = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(log, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

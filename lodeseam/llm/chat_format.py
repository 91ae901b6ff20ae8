"""Chat formatting: records of many layouts to one marked-up text, in DataFrame operations alone.

A record is a JSON object.  Its schema (field names and nesting, whatever the values' types) is written as a text and
hashed; the hash selects a declarative mapping, which says where roles and texts lie.  Layouts with an array of
messages, prompt and response pairs and instruction records become the same canonical array of (role, text) turns.

JSON functions give null for a string of over 20,000,000 characters and for a record over the variant limit.  So
`records` writes roles and texts into an array beside the record, and their places in it into the record: no text goes
through JSON, whatever its length.

The template writes a turn as `### role: text</turn>` and a line feed.  Inside roles and texts a backslash, `#`, `<`
(and `:` in roles) are written as a backslash and a letter, so what marks turns never stands in them and `parse` gives
back exactly what was formatted.  The loss mask is a list of (start, length) in code points of the formatted text, one
for each assistant text.

Defined results: a null text or role is the empty string; a record without turns is formatted as the empty text; a
record of an unknown schema, or one that isn't a JSON object, has a null `turns` and `formatted` and is told apart by
its null `layout`; turns with equal numbers stand in the order of role and text; rows of a null conv_id form one
conversation; repeated rows are repeated turns; other columns pass through unless they have the names of results, which
then replace them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role: string, text: string>>"
BEGIN, MIDDLE, END = "### ", ": ", "</turn>\n"
#: What is written for each character with a meaning, in roles; `:` has none in texts.
ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
LEARNED_ROLE = "assistant"
#: The column of strings that a record's own strings are places in, where there is one.
STRINGS = "_strings"


@dataclass(frozen=True)
class Mapping:
    """A layout: an example of its records, and the path of its messages or of each single turn.

    messages: the array's path, its items' fields for role and text.  turns: (role, paths); the texts of several paths
    are joined by an empty line, and a turn is left out if all its paths are null or empty and it is optional.
    """

    name: str
    schemas: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...], bool], ...] = ()
    rename: bool = False  # roles by ROLE_NAMES


#: Other names of roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}

MAPPINGS = (
    Mapping("messages", ("{messages:[{content,role}]}", "{messages:[]}"), messages=("messages", "role", "content")),
    Mapping("conversations", ("{conversations:[{from,value}]}",), messages=("conversations", "from", "value"), rename=True),
    Mapping("dialog", ("{dialog:{turns:[{speaker,text}]}}",), messages=("dialog.turns", "speaker", "text"), rename=True),
    Mapping("prompt", ("{prompt,response}",), turns=(("user", ("prompt",), False), ("assistant", ("response",), False))),
    Mapping("completion", ("{completion,prompt}",), turns=(("user", ("prompt",), False), ("assistant", ("completion",), False))),
    Mapping("question", ("{data:{answer,question}}",), turns=(("user", ("data.question",), False), ("assistant", ("data.answer",), False))),
    Mapping(
        "instruction",
        ("{input,instruction,output}", "{instruction,output}"),
        turns=(("user", ("instruction", "input"), False), ("assistant", ("output",), False)),
    ),
    Mapping(
        "system_prompt",
        ("{prompt,response,system}",),
        turns=(("system", ("system",), True), ("user", ("prompt",), False), ("assistant", ("response",), False)),
    ),
)


def schema_text(record: Column) -> Column:
    """The nested field names of a JSON object as `{a,b:[{c>>>`, fields in order; null if it isn't JSON.

    Names are those of schema_of_variant without the types of scalars.
    """
    kind = F.schema_of_variant(F.try_parse_json(record))
    out = F.regexp_replace(F.regexp_replace(kind, "OBJECT<", "{"), "ARRAY<", "[")
    return F.regexp_replace(F.regexp_replace(out, r"(: |(?<=\[))[A-Z_]+(\(\d+,\d+\))?(?=[,>])", ""), r"(?<=[:,]) ", "")


def _plainly(schema: str) -> str:
    """A mapping's schema as schema_text writes it."""
    return schema.replace("}", ">").replace("]", ">")


def fingerprint(record: Column) -> Column:
    """The hash of a record's schema."""
    return F.xxhash64(schema_text(record))


def _role(role: Column, rename: bool) -> Column:
    out = F.coalesce(role, F.lit(""))
    for a, b in ROLE_NAMES.items() if rename else ():
        out = F.when(role == a, b).otherwise(out)
    return out


def _turns(record: Column, m: Mapping, meant: Callable[[Column], Column]) -> Column:
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if m.messages:
        path, role, text = m.messages
        items = F.from_json(F.get_json_object(record, f"$.{path}"), f"array<struct<`{role}`: string, `{text}`: string>>")
        return F.transform(items, lambda x: turn(_role(meant(x[role]), m.rename), meant(x[text])))
    out = []
    for role, paths, optional in m.turns:
        texts = [meant(F.get_json_object(record, f"$.{p}")) for p in paths]
        whole = texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n\n")
        made = turn(F.lit(role), whole)
        out.append(F.when(F.coalesce(whole, F.lit("")) != "", made) if optional else made)
    return F.filter(F.array(*out), lambda t: t.isNotNull())


def canonical(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with layout and turns: each record's mapping is the one of its schema's hash.

    In records with a column STRINGS, which goes, a record's strings are places in that array.
    """
    kept = [F.col(f"`{c}`") for c in records.columns if c.lower() not in (STRINGS, "layout", "turns")]
    strings = [F.col(STRINGS).alias("strings")] if STRINGS in records.columns else []
    nested = records.select(F.struct(*kept).alias("row"), F.col(column).alias("record"), fingerprint(F.col(column)).alias("mark"), *strings)
    meant = (lambda c: F.get("strings", c.cast("int"))) if strings else lambda c: c
    record, mark = F.col("record"), F.col("mark")
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for m in reversed(mappings):
        known = mark.isin(*(F.xxhash64(F.lit(_plainly(s))) for s in m.schemas))
        turns, layout = F.when(known, _turns(record, m, meant)).otherwise(turns), F.when(known, m.name).otherwise(layout)
    return nested.select("row.*", layout.alias("layout"), turns.cast(TURNS).alias("turns"))


def _written(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for a, b in escapes:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _read(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    for a, b in reversed(escapes):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def formatted(rows: DataFrame) -> DataFrame:
    """rows with formatted, the text of `turns`, and loss_mask, (start, length) of each assistant text in it."""
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            _written(t["role"], ROLE_ESCAPES).alias("role"), _written(t["text"], ESCAPES).alias("text"), (t["role"] == LEARNED_ROLE).alias("learned")
        ),
    )
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("formatted", "loss_mask")]
    nested = rows.select(F.struct(*kept).alias("row"), parts.alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: F.concat(F.lit(BEGIN), p["role"], F.lit(MIDDLE), p["text"], F.lit(END))), "")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, length: long>>").alias("mask"))

    def add(done: Column, p: Column) -> Column:
        start = done["at"] + len(BEGIN) + F.length(p["role"]) + len(MIDDLE)
        length = F.length(p["text"]).cast("long")
        span = F.struct(start.cast("long").alias("start"), length.alias("length"))
        mask = F.when(p["learned"], F.concat(done["mask"], F.array(span))).otherwise(done["mask"])
        return F.struct((start + length + len(END)).cast("long").alias("at"), mask.alias("mask"))

    return nested.select("row.*", whole.alias("formatted"), F.aggregate("parts", begin, add)["mask"].alias("loss_mask"))


def parse(text: Column) -> Column:
    """The (role, text) turns of a formatted text."""
    marked = F.split(F.regexp_replace(text, r"</turn>\n$", ""), END)
    length = len(BEGIN)

    def turn(t: Column) -> Column:
        middle = F.locate(MIDDLE, t)
        role = F.substring(t, F.lit(length + 1), middle - length - 1)
        return F.struct(
            _read(role, ROLE_ESCAPES).alias("role"), _read(F.substring(t, middle + len(MIDDLE), F.length(t)), ESCAPES).alias("text")
        )

    return F.when(text == "", F.array().cast(TURNS)).otherwise(F.transform(marked, turn))


def learned(text: Column, mask: Column) -> Column:
    """All text under the loss mask as it was before formatting, nothing between."""
    return F.array_join(F.transform(mask, lambda m: _read(F.substring(text, m["start"].cast("int") + 1, m["length"].cast("int")), ESCAPES)), "")


def records(rows: DataFrame) -> DataFrame:
    """conv_id, record and STRINGS: turns by row (conv_id, turn, role, text) as records, in the layout that their roles allow.

    A user and an assistant turn are a prompt record, with a system turn before them a system_prompt record, anything
    else a messages record.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = F.sort_array(F.collect_list(F.struct("turn", part("role").alias("role"), part("text").alias("text"))))
    grouped = rows.groupBy("conv_id").agg(turns.alias("_turns"))
    roles, text = F.array_join("_turns.role", "\x1f"), lambda k: F.get("_turns", F.lit(k))["text"]
    json = lambda *c: F.to_json(F.struct(*c))
    at = lambda k: F.lit(str(k))
    made = (
        F.when(roles == "user\x1fassistant", json(at(0).alias("prompt"), at(1).alias("response")))
        .when((roles == "system\x1fuser\x1fassistant") & (text(0) != ""), json(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response")))
        .otherwise(json(F.transform("_turns", lambda t, k: F.struct((F.size("_turns") + k).cast("string").alias("role"), k.cast("string").alias("content"))).alias("messages")))
    )
    return grouped.select("conv_id", made.alias("record"), F.concat("_turns.text", "_turns.role").alias(STRINGS))


def digest(rows: DataFrame) -> DataFrame:
    """What can be read back from formatted and loss_mask alone, a row a conversation."""
    read = rows.withColumn("_read", parse(F.col("formatted"))).withColumn("_learned", learned(F.col("formatted"), F.col("loss_mask")))
    whole = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )

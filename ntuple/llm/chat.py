r"""Chat formatting by schema fingerprints.

Native.  A record is a JSON text in whatever layout its source uses.  The nested field paths of
the record are hashed; the hash selects a declarative mapping (which fields hold the turns and
who says them), and the mapping turns the record into canonical ``(role, text)`` turns.  Texts of
any length may stay out of the JSON: an outline has the number of a text in each of its places,
and the texts stand beside it.  Turns
are rendered between control strings; control characters in texts are escaped reversibly:
``\`` is written ``\b``, ``<`` is ``\l`` and ``>`` is ``\g``, so ``<turn:`` and ``</turn>``
occur only where a turn begins or ends.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, sums_before

OPEN, SHUT, END = "<turn:", ">", "</turn>"
TURNS = "array<struct<role:string,text:string>>"
#: Bytes that Spark lets a variant have, and characters that its JSON reader lets a string have.
VARIANT_BYTES = 128 << 20
STRING_CHARS = 20_000_000
#: Takes the place of :data:`STRING_CHARS` where options can be given.
LONG = {"maxStringLen": str((1 << 31) - 1)}


@dataclass(frozen=True)
class Mapping:
    """How one layout is read.

    ``sample`` is a record of the layout; its field paths are the fingerprint.  ``turns`` is the
    path of a list of messages with the fields ``role`` and ``text``; without it, ``said`` lists
    ``(path, role)`` of single texts in order.  ``roles`` renames roles.
    """

    name: str
    sample: dict
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    said: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Mapping("messages", {"messages": [{"role": "", "content": ""}]}, "$.messages"),
    Mapping(
        "conversations",
        {"conversations": [{"from": "", "value": ""}]},
        "$.conversations",
        "from",
        "value",
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Mapping("prompt", {"prompt": "", "completion": ""}, said=(("$.prompt", "user"), ("$.completion", "assistant"))),
    Mapping("response", {"prompt": "", "response": ""}, said=(("$.prompt", "user"), ("$.response", "assistant"))),
    Mapping(
        "instruction",
        {"instruction": "", "input": "", "output": ""},
        said=(("$.instruction", "user"), ("$.input", "user"), ("$.output", "assistant")),
    ),
    Mapping("short instruction", {"instruction": "", "output": ""}, said=(("$.instruction", "user"), ("$.output", "assistant"))),
    Mapping(
        "nested",
        {"system": "", "data": {"question": "", "answer": ""}},
        said=(("$.system", "system"), ("$.data.question", "user"), ("$.data.answer", "assistant")),
    ),
)


def parsed(record: Column) -> Column:
    """The variant of a JSON record, null for other text; an error for what Spark cannot hold.

    ``try_parse_json`` also gives null for strings over :data:`STRING_CHARS`, so long records
    are read again without that limit.  A variant is at most eight times as long as its text.
    """
    quick = F.try_parse_json(record)
    again = F.from_json(record, "variant", LONG)
    too_long = F.raise_error(
        F.lit(f"a record of over {VARIANT_BYTES // 8} bytes is not JSON or its variant has over {VARIANT_BYTES} bytes")
    )
    size = F.octet_length(record)
    return F.coalesce(
        quick,
        F.when(size > STRING_CHARS, again),
        F.when(size > VARIANT_BYTES // 8, F.try_parse_json(too_long.cast("string"))),
    )


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON record, whatever the types of its leaves.

    The schema of a variant lists the fields of an object by name, so the order in which a
    record writes them does not matter.  Null for text that is not JSON.
    """
    schema = F.schema_of_variant(parsed(record))
    shape = F.regexp_replace(schema, r": (?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\(\d+,\d+\))", "")
    return F.xxhash64(F.when(shape.isNotNull(), shape))


def shapes_of(mapping: Mapping) -> list[str]:
    """The record of a layout, and the one with an empty list of messages."""
    samples = [mapping.sample]
    if mapping.turns:
        samples.append({k: [] for k in mapping.sample})
    return [json.dumps(s) for s in samples]


def mapped(record: Column, mapping: Mapping, texts: Column | None = None) -> Column:
    """The turns of a record under one mapping; missing and null texts are empty.

    With ``texts`` the record is an outline: its leaves are places in that array.
    """

    def look(leaf: Column) -> Column:
        return F.coalesce(leaf if texts is None else F.get(texts, leaf.cast("int")), F.lit(""))

    if mapping.turns is None:
        variant = parsed(record)
        turns = F.array(
            *[
                F.struct(F.lit(role).alias("role"), look(F.try_variant_get(variant, path, "string")).alias("text"))
                for path, role in mapping.said
            ]
        )
        # An optional field that is empty says nothing.
        optional = {path for path, _ in mapping.said if is_optional(path)}
        if optional:
            kept = [
                F.when(F.lit(path not in optional) | (turns[i]["text"] != ""), F.array(turns[i])).otherwise(F.array().cast(TURNS))
                for i, (path, _) in enumerate(mapping.said)
            ]
            return F.concat(*kept)
        return turns
    fields = f"array<struct<`{mapping.role}`:string,`{mapping.text}`:string>>"
    name = mapping.turns.removeprefix("$.")
    messages = F.from_json(record, f"`{name}` {fields}", LONG)[name]

    def turn(m: Column) -> Column:
        role = look(m[mapping.role])
        for old, new in mapping.roles:
            role = F.when(look(m[mapping.role]) == old, new).otherwise(role)
        return F.struct(role.alias("role"), look(m[mapping.text]).alias("text"))

    return F.coalesce(F.transform(messages, turn), F.array().cast(TURNS)).cast(TURNS)


def is_optional(path: str) -> bool:
    return path.endswith((".input", ".system"))


def canonical_turns(
    df: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = LAYOUTS, *, texts: str | None = None
) -> DataFrame:
    """Add ``layout`` and ``turns`` (array of ``role``, ``text``) to records, or to outlines with ``texts``.

    A record that is null, is not JSON or has an unknown layout keeps its row, with null in both.
    Null roles and texts are empty.  The columns ``layout`` and ``turns`` are replaced.  A record
    whose variant has over :data:`VARIANT_BYTES` is an error (see :func:`parsed`).
    """
    df = df.withColumn("_shape", fingerprint(F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mapping in reversed(mappings):
        same = F.lit(False)
        for sample in shapes_of(mapping):
            same = same | (F.col("_shape") == fingerprint(F.lit(sample)))
        layout = F.when(same, mapping.name).otherwise(layout)
        places = None if texts is None else F.col(texts)
        turns = F.when(F.col("_layout") == mapping.name, mapped(F.col(record), mapping, places)).otherwise(turns)
    found = df.withColumn("_layout", layout)
    return found.withColumns({"layout": F.col("_layout"), "turns": turns}).drop("_shape", "_layout")


def escape(text: Column) -> Column:
    for char, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def render(df: DataFrame, turns: str = "turns", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and ``loss_spans``: where (code points, end exclusive) learned texts stand.

    Null turns give null; no turns give an empty text without spans.
    """
    parts = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SHUT)).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(*learn).alias("learn"),
        ),
    )
    lengths = F.transform("_parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + F.lit(len(END)))
    starts = sums_before(F.col("_lengths"))
    spans = F.filter(
        F.transform(
            "_parts",
            lambda p, i: F.when(
                p["learn"],
                F.struct(
                    (F.get("_starts", i) + F.length(p["head"])).alias("start"),
                    (F.get("_starts", i) + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return (
        df.withColumn("_parts", parts)
        .withColumn("_lengths", lengths)
        .withColumn("_starts", starts)
        .withColumns({"formatted": text, "loss_spans": spans})
        .drop("_parts", "_lengths", "_starts")
    )


def read_back(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    pieces = F.split(formatted, F.lit(END))
    full = F.filter(pieces, lambda p: p != "")
    return F.transform(
        full,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SHUT, 1)).alias("role"),
            unescape(F.substr(p, F.locate(SHUT, p) + 1)).alias("text"),
        ),
    )


def learned(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, joined without anything between."""
    cut = F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(cut, "")


def conversation_messages(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``messages`` (``role``, ``content``) from rows by turn.

    Turns are in order of ``turn``, then ``role`` and ``text``; nulls come first.  A row without
    ``conv_id`` is a conversation of its own.  Rows that repeat are turns that repeat.
    """
    message = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = rows.select("conv_id", alone.alias("_alone"), "turn", message.alias("message")).groupBy("conv_id", "_alone")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "message")))
    return grouped.agg(ordered.alias("ordered")).select("conv_id", F.transform("ordered", lambda x: x["message"]).alias("messages"))


def conversation_records(rows: DataFrame) -> DataFrame:
    """One ``messages`` record for each ``conv_id``, as :func:`conversation_messages` has them."""
    return conversation_messages(rows).select("conv_id", F.to_json(F.struct("messages")).alias("record"))


def fitting(messages: Column, mapping: Mapping) -> Column:
    """Whether a layout can hold these messages so that the same turns come back."""
    roles = F.transform(messages, lambda m: m["role"])
    if mapping.turns:
        return ~F.exists(roles, lambda r: r.isin([old for old, _ in mapping.roles])) if mapping.roles else F.lit(True)
    fits = roles == F.array(*[F.lit(role) for _, role in mapping.said])
    for i, (path, _) in enumerate(mapping.said):
        if is_optional(path):
            fits = fits & (F.get(messages, F.lit(i))["content"] != "")
    return fits


def dealt_layout(messages: Column, number: Column, mappings: tuple[Mapping, ...] = LAYOUTS) -> Column:
    """The name of one of the layouts that can hold the messages, dealt by the hash of ``number``."""
    names = F.array_compact(F.array(*[F.when(fitting(messages, m), m.name) for m in mappings]))
    return bound(names, lambda n: F.get(n, F.pmod(F.xxhash64(number), F.size(n)).cast("int")))


def numbered(messages: Column, mapping: Mapping) -> Column:
    return F.transform(messages, lambda _, i: F.struct((2 * i).alias(mapping.role), (2 * i + 1).alias(mapping.text)))


def outline(messages: Column, layout: Column, mappings: tuple[Mapping, ...] = LAYOUTS) -> Column:
    """The record of the messages in a layout, with the place of a text (see :func:`placed_texts`) for each."""
    out = F.lit(None).cast("string")
    for mapping in mappings:
        if mapping.turns:
            record = F.to_json(F.struct(numbered(messages, mapping).alias(mapping.turns.removeprefix("$."))))
        else:
            fields: dict = {}
            for i, (path, _) in enumerate(mapping.said):
                *above, last = path.removeprefix("$.").split(".")
                inner = fields
                for name in above:
                    inner = inner.setdefault(name, {})
                inner[last] = 2 * i + 1
            record = F.lit(json.dumps(fields))
        out = F.when(layout == mapping.name, record).otherwise(out)
    return out


def placed_texts(messages: Column, layout: Column, mappings: tuple[Mapping, ...] = LAYOUTS) -> Column:
    """Role and text of each message in turn, roles as the layout writes them."""

    def both(m: Column) -> Column:
        role = m["role"]
        for mapping in mappings:
            for old, new in mapping.roles:
                role = F.when((layout == mapping.name) & (m["role"] == new), old).otherwise(role)
        return F.array(role, m["content"])

    return F.flatten(F.transform(messages, both))


def conversation_turns(rows: DataFrame, layout: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``conv_id``, ``layout`` and ``turns`` of rows by turn, whatever their size.

    Each conversation becomes an outline in the layout that ``layout`` (of its messages and its
    ``conv_id``; default: ``messages`` for all) names, and is read back by the fingerprint of that outline.
    """
    messages = conversation_messages(rows)
    named = F.lit("messages") if layout is None else layout(F.col("messages"), F.col("conv_id"))
    known = messages.withColumn("_written", named)
    outlined = known.select(
        "conv_id",
        outline(F.col("messages"), F.col("_written")).alias("record"),
        placed_texts(F.col("messages"), F.col("_written")).alias("texts"),
    )
    return canonical_turns(outlined, texts="texts").select("conv_id", "layout", "turns")

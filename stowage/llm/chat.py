r"""Chat formatting by schema fingerprints.

The nested field paths of a layout (``messages[].role`` and the like), sorted
and hashed, are its fingerprint; a registry maps fingerprints to declarative
mappings that say where the conversation's turns are, and a layout whose hash
is not in it is unknown. A table has one layout, that of its schema; paths that no
mapping has are no part of it. Records of mixed layouts in JSON, such as prompts, instructions and messages in one table, are
fingerprinted one by one; an unknown layout keeps its record with a null list
of turns, so that nothing is lost silently.

Formatted text: for each turn ``<|im_start|>role\ntext<|im_end|>\n``. Inside
roles and texts a backslash becomes two and every control string of the known
templates gets a backslash after its first character, so no text can end or
start a turn; a line end in a role gets a backslash before it. A backslash
followed by any character stands for that character.
The loss mask is the list of spans (code points, end exclusive) of assistant
texts in the formatted string.

Defined results: a null text or role is empty; a conversation without turns is
the empty string. Turns are ordered by turn (null first), then role, then
text; rows that repeat a turn are turns of their own. Rows by turn with a null
conversation id are conversations of one turn each, whose id is null.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .memory import give_back, small_batches
from .shared import free_name

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of public chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns``: (path of a list, path of the role, path of the text) or None;
    ``fields``: ((role, paths joined by an empty line), ...) for flat layouts;
    ``rows``: (conversation, order, role, text) for layouts of a row per turn.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rows: tuple[str, str, str, str] | None = None


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    """Hash of a layout's sorted distinct field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


MAPPINGS = [
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Mapping("turn rows with sender", ("conversation_id", "position", "sender", "content"), rows=("conversation_id", "position", "sender", "content")),
    Mapping("messages", ("messages[].role", "messages[].content"), turns=("messages", "role", "content")),
    Mapping("messages with text", ("messages[].role", "messages[].text"), turns=("messages", "role", "text")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value")),
    Mapping("prompt and response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt and completion", ("prompt", "completion"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question and answer", ("question", "answer"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction with input", ("instruction", "input", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system, instruction and input", ("system", "instruction", "input", "output"), fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
]
REGISTRY = {fingerprint(m.paths): m for m in MAPPINGS}
#: Other names of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Field paths of a Spark type; ``[]`` stands for the elements of a list."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def value_paths(value: object, prefix: str = "") -> set[str]:
    """Field paths of a parsed JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def layout_of(table: DataFrame, besides: tuple[str, ...] = ()) -> Mapping:
    """The mapping that the fingerprint of a table's schema selects; ValueError if it selects none.

    Paths that no mapping knows, and the columns ``besides``, are left out
    before hashing.
    """
    known = {p for m in MAPPINGS for p in m.paths}
    paths = [p for f in table.schema.fields if f.name not in besides for p in schema_paths(f.dataType, f.name) if p in known]
    if (found := REGISTRY.get(fingerprint(paths))) is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return found


def _word(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _role(value: Column) -> Column:
    """The common name of a role that has others."""
    out = _word(value)
    for other, name in ROLES.items():
        out = F.when(_word(value) == other, name).otherwise(out)
    return out


def canonical(table: DataFrame, id_col: str = "conv_id", besides: tuple[str, ...] = ()) -> DataFrame:
    """``conv_id, turns`` of a table whose columns are of one layout, by the mapping that its fingerprint selects.

    ``id_col`` names a row's conversation where the layout has no such column.
    """
    layout = layout_of(table, besides)
    if layout.rows:
        conv, order, role, text = (F.col(f"`{c}`") for c in layout.rows)
        turn = F.struct(order.alias("turn"), _word(role).alias("role"), _word(text).alias("text"))
        rows = table.select(conv.alias("conv_id"), F.when(conv.isNull(), F.monotonically_increasing_id()).alias("alone"), turn.alias("t"))
        grouped = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("t"))
        return grouped.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    if layout.turns:
        at, role, text = layout.turns
        turns = F.transform(F.coalesce(F.col(f"`{at}`"), F.array()), lambda x: F.struct(_role(x[role]).alias("role"), _word(x[text]).alias("text")))
    else:
        said = []
        for role, paths in layout.fields:
            text = F.array_join(F.filter(F.array(*(_word(F.col(f"`{p}`")) for p in paths)), lambda x: x != ""), "\n\n")
            said.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
        turns = F.filter(F.array(*said), lambda t: (t["text"] != "") | (t["role"] == "assistant"))
    return table.select(F.col(f"`{id_col}`").alias("conv_id"), turns.alias("turns"))


def _turns(record: dict, mapping: Mapping) -> list[dict]:
    word = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    if mapping.turns:
        at, role, text = mapping.turns
        return [{"role": ROLES.get(word(x.get(role)), word(x.get(role))), "text": word(x.get(text))} for x in record[at]]
    said = [(role, "\n\n".join(s for s in (word(record.get(p)) for p in paths) if s)) for role, paths in mapping.fields]
    return [{"role": role, "text": text} for role, text in said if text or role == "assistant"]


def canonical_records(records: DataFrame, json_col: str = "record") -> DataFrame:
    """``records`` with ``layout`` (a mapping's name or null), ``layout_fingerprint`` and ``turns``."""

    @F.pandas_udf(f"layout string, layout_fingerprint string, turns {TURNS}")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw in batch:
                try:
                    record = json.loads(raw) if isinstance(raw, str) else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    out.append((None, None, None))
                    continue
                print_ = fingerprint(tuple(value_paths(record)))
                mapping = REGISTRY.get(print_)
                usable = mapping and not mapping.rows
                out.append((mapping.name if usable else None, print_, _turns(record, mapping) if usable else None))
            yield pd.DataFrame(out, columns=["layout", "layout_fingerprint", "turns"], index=batch.index)
        give_back()

    new = ("layout", "layout_fingerprint", "turns")
    kept = [F.col(f"`{c}`") for c in records.columns if c not in new]
    chat = free_name(records, "_chat")
    small_batches(records.sparkSession)
    return records.withColumn(chat, convert(F.col(f"`{json_col}`"))).select(*kept, f"{chat}.*")


def escape(text: Column, control: list[str] = CONTROL) -> Column:
    r"""``\`` becomes ``\\``; each control string gets a ``\`` after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in control:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> tuple[Column, Column]:
    """(formatted text, loss mask as an array of structs start, end) of a column of turns."""
    said = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), F.replace(escape(t.role), F.lit("\n"), F.lit("\\\n")), F.lit("\n")).alias("head"),
            escape(t.text).alias("body"),
            (t.role == "assistant").alias("loss"),
        ),
    )
    whole = F.array_join(F.transform(said, lambda s: F.concat(s["head"], s["body"], F.lit(END))), "")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["head"])
        end = start + F.length(s["body"])
        return F.struct(
            (end + len(END)).alias("at"),
            F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        )

    return whole, F.aggregate(said, begin, step, lambda acc: acc["spans"])


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^<\|im_start\|>((?:\\.|[^\n\\])*+)\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^<\|im_start\|>(?:\\.|[^\n\\])*+\n", "")).alias("text"),
        ),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` of ``conv_id, turns``."""
    formatted, mask = format_turns(F.col("turns"))
    return conversations.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))

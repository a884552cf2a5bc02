"""Chat formatting: conversations rendered by a compiled template, with the spans of generated text, and read back.

The template (language and sandbox: ``templates``) marks every turn with control strings and writes each role and text through
the filter ``escape``: a backslash gets a second one, and a control string inside a text gets a backslash behind its first
character.  So no control string is left inside a text, and dropping one backslash of each pair gives the text back.
``{% generation %}`` blocks mark what a model learns to write; their spans are the loss mask.

``read_back`` needs nothing but the rendered text and the mask.

Turns of a conversation are one row of the result, so they meet in one task; conversations are spread by their id.

Defined cases: null roles and texts are empty; turns go by number (nulls first), equal numbers by role, then text; repeated
rows are turns of their own; rows with a null id are one conversation; a conversation without generated text has no spans and
an empty loss text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of
from tidewatch.llm.templates import compile_template

#: Only the first character of a control string is "<" or "[", so two of them never overlap and none straddles the end of a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[REPLY]", "[TURN]", "[TEXT]", "[/TURN]")
TEMPLATE = """
{#- Users open a sequence, assistants close it; any other role is written out. -#}
{%- for turn in turns -%}
  {%- if turn.role == 'user' -%}
    {{ '<s>' + '[INST]' }}{{ turn.text | escape }}{{ '[/INST]' }}
  {%- elif turn.role == 'assistant' -%}
    {{ '[REPLY]' }}{% generation %}{{ turn.text | escape }}{% endgeneration %}{{ '</s>' }}
  {%- else -%}
    {{ '[TURN]' }}{{ turn.role | escape }}{{ '[TEXT]' }}{{ turn.text | escape }}{{ '[/TURN]' }}
  {%- endif -%}
{%- endfor -%}
"""
#: How the turns of ``TEMPLATE`` look when read: (opening, role or None where it is written out, what parts role and text, closing).
SHAPES = (("<s>[INST]", "user", "", "[/INST]"), ("[REPLY]", "assistant", "", "</s>"), ("[TURN]", None, "[TEXT]", "[/TURN]"))
_SPANS = pa.struct([("start", pa.int64()), ("end", pa.int64())])


@lru_cache
def _guarded(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, ("\\", *sorted(controls, key=len, reverse=True)))))


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    return _guarded(controls).sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@lru_cache
def renderer(template: str, controls: tuple[str, ...]):
    return compile_template(template, {"escape": lambda v: escape(str(v), controls)})


@lru_cache
def _reader(shapes: tuple) -> re.Pattern:
    """One alternative per shape, each with a group for the role and one for the text, up to its own closing."""
    parts = [f"{re.escape(a)}{f'(.*?){re.escape(mid)}' if role is None else '()'}(.*?){re.escape(z)}" for a, role, mid, z in shapes]
    return re.compile("|".join(parts), re.S)


def read_turns(formatted: str, shapes: tuple = SHAPES) -> list[tuple[str, str]]:
    """(role, text) of every turn; raises where something is not a turn."""
    turns, at = [], 0
    while at < len(formatted):
        m = _reader(shapes).match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {formatted[at : at + 20]!r}")
        number = (m.lastindex - 1) // 2
        role = shapes[number][1]
        turns.append((unescape(m[2 * number + 1]) if role is None else role, unescape(m[2 * number + 2])))
        at = m.end()
    return turns


def gathered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): one row per conversation, its turns (turn, role, text) in order."""
    one = F.struct(F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))
    return rows.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def formatted(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TEMPLATE,
              controls: tuple[str, ...] = CONTROLS, values: dict | None = None) -> DataFrame:
    """(conv, formatted, spans): the rendered conversations and what generation blocks wrote.  ``values`` are further names for the template."""
    more = dict(values or {})
    compile_template(template, {"escape": escape})  # a faulty template is refused before any task runs

    @F.arrow_udf("struct<formatted: string, spans: array<struct<start: bigint, end: bigint>>>")
    def render(turns: pa.Array) -> pa.Array:
        run = renderer(template, controls)
        texts, spans, offsets = [], [], [0]
        for conversation in turns.to_pylist():
            done, marked = run({**more, "turns": conversation})
            texts.append(done)
            spans += [{"start": s, "end": e} for s, e in marked]
            offsets.append(len(spans))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(spans, _SPANS))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), lists], names=["formatted", "spans"])

    done = gathered(rows, conv, turn, role, text).select(conv, render("turns").alias("out"))
    return done.select(conv, "out.formatted", "out.spans")


def read_back(rendered: DataFrame, shapes: tuple = SHAPES) -> DataFrame:
    """All columns of ``formatted`` with ``turns`` (role, text) and ``loss``, the unescaped text under the mask."""

    @F.arrow_udf("struct<turns: array<struct<role: string, text: string>>, loss: string>")
    def read(texts: pa.Array, spans: pa.Array) -> pa.Array:
        turns, loss = [], []
        for text, marked in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            turns.append([{"role": r, "text": t} for r, t in read_turns(text, shapes)])
            loss.append("".join(unescape(text[s["start"] : s["end"]]) for s in marked))
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(turns, kind), pa.array(loss, pa.string())], names=["turns", "loss"])

    return rendered.withColumn("__read", read("formatted", "spans")).select(*rendered.columns, "__read.turns", "__read.loss")

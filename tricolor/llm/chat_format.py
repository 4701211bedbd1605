"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. Its output is never
interpreted to find the turns: successive prefixes of a conversation are rendered, and what one
more turn adds to the previous output is that turn's span. Inside the span the text is found by
rendering the same prefix with a probe character for the turn's text. A template whose longer output does
not begin with the shorter one rewrites history; its first such turn is reported and it has no loss mask.

Conversations are gathered by Spark (one row each) and rendered in tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.llm.common import ship

Turn = tuple[str, str]
PROBE = "\ue000"

# Control strings of common chat templates, escaped wherever a text holds one.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)


@lru_cache(maxsize=1024)
def escape(text: str) -> str:
    """Reversible: a backslash is doubled, a control string gets a backslash and ``x`` after its
    first character. No control string is left, since none holds a backslash and none overlaps
    another."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\x" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"x": "", "n": "\n"}.get(m[1], m[1]), text)


def render_turns(turns: list[Turn]) -> str:
    """The library's own template: each turn between control strings, its role on the first line."""
    return "".join(f"<|im_start|>{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}<|im_end|>\n" for role, text in turns)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(output: str) -> list[Turn]:
    """The turns back from an output of ``render_turns``."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(output)]


def locate(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """(output, spans, rewritten): for each turn (start, text start, text end, end) in the output.

    ``rewritten`` is the first turn whose addition changed what was rendered before it; the spans
    then stop there. A template that alters or drops a text has an empty text span for that turn.
    """
    before, spans = render([]), []
    for i in range(len(turns)):
        now = render(turns[:i + 1])
        if not now.startswith(before):
            return render(turns), spans, i
        probe = render([*turns[:i], (turns[i][0], PROBE)])
        head, tail = probe.rfind(PROBE, len(before)), len(probe) - 1
        if probe.startswith(before) and head >= 0:
            end = len(now) - (tail - head)
            same = now[:head] == probe[:head] and now[end:] == probe[head + 1:] and end >= head
        else:
            same = False
        spans.append((len(before), head, end, len(now)) if same else (len(before), len(now), len(now), len(now)))
        before = now
    return before, spans, None


def _formatter(render: Callable[[list[Turn]], str], trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("formatted", "spans", "loss", "rewritten")}
            for turns in b.column("turns").to_pylist():
                turns = [(t["role"], t["text"]) for t in turns]
                text, spans, rewritten = locate(turns, render)
                out["formatted"].append(text)
                out["spans"].append([dict(zip(("start", "text_start", "text_end", "end"), s)) for s in spans])
                out["loss"].append([] if rewritten is not None else
                                   [{"start": a, "end": e} for (_, a, e, _), (role, _) in zip(spans, turns) if role == trained and e > a])
                out["rewritten"].append(rewritten)
            span = pa.struct([(n, pa.int64()) for n in ("start", "text_start", "text_end", "end")])
            mask = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(out["formatted"], pa.string()), pa.array(out["spans"], pa.list_(span)),
                                              pa.array(out["loss"], pa.list_(mask)), pa.array(out["rewritten"], pa.int32())],
                                             names=["conv_id", "formatted", "spans", "loss", "rewritten"])
    return run


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 render: Callable[[list[Turn]], str] = render_turns, trained: str = "assistant") -> DataFrame:
    """One row per conversation: (id, formatted, spans, loss, rewritten).

    ``spans`` has (start, text_start, text_end, end) of each turn in ``formatted`` (code points),
    ``loss`` the spans of the trained role's texts, ``rewritten`` the first turn that changed
    earlier output (then ``loss`` is empty) or null.

    Edge cases: null texts and roles are empty strings; rows go by turn, null turns first, ties by
    role and text; repeated rows are turns like others; rows with a null id are one conversation;
    an empty table gives an empty result; other columns are not read.
    """
    ship(df.sparkSession)
    turns = df.select(F.col(id_col).cast("bigint").alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return (grouped.mapInArrow(_formatter(render, trained), "conv_id long, formatted string, "
                               "spans array<struct<start:long,text_start:long,text_end:long,end:long>>, "
                               "loss array<struct<start:long,end:long>>, rewritten int").withColumnRenamed("conv_id", id_col))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
            turns = read_turns(text)
            learned = "".join(unescape(text[s["start"]:s["end"]]) for s in loss)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out["loss_chars"].append(len(learned))
            out["loss_sha256"].append(hashlib.sha256(learned.encode()).hexdigest())
            out["formatted_chars"].append(len(text))
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v) for v in out.values()]], names=["conv_id", *out])


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from the outputs of ``format_chats`` with the library's template."""
    return formatted.select(F.col(id_col).alias("conv_id"), "formatted", "loss").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

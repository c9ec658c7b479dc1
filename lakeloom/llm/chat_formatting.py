"""Operator 11: chat formatting by any template, with each turn's place found from what the template puts out.

A template is a function from turns (role, text) to a text; nothing else is known of it. It is run on the first
turn, the first two and so on. What a run adds to the one before is the new turn's span. A run that doesn't begin
with the one before has rewritten history (dropped old reasoning, moved a system prompt): such a conversation has
no spans that hold for its final text, and is reported. Where a turn's own text lies within its span is found
with two other texts in its place: what both runs share ahead of and behind them is the template's.

Long conversations are rendered page by page, so that the work grows with the turns and a conversation of any
length is spread over tasks: a page's runs begin with the last turns of the page before, and the last of those
has to come out as it did there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import _common as C
from lakeloom.plans import bands as B

Turns = list[tuple[str, str]]
Render = Callable[[Turns], str]
#: Turns of a page, and turns of the page before that its runs begin with.
PAGE, CONTEXT = 32, 2
#: Two texts without a character in common, which show where a template puts a text.
PROBES = ("x", "y")


@dataclass
class Located:
    """A run over all turns: its text, spans of the turns and of their texts (None where not found), the first turn at which history was rewritten."""

    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int] | None] = field(default_factory=list)
    rewritten_at: int | None = None


def _shared(a: str, b: str) -> int:
    """How many characters two short texts share at their beginning."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _text_span(render: Render, before: Turns, role: str, base: str, added: str) -> tuple[int, int] | None:
    """Where in `added` the turn's own text lies, None if the template doesn't put it between the same words as other texts."""
    one, two = (render([*before, (role, p)]) for p in PROBES)
    if not (one.startswith(base) and two.startswith(base)):
        return None
    one, two = one[len(base) :], two[len(base) :]
    head, tail = _shared(one, two), _shared(one[::-1], two[::-1])
    if one == two or len(added) < head + tail or added[:head] != one[:head] or added[len(added) - tail :] != one[len(one) - tail :]:
        return None
    return head, len(added) - tail


def locate(render: Render, turns: Turns, known: int = 0, wanted: Callable[[str], bool] = lambda role: True) -> Located:
    """Runs the template over turns[:known+1], turns[:known+2] ... and compares each run with the one before.

    Spans are of the turns from `known` on; texts are looked for in turns whose role is wanted. It stops
    at a run that doesn't begin with the one before, with the text of the run over all turns.
    """
    before, out = render(turns[:known]) if known else "", Located("")
    for k in range(known, len(turns)):
        now = render(turns[: k + 1])
        if not now.startswith(before):
            return Located(render(turns), rewritten_at=k)
        span = _text_span(render, turns[:k], turns[k][0], before, now[len(before) :]) if wanted(turns[k][0]) else None
        out.spans.append((len(before), len(now)))
        out.texts.append(span and (len(before) + span[0], len(before) + span[1]))
        before = now
    out.text = before
    return out


#: Control strings of common chat formats (fixed by those formats).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|turn|>", "<|end|>")


class MarkedTemplate:
    """Turns as `<|turn|>role`, a line end, the text, `<|end|>` and a line end.

    Control strings inside texts get a backslash after their first character, and so do those that have
    backslashes there already; taking one away gives the text back. In roles a line end is written `\\n`.
    """

    START, END = "<|turn|>", "<|end|>"

    def __init__(self, controls: tuple[str, ...] = CONTROLS):
        rests = sorted({(c[0], c[1:]) for c in (*controls, self.START, self.END)})
        self._firsts = {first for first, _ in rests}
        self._to_mark = re.compile("|".join(rf"(?<={re.escape(first)})(?=\\*{re.escape(rest)})" for first, rest in rests))
        self._marked = re.compile("|".join(rf"(?<={re.escape(first)})\\(?=\\*{re.escape(rest)})" for first, rest in rests))

    def escape(self, text: str) -> str:
        return self._to_mark.sub(r"\\", text) if any(c in text for c in self._firsts) else text

    def unescape(self, text: str) -> str:
        return self._marked.sub("", text) if "\\" in text else text

    def _role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def render(self, turns: Turns) -> str:
        return "".join([f"{self.START}{self._role(role)}\n{self.escape(text)}{self.END}\n" for role, text in turns])

    def parse(self, formatted: str) -> Turns:
        """The turns of a formatted text."""
        out = []
        for part in formatted.split(self.END + "\n")[:-1]:
            role, text = part.removeprefix(self.START).split("\n", 1)
            plain = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role), flags=re.DOTALL)
            out.append((plain, self.unescape(text)))
        return out


def format_conversations(df: DataFrame, render: Render, loss_roles: tuple[str, ...] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", page: int = PAGE, context: int = CONTEXT) -> DataFrame:
    """Pages of formatted conversations, a row a page: (id_col, page int, formatted string, turns array<int>, loss_starts, loss_ends array<int>, rewritten_at int, unplaced int, joins boolean).

    turns are the ends of the page's turns in `formatted`; loss_starts and loss_ends bound the texts under the
    loss mask, those of turns whose role is in loss_roles. A page's formatted text goes on where the one of the page before
    ends. `unplaced` counts masked texts that the template changed and that so have no span. If a run rewrites
    history, rewritten_at is the turn's number in the page, from 0, at which it was noticed, and there are no
    spans; `formatted` is then the run over the whole conversation, or null if that has further pages. joins
    is whether the page's first context came out as on the page before (true for first pages).

    Turns go by turn, role and text (nulls first); equal rows count each, null roles and texts are empty,
    null ids are one conversation. Texts of any length are taken whole, further columns of any name are left
    out, an empty table gives an empty one.
    """
    spark = df.sparkSession
    C.ship(spark)
    kind = dict(df.dtypes)[id_col].replace("bigint", "long")
    keys = ["conv"]
    rows = df.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("said"))
    placed = B.positions(B.banded(rows, keys, ["turn", "role", "said"]), keys, "pos").select("conv", "pos", "role", "said")
    # the last turns of a page go to the next page too
    own = F.floor((F.col("pos") - 1) / page).cast("int")
    to = F.when((F.col("pos") - 1) % page >= page - context, F.array(own, own + 1)).otherwise(F.array(own))
    pages = placed.withColumn("page", F.explode(to))
    schema = f"conv {kind}, page int, formatted string, turns array<int>, loss_starts array<int>, loss_ends array<int>, rewritten_at int, unplaced int, border string, rim string"

    def one(key, table):
        """A page: page + context turns at most."""
        out = C.arrow_schema(schema)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pos", "role", "said")), strict=True))
        known = sum(pos <= key[1].as_py() * page for pos, _, _ in rows)
        turns = [(role, said) for _, role, said in rows]
        if known == len(turns):  # nothing but context: the page before was the last
            return out.empty_table()
        made = locate(render, turns, known, lambda role: role in loss_roles)
        if made.rewritten_at is not None:
            got = [made.text if not known else None, [], [], [], made.rewritten_at - known, 0, None, None]
        else:
            low = made.spans[0][0]
            masked = [t for (role, _), t in zip(turns[known:], made.texts, strict=True) if role in loss_roles]
            found = [t for t in masked if t]
            rim = _digest(made.text[slice(*made.spans[-1])])
            ahead = locate(render, turns[:known], known - 1, lambda role: False) if known > 1 else None
            border = _digest(ahead.text[slice(*ahead.spans[0])]) if ahead and ahead.spans else None
            got = [made.text[low:], [e - low for _, e in made.spans], [s - low for s, _ in found], [e - low for _, e in found], None, len(masked) - len(found), border, rim]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([key[0].as_py(), key[1].as_py(), *got], out, strict=True)], schema=out)

    made = C.saved(pages.groupBy("conv", "page").applyInArrow(one, schema))
    # pages of long conversations, each with what the page before ended in
    before = made.where("rim is not null").select(F.col("conv").alias("its"), (F.col("page") + 1).alias("next"), "rim")
    further = made.where("page > 0").drop("rim").join(before, F.col("conv").eqNullSafe(F.col("its")) & (F.col("page") == F.col("next")), "left")
    further = further.withColumn("joins", F.col("border").eqNullSafe(F.col("rim")) & F.col("border").isNotNull())
    first = made.where("page = 0").withColumn("joins", F.lit(True))
    counts = made.where("page = 1").select(F.col("conv").alias("its"), F.lit(True).alias("more"))
    broken = first.where("rewritten_at is not null").join(counts, F.col("conv").eqNullSafe(F.col("its")), "left").withColumn("formatted", F.when(F.col("more").isNull(), F.col("formatted")))
    names = ["conv", "page", "formatted", "turns", "loss_starts", "loss_ends", "rewritten_at", "unplaced", "joins"]
    return first.where("rewritten_at is null").select(*names).unionByName(broken.select(*names)).unionByName(further.select(*names)).withColumnRenamed("conv", id_col)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def history_report(pages: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, rewrites_history boolean, context_dependent boolean, unplaced long) of each conversation: what its template did to it.

    context_dependent: no history was rewritten, but a page came out differently after other turns than the next ones before it.
    """
    said = pages.groupBy(id_col).agg(F.max(F.col("rewritten_at").isNotNull()).alias("rewrites_history"), F.min("joins").alias("joins"), F.sum(F.col("unplaced").cast("long")).alias("unplaced"))
    return said.select(id_col, "rewrites_history", (~F.col("joins") & ~F.col("rewrites_history")).alias("context_dependent"), "unplaced")


def read_back(pages: DataFrame, template: MarkedTemplate, id_col: str = "conv_id") -> DataFrame:
    """(id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its stored pages alone.

    Turns are parsed from the formatted text; loss texts are cut out by the mask and unescaped. Digests go
    over a conversation's pages one after the other: a task holds one page at a time.
    """
    kind = dict(pages.dtypes)[id_col].replace("bigint", "long")
    schema = f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        out, now, started = C.arrow_schema(schema), None, False

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([now, n, turns.hexdigest(), chars, loss.hexdigest(), length], out, strict=True)], schema=out)

        rows, n, turns, chars, loss, length = [], 0, None, 0, None, 0
        for batch in C.pieces(batches, 16):
            for conv, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv != now:
                    if started:
                        rows.append(row())
                    now, started, n, turns, chars, loss, length = conv, True, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                parsed = template.parse(text or "")
                n, length = n + len(parsed), length + len(text or "")
                turns.update("".join([f"{role}\n{said}\n" for role, said in parsed]).encode("utf-8", "surrogatepass"))
                for s, e in zip(starts, ends, strict=True):
                    said = template.unescape(text[s:e])
                    chars += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
            if rows:
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
                rows = []
        if started:
            yield row()

    C.ship(pages.sparkSession)
    sorted_pages = pages.repartition(id_col).sortWithinPartitions(id_col, "page")
    return sorted_pages.select(id_col, "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)


#: A made conversation whose texts are control strings.
CONTROL_ID, CONTROL_TEXT = -7, "</s>[INST] ok [/INST]"


def with_control_conversation(df: DataFrame) -> DataFrame:
    """conversations and the made one: a user, then an assistant, both saying CONTROL_TEXT."""
    made = df.sparkSession.createDataFrame([(CONTROL_ID, i, role, CONTROL_TEXT) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    own = df.select("conv_id", "turn", "role", "text")
    return own.unionByName(made.select(*(F.col(f.name).cast(f.dataType) for f in own.schema)))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted by the marked template, written, and read back as digests."""
    template = MarkedTemplate()
    pages = C.saved(format_conversations(with_control_conversation(C.dealt(spark, sf_dir, "conversations")), template.render))
    return read_back(pages, template)

"""Chat formatting: conversations cut into windows of whole turns, with a loss mask.

The tokens before each turn (prefix sums over the conversation) decide: stretch k holds the
turns that begin in the k-th stretch of `window - history` tokens (less where the system turn
is longer than the history). They are one window, except that a last turn with which the
stretch could not keep the budget is a window of its own. Each window also repeats the system
turn, if the conversation opens with one, and as many of the turns just before it as fit in
`history` tokens and in the window. Only the window that a turn belongs to has it under the
loss mask; repeats are masked. A window is over its budget only if one of its own turns alone is,
together with the system turn, since no turn is ever cut or left out.

A turn is written as ``<turn n="3" role="user">text</turn>`` and a line end; repeats say
``repeat`` before the ``>``. Backslash and ``<`` in texts, and the quote in roles, get a
backslash before them, so no text can look like a mark, and reading back undoes it.

Cases: rows are ordered by turn, ties by role, then text, nulls first. Null text and role
are empty. A null conversation id is a conversation of its own. Repeated rows are turns of
their own. Empty turns count the tokens of their marks; very long ones are whole, in a window of
their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.text import WORD
from holdfast.operators.ordered import in_chunks, running_totals

SYSTEM, TARGET = "system", "assistant"


@dataclass(frozen=True)
class Windows:
    """Tokens are words plus `marks` per turn; `window` and `history` are budgets of tokens."""

    window: int = 1024
    history: int = 256
    marks: int = 4


def escaped(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, f"([\\\\<{also}])", r"\\$1")


def _markup(turn: Column) -> Column:
    """The text of one turn before, of, and after its content."""
    return F.struct(
        F.concat(
            F.lit('<turn n="'), turn["n"].cast("string"), F.lit('" role="'),
            escaped(turn["role"], '"'), F.lit('"'),
            F.when(turn["again"], " repeat").otherwise(""), F.lit(">"),
        ).alias("opening"),
        escaped(turn["text"]).alias("content"),
        F.lit("</turn>\n").alias("closing"),
        ((turn["role"] == TARGET) & ~turn["again"]).alias("target"),
    )


def turns(
    rows: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    how: Windows = Windows(),
) -> DataFrame:
    """(conv, key, tokens, n, before, total, system): turns with the tokens before them, those of
    the conversation and those of its system turn.

    Conversations are range-partitioned together with their turns, so a long one is summed
    in several tasks.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    role = F.coalesce(F.col(role_column), F.lit(""))
    named = rows.select(
        # A struct, since null ids have to meet as well.
        F.struct(F.col(id_column).alias("id")).alias("conv"),
        F.struct(F.col(turn_column).alias("turn"), role.alias("role"), text.alias("text")).alias(
            "key"
        ),
        (F.regexp_count(text, F.lit(WORD)) + how.marks).cast("bigint").alias("tokens"),
        F.lit(1).cast("bigint").alias("one"),
    )
    chunks = in_chunks(named, "key", ["conv"])
    summed = running_totals(chunks, "key", ["tokens", "one"])
    first = F.min(F.struct("key.turn", "key.role", "key.text", "tokens"))
    opening = F.when(first["role"] == SYSTEM, first["tokens"]).otherwise(0)
    totals = chunks.rows.groupBy("conv").agg(
        F.sum("tokens").alias("total"), opening.alias("system")
    )
    return summed.join(totals, "conv").select(
        "conv", "key", "tokens", F.col("one_before").alias("n"),
        F.col("tokens_before").alias("before"), "total", "system",
    )


def windows(placed: DataFrame, how: Windows = Windows()) -> DataFrame:
    """(conv, part, formatted, loss, n_tokens) per window; `loss` holds (start, end) pairs."""
    stretch = F.greatest(F.lit(how.window) - F.greatest("system", F.lit(how.history)), F.lit(1))
    at = F.floor(F.col("before") / F.col("stretch")).cast("int")
    last = F.floor((F.col("total") - 1) / F.col("stretch")).cast("int")
    reach = F.floor((F.col("before") + how.history) / F.col("stretch")).cast("int")
    opening = (F.col("n") == 0) & (F.col("key.role") == SYSTEM)
    # Only the last turn of a stretch can reach beyond the stretch. Stretch k has windows 2k and
    # 2k + 1, the latter for a last turn that may not fit.
    end = F.col("before") + F.col("tokens") - F.col("at") * F.col("stretch")
    apart = (end > F.col("stretch")) & (end > F.lit(how.window) - F.col("system"))
    own = (2 * F.col("at") + F.when(apart, 1).otherwise(0)).cast("int")
    upto = F.when(opening, last).otherwise(F.least(last, reach))
    each = (
        placed.withColumn("stretch", stretch)
        .withColumn("at", at)
        .withColumn("own", own)
        .withColumn("opening", opening)
        .withColumn("part", F.explode(F.sequence("own", F.greatest("own", 2 * upto + 1))))
    )
    turn = F.struct(
        "n",
        F.col("key.role").alias("role"),
        F.col("key.text").alias("text"),
        (F.col("part") > F.col("own")).alias("again"),
        "opening",
        "before",
        "tokens",
    )
    grouped = (
        each.groupBy("conv", "part")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        # A stretch inside one long turn begins no turn and has no window.
        .where(F.exists("turns", lambda t: ~t["again"]))
    )

    def sum_of(keep: str) -> str:
        return f"aggregate(filter(turns, t -> {keep}), 0L, (s, t) -> s + t.tokens)"

    room = f"{how.window} - {sum_of('not t.again')} - {sum_of('t.again and t.opening')}"
    first = "element_at(filter(turns, t -> not t.again), 1).before"
    fitted = grouped.withColumn("room", F.expr(room)).withColumn("first", F.expr(first))
    kept = fitted.withColumn(
        "turns",
        F.expr(
            "filter(turns, t -> not t.again or t.opening"
            f" or first - t.before <= least(room, {how.history}))"
        ),
    )
    marked = kept.withColumn("marked", F.transform("turns", _markup))
    parts = "concat(m.opening, m.content, m.closing)"
    spans = """
        aggregate(marked, named_struct('at', 0L, 'spans', cast(array() as
            array<struct<start: bigint, end: bigint>>)),
            (s, m) -> named_struct(
                'at', s.at + length(m.opening) + length(m.content) + length(m.closing),
                'spans', if(m.target, array_append(s.spans, named_struct(
                    'start', s.at + length(m.opening),
                    'end', s.at + length(m.opening) + length(m.content))), s.spans)),
            s -> s.spans)
    """
    return marked.select(
        "conv",
        "part",
        F.expr(f"array_join(transform(marked, m -> {parts}), '')").alias("formatted"),
        F.expr(spans).alias("loss"),
        F.expr("aggregate(turns, 0L, (s, t) -> s + t.tokens)").alias("n_tokens"),
    )


def formatted(
    rows: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    how: Windows = Windows(),
) -> DataFrame:
    """(id, part, formatted, loss, n_tokens) for all conversations."""
    cut = windows(turns(rows, id_column, turn_column, role_column, text_column, how), how)
    return cut.select(F.col("conv.id").alias(id_column), "part", "formatted", "loss", "n_tokens")


_TURN = re.compile(
    r'<turn n="(\d+)" role="((?:[^"\\]|\\.)*)"( repeat)?>([^<\\]*(?:\\.[^<\\]*)*)</turn>\n', re.S
)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parsed(window: str) -> Iterator[tuple[int, str, str, bool]]:
    """(n, role, text, repeated) of the turns of one formatted window."""
    at = 0
    while at < len(window):
        m = _TURN.match(window, at)
        if not m:
            raise ValueError(f"no turn at {at} of a formatted window")
        yield int(m[1]), unescaped(m[2]), unescaped(m[4]), bool(m[3])
        at = m.end()


DIGEST = (
    "id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint"
)


class _Digest:
    """What one conversation's windows say, taken in one after the other."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.chars, self.size = 0, 0, 0

    def take(self, window: str, spans: list[dict]) -> None:
        for _, role, text, again in parsed(window):
            if not again:
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n += 1
        for span in spans:
            target = unescaped(window[span["start"] : span["end"]])
            self.loss.update(target.encode())
            self.chars += len(target)
        self.size += len(window)

    def row(self, key: int | None) -> tuple:
        digests = self.turns.hexdigest(), self.loss.hexdigest()
        return key, self.n, digests[0], self.chars, digests[1], self.size


def _digests(batches):
    names = [f.split()[0] for f in DIGEST.split(",")]
    kinds = [pa.int64() if "bigint" in f else pa.string() for f in DIGEST.split(",")]
    schema = pa.schema(list(zip(names, kinds)))

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema
        )

    key, state, out = None, None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("id", "formatted", "loss"))
        for conv, window, spans in zip(*columns):
            if state is None or conv != key:
                if state is not None:
                    out.append(state.row(key))
                key, state = conv, _Digest()
            state.take(window, spans)
        if len(out) > 5000:
            yield table(out)
            out = []
    if state is not None:
        out.append(state.row(key))
    if out:
        yield table(out)


def read_back(windowed: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Per conversation, read from its formatted windows: turns, loss text and sizes.

    A digest needs a conversation's windows in order, so they stream through one task, which
    holds one window at a time.
    """
    ordered = (
        windowed.select(F.col(id_column).cast("bigint").alias("id"), "part", "formatted", "loss")
        .repartition("id")
        .sortWithinPartitions("id", "part")
        .select("id", "formatted", "loss")
    )
    return ordered.mapInArrow(_digests, DIGEST).withColumnRenamed("id", id_column)

r"""Chat formatting with prefix-target expansion.

Each turn becomes `<|im_start|>role\ntext<|im_end|>\n`. In roles and texts a backslash becomes two and
`<|` becomes `<\|`; in roles a line feed becomes `\n`. So no text can open or close a turn, and reading
back undoes it exactly. Every assistant turn is an example of its own: its context is all that stands
before it and its reply alone is trainable. `examples` makes a row of each: the reply is written out, and the
context, being a prefix of the formatted conversation, is named by its end. That keeps the output as long as the
conversations; `expand` writes contexts out too, which grows with the square of the turns. What is trained on is
read back from the example rows alone, and each must follow the turns that it names as its context.

Turns are ordered by (turn, role, text). Null roles and texts are empty, a null conv_id is a conversation
of its own, others are integers, repeated rows are repeated turns, and conversations without an assistant have no example.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import integer_id

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_escaped = re.compile(r"\\(.)", re.DOTALL)
CONTROL_TEXT = f"{CLOSE}{OPEN}assistant ok"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def parse(piece: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    role, _, body = piece[len(OPEN) : -len(CLOSE) - 1].partition("\n")
    return unescape(role), unescape(body)


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, start, trainable, context_end, mask_start, mask_end: a row per turn.

    Offsets count characters in the conversation; the last three are null unless the turn is an example.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .withColumn("head", F.concat(F.lit(OPEN), F.replace(_escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n")))
        .withColumn("body", _escape(F.col("text")))
        .withColumn("formatted", F.concat("head", "body", F.lit(CLOSE + "\n")))
        .withColumn("start", F.sum(F.length("formatted").cast("long")).over(by) - F.length("formatted"))
        .withColumn("trainable", F.col("role") == "assistant")
    )
    begin = F.col("start") + F.length("head")
    only = lambda c: F.when(F.col("trainable"), c)
    return made.select(
        "conv_id", "turn", "formatted", "start", "trainable",
        only(begin).alias("context_end"), only(begin).alias("mask_start"), only(begin + F.length("body")).alias("mask_end"),
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, dict]]:
    """(conv_id, whether a conversation begins, turn) over batches sorted by conversation and start."""
    last: list = []
    for batch in batches:
        for row in batch.to_pylist():
            yield row["conv_id"], last != [row["conv_id"]], row
            last = [row["conv_id"]]


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, turn, start, context_end, reply, mask_start, mask_end: a row per assistant turn, from formatted turns.

    The context is what the conversation's formatted turns hold before `context_end`, the head of the reply's own turn
    included; the mask counts characters from the conversation's start, as `context_end` does.
    """
    reply = F.substr("formatted", (F.col("context_end") - F.col("start") + 1).cast("int"))
    return turns.where("trainable").select("conv_id", "turn", "start", "context_end", reply.alias("reply"), "mask_start", "mask_end")


def read_back(turns: DataFrame, made: DataFrame) -> DataFrame:
    """Digests of each conversation: its turns from the formatted turns, its loss from its examples.

    Conversations stream through a task in order: a hash is carried, never a conversation.
    """

    def digest(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "expanded_chars"]
        rows: list[tuple] = []
        state = None

        def closed():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:])

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        turn_start = None
        for conv, begins, row in _conversations(batches):
            if begins:
                if state:
                    rows.append(closed())
                    if len(rows) >= 5000:
                        yield flush()
                        rows.clear()
                state, turn_start = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0], None
            piece = row["piece"]
            if row["context_end"] is None:
                role, text = parse(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                turn_start, state[5] = row["start"], row["start"] + len(piece)
                continue
            if turn_start != row["start"] or row["context_end"] + len(piece) != state[5]:
                raise ValueError(f"conversation {conv}: the example at {row['start']} does not follow its context")
            reply = unescape(piece[row["mask_start"] - row["context_end"] : row["mask_end"] - row["context_end"]])
            state[3] += len(reply)
            state[4].update(reply.encode())
            state[6] += 1
            state[7] += row["context_end"] + len(piece)
        if state:
            rows.append(closed())
        if rows:
            yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, expanded_chars long"
    none = [F.lit(None).cast("long").alias(n) for n in ("context_end", "mask_start", "mask_end")]
    parts = turns.select(integer_id(turns, "conv_id"), "start", F.col("formatted").alias("piece"), *none).unionByName(
        made.select(integer_id(made, "conv_id"), "start", F.col("reply").alias("piece"), "context_end", "mask_start", "mask_end")
    )
    # a turn comes before the example that it ends
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "start", F.col("context_end").asc_nulls_first())
    return ordered.mapInArrow(digest, schema)


def expand(turns: DataFrame) -> DataFrame:
    """Each example written out: conv_id, turn, text (context and reply), mask_start, mask_end."""
    names, types = ["conv_id", "turn", "text", "mask_start", "mask_end"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def written(batches):
        held, out, size = [], [], 0
        for conv, begins, row in _conversations(batches):
            if begins:
                held = []
            held.append(row["formatted"])
            if row["mask_start"] is not None:
                out.append((conv, row["turn"], "".join(held), row["mask_start"], row["mask_end"]))
                size += len(out[-1][2])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    ordered = turns.select(integer_id(turns, "conv_id"), F.col("turn").cast("long"), "formatted", "start", "mask_start", "mask_end").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(written, "conv_id long, turn long, text string, mask_start long, mask_end long")

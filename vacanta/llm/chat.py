"""Chat formatting from an event log.

An event is (conv_id, message, seq, role, kind, text). message orders the messages of a conversation, seq the
events. kind is
  delta       text is appended to the message,
  edit        text takes the place of all that the message held,
  regenerate  the message starts anew with text, and messages after it that had begun before are dropped.
A null kind is a delta, a null text or role is empty; a null seq comes before all others. Events of a message with
equal seq are taken in the order delta, edit, regenerate and then of text, so of two edits with one seq the greater text
stays, and an edit takes the place of a delta with its seq. A message that begins with the seq of a regeneration stays.

Each message is folded on its own, so a conversation of any length spreads over tasks; the conversation itself is
only ever streamed in order. render gives one row for each turn, with the span under the loss mask; the formatted
conversation is those segments one after another. A control string inside a text is escaped: a backslash is
doubled and `<|` becomes `<\\|`, which unescape reverses, so no text can end its turn or open another.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.llm.shared import partitions, ship

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SEGMENT = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)<\|im_end\|>\n", re.S)


def escape(x: Column, newline: bool = False) -> Column:
    x = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(x, F.lit("\n"), F.lit("\\\n")) if newline else x


def unescape(x: str) -> str:
    return re.sub(r"\\(.)", r"\1", x, flags=re.S) if "\\" in x else x


#: Characters of a delta in rows_as_events.
DELTA_CHARS = 200
#: One message of so many gets a draft that is edited, and one a draft that is regenerated.
DRAFTS = 4


def rows_as_events(turns: DataFrame) -> DataFrame:
    """A table with a row for each turn, as the log that would have led to it.

    A text comes in deltas of DELTA_CHARS characters. By a hash of its place, one message in DRAFTS first has a draft
    that an edit replaces with the first part of the text, and another one a draft that is regenerated. Rows with the
    same conversation and turn are turns of their own, ordered by role and text. A conversation's rows are sorted in one
    task, which streams them.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    text = F.coalesce("text", F.lit(""))
    parts = F.greatest(F.lit(1), F.ceil(F.length(text) / DELTA_CHARS).cast("int"))
    said = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring(text, i * DELTA_CHARS + 1, F.lit(DELTA_CHARS)))
    turn = F.pmod(F.xxhash64("conv_id", "message"), F.lit(DRAFTS))
    again = F.when(turn == 0, "edit").when(turn == 1, "regenerate")
    first = F.when(again.isNull(), F.array(F.struct(F.lit("delta").alias("kind"), F.get(said, F.lit(0)).alias("text")))).otherwise(
        F.array(F.struct(F.lit("delta").alias("kind"), F.lit("a draft ").alias("text")), F.struct(again.alias("kind"), F.get(said, F.lit(0)).alias("text")))
    )
    rest = F.transform(F.slice(said, 2, F.greatest(F.lit(1), parts)), lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("text")))
    log = turns.select("conv_id", place.alias("message"), "role", "text").select("conv_id", "message", "role", F.posexplode(F.concat(first, rest)).alias("i", "e"))
    return log.select("conv_id", "message", (F.shiftleft("message", 32) + F.col("i")).alias("seq"), "role", "e.kind", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, message, role, text."""
    kind = F.coalesce("kind", F.lit("delta"))
    log = events.select("conv_id", "message", "role", F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"), F.when(kind == "regenerate", 2).when(kind == "edit", 1).otherwise(0).alias("step"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.struct("seq", "step", "text")
    one = log.groupBy("conv_id", "message").agg(
        F.min("seq").alias("begun"),
        F.max(F.when(F.col("step") > 0, at)).alias("reset"),
        F.max(F.when(F.col("step") == 2, F.col("seq"))).alias("again"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "step", "text", "role"))).alias("role"),
        F.collect_list(at).alias("log"),
    )
    last = F.filter("log", lambda e: F.col("reset").isNull() | (e > F.col("reset")))
    text = F.concat(F.coalesce("reset.text", F.lit("")), F.array_join(F.transform(F.array_sort(last), lambda e: e["text"]), ""))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    return (
        one.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), "begun", "again")
        .withColumn("cut", F.max("again").over(earlier))
        .filter(F.col("cut").isNull() | (F.col("cut") <= F.col("begun")))
        .select("conv_id", "message", "role", "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, message, segment, loss_from, loss_to (in code points of the segment; null: no loss)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit("\n"))
    body = escape(F.col("text"))
    loss = F.col("role") == "assistant"
    return messages.select(
        "conv_id",
        "message",
        F.concat(head, body, F.lit(CLOSE + "\n")).alias("segment"),
        F.when(loss, F.length(head)).alias("loss_from"),
        F.when(loss, F.length(head) + F.length(body)).alias("loss_to"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its segments, which are streamed in order."""

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, state = None, None

        def row():
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names)

        for b in batches:
            kinds = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = []
            for conv, segment, begin, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = map(unescape, SEGMENT.fullmatch(segment).groups())
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    under = unescape(segment[begin:end])
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(segment)
            if out:
                yield table(out)
        if state is not None:
            yield table([row()])

    spark = formatted.sparkSession
    ship(spark)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    # Conversations are dealt by key, not pre-aggregated: a digest of ordered text has no partial form.
    ordered = formatted.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "message")
    return ordered.select("conv_id", "segment", "loss_from", "loss_to").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

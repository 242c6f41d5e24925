"""Chat logs to training text: events are folded into final messages, then rendered.

Events have conv_id, seq, message (its place in the conversation), kind, role and text:

- ``message`` sets a message's text, ``delta`` appends to it;
- ``edit`` and ``regenerate`` set it anew and drop every later message logged before them.

Other kinds are ignored. A message's role is the last one that its events name. Null texts and
roles count as empty; null conv_ids form one conversation. Events that share a seq are taken in the
order of kind, role and text, so repeated rows and ties give one result on every run. A delta
without a message starts one.

Messages are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a
backslash becomes two, ``<|`` becomes ``<\\|`` and, in roles, a newline becomes ``\\n``; this is
undone by reading the character after each backslash. No escaped text holds ``<|``, so no text can
end its turn or open another.

The fold keeps one message in memory at a time and the renderer one segment, so a conversation of
any length passes; its rows still go through one task, as their order needs.
"""

import hashlib
import re
import sys

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Window, functions as F

register_pickle_by_value(sys.modules[__name__])

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT_CHARS = 1 << 20
SEGMENTS = "conv_id BIGINT, part INT, formatted STRING, loss ARRAY<STRUCT<start: INT, stop: INT>>"
DIGESTS = (
    "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, "
    "formatted_chars BIGINT"
)


def events_of_turns(conversations):
    """One ``message`` event per row of a table of finished turns (conv_id, turn, role, text)."""
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    placed = turns.withColumn("seq", place.cast("bigint"))
    return placed.select("conv_id", "seq", F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events):
    """(conv_id, message, role, text) of the messages that remain. One shuffle, by conversation."""
    known = events.where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    later = Window.partitionBy("conv_id").orderBy(
        *[F.col(c).desc() for c in ("seq", "kind", "role", "text", "message")]
    )
    resets = F.col("kind").isin("edit", "regenerate")
    cut = F.min(F.when(resets, F.col("message"))).over(later.rowsBetween(Window.unboundedPreceding, -1))
    place = F.row_number().over(later)  # 1 is the last event
    standing = (
        known.select("conv_id", "seq", "message", "kind", "role", "text", cut.alias("cut"), (-place).alias("at"))
        .where(F.col("cut").isNull() | (F.col("message") <= F.col("cut")))
    )
    steps = F.sort_array(F.collect_list(F.struct("at", "kind", "role", "text")))
    folded = standing.groupBy("conv_id", "message").agg(steps.alias("steps"))
    begins = F.array_max(F.transform(F.filter("steps", lambda s: s["kind"] != "delta"), lambda s: s["at"]))
    told = F.filter("steps", lambda s: s["role"].isNotNull())
    used = F.filter("steps", lambda s: F.col("begins").isNull() | (s["at"] >= F.col("begins")))
    return folded.withColumn("begins", begins).select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(told, F.lit(-1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(used, lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("text"),
    )


def escaped(text):
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text):
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def unescaped_role(role):
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def render_messages(messages, loss_role="assistant", segment_chars=SEGMENT_CHARS):
    """(conv_id, part, formatted, loss): text with the spans, in code points, that are learned.

    A conversation up to ``segment_chars`` is one row; a longer one continues in further parts.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ])

    def render(tables):
        nothing = object()
        conv, part, pieces, size, loss = nothing, 0, [], 0, []
        rows = []

        def close():
            if pieces:
                rows.append({"conv_id": conv, "part": part, "formatted": "".join(pieces), "loss": loss})

        for table in tables:
            columns = [table.column(i).to_pylist() for i in range(3)]
            for key, role, text in zip(*columns):
                if key != conv or size >= segment_chars:
                    close()
                    part = part + 1 if key == conv else 0
                    conv, pieces, size, loss = key, [], 0, []
                shown = escaped(role).replace("\n", "\\n")
                head, body = f"{START}{shown}\n", escaped(text)
                if role == loss_role:
                    loss.append({"start": size + len(head), "stop": size + len(head) + len(body)})
                pieces.append(f"{head}{body}{END}\n")
                size += len(pieces[-1])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    # The window sorts by conversation and message, and shuffles only if the input isn't dealt so yet.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("message"))
    return messages.select("conv_id", "role", "text", place.alias("place")).mapInArrow(render, SEGMENTS)


def read_back(segments):
    """Digests of each conversation, from the formatted text and its loss spans alone.

    Parts of a conversation must lie together and in order, as :func:`render_messages` leaves them.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def digest(tables):
        pattern = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
        nothing = object()
        conv, state, rows = nothing, None, []

        def close():
            if state:
                n, turns, chars, learned, size = state
                rows.append({
                    "conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                    "loss_sha256": learned.hexdigest(), "formatted_chars": size,
                })

        for table in tables:
            columns = [table.column(i).to_pylist() for i in range(3)]
            for key, formatted, loss in zip(*columns):
                if key != conv:
                    close()
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in pattern.findall(formatted):
                    state[0] += 1
                    state[1].update(f"{unescaped_role(role)}\n{unescaped(body)}\n".encode())
                for span in loss:
                    learned = unescaped(formatted[span["start"]:span["stop"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return segments.select("conv_id", "formatted", "loss").mapInArrow(digest, DIGESTS)

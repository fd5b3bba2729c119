"""Chat formatting of typed content parts, and reading formatted conversations back.

A visitor flattens the parts of a message, text, image, audio and document, into one text with ordered
placeholders, and records each attachment's reference, place and expanded token count. The
template marks turns with control strings; control strings inside texts are escaped reversibly, so
the output can be read back exactly. The loss mask covers the assistants' texts and nothing else.

A turn is formatted where it lies; the turns of a conversation are then put in order by a sort and
folded as a stream, so a conversation of any length needs no more memory than a batch. Null
text counts as empty, a null role as an empty role, null parts as none. Turns with equal numbers are ordered by
role and then text; repeated rows are turns each. Rows with a null conversation id form one
conversation. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN = "<s>"
#: What stands before and after the text of a turn, by role; other roles are named in the text.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
ROLE, NAMED, END_ROLE = "[ROLE] ", " [TEXT] ", " [/ROLE]"
CONTROL = re.compile(r"</?s>|\[/?(?:SYS|INST|OUT|ROLE|TEXT)\]|<\|(?:image|audio|document)\|>|\\")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)

PARTS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.LongType()),
]))
ATTACHMENTS = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())]))


def escape(text: str) -> str:
    """Break each control string behind its first character; a backslash is doubled."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    # A doubled backslash stands for one; any other backslash was put in.
    return ESCAPED.sub(lambda m: m[1] if m[1] != "\\" else "\\", text)


class Flattener:
    """Visits the parts of a message in order."""

    #: Pixels per token side of an image, tokens per second of audio and per page of a document.
    patch, per_second, per_page = 28, 12.5, 768

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        """Unknown kinds of parts are kept as text."""
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(side) or 0) / self.patch) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.per_page)

    def _put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"type": kind, "ref": part.get("ref"), "place": self.size, "tokens": tokens})
        self._put(f"<|{kind}|>")


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """(formatted turn, begin and end of the loss mask in it, attachments with their places in it)."""
    visitor = Flattener()
    for part in parts:
        visitor.visit(part)
    before, after = MARKS.get(role) or (f"{ROLE}{escape(role)}{NAMED}", END_ROLE)
    low = len(before)
    high = low + visitor.size
    for item in visitor.attachments:
        item["place"] += low
    return before + "".join(visitor.pieces) + after, low, high if role == "assistant" else low, visitor.attachments


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders of attachments stay in the text."""
    for role, (before, after) in MARKS.items():
        if formatted.startswith(before) and formatted.endswith(after):
            return role, unescape(formatted[len(before) : -len(after)])
    role, _, rest = formatted[len(ROLE) :].partition(NAMED)
    return unescape(role), unescape(rest[: -len(END_ROLE)])


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None) -> DataFrame:
    """A row per turn, in order: conv_id, place (from 0), formatted, loss_start, loss_end, attachments, expanded_tokens.

    The formatted conversation is its rows' texts one after another. `parts_col` is an array of `PARTS`; a
    text column is one text part. Places count code points of the row.
    """
    text = F.col(text_col) if text_col else F.lit(None).cast("string")
    parts = F.col(parts_col) if parts_col else F.lit(None).cast(PARTS)
    narrow = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), parts.alias("parts"))
    kinds = [narrow.schema[k].dataType for k in range(2)]
    middle = T.StructType().add("conv_id", kinds[0]).add("turn", kinds[1]).add("role", "string").add("text", "string")
    spark_attachments = T.ArrayType(T.StructType().add("type", "string").add("ref", "string").add("place", "long").add("tokens", "long"))
    middle = middle.add("loss_start", "long").add("loss_end", "long").add("attachments", spark_attachments)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for role, text, parts in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                own = [{"type": "text", "text": text}] if parts is None else [p for p in parts if p]
                out.append(format_turn(role, own))
            formatted, low, high, attached = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(formatted, pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(attached, ATTACHMENTS)], names=middle.names
            )

    final = T.StructType().add("conv_id", kinds[0]).add("place", "long").add("formatted", "string").add("loss_start", "long").add("loss_end", "long")
    final = final.add("attachments", spark_attachments).add("expanded_tokens", "long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, place, begun = None, 0, False
        for batch in batches:
            places, texts, shifts = [], [], []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                place = place + 1 if begun and conv == of else 0
                of, begun = conv, True
                places.append(place)
                shifts.append(0 if place else len(BEGIN))
                texts.append(text if place else BEGIN + text)
            attached = [[{**a, "place": a["place"] + s} for a in x or []] for x, s in zip(batch.column(6).to_pylist(), shifts)]
            moved = [pa.array([x + s for x, s in zip(batch.column(k).to_pylist(), shifts)], pa.int64()) for k in (4, 5)]
            tokens = pa.array([sum(a["tokens"] for a in x) for x in attached], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), pa.array(texts, pa.string()), *moved, pa.array(attached, ATTACHMENTS), tokens], names=final.names)

    # The formatted text orders equal turns as their texts would be, or by their parts.
    ordered = narrow.mapInArrow(turns, middle).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(number, final)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from the rows of `format_conversations` in their order.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars and loss_sha256 (all
    unescaped text under the mask), formatted_chars.
    """
    schema = T.StructType([formatted.schema["conv_id"]]).add("n_turns", "long").add("turns_sha256", "string")
    schema = schema.add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, place, text, low, high in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if place == 0:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = read_turn(text if place else text[len(BEGIN) :])
                masked = unescape(text[low:high])
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode())
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(text)
            yield rows_of(done)
        yield rows_of([state] if state else [])

    def rows_of(states: list) -> pa.RecordBatch:
        columns = [[x[k].hexdigest() if k in (2, 4) else x[k] for x in states] for k in range(6)]
        kinds = [kind_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = to_arrow_type(schema[0].dataType)
    narrow = formatted.select("conv_id", "place", "formatted", "loss_start", "loss_end")
    return narrow.mapInArrow(fold, schema)

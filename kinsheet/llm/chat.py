"""Chat formatting from event logs.

A log has rows ``(conv_id, seq, kind, turn, role, text)``:

    create       a message begins (or a lost one begins anew) with this role and text
    delta        text that is streamed to the end of the message
    edit         the whole text of the message is replaced
    regenerate   the message's text is thrown away; deltas that follow make it again

Events of a conversation are sorted by ``seq`` inside each turn and folded into messages;
messages are rendered, in turn order, with a mask over what an assistant says.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. Fixed values.
OPEN, COLON, CLOSE = "### ", ":\n", "</turn>\n"
ESCAPE = "\\"
#: An escape goes before itself, before every sign of the opening mark and into the closing one,
#: so that no text shows either mark.
CONTROL = re.compile(r"\\|#|(?<=<)/(?=turn>)")
ESCAPED = re.compile(r"\\(\\|#|/)")
ASSISTANT = "assistant"
#: Characters of a stored piece after which a new one is begun; a turn is never cut.
PIECE_CHARS = 1 << 16
ROWS_A_BATCH = 512


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def role_name(role: str) -> str:
    """A role on its line: line ends and colons are escaped too."""
    return escape(role).replace("\n", "\\n").replace(":", "\\c")


def role_of(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "c": ":"}.get(m[1], m[1]), name)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template shows it, and where its text starts and ends."""
    head = f"{OPEN}{role_name(role)}{COLON}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def parse(piece: str) -> Iterator[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of the turns of a rendered piece."""
    at = 0
    while at < len(piece):
        found = TURN.match(piece, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        yield role_of(found[1]), unescape(found[2]), found.start(2), found.end(2)
        at = found.end()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_A_BATCH):
            yield from batch.slice(start, ROWS_A_BATCH).to_pylist()


def _sorted_by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    """Whole conversations in one partition each, read as a stream: nothing is gathered."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def reconstruct(events: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: the final messages of a log.

    Null texts are empty. Events of equal ``seq`` are taken by kind, role and text, so
    reruns agree; repeated rows count as often as
    they stand. Events before a ``create``, and messages
    without one, take the role of their first event that has one, or none. Rows without a
    turn are one message, before all others; rows without a conversation are one too.
    An unknown kind is an error. An empty log has no messages.
    """
    columns = ["conv_id", "turn", "seq", "kind", "role", "text"]
    rows = events.select(
        *[F.col(c).cast("long" if c in ("conv_id", "turn", "seq") else "string") for c in columns]
    )
    ordered = _sorted_by_conversation(rows, "turn", "seq", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0
        key: tuple | None = None
        role: str | None = None
        parts: list[str] = []

        def flush():
            batch = pa.RecordBatch.from_pydict(
                dict(zip(["conv_id", "turn", "role", "text"], map(list, zip(*done)))),
                schema=MESSAGES,
            )
            done.clear()
            return batch

        for row in _rows(batches):
            now = (row["conv_id"], row["turn"])
            if now != key:
                if key is not None:
                    done.append((*key, role, "".join(parts)))
                    size += sum(map(len, parts))
                    if len(done) >= ROWS_A_BATCH or size >= PIECE_CHARS:
                        yield flush()
                        size = 0
                key, role, parts = now, None, []
            kind, text = row["kind"], row["text"] or ""
            if kind == "create":
                role, parts = row["role"], [text]
            elif kind == "delta":
                parts.append(text)
            elif kind in ("edit", "regenerate"):
                parts = [text]
            else:
                raise ValueError(f"unknown kind of event {kind!r}")
            role = row["role"] if role is None else role
        if key is not None:
            done.append((*key, role, "".join(parts)))
            yield flush()

    return ordered.mapInArrow(run, "conv_id long, turn long, role string, text string")


MESSAGES = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
)


def format_chats(messages: DataFrame) -> DataFrame:
    """``(conv_id, piece, text, loss)``: rendered conversations in pieces of whole turns.

    ``loss`` lists the ``[start, end)`` character spans, in the piece, of assistant texts as
    they are written there. Null roles and texts are empty; messages of equal turn follow
    role and text. The pieces of a conversation, by number, make its formatted text.
    """
    rows = messages.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = _sorted_by_conversation(rows, "turn", "role", "text")
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("piece", pa.int64()),
            ("text", pa.string()),
            ("loss", pa.list_(pa.list_(pa.int64()))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        held: dict | None = None
        size = 0

        def close(piece):
            piece["text"] = "".join(piece["text"])
            done.append(piece)

        for row in _rows(batches):
            if held is None or held["conv_id"] != row["conv_id"] or size >= PIECE_CHARS:
                same = held is not None and held["conv_id"] == row["conv_id"]
                if held is not None:
                    close(held)
                    if len(done) >= ROWS_A_BATCH or size >= PIECE_CHARS:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done.clear()
                number = held["piece"] + 1 if same else 0
                held = {"conv_id": row["conv_id"], "piece": number, "text": [], "loss": []}
                size = 0
            shown, start, end = render(row["role"], row["text"])
            if row["role"] == ASSISTANT:
                held["loss"].append([size + start, size + end])
            held["text"].append(shown)
            size += len(shown)
        if held is not None:
            close(held)
            yield pa.RecordBatch.from_pylist(done, schema=schema)

    return ordered.mapInArrow(
        run, "conv_id long, piece long, text string, loss array<array<bigint>>"
    )


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, from its stored pieces: turns and masked text, counted and hashed.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``. Pieces
    are parsed and unescaped; hashes run over the pieces as they come, in order.
    """
    ordered = _sorted_by_conversation(pieces.select("conv_id", "piece", "text", "loss"), "piece")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close():
            conv, n, turns, chars, loss, size = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(c, pa.string() if n.endswith("sha256") else pa.int64())
                    for n, c in zip(names, zip(*done))
                ],
                names,
            )
            done.clear()
            return batch

        for row in _rows(batches):
            if state is None or state[0] != row["conv_id"]:
                if state is not None:
                    close()
                    if len(done) >= ROWS_A_BATCH:
                        yield flush()
                state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[5] += len(row["text"])
            for role, text, _, _ in parse(row["text"]):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for start, end in row["loss"]:
                said = unescape(row["text"][start:end])
                state[3] += len(said)
                state[4].update(said.encode("utf-8", "surrogatepass"))
        if state is not None:
            close()
            yield flush()

    return ordered.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )

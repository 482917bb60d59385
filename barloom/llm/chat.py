"""Chat formatting with a grammar that is checked by reading the output back.

A turn is rendered as ``### <role>:`` LF text LF ``</turn>`` LF. The control strings are ``### `` and ``</turn>``. The
parser is deterministic: a control string behind one or more backslashes is content and loses one backslash; a bare
``</turn>`` ends the turn. A text is first rendered as it is and parsed; where the parse does not give the source back,
every control string in it gets one more backslash, and the parse must then agree. Turns are framed independently, so a
conversation is the concatenation of its pieces and no step holds a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = re.compile(r"(\\*)(### |</turn>)")
HEAD, TAIL = "### ", "\n</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][1:] if m[1] else m[0], text)


def _role_out(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace(":", "\\.")


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", ".": ":"}.get(m[1], m[1]), role)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text: role, text, and where the raw text starts and ends. Raises ValueError off the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(HEAD, at) or (colon := rendered.find(":\n", at)) < 0:
            raise ValueError(f"no turn at {at}")
        body, end = colon + 2, None
        for m in CONTROL.finditer(rendered, body):
            if not m[1]:
                end = m.start()
                break
        if end is None or rendered[end - 1 : end - 1 + len(TAIL)] != TAIL or end - 1 < body:
            raise ValueError(f"no end of the turn at {at}")
        turns.append((_role_in(rendered[at + len(HEAD) : colon]), unescape(rendered[body : end - 1]), body, end - 1))
        at = end - 1 + len(TAIL)
    return turns


def _back(piece: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(piece)] == [(role, text)]
    except ValueError:
        return False


def render(role: str, text: str) -> str:
    """One turn; escapes until the parser gives the same role and text."""
    content = text
    while True:
        piece = f"{HEAD}{_role_out(role)}:\n{content}{TAIL}"
        if _back(piece, role, text):
            return piece
        if content is not text:
            raise ValueError("a turn does not survive its template")
        content = escape(text)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per row of ``turns`` (conv_id, turn, role, text): conv_id, turn, piece.

    Null role and text count as empty. Pieces of a conversation in order of turn (nulls first; ties by piece) are its
    formatted text. Repeated rows are repeated turns; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pieces = [render(r, t) for r, t in zip(b["role"].fillna(""), b["text"].fillna(""), strict=True)]
            yield pd.DataFrame({"conv_id": b["conv_id"], "turn": b["turn"], "piece": pieces})

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInPandas(run, "conv_id long, turn long, piece string")


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: counts and digests of turns and of the text under the loss mask.

    Pieces stream through the parser in order, so memory does not grow with a conversation. A null conv_id is one
    conversation of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key, state = None, None

        def close() -> None:
            if state is not None:
                out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for null, conv, piece in zip(b["conv_id"].isna(), b["conv_id"], b["piece"], strict=True):
                conv = None if null else int(conv)
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == LOSS_ROLE:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(piece)
            if out:
                yield _frame(out)
                out = []
        close()
        if out:
            yield _frame(out)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return df.astype({"conv_id": "Int64"})

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInPandas(run, schema)

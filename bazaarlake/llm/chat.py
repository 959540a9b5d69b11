"""Chat formatting on token level.

Each turn is made of segments: the start mark, role and newline, the text, the
end mark and newline. Segments are encoded separately and spliced, and marks
are reserved ids above the vocabulary, so no text can form one. In the written
form, where marks are strings, control strings inside a text are escaped
reversibly. Positions and loss masks follow by prefix sums over the turns.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, trimmed

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|n|>"
_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One more backslash between ``<`` and ``|``: no control string is left, and ``unescape`` takes it out again."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def head_of(role: str) -> str:
    """A role on one line: its newlines become a mark that no escaped text holds."""
    return escape(role).replace("\n", NEWLINE)


def role_of(head: str) -> str:
    return unescape(head.replace(NEWLINE, "\n"))


class ChatCoder:
    """Ids of segments by a byte-level tokenizer, and back; the two marks have the ids after its vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.start = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end = self.start + 1

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """(ids of a turn, where its text begins, where its text ends)."""
        head, body, tail = (e.ids for e in self.tokenizer.encode_batch([role + "\n", escape(text), "\n"], add_special_tokens=False))
        begin = 1 + len(head)
        return [self.start, *head, *body, self.end, *tail], begin, begin + len(body)

    def decode(self, ids) -> str:
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)

    def read(self, ids: np.ndarray) -> tuple[str, str, str]:
        """(role, text, written form) read back from the ids of one turn."""
        at = np.flatnonzero(ids == self.end)[-1]
        head, _, body = self.decode(ids[1:at]).partition("\n")
        written = START + head + "\n" + body + END + self.decode(ids[at + 1 :])
        return head, unescape(body), written


_coders: dict[str, ChatCoder] = {}


def chat_coder(path: str) -> ChatCoder:
    if path not in _coders:
        _coders[path] = ChatCoder(path)
    return _coders[path]


def format_chat(turns: DataFrame, tokenizer_path: str, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Token ids of each turn and its place in the conversation.

    Takes ``conv_id, turn, role, text``; returns these and ``ids`` (array of
    int), ``begin`` (position of the turn's first id in the conversation),
    ``loss_begin`` and ``loss_end`` (positions of the text that the loss covers;
    equal if none). A conversation's ids are its turns' ids, one after the
    other; they are never gathered in one row, so conversations may be of any
    length. Turns are ordered by ``turn`` (nulls first), ties by role and text.
    Null roles and texts are empty ones; newlines and control strings of a role
    are escaped reversibly too. Repeated rows are turns of their own. A null ``conv_id`` is a conversation. An empty table gives an
    empty result. Other columns are ignored.
    """
    roles = list(learn_roles)

    def encode(batches):
        coder = chat_coder(tokenizer_path)
        for batch in batches:
            ids, begins, ends = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found, begin, end = coder.turn(head_of(role), text)
                ids.append(found)
                begins.append(begin)
                ends.append(end if role in roles else begin)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["conv_id", "turn", "role", "text", "ids", "loss_begin", "loss_end"]
            )

    src = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    coded = src.mapInArrow(trimmed(encode), "conv_id long, turn long, role string, text string, ids array<int>, loss_begin long, loss_end long")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0))
    return coded.withColumn("begin", begin).withColumns({"loss_begin": F.col("loss_begin") + F.col("begin"), "loss_end": F.col("loss_end") + F.col("begin")})


def chat_digests(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of each conversation, read back from its ids and loss spans alone.

    Turns of a conversation follow each other in one partition and are digested
    as they come, so memory does not grow with a conversation.
    """

    def digest(batches):
        coder = chat_coder(tokenizer_path)
        state = None

        def row(s):
            return {"conv_id": s["conv_id"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["written"]}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            done = []
            for conv, begin, ids, lo, hi in zip(*(batch.column(k) for k in range(5))):
                conv, begin, lo, hi = conv.as_py(), begin.as_py(), lo.as_py(), hi.as_py()
                if state is None or state["conv_id"] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = {"conv_id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "written": 0}
                ids = ids.values.to_numpy()
                role, text, written = coder.read(ids)
                covered = unescape(coder.decode(ids[lo - begin : hi - begin])) if hi > lo else ""
                state["n"] += 1
                state["turns"].update(f"{role_of(role)}\n{text}\n".encode())
                state["chars"] += len(covered)
                state["loss"].update(covered.encode())
                state["written"] += len(written)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(state)], schema)

    n = partitions(formatted.sparkSession)
    ordered = formatted.select("conv_id", "begin", "ids", "loss_begin", "loss_end").repartition(n, "conv_id").sortWithinPartitions("conv_id", "begin")
    return ordered.mapInArrow(trimmed(digest), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

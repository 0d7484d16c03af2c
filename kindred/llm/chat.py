"""Chat formatting by token-level assembly.

Each turn becomes ``<|im_start|>role\\n text<|im_end|>\\n``: its segments are encoded separately by the byte-level
vocabulary, as ordinary text, and the marks are spliced in as reserved ids beyond that vocabulary. The loss mask is
the prefix sum of +1 where an assistant's text begins and -1 where it ends.

Control strings inside texts are escaped reversibly: in ``<``, any backslashes, ``|`` one backslash is added.

A turn is formatted where it lies. Only reading a conversation back needs its turns together and in order, and they
stream by, with running digests: a conversation of any length costs no memory.

Defined cases: a null text is empty, a null role is the empty role; turns of equal number come in the order of their
role and text, null numbers first; a null conv_id is a conversation of its own; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.token_counts import byte_letters

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_vocabularies: dict[str, "Vocabulary"] = {}


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Vocabulary:
    """A byte-level vocabulary and two reserved ids beyond it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.start = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end = self.start + 1
        letter = {v: k for k, v in byte_letters().items()}
        self.said = {i: bytes(letter[c] for c in token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids) -> str:
        return b"".join(map(self.said.__getitem__, ids)).decode("utf-8", "surrogatepass")


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def assemble(v: Vocabulary, role: str, head: list[int], body: list[int], tail: list[int]) -> tuple[list[int], np.ndarray]:
    """Ids of a turn, and its loss mask."""
    ids = [v.start, *head, *body, v.end, *tail]
    edge = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        edge[1 + len(head)] += 1
        edge[1 + len(head) + len(body)] -= 1
    return ids, np.cumsum(edge[:-1], dtype=np.int8)


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """``conv_id, turn, role, text`` with ``ids`` and ``mask`` of each turn."""
    schema = "conv_id long, turn long, role string, text string, ids array<int>, mask binary"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        (newline,) = v.encode(["\n"])
        for part in parts:
            roles = [x or "" for x in part.column("role").to_pylist()]
            heads = v.encode([escape_role(x) + "\n" for x in roles])
            bodies = v.encode([escape(x or "") for x in part.column("text").to_pylist()])
            made = [assemble(v, *x, newline) for x in zip(roles, heads, bodies, strict=True)]
            more = [pa.array([ids for ids, _ in made], pa.list_(pa.int32())), pa.array([mask.tobytes() for _, mask in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], ["conv_id", "turn", "role", "text", "ids", "mask"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return rows.mapInArrow(batches, schema)


class _Reading:
    """Running digests of one conversation."""

    def __init__(self) -> None:
        self.turns = self.chars = self.loss = 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, v: Vocabulary, ids: list[int], mask: bytes) -> None:
        if ids[0] != v.start:
            raise ValueError("a turn does not begin with its mark")
        end = ids.index(v.end)
        said = v.decode(ids[1:end])
        role, _, text = said.partition("\n")
        text = unescape(text)
        self.all.update(f"{unescape_role(role)}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.turns += 1
        self.chars += len(START) + len(said) + len(END) + len(v.decode(ids[end + 1 :]))
        if learned := unescape(v.decode([i for i, m in zip(ids, mask, strict=True) if m])):
            self.loss += len(learned)
            self.learned.update(learned.encode("utf-8", "surrogatepass"))

    def row(self) -> list:
        return [self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars]


def read_conversations(turns: DataFrame, path: str) -> DataFrame:
    """What the ids and masks of ``format_turns`` say, by conversation; role and text themselves only break ties of the order."""
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        done: list[list] = []
        now: tuple | None = None

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", *names])

        for part in parts:
            for conv, ids, mask in zip(*(part.column(c).to_pylist() for c in ("conv_id", "ids", "mask")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append([now[0], *now[1].row()])
                    now = (conv, _Reading())
                now[1].add(v, ids, mask)
            if len(done) > 1000:
                yield rows()
                done = []
        if now is not None:
            done.append([now[0], *now[1].row()])
        if done:
            yield rows()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(batches, schema)

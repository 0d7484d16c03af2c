"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton reads each document word by word and knows at each word the longest match that ends there. Where that
reaches a window (eight item words, or all of a shorter item), the words of the window are hit.

Each state has a place for the items whose window ends there: a state holds one string of eight words at most, and
every longer match of the same end comes to it by suffix links, so states alone tell the items.

The items are read in blocks of a bounded number of words, and each block makes one automaton, sent as arrays. The
documents pass in one step: a task gathers a bounded volume of text and takes it through one automaton after the other,
holding one at a time. There is no shuffle, no join, and nothing that grows with the documents or the number of blocks.

Defined cases: a null or empty text has no words; an item without words matches nothing; equal items each count; a
null item_id counts as the item "null"; repeated documents are treated alike; without documents there is no row, and
without items nothing is hit. ``match_items`` puts its three columns in the place of any of the same names;
``decontaminate`` gives every column of the input back, whatever its name, with only the text changed.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII letters and digits and every byte of a character outside ASCII belong to words; A-Z are lower-cased.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Item words in one automaton, for each of which it takes some 600 bytes, and bytes of text that a task gathers for several.
BLOCK_WORDS, GATHER = 100_000, 32 << 20


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the windows of the items.

    ``to`` leads from ``state * number of words + word`` to the next state. ``held`` has the numbers of the items by
    the state of their window, ``short`` by state and length those of items shorter than a window.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        read = [(name, words(text)) for name, text in items]
        self.ids: dict[bytes, int] = {}
        seqs = [(name, [self.ids.setdefault(w, len(self.ids)) for w in seq]) for name, seq in read if seq]
        self.window, self.width = window, max(1, len(self.ids))
        self.names = sorted({name for name, _ in seqs})
        self.to: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        self._out: list[list[int]] | None = [[]]
        for _, seq in seqs:
            self._add(seq)
        self._out = None
        held: dict[int, set[int]] = {}
        short: dict[tuple[int, int], set[int]] = {}
        number = {name: i for i, name in enumerate(self.names)}
        for name, seq in seqs:  # each item read once more, to its windows' states
            state = 0
            for i, c in enumerate(seq):
                state = self.to[state * self.width + c]
                while i + 1 >= window and self.length[self.link[state]] >= window:
                    state = self.link[state]
                if i + 1 >= window:
                    held.setdefault(state, set()).add(number[name])
            if len(seq) < window:
                short.setdefault((state, len(seq)), set()).add(number[name])
        self.held = {k: tuple(sorted(v)) for k, v in held.items()}
        self.short: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for (state, k), v in short.items():
            self.short.setdefault(state, []).append((k, tuple(sorted(v))))
        self._settle()

    def _settle(self) -> None:
        self.least = min([self.window, *(k for own in self.short.values() for k, _ in own)])
        self.ends: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def packed(self) -> tuple:
        """The same in arrays and few objects."""
        return (list(self.ids), self.window, self.names, np.array(list(self.to), np.int64), np.array(list(self.to.values()), np.int32), np.array(self.link, np.int32), np.array(self.length, np.int32), self.held, self.short)

    @classmethod
    def unpacked(cls, packed: tuple) -> Automaton:
        self = cls.__new__(cls)
        known, self.window, self.names, keys, to, link, length, self.held, self.short = packed
        self.ids, self.width = {w: i for i, w in enumerate(known)}, max(1, len(known))
        self.to, self.link, self.length = dict(zip(keys.tolist(), to.tolist(), strict=True)), link.tolist(), length.tolist()
        self._settle()
        return self

    def _add(self, seq: list[int]) -> None:
        to, link, length, out, width, last = self.to, self.link, self.length, self._out, self.width, 0
        for c in seq:
            if (q := to.get(last * width + c)) is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new = len(link)
            length.append(length[last] + 1)
            link.append(0)
            out.append([])
            p = last
            while p >= 0 and p * width + c not in to:
                to[p * width + c] = new
                out[p].append(c)
                p = link[p]
            if p >= 0:
                q = to[p * width + c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c: int, q: int) -> int:
        to, link, length, out, width = self.to, self.link, self.length, self._out, self.width
        new = len(link)
        length.append(length[p] + 1)
        link.append(link[q])
        out.append(list(out[q]))
        for x in out[q]:
            to[new * width + x] = to[q * width + x]
        link[q] = new
        while p >= 0 and to.get(p * width + c) == q:
            to[p * width + c] = new
            p = link[p]
        return new

    def _ending(self, state: int) -> list[tuple[int, tuple[int, ...]]]:
        """Short items that end where the state's strings do: its own and those up its suffix links."""
        if (known := self.ends.get(state)) is None:
            up, known = state, []
            while up > 0:
                known += self.short.get(up, ())
                up = self.link[up]
            self.ends[state] = known
        return known

    def read(self, doc: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """The hit spans of words, merged and in order, and the items found."""
        spans: list[list[int]] = []
        found: set[int] = set()
        get, link, length, width, least, window, held = self.to.get, self.link, self.length, self.width, self.least, self.window, self.held
        state = n = 0
        for i, c in enumerate(map(self.ids.get, doc)):
            if c is None:
                state = n = 0
                continue
            to = get(state * width + c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = get(state * width + c)
            if to is None:
                n = 0
                continue
            state = to
            n += 1
            if n < least:
                continue
            longest = 0
            if n >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found.update(held[at])
                longest = window
            if self.short:
                for k, names in self._ending(state):
                    if k <= n:
                        found.update(names)
                        longest = max(longest, k)
            if longest:
                start = i + 1 - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, {self.names[x] for x in found}


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The items, ``BLOCK_WORDS`` of them at a time; an upper bound of the words is half the characters."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").alias("text"))
    total = named.agg(F.sum(F.char_length("text") / 2 + 1)).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_WORDS))
    for k in range(n):
        part = named if n == 1 else named.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield [(r.name, r.text) for r in part.collect()]


def _scanner(docs: DataFrame, items: DataFrame, window: int):
    """A function for the tasks: batches, each with the word count, hit spans and items of its texts.

    With several blocks it gathers batches up to ``GATHER`` bytes of text (one batch at least) and loads the automata one after the other.
    """
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(pickle.dumps(Automaton(block, window).packed())) for block in _blocks(items)]

    def through(batches: list[pa.RecordBatch], load) -> Iterator[tuple[pa.RecordBatch, list]]:
        texts = [list(map(words, b.column("text").to_pylist())) for b in batches]
        out = [[(len(doc), [], set()) for doc in t] for t in texts]
        for k in range(len(blocks)):
            read = load(k).read
            for docs_, had in zip(texts, out, strict=True):
                for i, doc in enumerate(docs_):
                    spans, found = read(doc)
                    if spans:
                        n, old, names = had[i]
                        had[i] = n, _merged(old + spans) if old else spans, names | found
        return zip(batches, out, strict=True)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        only = Automaton.unpacked(pickle.loads(blocks[0].value)) if len(blocks) == 1 else None

        def load(k: int) -> Automaton:
            if only is not None:
                return only
            automaton = Automaton.unpacked(pickle.loads(blocks[k].value))
            blocks[k].__dict__.pop("_value", None)  # it is read from its file again when it is needed again
            return automaton

        waiting, size = [], 0
        for part in parts:
            waiting.append(part)
            size += part.column("text").nbytes
            if only is not None or size >= GATHER:
                yield from through(waiting, load)
                waiting, size = [], 0
        if waiting:
            yield from through(waiting, load)

    return scan


def match_items(docs: DataFrame, items: DataFrame, window: int = 8) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (pairs of word positions, end exclusive) and ``hit_items``."""
    own = ("n_words", "hit_spans", "hit_items")
    rows = docs.select(*(c for c in docs.columns if c.lower() not in own))
    scan = _scanner(docs, items, window)
    kinds = (pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()))
    schema = StructType([*rows.schema, *StructType.fromDDL("n_words long, hit_spans array<array<int>>, hit_items array<string>")])
    names = schema.names

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in scan(parts):
            new = [pa.array([f(x) for x in found], kind) for f, kind in zip((lambda x: x[0], lambda x: x[1], lambda x: sorted(x[2])), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names)

    return rows.mapInArrow(batches, schema)


def without_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """``text`` without its words at ``spans``."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, min_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` (the same columns) without the hit spans of at least ``min_span`` words; a document of whose words more than ``max_coverage`` are hit goes."""
    scan = _scanner(docs, items, window)

    def cleaned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in scan(parts):
            stays = [sum(b - a for a, b in spans) <= max_coverage * n for n, spans, _ in found]
            texts = [without_spans(t, [s for s in spans if s[1] - s[0] >= min_span]) if stay else None for t, (_, spans, _), stay in zip(part.column("text").to_pylist(), found, stays, strict=True)]
            names = part.schema.names
            whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(i) for i, c in enumerate(names)], names)
            yield whole.filter(pa.array(stays))

    return docs.mapInArrow(cleaned, docs.schema)

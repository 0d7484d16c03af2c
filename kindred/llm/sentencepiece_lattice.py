"""SentencePiece encoding and decoding over a relational lattice.

1. The texts' words (no piece reaches over the border of two words) are gathered once, over the whole corpus.
2. Each word's substrings of bounded length are exploded and joined with the piece table: the lattice's edges, which
   are grouped by word again where they lie.
3. A fold with ``aggregate`` finds the path. The model at hand is a merge model: its encoding is not the path of the
   best sum of scores, which a Viterbi fold would give (tests show texts where the two differ), but that of the
   merges, best piece first, leftmost of equals. The state is the set of cuts that are left in the word; the edges
   come in the order of their rank, and one that joins two neighbouring parts removes the cut between them.
   One pass is enough where each piece, merged alone, takes steps of rising rank: then, in any word, no merge makes a
   better one possible. That is proved piece by piece when the model is read; the few other pieces are marked, and
   a word with such an edge is merged by a heap, by the rule itself. So are words of more than ``LONGEST``
   characters and runs of spaces.
4. Documents are put together from the words in blocks. Words travel to the lattice, and paths back to the blocks, as
   sorted compressed blobs; documents travel as the places of their words, compressed, once, in the same shuffle.

The piece table is the only thing broadcast: the vocabulary's file bounds it.

Defined cases: null counts as the empty text, without pieces; characters outside the vocabulary become byte pieces;
a literal U+2581 decodes as a space, as the library has it; control pieces are never made from text; repeated
documents are encoded each; other columns are not kept.
"""

from __future__ import annotations

import heapq
import pickle
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
LONGEST = 40
#: Bytes of text in a block.
BLOCK = 10 << 20
_models: dict[str, "Pieces"] = {}


class Pieces:
    """The vocabulary: ranks of the pieces that merges can make, and ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("a  ﬁ ") != f"{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}":
            raise NotImplementedError("a model whose normaliser changes more than spaces")
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.bytes = [0] * 256
        self.raw = [b""] * n
        usable: list[tuple[float, str, int]] = []
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i] = piece.replace(SPACE, " ").encode()
                usable.append((-model.get_score(i), piece, i))
        self.fallback = any(self.bytes)
        order = {s: r for r, s in enumerate(sorted({s for s, _, _ in usable}))}
        self.rank = {piece: order[s] for s, piece, _ in usable}
        self.id = {piece: i for _, piece, i in usable}
        self.longest = max(map(len, self.id))
        # a word may begin at each space after another character, and a line feed may stand alone, if no piece says otherwise
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p, re.S) for p in self.id):
            raise NotImplementedError("a model with pieces of several words")
        self.unproved = {p for p in self.id if len(p) > 1 and not self._rises(p)}
        self.words = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall

    def _rises(self, piece: str) -> bool:
        """Whether the piece, merged alone, comes about by merges of rising rank."""
        parts, last = list(piece), -1
        while len(parts) > 1:
            found = [(self.rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.rank]
            if not found or min(found)[0] <= last:
                return False
            last, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def split(self, text: str | None) -> list[str]:
        """The text's words: each begins at a space, or is a line feed, or what follows one."""
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text:
            return self.words(SPACE + text.replace(" ", SPACE))
        return list(filter(None, (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")))

    def ids(self, parts: Iterator[str]) -> list[int]:
        out: list[int] = []
        for part in parts:
            i = self.id.get(part)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def merged(self, word: str) -> list[int]:
        """The merges of one word, by a heap over linked parts."""
        n = len(word)
        end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := self.rank.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue
            alive[j], end[i] = False, e
            if e < n:
                left[e] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return self.ids(word[i : end[i]] for i in range(n) if alive[i])


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


# words never hold a space: it is written SPACE
def _pack(x: object) -> bytes:
    return zstandard.compress(pickle.dumps(x, 5), 3)


def _open(x: bytes) -> object:
    return pickle.loads(zstandard.decompress(x))


class _Numbers(dict):
    """word -> its number, in the order of coming."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers by planes of their bytes, which compress better apart; empty planes are left out."""
    planes = x.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return len(x), b"".join(planes[i].tobytes() for i in range(4) if planes[i].any() or i == 0)


def _whole(x: tuple[int, bytes]) -> np.ndarray:
    n, raw = x
    if not n:
        return np.empty(0, np.int32)
    out = np.zeros((n, 4), np.uint8)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<i4").reshape(-1)


def _home(word: str, ranges: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % ranges


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """The task's rows in blocks of bounded size: a number, keys and texts."""
    at, keys, texts, size = TaskContext.get().partitionId() << 24, [], [], 0
    for part in (p.slice(i, 500) for p in parts for i in range(0, p.num_rows, 500)):
        for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text or "") + 16
            if size >= BLOCK:
                yield at, keys, texts
                at, keys, texts, size = at + 1, [], [], 0
    if keys:
        yield at, keys, texts


def lattice(words: DataFrame, spark: SparkSession, p: Pieces) -> DataFrame:
    """``id, cuts`` for ``(id, word)``: a bit for each place where the word is cut, -1 if the rule itself must tell.

    Words that no piece of several characters is part of have no row: they are cut everywhere.
    """
    rows = [(piece, (rank << 16) + ((1 << 40) if piece in p.unproved else 0)) for piece, rank in p.rank.items() if len(piece) > 1]
    table = F.broadcast(spark.createDataFrame(rows, "piece string, rank long"))
    # placed before the edges are made, so that grouping them moves nothing; neighbours in order together, so that they compress
    words = words.select("id", "word", F.shiftright("id", 10).alias("near")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "near")
    starts = words.withColumn("n", F.char_length("word")).where("n > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("s"))
    ends = starts.select("*", F.explode(F.sequence(F.col("s") + 2, F.least(F.col("n"), F.col("s") + p.longest))).alias("e"))
    edges = ends.select("near", "id", "n", (F.col("s") * 256 + F.col("e")).alias("at"), F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s")).alias("piece")).join(table, "piece")
    held = edges.select("near", "id", "n", (F.col("rank") + F.col("at")).alias("edge")).groupBy("near", "id", "n").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    one = F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, i.cast("int"))
    start, end = lambda x: F.shiftright(x, 8).bitwiseAND(F.lit(255)), lambda x: x.bitwiseAND(F.lit(255))
    spans = F.transform("edges", lambda x: F.struct((bit(start(x)) + bit(end(x))).alias("ends"), (bit(end(x)) - bit(start(x) + 1)).alias("inside")))

    def join_two(cuts, x):
        between = cuts.bitwiseAND(x["inside"])
        fits = (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(between) == 1)
        return F.when(fits, cuts - between).otherwise(cuts)

    path = F.aggregate(spans, bit(F.col("n") + 1) - 1, join_two)
    return held.select("id", F.when(F.exists("edges", lambda x: x >= 1 << 40), F.lit(-1).cast("long")).otherwise(path).alias("cuts"))


def _ranged(known: list[str], ranges: int) -> list[tuple[int, list[str]]]:
    """Words by range, each range's in order."""
    by: dict[int, list[str]] = {}
    for word in known:
        by.setdefault(_home(word, ranges), []).append(word)
    return [(r, sorted(by[r])) for r in sorted(by)]


def _sum(words: str) -> int:
    return zlib.crc32(words.encode("utf-8", "surrogatepass"))


def _raw(p: Pieces, ids: list[int]) -> str:
    said = b"".join(map(p.raw.__getitem__, ids))
    return said[said.startswith(b" ") :].decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, key: str = "doc_id", back: bool = False) -> DataFrame:
    """``key`` and ``ids``, the pieces of each whole text; with ``back`` also ``text``, decoded from the ids again."""
    spark = docs.sparkSession
    p = Pieces(path)  # the driver needs it for the piece table only, and lets it go again
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col("text").alias("text"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranges = max(2 * width, chars // (16 << 20))
    names = ["r", "block", "blob"]

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block the words by range, and (r = -1 - block) the documents as places of their words: those of the lattice by range, then the others."""
        p = pieces(path)
        for block, keys, texts in _blocks(parts):
            number = _Numbers()
            lists = [np.fromiter(map(number.__getitem__, p.split(text)), np.int32) for text in texts]
            at = np.concatenate(lists)
            usual = [w for w in number if len(w) <= LONGEST and w[1:2] != SPACE]
            others = sorted(set(number).difference(usual)) if len(usual) < len(number) else []
            full = [(r, words, " ".join(words)) for r, words in _ranged(usual, ranges)]
            place = {w: i for i, w in enumerate(chain(*(words for _, words, _ in full), others))}
            # frequent words get the small numbers
            order = np.argsort(-np.bincount(at, minlength=len(number)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            places = np.fromiter(map(place.__getitem__, number), np.int32, len(number))[order]
            sums = [(r, _sum(text), len(words)) for r, words, text in full]
            about = _pack((keys, [len(x) for x in lists], sums, others, _planes(places), _planes(rank[at])))
            blobs = [*(_pack(text) for _, _, text in full), about]
            made = pa.RecordBatch.from_arrays([pa.array([*(r for r, _, _ in full), -1 - block], pa.int64()), pa.array([block] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names)
            # nothing of this block is held while the next one is read
            del keys, texts, number, lists, at, usual, others, full, place, order, rank, places, sums, about, blobs
            yield made
            del made

    # words and documents lie in one shuffle; its three readers take all columns and rows, so that Spark makes it once
    sent = rows.mapInArrow(gather, "r long, block long, blob binary").repartition(width, "r")

    def union(blobs: list[bytes]) -> list[str]:
        known: set[str] = set()
        for blob in blobs:
            known.update(_open(blob).split(" "))
        return sorted(known)

    def distinct(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for part in parts:
            for r, blob in zip(part.column("r").to_pylist(), part.column("blob"), strict=True):
                if r >= 0:
                    by.setdefault(r, []).append(blob.as_py())
        for r in list(by):
            ordered = union(by.pop(r))
            for i in range(0, len(ordered), 20_000):
                some = ordered[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(some), dtype=np.int64) + (r << 32)), pa.array(some)], ["id", "word"])

    words = sent.mapInArrow(distinct, "id long, word string")
    paths = lattice(words, spark, p).select(F.shiftright("id", 32).alias("home"), F.col("id").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("i"), "cuts")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ids of the blocks' words of one range, word by word in order."""
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["back_r", "r", "told"])
        if not left.num_rows or left.column("r")[0].as_py() < 0:
            return none
        p = pieces(path)
        blobs = left.column("blob").to_pylist()
        cuts = dict(zip(right.column("i").to_pylist(), right.column("cuts").to_pylist(), strict=True))
        told: dict[str, list[int]] = {}
        for i, word in enumerate(union(blobs)):
            mask = cuts.get(i)
            if mask is None:
                told[word] = p.ids(iter(word))
            elif mask < 0:
                told[word] = p.merged(word)
            else:
                at = [k for k in range(len(word) + 1) if mask >> k & 1]
                told[word] = p.ids(word[a:b] for a, b in zip(at, at[1:], strict=False))
        out = []
        for blob in blobs:
            text = _open(blob)
            lists = list(map(told.__getitem__, text.split(" ")))
            flat = np.fromiter(chain.from_iterable(lists), np.int32)
            lengths = np.fromiter(map(len, lists), np.int32, len(lists))
            out.append(_pack((_sum(text), _planes(lengths), _planes(flat))))
        back_r = pa.array(-1 - left.column("block").to_numpy())
        return pa.table([back_r, left.column("r"), pa.array(out, pa.binary())], ["back_r", "r", "told"])

    told = sent.groupBy("r").cogroup(paths.groupBy("home")).applyInArrow(answer, "back_r long, r long, told binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        p = pieces(path)
        known = {r: _open(blob) for r, blob in zip(right.column("r").to_pylist(), right.column("told").to_pylist(), strict=True)}
        keys, sizes, values = [], [np.zeros(1, np.int64)], [np.empty(0, np.int32)]
        for blob in left.column("blob").to_pylist() if left.num_rows and left.column("r")[0].as_py() < 0 else ():
            names, counts, sums, others, places, at = _open(blob)
            own = [np.array(p.merged(w), np.int32) for w in others]
            if any(known[r][0] != check or known[r][1][0] != n for r, check, n in sums):
                raise ValueError("the documents were not the same when they were read again")
            length = np.concatenate([*(_whole(known[r][1]) for r, _, _ in sums), np.array([len(x) for x in own], np.int32)]).astype(np.int64)
            ids = np.concatenate([*(_whole(known[r][2]) for r, _, _ in sums), *own, np.empty(0, np.int32)])
            start = np.cumsum(length) - length
            at = _whole(places)[_whole(at)]
            n = length[at]
            # the ids of word after word, some at a time: each place's start, and from there on one by one
            for i in range(0, len(at), 200_000):
                m = n[i : i + 200_000]
                ends = np.cumsum(m)
                values.append(ids[np.arange(ends[-1]) + np.repeat(start[at[i : i + 200_000]] - ends + m, m)])
            keys += names
            sizes.append(np.bincount(np.repeat(np.arange(len(counts)), counts), n, len(counts)).astype(np.int64))
        offsets, flat = np.cumsum(np.concatenate(sizes)), np.concatenate(values)
        columns = [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
        if back:
            columns.append(pa.array([_raw(p, flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)], pa.string()))
        return pa.table(columns, ["key", "ids", "text"][: len(columns)])

    made = sent.groupBy("r").cogroup(told.groupBy("back_r")).applyInArrow(assemble, "key long, ids array<int>" + ", text string" * back)
    return made.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``text``, from ``ids``."""
    names = [c for c in encoded.columns if c != "text"]
    rows = encoded.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in parts:
            texts = []
            for ids in part.column("ids"):
                texts.append(_raw(p, ids.values.to_pylist() if ids.is_valid else []))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "text"])

    return rows.mapInArrow(batches, f"{kinds}, text string")

"""Token counts of whole texts without building the tokens.

The shortcut: for each string of the vocabulary it is proved once, by running the merges on it alone, whether it
encodes to a single token. A pre-token that is such a string counts 1 at once; only the rest is merged, by the
library's model, and remembered in a bounded table.

Defined cases: null counts as the empty text, 0 tokens; a special token's string inside a text is one token, as the
library has it by default; rows are independent, so ties, repeats and other columns do not matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the table of merged pre-tokens before it starts anew.
MEMORY = 400_000
_counters: dict[str, "Counter"] = {}


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself where it prints, else the next from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


def whole_tokens(tokenizer, suffix: str) -> dict[str, int]:
    """The vocabulary strings, as pre-tokens, that encode alone as exactly one token."""
    letters = byte_letters()
    letter = {v: k for k, v in letters.items()}
    found = {}
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if not token.endswith(suffix):
            continue
        try:
            text = bytes(letter[c] for c in token[: len(token) - len(suffix)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and len(tokenizer.model.tokenize("".join(map(letters.__getitem__, text.encode())))) == 1:
            found[text] = 1
    return found


class Counter(dict):
    """pre-token -> tokens; a missing one is merged by the library's model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.whole = whole_tokens(self.tokenizer, suffix)
        super().__init__(self.whole)
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(split).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        # printable ASCII, the usual white space, and Latin letters: there all Unicode tables agree and NFC changes nothing
        self.odd = regex.compile("[^\t\n\r\x20-\x7e¡-ɏ]").search

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
            self.update(self.whole)
        n = self[word] = len(self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, word.encode()))))
        return n

    def count_plain(self, text: str) -> int:
        if self.odd(text):
            text = self.tokenizer.normalizer.normalize_str(text)
            return sum(len(self.tokenizer.model.tokenize(word)) for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return sum(map(self.__getitem__, self.words(text.lower())))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text:
            return self.count_plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, filter(None, parts)))


def counter(path: str) -> Counter:
    """One for each Python worker: the proof is run once, and what was merged stays known for later tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for part in parts:
            n = [count(t) for t in part.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("__key"), part.column("__bytes"), pa.array(n, pa.int64())], ["__key", "__bytes", "__n"])

    rows = docs.select(
        F.col(key).alias("__key"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("__bytes"),
        F.col("text").alias("__text"),
    )
    return rows.mapInArrow(batches, f"__key {kind}, __bytes long, __n long").select(
        F.col("__key").alias(key), F.col("__bytes").alias("n_bytes"), F.col("__n").alias("n_tokens"), (F.col("__n") > limit).alias("over_limit")
    )

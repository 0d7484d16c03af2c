"""Line deduplication, with DataFrame functions only.

Lines are normalised, hashed and counted once for each document that holds them; a line whose count reaches the
limit goes from every document; the other lines are put together again in their order.

Defined cases: a null or empty text is one empty line, which has no key long enough to be dropped; a document of
which every line goes keeps the empty text; rows that repeat a ``doc_id`` count as one document and are each
cleaned; a null ``doc_id`` is a document of its own; an empty table gives no rows; other columns pass through, whatever
their names, but for those named as the two counts, which take their place (``counts=None`` leaves the counts out).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm._common import ASCII_SPACE, ascii_lower, free_name


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hashed(line: Column) -> Column:
    """Two independent 64-bit hashes of a line's key; null for a key that is too short to count."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``(doc, a, b)``: for each document the hashes of its lines found in ``min_docs`` documents or more."""
    kept = F.filter(_lines(F.col("text")), lambda x: F.char_length(F.btrim(x, F.lit(ASCII_SPACE))) >= min_chars)
    held = (
        docs.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(F.transform(kept, _hashed))).alias("h"))
        .select("doc", "h.a", "h.b")
        .distinct()
    )
    # the counts are summed before the shuffle, so a line that every document holds costs a row per task
    common = held.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("a", "b")
    return held.join(common, ["a", "b"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with ``text`` cleaned, and the numbers of lines (before) and of dropped lines in columns named by ``counts``."""
    doc, gone, kept, n = (free_name(x, docs) for x in ("doc", "gone", "kept", "n"))
    dropped = common_lines(docs, min_docs, min_chars).groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("a", "b")).alias(gone))
    lines = _lines(F.col("text"))
    stays = F.filter(
        lines,
        lambda x: (F.char_length(F.btrim(x, F.lit(ASCII_SPACE))) < min_chars) | ~F.array_contains(F.col(gone), _hashed(x)),
    )
    new = [] if counts is None else [F.col(n).cast("long").alias(counts[0]), (F.col(n) - F.size(kept)).cast("long").alias(counts[1])]
    others = [c for c in docs.columns if c.lower() not in {x.lower() for x in counts or ()}]
    return (
        docs.join(dropped, docs["doc_id"].eqNullSafe(dropped[doc]), "left")
        .withColumn(kept, F.when(F.col(gone).isNull(), lines).otherwise(stays))
        .withColumn(n, F.size(lines))
        .select(*(F.array_join(kept, "\n").alias("text") if c.lower() == "text" else F.col(c) for c in others), *new)
    )

"""The store of works and verdicts: upserts, withdrawals, feeds and statistics.

Tables are DataFrames; what would be a transaction is one query that gives the whole new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICT_KEY = ("a", "b")


def earlier(xid: str, xtime: str, yid: str, ytime: str) -> Column:
    """Whether x came first: by time, then by id."""
    return (F.col(xtime) < F.col(ytime)) | ((F.col(xtime) == F.col(ytime)) & (F.col(xid) < F.col(yid)))


def ordered_pairs(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs ``(x, y, ...)`` as ``(a, b, ..., same_author)``, the earlier work first; ``meta`` is (id, created, author)."""
    side = lambda n: meta.select(F.col("id").alias(n), F.col("created").alias(f"{n}_at"), F.col("author").alias(f"{n}_by"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    first = earlier("x", "x_at", "y", "y_at")
    rest = [c for c in pairs.columns if c not in ("x", "y")]
    return both.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), *rest, F.when(F.col("x_by") == F.col("y_by"), 1).otherwise(0).alias("same_author"))


def live_only(rows: DataFrame, works: DataFrame, id: str = "id", content: str = "content_hash") -> DataFrame:
    """Rows whose work is still there with the content they speak of; ``works`` is (id, content_hash, deleted)."""
    there = works.where("deleted = 0").select(F.col("id").alias("__id"), F.col("content_hash").alias("__hash"))
    return rows.join(there, (F.col(id) == F.col("__id")) & (F.col(content) == F.col("__hash")), "left_semi")


def replace_matches(stored: DataFrame, examined: DataFrame, found: DataFrame) -> DataFrame:
    """The new verdicts: those of examined pairs go, whichever way round, and what was found comes in, once for each pair.

    ``stored`` and ``found`` hold ``a, b, computed`` and more; ``examined`` is (a, b). Of several verdicts of a pair in
    ``found`` the last computed stays.
    """
    pair = lambda df: df.select(F.least("a", "b").alias("__lo"), F.greatest("a", "b").alias("__hi"))
    gone = pair(examined.select("a", "b").unionByName(found.select("a", "b"))).distinct()
    kept = stored.join(gone, (F.least("a", "b") == F.col("__lo")) & (F.greatest("a", "b") == F.col("__hi")), "left_anti")
    rest = [c for c in found.columns if c not in VERDICT_KEY]
    last = found.groupBy(*VERDICT_KEY).agg(F.max(F.struct("computed", *(c for c in rest if c != "computed"))).alias("__m"))
    return kept.unionByName(last.select(*VERDICT_KEY, *(F.col(f"__m.{c}").alias(c) for c in rest)))


def withdraw(stored: DataFrame, works: DataFrame) -> DataFrame:
    """Verdicts without those about ``works`` (id)."""
    for side in VERDICT_KEY:
        stored = stored.join(works.select(F.col("id").alias(side)).distinct(), side, "left_anti")
    return stored


def stored_matches(stored: DataFrame, work: int, min_state: int = 2, limit: int = 100) -> DataFrame:
    """The verdicts about a work, the strongest first."""
    about = stored.where(((F.col("a") == work) | (F.col("b") == work)) & (F.col("state") >= min_state) & (F.col("state") <= 4))
    return about.orderBy(F.desc("state"), F.desc("certifiable"), F.desc("structural"), "a", "b").limit(limit)


def partners(stored: DataFrame, limit: int = 256) -> DataFrame:
    """``work, partner, rank``: of each work the other sides of its verdicts, the strongest first."""
    sides = stored.select(F.explode(F.array(F.struct(F.col("a").alias("work"), F.col("b").alias("partner")), F.struct(F.col("b").alias("work"), F.col("a").alias("partner")))).alias("s"), "state", "structural")
    rank = F.row_number().over(Window.partitionBy("work").orderBy(F.desc("state"), F.desc("structural"), "partner"))
    return sides.select("s.work", "s.partner", "state", "structural").withColumn("rank", rank).where(F.col("rank") <= limit).select("work", "partner", "rank")


def alerts(stored: DataFrame, since: int, min_state: int = 3, cross_author: bool = True, limit: int = 50) -> DataFrame:
    """A feed of recent verdicts."""
    rows = stored.where((F.col("computed") >= since) & (F.col("state") >= min_state))
    rows = rows.where("same_author = 0") if cross_author else rows
    return rows.orderBy(F.desc("computed"), F.desc("state"), "a", "b").limit(limit)


def verdict_statistics(stored: DataFrame) -> DataFrame:
    return stored.groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.col("same_author") == 0).alias("cross_author"))


def latest(rows: DataFrame, by: str, version: str, tie: str) -> DataFrame:
    """The last version of each row, the greatest ``tie`` of equals: late arrivals never replace newer content."""
    rest = [c for c in rows.columns if c not in (by, version, tie)]
    return rows.groupBy(by).agg(F.max(F.struct(version, tie, *rest)).alias("__m")).select(by, *(F.col(f"__m.{c}").alias(c) for c in (version, tie, *rest)))


def upsert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the rows of ``new`` in place of its own of the same key."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stale(works: DataFrame, keys_version: int) -> DataFrame:
    """Works whose keys are of another version and can be read (-1 marks what cannot)."""
    return works.where((F.col("keys_version") != keys_version) & (F.col("keys_version") >= 0))


def frequency_change(df: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Document frequencies ``(kind, key, n)`` after postings came and went; keys that nothing holds any more go."""
    change = added.select("kind", "key", F.lit(1).alias("d")).unionByName(removed.select("kind", "key", F.lit(-1).alias("d")))
    all_ = df.select("kind", "key", F.col("n").alias("d")).unionByName(change.select("kind", "key", F.col("d").cast("long").alias("d")))
    return all_.groupBy("kind", "key").agg(F.sum("d").alias("n")).where("n > 0")


def frequencies_after(postings: DataFrame, changes: dict[str, tuple[Column, int]]) -> DataFrame:
    """``frequency_change`` where all changes are of the same postings: these are read and placed by key once.

    ``changes`` tells which postings each change is about, and what it adds to their keys' frequencies.
    """
    moved = sum((F.when(about, by).otherwise(0) for about, by in changes.values()), F.lit(0)).cast("long")
    return postings.select("kind", "key", moved.alias("d")).groupBy("kind", "key").agg(F.sum("d").alias("n")).where("n > 0")


def transitions(old: DataFrame, new: DataFrame, key: list[str], kind: str, state: str) -> DataFrame:
    """``kind, old, new, n``: how the states of the same rows moved from one calibration to the other."""
    both = old.select(*key, F.col(kind).alias("kind"), F.col(state).alias("old")).join(new.select(*key, F.col(state).alias("new")), key)
    return both.groupBy("kind", "old", "new").agg(F.count("*").alias("n"))


def arrival_pairs(works: DataFrame, keys: list[str], order: tuple[str, ...], id: str) -> DataFrame:
    """``earlier, later``: works that share the keys, each pair once, from the one that arrives later.

    A work looks for those before it and is added only then, so no pair is examined twice however the batches are cut.
    """
    x = works.select(*keys, F.col(id).alias("earlier"), F.struct(*order).alias("__x"))
    y = works.select(*keys, F.col(id).alias("later"), F.struct(*order).alias("__y"))
    return x.join(y, keys).where(F.col("__x") < F.col("__y")).select("earlier", "later")


def failure_class(rows: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """``rows`` with ``class``: the first that applies, ``ok`` if none. What is permanent is not tried again."""
    out = F
    for name, applies in classes.items():
        out = out.when(F.coalesce(applies, F.lit(False)), name)
    return rows.withColumn("class", out.otherwise("ok"))

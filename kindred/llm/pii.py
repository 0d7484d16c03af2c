"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

1. Seeds: e-mail addresses, IP addresses, card numbers and phone numbers found by their form and checked.
2. The words beside a seed make lexical patterns. Strings that look like identifiers (``candidate``) stand in the
   same places; patterns and instances form a bipartite graph, of which only counted edges are kept.
3. A few rounds score it: a pattern by the share of its instances that are believed, an instance by its best pattern.
   Instances that one pattern tells count for others, so patterns without any seed can come to be believed.
4. What stands beside a pattern that is believed, with enough different believed instances, is a span of its kind.

The form's spans always stay. Patterns and instances are counted before any shuffle, and the graph holds strings
with digits, colons or an at sign only, so it is small beside the text; no row of a hot pattern is gathered in one place.

Secrets (keys and passwords) are a fifth kind, apart from the four: their seeds are access keys of a known form and what
is assigned to a name such as password or token; the same rounds find others in the places where these stand. In prose
whose words beside identifiers hardly ever repeat, such as the synthetic tables, patterns of the four kinds are few and
find next to nothing, while assignments repeat.

Defined cases: columns other than ``doc_id`` and ``text`` do not matter and are not given back; an empty table gives no
rows; null or empty text has no spans; overlapping spans of different kinds are all kept; a found span that
overlaps one of its kind is left out; repeated documents are treated alike, and their instances count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.bits import let
from kindred.llm._common import cut_lineage

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
#: The forms. Each is written so that a match can only begin where a run of its characters begins and never needs
#: to be tried anew within the run: the same matches as without that, in time linear in the text's length.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=(?i:password|passwd|secret|token|api[_-]?key)[\x20]{0,2}[=:][\x20]{0,2}[\x22']?)(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,63}[0-9])[A-Za-z0-9+/_-]{8,64}(?![A-Za-z0-9+/_-])",
}
#: Strings that may be identifiers: of hexadecimal groups and colons; of groups of digits, some in parentheses, with spaces
#: between them, seven digits at least and no IP address among them; or from a letter, digit or plus on at least five
#: characters of an address with a digit or an at sign. Digits are never tried anew, so time is linear here too.
_NO_IP = r"(?![0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]))"
_GROUP = _NO_IP + r"(?:\([0-9]{1,6}\)|[0-9]{1,19}+)"
CANDIDATE = "|".join(
    (
        r"(?<![A-Za-z0-9])(?<![0-9A-Fa-f:]:)(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4})(?:%[A-Za-z0-9]{1,15})?(?![A-Za-z0-9:])",
        r"(?<![A-Za-z0-9+@._%-])(?=\+?\(?(?:[0-9][\x20().-]{0,3}){7})\+?" + _GROUP + r"(?:[\x20.-]{0,2}" + _GROUP + r"){1,9}(?![A-Za-z0-9@_%+:]|[.-][A-Za-z0-9])",
        r"(?<![A-Za-z0-9+@._%-])(?=[A-Za-z@._%+-]{0,252}[0-9@])[A-Za-z0-9+][A-Za-z0-9@._%+-]{3,252}[A-Za-z0-9](?![A-Za-z0-9@_%+-])",
    )
)
#: The contexts of a span, the most telling first: two words left, one word left, the word right of it. A word is what is
#: between white space, digits made equal.
LEFT, NEAR, RIGHT = r"(\S{1,32}\s{1,3}\S{0,32}\s{0,3})$", r"(\S{1,32}\s{0,3})$", r"^(\S{0,32}\s{1,3}\S{1,32})"
ROUNDS = 3
MIN_SEEDS = 5
MIN_SCORE = 0.8
#: Scores and beliefs are whole numbers of this unit, so that sums are the same in any order.
SURE = 10_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits holds."""
    n = F.length(digits)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2))
    return F.aggregate(at, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), _small)
    if kind == "card":
        return luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


#: Matches whose positions are summed one by one; of more, blocks of so many are summed first, so that long texts take no square of their matches.
BLOCK = 64


def _located(text: Column, form: str) -> Column:
    """Array of (start, end, said) of the form's matches, in code points: positions are sums of the lengths of the matches and of what is between."""
    between, found = F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    step = F.transform(F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("said")), lambda m: F.struct(F.char_length(m["gap"]).alias("gap"), F.char_length(m["said"]).alias("long"), m["said"].alias("said")))
    empty = F.array().cast("array<struct<start:int,end:int,said:string>>")

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        return F.struct((start + m["long"]).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + m["long"]).alias("end"), m["said"].alias("said"))).alias("out"))

    def placed(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(steps) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda rows: let(F.transform(rows, lambda r: F.aggregate(r, F.lit(0), lambda acc, m: acc + m["gap"] + m["long"])), lambda sums: F.flatten(F.transform(rows, lambda r, b: F.aggregate(r, F.struct(F.aggregate(F.call_function("slice", sums, F.lit(1), b), F.lit(0), lambda acc, n: acc + n).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])))))

    return let(step, placed)


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that every match passes."""
    cheap = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "secret": F.contains(text, F.lit("AKIA")) | text.rlike("[=:]")}
    return cheap.get(kind, text.rlike("[0-9]"))


def base_spans(text: Column, kind: str) -> Column:
    empty = F.array().cast("array<struct<start:int,end:int,said:string>>")
    return F.when(_possible(kind, text), F.filter(_located(text, FORMS[kind]), lambda m: _valid(kind, m["said"]))).otherwise(empty)


#: Characters of a text's pieces, and of the neighbourhood of a span, by which pieces overlap.
PIECE, REACH = 2048, 72


def _pieces(text: Column) -> Column:
    """Overlapping pieces: what is beside a span is taken from one of them, not by counting characters from the text's start."""
    last = F.greatest(F.ceil(F.char_length(text) / PIECE).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.substring(text, b * PIECE + 1, F.lit(PIECE + REACH)))


def _part(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` characters, ``REACH`` at most, from ``start`` on, counted from 0; fewer at the end."""
    at = F.floor(start / PIECE).cast("int")
    return F.coalesce(F.substring(F.get(pieces, at), start - at * PIECE + 1, length), F.lit(""))


def _contexts(pieces: Column, start: Column, end: Column) -> Column:
    """The patterns: the words beside a span, lower case, digits made equal, with the number of their kind of context; fewer at a text's ends."""
    left = _part(pieces, F.greatest(start - REACH, F.lit(0)), F.least(start, F.lit(REACH)))
    right = _part(pieces, end, F.lit(REACH))
    found = (F.regexp_extract(near, form, 1) for near, form in ((left, LEFT), (left, NEAR), (right, RIGHT)))
    named = (F.when(words != "", F.concat(F.lit(f"{i}:"), F.regexp_replace(F.lower(words), "[0-9]+", "0"))) for i, words in enumerate(found))
    return F.array_compact(F.array(*named))


def _tagged(column: str, kind: int) -> Column:
    return F.transform(column, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["said"].alias("said")))


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """For each document ``doc_id``, ``base`` and ``spans``, arrays of (kind number, start, end) in order, and ``secrets`` of the same form."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id"), text.alias("text")).select("doc_id", "text", *(base_spans(F.col("text"), k).alias(k) for k in FORMS))
    found = found.select("doc_id", "text", _pieces(F.col("text")).alias("pieces"), F.concat(*(_tagged(k, i) for i, k in enumerate(FORMS))).alias("base"))
    looks = F.when(F.col("text").rlike("[0-9@:]"), _located(F.col("text"), CANDIDATE))
    free = F.filter(looks, lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    placed = lambda spans, kind: F.transform(spans, lambda m: F.struct(kind(m).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["said"].alias("said"), _contexts(F.col("pieces"), m["start"], m["end"]).alias("patterns")))
    # what the rounds need is far smaller than the text; with the lineage cut here the text is read once
    marked = cut_lineage(
        found.select(
            "doc_id",
            placed(F.col("base"), lambda m: m["kind"]).alias("base"),
            F.filter(placed(F.coalesce(free, F.array().cast("array<struct<start:int,end:int,said:string>>")), lambda m: F.lit(-1)), lambda m: F.size(m["patterns"]) > 0).alias("free"),
        )
    )
    edges = (
        marked.select(F.explode(F.concat("base", "free")).alias("m"))
        .select(F.explode("m.patterns").alias("pattern"), "m.said", "m.kind")
        .groupBy("pattern", "said", "kind")
        .agg(F.count("*").alias("n"))
    )
    patterns = score_graph(edges, rounds, min_seeds, min_score)
    told = (
        marked.select("doc_id", F.explode("free").alias("m"))
        .select("doc_id", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
        .join(patterns, "pattern")
        .groupBy("doc_id", "start", "end")
        .agg(F.min(F.struct(F.substring("pattern", 1, 1).alias("of"), -F.col("score"), "kind")).alias("first"))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("first.kind", "start", "end")).alias("more"))
        .withColumnRenamed("doc_id", "__doc")
    )
    bare = F.transform("base", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    personal = lambda spans: F.filter(spans, lambda m: m["kind"] != SECRET)
    return (
        marked.join(told, marked["doc_id"].eqNullSafe(told["__doc"]), "left")
        .select("doc_id", F.array_sort(bare).alias("base"), F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("more"))
        .select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))
        .select("doc_id", personal("base").alias("base"), personal("spans").alias("spans"), F.filter("spans", lambda m: m["kind"] == SECRET).alias("secrets"))
    )


def score_graph(edges: DataFrame, rounds: int, min_seeds: int, min_score: float) -> DataFrame:
    """Believed patterns ``(pattern, kind, score)`` of the edges ``(pattern, said, kind, n)``; ``kind`` is -1 for what no form found.

    Each round scores the patterns that hold a believed instance, a seed or one that patterns of the round before told:
    a pattern is believed with ``min_seeds`` different believed instances of a kind that make up a share of ``min_score``
    of all its instances. So patterns are reached from seeds by shared instances, whether or not a form stands in them.
    """
    graph = cut_lineage(edges.select("pattern", "said").distinct())
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("of"))
    seeds = cut_lineage(edges.where("kind >= 0").select("said", "kind", F.lit(SURE).cast("long").alias("belief")).distinct())
    beliefs = seeds
    for last in (*[False] * (rounds - 1), True):
        met = graph.join(beliefs, "said").groupBy("pattern", "kind").agg(F.count("*").alias("believed"), F.sum("belief").alias("sum"))
        scored = met.where(F.col("believed") >= min_seeds).join(sizes, "pattern").withColumn("score", F.expr("sum div of")).where(F.col("score") >= round(min_score * SURE))
        best = scored.groupBy("pattern").agg(F.max(F.struct("score", "believed", -F.col("kind"))).alias("b"))
        patterns = best.select("pattern", (-F.col("b.col3")).alias("kind"), F.col("b.score").alias("score"))
        if not last:
            patterns = cut_lineage(patterns)
            told = graph.join(patterns, "pattern").select("said", "kind", F.col("score").alias("belief"))
            beliefs = cut_lineage(seeds.unionByName(told).groupBy("said", "kind").agg(F.max("belief").alias("belief")))
    return patterns


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    names = F.array(*map(F.lit, FORMS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

"""More queries of the catalogue: keys and signatures, votes and assignments, key points. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import ints, mixers
from kindred.operators import evidence, keypoints, signatures, store, tiles
from kindred.plans.catalogue import _CODES, _DESC, _WHOLE, _codes, _met, _parts, _stored, _STORED, _t, query

# ---- mixers and keys ----

def _unsigned(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN {x}::HUGEINT + 18446744073709551616 ELSE {x} END)::UBIGINT"


def _times(x: str, factor: int, bits: int) -> str:
    return f"(({x}::UHUGEINT * {factor}::UHUGEINT) % {1 << bits}::UHUGEINT)::UBIGINT"


def _shifted(x: str, n: int) -> str:
    return f"xor({x}, {x} >> {n})"


@query(
    f"WITH w0 AS (SELECT DISTINCT l_partkey * 1000003 - l_orderkey * 7919 AS word FROM lineitem), u AS (SELECT word, {_unsigned('word')} AS x FROM w0), "
    f"a AS (SELECT word, x, ((x::UHUGEINT + {mixers.STEP}) % 18446744073709551616::UHUGEINT)::UBIGINT AS m0, xor((x >> 32), {mixers.HIGH}::UBIGINT) AS p0, xor((x & 4294967295), {mixers.LOW}::UBIGINT) AS q0 FROM u), "
    f"b AS (SELECT *, {_times(_shifted('m0', 30), mixers.FIRST, 64)} AS m1, {_times(_shifted('p0', 16), mixers.FACTORS[0], 32)} AS p1, {_times(_shifted('q0', 15), mixers.FACTORS[1], 32)} AS q1 FROM a), "
    f"c AS (SELECT *, {_times(_shifted('m1', 27), mixers.SECOND, 64)} AS m2, xor(p1, q1) AS p2 FROM b), d AS (SELECT *, {_shifted('m2', 31)} AS m3, {_times(_shifted('p2', 13), mixers.FACTORS[2], 32)} AS p3 FROM c) "
    f"SELECT word, CASE WHEN m3 >= 9223372036854775808 THEN (m3::HUGEINT - 18446744073709551616)::BIGINT ELSE m3::BIGINT END AS mixed, {_shifted('p3', 16)}::BIGINT AS key FROM d"
)
def mixed_words(spark, sf):
    words = _t(spark, sf, "lineitem").select((F.col("l_partkey") * 1000003 - F.col("l_orderkey") * 7919).alias("word")).distinct()
    return mixers.with_mixes(words, "word")


_BYTES = "list_transform(range(0, 32), lambda i: (d[i // 8 + 1] >> (8 * (i % 8))::INT) & 255)"


@query(
    f"WITH {_CODES}, {_DESC}, c AS (SELECT DISTINCT id // 64 AS id, 0 AS kind, code & 9007199254740991 AS key FROM codes WHERE bit_count(code) BETWEEN 6 AND 58), y AS (SELECT work, {_BYTES} AS y FROM parts), "
    "v AS (SELECT work, j, y[3 * j + 1] * 65536 + y[3 * j + 2] * 256 + y[3 * j + 3] AS v FROM y, range(0, 10) t(j)), b AS (SELECT DISTINCT work AS id, 1 AS kind, j * 16777216 + v AS key FROM v WHERE v NOT IN (0, 16777215)) "
    "SELECT id, kind, CAST(key AS BIGINT) AS key FROM c UNION ALL SELECT id, kind, CAST(key AS BIGINT) FROM b"
)
def index_keys(spark, sf):
    """Keys of works of 64 codes and descriptors each."""
    codes = _codes(spark, sf).select(ints.idiv(F.col("id"), 64).alias("id"), "code")
    parts = _parts(spark, sf).select(F.col("work").alias("id"), "desc")
    return signatures.code_keys(codes).unionByName(signatures.band_keys(parts))


# ---- the screening index as tables ----
_OWN, _BANDS = (-12, 9, 31), (-8, 14, 33, 52)
_PRESENT = "CAST(" + " + ".join(f"CASE WHEN vec_id % {f + 5} = 0 THEN 0 ELSE {1 << f} END" for f in range(8)) + " AS INT)"
_SIG = f"""w AS (SELECT vec_id AS id, {_PRESENT} AS present, {_WHOLE} AS v FROM embeddings),
sig AS (SELECT id, present, list_transform(range(0, 6), lambda f: ((v[8 * f + 1] // 16) & 15) * 16 + ((v[8 * f + 2] // 16) & 15)) AS cells,
  list_transform(range(0, 8), lambda j: ((v[j + 1] // 8) & 255) * 256 + ((v[j + 9] // 8) & 255)) AS loc, list_transform(range(0, 8), lambda j: ((v[j + 33] // 8) & 255) * 256 + ((v[j + 41] // 8) & 255)) AS band FROM w)"""
_KEYS = """SELECT id, {f} * 16777216 + cells[{g}] AS k FROM sig WHERE (present >> {f}) & 1 = 1"""
_POSTINGS = "(" + " UNION ALL ".join(_KEYS.format(f=f, g=f + 1) for f in range(6)) + "".join(f" UNION ALL SELECT id, {f} * 16777216 + j * 65536 + {c}[j + 1] FROM sig, range(0, 8) t(j) WHERE (present >> {f}) & 1 = 1" for f, c in ((6, "loc"), (7, "band"))) + ")"


def _signatures(spark, sf) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), whole.alias("v"))
    at = lambda i, by, most: ints.idiv(F.element_at("v", i), by).bitwiseAND(most).cast("int")
    present = sum((F.when(F.col("id") % (f + 5) == 0, 0).otherwise(1 << f) for f in range(8)), F.lit(0))
    lanes = lambda a, b: F.array(*(at(j + a, 8, 255) * 256 + at(j + b, 8, 255) for j in range(8)))
    return v.select("id", present.alias("present"), F.array(*(at(8 * f + 1, 16, 15) * 16 + at(8 * f + 2, 16, 15) for f in range(6))).alias("cells"), lanes(1, 9).alias("local"), lanes(33, 41).alias("band"))


@query(f"WITH {_SIG} SELECT id, CAST(k AS INT) AS k FROM {_POSTINGS}")
def posting_keys(spark, sf):
    return signatures.posting_keys(_signatures(spark, sf))


def _near():
    """The cells beside a cell along its second axis, where there are any."""
    c = F.col("cell")
    return F.array_compact(F.array(F.when(c % 16 > 0, c - 1), F.when(c % 16 < 15, c + 1)))


@query(
    f"WITH {_SIG}, q AS (SELECT * FROM sig WHERE id % 50 = 0), m AS (SELECT q.id AS query, s.id AS id, q.present & s.present AS mask, "
    "list_transform(range(0, 6), lambda f: CASE WHEN q.cells[f + 1] = s.cells[f + 1] THEN 31 WHEN abs(q.cells[f + 1] - s.cells[f + 1]) = 1 AND q.cells[f + 1] // 16 = s.cells[f + 1] // 16 THEN 9 ELSE -12 END) AS w, "
    "len(list_filter(range(1, 9), lambda j: q.loc[j] = s.loc[j])) AS nl, len(list_filter(range(1, 9), lambda j: q.band[j] = s.band[j])) AS nb FROM q JOIN sig s ON q.id <> s.id), "
    "l AS (SELECT query, id, coalesce(list_sum(list_transform(list_filter(range(0, 6), lambda f: (mask >> f::INT) & 1 = 1), lambda f: w[f + 1])), 0) AS ex, coalesce(list_max(list_transform(list_filter(range(0, 6), lambda f: (mask >> f::INT) & 1 = 1), lambda f: w[f + 1])), -12) > 0 AS cell, "
    "(mask >> 6) & 1 AS hl, (mask >> 7) & 1 AS hb, nl, nb FROM m), "
    "s AS (SELECT query, id, ex + hl * CASE WHEN nl = 0 THEN -8 WHEN nl = 1 THEN 14 WHEN nl <= 3 THEN 33 ELSE 52 END + hb * CASE WHEN nb = 0 THEN -8 WHEN nb = 1 THEN 14 WHEN nb <= 3 THEN 33 ELSE 52 END AS score FROM l WHERE cell OR (hl = 1 AND nl > 0) OR (hb = 1 AND nb > 0)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s WHERE score >= -40) SELECT query, id, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 50"
)
def si_index_query(spark, sf):
    """The index's plan rows against its postings; the SQL compares every pair by the definition."""
    sig = _signatures(spark, sf)
    asked = sig.where("id % 50 = 0")
    return signatures.search(signatures.plans(asked, _near(), _OWN, _BANDS), signatures.posting_keys(sig), sig, asked, _OWN, _BANDS, threshold=-40, budget=50, size=tiles.width(sig.count()))


@query(f"WITH {_SIG}, p AS {_POSTINGS} SELECT CAST(k // 16777216 AS INT) AS fam, count(*) AS postings, count(DISTINCT k) AS keys FROM p WHERE id % 3 <> 0 OR id % 6 = 0 GROUP BY fam")
def si_index_maintenance(spark, sf):
    """All works added, a third removed, half of these added again, and the dead postings written off."""
    sig = _signatures(spark, sf)
    postings = signatures.add(None, sig, 1)
    gone = signatures.remove(None, sig.where("id % 3 = 0"), 1)
    postings = signatures.add(postings, sig.where("id % 6 = 0"), 2)
    postings, gone = signatures.compacted(postings, gone)
    return signatures.live(postings, gone).groupBy(F.shiftright("k", 24).alias("fam")).agg(F.count("*").alias("postings"), F.count_distinct("k").alias("keys"))


# ---- selection, order, lookups ----
_XY = "CAST(greatest(0, least(65535, floor(32768 + 65536 * CAST(embedding[{0}] AS DOUBLE)))) AS BIGINT)"


def _points(spark, sf) -> DataFrame:
    at = lambda i: F.greatest(F.lit(0), F.least(F.lit(65535), F.floor(F.lit(32768) + F.lit(65536) * F.element_at("embedding", i).cast("double")).cast("long")))
    return _t(spark, sf, "embeddings").select(ints.idiv(F.col("vec_id"), 64).alias("work"), (F.col("vec_id") % 64).cast("int").alias("part"), at(1).alias("x"), at(2).alias("y"))


@query(
    f"WITH p AS (SELECT vec_id // 64 AS work, CAST(vec_id % 64 AS INT) AS part, {_XY.format(1)} AS x, {_XY.format(2)} AS y FROM embeddings), c AS (SELECT *, (y * 8 >> 16) * 8 + (x * 8 >> 16) AS cell FROM p), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY work, cell ORDER BY part) AS round FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY round, cell) AS place FROM r) SELECT work, part, x, y, CAST(place AS INT) AS place FROM o WHERE place <= 24"
)
def grid_selection(spark, sf):
    return signatures.select_grid(_points(spark, sf), "work", "x", "y", ["part"], 24)


@query(
    "WITH h AS (SELECT page_id, sha256(html) AS sha FROM pages), p AS (SELECT x.page_id AS a, y.page_id AS b, unhex(x.sha) AS ha, unhex(y.sha) AS hb FROM h x JOIN h y ON y.page_id = x.page_id + 1) "
    "SELECT a, b, hb < ha AS swapped, hex(CASE WHEN hb < ha THEN hb ELSE ha END) AS first, hex(CASE WHEN hb < ha THEN ha ELSE hb END) AS second FROM p"
)
def byte_order(spark, sf):
    """Pairs of pages one after the other, in the order of their digests' bytes."""
    h = _t(spark, sf, "pages").select("page_id", F.unhex(F.sha2("html", 256)).alias("sha"))
    pairs = h.select(F.col("page_id").alias("a"), F.col("sha").alias("ha"), (F.col("page_id") + 1).alias("b")).join(h.select(F.col("page_id").alias("b"), F.col("sha").alias("hb")), "b")
    return signatures.in_byte_order(pairs, "ha", "hb").select("a", "b", "swapped", F.hex("first").alias("first"), F.hex("second").alias("second"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT unnest(from_json('[1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 99999999]', '[\"BIGINT\"]')))")
def load_by_ids(spark, sf):
    works = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return signatures.by_ids(works, F.lit("[1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 99999999]"), "doc_id")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY status")
def job_counts(spark, sf):
    return _t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey, 256 * greatest(p_size, p_partkey % 97 + 1) // least(p_size, p_partkey % 97 + 1) AS elongation, CAST(least(65535, 65535 * 15 * 100 // (greatest(p_size, 1) * 100)) AS BIGINT) AS footprint, "
    "[CAST((p_size >> f::INT) & 1 AS INT) for f in range(0, 6)] AS families FROM part"
)
def record_measures(spark, sf):
    w, h = F.col("p_size"), F.col("p_partkey") % 97 + 1
    families = F.array(*(signatures.bit(F.col("p_size"), f).cast("int") for f in range(6)))
    return _t(spark, sf, "part").select("p_partkey", signatures.elongation(w, h).alias("elongation"), signatures.footprint(F.col("p_size"), 100).alias("footprint"), families.alias("families"))


@query(f"WITH {_STORED.format(where='')}, c AS (SELECT a, b, CASE WHEN state >= 3 THEN 'codes,bands' WHEN state = 2 THEN 'bands' ELSE 'phash' END AS via FROM stored) SELECT v.via AS via, count(*) AS pairs FROM c, LATERAL (SELECT unnest(string_split(c.via, ',')) AS via) v GROUP BY v.via")
def via_counts(spark, sf):
    """Pairs by each of the channels that found them, which a verdict keeps as one text."""
    via = F.when(F.col("state") >= 3, "codes,bands").when(F.col("state") == 2, "bands").otherwise("phash")
    return _stored(spark, sf).select(F.explode(F.split(via, ",")).alias("via")).groupBy("via").agg(F.count("*").alias("pairs"))


@query(
    "WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS arrival FROM events) "
    "SELECT x.event_id AS earlier, y.event_id AS later FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_type = y.event_type AND x.arrival < y.arrival"
)
def arrival_pairs(spark, sf):
    """Each pair of works that share a key, once, when the later one arrives."""
    return store.arrival_pairs(_t(spark, sf, "events"), ["user_id", "event_type"], ("ts", "event_id"), "event_id")


@query(
    "SELECT CASE WHEN html IS NULL THEN 'permanent:empty' WHEN length(html) > 1500 THEN 'permanent:limit' WHEN page_id % 11 = 0 THEN 'retry' ELSE 'ok' END AS class, count(*) AS n FROM pages GROUP BY class"
)
def failure_classes(spark, sf):
    rows = _t(spark, sf, "pages").select(F.col("html").isNull().alias("empty"), (F.length("html") > 1500).alias("large"), (F.col("page_id") % 11 == 0).alias("busy"))
    return store.failure_class(rows, {"permanent:empty": F.col("empty"), "permanent:limit": F.col("large"), "retry": F.col("busy")}).groupBy("class").agg(F.count("*").alias("n"))


# ---- votes, fits, local codes ----
_STEPS = "[" + ", ".join(map(str, evidence.STEPS.tolist())) + "]"
_TURN = "list_transform(range(0, 64), lambda i: CAST(round(1024 * {0}(2 * pi() * i / 64)) AS BIGINT))"
_CORR = """c0 AS (SELECT l_suppkey AS s, l_orderkey * 8 + l_linenumber AS i, l_partkey * 8 + l_linenumber AS j, (l_partkey * 7919) % 65536 AS ax, (l_orderkey * 104729) % 65536 AS ay, CAST(l_linenumber % 3 AS INT) AS a_sector, 512 AS a_side,
  ((l_partkey * 7919) % 65536) * 3 // 4 + 4000 AS bx, ((l_orderkey * 104729) % 65536) * 3 // 4 + 3000 AS by_, CAST(l_linenumber % 3 AS INT) AS b_sector, CAST(CASE WHEN l_orderkey % 5 = 0 THEN 512 ELSE 683 END AS INT) AS b_side, CAST(1 + l_quantity AS BIGINT) AS weight, CAST(1 + l_linenumber AS BIGINT) AS conf FROM lineitem)"""


def _bins(v: str) -> str:
    own = f"CAST(greatest(0, least(63, {v} // 4096)) AS INT)"
    return f"CASE WHEN ({v} - {own} * 4096) * 2 >= 4096 THEN CASE WHEN {own} < 63 THEN [{own}, {own} + 1] ELSE [{own}] END ELSE CASE WHEN {own} > 0 THEN [{own}, {own} - 1] ELSE [{own}] END END"


def _sh(v: str) -> str:
    return f"(CASE WHEN {v} >= 0 THEN ({v} + 512) >> 10 ELSE -((512 - ({v})) >> 10) END)"


_CELLS = f"""{_CORR}, c1 AS (SELECT *, a_side * 65536 // b_side AS q, ((b_sector - a_sector) & 63) AS t, {_TURN.format('cos')} AS co, {_TURN.format('sin')} AS si FROM c0),
c2 AS (SELECT *, list_position(list_transform({_STEPS}, lambda x: abs(q - x)), list_min(list_transform({_STEPS}, lambda x: abs(q - x)))) - 1 AS sc, ax * co[t + 1] - ay * si[t + 1] AS ux, ax * si[t + 1] + ay * co[t + 1] AS uy FROM c1),
c3 AS (SELECT *, bx - ((q * {_sh('ux')}) >> 16) + 131072 AS px, by_ - ((q * {_sh('uy')}) >> 16) + 131072 AS py FROM c2),
c4 AS (SELECT s, i, j, weight, conf, unnest(list_filter([{{'at': sc, 'share': 64}}, {{'at': sc - 1, 'share': 24}}, {{'at': sc + 1, 'share': 24}}], lambda x: x.at BETWEEN 0 AND 24)) AS z, [t >> 2, CASE WHEN t & 3 >= 2 THEN ((t >> 2) + 1) & 15 ELSE ((t >> 2) + 15) & 15 END] AS rs, {_bins('px')} AS xs, {_bins('py')} AS ys FROM c3),
c5 AS (SELECT s, i, j, weight, conf, z, r, xs, ys FROM c4, LATERAL (SELECT unnest(rs) AS r)), c6 AS (SELECT s, i, j, weight, conf, z, r, x, ys FROM c5, LATERAL (SELECT unnest(xs) AS x)),
votes AS (SELECT s, i, j, weight, conf, CAST(((z.at * 16 + r) * 64 + x) * 64 + y AS INT) AS cell, z.share AS share FROM c6, LATERAL (SELECT unnest(ys) AS y)),
h AS (SELECT s, cell, CAST(sum(weight * share // 64) AS BIGINT) AS mass, count(*) AS members, CAST(sum(conf) AS BIGINT) AS confidence FROM votes GROUP BY s, cell), p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY mass DESC, members DESC, confidence DESC, cell) AS r FROM h)"""


def _correspondences(spark, sf) -> DataFrame:
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    ax, ay = p * 7919 % 65536, o * 104729 % 65536
    return _t(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("s"), (o * 8 + n).alias("i"), (p * 8 + n).alias("j"), ax.alias("ax"), ay.alias("ay"), (n % 3).alias("a_sector"), F.lit(512).alias("a_side"),
        (ints.idiv(ax * 3, 4) + 4000).alias("bx"), (ints.idiv(ay * 3, 4) + 3000).alias("by"), (n % 3).alias("b_sector"), F.when(o % 5 == 0, 512).otherwise(683).alias("b_side"),
        (F.col("l_quantity").cast("long") + 1).alias("weight"), (n + 1).cast("long").alias("conf"),
    )


@query(f"WITH {_CELLS} SELECT s, cell, mass, members, confidence FROM p WHERE r = 1")
def vote_peaks(spark, sf):
    """The transformation that most of a supplier's correspondences vote for."""
    return evidence.peaks_of_pairs(_correspondences(spark, sf), "s")


@query()
def verified_transforms(spark, sf):
    """The peaks' transformations, fitted and checked."""
    rows = _correspondences(spark, sf)
    return evidence.verified_pairs(rows, evidence.peaks_of_pairs(rows, "s"), "s")


_PAIRED = f"{_CODES}, o AS (SELECT id // 64 AS work, code, (code >> 48) & 65535 AS k FROM codes), pairs AS (SELECT DISTINCT x.work AS a, y.work AS b FROM o x JOIN o y ON x.k = y.k AND x.work < y.work)"


@query(
    f"WITH {_PAIRED}, u AS (SELECT work, {_unsigned('code')} AS c FROM o), t AS (SELECT work, 0 AS transform, c FROM u UNION ALL "
    + " UNION ALL ".join(f"SELECT work, {i}, (((c::UHUGEINT << {16 * i}) % 18446744073709551616::UHUGEINT)::UBIGINT | (c >> {64 - 16 * i})) FROM u" for i in (1, 2, 3))
    + " UNION ALL SELECT work, 4, list_reduce(list_concat([0::UBIGINT], list_transform(range(0, 64), lambda i: ((c >> i::UBIGINT) & 1) << (63 - i)::UBIGINT)), lambda x, y: x | y) FROM u) "
    "SELECT a, b, transform, count(*) FILTER (WHERE bit_count(xor(x.c, y.c)) <= 24) AS near, CAST(min(bit_count(xor(x.c, y.c))) AS INT) AS least FROM pairs JOIN u x ON x.work = a JOIN t y ON y.work = b GROUP BY a, b, transform"
)
def bag_distances(spark, sf):
    codes = _codes(spark, sf).select(ints.idiv(F.col("id"), 64).alias("work"), "code")
    return evidence.bag_distances(_met(spark, sf), codes, near=24)


@query()
def local_evidence(spark, sf):
    """The local channel of the paired works, by assignment under four controls, and whether its matches keep their arrangement."""
    points = _points(spark, sf).join(_codes(spark, sf).select(ints.idiv(F.col("id"), 64).alias("work"), (F.col("id") % 64).cast("int").alias("part"), "code"), ["work", "part"])
    rows = F.array_sort(F.collect_list(F.struct("part", "code", "x", "y")))
    bags = points.groupBy("work").agg(rows.alias("r")).select("work", F.col("r.code").alias("codes"), F.col("r.x").alias("x"), F.col("r.y").alias("y"))
    return evidence.local_evidence(_met(spark, sf), bags, tiles.width(points.count()))


@query()
def image_keypoints(spark, sf):
    """Key points of made-up pictures."""
    from kindred.operators import images

    found = keypoints.image_keypoints(images.synthetic_images(spark, 200))
    return found.select("work_id", "reason", "max_dim", F.size("points").alias("n"), F.size("sketch").alias("in_sketch"), F.array_max(F.col("points.strength")).alias("strongest"))


# ---- pictures compared ----
@query()
def picture_records(spark, sf):
    """Records of made-up pictures, as sizes and digests."""
    from kindred.operators import comparison, images

    r = comparison.picture_records(images.synthetic_images(spark, 200))
    return r.select("work_id", "reason", "identity", "width", "height", F.size("codes").alias("n_codes"), F.size("edges").alias("n_edges"), F.size("kp").alias("n_points"), F.xxhash64("dct").alias("dct_hash"))


@query()
def compare_pictures(spark, sf):
    """Made-up pictures nominated by shared local codes, compared and judged; and each with its damaged version."""
    from kindred.operators import comparison, images

    r = comparison.picture_records(images.synthetic_images(spark, 120))
    damaged = r.where("reason IS NOT NULL").select((F.col("work_id") - 3).alias("a"), F.col("work_id").alias("b"))
    pairs = comparison.nominated(r).select("a", "b").unionByName(damaged)
    judged = comparison.compare(pairs, r)
    return judged.select("a", "b", "state", "class", F.array_join("basis", ",").alias("basis"), "structural", "certifiable", "inliers", "models", "topology", "mirrored")


@query()
def picture_copies(spark, sf):
    """From pixels to the copies of each picture."""
    from kindred.operators import comparison, images

    found = comparison.copies(comparison.picture_records(images.synthetic_images(spark, 120)))
    return found.select("a", "b", "state", "structural", "inliers", "mirrored")


@query(
    "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), r AS (SELECT n, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS m FROM c) "
    "SELECT CAST(p AS INT) AS percent, min(n) AS value FROM r, (VALUES (50), (90), (95), (99)) t(p) WHERE k * 100 >= m * p GROUP BY p"
)
def pool_percentiles(spark, sf):
    """Sizes of users' pools of events, by place in order."""
    from kindred.operators import nomination

    return nomination.percentiles(_t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n")


@query()
def principal_axes(spark, sf):
    """The first axes of the embeddings, from sums of products."""
    from kindred.operators import screening

    _, axes, shares = screening.principal_axes(_t(spark, sf, "embeddings"), "embedding", 64)
    return spark.createDataFrame([(k, share, axis) for k, (axis, share) in enumerate(zip(axes, shares, strict=True))], "axis int, share double, weights array<double>")


@query()
def keypoint_containers(spark, sf):
    """Key points of made-up pictures written to containers and read again."""
    from kindred.operators import images
    from kindred.sources import containers

    found = keypoints.image_keypoints(images.synthetic_images(spark, 80))
    back = containers.read_containers(containers.write_containers(found))
    return back.select("work_id", "reason", "longest", F.size("points").alias("n"), F.xxhash64("points").alias("points_hash"))


@query()
def picture_families(spark, sf):
    """Family vectors, regions and route words of made-up pictures."""
    from kindred.operators import comparison, images

    r = comparison.picture_records(images.synthetic_images(spark, 80)).where("reason IS NULL")
    return r.select("work_id", "families", "words", "shapes", "silhouette")

"""Defined cases of every operator and stage: empty tables, clashing columns, long texts; and registered queries against brute force."""

from __future__ import annotations

import hashlib
import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import _common, chat, decontaminate, kdtree, linedup, ngram_join, pii, quality, queries, sentencepiece_lattice, token_counts, warc

CLASH = ["n_words", "hit_spans", "hit_items", "__gone", "__doc", "__kept", "__n", "__place", "n_lines", "n_dropped", "score", "held_out", "predicted", "uid", "sid", "comp", "key", "doc", "a", "b", "base", "spans", "kind", "ids", "N_Tokens", "n_chars"]
LONG = "\n".join(f"line {i % 700} of a very long text, word{i}" for i in range(12_000))
TEXTS = ["one short text of some seven words", "one short text of some seven words", LONG, "", None, "mail me@site.org or 10.0.0.1\nand a line"] + [f"the same line\nand number {i}" for i in range(12)]


@pytest.fixture(scope="module")
def clash(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")], "doc_id long, text string")
    return docs.select("doc_id", "text", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one short text of some seven words"), (2, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")


def told(row):
    return f"{row.doc_id}" if row.doc_id is not None else "null"


def own_columns(rows, names):
    return all(r[c] == f"{c}:{told(r)}" for r in rows for c in names)


PIECES, WORDS, BYTES = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"


def operators(spark, items, labels):
    """Each operator on documents, by number."""
    path = queries.tokenizer_path
    return {
        1: lambda d: sentencepiece_lattice.encode(d, path(PIECES)),
        2: lambda d: token_counts.count_tokens(d, path(WORDS)),
        3: lambda d: ngram_join.jaccard_components(d),
        5: lambda d: decontaminate.match_items(d, items),
        7: lambda d: pii.find_personal_data(d),
        8: lambda d: quality.score_quality(d, labels),
        10: lambda d: linedup.dedup_lines(d),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 10])
def test_operators_on_clashing_columns_and_empty_tables(spark, clash, items, labels, n):
    run = operators(spark, items, labels)[n]
    plain = clash.select("doc_id", "text")
    got, want = run(clash), run(plain)
    same = [c for c in want.columns if c not in ("uid", "comp")]
    assert sorted(map(repr, got.select(*same).collect())) == sorted(map(repr, want.select(*same).collect()))
    assert got.count() == clash.count()
    if n in (5, 8, 10):
        assert own_columns(got.collect(), [c for c in CLASH if c.lower() not in want.columns])
    empty = run(clash.limit(0))
    assert empty.collect() == [] and empty.columns == got.columns


def test_other_operators_on_empty_tables(spark):
    path = queries.tokenizer_path(BYTES)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, rank int, score int")
    assert kdtree.top_k(vectors, F.col("vec_id") % 50 == 0).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.archive_pages(pages)).collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(chat.format_turns(turns, path), path).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.n_words, r.hit_items) for r in decontaminate.match_items(docs, none).collect()] == [(3, [])]


def test_clashing_columns_of_vectors(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    more = df.select("*", *(F.lit("x").alias(c) for c in ("dim", "shard", "block", "query_id", "score", "rank", "v", "asks", "floor")))
    asks = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, kdtree.top_k(more, asks).collect())) == sorted(map(tuple, kdtree.top_k(df, asks).collect()))


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_clashing_columns_and_empty_tables(spark, sf, clash, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    name, run = pipeline.STAGES[stage]
    before = {told(r): r for r in clash.collect()}
    after = run(spark, clash, sf)
    rows = after.collect()
    if stage < 4:
        assert after.columns == clash.columns, name
        assert own_columns(rows, [c for c in CLASH if c != "n_chars"])
    ids = sorted(told(r) for r in rows)
    kept = {told(r) for r in rows}
    if name == "ngram_jaccard_join":
        assert ids == sorted(set(before) - {"1"})
    elif name == "line_dedup":
        assert ids == sorted(before)
        assert {told(r): r.text for r in rows}["8"] == "and number 2" and {told(r): r.text for r in rows}["4"] == ""
        assert {told(r): r.n_chars for r in rows}["8"] == 12
    elif name == "benchmark_decontamination":
        assert ids == sorted(before)
    elif name == "sentencepiece_encoding":
        assert len(rows) == len(before)
    else:
        assert kept <= set(before)
    assert run(spark, clash.limit(0), sf).collect() == [], name


def test_one_of_each_of_any_frame(spark):
    """Rows that are made anew at each reading, and rows alike."""
    docs = spark.range(40).select((F.col("id") % 10).alias("doc_id"), F.concat(F.lit("a text of the number "), (F.col("id") % 5).cast("string")).alias("text")).repartition(7)
    got = ngram_join.one_of_each(docs.orderBy(F.rand())).collect()
    assert sorted((r.doc_id, r.text[-1]) for r in got) == [(i, str(i)) for i in range(5)]


def test_chains_and_stars_are_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "EDGES", 40)
    pick = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(3000 + i, 2000) for i in range(200)]
    edges += [(pick.randrange(5000, 5400), pick.randrange(5000, 5400)) for _ in range(150)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    df = spark.createDataFrame(edges, "u long, v long").repartition(9)
    got: dict = {}
    for r in ngram_join.components(df).collect():
        got.setdefault(r.comp, set()).add(r.node)
    want: dict = {}
    for x in parent:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert ngram_join.components(df.limit(0)).collect() == []


def test_twenty_blocks_in_one_step(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    monkeypatch.setattr(decontaminate, "GATHER", 500)
    pick = random.Random(2)
    text = lambda n: " ".join(f"v{pick.randrange(40)}" for _ in range(n))
    texts = {i: text(pick.choice((3, 8, 12))) for i in range(60)}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    assert len(list(decontaminate._blocks(items))) >= 20
    docs = spark.createDataFrame([(i, f"{text(9)} {texts[i]} {text(5)} {texts[(7 * i) % 60]}") for i in range(60)], "doc_id long, text string").repartition(3)
    got = decontaminate.match_items(docs, items)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10**6)
    whole = decontaminate.match_items(docs, items)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    assert all({str(r.doc_id), str(7 * r.doc_id % 60)} <= set(r.hit_items) for r in got.collect())


def test_secrets_and_where_they_stand(spark):
    rows = [(i, f"words{i} password={i:02d}f9a8b7c6d5e4 and more") for i in range(20)]
    rows += [(30 + i, f"the vault code: AKIA{i:02d}ABCDEFGHIJKLMN and") for i in range(20)]
    rows += [(100, "other password=letmein99 etc"), (101, "the word 99aletmein99 alone"), (102, 'see token = "abcd" ok'), (103, "see the vault code: tango-77-lima ok"), (104, "password=short1 a 10.0.0.1")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    said = {i: [dict(rows)[i][s.start : s.end] for s in got[i].secrets] for i in (0, 100, 101, 102, 103, 104)}
    assert said == {0: ["00f9a8b7c6d5e4"], 100: ["letmein99"], 101: [], 102: [], 103: ["tango-77-lima"], 104: ["short1"]}
    assert [tuple(s) for s in got[104].spans] == [(1, 18, 26)] == [tuple(s) for s in got[104].base]


def test_registered_counts_and_codes(spark, sf):
    """The columns of op1 and op2 against the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(PIECES))
    ids = {k: library.encode(t) for k, t in texts.items()}
    hashes = {r.doc_id: r.h for r in spark.createDataFrame(list(ids.items()), "doc_id long, ids array<int>").select("doc_id", F.xxhash64("ids").alias("h")).collect()}
    for r in queries.op1_sentencepiece(spark, sf).collect():
        back = library.decode(ids[r.doc_id])
        assert (r.n_tokens, r.ids_hash, r.n_chars_decoded, r.decoded_sha256) == (len(ids[r.doc_id]), hashes[r.doc_id], len(back), hashlib.sha256(back.encode()).hexdigest())
    words = Tokenizer.from_file(queries.tokenizer_path(WORDS))
    for r in queries.op2_token_counts(spark, sf).collect():
        n = len(words.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_scores_are_those_of_a_plain_fit(spark, sf):
    """Plain gradient steps on the same pairs come to the same scores."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = sorted(((str(r.doc_id), r.doc_id, r.quality) for r in labels.where(~quality.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")).collect()))
    x = np.array([quality.features(texts[i]) for _, i, _ in known])
    y = np.array([q for _, _, q in known])
    b = np.concatenate([x, x[:, :-1] ** 2], 1)
    mean, scale = b.mean(0), b.std(0)
    scale[scale < 1e-9] = np.inf
    z = (b - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pick = np.random.default_rng(7)
    n = min(quality.PAIRS, len(good) * len(bad))
    first, second = pick.choice(good, n), pick.choice(bad, n)
    d, w = z[first] - z[second], np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, -(d @ w)).mean() + quality.RIDGE / 2 * (w @ w)
    rate = 1.0
    for _ in range(6000):
        slope = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + quality.RIDGE * w
        while rate > 1e-12 and loss(w - rate * slope) > loss(w) - rate / 2 * (slope @ slope):
            rate /= 2
        w = w - rate * slope
        rate *= 1.5
        if np.abs(slope).max() < 1e-7:
            break
    model = quality.fit(docs, labels)
    assert loss(model.weights) <= loss(w) + 1e-6
    got = {r.doc_id: r.score for r in queries.op8_quality(spark, sf).collect()}
    s = np.sort(z @ model.weights)
    at = min(max(len(bad), 1), len(s) - 1)
    threshold = (s[at - 1] + s[at]) / 2
    for i, text in texts.items():
        v = np.array([quality.features(text)])
        raw = (((np.concatenate([v, v[:, :-1] ** 2], 1) - mean) / scale) @ model.weights - threshold).item()
        assert got[i] == pytest.approx(1 / (1 + 0.7 / 0.3 * np.exp(np.clip(-raw, -500, 500))), abs=1e-6)


def test_all_rows_and_all_pairs_teach(spark):
    """More rows and pairs than any sample: the slope over all pairs is nothing, and the threshold parts all rows."""
    dice = random.Random(3)
    texts = [" ".join(dice.choice(["Word", "word", "a1", "9", "of", "THE", "end.", "x|", "!"]) for _ in range(dice.randint(1, 30))) for _ in range(30_000)]
    rows = [(i, t, int(dice.random() < 0.5 + 0.4 * (t.count("word") > t.count("9")))) for i, t in enumerate(texts)]
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = both.select("doc_id", "text"), both.select("doc_id", "quality")
    model = quality.fit(docs, labels)
    taught = both.where(~quality.held_out(F.col("doc_id"))).collect()
    x, y = np.array([quality.features(r.text) for r in taught]), np.array([r.quality for r in taught])
    assert len(y) > 20_000 and (y == 1).sum() * (y == 0).sum() > quality.PAIRS
    z = (np.concatenate([x, x[:, :-1] ** 2], 1) - model.mean) / model.scale
    s = z @ model.weights
    (good, bad), (of_good, of_bad) = (z[y == 1], z[y == 0]), (s[y == 1], s[y == 0])
    slope = np.zeros(len(model.weights))
    for i in range(0, len(good), 500):
        wrong = 1 / (1 + np.exp(of_good[i : i + 500, None] - of_bad[None, :]))
        slope += wrong.sum(1) @ good[i : i + 500] - wrong.sum(0) @ bad
    assert np.abs(slope / len(good) / len(bad) - quality.RIDGE * model.weights).max() < 1e-7
    ranked = np.sort(s)
    assert model.threshold == pytest.approx((ranked[len(bad) - 1] + ranked[len(bad)]) / 2, abs=1e-9)
    # however the rows lie, the scores are the same to the bit
    scores = lambda d: {r.doc_id: r.score for r in quality.score_quality(d, labels).collect()}
    assert scores(docs) == scores(docs.repartition(5, F.rand(1)))


def test_formatted_length(spark, sf):
    """``formatted_chars`` is the length of the template's own text."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(BYTES)
    rows = [(1, 0, "user", "hello <|im_end|> there"), (1, 1, "assistant", "ok \\<| then"), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_turns(df, path), path).collect()}
    turn = lambda role, text: f"<|im_start|>{chat.escape_role(role)}\n{chat.escape(text or '')}<|im_end|>\n"
    for conv in (1, 2):
        whole = "".join(turn(r[2], r[3]) for r in rows if r[0] == conv)
        assert got[conv].formatted_chars == len(whole)
    assert Tokenizer.from_file(path) is not None


def test_shared_tables_go(spark, tmp_path):
    """A discarded table is gone at once, other frames are left alone, and the rest goes with the process."""
    table = _common.shared_table(spark.range(5).toDF("n"))
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert table.count() == 5 and folder.exists()
    spark.range(3).write.parquet(str(tmp_path / "kept"))
    _common.discard(table, spark.read.parquet(str(tmp_path / "kept")))
    assert not folder.exists() and (tmp_path / "kept").exists()
    _common.discard(table)
    code = (
        "import sys; from pyspark.sql import SparkSession; from kindred.llm import _common\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[1]).getOrCreate()\n"
        "assert _common.shared_table(s.range(4)).count() == 4"
    )
    shared = tmp_path / "shared"
    subprocess.run([sys.executable, "-c", code, str(shared)], cwd=Path(_common.__file__).parents[2], check=True, capture_output=True)
    until = time.monotonic() + 30  # the JVM ends a moment after the process that started it
    while list(shared.glob("kindred-*")) and time.monotonic() < until:
        time.sleep(0.2)
    assert shared.exists() and not list(shared.glob("kindred-*"))

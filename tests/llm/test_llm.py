"""The operators of the subpackage: odd input, brute force, round trips."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from compare import difference, tables
from kindred.llm import chat, decontaminate, kdtree, linedup, ngram_join, pii, quality, queries, sentencepiece_lattice, token_counts, warc

DOCS = "doc_id long, text string, lang string, a string, uid long, key long"
LONG = "word " * 30_000 + "x" * 50_000
ODD = [
    (1, None, None, None, None, None),
    (2, "", "en", "", 0, 0),
    (3, " \n\n \t", "en", "a", 1, 1),
    (4, LONG, "en", "b", 1, 1),
    (5, "café 你好 \U0001f600 é <|endoftext|> ▁x \u0000 ﬁ", "fr", "c", 2, 2),
    (6, "same text here\nand a second line of it", "en", "d", 3, 3),
    (6, "same text here\nand a second line of it", "en", "d", 3, 3),
    (7, "same text here\nand a second line of it", "en", "d", 3, 3),
    (None, "no id at all", "en", "e", 4, 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    assert difference(queries.queries()[name](spark, sf), tables(sf), queries.oracle_sql()[name]) is None


# ---- 1
@pytest.fixture(scope="module")
def model():
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_are_those_of_the_library(spark, odd, model):
    path, library = model
    texts = [r[1] for r in ODD]
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in sentencepiece_lattice.encode(odd, path).collect())
    assert got == sorted(((r[0] or 0), library.encode(r[1] or "")) for r in ODD)
    back = {r.doc_id: r.text for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(odd, path), path).collect()}
    for doc_id, text in ((r[0], r[1] or "") for r in ODD):
        assert back[doc_id] == library.decode(library.encode(text)) == text.replace("▁", " ")
    assert len(texts) == len(got)


def test_pieces_of_real_texts(spark, sf, model):
    path, library = model
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in sentencepiece_lattice.encode(docs, path).collect()}
    assert all(got[r.doc_id] == library.encode(r.text) for r in docs.collect())


def test_merges_are_not_the_best_sum_of_scores(model):
    """Why the fold is over merges: for some words the path of the best sum is another."""
    path, library = model
    p = sentencepiece_lattice.pieces(path)
    differ = 0
    for word in ("▁thentionerhe", "▁Wiederherstellung", "▁responsabilidades", "▁erenthat", "▁undertaking"):
        best = {0: (0.0, [])}
        for e in range(1, len(word) + 1):
            options = [(best[s][0] - p.rank[word[s:e]], [*best[s][1], p.id[word[s:e]]]) for s in range(e) if s in best and word[s:e] in p.rank]
            if options:
                best[e] = max(options)
        differ += best[len(word)][1] != p.merged(word)
        assert p.merged(word) == library.encode(word.replace("▁", " ").lstrip(" "))
    assert differ


# ---- 2
def test_counts_are_those_of_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    more = ["AΣ ΣΣ", "it's 12,345 <|startoftext|>x<|endoftext|>", "İstanbul", "a b c", "ẛ̣", "x​y", "don'T"]
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r, text in zip(sorted(token_counts.count_tokens(rows, path).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(rows.collect(), key=lambda r: (r.doc_id or 0, len((r.text or "").encode()))), strict=True):
        assert (r.n_bytes, r.n_tokens) == (len((text.text or "").encode()), len(library.encode(text.text or "", add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 2048)


# ---- 3
def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids: dict = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((doc is None, doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(df):
    return sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_components_of_odd_rows(odd, none):
    assert found(ngram_join.jaccard_components(odd)) == components([(r[0], r[1]) for r in ODD])
    assert ngram_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("rare", [0, 2, 16])
def test_components_of_families(spark, monkeypatch, tmp_path, rare):
    """Families of copies with few and many edits, so that links are missed if any stage loses one; ``rare`` drives tokens to either index."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    pick = random.Random(rare)
    rows = []
    for family in range(4):
        base = [f"w{pick.randrange(400)}" for _ in range(pick.choice((12, 60, 150)))]
        for _ in range(40):
            words = list(base)
            for _ in range(pick.randrange(0, 4)):
                words[pick.randrange(len(words))] = f"n{pick.randrange(10**6)}"
            rows.append((len(rows), " ".join(words[: len(words) - pick.randrange(0, 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df.write.parquet(path := str(tmp_path / "families"))
    assert found(ngram_join.jaccard_components(spark.read.parquet(path))) == components(rows)


# ---- 4
def test_top_k_is_exact(spark):
    pick = random.Random(3)
    rows = [(i, [pick.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(300)]  # ties
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (950, [1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in kdtree.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    import numpy as np

    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_over_many_shards_and_blocks(spark, monkeypatch):
    """Vectors of several lengths, with shards and blocks of a few vectors and bounds of a few queries at once."""
    monkeypatch.setattr(kdtree, "SHARD_BYTES", 2500)
    monkeypatch.setattr(kdtree, "BLOCK_BYTES", 1200)
    monkeypatch.setattr(kdtree, "STEP", 3)
    monkeypatch.setattr(kdtree, "LEAF", 4)
    pick = random.Random(4)
    rows = [(i, [pick.uniform(-2, 2) for _ in range(pick.choice((3, 3, 8)))]) for i in range(240)]
    rows += [(240 + i, [1.0, 1.0, 1.0]) for i in range(120)]  # one vector is a third of all rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in kdtree.top_k(df, F.col("vec_id") % 5 == 0, k=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [int(256 * x // 1) for x in v] for i, v in rows}
    for q in (i for i in whole if i % 5 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:4]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


# ---- 5
def windows(items):
    out: dict = {}
    for name, text in items:
        w = decontaminate.words(text)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out.setdefault(tuple(w[i : i + n]), set()).add(str(name) if name is not None else "null")
    return out


def test_hits_are_those_of_all_windows(spark, odd):
    pick = random.Random(8)
    text = lambda n: " ".join(f"v{pick.randrange(6)}" for _ in range(n))
    items = [(i, text(pick.choice((3, 8, 9, 14)))) for i in range(12)] + [(50, None), (51, ""), (None, "same text here"), (3, text(9))]
    docs = [(i, text(60)) for i in range(40)] + [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = windows(items)
    got = decontaminate.match_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        w = decontaminate.words(r.text)
        hit, names = set(), set()
        for key, found_ in held.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit |= set(range(i, i + len(key)))
                    names |= found_
        assert r.n_words == len(w) and set(r.hit_items) == names
        assert {k for a, b in r.hit_spans for k in range(a, b)} == hit


def test_blocks_of_items_and_cleaning(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    items = spark.createDataFrame([(i, " ".join(f"item{i} word{j}" for j in range(6))) for i in range(6)], "item_id long, text string")
    passage = " ".join(f"item2 word{j}" for j in range(6))
    docs = spark.createDataFrame([(1, f"Before it, {passage}. After it come several more words to keep, and more and more."), (2, passage), (3, "clean"), (4, None), (5, f"AN ALL CAPS PLACE {passage.upper()} AND MORE WORDS HERE 42 Ünd ÀB so it stays")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: "Before it, . After it come several more words to keep, and more and more.", 3: "clean", 4: None, 5: "AN ALL CAPS PLACE  AND MORE WORDS HERE 42 Ünd ÀB so it stays"}


# ---- 6
def test_archives_read_back(spark):
    big = "<p>" + "payload " * 40
    rows = [(5, "http://a/\r\nx", big), (3, None, big), (9, "http://b", big), (4, "http://c", "short"), (6, "http://d", "short"), (7, None, None), (None, "http://e", big), (3, None, big), (8, "http://f", "café" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("refers_to", F.lit(2))
    archives = warc.archive_pages(pages)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_warc(archives).collect()), key=repr)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and page != 3
        want.append((page or 0, "revisit" if revisit else "response", 3 if revisit else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want, key=repr)


def test_archive_begins_with_its_dictionary():
    records = [warc.write_record(i, f"http://x/{i}", b"the same words again and again %d" % i, False, None, "2020-01-01T00:00:00Z") for i in range(200)]
    data = warc.write_archive(records)
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    assert list(warc.read_archive(data)) == records


# ---- 7
def test_forms_find_what_the_plain_patterns_find(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    pick = random.Random(1)
    pieces = ["a@b.c", "x.y@z", "@", ".", "-", " ", "1.2.3.4", "255", "256", "+1", "(", ")", "4111 1111 1111 1111", "4111111111111111", "0", "12", "café", "\U0001f600", "\n", "_q@d.e.f", "5500-0000-0000-0004", "+1 (017) 555-7713"]
    rows = [(i, "".join(pick.choice(pieces) for _ in range(pick.randrange(1, 14)))) for i in range(600)] + [(1000, None), (1001, "7" * 30_000), (1002, "1 " * 20_000), (1003, "a." * 20_000 + "@x.y"), (1004, "a@" + "b." * 20_000 + "c")]

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in s.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        if doc_id in (1001, 1002):  # the plain patterns are too slow there
            want = []
        else:
            want = [(i, m.start(), m.end()) for i, (k, p) in enumerate(plain.items()) for m in re.finditer(p, text or "") if good(k, m.group())]
        assert [tuple(s) for s in got[doc_id].base] == want, text
        assert set(want) <= {tuple(s) for s in got[doc_id].spans}


def test_contexts_find_what_no_form_finds(spark):
    known = [(i, f"some words and then phone number: +1 (2{i:02d}) 555-01{i:02d} ends") for i in range(12)]
    rows = [*known, (100, "again other words and then phone number: 555-777-0199 ends"), (101, "no such place 555-777-0198 here")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = rows[12][1]
    assert got[100] == [(3, text.index("555"), text.index(" ends"))]
    assert got[101] == []


# ---- 8
def test_scores_on_held_out_rows(spark, sf):
    rows = queries.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 0, 0), (6, 1, 0), (7, None, 0), (3, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.score == 0.5 for r in quality.score_quality(odd, labels.limit(0)).collect())
    assert quality.score_quality(none, labels).count() == 0


# ---- 9
def test_conversations_read_back(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\| <||> \\", None, "", "café \U0001f600\n", "<|endoftext|>", "plain " * 5000]
    rows = [(c, t, pick, text) for c in range(3) for t, (pick, text) in enumerate(zip(["user", "assistant", None, "as\nsistant", "assistant", "<|im_start|>", "assistant"], said, strict=True))]
    rows += [(None, 0, "user", "lost"), (7, None, "assistant", "b"), (7, 1, "assistant", "a"), (7, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).withColumn("mask", F.lit(2))
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_turns(df, path), path).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_escapes_come_back():
    pick = random.Random(4)
    for _ in range(2000):
        text = "".join(pick.choice("<|\\\nna") for _ in range(pick.randrange(10)))
        assert chat.unescape(chat.escape(text)) == text
        assert "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


# ---- 10
def test_lines_of_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id or 0, r.n_lines, r.n_dropped, r.text, r.lang, r.a, r.uid) for r in linedup.dedup_lines(odd, min_docs=2).collect()), key=repr)
    want = []
    for doc_id, text, lang, a, uid, _ in ODD:
        lines = (text or "").split("\n")
        kept = [] if doc_id in (6, 7) else lines
        want.append((doc_id or 0, len(lines), len(lines) - len(kept), "\n".join(kept), lang, a, uid))
    assert got == sorted(want, key=repr)
    assert linedup.dedup_lines(none).count() == 0


# ---- the pipeline
def test_pipeline(spark, sf, tmp_path):
    """Each stage is judged on its own input: what a later one cuts can make texts alike again."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        after.write.parquet(path := str(tmp_path / name))
        before, docs = {r.doc_id: r.text for r in docs.collect()}, spark.read.parquet(path)
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "ngram_jaccard_join":
            assert sorted(now) == sorted({c for _, _, _, c in components(list(before.items()))})
            assert all(before[k] == text for k, text in now.items())
        if name == "benchmark_decontamination":
            assert decontaminate.match_items(docs, items).where(F.size("hit_items") > 0).count() == 0
            held = windows([(r.item_id, r.text) for r in items.collect()])
            hit = {k: sum(_covered(decontaminate.words(t), held)) for k, t in before.items()}
            assert set(now) == {k for k, t in before.items() if hit[k] <= 0.5 * len(decontaminate.words(t))}
            assert all(now[k] == before[k] for k in now if not hit[k])
    last = pipeline.STAGES[-1][1](spark, docs, sf)
    assert 0 < last.count() == docs.count()
    run = pipeline.run(spark, sf)
    assert sorted(map(tuple, run.select("doc_id", F.size("ids")).collect())) == sorted(map(tuple, last.select("doc_id", F.size("ids")).collect()))


def _covered(w, held):
    hit = [False] * len(w)
    for n in {len(k) for k in held}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in held:
                hit[i : i + n] = [True] * n
    return hit

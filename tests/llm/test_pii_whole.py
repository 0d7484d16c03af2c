"""What the bootstrapping may discover, and how far it goes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kindred.llm import pii

WHOLE = ["root@localhost", "555 777 0199", "(555) 777-0199", "fe80::1ff:fe23:4567:890a", "4111 1111 1111 1112", "a.rather.long.name.without.numbers@localhost", "555-777-0199", "part_7x"]


def test_candidates_are_whole(spark):
    texts = [f"is {s} {end}" for s in WHOLE for end in ("ends", "", ". Next")] + ["10.0.0.1 555-777-0199 then", "phone:555-777-0199: then", "plain words only"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.transform(pii._located(F.col("text"), pii.CANDIDATE), lambda m: m["said"]).alias("said")).orderBy("id").collect()
    want = [[s] for s in WHOLE for _ in range(3)] + [["10.0.0.1", "555-777-0199"], ["555-777-0199"], []]
    assert [r.said for r in rows] == want


@pytest.mark.parametrize("kind, form", [("email", "user{0}@site.org"), ("ip", "10.0.0.{0}"), ("phone", "+1 (200) 555-01{0}")])
def test_a_believed_pattern_yields_every_form(spark, kind, form):
    rows = [(i, f"words and then the given value: {form.format(20 + i)} ends") for i in range(40)]
    rows += [(100 + i, f"other words then the given value: {s} stops") for i, s in enumerate(WHOLE)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, s in enumerate(WHOLE):
        text = rows[40 + i][1]
        assert got[100 + i] == [(pii.KINDS.index(kind), text.index(s), text.index(s) + len(s))], s


def test_instances_of_one_pattern_make_another_believed(spark):
    told = [f"555 777 01{i:02d}" for i in range(8)]
    rows = [(i, f"the first place: +1 (200) 555-01{i:02d}") for i in range(40)]
    rows += [(100 + i, f"the first place: {s}") for i, s in enumerate(told)]
    rows += [(200 + i, f"of another kind: {s}") for i, s in enumerate(told)]
    rows += [(300, "of another kind: 555 888 0000"), (301, "of no kind: 555 888 0001")]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in found}
    assert got[300] == [(3, 17, 29)]
    assert got[301] == []
    assert all(len(got[k + i]) == 1 for k in (100, 200) for i in range(8))


def test_shorter_contexts_tell_when_two_words_do_not(spark):
    left = [(i, f"word{chr(97 + i)} mobile: +1 (200) 555-01{i:02d}") for i in range(12)]
    right = [(20 + i, f"x{chr(97 + i)} y{chr(97 + i)} +1 (200) 555-02{i:02d} rings") for i in range(12)]
    rows = [*left, *right, (100, "unseen mobile: 555 777 0199"), (101, "un seen 555 777 0198 rings"), (102, "un heard 555 777 0197 said")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[100], got[101], got[102]) == ([(3, 15, 27)], [(3, 8, 20)], [])

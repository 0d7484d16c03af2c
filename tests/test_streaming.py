"""Streams over tables that are cut into files in no order of time."""

from __future__ import annotations

from compare import difference, tables
from kindred.plans.catalogue import ORACLE, QUERIES


def test_windows_count_all_of_several_unordered_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in (2, 0, 3, 1):
        part = events.where(f"event_id % 4 = {k}")
        # a quarter comes again with the next file: each event counts once
        again = events.where(f"event_id % 4 = {(k + 1) % 4} AND event_id % 16 < 4")
        part.unionByName(again).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) == 4
    assert difference(QUERIES["stream_windows"](spark, str(tmp_path)), tables(sf), ORACLE["stream_windows"]) is None


def test_a_table_goes_on_after_a_restart(spark, tmp_path):
    from kindred.streaming.ingest import StagedTable

    rows = lambda *r: spark.createDataFrame(r, "k long, v long, t long, x string")
    make = lambda: StagedTable(spark, f"{tmp_path}/table", "k", "v", "t")
    assert make().read() is None
    make().apply(rows((1, 1, 0, "a"), (2, 1, 0, "b")), 0)
    again = make()  # as after a restart: the first batch comes once more, then another
    again.apply(rows((1, 9, 0, "not twice")), 0)
    again.apply(rows((2, 2, 0, "c"), (3, 1, 0, "d")), 1)
    assert sorted((r.k, r.x) for r in make().read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert make().done == 1

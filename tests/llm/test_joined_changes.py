"""A history in a folder: opened again, run again, broken off, and with changes that a later row joins."""

import pytest

from strandline.llm import batch_dedup
from test_llm import EVENTS, LONG


def _row(seq, type_, ref, message=None, sha=None):
    return (seq, seq, "l", type_, ref, "Close edges", message, sha, 0)


A, B, C = "a" * 40, "b" * 40, "c" * 40
BATCHES = [
    [_row(1, "pr_merge", "#5", "m")],
    [_row(2, "commit", A, LONG), _row(3, "tag", "v1.2.3")],
    [_row(4, "pr_merge", "#5", "m", A), _row(9, "pr_merge", "#9", "m", "d" * 40)],
    [_row(5, "commit", B, LONG), _row(6, "pr_merge", "PR-5", "m"), _row(7, "tag", "1.2.3"), _row(8, "commit", C, LONG.replace("trusted", "trustd")), _row(10, "commit", "d" * 40, "short")],
]
WHOLE = {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 1, 7: 3, 8: 1, 9: 9, 10: 9}


def _firsts(df):
    return {r["seq"]: r["first"] for r in df.collect()}


def test_a_history_opened_again_for_each_batch_gives_what_one_run_gives(spark, tmp_path):
    at, told = str(tmp_path / "h"), {}
    for i, rows in enumerate(BATCHES):
        batch = spark.createDataFrame(rows, EVENTS)
        told |= _firsts(batch_dedup.History(spark, at, 4).ingest(batch, i))
        assert _firsts(batch_dedup.History(spark, at).ingest(batch, i)) == {r[0]: told[r[0]] for r in rows}  # once more
    assert told == WHOLE | {2: 2}  # the second row was a change of its own until the fourth came
    history = batch_dedup.History(spark, at)
    assert _firsts(history.firsts()) == WHOLE and history.batches() == list(range(4)) and history.buckets == 4
    every = spark.createDataFrame([r for rows in BATCHES for r in rows], EVENTS)
    assert _firsts(batch_dedup.first_rows(every, 1)) == WHOLE


def test_what_a_broken_batch_has_left_is_not_read(spark, tmp_path):
    at = str(tmp_path / "h")
    batch_dedup.History(spark, at).ingest(spark.createDataFrame(BATCHES[1], EVENTS), 0)
    history = batch_dedup.History(spark, at)

    class Lost(Exception):
        pass

    def fail(name, *rest):
        if name == "segments":
            raise Lost
        batch_dedup.History.write(history, name, *rest)

    history.write = fail
    with pytest.raises(Lost):
        history.ingest(spark.createDataFrame(BATCHES[3], EVENTS), 1)
    again = batch_dedup.History(spark, at)
    assert again.batches() == [0]
    assert _firsts(again.ingest(spark.createDataFrame(BATCHES[3], EVENTS), 1)) == {5: 2, 6: 6, 7: 3, 8: 2, 10: 10}


def test_a_batch_reads_the_buckets_of_its_own_keys(spark, tmp_path):
    history = batch_dedup.History(spark, str(tmp_path / "h"), 16)
    history.ingest(spark.createDataFrame([_row(i, "tag", f"v{i}.0") for i in range(1, 60)], EVENTS), 0)
    keys = batch_dedup.keyed_rows(spark.createDataFrame([_row(90, "tag", "7.0")], EVENTS))
    buckets = history.touched(keys, "key")
    plan = history.read("refs", [0], buckets)._jdf.queryExecution().executedPlan().toString()
    assert len(buckets) == 1 and f"bucket#" in plan and "PartitionFilters: [" in plan and f"= {buckets[0]})" in plan
    assert history.read("refs", [0], buckets).count() < 20


def test_an_empty_batch(spark, tmp_path):
    history = batch_dedup.History(spark, str(tmp_path / "h"))
    none = spark.createDataFrame([], EVENTS)
    assert history.ingest(none, 0).count() == 0 and history.ingest(none, 1).count() == 0 and history.firsts().count() == 0

"""Streaming jobs on captures that come in no order of time: every job against its batch twin, at few and many files a batch, and over restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect as D
from tidemark.plans.reconcile import confirm_hits
from tidemark.sources import epochs
from tidemark.sources import fixtures as X
from tidemark.sources import readers
from tidemark.streaming import jobs as J

EVENT = datetime(2026, 6, 10, 12, 30)
DELAY = "2 days"


def made_log(n_releases=6, seed=4):
    """(LOG rows): per release and source a baseline, then polls of which some failed, some are stale or out of bounds."""
    made, rows, seq = random.Random(seed), [], 0
    for release in range(n_releases):
        event = EVENT + timedelta(hours=6 * release)
        for source, *_ in X.SOURCES:
            for minute in sorted(made.sample(range(-90, 175), 24)):
                seq += 1
                value, failed = float(made.choice([0, 1, 1, 2, 3, 7])), made.random() < 0.25
                at = event + timedelta(minutes=minute, seconds=made.randint(0, 59))
                rows.append((release, source, seq, at, 500 if failed else 200, None if failed else f"e{int(value)}", 0 if made.random() < 0.2 else 1, None if failed else value, f"failed {seq}" if failed else None, event))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(made_log(), X.LOG).cache()


def shuffled(spark, path, rows, files, beat_days=400):
    """The rows in files without any order, and a heartbeat in the last."""
    made = random.Random(files)
    rows = rows[:]
    made.shuffle(rows)
    parts = [rows[i::files] for i in range(files)] + ([[(None, None, None, EVENT + timedelta(days=beat_days), None, None, None, None, None, None)]] if beat_days else [])
    for part in parts:
        spark.createDataFrame(part, X.LOG).coalesce(1).write.mode("append").parquet(path)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


HIT = ("release_id", "source_id", "seq")


@pytest.mark.parametrize("per_batch", [1, 100])
def test_disorder_changes_nothing(spark, log, tmp_path, per_batch):
    path, window = f"file://{tmp_path}/log", "3 hours"
    shuffled(spark, path, log.collect(), 5)
    stream = lambda: readers.stream_captures(spark, path, X.LOG, per_batch)
    policies, twin = X.detection_policies(spark), D.until_close(log, window, "1 day")

    got = J.run_once(J.detect_changes_stream(stream(), policies, X.valid(), DELAY), "c", rocks=True)
    assert collected(got, *HIT, "method") == collected(D.changed_captures(log, policies, X.valid()), *HIT, "method")

    inside = D.until_close(log, window, "2 seconds")
    first = D.first_hits(inside, ("seq", "captured_at"))
    assert collected(J.run_once(J.first_hit_stream(stream(), window, DELAY), "f"), *HIT, "captured_at") == collected(first, *HIT, "captured_at")

    valid = inside.filter(X.valid()).groupBy("release_id").agg(F.min(F.struct("captured_at", "source_id", "seq")).alias("w")).select("release_id", "w.source_id", "w.seq")
    assert collected(J.run_once(J.race_stream(stream(), X.valid(), window, DELAY), "r", rocks=True), *HIT) == collected(valid, *HIT)

    released = J.release_stream(stream(), X.sources(spark), policies, X.good(), X.valid(), None, window, "1 day", delay=DELAY)
    hits = D.hits_of_versions(D.versions(twin, X.good(), X.valid()), policies)
    columns = ("release_id", "status", "reason", "actual", "matched_sources", "warnings", "pending_sources", "winner", "latency_ms", "last_error")
    assert collected(J.run_once(released, "a"), *columns) == collected(confirm_hits(hits, X.sources(spark)), *columns)
    assert {r.hit is None for r in hits.collect()} == {False} or hits.filter("hit is null").count() > 0


def test_detection_skips_failed_unchanged_and_invalid_captures(spark):
    at = lambda m: EVENT + timedelta(minutes=m)
    ok = lambda seq, m, value, period=1: (1, "purchase", seq, at(m), 200, f"e{seq}", period, value, None, EVENT)
    bad = lambda seq, m: (1, "purchase", seq, at(m), 500, None, 0, None, "timeout", EVENT)
    rows = [ok(1, -30, 2.0, 0), bad(2, -20), bad(3, -2), ok(4, 0, 2.0), bad(5, 1), ok(6, 2, 9.0), ok(7, 3, 1.0, 0), ok(8, 4, 2.0), ok(9, 5, 1.0), ok(10, 6, 3.0)]
    twin = D.until_close(spark.createDataFrame(rows, X.LOG), "3 hours", "1 day")
    hit = D.hits_of_versions(D.versions(twin, X.good(), X.valid()), X.detection_policies(spark)).first()
    # the failures before the event are no baseline; then unchanged, failed, out of bounds, stale, unchanged
    assert (hit.base.actual, hit.hit.seq, hit.hit.actual, hit.hit.method, hit.polls, hit.last_error) == (2.0, 9, 1.0, "content", 10, "timeout")
    none = D.until_close(spark.createDataFrame([bad(1, -5), ok(2, 1, 9.0), bad(3, 2)], X.LOG), "3 hours", "1 day")
    row = D.hits_of_versions(D.versions(none, X.good(), X.valid()), X.detection_policies(spark)).first()
    assert row.hit is None and row.base is None
    new = D.until_close(spark.createDataFrame([ok(1, 1, 2.0)], X.LOG), "3 hours", "1 day")
    assert D.hits_of_versions(D.versions(new, X.good(), X.valid()), X.detection_policies(spark)).first().hit.method == "no baseline"


def test_state_is_empty_after_the_last_window(spark, log, tmp_path):
    path = f"file://{tmp_path}/log"
    shuffled(spark, path, log.collect(), 3)
    stream = lambda: readers.stream_captures(spark, path, X.LOG, 1)
    jobs = {
        "changes": (J.detect_changes_stream(stream(), None, None, DELAY), ("held", "last")), "race": (J.race_stream(stream(), None, "3 hours", DELAY), ("best",)),
        "deadline": (J.deadline_stream(stream(), "3 hours", "nobody", delay=DELAY), ("seen",)),
    }
    with J.settings(spark, J.ROCKS):
        for name, (job, states) in jobs.items():
            place = f"file://{tmp_path}/{name}"
            assert J.run_once(job, name, rocks=True, checkpoint=place).count() > 0
            for state in states:
                assert spark.read.format("statestore").option("stateVarName", state).load(place).count() == 0


def test_order_is_kept_within_the_delay_and_late_rows_go(spark, tmp_path):
    """A watermark in the middle: what is behind it is final, what comes later than the delay is dropped."""
    path, checkpoint = f"file://{tmp_path}/log", f"file://{tmp_path}/c"
    row = lambda seq, m, tag: (1, "s", seq, EVENT + timedelta(minutes=m), 200, tag, 1, 1.0, None, EVENT)
    beat = lambda m: (None, None, None, EVENT + timedelta(minutes=m), None, None, None, None, None, None)
    found = []
    for part in ([row(3, 8, "b"), row(1, 0, "a")], [row(2, 4, "a"), beat(30)], [row(4, 1, "z"), row(5, 29, "c"), beat(90)]):
        spark.createDataFrame(part, X.LOG).coalesce(1).write.mode("append").parquet(path)
        stream = readers.stream_captures(spark, path, X.LOG, 1).select("release_id", "source_id", "seq", "captured_at", "etag")
        done = J.run_once(J.detect_changes_stream(stream, delay="10 minutes"), "o", rocks=True, checkpoint=checkpoint, out=f"file://{tmp_path}/o")
        found.append(collected(done, "seq", "method"))
    assert found == [[], [(3, "headers")], [(3, "headers"), (5, "headers")]]


# epoch tables


def test_epochs_are_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    least = lambda rows: rows.groupBy("k").agg(F.min("v").alias("v"))
    table = epochs.EpochTable(spark, path, "k long, v long", least, compact_after=4)
    of = lambda *rows: spark.createDataFrame(rows, "k long, v long")
    assert table.read().count() == 0
    assert table.commit(of((1, 5), (2, 9)), 0, "w") and not table.commit(of((1, 0)), 0, "w")
    of((1, 0)).write.parquet(f"{path}/data/w-{1:012d}")  # a batch that was killed before its manifest
    assert collected(table.read(), "k", "v") == [(1, 5), (2, 9)]
    assert table.commit(of((1, 3)), 1, "w") and table.commit(of((3, 1)), 0, "other")
    assert collected(table.read(), "k", "v") == [(1, 3), (2, 9), (3, 1)] and len(table.folders()) == 3
    before = table.read()
    assert table.commit(of((2, 8)), 2, "w")
    assert collected(before, "k", "v") == [(1, 3), (2, 9), (3, 1)]  # a reader of the version before the merge
    assert collected(table.read(), "k", "v") == [(1, 3), (2, 8), (3, 1)] and len(table.folders()) == 1
    assert not table.commit(of((2, 0)), 2, "w") and table.commit(of((9, 9)), 3, "w")
    assert collected(epochs.EpochTable(spark, path, "k long, v long", least).read(), "k", "v") == [(1, 3), (2, 8), (3, 1), (9, 9)]


def test_a_batch_killed_before_its_manifest_is_written_once(spark, log, tmp_path, monkeypatch):
    path, place, checkpoint = f"file://{tmp_path}/log", f"file://{tmp_path}/docs", f"file://{tmp_path}/c"
    shuffled(spark, path, log.collect(), 2)
    documents = lambda: J.first_hit_stream(readers.stream_captures(spark, path, X.LOG, 1), "3 hours", DELAY).select("release_id", F.to_json(F.struct("source_id", "seq")).alias("document"))
    publish, calls = epochs.EpochTable._publish, []

    def killed(self, state):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        publish(self, state)

    monkeypatch.setattr(epochs.EpochTable, "_publish", killed)
    with pytest.raises(Exception, match="killed"):
        J.document_stream(documents(), place, checkpoint)
    assert len(calls) == 2
    got = collected(J.document_stream(documents(), place, checkpoint), "release_id", "document")
    twin = D.first_hits(D.until_close(log, "3 hours", "2 seconds"), ("seq",)).select("release_id", F.to_json(F.struct("source_id", "seq")).alias("document"))
    assert got == collected(twin, "release_id", "document")
    assert collected(J.document_stream(documents(), place, checkpoint), "release_id", "document") == got


def test_a_batch_of_the_leaderboard_writes_in_proportion_to_its_rows(spark, log, tmp_path):
    path, place, checkpoint = f"file://{tmp_path}/log", f"{tmp_path}/board", f"file://{tmp_path}/c"
    shuffled(spark, path, log.collect(), 1, beat_days=0)
    J.leaderboard_stream(readers.stream_captures(spark, path, X.LOG), f"file://{place}", checkpoint)
    late = (0, "purchase", 99_999, EVENT - timedelta(seconds=1), 200, "e", 1, 1.0, None, EVENT)
    spark.createDataFrame([late], X.LOG).coalesce(1).write.mode("append").parquet(path)
    board = J.leaderboard_stream(readers.stream_captures(spark, path, X.LOG), f"file://{place}", checkpoint)
    newest = epochs.EpochTable(spark, f"file://{place}", J.HITS).folders()[-1]
    assert spark.read.parquet(f"file://{place}/{newest}").count() == 1
    assert board.filter("release_id = 0 and rank = 1").select("seq").first().seq == 99_999


def test_a_batch_is_held_as_one_value_per_key(spark, tmp_path):
    path, place = f"file://{tmp_path}/log", f"file://{tmp_path}/c"
    rows = [(1, "s", seq, EVENT + timedelta(minutes=seq), 200, "a", 1, 1.0, None, EVENT) for seq in range(5)]
    spark.createDataFrame(rows, X.LOG).coalesce(1).write.parquet(path)
    stream = readers.stream_captures(spark, path, X.LOG, 1)
    with J.settings(spark, J.ROCKS):
        assert J.run_once(J.detect_changes_stream(stream, delay="1 hour"), "h", rocks=True, checkpoint=place).count() == 0
        assert spark.read.format("statestore").option("stateVarName", "held").load(place).count() == 1

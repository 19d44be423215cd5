"""Timers of a stream: once per worker, or again after each firing."""

from tidemark.streaming.timers import timed_on_events


def test_a_periodic_timer_fires_again_and_numbers_its_runs(spark, tiny):
    by_worker = {}
    for r in timed_on_events(spark, tiny, 4, every_ms=1).orderBy("worker", "run").collect():
        by_worker.setdefault(r["worker"], []).append(r)
    assert set(by_worker) == {0, 1, 2, 3}
    for runs in by_worker.values():
        assert [r["run"] for r in runs] == list(range(1, len(runs) + 1)) and len(runs) > 1
        assert all(r["registered_ms"] < r["due_ms"] <= r["fired_ms"] for r in runs)
        assert all(a["fired_ms"] + 1 == b["due_ms"] for a, b in zip(runs, runs[1:]))

"""Stalls told by changes: the same rows, while neither the stream nor a task holds those of a session together."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_captures import silences

from cairn.jobs import system_queries
from cairn.jobs.registry import QUERIES
from cairn.streaming import ingest, watchdog


def shown(name, stalls):
    """Rows of a query for brute-force silences."""
    if name == "st_watchdog":
        return sorted((s, at * 1000, len(alive), ",".join(map(str, alive))) for s, at, alive in stalls)
    return sorted((s, at * 1000, place, pid) for s, at, alive in stalls for place, pid in enumerate(alive, 1))


@pytest.mark.parametrize("name", ["st_watchdog", "sort_alive_pids"])
def test_a_stream_tells_no_more_than_changes(spark, tmp_path, monkeypatch, name):
    # 200 users of two sessions are forked; then two of them take turns to leave and come back, each time after a silence.
    users = [20 * (k // 2) + k % 2 for k in range(200)]
    steps = [(k, user, "signup") for k, user in enumerate(users)] + [(200 + 11 * k, users[k % 2], "purchase" if k % 4 < 2 else "view") for k in range(600)]
    events = spark.createDataFrame([(i, *step) for i, step in enumerate(steps)], "event_id long, second long, user_id long, event_type string")
    events.select("event_id", F.timestamp_seconds("second").cast("timestamp_ntz").alias("ts"), "user_id", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    want = silences([(user % 20, at, 1000 + user, {"signup": "fork", "purchase": "exit"}.get(kind, "open")) for at, user, kind in steps])
    kept, drained = [], ingest.drained

    def spied(*args):
        kept.append(drained(*args))
        return kept[-1]

    monkeypatch.setattr(system_queries.ingest, "drained", spied)
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == shown(name, want)
    (told,) = kept
    numbers = [F.sum(F.size(f.name) if isinstance(f.dataType, T.ArrayType) else F.lit(1)) for f in told.schema]
    assert sum(told.select(*numbers).first()) < 5 * 3 * len(steps) < sum(len(alive) for _, _, alive in want)


@pytest.mark.parametrize("block", [1, 25, 1 << 20])
def test_blocks_of_any_size(spark, tmp_path, block):
    rng, at, rows = random.Random(7), 0, []
    for _ in range(400):
        at += rng.choice([0, 1, 9, 10, 30])
        rows.append((rng.randrange(3), at, rng.randrange(9), rng.choice(["fork", "open", "exit"])))
    table = spark.createDataFrame(rows, "session long, second long, pid long, kind string").select("session", F.timestamp_seconds("second").alias("ts"), "pid", "kind")
    times = sorted({r[1] for r in rows})
    for low, high in ((0, times[len(times) // 2]), (times[len(times) // 2], 1 << 40)):
        table.filter(F.unix_seconds("ts").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "trace"))
    told = ingest.drained(spark, str(tmp_path / "trace"), lambda r: watchdog.told(r, block=block), watchdog.TOLD, 1)
    assert sorted(map(tuple, watchdog.texts(told).collect())) == shown("st_watchdog", silences(rows))
    assert sorted(map(tuple, watchdog.ranks(told).collect())) == shown("sort_alive_pids", silences(rows))


def test_a_task_unfolds_a_little_at_a_time():
    # 2000 processes in each of 3000 silences are 48 MB of numbers.
    what, number = [watchdog.CAME] * 2000 + [watchdog.SILENT] * 3000, [*range(2000), *range(0, 3000 * 10**7, 10**7)]
    n = len(what)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([0] * n), pa.array(range(n)), pa.array(what, pa.int8()), pa.array(number)], ["session", "block", "place", "what", "number"])
    tracemalloc.start()
    try:
        rows = 0
        for one in watchdog.unfolding(watchdog.listed)(iter([batch])):
            assert one.nbytes < 2 << 20
            rows += one.num_rows
        assert rows == 3000 and tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()

"""Late and repeated postings of a stream, where keys are rare: against a plain loop, and the query against its twin."""

from __future__ import annotations

import random

import duckdb
import pytest

from ledgerloom.plans import q_runs, registry
from ledgerloom.streaming import guard

DAY = 86_400_000


def test_late_and_repeated_postings_equal_a_plain_loop(spark, tmp_path):
    own, rng = q_runs._streaming(spark, guard.LATE_AT_ONCE), random.Random(5)
    # whole days and a millisecond beside them: times meet watermarks and ends of memory exactly
    batches = [[(k, 100 * b + k, (rng.randrange(20, 29) + 2 * b) * DAY + rng.randrange(-1, 2)) for k in rng.sample(range(60), 30)] for b in range(4)]
    schema = "key long, event_id long, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, "key long, event_id long, ms long").selectExpr("key", "event_id", "timestamp_millis(ms) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = guard.first_seen_within(stream, ["key"], late="2 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    want, held, newest, late = [], {}, 0, 0
    for rows in batches:
        mark = newest - 2 * DAY
        for key, event, t in rows:
            late += t <= mark and key not in held
            if t > mark and key not in held:
                want.append(event)
                held[key] = t + 2 * DAY
        held = {k: until for k, until in held.items() if until > mark}
        newest = max([newest, *(t for _, _, t in rows)])
    assert late
    assert sorted(r.event_id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == sorted(want)


def test_a_session_that_lets_late_postings_pass_is_refused(spark):
    rows = spark.newSession().readStream.format("rate").load()
    with pytest.raises(ValueError, match="allowMultiple"):
        guard.first_seen_within(rows, ["value"], "timestamp")


def test_keys_of_one_event_equal_the_twin(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(i * 37 % 720 AS INT)) AS ts, i * i % 331 AS user_id, CASE WHEN i % 2 = 0 THEN 'view' ELSE 'click' END AS event_type, 1.0 AS value, '' AS props
        FROM range(600) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = duck.execute(registry.oracle_sql()["late_postings"]).fetchall()
    got = registry.queries()["late_postings"](spark, str(tmp_path)).select("key", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert want and duck.execute("SELECT 1 FROM events GROUP BY user_id, event_type HAVING count(*) = 1").fetchall()

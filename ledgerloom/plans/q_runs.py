"""Queries of runs: the discovery pipeline, source health, schedules, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dedup, registry
from ..storage import fresh
from ..streaming import guard
from . import discovery, q_keys
from .views import choice, table

HOUR = 3_600_000
SEEN = ("ok", "error", "429", "gone")
COMPANIES = ("Alpha SpA", "Beta Srl", "Orienta Agenzia", "Gamma Ltd", "Delta GmbH", "Epsilon")


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cards: the posting of a card is p_partkey % 1500, so later parts repeat earlier ones."""
    k = F.col("p_partkey")
    job = k % 1500
    return table(spark, d, "part").select(
        k.alias("ord"),
        F.concat_ws(" ", choice(job, q_keys.TITLES), F.lit("x")).alias("title"),
        choice(F.floor(job / 8), COMPANIES).alias("company"),
        choice(F.floor(job / 5), q_keys.PLACES).alias("location"),
        F.concat(F.lit("https://jobs.test/"), job.cast("string"), F.lit("?utm_source="), (k % 7).cast("string")).alias("url"),
        F.when(k % 3 == 0, "ux and design").otherwise("").alias("snippet"),
        F.lit(None).cast("string").alias("sourceJobId"),
        F.array().cast("array<string>").alias("alternateUrls"),
        F.when(job % 10 == 3, "fully_remote").alias("workMode"),
        F.lit("portal").alias("source"),
        choice(k, ("design intern", "ux intern")).alias("discoveryQuery"),
    )


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    config = discovery.Config({"A": ["design"], "B": ["ux"]}, ["intern"], ["clerk"], 200)
    aggregators = spark.createDataFrame([("orienta", 1)], "pattern string, entry_ord int")
    old = table(spark, d, "part").filter("p_partkey % 1500 < 300").select(choice(F.floor((F.col("p_partkey") % 1500) / 8), ("alpha", "beta", "orienta agenzia", "gamma", "delta", "epsilon")).alias("norm_company"), F.concat(F.lit("https://jobs.test/"), (F.col("p_partkey") % 1500).cast("string")).alias("url_norm"))
    return discovery.run(_cards(spark, d), config, aggregators, (old, spark.createDataFrame([], "norm_company string, role_key string")))


def discover_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("ord", "outcome", "ground", F.round("score", 9).alias("score"))


def conservation(spark: SparkSession, d: str) -> DataFrame:
    """Counts by outcome, and of all cards."""
    counts = discovery.counters(_outcomes(spark, d))
    seen = table(spark, d, "part").agg(F.count(F.lit(1)).alias("n")).select(F.lit("seen").alias("outcome"), "n")
    return counts.unionByName(seen)


def run_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of a run, counted while its rows are written, beside a count of what was written."""
    path = fresh(spark, "run")
    discovery.write_run(_outcomes(spark, d), path)
    rows = spark.read.parquet(f"{path}/rows")
    grounds = rows.filter("ground is not null").groupBy(F.concat(F.lit("excluded: "), "ground").alias("name"))
    written = rows.groupBy(F.col("outcome").alias("name")).agg(F.count(F.lit(1)).alias("rows")).union(grounds.agg(F.count(F.lit(1)))).union(rows.agg(F.count(F.lit(1))).select(F.lit("seen"), "*"))
    return spark.read.schema("name string, n long").json(f"{path}/report").join(written, "name", "left").select("name", "n", F.coalesce("rows", F.lit(0)).alias("rows"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "gone").when((F.col("event_type") == "click") & (F.col("event_id") % 5 == 0), "429").otherwise("ok")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("seq"), kind.alias("outcome"), "ts")


def source_health(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in SEEN])


def error_streaks(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of errors of each source, and the first response by which it would stop at three."""
    r = registry.windowed_islands(_responses(spark, d), "source", "seq", F.col("outcome") == "ok", F.col("outcome") == "error")
    return r.groupBy("source").agg(F.max("streak").alias("longest"), F.min(F.when(F.col("streak") >= 3, F.col("seq"))).alias("stop_seq"))


def limiter_schedule(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    return registry.send_times(e, "user_id", ["arrival", "event_id"], "arrival", 600_000_000).select("event_id", F.col("send_at").alias("send_us"))


def heartbeat_gap(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("user_id", us.alias("us"))
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us"))
    return e.withColumn("gap", gap).groupBy("user_id").agg(F.max("gap").alias("longest_us"))


def last_success(spark: SparkSession, d: str) -> DataFrame:
    """Days to search back: from the last good run before a day, with three to spare."""
    e = table(spark, d, "events").filter("ts < timestamp_ntz'2024-01-20 00:00:00'")
    last = F.max(F.when(F.col("event_type") == "purchase", F.to_date("ts")))
    return e.groupBy("user_id").agg(F.datediff(F.lit("2024-01-20").cast("date"), last).alias("gap")).select("user_id", (F.col("gap") + 3).cast("long").alias("window_days"))


def recency_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("ts >= timestamp_ntz'2024-01-15 00:00:00'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def checkpoint_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat_ws("/", "user_id", "event_type").alias("key"), "event_id")
    return dedup.latest(e, "key", "event_id").select("key", "event_id")


def unread_postings(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("sourceJobId"))
    return guard.unread(table(spark, d, "customer").select(F.col("c_custkey").alias("sourceJobId")), held)


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Outcome counts of a read: what was asked for, held, and left."""
    o = table(spark, d, "orders")
    return o.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("o_orderstatus") == "F").alias("active"), F.count_if(F.col("o_orderstatus") == "O").alias("to_verify"), F.count_if(F.col("o_orderstatus") == "P").alias("blocked"))


def artifact_hashes(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import manifest

    return manifest(table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("body"))).withColumnRenamed("name", "doc_id")


def fsm_stop(spark: SparkSession, d: str) -> DataFrame:
    """The guarded fetch of each source, with cooldowns; tests hold it against a plain loop."""
    return guard.health(_responses(spark, d), max_429=3, max_errors=3, max_cooldowns=2)


def _streaming(spark: SparkSession, settings: dict[str, str] | None = None) -> SparkSession:
    """A session that shares all but its settings, with the state store that timers need."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, value in (settings or {}).items():
        own.conf.set(name, value)
    return own


def _run_out(stream: DataFrame, name: str, mode: str = "append") -> str:
    """The folder in which all rows of a stream over what is there now are."""
    to = fresh(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{to}/rows"


def source_waits(spark: SparkSession, d: str) -> DataFrame:
    """Rate-limited sources held for half a day and resumed, and those silent for a day, as a stream of three batches and timers tell it."""
    r = _responses(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    own, path = _streaming(spark), fresh(spark, "responses")
    cuts = ("2024-01-11", "2024-01-21")
    for part in (F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1]):
        r.filter(part).coalesce(1).write.mode("append").parquet(path)
    stream = own.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = _run_out(guard.watched(stream, 12 * HOUR, 24 * HOUR), "waits")
    rows = spark.read.schema("source string, kind string, at_ms long").parquet(found)
    return rows.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


def late_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings that come in three batches, the second before the first: repeated ones within two days and late ones are left out."""
    e = table(spark, d, "events").select(F.concat_ws("/", "user_id", "event_type").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id"))
    e = e.withColumn("turn", turn).filter("turn <= 3")
    own, path = _streaming(spark, guard.LATE_AT_ONCE), fresh(spark, "postings")
    for i in (2, 1, 3):
        e.filter(F.col("turn") == i).drop("turn").coalesce(1).write.mode("append").parquet(path)
    stream = own.readStream.schema("key string, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return spark.read.schema("key string, event_id long, ts timestamp").parquet(_run_out(guard.first_seen_within(stream, ["key"], late="2 days"), "postings")).select("key", "event_id")


_RESP = "(SELECT CAST(user_id AS VARCHAR) AS source, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'gone' WHEN event_type = 'click' AND event_id % 5 = 0 THEN '429' ELSE 'ok' END AS outcome FROM events)"
_OUT = rf"""WITH c AS (SELECT p_partkey AS ord, p_partkey % 1500 AS job, {q_keys._pick(q_keys.TITLES, '(p_partkey % 1500)')} || ' x' AS title, {q_keys._pick(COMPANIES, '(p_partkey % 1500) // 8')} AS company, {q_keys._pick(q_keys.PLACES, '(p_partkey % 1500) // 5')} AS place,
    CASE WHEN p_partkey % 3 = 0 THEN 'ux and design' ELSE '' END AS snippet FROM part),
  g AS (SELECT *, CASE WHEN {q_keys._GEO.format('place')} = 'non-eu' THEN 'non-eu' WHEN company = 'Orienta Agenzia' THEN 'unresolved' END AS o1,
    CASE WHEN regexp_matches(title, '(?i)\b(?:{q_keys.SQL_SENIOR})\b') AND (regexp_matches(title, '(?i)\b(?:{q_keys.SQL_OUTRIGHT})\b') OR NOT regexp_matches(title, '(?i)\b(?:{q_keys.SQL_JUNIOR})\b')) AND NOT regexp_matches(title || chr(10) || snippet, '(?i)\b(?:{q_keys.SQL_INTERN})\b') THEN 'senior-without-stage'
      WHEN job % 10 = 3 THEN 'fully-remote' END AS gr FROM c),
  h AS (SELECT *, CASE WHEN o1 IS NOT NULL THEN o1 WHEN gr IS NOT NULL THEN 'excluded' END AS o2 FROM g),
  s AS (SELECT job, min(ord) AS ord, arg_max(snippet, struct_pack(a := length(snippet), b := -ord)) AS snip, any_value(title) AS title FROM h WHERE o2 IS NULL GROUP BY job),
  z AS (SELECT *, job < 300 AS dup, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN regexp_matches(title, '(?i)\b(?:{q_keys.SQL_INTERN})\b') THEN 0.3::DOUBLE WHEN regexp_matches(snip, '(?i)\b(?:{q_keys.SQL_INTERN})\b') THEN 0.15::DOUBLE ELSE 0::DOUBLE END
    - CASE WHEN regexp_matches(title || chr(10) || snip, '(?i)\bclerk\b') THEN 0.25::DOUBLE ELSE 0::DOUBLE END + (regexp_matches(title || chr(10) || snip, '(?i)\bdesign\b')::INT + regexp_matches(title || chr(10) || snip, '(?i)\bux\b')::INT) / 2.0::DOUBLE * 0.25::DOUBLE)) AS score FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY dup ORDER BY score DESC, ord) AS rn FROM z),
  out AS (SELECT h.ord, coalesce(o2, CASE WHEN r.ord IS NULL THEN 'merged' WHEN dup THEN 'duplicate' WHEN rn <= 200 THEN 'kept' ELSE 'dropped' END) AS outcome, CASE WHEN o1 IS NULL THEN gr END AS ground, CASE WHEN o2 IS NULL AND NOT dup THEN round(score, 9) END AS score FROM h LEFT JOIN r ON r.ord = h.ord AND h.o2 IS NULL)"""

SQL = {
    "discover_outcomes": _OUT + " SELECT ord, outcome, ground, score FROM out",
    "conservation": _OUT + " SELECT outcome, count(*) AS n FROM out GROUP BY 1 UNION ALL SELECT 'seen', count(*) FROM part",
    "run_report": _OUT + """, n AS (SELECT outcome AS name FROM out UNION ALL SELECT 'excluded: ' || ground FROM out WHERE ground IS NOT NULL UNION ALL SELECT 'seen' FROM part),
      k AS (SELECT unnest(['seen', 'non-eu', 'unresolved', 'excluded', 'merged', 'duplicate', 'kept', 'dropped', 'excluded: senior-without-stage', 'excluded: fully-remote', 'excluded: closed-ad', 'excluded: mandatory-language', 'other']) AS name)
      SELECT k.name, count(n.name) AS n, count(n.name) AS rows FROM k LEFT JOIN n USING (name) GROUP BY k.name""",
    "source_health": f"SELECT source, count(*) AS requests, count(*) FILTER (WHERE outcome = 'ok') AS n_ok, count(*) FILTER (WHERE outcome = 'error') AS n_error, count(*) FILTER (WHERE outcome = '429') AS n_429, count(*) FILTER (WHERE outcome = 'gone') AS n_gone FROM {_RESP} GROUP BY 1",
    "error_streaks": f"""WITH i AS (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY source ORDER BY seq) AS island FROM {_RESP}), s AS (SELECT *, sum((outcome = 'error')::INT) OVER (PARTITION BY source, island ORDER BY seq) AS streak FROM i)
      SELECT source, CAST(max(streak) AS BIGINT) AS longest, min(seq) FILTER (WHERE streak >= 3) AS stop_seq FROM s GROUP BY 1""",
    "limiter_schedule": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS a, CAST(row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS BIGINT) AS i FROM events)
      SELECT event_id, max(a - i * 600000000) OVER (PARTITION BY user_id ORDER BY i) + i * 600000000 AS send_us FROM e""",
    "heartbeat_gap": "SELECT user_id, max(g) AS longest_us FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) GROUP BY 1",
    "last_success": "SELECT user_id, date_diff('day', max(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END), DATE '2024-01-20') + 3 AS window_days FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1",
    "recency_filter": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1",
    "checkpoint_dedup": "SELECT user_id || '/' || event_type AS key, max(event_id) AS event_id FROM events GROUP BY 1",
    "unread_postings": "SELECT c_custkey AS \"sourceJobId\" FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'view')",
    "run_summary": "SELECT count(*) AS targets, count(*) FILTER (WHERE o_orderstatus = 'F') AS active, count(*) FILTER (WHERE o_orderstatus = 'O') AS to_verify, count(*) FILTER (WHERE o_orderstatus = 'P') AS blocked FROM orders",
    "fsm_stop": f"""WITH RECURSIVE o AS (SELECT source, outcome, row_number() OVER (PARTITION BY source ORDER BY seq) AS i FROM {_RESP}),
      r AS (SELECT source, 0 AS i, 0 AS requests, 0 AS ok, 0 AS n429, 0 AS gone, 0 AS errors, 0 AS cool, 0 AS streak, 0 AS base, 0 AS last_ok, NULL::VARCHAR AS reason, 0 AS unsent FROM o GROUP BY 1
        UNION ALL SELECT r.source, o.i, requests + go, ok + (go * (outcome = 'ok')::INT), n429 + lim, gone + (go * (outcome = 'gone')::INT), errors + err, cool + (full_ AND may)::INT, CASE WHEN go = 0 THEN streak WHEN outcome = 'ok' THEN 0 ELSE streak + err END,
          CASE WHEN full_ AND may THEN n429 + lim ELSE base END, CASE WHEN full_ AND may THEN ok ELSE last_ok END,
          CASE WHEN reason IS NOT NULL THEN reason WHEN err = 1 AND streak + 1 >= 3 THEN 'error: 3 consecutive transport errors' WHEN full_ AND cool > 0 AND ok = last_ok THEN 'blocked: ' || (n429 + lim) || ' x HTTP 429, no success since the last cooldown'
            WHEN full_ AND cool >= 2 THEN 'blocked: ' || (n429 + lim) || ' x HTTP 429 after ' || cool || ' cooldowns' END, unsent + 1 - go
        FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1, LATERAL (SELECT (reason IS NULL)::INT AS go) a, LATERAL (SELECT go * (outcome = '429')::INT AS lim, go * (outcome = 'error')::INT AS err) b, LATERAL (SELECT lim = 1 AND n429 + 1 - base >= 3 AS full_, NOT (cool > 0 AND ok = last_ok) AND cool < 2 AS may) c)
      SELECT source, CAST(requests AS BIGINT) AS requests, CAST(ok AS BIGINT) AS ok, CAST(n429 AS BIGINT) AS blocked429, CAST(0 AS BIGINT) AS blocked403, CAST(gone AS BIGINT) AS gone, CAST(errors AS BIGINT) AS errors, CAST(cool AS BIGINT) AS cooldowns, reason IS NOT NULL AS stopped, reason, CAST(unsent AS BIGINT) AS unsent
      FROM r QUALIFY i = max(i) OVER (PARTITION BY source)""",
    "source_waits": """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS source, epoch_us(ts) // 1000 AS t, event_type = 'click' AND event_id % 5 = 0 AS limited, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
      w AS (SELECT max(epoch_us(ts) // 1000) - 3600000 AS mark FROM events),
      r AS (SELECT source, 0 AS i, CAST(0 AS BIGINT) AS until, NULL::VARCHAR AS what, CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS resumed FROM e GROUP BY 1
        UNION ALL SELECT r.source, e.i, CASE WHEN r.until > e.t THEN r.until WHEN limited THEN e.t + 43200000 ELSE 0 END, CASE WHEN r.until > e.t THEN 'held' WHEN limited THEN 'cooldown' END, e.t, CASE WHEN r.until > 0 AND r.until <= e.t THEN r.until END
        FROM r JOIN e ON e.source = r.source AND e.i = r.i + 1),
      l AS (SELECT source, max_by(until, i) AS until FROM r GROUP BY 1),
      g AS (SELECT source, t, lead(t) OVER (PARTITION BY source ORDER BY i) AS next FROM e),
      x AS (SELECT source, what AS kind, t AS at_ms FROM r WHERE what IS NOT NULL UNION ALL SELECT source, 'resumed', resumed FROM r WHERE resumed IS NOT NULL UNION ALL SELECT source, 'resumed', until FROM l, w WHERE until > 0 AND until < mark
        UNION ALL SELECT source, 'silent', t FROM g, w WHERE coalesce(next - t >= 86400000, t + 86400000 < mark))
      SELECT source, kind, count(*) AS n, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM x GROUP BY 1, 2""",
    "late_postings": """WITH e AS (SELECT user_id || '/' || event_type AS key, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS turn FROM events),
      b AS (SELECT *, CASE turn WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS batch FROM e WHERE turn <= 3),
      w AS (SELECT n AS batch, (SELECT max(t) // 1000 * 1000 - 172800000000 FROM b WHERE batch < n) AS mark FROM (VALUES (1), (2), (3)) v(n)),
      p AS (SELECT key, event_id, t, batch, mark FROM b JOIN w USING (batch) WHERE mark IS NULL OR t > mark),
      one AS (SELECT *, true AS kept FROM p WHERE batch = 1),
      two AS (SELECT p.*, one.key IS NULL AS kept FROM p LEFT JOIN one USING (key) WHERE p.batch = 2),
      held AS (SELECT key, max(t) + 172800000000 AS until FROM (SELECT key, t FROM one UNION ALL SELECT key, t FROM two WHERE kept) GROUP BY 1),
      three AS (SELECT p.*, held.key IS NULL OR held.until <= (SELECT mark FROM w WHERE batch = 2) AS kept FROM p LEFT JOIN held USING (key) WHERE p.batch = 3)
      SELECT key, event_id FROM one UNION ALL SELECT key, event_id FROM two WHERE kept UNION ALL SELECT key, event_id FROM three WHERE kept""",
    "artifact_hashes": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
}

QUERIES = [
    discover_outcomes, conservation, run_report, source_health, error_streaks, limiter_schedule, heartbeat_gap, last_success, recency_filter, checkpoint_dedup, unread_postings, run_summary, artifact_hashes, fsm_stop, source_waits, late_postings,
]

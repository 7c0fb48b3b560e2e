"""The guarded fetch as a state machine over each source's responses, in batch and in streaming.

Rules, per source and in order of ``seq``: a success resets the run of transport
errors; a missing page changes nothing; MAX_ERRORS errors in a row stop the source; a
refusal (403) stops it at once; MAX_429 rate limits stop it, or start a cooldown while
cooldowns are left and something has succeeded since the last. Nothing is sent once a
source has stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import ship, stored

MAX_429, MAX_ERRORS = 5, 8
FIELDS = ("requests", "ok", "blocked429", "blocked403", "gone", "errors", "cooldowns", "errors_in_row", "base429", "ok_at_last")
SCHEMA = "source string, requests long, ok long, blocked429 long, blocked403 long, gone long, errors long, cooldowns long, stopped boolean, reason string, unsent long"
STATE = ", ".join(f"{f} long" for f in FIELDS) + ", stopped boolean, reason string, unsent long"
LATE_AT_ONCE = {"spark.sql.streaming.statefulOperator.allowMultiple": "false"}


@dataclass
class Guard:
    max_429: int = MAX_429
    max_errors: int = MAX_ERRORS
    max_cooldowns: int | None = None
    requests: int = 0
    ok: int = 0
    blocked429: int = 0
    blocked403: int = 0
    gone: int = 0
    errors: int = 0
    cooldowns: int = 0
    errors_in_row: int = 0
    base429: int = 0
    ok_at_last: int = 0
    stopped: bool = False
    reason: str | None = None
    unsent: int = 0
    log: list = field(default_factory=list)

    def stop(self, reason: str) -> None:
        if not self.stopped:  # the first reason stays
            self.stopped, self.reason = True, reason

    def see(self, outcome: str) -> None:
        if self.stopped:
            self.unsent += 1
            return
        self.requests += 1
        if outcome == "ok":
            self.ok += 1
            self.errors_in_row = 0
        elif outcome == "gone":
            self.gone += 1
        elif outcome == "error":
            self.errors += 1
            self.errors_in_row += 1
            if self.errors_in_row >= self.max_errors:
                self.stop(f"error: {self.max_errors} consecutive transport errors")
        elif outcome == "403":
            self.blocked403 += 1
            self.stop("blocked: HTTP 403")
        elif outcome == "429":
            self.blocked429 += 1
            if self.blocked429 - self.base429 >= self.max_429:
                if self.max_cooldowns is None:
                    self.stop(f"blocked: {self.blocked429} x HTTP 429")
                elif self.cooldowns and self.ok == self.ok_at_last:
                    self.stop(f"blocked: {self.blocked429} x HTTP 429, no success since the last cooldown")
                elif self.cooldowns >= self.max_cooldowns:
                    self.stop(f"blocked: {self.blocked429} x HTTP 429 after {self.cooldowns} cooldowns")
                else:
                    self.cooldowns += 1
                    self.base429, self.ok_at_last = self.blocked429, self.ok

    def row(self, source: str) -> dict[str, Any]:
        names = [c.strip().split()[0] for c in SCHEMA.split(",")][1:]
        state = asdict(self)
        return {"source": source, **{n: state[n] for n in names}}


def _chunks(responses: DataFrame) -> DataFrame:
    """source, seq, outcome and chunk: ranges of (source, seq), so that a source of any size is spread over many.

    Written, as what is found about a chunk is joined with its rows: ranges drawn twice might differ.
    """
    rows = responses.select("source", F.col("seq").cast("long").alias("seq"), "outcome").repartitionByRange("source", "seq")
    return stored(rows.withColumn("chunk", F.spark_partition_id()), "responses")


KINDS = {"ok": "ok", "429": "blocked429", "403": "blocked403", "gone": "gone", "error": "errors"}


def _running(rows: DataFrame) -> DataFrame:
    """rows with what the source had got up to each, counts and the errors since its last success.

    The machine needs no walk through a source: all of its rules speak of counts up to a
    response. Counts within a chunk and sums of whole chunks before it give them.
    """
    is_ = lambda k: (F.col("outcome") == k).cast("long")
    here = Window.partitionBy("source", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counts = {"requests": F.lit(1), **{n: is_(k) for k, n in KINDS.items()}}
    local = rows.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"l_{n}") for n, c in counts.items()])
    local = local.withColumn("l_row", F.col("l_errors") - F.coalesce(F.max(F.when(F.col("outcome") == "ok", F.col("l_errors"))).over(here), F.lit(0)))

    sums = local.groupBy("source", "chunk").agg(*[F.max(f"l_{n}").alias(f"s_{n}") for n in counts], F.max_by("l_row", "seq").alias("tail"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    # errors up to the last success of a chunk; the greatest so far is that of the last success
    sums = sums.withColumn("upto", F.when(F.col("s_ok") > 0, F.sum("s_errors").over(through) - F.col("tail")))
    before = sums.select(F.col("source").alias("b_source"), F.col("chunk").alias("b_chunk"), *[F.coalesce(F.sum(f"s_{n}").over(earlier), F.lit(0)).alias(f"b_{n}") for n in counts], F.coalesce(F.max("upto").over(earlier), F.lit(0)).alias("b_upto"))
    out = local.join(before, (F.col("chunk") == F.col("b_chunk")) & F.col("source").eqNullSafe(F.col("b_source")))
    streak = F.col("l_row") + F.when(F.col("l_ok") == 0, F.col("b_errors") - F.col("b_upto")).otherwise(0)
    return out.select("source", "seq", "outcome", streak.alias("errors_in_row"), *[(F.col(f"l_{n}") + F.col(f"b_{n}")).alias(n) for n in counts])


def _ends(running: DataFrame, max_429: int = MAX_429, max_errors: int = MAX_ERRORS, max_cooldowns: int | None = None) -> DataFrame:
    """source, total, at (counts at the end: at its stop, or of all), seq (of the stop, or null), reason, cooldowns.

    A source stops at the first of: a refusal, the error that makes a row of max_errors, and
    the rate limit number j * max_429 at which no cooldown is left or due. Of the latter the
    first max_cooldowns + 1 decide, so a source's list of them is short.
    """
    counts = ["requests", *KINDS.values()]
    row = F.struct("seq", *counts)
    turns = 1 if max_cooldowns is None else max_cooldowns + 1
    full = (F.col("outcome") == "429") & (F.col("blocked429") % max_429 == 0) & (F.col("blocked429") <= turns * max_429)
    found = running.groupBy("source").agg(
        F.max(F.struct("requests", *counts[1:])).alias("all"),
        F.min(F.when(F.col("outcome") == "403", row)).alias("refused"),
        F.min(F.when((F.col("outcome") == "error") & (F.col("errors_in_row") >= max_errors), row)).alias("broken"),
        F.array_sort(F.collect_list(F.when(full, row))).alias("full"),
    )
    n = lambda x: x["blocked429"].cast("string")
    said = F.concat(F.lit("blocked: "), n(F.col("limited")), F.lit(" x HTTP 429"))
    if max_cooldowns is None:
        found = found.withColumn("limited", F.get("full", 0))
    else:
        idle = lambda x, i: (i > 0) & (x["ok"] == F.get("full", i - 1)["ok"])
        ends = F.filter("full", lambda x, i: (i >= max_cooldowns) | F.coalesce(idle(x, i), F.lit(False)))
        found = found.withColumn("limited", F.get(ends, 0))
        place = F.array_position(F.transform("full", lambda x: x["seq"]), F.col("limited")["seq"])
        last = F.get("full", (place - 2).cast("int"))
        said = F.concat(said, F.when((place > 1) & (last["ok"] == F.col("limited")["ok"]), ", no success since the last cooldown").otherwise(F.concat(F.lit(" after "), (place - 1).cast("string"), F.lit(" cooldowns"))))
    first = F.array_min(F.filter(F.array("refused", "broken", "limited"), lambda x: x.isNotNull()))
    found = found.withColumn("stop", first).withColumn("seq", F.col("stop.seq"))
    at = F.coalesce(F.struct(*[F.col(f"stop.{c}").alias(c) for c in counts]), F.col("all"))
    at = F.when(F.col("stop").isNull(), F.col("all")).otherwise(at)
    reason = F.when(F.col("seq") == F.col("refused.seq"), "blocked: HTTP 403").when(F.col("seq") == F.col("broken.seq"), f"error: {max_errors} consecutive transport errors").when(F.col("seq") == F.col("limited.seq"), said)
    # every full count but the one that stops it starts a cooldown
    cooldowns = F.lit(0) if max_cooldowns is None else F.size(F.filter("full", lambda x: F.col("seq").isNull() | (x["seq"] < F.col("seq"))))
    return found.select("source", F.col("all.requests").alias("total"), at.alias("at"), "seq", reason.alias("reason"), cooldowns.cast("long").alias("cooldowns"))


def health(responses: DataFrame, **limits: Any) -> DataFrame:
    """responses(source, seq, outcome) -> the state of each source at the end; seq is unique within a source.

    Columns and shuffles only: the responses of one source are counted in many tasks, and
    a row a chunk meets at the source. Limits are those of Guard.
    """
    ends = _ends(_running(_chunks(responses)), **limits)
    n = lambda c: F.col(f"at.{c}").alias(c)
    unsent = (F.col("total") - F.col("at.requests")).alias("unsent")
    return ends.select("source", *map(n, ["requests", *KINDS.values()]), "cooldowns", F.col("seq").isNotNull().alias("stopped"), "reason", unsent)


def drained(responses: DataFrame, **limits: Any) -> DataFrame:
    """source, seq, outcome and sent of every response: false for what its source's stop left unsent, which goes on to the end."""
    rows = _chunks(responses)
    stops = stored(_ends(_running(rows), **limits).filter("seq is not null").select(F.col("source").alias("s_source"), F.col("seq").alias("s_seq")), "stops")
    out = rows.join(stops, F.col("source").eqNullSafe(F.col("s_source")), "left")
    return out.select("source", "seq", "outcome", (F.col("s_seq").isNull() | (F.col("seq") <= F.col("s_seq"))).alias("sent"))


class GuardProcessor(StatefulProcessor):
    """The same machine over a stream: a row of the source's state after each micro-batch."""

    def __init__(self, ttl_ms: int | None = None, **limits: Any):
        self.ttl_ms, self.limits = ttl_ms, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("guard", STATE, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        guard = Guard(**self.limits)
        if self.state.exists():
            for name, value in zip([*FIELDS, "stopped", "reason", "unsent"], self.state.get(), strict=True):
                setattr(guard, name, value)
        for outcome in pd.concat([r[["seq", "outcome"]] for r in rows]).sort_values("seq")["outcome"]:
            guard.see(outcome)
        self.state.update(tuple(getattr(guard, n) for n in [*FIELDS, "stopped", "reason", "unsent"]))
        yield pd.DataFrame([guard.row(key[0])])

    def close(self) -> None:
        pass


def health_stream(responses: DataFrame, ttl_ms: int | None = None, **limits: Any) -> DataFrame:
    """A streaming DataFrame of states; needs the RocksDB state store. A source unheard of for ttl_ms is forgotten, and begins anew."""
    ship(responses.sparkSession)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return responses.groupBy("source").transformWithStateInPandas(GuardProcessor(ttl_ms, **limits), outputStructType=SCHEMA, outputMode="Update", timeMode=mode)


@dataclass
class Watch:
    """One source's waits and silences, by the times (ms) of its responses alone.

    A rate limit holds the source until ``wait`` has passed: what is due meanwhile is held,
    and at its end the source resumes. No response for ``silence`` is reported once, with
    the time of the last one.
    """

    wait: int
    silence: int
    until: int = 0
    last: int = -1
    told: bool = False

    def pass_to(self, now: int) -> Iterator[tuple[str, int]]:
        """What has come about by ``now``, whether or not anything arrives."""
        if self.last >= 0 and not self.told and now >= self.last + self.silence:
            self.told = True
            yield "silent", self.last
        if self.until and now >= self.until:
            yield "resumed", self.until
            self.until = 0

    def see(self, now: int, outcome: str) -> Iterator[tuple[str, int]]:
        yield from self.pass_to(now)
        self.last, self.told = now, False
        if self.until:
            yield "held", now
        elif outcome == "429":
            self.until = now + self.wait
            yield "cooldown", now

    def due(self) -> list[int]:
        """When something comes about if nothing arrives."""
        return [t for t in (self.until, 0 if self.told or self.last < 0 else self.last + self.silence) if t]


class WatchProcessor(StatefulProcessor):
    """A Watch for each source of a stream: timers in event time say what comes about without a response."""

    def __init__(self, wait: int, silence: int):
        self.limits = wait, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "until long, last long, told boolean")

    def _watch(self) -> Watch:
        return Watch(*self.limits, *(self.state.get() if self.state.exists() else ()))

    def _keep(self, watch: Watch, key: tuple, found: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        due = set(watch.due())
        for t in list(self.handle.listTimers()):
            if t not in due:
                self.handle.deleteTimer(t)
        for t in due:
            self.handle.registerTimer(t)
        self.state.update((watch.until, watch.last, watch.told))
        if found:
            yield pd.DataFrame([(key[0], kind, at) for kind, at in found], columns=["source", "kind", "at_ms"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watch = self._watch()
        new = pd.concat([r[["seq", "outcome", "at_ms"]] for r in rows]).sort_values(["at_ms", "seq"])
        found = [x for t, o in zip(new["at_ms"].tolist(), new["outcome"], strict=True) for x in watch.see(t, o)]
        yield from self._keep(watch, key, found)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watch = self._watch()
        found = list(watch.pass_to(expiredTimerInfo.getExpiryTimeInMs()))
        yield from self._keep(watch, key, found)

    def close(self) -> None:
        pass


def watched(responses: DataFrame, wait_ms: int, silence_ms: int, late: str = "1 hour") -> DataFrame:
    """A stream of responses(source, seq, outcome, ts) -> source, kind (cooldown, held, resumed, silent), at_ms.

    What comes about without a response is told when the watermark, ``late`` behind the
    newest response of any source, has passed it. Needs the RocksDB state store.
    """
    ship(responses.sparkSession)
    timed = responses.select("source", F.col("seq").cast("long").alias("seq"), "outcome", F.unix_millis("ts").alias("at_ms"), "ts").withWatermark("ts", late)
    return timed.groupBy("source").transformWithStateInPandas(WatchProcessor(wait_ms, silence_ms), outputStructType="source string, kind string, at_ms long", outputMode="Append", timeMode="EventTime")


def first_seen_within(postings: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """A stream of postings without those whose key came before and is still remembered, and without those that come too late.

    A key is remembered until the watermark, ``late`` behind the newest posting of the batches
    before, is ``late`` past the posting that was let through; a posting not newer than the
    watermark is dropped. Spark by itself drops by the watermark of one batch earlier, so that
    late postings of a second batch pass: the session must have LATE_AT_ONCE.
    """
    for name, value in LATE_AT_ONCE.items():
        if postings.sparkSession.conf.get(name, None) != value:
            raise ValueError(f"{name} must be {value} in the session of the stream, or late postings pass")
    return postings.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def unread(postings: DataFrame, held: DataFrame, key: str = "sourceJobId") -> DataFrame:
    """Postings not yet held or known gone: what an interrupted read still has to fetch."""
    return postings.join(held.select(key).distinct(), key, "left_anti")

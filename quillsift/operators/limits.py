"""Rate limits, run tasks and event streams over logs.

Whether a limiter takes an event depends on which it took before, so limiters
fold over each key's events in order of time; a key's events are streamed
through the fold in batches and only the times inside the window are held.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.schemas import TERMINAL_EVENTS
from quillsift.session import frozen

REQUESTS = 20
SECONDS = 60.0


class SlidingWindow:
    """At most ``capacity`` tokens in any ``seconds``; refused requests don't count."""

    def __init__(self, capacity: int, seconds: float, held: Sequence[tuple[float, int]] = ()):
        self.capacity, self.seconds = capacity, seconds
        self.held = deque(held)
        self.used = sum(n for _, n in self.held)

    def _expire(self, now: float) -> None:
        while self.held and self.held[0][0] <= now - self.seconds:
            self.used -= self.held.popleft()[1]

    def take(self, now: float, tokens: int = 1) -> bool:
        self._expire(now)
        if self.used + tokens > self.capacity:
            return False
        self.held.append((now, tokens))
        self.used += tokens
        return True

    def wait(self, now: float, tokens: int = 1) -> float:
        """Seconds until enough has expired, 1 at least; 0 if there is room now, the whole window if there never is."""
        self._expire(now)
        needed = self.used + tokens - self.capacity
        if needed <= 0:
            return 0.0
        for at, n in self.held:
            needed -= n
            if needed <= 0:
                return max(at + self.seconds - now, 1.0)
        return self.seconds


def sliding_limit(events: DataFrame, key: str, time: str, tie: str, capacity: int = REQUESTS, seconds: float = SECONDS) -> DataFrame:
    """``events`` (key, time in seconds, tie) with ``accepted``.

    Keys are dealt out and sorted by Spark; each task walks its sorted rows
    with the state of one key, so a key with very many events is streamed, not
    gathered.
    """
    # Keys go to Python as text: pandas would make longs beside nulls doubles.
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("double").alias("at"), F.col(tie).alias("tie"))
    kind = events.schema[key].dataType.simpleString(), events.schema[tie].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), SlidingWindow(capacity, seconds)
        for batch in batches:
            taken = []
            for k, at in zip(batch["key"], batch["at"], strict=True):
                if k != current:
                    current, state = k, SlidingWindow(capacity, seconds)
                taken.append(state.take(at))
            yield batch.assign(accepted=taken)

    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "tie")
    out = ordered.mapInPandas(walk, f"key string, at double, tie {kind[1]}, accepted boolean")
    return out.select(F.col("key").cast(kind[0]).alias(key), F.col("at").alias(time), F.col("tie").alias(tie), "accepted")


def reserve(requests: DataFrame, tpm: int = 100_000, rpm: int = 60, rpd: int = 10_000) -> DataFrame:
    """``requests`` (provider, model, api_key, at, tie, tokens) with ``accepted, wait``: three sliding budgets per key.

    Budgets are asked in turn, so one that has taken stays charged if a later
    one refuses.  ``wait`` is the longest wait of the three after a refusal.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        for batch in batches:
            out = []
            for k, at, tokens in zip(batch["key"], batch["at"], batch["tokens"], strict=True):
                if k != current:
                    current, state = k, [SlidingWindow(tpm, 60.0), SlidingWindow(rpm, 60.0), SlidingWindow(rpd, 86_400.0)]
                sizes = (int(tokens), 1, 1)
                ok = all(s.take(at, n) for s, n in zip(state, sizes, strict=True))
                out.append((ok, 0.0 if ok else max(s.wait(at, n) for s, n in zip(state, sizes, strict=True))))
            yield batch.assign(accepted=[x[0] for x in out], wait=[x[1] for x in out])

    rows = requests.select(F.concat_ws("\u001e", "provider", "model", "api_key").alias("key"), F.col("at").cast("double").alias("at"), F.col("tie").cast("long").alias("tie"), F.col("tokens").cast("long").alias("tokens"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "tie").mapInPandas(walk, "key string, at double, tie long, tokens long, accepted boolean, wait double")


def first_free_key(waits: DataFrame) -> DataFrame:
    """``request_id, api_key``: of each request's keys (position, wait), the first without a wait; null if there is none."""
    free = F.min(F.when(F.col("wait") == 0, F.struct("position", "api_key")))
    return waits.groupBy("request_id").agg(free["api_key"].alias("api_key"))


def until_terminal(events: DataFrame, run: str, order: Sequence[str], kind: str = "event") -> DataFrame:
    """The events of each run up to its first terminal one, which is found by an aggregation first."""
    ended = events.filter(F.col(kind).isin(*TERMINAL_EVENTS)).groupBy(F.col(run).alias("_run")).agg(F.min(F.struct(*order)).alias("_end"))
    both = events.join(ended, F.col(run) == F.col("_run"), "left")
    return both.filter(F.col("_end").isNull() | (F.struct(*order) <= F.col("_end"))).drop("_run", "_end")


def heartbeats(events: DataFrame, run: str, time: str, tie: str, idle: float = 15.0) -> DataFrame:
    """``events`` with ``beats``: heartbeats that an idle stream sends between an event and the next."""
    nxt = F.lead(time).over(Window.partitionBy(run).orderBy(time, tie))
    return events.withColumn("beats", F.coalesce(F.greatest(F.lit(0), F.ceil((nxt - F.col(time)) / idle) - 1), F.lit(0)).cast("long"))


def due(tasks: DataFrame, now: Column) -> DataFrame:
    """Pending tasks whose time has come."""
    return tasks.filter((F.col("status") == "pending") & (F.col("not_before").isNull() | (F.col("not_before") <= now)))


def claim(tasks: DataFrame, now: Column, most: int = 200) -> DataFrame:
    """The due tasks with the smallest ids, claimed: one attempt more."""
    return due(tasks, now).orderBy("id").limit(most).withColumns({"status": F.lit("claimed"), "attempt": F.col("attempt") + 1, "claimed_at": now, "heartbeat_at": now})


def current_state(log: DataFrame) -> DataFrame:
    """The state of each task from its log of transitions (task_id, seq, status, at), the latest winning."""
    last = F.max(F.struct("seq", "status", "at"))
    tries = F.count_if(F.col("status") == "claimed")
    return log.groupBy("task_id").agg(last.alias("_l"), tries.alias("attempts")).select("task_id", F.col("_l.status").alias("status"), F.col("_l.at").alias("at"), "attempts")


def stale(tasks: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Claimed tasks without a heartbeat for so long, pending again."""
    old = tasks.filter((F.col("status") == "claimed") & (F.col("heartbeat_at") < now - F.make_interval(secs=F.lit(seconds))))
    return old.withColumn("status", F.lit("pending"))


def stage_outcomes(results: DataFrame, core: Sequence[str]) -> DataFrame:
    """``run_id, completed, failed, status``: a failed core stage fails the run, others don't."""
    core_failed = F.max(((F.col("status") == "failed") & F.col("stage").isin(*core)).cast("int"))
    out = results.groupBy("run_id").agg(F.count_if(F.col("status") == "ok").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), core_failed.alias("_c"))
    return out.withColumn("status", F.when(F.col("_c") == 1, "failed").otherwise("complete")).drop("_c")


def enqueue(payloads: DataFrame, first_id: int = 1) -> DataFrame:
    """Pending task rows for ``payloads`` (run_id, stage, agent_name, tenant_id, ordinal, payload), numbered by run, stage and ordinal.

    Numbers come from the rows before in their partition and in the partitions
    before, so no task numbers all rows; the driver sees a count per partition.
    The ordered rows are frozen: bounds of ranges are drawn anew, and ranges
    merged anew, whenever the shuffle runs again.  Jobs run here.
    """
    ordered = frozen(payloads.repartitionByRange("run_id", "stage", "ordinal").sortWithinPartitions("run_id", "stage", "ordinal").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}
    before, total = {}, first_id
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    start = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])[part] if before else F.lit(first_id).cast("long")
    fresh = {"attempt": F.lit(0), "not_before": F.lit(None).cast("timestamp"), "status": F.lit("pending")}
    return ordered.withColumn("id", start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at").withColumns(fresh)


def finish(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``tasks`` with the ``outcomes`` (id, result, error) of some: done, or failed where there is an error.  Others stay as they are."""
    given = outcomes.select("id", F.col("result").alias("_result"), F.col("error").alias("_error"), F.lit(True).alias("_given"))
    both = tasks.join(given, "id", "left")
    status = F.when(F.col("_given").isNull(), F.col("status")).when(F.col("_error").isNotNull(), "failed").otherwise("done")
    return both.withColumns({"status": status, "result": F.col("_result"), "error": F.col("_error")}).drop("_result", "_error", "_given")


def beat(checkpoints: DataFrame, beats: DataFrame) -> DataFrame:
    """``checkpoints`` (run_id, last_stage, heartbeat_at) with those that ``beats`` (run_id, stage, at) updates or adds, the latest of each run."""
    new = beats.select("run_id", F.col("stage").alias("last_stage"), F.col("at").alias("heartbeat_at"))
    latest = F.max(F.struct("heartbeat_at", "last_stage"))
    return checkpoints.unionByName(new).groupBy("run_id").agg(latest.alias("_l")).select("run_id", F.col("_l.last_stage").alias("last_stage"), F.col("_l.heartbeat_at").alias("heartbeat_at"))


def stale_runs(checkpoints: DataFrame, now: Column, seconds: int = 120) -> DataFrame:
    """Runs without a heartbeat for so long: their work has to be drained again."""
    return checkpoints.filter(F.col("heartbeat_at") < now - F.make_interval(secs=F.lit(seconds))).select("run_id")


def drain(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], now: Column, rounds: int, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Outcomes of ``rounds`` claims of ``most`` tasks each, and the tasks that are left: a budget of work, in one plan.

    ``work`` gives (id, result, error) for claimed tasks.
    """
    left, done = tasks, []
    for _ in range(rounds):
        taken = claim(left, now, most)
        done.append(work(taken))
        left = left.join(taken.select("id"), "id", "left_anti")
    return reduce(DataFrame.unionByName, done), left


def cancel_siblings(results: DataFrame, core: Sequence[str], width: int = 16) -> DataFrame:
    """``results`` (run_id, stage, ordinal, status) of stages run ``width`` at a time: after a failure in a core stage, the waves to come are cancelled."""
    wave = F.floor(F.col("ordinal") / width)
    failed = results.filter((F.col("status") == "failed") & F.col("stage").isin(*core)).groupBy("run_id", "stage").agg(F.min(wave).alias("_wave"))
    both = results.join(failed, ["run_id", "stage"], "left")
    return both.withColumn("status", F.when(wave > F.col("_wave"), "cancelled").otherwise(F.col("status"))).drop("_wave")


def within_capacity(events: DataFrame, run: str, order: Sequence[str], read_at: str, capacity: int = 1000) -> DataFrame:
    """``events`` with ``dropped``: an event that finds ``capacity`` unread ones of its run before it.

    ``order[0]`` is when an event is put in, ``read_at`` when the reader takes
    it out (null: never).  Those put in before and not yet read are those put
    in less those read, both counted by one merge of the two times.
    """
    put = events.select("*", F.col(order[0]).alias("_t"), F.lit(1).alias("_in"))
    taken = events.filter(F.col(read_at).isNotNull()).select("*", F.col(read_at).alias("_t"), F.lit(-1).alias("_in"))
    before = Window.partitionBy(run).orderBy("_t", "_in", *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    merged = put.unionByName(taken).withColumn("dropped", F.coalesce(F.sum("_in").over(before), F.lit(0)) >= capacity)
    return merged.filter("_in = 1").drop("_t", "_in")

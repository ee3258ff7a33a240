"""What a running service reports: metrics by table, health, alerts, and the errors it ends with."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from enum import IntEnum
from threading import Event

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changeloom.functions import lsn
from changeloom.operators import common, ledger

TABLE = ["epoch", "source_schema", "source_table"]


class Exit(IntEnum):
    """Exit statuses; fixed values of the service's contract."""

    SUCCESS = 0
    CONFIG = 10
    CONTROL = 11
    STORE = 12
    PREFLIGHT = 13
    KEYLESS_TABLE = 14
    LEASE = 15
    SOURCE = 16
    QUARANTINE = 17
    INTERNAL = 70


class ServiceError(RuntimeError):
    """An error with its exit status; ``retry`` tells whether the same step may succeed later."""

    def __init__(self, message: str, status: Exit = Exit.INTERNAL, retry: bool = False):
        super().__init__(message)
        self.status, self.retry = status, retry


def exit_status(error: BaseException | None) -> Exit:
    """Status of any error: its own, or that of what it was raised from, or by its kind."""
    import sqlite3

    from changeloom.sources.control import StaleToken
    from changeloom.streaming.loader import Quarantined

    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        if isinstance(error, ServiceError):
            return error.status
        for kind, status in ((Quarantined, Exit.QUARANTINE), (StaleToken, Exit.LEASE), (sqlite3.Error, Exit.CONTROL), (ConnectionError, Exit.SOURCE), (OSError, Exit.STORE)):
            if isinstance(error, kind):
                return status
        if error.__cause__ is None:
            return Exit.INTERNAL
        error = error.__cause__
    return Exit.SUCCESS


def loader_metrics(manifest: DataFrame, checkpoints: DataFrame, log: DataFrame, ddl: DataFrame | None = None) -> DataFrame:
    """(table, metric, value) of every source table of the manifest.

    files_ready and files_failed count objects; append_lag_bytes and transform_lag_bytes are log bytes from the loader's positions to the last ready file,
    never negative; raw_rows counts rows of the log. With ``ddl`` (table, done) also ddl_pending.
    """
    files = common.objects_of(manifest)
    ready = F.col("ready")
    per = files.groupBy(*TABLE).agg(F.count_if(ready).alias("files_ready"), F.count_if(~ready).alias("files_failed"), F.max(F.when(ready, F.col("lsn_end"))).alias("top"))
    runs = ledger.last_committed(checkpoints)
    rows = common.read_changes(log).groupBy(*TABLE).agg(F.count(F.lit(1)).alias("raw_rows"))
    a, b, c = per.alias("a"), runs.alias("b"), rows.alias("c")
    j = a.join(b, common.same(TABLE), "left").join(c, common.same(TABLE, "a", "c"), "left")
    lag = lambda p: F.coalesce(lsn.lag("a.top", F.coalesce(p, F.lit(lsn.ZERO))).cast("bigint"), F.lit(0))
    values = {
        "files_ready": F.col("a.files_ready"), "files_failed": F.col("a.files_failed"), "append_lag_bytes": lag("b.raw_appended_lsn"),
        "transform_lag_bytes": lag("b.transformed_lsn"), "raw_rows": F.coalesce("c.raw_rows", F.lit(0)),
    }
    if ddl is not None:
        waiting = ddl.where("NOT done").groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n")).alias("d")
        j = j.join(waiting, common.same(TABLE, "a", "d"), "left")
        values["ddl_pending"] = F.coalesce("d.n", F.lit(0))
    each = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("bigint").alias("value")) for k, v in values.items()])
    return j.select(*[F.col(f"a.{k}") for k in TABLE], F.inline(each))


def exposition(metrics: DataFrame, prefix: str = "changeloom") -> DataFrame:
    """(line): the metrics in the text format that scrapers read."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"\\", r"\\\\\\\\"), '"', r'\\\\"')
    label = F.concat(F.lit('{epoch="'), F.col("epoch").cast("string"), F.lit('",table="'), clean("source_schema"), F.lit("."), clean("source_table"), F.lit('"} '))
    return metrics.select(F.concat(F.lit(f"{prefix}_"), F.col("metric"), label, F.col("value").cast("string")).alias("line"))


@dataclass(frozen=True)
class Rule:
    """An alert: ``when`` (SQL over metric columns ``value`` and ``before``, the value one sample earlier) holds for ``seconds``."""

    name: str
    metric: str
    when: str
    seconds: int


RULES = [
    Rule("retained log is large", "retained_wal_bytes", "value > 1073741824", 600),
    Rule("stream position is at risk", "wal_status", "value >= 1", 60),
    Rule("heartbeat is stale", "heartbeat_age_seconds", "value > 60", 120),
    Rule("backlog does not drain", "files_ready", "value > 0 AND value >= coalesce(before, value)", 900),
    Rule("reload lease is stale", "reload_lease_stale", "value > 0", 300),
    Rule("reload gave up", "reload_gave_up", "value > coalesce(before, 0)", 0),
    Rule("signal written after its commit", "reload_crosscheck", "value > coalesce(before, 0)", 0),
]


def alerts(samples: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(rule, subject, since, at): samples at which a rule has held for its time without a break.

    ``samples``: metric, subject, at, value. A rule without a time holds at once.
    """
    out = None
    per = Window.partitionBy("subject").orderBy("at")
    for r in rules:
        s = samples.where((F.col("metric") == r.metric) & F.col("at").isNotNull()).withColumn("before", F.lag("value").over(per))
        s = s.withColumn("hit", F.coalesce(F.expr(r.when), F.lit(False)))
        since = F.max(F.when(~F.col("hit"), F.col("at"))).over(per)  # the last sample that did not hit
        s = s.withColumn("last_ok", since).where("hit")
        begun = F.min("at").over(Window.partitionBy("subject", "last_ok"))
        s = s.withColumn("since", begun).where(F.col("at") >= F.col("since") + F.make_dt_interval(secs=F.lit(r.seconds)))
        one = s.select(F.lit(r.name).alias("rule"), "subject", "since", "at")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class Health:
    """Probes of a loader: started once its stores answered, live while it polls, ready unless a table is in quarantine or it drains."""

    started: bool = False
    polled: datetime | None = None
    quarantined: set[str] = field(default_factory=set)
    draining: bool = False

    def is_live(self) -> bool:
        """Progress, not lag: a loader that catches up is alive."""
        return self.polled is not None

    def is_ready(self) -> bool:
        return self.started and self.is_live() and not self.quarantined and not self.draining

    def probes(self) -> dict[str, int]:
        return {k: 200 if ok else 503 for k, ok in (("startup", self.started), ("ready", self.is_ready()), ("healthz", self.is_live()))}


def run_until_drained(step, stop: Event, health: Health, idle_seconds: float = 1.0, every: int = 0, upkeep=None) -> int:
    """The apply loop: ``step`` returns whether it did anything. After ``stop`` the step at work ends and what it had begun is committed;
    nothing new is begun. ``upkeep`` runs after every so many steps. Returns the number of steps."""
    n = 0
    health.started = True
    while not stop.is_set():
        busy = step()
        n += 1
        health.polled = datetime.now()
        if every and upkeep is not None and n % every == 0:
            upkeep()
        if not busy:
            stop.wait(idle_seconds)
    health.draining = True
    return n


def drain(query: StreamingQuery) -> dict | None:
    """Lets a stream finish what it has read and stops it; the progress of its last batch."""
    query.processAllAvailable()
    query.stop()
    return query.lastProgress

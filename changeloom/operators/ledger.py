"""Work-item ledger: process only what is new or changed, skipping and repeating nothing when runs fail.

The ledger is a set of events about items: ``pending`` (token 0), ``leased`` (token n, until a time) and ``done`` (token n).
An item's state is that of its event with the highest fencing token; a done event beats the lease of the same token. A
lease whose time is over counts as pending again. Each lease of an item has a higher token than the one before, so a done
event of a writer that lost its lease has a lower token than the current lease and is rejected when events are folded.

A stored ledger is a log of numbered commits. Each names a folder of events; its number is made exclusively, so of two writers that saw the
same state one wins and the other looks again. A lease's token is the number of its commit: no two leases ever share one, even
if a slow writer's commit is overlooked. What an attempt of a worker does has a name, under which it is found again, so a retry is
absorbed. A crash between two steps leaves items pending or leased, never lost. State is one aggregation over
events, so nothing is collected; from time to time a commit sums up all before it, so reading stays short.

Nulls: an item with a null id is an item; a lease without a time never expires. Repeated events change nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import lsn
from changeloom.operators import common

PENDING, LEASED, DONE = "pending", "leased", "done"
EVENT = "item string, token bigint, state string, lease_until timestamp, worker string"
PHASES = ("append", "transform")


def fold(events: DataFrame, now, keys: tuple[str, ...] = ("item",)) -> DataFrame:
    """(keys, token, state, lease_until, worker) of each item at time ``now``; expired leases are pending."""
    rank = F.when(F.col("state") == DONE, 2).when(F.col("state") == LEASED, 1).otherwise(0)
    last = F.max(F.struct("token", rank.alias("r"), "state", "lease_until", "worker")).alias("s")
    s = events.groupBy(*keys).agg(last).select(*keys, "s.token", "s.state", "s.lease_until", "s.worker")
    expired = (F.col("state") == LEASED) & (F.col("lease_until") <= F.lit(now).cast("timestamp"))
    return s.withColumn("state", F.when(expired, PENDING).otherwise(F.col("state")))


class WorkLedger:
    """A stored ledger; any number of controllers lease and any number of workers complete, at once.

    ``compact_after`` commits are summed up by the next one. A retry is recognised among the ``remembered`` latest names. Exclusive
    creation must be atomic in the file system, as it is in HDFS and local ones; an object store needs conditional writes.
    """

    def __init__(self, spark: SparkSession, root: str, compact_after: int = 24, remembered: int = 16):
        self.spark, self.root, self.compact_after, self.remembered = spark, root.rstrip("/"), compact_after, remembered
        self._folder = common.Pointer(spark, self.root)

    def commits(self) -> dict[int, dict]:
        """Commits since the last summary, by number; one that was never filled has no events."""
        out: dict[int, dict] = {}
        for name in reversed(self._folder.names("commit-")):
            stream = self._folder.fs.open(self._folder.path(name))
            try:
                out[int(name.removeprefix("commit-"))] = entry = json.loads(stream.readUTF()) if stream.available() else {}
            finally:
                stream.close()
            if "names" in entry:
                break
        return dict(sorted(out.items()))

    def _done(self, commits: dict[int, dict], name: str) -> str | None:
        """Folder of an attempt that was committed before."""
        for c in reversed(commits.values()):
            if c.get("name") == name:
                return c["data"]
            if name in c.get("names", {}):
                return c["names"][name]
        return None

    def _events(self, commits: dict[int, dict]) -> DataFrame:
        paths = [f"{self.root}/{c['data']}" for c in commits.values() if c]
        return self.spark.read.schema(EVENT).parquet(*paths) if paths else self.spark.createDataFrame([], EVENT)

    def events(self) -> DataFrame:
        return self._events(self.commits())

    def state(self, now) -> DataFrame:
        return fold(self.events(), now)

    def _claim(self, number: int, entry: dict) -> bool:
        """Makes commit ``number``; False if another writer made it."""
        try:
            out = self._folder.fs.create(self._folder.path(f"commit-{number:012d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
                return False
            raise
        out.writeUTF(json.dumps(entry))
        out.close()
        return True

    def _commit(self, name: str, make) -> str:
        """Commits the events that ``make`` derives from the events before and from the new commit's number; returns their folder."""
        while True:
            commits = self.commits()
            if found := self._done(commits, name):
                return found
            number, data = max(commits, default=0) + 1, f"events-{uuid.uuid4().hex}"
            made = make(self._events(commits), number)
            made.selectExpr("item", "token", "state", "lease_until", "worker").write.parquet(f"{self.root}/{data}")
            if self._claim(number, {"name": name, "data": data}):
                if len(commits) >= self.compact_after:
                    self.compact()
                return data
            self._folder.fs.delete(self._folder.path(data), True)

    def compact(self) -> None:
        """One commit with the deciding event of every item in place of all before; if another writer comes first it is left for later."""
        commits = self.commits()
        number, data = max(commits, default=0) + 1, f"events-{uuid.uuid4().hex}"
        fold(self._events(commits), None).select("item", "token", "state", "lease_until", "worker").write.parquet(f"{self.root}/{data}")
        names: dict[str, str] = {}
        for c in commits.values():
            names |= c.get("names", {}) | ({c["name"]: c["data"]} if "name" in c else {})
        names = dict(list(names.items())[-self.remembered :])
        if not self._claim(number, {"data": data, "names": names}):
            self._folder.fs.delete(self._folder.path(data), True)

    def clean(self) -> None:
        """Deletes what no reader needs since the last summary. Not while others read: they may still hold older folders."""
        commits = self.commits()
        kept = {c["data"] for c in commits.values() if c} | {d for c in commits.values() for d in c.get("names", {}).values()}
        for name in self._folder.names("events-"):
            if name not in kept:
                self._folder.fs.delete(self._folder.path(name), True)
        for name in self._folder.names("commit-"):
            if int(name.removeprefix("commit-")) < min(commits, default=0):
                self._folder.fs.delete(self._folder.path(name), False)

    def enqueue(self, items: DataFrame, batch: str) -> None:
        """Adds the column ``item`` of ``items`` as pending; items that the ledger has are left as they are."""
        new = items.select(F.col("item").cast("string").alias("item")).distinct()
        self._commit(f"enqueue/{batch}", lambda before, number: _event(new, F.lit(0), PENDING))

    def lease(self, worker: str, attempt: str, now, seconds: int, limit: int | None = None, choose=None) -> DataFrame:
        """Leases pending items, smallest first, up to ``limit``, and returns them with their token. ``choose`` narrows the pending items down.

        A repeated call with the same worker and attempt returns what the first one leased and leases nothing more.
        """

        def make(before: DataFrame, number: int) -> DataFrame:
            due = fold(before, now).where(F.col("state") == PENDING).select("item")
            due = due if choose is None else choose(due)
            due = due if limit is None else due.orderBy("item").limit(limit)
            return _event(due, F.lit(number), LEASED, F.lit(now).cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds)), worker)

        data = self._commit(f"lease/{worker}-{attempt}", make)
        return self.spark.read.schema(EVENT).parquet(f"{self.root}/{data}").select("item", "token")

    def complete(self, worker: str, attempt: str, leased: DataFrame) -> DataFrame:
        """Marks items done under the tokens they were leased with; returns those whose token is stale, hence refused."""
        stale = self.spark.createDataFrame([], "item string, token bigint")

        def make(before: DataFrame, number: int) -> DataFrame:
            nonlocal stale
            top = before.groupBy("item").agg(F.max("token").alias("top"))
            a, b = leased.alias("a"), top.alias("b")
            known = a.join(b, common.same(["item"]))
            judged = common.checkpoint(known.select("a.item", "a.token", (F.col("a.token") < F.col("b.top")).alias("late")))
            stale = judged.where("late").select("item", "token")
            return _event(judged.where("not late"), F.col("token"), DONE, worker=worker)

        self._commit(f"done/{worker}-{attempt}", make)
        return stale

    def record(self, items: DataFrame, name: str) -> None:
        """Marks items done that were worked off outside the ledger, before any later lease."""
        done = items.select("item").distinct()
        self._commit(f"record/{name}", lambda before, number: _event(done, F.lit(number), DONE, worker=name))


def _event(items: DataFrame, token: Column, state: str, until: Column | None = None, worker: str | None = None) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    return items.select(
        "item", token.cast("bigint").alias("token"), F.lit(state).alias("state"), (none if until is None else until).alias("lease_until"),
        F.lit(worker).cast("string").alias("worker"),
    )


def last_committed(checkpoints: DataFrame) -> DataFrame:
    """The committed run with the latest updated_at of each source table; null positions are zero, null times earliest.

    Of equally late runs the one with the greater positions counts.
    """
    key = ["epoch", "source_schema", "source_table"]
    pos = lambda c: F.coalesce(lsn.normal(c), F.lit(lsn.ZERO)).alias(c)
    runs = checkpoints.where("outcome = 'committed'").select(*key, "updated_at", pos("raw_appended_lsn"), pos("transformed_lsn"))
    return runs.groupBy(*key).agg(F.max(F.struct("updated_at", "raw_appended_lsn", "transformed_lsn")).alias("r")).select(*key, "r.*")


def file_phases(manifest: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(item, done) of each ready file and phase: ``item`` is ``phase|file``, ``done`` whether the committed run of its source table covers it.

    A run has appended a file only if it could list it.
    """
    files = common.objects_of(manifest).where("ready").withColumn("lsn_end", F.coalesce("lsn_end", F.lit(lsn.ZERO)))
    runs = common.broadcast_if_small(last_committed(checkpoints))
    a, b = files.alias("a"), runs.alias("b")
    seen = a.join(b, common.same(["epoch", "source_schema", "source_table"]), "left")
    zero = F.lit(lsn.ZERO)
    listed = F.coalesce(F.col("a.created_at") <= F.col("b.updated_at"), F.col("b.updated_at").isNotNull() & F.col("a.created_at").isNull())
    done = {
        "append": (F.col("a.lsn_end") <= F.coalesce("b.raw_appended_lsn", zero)) & listed,
        "transform": F.col("a.lsn_end") <= F.coalesce("b.transformed_lsn", zero),
    }
    each = F.array(*[F.struct(F.concat_ws("|", F.lit(p), "file_id").alias("item"), done[p].alias("done")) for p in PHASES])
    return seen.select(F.inline(each))


def first_phase(items: DataFrame) -> DataFrame:
    """Of the pending phases of a file the one that comes first: nothing is transformed before it is appended."""
    parts = items.select("item", F.split_part("item", F.lit("|"), F.lit(2)).alias("file"))
    return parts.groupBy("file").agg(F.min("item").alias("item")).select("item")


def due_files(manifest: DataFrame, checkpoints: DataFrame, book: WorkLedger) -> DataFrame:
    """(file_id, phase): ready files with the phase that the next run leases in ``book``.

    Ready files are enqueued, committed runs recorded as done. A run then leases what is due and dies; its lease expires, the next run gets the
    same items under a new token, and should the first one come back its results are refused. Rows are what the next run holds.
    """
    items = common.checkpoint(file_phases(manifest, checkpoints))
    book.enqueue(items, "manifest")
    book.record(items.where("done"), "committed-runs")
    start, later = "2000-01-01 00:00:00", "2000-01-01 01:00:00"  # the ledger's own clock; leases of one run end before the next begins
    lost = book.lease("lost", "1", start, 60, choose=first_phase)
    held = book.lease("next", "1", later, 60, choose=first_phase)
    book.complete("lost", "1", lost)
    current = fold(book.events(), later).where(F.col("state") == LEASED).select("item", "token").join(held, ["item", "token"])
    return current.select(F.split_part("item", F.lit("|"), F.lit(2)).cast("bigint").alias("file_id"), F.split_part("item", F.lit("|"), F.lit(1)).alias("phase"))

"""The loader of one source table: staged files into the raw log, the raw log into the mirror.

Phase A claims queued files, appends them to the raw log and advances the raw watermark; phase B applies what was appended
since the mirror's version and advances the transformed watermark. Files of one schema version are appended together into a folder
that is named by the smallest file in it, so a repeat after a crash overwrites the same folder. The mirror's pointer names the
folders it holds: increments go by what was appended, not by position, so chunks that were stamped early are never missed.

Order of effects: data first, then the control store in one transaction. A crash in between repeats the step, which changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import envelope, lsn
from changeloom.operators import evolve, mirror
from changeloom.sources.control import ControlStore, StagedFile
from changeloom.streaming.plan import SchemaCache

RAW = ["op", "commit_lsn", "lsn", "unchanged", "sink_processed_at"]


class Quarantined(RuntimeError):
    """Rows that do not fit a narrowed type; they were written aside and the table stopped at its old version."""


def _renamer(old: str, new: str):
    return lambda n: F.when(n == old, new).otherwise(n)


class TableLoader:
    def __init__(self, spark: SparkSession, control: ControlStore, root: str, epoch: int, schema: str, table: str, keys: list[str], buckets: int = 8):
        self.spark, self.control, self.root, self.keys = spark, control, root.rstrip("/"), keys
        self.id = (epoch, schema, table)
        self.store = mirror.MirrorStore(spark, f"{self.root}/mirror", keys, buckets)
        self.schemas = SchemaCache()
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Phase A

    def append(self, limit: int = 32) -> str | None:
        """Appends the next queued files; returns the new raw watermark, or None if none waits."""
        files = self.control.claim_ready(*self.id, limit)
        if not files:
            return None
        files = files[: next((i for i, f in enumerate(files) if f.schema_version != files[0].schema_version), len(files))]
        if files[0].kind == "reload" and self._starts_reload(files[0]):
            self._wipe()
            self._fs.mkdirs(self._path(f"{self.root}/reload-{files[0].reload_id}"))  # after the wipe: a crash in between wipes again
            self.control.delete_superseded(*self.id, files[0].lsn_end)  # queued files that end before the export began
        files = [f for f in files if (f.kind == "reload") == (files[0].kind == "reload")]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._read(f) for f in files])
        folder = f"{self.root}/raw/{min(f.id for f in files):012d}-v{files[0].schema_version}"
        rows.write.mode("overwrite").parquet(folder)
        top = max(f.lsn_end for f in files)
        self.control.appended(*self.id, top, [f.id for f in files])
        return top

    def _read(self, f: StagedFile) -> DataFrame:
        schema = self.schemas.schema(f.schema_version, lambda: self.spark.read.parquet(f.uri).schema)  # files of one version are alike
        df = self.spark.read.schema(schema).parquet(f.uri)
        df = envelope.read(envelope.promote(df), "unchanged_toast").withColumnRenamed("m_unchanged_toast", "unchanged").drop("sink_meta")
        commit = F.lit(f.lsn_end) if f.kind == "spill" else lsn.normal("commit_lsn")
        return df.withColumns({"commit_lsn": commit, "lsn": lsn.normal("lsn"), "unchanged": F.coalesce("unchanged", F.array().cast("array<string>"))})

    def _starts_reload(self, f: StagedFile) -> bool:
        """Whether the file is the first of a reload that replaces the table; a resync only adds to it."""
        mode = self.control.db.execute("SELECT mode FROM reload WHERE id = ?", (f.reload_id,)).fetchone()
        cur = self.store.current()
        return mode is not None and mode[0] == "reload" and (cur or {}).get("reload", 0) < (f.reload_id or 0) and not self._reloaded(f.reload_id)

    def _reloaded(self, reload_id: int | None) -> bool:
        return self._fs.exists(self._path(f"{self.root}/reload-{reload_id}"))

    def _wipe(self) -> None:
        for name in ("raw", "mirror"):
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def appended(self) -> list[tuple[str, int]]:
        """(folder, schema version) of every append, in order."""
        raw = self._path(f"{self.root}/raw")
        if not self._fs.exists(raw):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(raw))
        return [(n, int(n.rpartition("-v")[2])) for n in names if self._fs.exists(self._path(f"{self.root}/raw/{n}/_SUCCESS"))]

    # Phase B

    def columns(self, version: int) -> list[evolve.Column]:
        known = self.control.version(*self.id, version)
        if known is None:
            raise LookupError(f"schema version {version} of {self.id} is not registered")
        return [evolve.Column(c["name"], c["type"], c["spark"], c["pos"]) for c in known[1]]

    def log(self, folders: list[tuple[str, int]], version: int) -> DataFrame:
        """Appended rows under the names and types of one version; columns it lacks are left out."""
        target = self.columns(version)
        parts = []
        for name, v in folders:
            df = self.spark.read.parquet(f"{self.root}/raw/{name}")
            if v != version:
                d = evolve.diff(self.columns(v), target)
                df = evolve.evolve_log(df, d)
                for old, new in d.renamed:  # names of unsent columns follow their columns
                    df = df.withColumn("unchanged", F.transform("unchanged", _renamer(old, new)))
            have = set(df.columns)
            cols = [(F.col(c.name) if c.name in have else F.lit(None)).cast(c.spark).alias(c.name) for c in target]
            parts.append(df.select(*cols, *RAW))
        return reduce(DataFrame.unionByName, parts)

    def transform(self) -> str | None:
        """Applies what was appended since the mirror's version; returns the new transformed watermark."""
        cur = self.store.current() or {"seen": [], "schema": None}
        present = self.appended()
        new = [f for f in present if f[0] not in set(cur["seen"])]
        if not new:
            return None
        version = max([v for _, v in new] + ([cur["schema"]] if cur["schema"] is not None else []))
        data = [c.name for c in self.columns(version) if c.name not in self.keys]
        log = self.log(new, version).persist()  # the tail; read several times
        try:
            note = {"seen": [n for n, _ in present], "schema": version, "reload": cur.get("reload", 0)}
            if cur["schema"] in (None, version):
                self.store.apply(log, data, "unchanged", note)
            else:
                base = self._evolve(self.store.read(), cur["schema"], version)
                self.store.write(mirror.apply(base, log, self.keys, data, unchanged="unchanged", tombstones=True), note)
            top = log.agg(F.max("commit_lsn").alias("c")).first()["c"]
        finally:
            log.unpersist()
        if top is not None:
            self.control.transformed(*self.id, min(top, self.control.watermark(*self.id)[0]))
        self.control.complete_reached(*self.id)
        return top

    def _evolve(self, base: DataFrame, old: int, new: int) -> DataFrame:
        versions = {v: self.columns(v) for v in range(old, new + 1) if self.control.version(*self.id, v)}
        base, bad = evolve.reconcile(base, versions, old, new)
        for v, q in enumerate(bad):
            if not q.isEmpty():
                q.write.mode("overwrite").parquet(f"{self.root}/quarantine/{old}-{new}-{v}")
                raise Quarantined(f"{self.id}: rows that do not fit version {new}")
        return base

    def mirror(self) -> DataFrame | None:
        m = self.store.read()
        return None if m is None else mirror.user_view(m)

    # Schema events

    def create(self, version: int) -> None:
        """An empty mirror of a registered version; a table that has one keeps it."""
        self.control.ensure_watermark(*self.id)
        if self.store.current() is None:
            cols = ", ".join(f"`{c.name}` {c.spark}" for c in self.columns(version))
            empty = self.spark.createDataFrame([], f"{cols}, _commit_lsn string, _lsn string, _deleted boolean")
            self.store.write(empty, {"seen": [], "schema": version, "reload": 0})

    def consume(self, lsn_: str, tag: str, columns: list[dict] | None = None, comment: tuple[str, str | None] | None = None) -> int | None:
        """An event of the source: a structural one registers the next version and returns it, so that the writer begins a new file; a
        comment goes to the mirror alone and returns None; a dropped table is retired."""
        self.control.add_ddl(self.id[0], lsn_, tag, f"{self.id[1]}.{self.id[2]}")
        if tag.upper() == "DROP TABLE":
            self.retire()
            return None
        if tag.upper() == "COMMENT":
            if comment is not None:
                self.control.set_comment(*self.id, comment[1], comment[0])
            return None
        latest = self.control.version(*self.id)
        version = (latest[0] if latest else 0) + 1
        if columns is not None:
            self.control.add_version(*self.id, version, columns)
        return version

    def retire(self) -> None:
        """A dropped table: queue and positions first, then its folders, so nothing is read that is half gone."""
        self.control.retire_table(*self.id)
        self._fs.delete(self._path(self.root), True)

    def rename(self, new: str) -> TableLoader:
        """The same table under its new name, with its log and mirror; the folder is named by the table's identity and stays."""
        self.control.rename_table(*self.id, new)
        return TableLoader(self.spark, self.control, self.root, self.id[0], self.id[1], new, self.keys, self.store.buckets)

    # Upkeep

    def rebuild(self) -> None:
        """The mirror anew from the retained log and, for what was pruned, its own rows."""
        cur = self.store.current()
        data = [c.name for c in self.columns(cur["schema"]) if c.name not in self.keys]
        log = self.log(self.appended(), cur["schema"]) if self.appended() else None
        base = self.store.read()
        if log is not None:
            out = mirror.rebuild(log, base, self.keys, data, "unchanged", tombstones=True)
            self.store.write(out, {k: cur[k] for k in ("seen", "schema", "reload") if k in cur})

    def prune(self, lag: int = 16 << 20) -> int:
        """Drops appended folders whose changes all lie ``lag`` bytes behind the transformed watermark; returns how many."""
        floor = f"{max(0, int(self.control.watermark(*self.id)[1], 16) - lag):016X}"
        seen, n = set((self.store.current() or {"seen": []})["seen"]), 0
        for name, _ in self.appended():
            top = self.spark.read.parquet(f"{self.root}/raw/{name}").agg(F.max("commit_lsn")).first()[0]
            if name in seen and (top is None or top < floor):
                self._fs.delete(self._path(f"{self.root}/raw/{name}"), True)
                n += 1
        return n

    def tick(self, limit: int = 32) -> bool:
        """Both phases once; whether there was anything to do."""
        a = self.append(limit)
        return self.transform() is not None or a is not None

"""Control store: work queue of staged files, watermarks, schema history, leases, epochs and reloads, in one SQLite file.

It lives on the driver and holds one row per file, table or reload, never data. Every public method is one transaction, so
a step is either wholly visible or not at all. Positions are in normal form, so text comparison is numeric.
"""

from __future__ import annotations

import json
import sqlite3
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ZERO = "0" * 16

SCHEMA = """
CREATE TABLE IF NOT EXISTS epoch (id INTEGER PRIMARY KEY, started REAL NOT NULL);
CREATE TABLE IF NOT EXISTS file (
  id INTEGER PRIMARY KEY AUTOINCREMENT, epoch INTEGER NOT NULL, source_schema TEXT NOT NULL, source_table TEXT NOT NULL,
  uri TEXT NOT NULL, kind TEXT NOT NULL CHECK (kind IN ('snapshot', 'stream', 'spill', 'reload')), row_count INTEGER,
  lsn_start TEXT NOT NULL, lsn_end TEXT NOT NULL CHECK (lsn_end >= lsn_start), schema_version INTEGER NOT NULL,
  reload_id INTEGER, status TEXT NOT NULL DEFAULT 'ready' CHECK (status IN ('ready', 'failed')), UNIQUE (epoch, uri));
CREATE INDEX IF NOT EXISTS file_ready ON file (epoch, source_schema, source_table, lsn_end, id) WHERE status = 'ready';
CREATE TABLE IF NOT EXISTS watermark (
  epoch INTEGER NOT NULL, source_schema TEXT NOT NULL, source_table TEXT NOT NULL, raw_appended TEXT NOT NULL, transformed TEXT NOT NULL,
  PRIMARY KEY (epoch, source_schema, source_table), CHECK (transformed <= raw_appended));
CREATE TABLE IF NOT EXISTS schema_version (
  epoch INTEGER NOT NULL, source_schema TEXT NOT NULL, source_table TEXT NOT NULL, version INTEGER NOT NULL, columns TEXT NOT NULL,
  PRIMARY KEY (epoch, source_schema, source_table, version));
CREATE TABLE IF NOT EXISTS ddl (id INTEGER PRIMARY KEY AUTOINCREMENT, epoch INTEGER NOT NULL, lsn TEXT NOT NULL, tag TEXT NOT NULL, object TEXT NOT NULL,
  done INTEGER NOT NULL DEFAULT 0, UNIQUE (epoch, lsn, object));
CREATE TABLE IF NOT EXISTS slot (name TEXT PRIMARY KEY, confirmed TEXT NOT NULL);
CREATE TABLE IF NOT EXISTS comment (
  epoch INTEGER NOT NULL, source_schema TEXT NOT NULL, source_table TEXT NOT NULL, column_name TEXT NOT NULL DEFAULT '', text TEXT,
  PRIMARY KEY (epoch, source_schema, source_table, column_name));
CREATE TABLE IF NOT EXISTS ownership (
  name TEXT PRIMARY KEY, owner TEXT NOT NULL, token INTEGER NOT NULL, until REAL NOT NULL);
CREATE TABLE IF NOT EXISTS reload (
  id INTEGER PRIMARY KEY AUTOINCREMENT, epoch INTEGER NOT NULL, source_schema TEXT NOT NULL, source_table TEXT NOT NULL,
  mode TEXT NOT NULL CHECK (mode IN ('reload', 'resync')), restarts INTEGER NOT NULL DEFAULT 0,
  state TEXT NOT NULL DEFAULT 'requested' CHECK (state IN ('requested', 'exporting', 'export_complete', 'complete', 'failed')),
  chunk INTEGER NOT NULL DEFAULT 0, cursor TEXT, first_lsn TEXT, final_lsn TEXT, schema_version INTEGER, holder TEXT, until REAL, reason TEXT);
CREATE UNIQUE INDEX IF NOT EXISTS reload_live ON reload (epoch, source_schema, source_table) WHERE state NOT IN ('complete', 'failed');
"""


@dataclass(frozen=True)
class StagedFile:
    id: int
    uri: str
    kind: str
    row_count: int | None
    lsn_start: str
    lsn_end: str
    schema_version: int
    reload_id: int | None


class StaleToken(RuntimeError):
    """A writer whose lease has gone to another."""


class ControlStore:
    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path, isolation_level=None)
        self.db.executescript(SCHEMA)

    @contextmanager
    def transaction(self) -> Iterator[sqlite3.Connection]:
        """Everything inside commits together; nested use joins the outer transaction."""
        if self.db.in_transaction:
            yield self.db
            return
        self.db.execute("BEGIN IMMEDIATE")
        try:
            yield self.db
        except BaseException:
            self.db.execute("ROLLBACK")
            raise
        self.db.execute("COMMIT")

    # Epochs

    def epoch(self) -> int | None:
        return self.db.execute("SELECT max(id) FROM epoch").fetchone()[0]

    def next_epoch(self) -> int:
        with self.transaction() as db:
            n = (self.epoch() or 0) + 1
            db.execute("INSERT INTO epoch VALUES (?, ?)", (n, time.time()))
            return n

    def retire_epochs(self, before: int) -> int:
        """Forgets queue, watermarks, versions, events and reloads of all epochs before one; returns how many files were queued."""
        with self.transaction() as db:
            n = db.execute("DELETE FROM file WHERE epoch < ?", (before,)).rowcount
            for name in ("watermark", "schema_version", "ddl", "reload"):
                db.execute(f"DELETE FROM {name} WHERE epoch < ?", (before,))  # noqa: S608
            return n

    def retire_table(self, epoch: int, schema: str, table: str) -> None:
        """Forgets a table that was dropped at the source; its history of versions stays."""
        with self.transaction() as db:
            for name in ("file", "watermark"):
                db.execute(f"DELETE FROM {name} WHERE epoch = ? AND source_schema = ? AND source_table = ?", (epoch, schema, table))  # noqa: S608
            db.execute("UPDATE reload SET state = 'failed', reason = 'table dropped' WHERE epoch = ? AND source_schema = ? AND source_table = ? "
                       "AND state NOT IN ('complete', 'failed')", (epoch, schema, table))  # fmt: skip

    def rename_table(self, epoch: int, schema: str, table: str, new: str) -> None:
        """Moves all that is known of a table to its new name, in one transaction."""
        with self.transaction() as db:
            for name in ("file", "watermark", "schema_version", "reload"):
                db.execute(f"UPDATE {name} SET source_table = ? WHERE epoch = ? AND source_schema = ? AND source_table = ?", (new, epoch, schema, table))  # noqa: S608

    def verify_or_create(self, name: str, position: str) -> tuple[bool, str]:
        """(created, position): where the stream of that name goes on, or where it begins, if it is new."""
        with self.transaction() as db:
            row = db.execute("SELECT confirmed FROM slot WHERE name = ?", (name,)).fetchone()
            if row:
                return False, row[0]
            db.execute("INSERT INTO slot VALUES (?, ?)", (name, position))
            return True, position

    def confirm(self, name: str, position: str) -> str:
        """Advances a stream's confirmed position, never back; returns it."""
        with self.transaction() as db:
            db.execute("UPDATE slot SET confirmed = max(confirmed, ?) WHERE name = ?", (position, name))
            return db.execute("SELECT confirmed FROM slot WHERE name = ?", (name,)).fetchone()[0]

    # Files

    def add_ready(self, epoch: int, schema: str, table: str, uri: str, kind: str, rows: int, start: str, end: str, version: int, reload_id: int | None = None) -> int:
        """Registers a file; the same URI again is the same file."""
        with self.transaction() as db:
            db.execute(
                "INSERT INTO file (epoch, source_schema, source_table, uri, kind, row_count, lsn_start, lsn_end, schema_version, reload_id) "
                "VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?) ON CONFLICT DO NOTHING",
                (epoch, schema, table, uri, kind, rows, start, end, version, reload_id),
            )
            return db.execute("SELECT id FROM file WHERE epoch = ? AND uri = ?", (epoch, uri)).fetchone()[0]

    def claim_ready(self, epoch: int, schema: str, table: str, limit: int = 32) -> list[StagedFile]:
        """The next files in order of (lsn_end, id). While a reload of the table has not finished its export only its own files come."""
        rows = self.db.execute(
            "SELECT id, uri, kind, row_count, lsn_start, lsn_end, schema_version, reload_id FROM file f WHERE epoch = ? AND source_schema = ? AND source_table = ? "
            "AND status = 'ready' AND NOT (kind <> 'reload' AND EXISTS (SELECT 1 FROM reload r WHERE r.epoch = f.epoch AND r.source_schema = f.source_schema "
            "AND r.source_table = f.source_table AND r.mode = 'reload' AND r.state IN ('requested', 'exporting'))) ORDER BY lsn_end, id LIMIT ?",
            (epoch, schema, table, limit),
        )
        return [StagedFile(*r) for r in rows]

    def mark_failed(self, file_id: int) -> None:
        with self.transaction() as db:
            db.execute("UPDATE file SET status = 'failed' WHERE id = ?", (file_id,))

    def delete_superseded(self, epoch: int, schema: str, table: str, floor: str) -> int:
        """Drops queued files that a reload begun at ``floor`` replaces."""
        with self.transaction() as db:
            return db.execute(
                "DELETE FROM file WHERE epoch = ? AND source_schema = ? AND source_table = ? AND kind <> 'reload' AND lsn_end <= ?", (epoch, schema, table, floor)
            ).rowcount

    # Watermarks

    def ensure_watermark(self, epoch: int, schema: str, table: str) -> None:
        with self.transaction() as db:
            db.execute("INSERT INTO watermark VALUES (?, ?, ?, ?, ?) ON CONFLICT DO NOTHING", (epoch, schema, table, ZERO, ZERO))

    def watermark(self, epoch: int, schema: str, table: str) -> tuple[str, str]:
        self.ensure_watermark(epoch, schema, table)
        return self.db.execute(
            "SELECT raw_appended, transformed FROM watermark WHERE epoch = ? AND source_schema = ? AND source_table = ?", (epoch, schema, table)
        ).fetchone()

    def appended(self, epoch: int, schema: str, table: str, lsn: str, file_ids: list[int]) -> None:
        """Advances the raw watermark (never back) and removes the files from the queue, in one transaction."""
        with self.transaction() as db:
            self.ensure_watermark(epoch, schema, table)
            db.execute(
                "UPDATE watermark SET raw_appended = max(raw_appended, ?) WHERE epoch = ? AND source_schema = ? AND source_table = ?", (lsn, epoch, schema, table)
            )
            db.executemany("DELETE FROM file WHERE id = ?", [(i,) for i in file_ids])

    def transformed(self, epoch: int, schema: str, table: str, lsn: str) -> None:
        with self.transaction() as db:
            db.execute(
                "UPDATE watermark SET transformed = max(transformed, ?) WHERE epoch = ? AND source_schema = ? AND source_table = ?", (lsn, epoch, schema, table)
            )

    def lag(self, epoch: int, schema: str, table: str) -> int:
        """Bytes of log that are staged but not transformed; never negative."""
        top = self.db.execute(
            "SELECT max(lsn_end) FROM file WHERE epoch = ? AND source_schema = ? AND source_table = ? AND status = 'ready'", (epoch, schema, table)
        ).fetchone()[0]
        raw, done = self.watermark(epoch, schema, table)
        return max(0, int(max(top or ZERO, raw), 16) - int(done, 16))

    # Schema history

    def add_version(self, epoch: int, schema: str, table: str, version: int, columns: list[dict]) -> None:
        with self.transaction() as db:
            db.execute("INSERT OR REPLACE INTO schema_version VALUES (?, ?, ?, ?, ?)", (epoch, schema, table, version, json.dumps(columns)))

    def version(self, epoch: int, schema: str, table: str, version: int | None = None) -> tuple[int, list[dict]] | None:
        """A version's columns, by default the latest's."""
        row = self.db.execute(
            "SELECT version, columns FROM schema_version WHERE epoch = ? AND source_schema = ? AND source_table = ? AND (? IS NULL OR version = ?) "
            "ORDER BY version DESC LIMIT 1", (epoch, schema, table, version, version),
        ).fetchone()
        return row and (row[0], json.loads(row[1]))

    def add_ddl(self, epoch: int, lsn: str, tag: str, obj: str) -> None:
        with self.transaction() as db:
            db.execute("INSERT INTO ddl (epoch, lsn, tag, object) VALUES (?, ?, ?, ?) ON CONFLICT DO NOTHING", (epoch, lsn, tag, obj))

    def pending_ddl(self, epoch: int) -> list[tuple[int, str, str, str]]:
        return self.db.execute("SELECT id, lsn, tag, object FROM ddl WHERE epoch = ? AND NOT done ORDER BY lsn, id", (epoch,)).fetchall()

    def set_comment(self, epoch: int, schema: str, table: str, text: str | None, column: str = "") -> None:
        """Comment of a table or column; it belongs to the mirror alone and changes no version. None removes it."""
        with self.transaction() as db:
            if text is None:
                db.execute("DELETE FROM comment WHERE epoch = ? AND source_schema = ? AND source_table = ? AND column_name = ?", (epoch, schema, table, column))
            else:
                db.execute("INSERT OR REPLACE INTO comment VALUES (?, ?, ?, ?, ?)", (epoch, schema, table, column, text))

    # Ownership

    def acquire(self, name: str, owner: str, seconds: float, now: float | None = None) -> int | None:
        """A lease with its fencing token, or None while another owner's holds. The token grows whenever the owner changes or the lease had run out."""
        now = time.time() if now is None else now
        with self.transaction() as db:
            row = db.execute("SELECT owner, token, until FROM ownership WHERE name = ?", (name,)).fetchone()
            if row and row[0] != owner and row[2] > now:
                return None
            token = 1 if row is None else row[1] + (row[0] != owner or row[2] <= now)
            db.execute("INSERT OR REPLACE INTO ownership VALUES (?, ?, ?, ?)", (name, owner, token, now + seconds))
            return token

    def require(self, name: str, token: int) -> None:
        row = self.db.execute("SELECT token FROM ownership WHERE name = ?", (name,)).fetchone()
        if row is None or row[0] != token:
            raise StaleToken(f"{name}: token {token}, current {row and row[0]}")

    def release(self, name: str, owner: str) -> None:
        with self.transaction() as db:
            db.execute("UPDATE ownership SET until = 0 WHERE name = ? AND owner = ?", (name, owner))

    # Reloads

    def request_reload(self, epoch: int, schema: str, table: str, mode: str = "reload") -> int:
        with self.transaction() as db:
            return db.execute("INSERT INTO reload (epoch, source_schema, source_table, mode) VALUES (?, ?, ?, ?)", (epoch, schema, table, mode)).lastrowid

    def claim_reload(self, epoch: int, holder: str | None = None, seconds: float = 60, now: float | None = None) -> int | None:
        """The oldest requested reload, which then exports under the holder's lease."""
        now = time.time() if now is None else now
        with self.transaction() as db:
            row = db.execute("SELECT min(id) FROM reload WHERE epoch = ? AND state = 'requested'", (epoch,)).fetchone()
            if row[0] is not None:
                db.execute("UPDATE reload SET state = 'exporting', holder = ?, until = ? WHERE id = ?", (holder, now + seconds if holder else None, row[0]))
            return row[0]

    def renew_reload(self, reload_id: int, holder: str, seconds: float, now: float | None = None) -> bool:
        """Prolongs an export's lease; False if it has gone to another holder or the export has ended."""
        now = time.time() if now is None else now
        with self.transaction() as db:
            return db.execute("UPDATE reload SET until = ? WHERE id = ? AND holder = ? AND state = 'exporting'", (now + seconds, reload_id, holder)).rowcount == 1

    def adopt_reloads(self, epoch: int, holder: str, seconds: float, limit: int = 8, now: float | None = None) -> list[int]:
        """Exports that this holder may go on with: its own from before a restart, and those whose lease has run out."""
        now = time.time() if now is None else now
        with self.transaction() as db:
            ids = [r[0] for r in db.execute(
                "SELECT id FROM reload WHERE epoch = ? AND state = 'exporting' AND (holder = ? OR until < ?) ORDER BY id LIMIT ?", (epoch, holder, now, limit)
            )]
            db.executemany("UPDATE reload SET holder = ?, until = ? WHERE id = ?", [(holder, now + seconds, i) for i in ids])
            return ids

    def stuck_reloads(self, epoch: int, now: float | None = None) -> list[int]:
        """Exports whose lease has run out and that nobody adopted."""
        now = time.time() if now is None else now
        return [r[0] for r in self.db.execute("SELECT id FROM reload WHERE epoch = ? AND state = 'exporting' AND until < ? ORDER BY id", (epoch, now))]

    def fail_reload(self, reload_id: int, reason: str) -> int:
        """Gives an export up and takes its files out of the queue; returns how many."""
        with self.transaction() as db:
            db.execute("UPDATE reload SET state = 'failed', reason = ? WHERE id = ? AND state IN ('requested', 'exporting', 'export_complete')", (reason, reload_id))
            return db.execute("DELETE FROM file WHERE reload_id = ?", (reload_id,)).rowcount

    def advance_reload(self, reload_id: int, chunk: int, cursor: str, lsn: str, version: int) -> bool:
        """Moves an export to its next chunk: only from the one before, and only under the schema version it began with."""
        with self.transaction() as db:
            return db.execute(
                "UPDATE reload SET chunk = ?, cursor = ?, first_lsn = coalesce(first_lsn, ?), schema_version = coalesce(schema_version, ?) "
                "WHERE id = ? AND state = 'exporting' AND chunk = ? AND (schema_version IS NULL OR schema_version = ?)",
                (chunk, cursor, lsn, version, reload_id, chunk - 1, version),
            ).rowcount == 1

    def reload_floor(self, epoch: int, schema: str, table: str) -> str | None:
        """First position of the newest live reload of a table."""
        row = self.db.execute(
            "SELECT first_lsn FROM reload WHERE epoch = ? AND source_schema = ? AND source_table = ? AND mode = 'reload' "
            "AND state IN ('requested', 'exporting', 'export_complete') AND first_lsn IS NOT NULL ORDER BY id DESC LIMIT 1", (epoch, schema, table),
        ).fetchone()
        return row and row[0]

    def reload_chunk(self, reload_id: int, cursor: str, **file) -> int:
        """Registers a chunk and moves the cursor past it, in one transaction, so no chunk is skipped or repeated."""
        with self.transaction() as db:
            n = db.execute("UPDATE reload SET cursor = ? WHERE id = ? AND state = 'exporting'", (cursor, reload_id)).rowcount
            if n != 1:
                raise RuntimeError(f"reload {reload_id} is not exporting")
            return self.add_ready(**file, kind="reload", reload_id=reload_id)

    def export_done(self, reload_id: int, final_lsn: str) -> None:
        with self.transaction() as db:
            db.execute("UPDATE reload SET state = 'export_complete', final_lsn = ? WHERE id = ? AND state = 'exporting'", (final_lsn, reload_id))

    def restart_reload(self, reload_id: int, cap: int = 3) -> int | None:
        """Fails an export that a schema change broke and requests its successor, up to ``cap`` times."""
        with self.transaction() as db:
            epoch, schema, table, mode, restarts = db.execute(
                "SELECT epoch, source_schema, source_table, mode, restarts FROM reload WHERE id = ?", (reload_id,)
            ).fetchone()
            db.execute("UPDATE reload SET state = 'failed', reason = 'schema change' WHERE id = ? AND state = 'exporting'", (reload_id,))
            if restarts >= cap:
                return None
            return db.execute(
                "INSERT INTO reload (epoch, source_schema, source_table, mode, restarts) VALUES (?, ?, ?, ?, ?)", (epoch, schema, table, mode, restarts + 1)
            ).lastrowid

    def complete_reached(self, epoch: int, schema: str, table: str) -> list[int]:
        """Completes exported reloads whose last position the transform has reached."""
        with self.transaction() as db:
            ids = [
                r[0]
                for r in db.execute(
                    "SELECT r.id FROM reload r JOIN watermark w USING (epoch, source_schema, source_table) WHERE epoch = ? AND source_schema = ? "
                    "AND source_table = ? AND state = 'export_complete' AND final_lsn <= transformed", (epoch, schema, table),
                )
            ]
            db.executemany("UPDATE reload SET state = 'complete' WHERE id = ?", [(i,) for i in ids])
            return ids

    def reload_state(self, reload_id: int) -> tuple[str, str | None, str | None]:
        return self.db.execute("SELECT state, cursor, final_lsn FROM reload WHERE id = ?", (reload_id,)).fetchone()

    # Views

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        """One of the store's tables as a DataFrame; text columns unless all values are numbers."""
        cur = self.db.execute(f'SELECT * FROM "{name}"')
        cols, rows = [c[0] for c in cur.description], cur.fetchall()
        numeric = {c for i, c in enumerate(cols) if rows and all(isinstance(r[i], int) or r[i] is None for r in rows)}
        schema = ", ".join(f"`{c}` {'bigint' if c in numeric else 'string'}" for c in cols)
        return spark.createDataFrame([tuple(v if c in numeric or v is None else str(v) for c, v in zip(cols, r, strict=True)) for r in rows], schema)

"""Transactions that arrive interleaved: nothing is visible before its commit, rolled-back parts never are.

Keyed by buckets of top transactions, as each key costs calls to the state and frames of its own: messages are packed before the shuffle, and whole buckets are
gated at once. What begins and ends in one batch never touches the state. Rows that stay open are appended to it in packed parts, beside an index of
the parts that each open transaction has rows in and the sub-transactions that were aborted. A commit emits the surviving rows stamped with its
position, in pieces; a whole abort drops them. Open transactions stay in state, which the state store (RocksDB) keeps on disk; they never expire, as a
position that is still open must not be passed.

Changes of a transaction in the same batch as its commit count whatever their order; changes after it are another transaction of that number. Messages
without a transaction are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Messages: kind is change, commit or abort; ``lsn`` orders them within a transaction.
MESSAGES = "xid bigint, sub_xid bigint, kind string, lsn string, payload string"
OUT = "xid bigint, sub_xid bigint, lsn string, payload string, commit_lsn string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state. A store that exists keeps its number.
BUCKETS = 512
#: Rows and bytes that are emitted, or stored in one part, at once.
PIECE, PIECE_BYTES = 10_000, 8 << 20
#: Rows and bytes that are packed into one value; Arrow moves 10,000 values at once.
PACKED, PACKED_BYTES = 128, 8 << 10
#: Bytes that a task holds before it packs them, or of one bucket before it moves them to the state.
HELD_BYTES = 32 << 20

INT, TEXT = pa.int64(), pa.string()
MESSAGE = pa.schema([("xid", INT), ("sub_xid", INT), ("kind", TEXT), ("lsn", TEXT), ("payload", TEXT)])
ROW = pa.schema([("xid", INT), ("sub_xid", INT), ("lsn", TEXT), ("payload", TEXT)])
PART = pa.schema([("xid", INT), ("part", INT)])
DEAD = pa.schema([("xid", INT), ("sub_xid", INT)])


def _pieces(table: Any, rows: int, size: int) -> Iterator[Any]:
    """A table or record batch in pieces of at most ``rows`` rows and about ``size`` bytes, and one row at least."""
    step = max(1, min(rows, table.num_rows * size // max(1, table.nbytes)))
    for i in range(0, table.num_rows, step):
        yield table.slice(i, step)


def _bytes(table: pa.Table) -> bytes:
    batch = table.combine_chunks().to_batches()
    return batch[0].serialize().to_pybytes() if batch else b""


def _table(body: bytes, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(body), schema)] if body else [], schema)


def _sorted(table: pa.Table, by: str) -> pa.Table:
    return table.combine_chunks().take(np.argsort(table[by].to_numpy(), kind="stable"))


def _in(column: pa.ChunkedArray, values: pa.ChunkedArray | pa.Array) -> pa.ChunkedArray:
    return pc.is_in(column, value_set=pc.unique(values))


def _pairs_in(table: pa.Table, dead: pa.Table) -> pa.ChunkedArray:
    """Whether (xid, sub_xid) of each row is among those of ``dead``."""
    xids, subs = pc.unique(dead["xid"]), pc.unique(dead["sub_xid"])
    code = lambda t: pc.add(pc.multiply(pc.index_in(t["xid"], value_set=xids).cast(INT), len(subs)), pc.index_in(t["sub_xid"], value_set=subs).cast(INT))
    return _in(code(table), code(dead))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, messages) to (bucket, body), with some messages in each body."""

    def packed() -> pa.RecordBatch:
        table = _sorted(pa.Table.from_batches(held), "bucket")
        at = table["bucket"].to_numpy()
        cuts = [*np.flatnonzero(np.diff(at, prepend=-1)), len(at)]
        messages = table.select(MESSAGE.names).cast(MESSAGE).combine_chunks().to_batches()[0]
        out = [(at[a], p.serialize().to_pybytes()) for a, z in zip(cuts, cuts[1:], strict=False) for p in _pieces(messages.slice(a, z - a), PACKED, PACKED_BYTES)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], INT), pa.array([b for _, b in out], pa.binary())], ["bucket", "body"])

    held, size = [], 0
    for batch in batches:
        held, size = [*held, batch], size + batch.nbytes
        if size >= HELD_BYTES:
            yield packed()
            held, size = [], 0
    if size:
        yield packed()


def _unpack(rows: Iterator[pd.DataFrame]) -> Iterator[pa.Table]:
    """Messages of a bucket, in tables of about ``HELD_BYTES``."""
    held, size = [], 0
    for pdf in rows:
        for body in pdf["body"]:
            held.append(pa.ipc.read_record_batch(pa.py_buffer(body), MESSAGE))
            size += len(body)
            if size >= HELD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Gate(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "parts binary, dead binary, next bigint")
        self.rows = handle.getMapState("rows", "part bigint", "body binary")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored = self.index.get()
        body, gone, self.next = stored or (b"", b"", 0)
        parts, dead, new, ends = _table(body, PART), _table(gone, DEAD), ROW.empty_table(), []
        for messages in _unpack(rows):
            parts = self._store(new, parts)  # all but the last table: more than a task should hold
            change = pc.equal(messages["kind"], "change")
            new = messages.filter(change).select(ROW.names)
            ends.append(messages.filter(pc.invert(change)))
        end = pa.concat_tables(ends)
        aborts = end.filter(pc.and_(pc.equal(end["kind"], "abort"), pc.is_valid(end["sub_xid"])))
        dead = pa.concat_tables([dead, aborts.select(DEAD.names)]).group_by(DEAD.names).aggregate([]).select(DEAD.names)
        whole = dead.filter(pc.equal(dead["xid"], dead["sub_xid"]))["xid"]
        commits = end.filter(pc.and_(pc.equal(end["kind"], "commit"), pc.is_valid(end["lsn"]))).group_by("xid").aggregate([("lsn", "min")])
        commits = commits.filter(pc.invert(_in(commits["xid"], whole)))
        over = pa.concat_tables([commits.select(["xid"]), pa.table({"xid": whole})])["xid"]

        def visible(table: pa.Table) -> Iterator[pd.DataFrame]:
            at = pc.index_in(table["xid"], value_set=commits["xid"].combine_chunks())
            out = table.append_column("commit_lsn", commits["lsn_min"].combine_chunks().take(at)).filter(pc.is_valid(at))
            for piece in _pieces(out, PIECE, PIECE_BYTES):
                yield piece.to_pandas(types_mapper={INT: pd.Int64Dtype()}.get)

        new = new.filter(pc.invert(_pairs_in(new, dead)))
        yield from visible(new)
        for part in pc.unique(parts.filter(_in(parts["xid"], over))["part"]).to_pylist():
            had = _table(self.rows.getValue((part,))[0], ROW)
            own = parts.filter(pc.equal(parts["part"], part))["xid"]  # rows of others are from transactions that ended, whose numbers may be used again
            live = had.filter(pc.and_(_in(had["xid"], own), pc.invert(_pairs_in(had, dead))))
            yield from visible(live)
            rest = live.filter(pc.invert(_in(live["xid"], over)))
            if not rest.num_rows:
                self.rows.removeKey((part,))
                parts = parts.filter(pc.not_equal(parts["part"], part))
            elif rest.num_rows <= had.num_rows // 2:
                self.rows.updateValue((part,), (_bytes(rest),))
        parts, dead = (t.filter(pc.invert(_in(t["xid"], over))) for t in (parts, dead))
        parts = self._store(new.filter(pc.invert(_in(new["xid"], over))), parts)
        if parts.num_rows or dead.num_rows:
            self.index.update((_bytes(parts), _bytes(dead), self.next))
        elif stored:
            self.index.clear()

    def _store(self, rows: pa.Table, parts: pa.Table) -> pa.Table:
        """Appends ``rows`` to the state in new parts; the index with them. Rows of one transaction lie together."""
        added = [parts]
        for piece in _pieces(_sorted(rows, "xid"), PIECE, PIECE_BYTES):
            self.rows.updateValue((self.next,), (_bytes(piece),))
            xids = pc.unique(piece["xid"])
            added.append(pa.table([xids, pa.array([self.next] * len(xids), INT)], PART))
            self.next += 1
        return pa.concat_tables(added)

    def close(self) -> None:
        """Nothing is held outside the state."""


def committed(messages: DataFrame) -> DataFrame:
    """Rows of committed transactions from a stream of ``MESSAGES``. The session's state store must be RocksDB, which is set here."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = messages.where("xid IS NOT NULL").select(F.pmod(F.xxhash64("xid"), F.lit(BUCKETS)).alias("bucket"), *MESSAGE.names)
    packed = keyed.mapInArrow(_pack, "bucket bigint, body binary")
    return packed.groupBy("bucket").transformWithStateInPandas(_Gate(), OUT, "append", "none")

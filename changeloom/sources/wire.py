"""Logical-replication messages (the public ``pgoutput`` format, protocol version 2 with streaming) as a DataFrame source.

``decode`` turns one payload into a ``dict``; ``decode_frames`` a DataFrame of frames into rows. Within a streamed transaction
messages carry the sub-transaction's id, so a decoder must know whether a stream block is open. That state is one bit: frames are
range-partitioned by number, each partition reports its last block mark (one value per partition), and every partition
starts with the state its predecessors leave. The log is thus decoded in parallel, whatever its length.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.operators import common

#: Microseconds from the Unix epoch to 2000-01-01, the epoch of timestamps on the wire.
EPOCH = 946_684_800_000_000
NULL, UNCHANGED, TEXT, BINARY = "n", "u", "t", "b"


class Malformed(ValueError):
    """A payload that ends early, goes on too long or has an unknown tag."""


class Reader:
    """Bounds-checked big-endian reads."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        end = self.at + n
        if n < 0 or end > len(self.data):
            raise Malformed(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        out = self.data[self.at : end]
        self.at = end
        return out

    def number(self, form: str) -> int:
        return struct.unpack(">" + form, self.take(struct.calcsize(form)))[0]

    def byte(self) -> str:
        return chr(self.take(1)[0])

    def string(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise Malformed("text without end")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out

    def lsn(self) -> str:
        return f"{self.number('Q'):016X}"

    def time(self) -> int:
        return self.number("q") + EPOCH

    def done(self) -> None:
        if self.at != len(self.data):
            raise Malformed(f"{len(self.data) - self.at} bytes left over")


def _tuple(r: Reader) -> list[tuple[str, Any]]:
    out = []
    for _ in range(r.number("h")):
        kind = r.byte()
        if kind in (NULL, UNCHANGED):
            out.append((kind, None))
        elif kind == TEXT:
            out.append((kind, r.take(r.number("i")).decode()))
        elif kind == BINARY:
            out.append((kind, r.take(r.number("i"))))
        else:
            raise Malformed(f"value of kind {kind!r}")
    return out


def _relation(r: Reader) -> dict[str, Any]:
    out: dict[str, Any] = {"rel": r.number("I"), "schema": r.string(), "name": r.string(), "identity": r.byte(), "columns": []}
    for _ in range(r.number("h")):
        out["columns"].append({"is_key": bool(r.number("B") & 1), "name": r.string(), "type_oid": r.number("I"), "typmod": r.number("i")})
    return out


def _old_image(r: Reader, kind: str) -> dict[str, Any]:
    return {"key" if kind == "K" else "old": _tuple(r)}


def _update(r: Reader) -> dict[str, Any]:
    out: dict[str, Any] = {"rel": r.number("I")}
    kind = r.byte()
    if kind in "KO":
        out |= _old_image(r, kind)
        kind = r.byte()
    if kind != "N":
        raise Malformed("update without a new row")
    return out | {"new": _tuple(r)}


def _insert(r: Reader) -> dict[str, Any]:
    rel = r.number("I")
    if r.byte() != "N":
        raise Malformed("insert without a new row")
    return {"rel": rel, "new": _tuple(r)}


def _delete(r: Reader) -> dict[str, Any]:
    rel, kind = r.number("I"), r.byte()
    if kind not in "KO":
        raise Malformed("delete without an old row")
    return {"rel": rel} | _old_image(r, kind)


def _truncate(r: Reader) -> dict[str, Any]:
    n, options = r.number("i"), r.number("B")
    return {"cascade": bool(options & 1), "restart": bool(options & 2), "rels": [r.number("I") for _ in range(n)]}


def _message(r: Reader) -> dict[str, Any]:
    out = {"transactional": bool(r.number("B") & 1), "lsn": r.lsn(), "prefix": r.string()}
    return out | {"content": r.take(r.number("i"))}


def _prepared(r: Reader) -> dict[str, Any]:
    return {"flags": r.number("B"), "lsn": r.lsn(), "end_lsn": r.lsn(), "time": r.time(), "xid": r.number("I"), "gid": r.string()}


#: Tags whose message carries a transaction id inside a stream block.
IN_STREAM = set("RYIUDTM")
BODY = {
    "B": lambda r: {"final_lsn": r.lsn(), "time": r.time(), "xid": r.number("I")},
    "C": lambda r: {"flags": r.number("B"), "commit_lsn": r.lsn(), "end_lsn": r.lsn(), "time": r.time()},
    "O": lambda r: {"lsn": r.lsn(), "name": r.string()},
    "R": _relation,
    "Y": lambda r: {"type_oid": r.number("I"), "schema": r.string(), "name": r.string()},
    "I": _insert,
    "U": _update,
    "D": _delete,
    "T": _truncate,
    "M": _message,
    "S": lambda r: {"xid": r.number("I"), "first": r.number("B") == 1},
    "E": lambda r: {},
    "c": lambda r: {"xid": r.number("I"), "flags": r.number("B"), "commit_lsn": r.lsn(), "end_lsn": r.lsn(), "time": r.time()},
    "A": lambda r: {"xid": r.number("I"), "sub_xid": r.number("I")},
    "b": lambda r: {"lsn": r.lsn(), "end_lsn": r.lsn(), "time": r.time(), "xid": r.number("I"), "gid": r.string()},
    "P": _prepared,
    "K": _prepared,
    "r": lambda r: {
        "flags": r.number("B"), "end_lsn": r.lsn(), "rollback_lsn": r.lsn(), "prepared": r.time(), "time": r.time(), "xid": r.number("I"), "gid": r.string(),
    },
    "p": _prepared,
}


def decode(payload: bytes, in_stream: bool = False) -> dict[str, Any]:
    """One message; raises Malformed for bytes too few or too many."""
    r = Reader(payload)
    tag = r.byte()
    if tag not in BODY:
        raise Malformed(f"unknown tag {tag!r}")
    head = {"tag": tag}
    if in_stream and tag in IN_STREAM:
        head["sub_xid"] = r.number("I")
    out = head | BODY[tag](r)
    r.done()
    return out


def decode_stream(data: bytes) -> list[dict[str, Any]]:
    """Messages one after another, parted by single line feeds."""
    out, open_block, rest = [], False, data
    while rest:
        if rest[:1] == b"\n":
            rest = rest[1:]
            continue
        r = Reader(rest)
        tag = r.byte()
        if tag not in BODY:
            raise Malformed(f"unknown tag {tag!r}")
        head = {"tag": tag} | ({"sub_xid": r.number("I")} if open_block and tag in IN_STREAM else {})
        out.append(head | BODY[tag](r))
        open_block = tag == "S" or (open_block and tag != "E")
        rest = rest[r.at :]
    return out


CELL = "struct<kind:string,value:string,bytes:binary>"
ROW = (
    f"frame_no bigint, frame_lsn string, tag string, xid bigint, sub_xid bigint, rel bigint, rels array<bigint>, commit_lsn string, "
    f"time_micros bigint, new array<{CELL}>, old array<{CELL}>, old_is_key boolean, relation string"
)


_SHORT, _INT, _UINT = struct.Struct(">h"), struct.Struct(">i"), struct.Struct(">I")


class _Cells:
    """Rows of cells as flat columns: kinds, texts, bytes and where each row ends; a row that is None is null."""

    def __init__(self):
        self.kinds, self.texts, self.raws, self.ends, self.valid = [], [], [], [0], []

    def none(self) -> None:
        self.ends.append(len(self.kinds))
        self.valid.append(False)

    def add(self, values: list[tuple[str, Any]] | None) -> None:
        if values is None:
            return self.none()
        for kind, v in values:
            self.kinds.append(kind)
            self.texts.append(v if kind == TEXT else None)
            self.raws.append(v if kind == BINARY else None)
        self.ends.append(len(self.kinds))
        self.valid.append(True)
        return None

    def read(self, p: bytes, at: int) -> int:
        """A row straight from a payload; returns where it ends."""
        kinds, texts, raws = self.kinds, self.texts, self.raws
        (n,) = _SHORT.unpack_from(p, at)
        at += 2
        for _ in range(n):
            kind = p[at]
            at += 1
            if kind == 116:  # t
                end = at + 4 + _INT.unpack_from(p, at)[0]
                if end > len(p) or end < at + 4:
                    raise Malformed("value that ends early")
                kinds.append(TEXT), texts.append(p[at + 4 : end].decode()), raws.append(None)
                at = end
            elif kind in (110, 117):  # n, u
                kinds.append(chr(kind)), texts.append(None), raws.append(None)
            elif kind == 98:  # b
                end = at + 4 + _INT.unpack_from(p, at)[0]
                if end > len(p) or end < at + 4:
                    raise Malformed("value that ends early")
                kinds.append(BINARY), texts.append(None), raws.append(p[at + 4 : end])
                at = end
            else:
                raise Malformed(f"value of kind {chr(kind)!r}")
        self.ends.append(len(kinds))
        self.valid.append(True)
        return at

    def array(self) -> pa.ListArray:
        cells = pa.StructArray.from_arrays(
            [pa.array(self.kinds, pa.string()), pa.array(self.texts, pa.string()), pa.array(self.raws, pa.binary())], names=["kind", "value", "bytes"]
        )
        none = pa.array([not v for v in self.valid], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), cells, mask=none)


class _Rows:
    """Decoded frames in columns. Row changes, which are nearly all frames, are read without going through a dict."""

    def __init__(self):
        self.plain: dict[str, list] = {c: [] for c in PLAIN}
        self.new, self.old = _Cells(), _Cells()

    def change(self, state: State, p: bytes) -> tuple:
        """(sub_xid, rel, old_is_key) of an insert, update or delete."""
        at, sub = 1, None
        if state.block:
            (sub,), at = _UINT.unpack_from(p, at), at + 4
        (rel,), at = _UINT.unpack_from(p, at), at + 4
        is_key, kind = None, p[at]
        if p[0] != 73 and kind in (75, 79):  # not I, and K or O
            is_key = kind == 75
            at = self.old.read(p, at + 1)
            kind = p[at] if p[0] == 85 else None
        else:
            self.old.none()
        if p[0] == 68:  # D
            if is_key is None:
                raise Malformed("delete without an old row")
            self.new.none()
        elif kind == 78:  # N
            at = self.new.read(p, at + 1)
        else:
            raise Malformed("change without a new row")
        if at != len(p):
            raise Malformed(f"{len(p) - at} bytes left over")
        return sub, rel, is_key

    def add(self, frame_no: int, frame_lsn: str, state: State, p: bytes) -> None:
        out = self.plain
        if p[:1] in (b"I", b"U", b"D"):
            try:
                sub, rel, is_key = self.change(state, p)
            except (struct.error, IndexError) as e:
                raise Malformed("payload that ends early") from e
            values = (frame_no, frame_lsn, chr(p[0]), state.xid, sub, rel, None, None, None, is_key, None)
        else:
            m = state.decode(p)
            relation = json.dumps({k: m[k] for k in ("rel", "schema", "name", "identity", "columns")}) if m["tag"] == "R" else None
            self.new.none(), self.old.none()
            values = (frame_no, frame_lsn, m["tag"], m.get("xid"), m.get("sub_xid"), m.get("rel"), m.get("rels"), m.get("commit_lsn") or m.get("final_lsn"), m.get("time"), None, relation)
        for column, v in zip(out.values(), values, strict=True):
            column.append(v)

    def batch(self) -> pa.RecordBatch:
        kinds = {"rels": pa.list_(pa.int64()), "frame_lsn": pa.string(), "tag": pa.string(), "commit_lsn": pa.string(), "relation": pa.string(), "old_is_key": pa.bool_()}
        cols = {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in self.plain.items()} | {"new": self.new.array(), "old": self.old.array()}
        return pa.RecordBatch.from_arrays([cols[c] for c in ROW_COLUMNS], names=list(ROW_COLUMNS))


class State:
    """What a decoder carries from frame to frame: whether a stream block is open, and the open transaction."""

    def __init__(self, block: bool = False, xid: int | None = None):
        self.block, self.xid = block, xid

    def decode(self, payload: bytes) -> dict[str, Any]:
        m = decode(payload, self.block)
        tag = m["tag"]
        if tag == "S":
            self.block, self.xid = True, m["xid"]
        elif tag == "B":
            self.xid = m["xid"]
        if "xid" not in m and self.xid is not None:
            m["xid"] = self.xid
        if tag == "E":
            self.block, self.xid = False, None
        elif tag == "C":
            self.xid = None
        return m


#: Payload bytes that a task decodes at most on average.
DECODE_BYTES = 64 << 20


def decode_frames(frames: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of (frame_no, frame_lsn, payload), in the schema ``ROW``; ``frame_no`` gives the order.

    By default there are as many partitions as the payloads' bytes ask for, and not fewer than the session's parallelism.
    """
    frames = frames.select("frame_no", "frame_lsn", "payload")
    if partitions is None:
        size = frames.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
        partitions = max(frames.sparkSession.sparkContext.defaultParallelism, -(-size // DECODE_BYTES))
    ordered = frames.repartitionByRange(partitions, "frame_no").sortWithinPartitions("frame_no")
    ordered = common.checkpoint(ordered)  # both passes must see the same partitions
    number = lambda at: F.conv(F.hex(F.substring("payload", at, 4)), 16, 10).cast("bigint")
    tag = F.decode(F.substring("payload", 1, 1), "ISO-8859-1")
    marks = (
        ordered.select("frame_no", F.spark_partition_id().alias("part"), tag.alias("tag"), F.when(tag == "S", number(2)).when(tag == "B", number(18)).alias("xid"))
        .where(F.col("tag").isin("S", "E", "B", "C"))
        .groupBy("part").agg(F.max(F.struct("frame_no", "tag", "xid")).alias("m")).select("m.*")
    )
    # One row per partition: its last mark, hence the state that it leaves.
    last = sorted((r["frame_no"], r["tag"], r["xid"]) for r in marks.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State | None = None
        for b in batches:
            out = _Rows()
            for no, lsn, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if state is None:
                    before = [m for m in last if m[0] < no]
                    tag, xid = before[-1][1:] if before else ("E", None)
                    state = State(tag == "S", xid if tag in ("S", "B") else None)
                out.add(no, lsn, state, payload)
            yield out.batch()

    return ordered.mapInArrow(run, ROW)


ROW_COLUMNS = ("frame_no", "frame_lsn", "tag", "xid", "sub_xid", "rel", "rels", "commit_lsn", "time_micros", "new", "old", "old_is_key", "relation")
PLAIN = tuple(c for c in ROW_COLUMNS if c not in ("new", "old"))


class Encoder:
    """Builds payloads; for fixtures, recorded-frame sources and round trips."""

    @staticmethod
    def text(s: str) -> bytes:
        return s.encode() + b"\0"

    @staticmethod
    def row(values: list[str | bytes | None | type[Ellipsis]]) -> bytes:
        """``...`` stands for an unchanged value."""
        out = [struct.pack(">h", len(values))]
        for v in values:
            if v is None:
                out.append(b"n")
            elif v is ...:
                out.append(b"u")
            elif isinstance(v, bytes):
                out.append(b"b" + struct.pack(">i", len(v)) + v)
            else:
                out.append(b"t" + struct.pack(">i", len(v.encode())) + v.encode())
        return b"".join(out)

    @classmethod
    def relation(cls, rel: int, schema: str, name: str, columns: list[tuple[str, int, int, bool]], identity: str = "d", sub: int | None = None) -> bytes:
        head = cls.head("R", sub) + struct.pack(">I", rel) + cls.text(schema) + cls.text(name) + identity.encode() + struct.pack(">h", len(columns))
        return head + b"".join(struct.pack(">B", key) + cls.text(n) + struct.pack(">Ii", oid, mod) for n, oid, mod, key in columns)

    @staticmethod
    def head(tag: str, sub: int | None = None) -> bytes:
        return tag.encode() + (b"" if sub is None else struct.pack(">I", sub))

    @classmethod
    def begin(cls, final: int, time: int, xid: int) -> bytes:
        return b"B" + struct.pack(">QqI", final, time - EPOCH, xid)

    @classmethod
    def commit(cls, lsn: int, end: int, time: int) -> bytes:
        return b"C" + struct.pack(">BQQq", 0, lsn, end, time - EPOCH)

    @classmethod
    def insert(cls, rel: int, new: list, sub: int | None = None) -> bytes:
        return cls.head("I", sub) + struct.pack(">I", rel) + b"N" + cls.row(new)

    @classmethod
    def update(cls, rel: int, new: list, old: list | None = None, key: bool = True, sub: int | None = None) -> bytes:
        before = b"" if old is None else (b"K" if key else b"O") + cls.row(old)
        return cls.head("U", sub) + struct.pack(">I", rel) + before + b"N" + cls.row(new)

    @classmethod
    def delete(cls, rel: int, old: list, key: bool = True, sub: int | None = None) -> bytes:
        return cls.head("D", sub) + struct.pack(">I", rel) + (b"K" if key else b"O") + cls.row(old)

    @classmethod
    def truncate(cls, rels: list[int], options: int = 0, sub: int | None = None) -> bytes:
        return cls.head("T", sub) + struct.pack(f">iB{len(rels)}I", len(rels), options, *rels)

    @classmethod
    def stream_start(cls, xid: int, first: bool) -> bytes:
        return b"S" + struct.pack(">IB", xid, first)

    @classmethod
    def stream_stop(cls) -> bytes:
        return b"E"

    @classmethod
    def stream_commit(cls, xid: int, lsn: int, end: int, time: int) -> bytes:
        return b"c" + struct.pack(">IBQQq", xid, 0, lsn, end, time - EPOCH)

    @classmethod
    def stream_abort(cls, xid: int, sub: int) -> bytes:
        return b"A" + struct.pack(">II", xid, sub)

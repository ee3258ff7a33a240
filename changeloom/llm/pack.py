"""Filling containers of one fixed capacity by hierarchical residual packing.

1. Texts are measured in tokens. One longer than the capacity is split into full pieces, each a container of its own, and a rest; no other
   text is split.
2. Each partition packs its pieces by best fit (longest first, each into the fullest container that takes it), in chunks of bounded
   length. Containers with at most ``slack`` left are emitted.
3. Underfull containers become items of the next round, on ``fan_in`` times fewer partitions, where they are packed again by best fit as
   whole items. Rounds go on until one chunk has held all that was left, or a round joins less than one container in ``STALL``: then no
   pieces fit together any more, and the rest is emitted as it is.

A task holds at most one chunk, whose containers and members are both bounded. Each round is checkpointed, so a lost executor repeats one round. A container lists its
members (at most ``capacity``, as each has a token). Texts without tokens need no space: they come out with a null container. A
null text counts as empty. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import bpe
from changeloom.operators import common

CAPACITY = 2048
#: Containers, and members of containers, that a task holds at once; one of them full ends a chunk.
CHUNK, MEMBERS_AT_ONCE = 200_000, 2_000_000
FAN_IN = 8
STALL = 200

MEMBERS = "array<struct<doc_id:bigint,piece_no:int,start_token:int,n_tokens:int>>"
BIN = f"members {MEMBERS}, size int, closed boolean"


def pieces(measured: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens) from (doc_id, n_tokens); nothing for texts without tokens."""
    starts = F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(capacity))
    cut = measured.where("n_tokens > 0").select("doc_id", "n_tokens", F.posexplode(starts).alias("piece_no", "start_token"))
    return cut.select("doc_id", "piece_no", "start_token", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start_token")).alias("n_tokens"))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, longest first, each into the fullest container that still takes it."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = count = 0  # bit r of mask: some container has r left
    for i in order.tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            at, left, count = count, capacity, count + 1
        out[i] = at
        if rest := left - size:
            room[rest].append(at)
            mask |= 1 << rest
    return out


def _pack(members: pa.ListArray, sizes: np.ndarray, capacity: int, slack: int, last: bool) -> pa.RecordBatch:
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    n = int(bins.max()) + 1 if len(bins) else 0
    filled = np.bincount(bins, weights=sizes, minlength=n).astype(np.int32)
    lengths = np.diff(members.offsets.to_numpy())
    held = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
    flat = members.take(pa.array(order)).flatten()
    offsets = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(offsets), flat)
    closed = np.full(n, True) if last else filled >= capacity - slack
    return pa.RecordBatch.from_arrays([made, pa.array(filled), pa.array(closed)], names=["members", "size", "closed"])


def _slices(sizes: np.ndarray, rows: int, members: int) -> list[tuple[int, int]]:
    """Consecutive spans of at most so many containers and members; a container by itself may exceed the latter."""
    ends, out, lo = np.cumsum(sizes), [], 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = min(max(int(np.searchsorted(ends, before + members, side="right")), lo + 1), lo + rows)
        out.append((lo, hi))
        lo = hi
    return out


def _round(items: DataFrame, capacity: int, slack: int, chunk: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = inside = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            members = table.column("members").combine_chunks()
            members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
            if members.offset:
                members = pa.concat_arrays([members])
            held.clear()
            return _pack(members, table.column("size").to_numpy(), capacity, slack, last)

        for b in batches:
            sizes = np.diff(b.column(0).offsets.to_numpy())
            for lo, hi in _slices(sizes, chunk, MEMBERS_AT_ONCE):
                n = int(sizes[lo:hi].sum())
                if rows and (rows + hi - lo > chunk or inside + n > MEMBERS_AT_ONCE):
                    yield flush()
                    rows = inside = 0
                held.append(b.slice(lo, hi - lo))
                rows, inside = rows + hi - lo, inside + n
        if rows:
            yield flush()

    return items.mapInArrow(run, BIN)


def pack(items: DataFrame, capacity: int = CAPACITY, slack: int | None = None, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """``items`` (doc_id, piece_no, start_token, n_tokens) with container_id and the container's fill.

    The container is named by its first member, ``doc-piece``, so names need no coordination.
    """
    slack = capacity // 64 if slack is None else slack
    one = F.struct("doc_id", "piece_no", F.col("start_token").cast("int").alias("start_token"), F.col("n_tokens").cast("int").alias("n_tokens"))
    full = items.where(F.col("n_tokens") == capacity).select(F.array(one).cast(MEMBERS).alias("members"), F.col("n_tokens").cast("int").alias("size"))
    level = items.where(F.col("n_tokens") < capacity).select(F.array(one).cast(MEMBERS).alias("members"), F.col("n_tokens").cast("int").alias("size"))
    done, n_before, parts = [full], None, None
    while True:
        packed = common.checkpoint(_round(level, capacity, slack, chunk, last=False))
        done.append(packed.where("closed").select("members", "size"))
        level = packed.where("not closed").select("members", "size")
        n_open = level.count()
        if n_open <= 1 or parts == 1 or (n_before and n_before - n_open < n_before / STALL):
            done.append(level)
            break
        held = parts or packed.rdd.getNumPartitions()
        # Half a chunk a partition, as hashing does not fill partitions evenly.
        parts = max(-(-held // fan_in), -(-2 * n_open // chunk)) if n_open > chunk // 2 else 1
        level = level.repartition(parts, F.xxhash64(F.col("members")[0], F.lit(len(done))))
        n_before = n_open
    bins = reduce(DataFrame.unionByName, done)
    name = F.concat_ws("-", F.col("members")[0]["doc_id"], F.col("members")[0]["piece_no"])
    return bins.select(name.alias("container_id"), F.col("size").alias("fill"), F.inline("members"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, file: str | None = None) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_id, fill) for every document of ``docs``."""
    measured = common.checkpoint(bpe.encode(docs.select("doc_id", "text"), out="n_tokens", file=file, lengths=True))
    packed = pack(pieces(measured, capacity), capacity)
    cols = ["doc_id", "piece_no", "start_token", "n_tokens", "container_id", "fill"]
    zero = F.lit(0).cast("int")
    empty = measured.where("n_tokens = 0").select(
        "doc_id", zero.alias("piece_no"), zero.alias("start_token"), zero.alias("n_tokens"),
        F.lit(None).cast("string").alias("container_id"), F.lit(None).cast("int").alias("fill"),
    )
    return packed.select(*cols).unionByName(empty)

"""Byte-level BPE over whole partitions by a pair occurrence index.

The vocabulary file (a public one, whose path is a parameter) gives merges in order of rank. Texts are cut by the published
pattern; each distinct piece is encoded once per batch. All pieces of a batch stand in one linked list of symbols. An index maps each
mergeable pair to all places where it occurs. Active ranks are taken in ascending order from a heap; all places of a rank's pair are
merged in one go from left to right, the neighbouring pairs that this breaks or makes are updated, and new ranks join the heap. A
merge can only make pairs of higher rank (its symbol did not exist before), so each rank is taken once and the result is
that of merging piece by piece. Cost is proportional to symbols and merges, with a logarithm for ranks, also for a piece
of a million characters.

Empty and null texts give an empty list. The strings of special tokens are ordinary text. Any Unicode text is valid.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: The published pattern that cuts text before merging; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces kept from batch to batch within a task, and bytes of those; more are forgotten and encoded anew.
CACHE_PIECES, CACHE_BYTES = 200_000, 16_000_000
#: Longest piece that is remembered, in bytes.
CACHE_LONGEST = 256


def path(name: str = VOCABULARY, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, name)


def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files of this kind write bytes: printable bytes stand for themselves, the others
    for the letters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merges of one file: ``rank_of[(left << 32) | right]`` and ``made[rank]``."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, letters = model["vocab"], _byte_letters()
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank_of[(ids[left] << 32) | ids[right]] = len(self.made)
            self.made.append(ids[left + right])

    def encode_pieces(self, pieces: list[bytes]) -> list[array]:
        """Ids of each piece, by one pair occurrence index over all of them."""
        symbols = array("i", [-1])
        starts = []
        byte_ids, rank_of, made = self.byte_ids, self.rank_of, self.made
        for p in pieces:
            starts.append(len(symbols))
            symbols.extend([byte_ids[b] for b in p])
            symbols.append(-1)  # pieces never merge with each other
        n = len(symbols)
        nxt, prv = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        places: dict[int, list[int]] = {}
        get = rank_of.get
        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0 and (r := get((a << 32) | b)) is not None:
                if r in places:
                    places[r].append(i)
                else:
                    places[r] = [i]
        active = [*places]
        heapq.heapify(active)
        pair_of: dict[int, tuple[int, int]] = {}
        while active:
            rank = heapq.heappop(active)
            at = places.pop(rank)
            new = made[rank]
            at.sort()
            first = second = -2
            for i in at:
                j = nxt[i]
                a, b = symbols[i], symbols[j] if j < n else -1
                # A place is stale when an earlier merge took one of its symbols; dead symbols are -2.
                if a < 0 or b < 0:
                    continue
                if first == -2:
                    if get((a << 32) | b) != rank:
                        continue
                    first, second = a, b
                elif a != first or b != second:
                    continue
                k = nxt[j]
                symbols[i], symbols[j] = new, -2
                nxt[i] = k
                prv[k] = i
                h = prv[i]
                left, right = symbols[h], symbols[k]
                if left >= 0 and (r := get((left << 32) | new)) is not None:
                    if r in places:
                        places[r].append(h)
                    else:
                        places[r] = [h]
                        heapq.heappush(active, r)
                if right >= 0 and (r := get((new << 32) | right)) is not None:
                    if r in places:
                        places[r].append(i)
                    else:
                        places[r] = [i]
                        heapq.heappush(active, r)
        out = []
        for s in starts:
            ids, i = array("i"), s
            while symbols[i] != -1:
                ids.append(symbols[i])
                i = nxt[i]
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


class Encoder:
    """Encodes batches of texts, remembering the pieces of earlier batches up to a bound."""

    def __init__(self, file: str | None = None):
        self.vocabulary = vocabulary(file or path())
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, array] = {}
        self.bytes = 0

    def batch(self, texts: Iterable[str | None]) -> list[array]:
        cut = [self.cut(t) if t else () for t in texts]
        fresh = list({p for pieces in cut for p in pieces} - self.known.keys())
        local = dict(zip(fresh, self.vocabulary.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True))
        known, out = self.known, []
        for pieces in cut:
            ids = array("i")
            for p in pieces:
                ids.extend(local[p] if p in local else known[p])
            out.append(ids)
        for p, ids in local.items():
            if len(p) <= CACHE_LONGEST:
                known[p] = ids
                self.bytes += len(p)
        if len(known) > CACHE_PIECES or self.bytes > CACHE_BYTES:
            known.clear()
            self.bytes = 0
        return out


def _slices(batch: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that one index never spans much more than ``limit`` bytes of text."""
    at = size = 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    yield batch.slice(at)


def encode(docs: DataFrame, text: str = "text", out: str = "ids", file: str | None = None, lengths: bool = False) -> DataFrame:
    """``docs`` without ``text`` and with ``out``: the ids of the text, or with ``lengths`` their number.

    One pass without a shuffle. Other columns are carried along, whatever their names but ``out``.
    """
    import pyarrow.compute  # noqa: F401

    keep = [c for c in docs.columns if c not in (text, out)]
    schema = docs.select(*keep, F.lit(0 if lengths else None).cast("int" if lengths else "array<int>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        encoder = Encoder(file)
        for whole in batches:
            for b in _slices(whole, 0):
                ids = encoder.batch(b.column(0).to_pylist())
                if lengths:
                    made = pa.array([len(x) for x in ids], pa.int32())
                else:
                    offsets = array("i", [0])
                    flat = array("i")
                    for x in ids:
                        flat.extend(x)
                        offsets.append(len(flat))
                    made = pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], made], names=[*keep, out])

    return docs.select(F.col(text).cast("string"), *keep).mapInArrow(run, schema)

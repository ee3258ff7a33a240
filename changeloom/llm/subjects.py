"""Subject areas of threads, from few noisy labels and all texts.

*Features.* Each text is cut into sentences; words and pairs of neighbouring words are hashed into ``BUCKETS`` cells, so the model has a
fixed size whatever the corpus. Every document counts, in full.

*Complement naive Bayes.* For each subject a cell's weight is the log of its frequency in the subject over its frequency in
the complement, all other subjects together. Only clear weights (``CUT``) count, so words of no subject add no noise.

*Expectation-maximization.* Sentences of labelled threads give the first counts, weighted by how many raters named the subject. Then,
over the whole corpus: a sentence's weights and its document's own mix of subjects give its posterior; sentences below ``GATE`` are neutral; posteriors are
the counts of the next round, and labelled threads keep to what some rater named. A further class, seeded by unlabelled documents
almost without evidence, learns the talk about the sites themselves. Each round is one pass and one small aggregation.

*Calibration.* Evidence is summed per thread. A logistic model, fitted on at most ``LABELLED`` labelled threads (cross-fitted: on evidence from weights
that their own documents had no part in), turns each subject's
evidence, share and margin over site talk into an independent posterior; a subject that is only mentioned in passing has a small
share. Each thread gets the subjects above ``ACCEPT``, at most two.

Documents whose text is null or only white space get no subject, nor do threads without any evidence or mostly of site talk. Without labels or
texts the result is empty. Unknown subject codes in labels are ignored; repeated labels count once. Threads may be of any size: only
sums per thread are shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.operators import common

BUCKETS = 1 << 20
ROUNDS = 4
CUT, CAP, GATE, SHARP = 2.5, 5.0, 4.0, 2.0
ALPHA, PRIOR, SUPPORT = 0.5, 0.3, 3
#: Smoothing counts as if this many cells were in use.
CELLS = 50_000
#: An unlabelled document of at least so many sentences, of which less than this share has evidence, seeds site talk.
SEED_SENTENCES, SEED_SHARE = 5, 0.1
LABELLED = 200_000
#: Labelled threads are calibrated in so many folds, each by weights without its own documents, if there are so many threads a fold; fewer
#: are calibrated on the final weights, as a fold's rest would teach nothing.
FOLDS, FOLD_THREADS = 2, 50
ACCEPT = 0.35

#: Characters of a batch that are worked on at once.
CHARS = 2_000_000
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base, which is odd, and of its inverse modulo 2^64."""
    up, down = (np.full(n, b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point whether it is a letter, and whether it may stand in a word (letter, mark or apostrophe)."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    word = letter | np.array([k == "M" for k in kinds])
    word[ord("'")] = True
    return letter, word


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """Of code points up to U+3000: 1 for white space, 2 for an end of a clause, 4 for an end of a line."""
    return np.array([chr(c).isspace() + 2 * (chr(c) in ".!?:;)") + 4 * (chr(c) in "\n\r") for c in range(0x3002)], dtype=np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Cell of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int32)


def cells_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, cells of each text, ends, sentences of each text): cells of all sentences one after another; ends count from the text's start.

    A sentence ends at a line's end, or at white space after one of ``.!?:;)``. A word is a letter and what follows of letters, marks and
    apostrophes. Words and pairs of neighbouring words of one sentence are hashed, all texts at once.
    """
    low = [(t or "").replace("\u200b", "").lower() for t in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in low])[:-1]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter, word = _tables()
    none = np.zeros(0, np.int64)
    zero = np.zeros(len(texts), np.int64)
    inside = np.concatenate([[False], word[codes], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, stop = edge[::2].copy(), edge[1::2]
    odd = np.flatnonzero(~letter[codes[first]])  # begins with a mark or an apostrophe, which is no part of the word
    for n in odd.tolist():
        later = np.flatnonzero(letter[codes[first[n] : stop[n]]])
        first[n] += later[0] if len(later) else stop[n] - first[n]
    real = first < stop
    first, stop = first[real], stop[real]
    if not len(first):
        return none.astype(np.int32), zero, none.astype(np.int32), zero
    # The hash of a word is a difference of running sums, shifted back to the text's start.
    up, down = _powers(1 << int(len(codes)).bit_length())
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    hashed = (sums[stop] - sums[first]) * down[first]
    marks = _marks()[np.minimum(codes, 0x3001)]
    breaks = marks >= 4
    breaks[1:] |= (marks[1:] & 1).astype(bool) & (marks[:-1] == 2)
    sentence = np.cumsum(breaks, dtype=np.int32)[first]
    joined = sentence[1:] == sentence[:-1]
    cells = np.empty(len(first) + int(joined.sum()), np.int32)
    here = np.arange(len(first)) + np.concatenate([[0], np.cumsum(joined)])
    cells[here] = _mixed(hashed)
    cells[here[:-1][joined] + 1] = _mixed(hashed[:-1][joined] * np.uint64(0xD6E8FEB86659FD93) + hashed[1:][joined])
    last = np.concatenate([~joined, [True]])
    ends = np.concatenate([here[1:], [len(cells)]])[last]
    text = np.searchsorted(starts, first[last], side="right") - 1
    sentences = np.bincount(text, minlength=len(texts))
    upto = np.concatenate([[0], ends])[np.cumsum(sentences)]
    before = np.concatenate([[0], upto[:-1]])
    return cells, upto - before, (ends - before[text]).astype(np.int32), sentences


def _list(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, thread, blank, cells, ends) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            size = np.cumsum([len(t or "") for t in texts]) // CHARS
            for n in np.unique(size):
                lo, hi = (int(x) for x in (np.searchsorted(size, n), np.searchsorted(size, n, side="right")))
                some = texts[lo:hi]
                cells, per_text, ends, sentences = cells_of(some)
                blank = pa.array([t is None or not t.strip() for t in some], pa.bool_())
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), blank, _list(cells, per_text), _list(ends, sentences)], names=["doc_id", "thread", "blank", "cells", "ends"]
                )

    narrow = docs.select("doc_id", F.coalesce("question_id", "doc_id").alias("thread"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, thread bigint, blank boolean, cells array<int>, ends array<int>")


def thread_labels(docs: DataFrame, labels: DataFrame, codes: list[str]) -> DataFrame:
    """(thread, named): for each subject the share of the thread's ratings that named it; at most LABELLED threads."""
    threads = docs.select("doc_id", F.coalesce("question_id", "doc_id").alias("thread"))
    known = labels.where(F.col("subject_code").isin(codes)).select("doc_id", "rater_id", "subject_code").distinct()
    rated = known.join(threads, "doc_id")
    n = F.count_distinct("doc_id", F.coalesce("rater_id", F.lit(-1)))
    named = F.array(*[(F.count_if(F.col("subject_code") == c) / n).cast("float") for c in codes])
    return rated.groupBy("thread").agg(named.alias("named"), n.cast("float").alias("ratings")).orderBy("thread").limit(LABELLED)


class _Batch:
    """The sentences of an Arrow batch as flat arrays."""

    def __init__(self, b: pa.RecordBatch):
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        self.cells = col["cells"].flatten().to_numpy(zero_copy_only=False)
        ends = col["ends"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        per_doc = np.diff(col["ends"].offsets.to_numpy())
        cells_per_doc = np.diff(col["cells"].offsets.to_numpy()).astype(np.int64)
        self.docs = len(per_doc)
        self.doc = np.repeat(np.arange(self.docs), per_doc)
        base = np.concatenate([[0], np.cumsum(cells_per_doc)[:-1]]) if self.docs else np.zeros(0, np.int64)
        stop = ends + base[self.doc]
        self.sentences = len(stop)
        self.stop = stop
        self.start = np.concatenate([[0], stop[:-1]]) if self.sentences else stop
        self.size = stop - self.start
        self.n_sentences = per_doc

    def cells_in(self, sentences: np.ndarray) -> np.ndarray:
        """Cells of some sentences, one sentence after another."""
        first, size = self.start[sentences], self.size[sentences]
        return self.cells[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _expect(b: _Batch, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentences with any evidence, their posterior by class, their gate, and the sums per document); other sentences are neutral."""
    weights, used = model
    k = weights.shape[1]
    some = np.flatnonzero(used[b.cells])
    if not len(some):
        return np.zeros(0, np.int64), np.zeros((0, k)), np.zeros(0), np.zeros((b.docs, k))
    row = np.searchsorted(b.stop, some, side="right")
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    at, score = row[new], np.add.reduceat(weights[b.cells[some]], new, axis=0).astype(np.float64)
    gate = 1 / (1 + np.exp(np.clip(SHARP * (GATE - score.max(axis=1)), -50, 50)))
    doc = b.doc[at]
    change = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))

    def posterior(mix: np.ndarray) -> np.ndarray:
        z = score + np.log(mix)[doc]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True) * gate[:, None]

    def per_doc(p: np.ndarray) -> np.ndarray:
        out = np.zeros((b.docs, k))
        out[doc[change]] = np.add.reduceat(p, change, axis=0)
        return out

    mix = per_doc(posterior(np.full((b.docs, k), 1 / k))) + PRIOR
    post = posterior(mix / mix.sum(axis=1, keepdims=True))
    return at, post, gate, per_doc(post)


def _named(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document whether its thread is labelled, and the shares of the ratings with a zero for site talk."""
    rows = b.column(b.schema.get_field_index("named")).to_pylist()
    out = np.zeros((len(rows), k))
    for i, r in enumerate(rows):
        if r is not None:
            out[i, : k - 1] = r
    return np.array([r is not None for r in rows], dtype=bool), out


def _fold_of(b: pa.RecordBatch, folds: int) -> np.ndarray:
    """Fold of each document, by its thread."""
    thread = b.column(b.schema.get_field_index("thread"))
    return (thread.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(_BASE) >> np.uint64(40)) % np.uint64(folds) if folds > 1 else np.zeros(b.num_rows, np.uint64)


#: A class's share of a sentence below it is left out of the counts.
LEAST = 1e-2


def _counts(rows: DataFrame, k: int, model, seeding: bool, everything: np.ndarray | None, folds: int = 1) -> tuple[np.ndarray, np.ndarray | None]:
    """Expected counts (folds x BUCKETS x k, without the first if there is one fold) over ``rows``, and how often each cell occurs. ``model`` broadcasts the weights; None counts by labels alone.

    What neutral sentences add to all classes alike follows from how often a cell occurs at all, which is counted once (``everything``), and from
    what the classes have of it. So a round looks at the cells of sentences with evidence, and a task hands on few numbers a cell.
    """
    first, wide = model is not None and everything is None, folds * (k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = None if model is None else _dense(model.value, k)
        total = np.zeros((wide, BUCKETS), dtype=np.float32)  # of each fold by class; then, in the first round, all occurrences

        def add(c: int, b: _Batch, sentences: np.ndarray, weight: np.ndarray) -> None:
            if len(sentences):
                total[c] += np.bincount(b.cells_in(sentences), weights=np.repeat(weight, b.size[sentences]), minlength=BUCKETS)

        for batch in batches:
            if not batch.num_rows:
                continue
            b = _Batch(batch)
            labelled, named = _named(batch, k)
            if dense is None:
                at = np.arange(b.sentences)
                share = (named / np.maximum(named.sum(axis=1, keepdims=True), 1e-9))[b.doc]
            else:
                at, share, gate, evidence = _expect(b, dense)
                m = labelled[b.doc[at]]
                share[m] *= 0.05 + named[b.doc[at[m]]]
                if seeding:
                    quiet = (evidence[:, :-1].sum(axis=1) < SEED_SHARE * b.n_sentences) & ~labelled & (b.n_sentences >= SEED_SENTENCES)
                    q = quiet[b.doc[at]]
                    share[q, -1] = np.maximum(share[q, -1], 1 - gate[q])
                    rest = quiet[b.doc]
                    rest[at] = False  # without any evidence: site talk as a whole
                    rest = np.flatnonzero(rest)
                    add(k - 1, b, rest, np.ones(len(rest)))
                if first and folds == 1:
                    total[k] += np.bincount(b.cells, minlength=BUCKETS)
            fold = _fold_of(batch, folds)[b.doc]
            for f in range(folds):
                mine = fold == f
                if first and folds > 1:
                    own = np.flatnonzero(mine)
                    add(f * (k + 1) + k, b, own, np.ones(len(own)))
                for c in range(k):
                    some = np.flatnonzero((share[:, c] >= LEAST) & mine[at])
                    add(f * (k + 1) + c, b, at[some], share[some, c])
        for c in range(wide):
            used = np.flatnonzero(total[c])
            for lo in range(0, len(used), 200_000):
                u = used[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array((u * wide + c).astype(np.int64)), pa.array(total[c, u])], names=["at", "n"])

    summed = rows.mapInArrow(run, "at bigint, n float").groupBy("at").agg(F.sum("n").cast("float").alias("n"))
    table = summed.toArrow()  # at most BUCKETS x (k + 1) numbers a fold
    out = np.zeros(BUCKETS * wide, dtype=np.float32)
    out[table.column("at").to_numpy()] = table.column("n").to_numpy()
    if folds > 1:
        parts = out.reshape(BUCKETS, folds, k + 1)
        return np.stack([p[:, :k] + (np.maximum(p[:, k] - p[:, :k].sum(axis=1), 0) / k)[:, None] for p in parts.transpose(1, 0, 2)]), None
    out = out.reshape(BUCKETS, k + 1)
    if model is None:
        return out[:, :k], None
    everything = out[:, k].copy() if first else everything
    neutral = np.maximum(everything - out[:, :k].sum(axis=1), 0) / k
    return out[:, :k] + neutral[:, None], everything


def _weights(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clear complement weights as (cell, class, weight); most are zero and left out."""
    n, cell_n = counts.sum(axis=0, dtype=np.float64), counts.sum(axis=1, dtype=np.float64)
    cells, classes, values = [], [], []
    for c in range(counts.shape[1]):
        inside = (counts[:, c] + 0.2 * ALPHA) / (n[c] + 0.2 * ALPHA * CELLS)
        outside = (cell_n - counts[:, c] + ALPHA) / (n.sum() - n[c] + ALPHA * CELLS)
        w = np.log(inside) - np.log(np.maximum(outside, 1e-300))
        at = np.flatnonzero((w > CUT) & (cell_n >= SUPPORT))
        cells.append(at.astype(np.int32))
        classes.append(np.full(len(at), c, dtype=np.int32))
        values.append(np.minimum(w[at], CAP).astype(np.float32))
    return np.concatenate(cells), np.concatenate(classes), np.concatenate(values)


def _dense(sparse: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by cell and class (4 MB a class), and which cells have any."""
    out, used = np.zeros((BUCKETS, k), dtype=np.float32), np.zeros(BUCKETS, dtype=bool)
    out[sparse[0], sparse[1]] = sparse[2]
    used[sparse[0]] = True
    return out, used


def _evidence(rows: DataFrame, k: int, model, folds: int = 1) -> DataFrame:
    """(doc_id, thread, blank, e0 .. ek-1): evidence of each class in each document; ``model`` has one set of weights a fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [_dense(m, k) for m in model.value]
        for batch in batches:
            if batch.num_rows:
                b, fold = _Batch(batch), _fold_of(batch, folds)
                e = np.zeros((batch.num_rows, k))
                for f in range(folds):
                    e[fold == f] = _expect(b, dense[f])[3][fold == f]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], *[pa.array(np.ascontiguousarray(e[:, c])) for c in range(k)]],
                    names=["doc_id", "thread", "blank", *[f"e{i}" for i in range(k)]],
                )

    return rows.select("doc_id", "thread", "blank", "cells", "ends").mapInArrow(
        run, "doc_id bigint, thread bigint, blank boolean, " + ", ".join(f"e{i} double" for i in range(k))
    )


def _design(e, n, site, log) -> list:
    """Inputs of the calibration; for numpy arrays and for Columns alike."""
    return [log((e + 0.3) / (n * 0.02 + 0.3)), log((e + 0.1) / (n - e + 0.1)), log(n + 1), log((e + 0.3) / (site + 0.3))]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-7:
            break
    return beta


def _calibrate(threads: DataFrame, labels: DataFrame, k: int) -> np.ndarray | None:
    rows = threads.join(labels, "thread").toArrow()
    if rows.num_rows == 0:
        return None
    e = np.stack([rows.column(f"e{i}").to_numpy() for i in range(k)], axis=1)
    named = np.array(rows.column("named").to_pylist())
    ratings = rows.column("ratings").to_numpy()
    n, site = e[:, :-1].sum(axis=1), e[:, -1]
    x = np.concatenate([np.stack([np.ones(len(e)), *_design(e[:, c], n, site, np.log)], axis=1) for c in range(k - 1)])
    return logistic(x, np.concatenate([named[:, c] for c in range(k - 1)]), np.tile(ratings, k - 1))


def posteriors(docs: DataFrame, labels: DataFrame, codes: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """(evidence per document, threads with an array ``posterior`` of (p, subject_code)); None without usable labels."""
    k, sc = len(codes) + 1, docs.sparkSession.sparkContext
    named = common.checkpoint(thread_labels(docs, labels, codes))
    rows = features(docs).join(common.broadcast_if_small(named.select("thread", "named")), "thread", "left")
    rows = common.checkpoint(rows.select("doc_id", "thread", "blank", "cells", "ends", "named"))
    counts, everything = _counts(rows.where("named is not null"), k, None, False, None)
    model = sc.broadcast(_weights(counts))
    before = model
    for r in range(ROUNDS):
        counts, everything = _counts(rows, k, model, r < 2, everything)
        before, model = model, sc.broadcast(_weights(counts))
    sums = lambda df: df.groupBy("thread").agg(*[F.sum(f"e{i}").alias(f"e{i}") for i in range(k)])
    scored = common.checkpoint(_evidence(rows, k, sc.broadcast([model.value])))
    threads = sums(scored)
    judged = threads
    if named.count() >= FOLDS * FOLD_THREADS:
        # Evidence of each fold of labelled threads under weights from which all counts of the fold's own documents were taken out.
        labelled = rows.where("named is not null")
        own, _ = _counts(labelled, k, before, ROUNDS <= 2, None, FOLDS)
        judged = sums(_evidence(labelled, k, sc.broadcast([_weights(np.maximum(counts - c, 0)) for c in own]), FOLDS))
    beta = _calibrate(judged, named, k)
    if beta is None:
        return None
    n: Column = sum((F.col(f"e{i}") for i in range(1, k - 1)), F.col("e0"))
    site = F.col(f"e{k - 1}")

    def p(i: int) -> Column:
        terms = _design(F.col(f"e{i}"), n, site, F.log)
        return 1 / (1 + F.exp(-sum((F.lit(float(b)) * t for b, t in zip(beta[1:], terms, strict=True)), F.lit(float(beta[0])))))

    each = F.array(*[F.struct(p(i).alias("p"), F.col(f"e{i}").alias("e"), F.lit(c).alias("subject_code")) for i, c in enumerate(codes)])
    return scored, threads.select("thread", each.alias("posterior"), n.alias("n"), site.alias("site"))


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, subject_code): every subject of the thread of each document that has a text."""
    spark = docs.sparkSession
    codes = [r[0] for r in subjects.where("subject_code is not null").select("subject_code").distinct().orderBy("subject_code").collect()]
    made = posteriors(docs, labels, codes) if codes else None
    if made is None:
        return spark.createDataFrame([], "doc_id bigint, subject_code string")
    scored, threads = made
    best = F.sort_array("posterior", asc=False)
    clear = F.filter(best, lambda x: x["p"] >= accept)
    only = F.filter(F.slice(best, 1, 1), lambda x: (x["e"] >= 0.8) & (F.col("site") < 0.5))
    chosen = F.when(F.size(clear) > 0, F.slice(clear, 1, 2)).otherwise(only)
    about = threads.where(F.col("n") > F.col("site")).select("thread", F.explode(chosen).alias("s")).select("thread", "s.subject_code")
    return scored.where("not blank").select("doc_id", "thread").join(about, "thread").select("doc_id", "subject_code")

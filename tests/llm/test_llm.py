"""Text operators: against the public library, invariants, and held-out labels."""

from __future__ import annotations

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changeloom.llm import bpe, pack, subjects

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.path()), reason="no vocabulary here")


def odd_texts(n=400):
    rnd = random.Random(5)
    alphabet = ["a", "e", " ", "  ", "\n", "'s", "'ll", "the", "ing", "1", "42", ".", "—", "é", "ß", "漢", "🙂", "​", " ", "<|endoftext|>", "\t"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)] + ["", " ", "aaaa" * 30_000, "x" * 9999, "ab " * 5000]


@needs_vocabulary
def test_ids_equal_the_library_s(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.path())
    t.encode_special_tokens = True
    texts = odd_texts()
    want = {i: e.ids for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}
    df = spark.createDataFrame([*enumerate(texts), (10**6, None)], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got.pop(10**6) == [] and got == want
    lengths = {r.doc_id: r.n for r in bpe.encode(df, out="n", lengths=True).collect()}
    assert lengths == {i: len(x) for i, x in want.items()} | {10**6: 0}


@needs_vocabulary
def test_ids_round_trip():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(bpe.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts(100)
    assert [encoding.decode(list(ids)) for ids in bpe.Encoder().batch(texts)] == texts


@needs_vocabulary
def test_bounded_memory_of_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    e = bpe.Encoder()
    assert e.batch(["one two three four five six seven"]) == e.batch(["one two three four five six seven"])
    assert len(e.known) <= 5


def items(spark, sizes):
    rows = [(i, 0, 0, s) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id bigint, piece_no int, start_token int, n_tokens int")


def containers(out):
    held = collections.defaultdict(list)
    for r in out:
        held[r.container_id].append(r.n_tokens)
        assert r.fill <= pack.CAPACITY
    for c, sizes in held.items():
        assert sum(sizes) == next(r.fill for r in out if r.container_id == c)
    return held


def test_packing_loses_nothing_and_wastes_little(spark):
    rnd = random.Random(1)
    sizes = [min(2047, int(rnd.lognormvariate(5, 1))) + 1 for _ in range(3000)]
    out = pack.pack(items(spark, sizes).repartition(8), chunk=500).collect()
    assert sorted(r.n_tokens for r in out) == sorted(sizes) and len({r.doc_id for r in out}) == len(sizes)
    held = containers(out)
    assert sum(sizes) / len(held) / pack.CAPACITY > 0.97


@pytest.mark.parametrize("sizes", [[], [1], [2048] * 5, [1025] * 50, [2047, 1] * 20, [1] * 5000])
def test_packing_corner_cases(spark, sizes):
    out = pack.pack(items(spark, sizes).repartition(4), chunk=20).collect()
    held = containers(out)
    assert sorted(r.n_tokens for r in out) == sorted(sizes)
    if sizes == [1025] * 50:
        assert len(held) == 50
    if sizes == [2047, 1] * 20:
        assert len(held) <= 24


def test_best_fit_takes_the_fullest():
    assert len(set(pack.best_fit(np.array([6, 5, 4, 5]), 10).tolist())) == 2
    assert pack.best_fit(np.array([], dtype=np.int64), 10).tolist() == []


@needs_vocabulary
def test_chunks_are_bounded_by_members_too():
    sizes = np.array([1, 5, 3, 9, 1, 1, 1, 20, 2])
    spans = pack._slices(sizes, 3, 8)
    assert spans == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8), (8, 9)] and pack._slices(sizes[:0], 3, 8) == []


def test_documents_are_split_only_when_too_long(spark):
    texts = [None, "", "one line", "word " * 5000, "word " * 2048, "word " * 2047]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").withColumn("fill", F.lit("clash"))
    out = pack.pack_documents(df).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert [r.container_id for r in by[0] + by[1]] == [None, None] and len(by[2]) == 1
    lengths = {i: len(ids) for i, ids in enumerate(bpe.Encoder().batch(texts))}
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in rows) == lengths[i] and len(rows) == max(1, -(-lengths[i] // pack.CAPACITY))
        assert [r.start_token for r in rows] == [k * pack.CAPACITY for k in range(len(rows))]


# Subjects

WORDS = {
    "sport": ["penalty kick", "goal keeper", "training match", "stadium gate", "referee card", "final league"],
    "music": ["violin bow", "minor chord", "sheet music", "piano pedal", "choir part", "bass line"],
    "law": ["court ruling", "lease clause", "written consent", "bond hearing", "legal notice", "appeal deadline"],
}
FILLER = ["It depends as always.", "Hope that helps.", "I searched the older posts.", "Maybe I am wrong.", "Thanks in advance."]
SITE = ["Where did my badge go?", "The preview pane is broken.", "Can a moderator reopen my question?", "Please hide signatures."]
DOCS = "doc_id bigint, text string, question_id bigint"


def corpus(n=240, seed=2):
    """Threads of one or two subjects with passing mentions, and threads about the site."""
    rnd = random.Random(seed)
    docs, truth = [], {}
    for t in range(n):
        q = t * 10 + 1
        about = [] if t % 12 == 0 else rnd.sample(sorted(WORDS), 2 if t % 6 == 1 else 1)
        for k in range(3):
            sentences = [rnd.choice(FILLER) for _ in range(3)]
            sentences += [f"Check the {rnd.choice(WORDS[about[i % len(about)]])} first." for i in range(5)] if about else [rnd.choice(SITE) for _ in range(4)]
            if rnd.random() < 0.15:
                sentences.append(f"(My cousin talks about the {rnd.choice(WORDS[rnd.choice(sorted(WORDS))])}.)")
            rnd.shuffle(sentences)
            text = "Yes." if k == 2 and t % 3 == 0 else " ".join(sentences)
            docs.append((q + k, text, None if k == 0 else q))
        truth[q] = set(about)
    docs += [(9001, None, 1), (9002, "  \n", 1), (9003, None, None)]
    return docs, truth


def test_subjects_of_threads(spark):
    docs, truth = corpus()
    rnd = random.Random(9)
    labels = []
    for q, about in truth.items():
        if about and rnd.random() < 0.5:
            for rater in range(2):
                named = {s for s in about if rnd.random() < 0.85} or {sorted(about)[0]}
                if rnd.random() < 0.05:
                    named = {rnd.choice(sorted(WORDS))}
                labels += [(q, rater, s) for s in named]
    df = spark.createDataFrame(docs, DOCS).withColumn("thread", F.lit("clash")).repartition(3)
    lab = spark.createDataFrame([*labels, (1, None, "nonsense"), (10**9, 1, "law")], "doc_id bigint, rater_id int, subject_code string")
    codes = spark.createDataFrame([(s,) for s in WORDS] + [(None,)], "subject_code string")
    got = collections.defaultdict(set)
    for r in subjects.subjects_of(df, lab, codes).collect():
        assert r.subject_code not in got[r.doc_id]
        got[r.doc_id].add(r.subject_code)
    assert not {9001, 9002, 9003} & {*got}
    rated = {d for d, _, _ in labels}
    hit = wrong = missed = 0
    for d, text, q in docs:
        if text and text.strip() and (q or d) not in rated:
            want = truth[q or d]
            hit, wrong, missed = hit + len(want & got[d]), wrong + len(got[d] - want), missed + len(want - got[d])
    assert 2 * hit / (2 * hit + wrong + missed) > 0.95


def test_subjects_without_labels_or_texts(spark):
    docs = spark.createDataFrame(corpus(12)[0], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, rater_id int, subject_code string")
    codes = spark.createDataFrame([("law",), ("music",)], "subject_code string")
    assert subjects.subjects_of(docs, none, codes).count() == 0
    assert subjects.subjects_of(docs.where("false"), none, codes).count() == 0
    assert subjects.subjects_of(docs, none, codes.where("false")).count() == 0


def test_very_long_text_and_repeated_rows(spark):
    long = "Check the violin bow first. " * 20_000
    rows = [(1, long, None), (1, long, None), (2, "Check the court ruling first. " * 5, None), (3, "Check the violin bow first. " * 6, None)]
    lab = spark.createDataFrame([(3, 1, "music"), (2, 1, "law")], "doc_id bigint, rater_id int, subject_code string")
    codes = spark.createDataFrame([("law",), ("music",)], "subject_code string")
    got = subjects.subjects_of(spark.createDataFrame(rows, DOCS), lab, codes).collect()
    assert {r.subject_code for r in got if r.doc_id == 1} <= {"music"}


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {"p7_ids", "p8_packed", "p9_found"} <= set(entry.queries())

"""Redelivery, drift, ledger, tree aggregation, change feed and compaction on small hand-made stores."""

from __future__ import annotations

import datetime
import decimal
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changeloom.functions import lsn
from changeloom.operators import changefeed, compact, drift, ledger, redelivery, treeagg

LOG = (
    "rid bigint, s3_uri string, row_no int, op string, commit_lsn string, lsn string, row_key string, old_key string, row_data string, sink_meta string, "
    "sink_processed_at timestamp_ntz"
)
MANIFEST = (
    "file_id bigint, epoch bigint, source_schema string, source_table string, s3_uri string, kind string, row_count bigint, lsn_start string, lsn_end string, "
    "schema_version bigint, status string, reload_id bigint, created_at timestamp_ntz"
)


def change(rid, key, at, op="i", commit=None, table="t", epoch=1, old=None, data=None, unset=(), uri="s3://b/1/p/t/0000000000000001-a.parquet", xid=1, version=1):
    meta = {"epoch": epoch, "source_schema": "p", "source_table": table, "xid": xid, "schema_version": version, "unchanged_toast": list(unset)}
    text = at if isinstance(at, str) or at is None else f"{at:016X}"
    c = commit if isinstance(commit, str) or commit is None and at is None else f"{(at if commit is None else commit):016X}" if not isinstance(at, str) else at
    return (rid, uri, 1, op, c, text, key, old, json.dumps(data) if data is not None else None, json.dumps(meta), None)


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def manifest(spark, rows):
    return spark.createDataFrame(rows, MANIFEST)


def file(file_id, uri="s3://b/1/p/t/0000000000000001-a.parquet", kind="stream", end="1", status="ready", created=None, table="t", epoch=1):
    return (file_id, epoch, "p", table, uri, kind, None, end, end, None, status, None, created)


# Messages delivered more than once


def test_repeats_of_rows(spark):
    rows = [
        change(5, "a", "0/10"), change(3, "a", "0000000000000010"), change(9, "a", "10"), change(4, "b", 16), change(6, None, 32, "t"), change(7, None, 32, "t"),
        change(8, "a", 16, table="u"), change(10, "a", 16, epoch=2), change(11, "c", None), change(12, "c", None),
    ]
    got = {tuple(r) for r in redelivery.repeated_rows(log(spark, rows)).collect()}
    assert got == {(3, 5), (3, 9), (6, 7), (11, 12)}


def test_repeats_against_brute_force_with_a_hot_message(spark):
    rnd = random.Random(7)
    rows = [change(i, str(rnd.randrange(60)), rnd.randrange(40), table=rnd.choice("tu")) for i in range(1500)] + [change(2000 + i, "hot", 5) for i in range(700)]
    first: dict = {}
    want = set()
    for r in sorted(rows):
        key = (r[6], r[5], json.loads(r[9])["source_table"])
        if key in first:
            want.add((first[key], r[0]))
        else:
            first[key] = r[0]
    df = log(spark, rows)
    assert {tuple(r) for r in redelivery.repeated_rows(df).collect()} == want
    assert {r.rid for r in redelivery.once(df).collect()} == set(first.values())


def test_no_repeats_in_an_empty_log(spark):
    assert redelivery.repeated_rows(log(spark, [])).count() == 0
    assert redelivery.repeated_files(manifest(spark, [])).count() == 0


def test_repeated_registrations(spark):
    uri = "s3://b/1/p/t/0000000000000001-a.parquet"
    df = manifest(spark, [file(4, uri), file(2, uri.replace("s3:", "S3A:")), file(7, uri.replace("b/1", "b//1")), file(1, uri.replace("-a", "-b")), file(9, None)])
    assert {tuple(r) for r in redelivery.repeated_files(df).collect()} == {(2, 4), (2, 7)}


def test_filter_has_no_false_negatives(spark):
    ids = spark.range(5000).select(F.col("id"), F.format_string("%016X", F.col("id") * 1000).alias("lsn"))
    rows = redelivery.addressed(ids, ["id"], F.col("lsn"))
    rows = redelivery.located(rows, redelivery.segment_counts(rows))
    assert redelivery.screen(rows, redelivery.build_filter(rows)).count() == 5000
    # Against repeats only, nearly nothing of distinct ids passes.
    assert redelivery.screen(rows, redelivery.build_filter(rows, at_least=2)).count() < 500


def test_batches_against_a_store(spark, tmp_path):
    store = redelivery.SeenStore(spark, f"file://{tmp_path}/seen", ["k"])
    batch = lambda ks: spark.createDataFrame([(i, k, f"{k:016X}") for i, k in enumerate(ks)], "rid bigint, k bigint, lsn string")
    seen: set = set()
    for n, ks in enumerate([[1, 2, 2, 3], [3, 4, 1], [4, 5, 5, 9]]):
        fresh = store.fresh(batch(ks), "rid", F.col("lsn"), n)
        assert sorted(r.k for r in fresh.collect()) == sorted({*ks} - seen)
        store.remember(fresh, n)
        # The same batch again, as after a crash: its own folder does not count and is overwritten.
        again = store.fresh(batch(ks), "rid", F.col("lsn"), n)
        assert sorted(r.k for r in again.collect()) == sorted({*ks} - seen)
        seen |= {*ks}


def test_a_restarted_store_knows_its_batches(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/seen"
    batch = lambda ks: spark.createDataFrame([(i, k, f"{k << 24:016X}") for i, k in enumerate(ks)], "rid bigint, k bigint, lsn string")
    fresh = lambda store, ks, n: store.fresh(batch(ks), "rid", F.col("lsn"), n)
    first = redelivery.SeenStore(spark, root, ["k"], keep=2)
    assert first.entries() == []
    for n, ks in enumerate([[1, 2], [3], [4], [6]]):  # merged on the way
        first.remember(fresh(first, ks, n), n)
    with monkeypatch.context() as m:  # stopped before the last batch was stored whole
        m.setattr(first, "_index", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            first.remember(fresh(first, [7], 4), 4)
    second = redelivery.SeenStore(spark, root, ["k"])
    assert sorted(b for e in second.entries() for b in e["batches"]) == [0, 1, 2, 3] and len(second.entries()) <= 2
    assert sorted(r.k for r in fresh(second, [1, 3, 4, 5, 6, 7], 4).collect()) == [5, 7]
    plan = second.stored(second._rows(batch([1, 2]), F.col("lsn")), second.entries())._jdf.queryExecution().toString()
    assert "PartitionFilters: [_group" in plan


def test_empty_batches_and_null_identifiers(spark, tmp_path):
    store = redelivery.SeenStore(spark, f"file://{tmp_path}/seen", ["k", "epoch"])
    batch = lambda rows: spark.createDataFrame(rows, "rid bigint, k bigint, epoch string, lsn string, _h string")
    store.remember(store.fresh(batch([]), "rid", F.col("lsn"), 0), 0)
    first = store.fresh(batch([(1, None, "a", None, "clash"), (2, None, "a", None, ""), (3, 7, None, "0", None)]), "rid", F.col("lsn"), 1)
    assert sorted(r.rid for r in first.collect()) == [1, 3]
    store.remember(first, 1)
    again = store.fresh(batch([(4, None, "a", None, ""), (5, 7, None, "0", ""), (6, 7, "b", "0", "")]), "rid", F.col("lsn"), 2)
    assert [r.rid for r in again.collect()] == [6]
    assert store.fresh(batch([]), "rid", F.col("lsn"), 2).count() == 0


# Schemas that drift


def columns(*names, kind="text"):
    return [(n, kind if isinstance(kind, str) else kind[i], i + 1) for i, n in enumerate(names)]


def test_compare_versions():
    old = [("id", "int8", 1), ("name", "text", 2), ("qty", "int4", 3), ("gone", "bool", 4)]
    new = [("id", "int8", 1), ("full_name", "text", 2), ("qty", "int8", 3), ("came", "date", 5)]
    report = sorted(c for c in drift.compare(old, new) if c[0] != "step")
    assert report == [("added", "came", None), ("removed", "gone", "gone"), ("renamed", "full_name", "name"), ("retyped", "qty", "qty")]
    assert {(was, to) for kind, to, was in drift.compare(old, new) if kind == "step"} == {("name", "full_name"), ("gone", None)}
    assert drift.compare([], new) == [("added", n, None) for n, _, _ in new]
    assert drift.compare(old, old) == []


def test_flooding_prefers_like_fields():
    old = [("id", "int8", 1), ("customer_name", "text", 2), ("note", "text", 3)]
    new = [("id", "int8", 1), ("cust_name", "text", 2), ("remark", "text", 3)]
    score = drift.flood(old, new)
    assert score[1, 1] > score[1, 2] and score[2, 2] > score[2, 1] and score[0, 0] == score.max()


def test_values_follow_a_column_whose_place_another_took():
    old = [("id", "int8", 1), ("customer_name", "text", 2), ("qty", "int4", 3)]
    new = [("id", "int8", 1), ("note", "text", 2), ("quantity", "int8", 3), ("customer_nm", "text", 4)]
    got = drift.compare(old, new)
    assert {(was, to) for kind, to, was in got if kind == "step"} == {("customer_name", "customer_nm"), ("qty", "quantity")}
    # The report keeps its own rule: same place and type.
    assert {c for c in got if c[0] != "step"} == {("renamed", "note", "customer_name"), ("added", "customer_nm", None), ("added", "quantity", None), ("removed", "qty", "qty")}


def test_scores_decide(monkeypatch):
    """With noise in place of the flooded scores both the report and the correspondences change; with the scores they equal the rule."""
    rnd = random.Random(5)
    noise = np.random.default_rng(5)
    kinds = ["int4", "text", "bool", "varchar(20)", "numeric(10,2)"]
    differ = [0, 0]
    for _ in range(60):
        old = [(f"f{k}_{rnd.choice('abcdef') * 3}", rnd.choice(kinds), k) for k in range(1, rnd.randrange(4, 12))]
        new = [(n if rnd.random() > 0.25 else f"g{p}_{rnd.choice('uvwxyz') * 4}", t if rnd.random() > 0.1 else rnd.choice(kinds), p) for n, t, p in old if rnd.random() > 0.1]
        new += [(f"h{k}", rnd.choice(kinds), len(old) + 1 + k) for k in range(rnd.randrange(3))]
        before, after = {f[0] for f in old}, {f[0] for f in new}
        moved = {(x[0], y[0]) for x in old for y in new if x[1:] == y[1:] and x[0] not in after and y[0] not in before}
        got = drift.compare(old, new)
        assert {(was, f) for kind, f, was in got if kind == "renamed"} == moved
        with monkeypatch.context() as m:
            m.setattr(drift, "flood", lambda a, b: noise.random((len(a), len(b))))
            other = drift.compare(old, new)
        for i, step in enumerate((False, True)):
            differ[i] += {c for c in got if (c[0] == "step") == step} != {c for c in other if (c[0] == "step") == step}
    assert min(differ) > 20


def test_drift_of_files(spark):
    uri = "s3://b/1/p/t/00000000000000{:02}-a.parquet"
    rows = [change(i, "a", i, uri=uri.format(i), version=v) for i, v in enumerate([1, 1, 3], start=1)]
    files = manifest(spark, [file(i, uri.format(i)) for i in (1, 2, 3)])
    staged = spark.createDataFrame(
        [(1, 1, "id", "int4", True), (2, 1, " ID ", "integer", True), (1, 2, "n", "numeric(8,2)", False), (2, 2, "N", "decimal(8, 2)", False), (2, 3, None, "text", False),
         (3, 1, "id", "int4", True), (3, 2, "n", "numeric(9,2)", False), (3, 3, "more", "text", False)],
        "file_id bigint, pos int, col_name string, col_type string, is_key boolean",
    )
    got = {(r.schema_version, r.drift, r.field) for r in drift.changes(log(spark, rows), files, staged).collect()}
    assert got == {(3, "retyped", "n"), (3, "added", "more")}


def test_unified_rows_take_the_newest_names(spark):
    uri = "s3://b/1/p/t/00000000000000{:02}-a.parquet"
    data = [{"id": 1, "Name ": "x", "n": 5}, {"id": 2, "full_name": None, "n": "bad"}]
    rows = [change(i + 1, str(i), i, uri=uri.format(i), version=i + 1, data=d) for i, d in enumerate(data)] + [change(9, None, 9, "t", uri=uri.format(0))]
    files = manifest(spark, [file(i, uri.format(i)) for i in (0, 1)])
    staged = spark.createDataFrame(
        [(0, 1, "id", "int4", True), (0, 2, "name", "text", False), (0, 3, "n", "int4", False), (1, 1, "id", "int4", True), (1, 2, "full_name", "text", False), (1, 3, "n", "int4", False)],
        "file_id bigint, pos int, col_name string, col_type string, is_key boolean",
    )
    out = drift.unified(log(spark, rows), files, staged)
    got = {r.rid: r.fields for r in out.collect()}
    assert got == {1: {"id": "1", "full_name": "x", "n": "5"}, 2: {"id": "2", "full_name": None, "n": "bad"}, 9: None}
    typed = {r.rid: (r.n, r.misfits) for r in drift.typed(out, {"id": "int4", "n": "int4"}).collect()}
    assert typed[1] == (5, []) and typed[2] == (None, ["n"])


def versions(spark, *names):
    """Log URIs, manifest and footers of one file per version, each with the given fields."""
    uri = "s3://b/1/p/t/000000000000000{}-v.parquet"
    staged = [(v, i, n, "text", i == 1) for v, fields in enumerate(names, start=1) for i, n in enumerate(fields, start=1) if n]
    footers = spark.createDataFrame(staged, "file_id bigint, pos int, col_name string, col_type string, is_key boolean")
    return uri.format, manifest(spark, [file(v, uri.format(v)) for v in range(1, len(names) + 1)]), footers


def test_unified_keeps_removed_fields_whose_name_is_taken(spark):
    at, files, staged = versions(spark, ["id", "a", None], ["id", "a", "b"], ["id", None, "b"], ["id", None, "a"])
    data = [{"id": 1, "a": "gone1"}, {"id": 2, "a": "gone2", "b": "live2"}, {"id": 3, "b": "live3"}, {"id": 4, "a": "live4"}, {"id": 5, "a": "odd", "b": "live5"}]
    rows = [change(i, str(i), i, uri=at(v), version=v, data=d) for i, (v, d) in enumerate(zip([1, 2, 3, 4, 3], data, strict=True), start=1)]
    got = {r.rid: r.fields for r in drift.unified(log(spark, rows), files, staged).collect()}
    assert got == {
        1: {"id": "1", "a@2": "gone1"}, 2: {"id": "2", "a@2": "gone2", "a": "live2"}, 3: {"id": "3", "a": "live3"}, 4: {"id": "4", "a": "live4"},
        5: {"id": "5", "a@3": "odd", "a": "live5"},
    }
    assert {r.misfit for r in drift.unified_typed(log(spark, rows), files, staged).collect()} == {None}


def test_typed_union_of_nothing_and_of_odd_rows(spark):
    at, files, staged = versions(spark, ["id", "a"])
    assert drift.unified_typed(log(spark, []), files, staged).count() == 0
    rows = [change(1, "1", 1, uri=at(1), version=1, data={"id": None, "a": ""}), change(2, None, None, uri=at(1), version=None, data={"field": "x", "type": "y"})]
    rows += [(*change(3, "3", 3, uri="s3://other/x.parquet")[:8], "not json", None, None)]
    out = drift.unified_typed(log(spark, rows).withColumns({"field": F.lit(1), "v": F.lit(2)}), files, staged)
    assert {(r.rid, r.field, r.type, r.v_text) for r in out.collect()} == {
        (1, "id", "text", None), (1, "a", "text", ""), (2, "field", None, "x"), (2, "type", None, "y"), (3, None, None, None),
    }


def test_two_spellings_of_one_name_are_both_kept(spark):
    at, files, staged = versions(spark, ["id", "a"])
    rows = [change(1, "1", 1, uri=at(1), version=1, data={"id": 1, "a": "x", " A": "y"})]
    assert drift.unified(log(spark, rows), files, staged).first().fields == {"id": "1", "a": "x", "a#2": "y"}
    assert sorted(r.v_text for r in drift.unified_typed(log(spark, rows), files, staged).collect() if r.field == "a") == ["x", "y"]


def test_unified_query_casts_to_the_newest_types(spark, tmp_path):
    from changeloom.plans import store

    uri = "s3://b/1/p/t/000000000000000{}-v.parquet"
    names = ["id", "flag", "n", "at", "price", "tag", "doc", "old"]
    kinds = [["int4", "bool", "int4", "date", "numeric(10,2)", "text", "text", "date"], ["bigint", "int2", "text", "timestamptz", "decimal(6, 3)", "varchar(3)", "jsonb", None]]
    old = {"id": 1, "flag": True, "n": 5, "at": "2024-07-18", "price": "12723.55", "tag": "long", "doc": "no json", "old": "2024-01-01"}
    new = {"id": 2, "flag": 7, "n": "x", "at": "2024-12-01 04:18:19+02", "price": "1.5", "tag": None, "doc": '{"k":1}'}
    rows = [change(i, str(i), i, uri=uri.format(i), version=i, data=d) for i, d in enumerate([old, new], start=1)] + [change(3, None, 3, "t", uri=uri.format(1))]
    staged = [(v, i, n, k, i == 1) for v in (1, 2) for i, (n, k) in enumerate(zip(names, kinds[v - 1], strict=True), start=1) if k]
    log(spark, rows).write.parquet(f"{tmp_path}/change_log.parquet")
    manifest(spark, [file(v, uri.format(v)) for v in (1, 2)]).write.parquet(f"{tmp_path}/file_manifest.parquet")
    spark.createDataFrame(staged, "file_id bigint, pos int, col_name string, col_type string, is_key boolean").write.parquet(f"{tmp_path}/staged_columns.parquet")
    out = store.p2_unified(spark, str(tmp_path))
    values = {(r.rid, r.field): (next((r[c] for c in drift.VALUES if r[c] is not None), None), r.misfit) for r in out.collect()}
    utc = datetime.datetime
    assert values == {
        (1, "id"): (1, None), (1, "flag"): (None, "true"), (1, "n"): ("5", None), (1, "at"): (utc(2024, 7, 18), None), (1, "price"): (None, "12723.55"),
        (1, "tag"): (None, "long"), (1, "doc"): (None, "no json"), (1, "old"): (utc(2024, 1, 1), None),
        (2, "id"): (2, None), (2, "flag"): (7, None), (2, "n"): ("x", None), (2, "at"): (utc(2024, 12, 1, 2, 18, 19), None), (2, "price"): (decimal.Decimal("1.5"), None),
        (2, "tag"): (None, None), (2, "doc"): ('{"k":1}', None), (3, None): (None, None),
    }


# New or changed files only


def checkpoints(spark, rows):
    cols = "run_id bigint, epoch bigint, source_schema string, source_table string, raw_appended_lsn string, transformed_lsn string, outcome string, updated_at timestamp_ntz"
    return spark.createDataFrame([(i, 1, "p", *r) for i, r in enumerate(rows)], cols)


def test_due_files(spark, tmp_path):
    count = iter(range(9))
    book = lambda: ledger.WorkLedger(spark, f"file://{tmp_path}/due{next(count)}")
    from datetime import datetime as t

    uri = "s3://b/1/p/t/00000000000000{:02}-a.parquet"
    early, late = t(2025, 1, 1), t(2025, 1, 3)
    files = [
        file(1, uri.format(1), end="10", created=early), file(2, uri.format(2), end="0/20", created=early), file(3, uri.format(3), end="30", created=early),
        file(4, uri.format(4), end="5", created=late), file(5, uri.format(5), end="99", created=early, status="failed"), file(6, uri.format(1), end="10", created=late),
        file(7, uri.format(7), end="1", created=early, table="new"),
    ]
    runs = checkpoints(spark, [
        ("t", "5", "5", "committed", t(2025, 1, 1)), ("t", "20", "10", "committed", t(2025, 1, 2)), ("t", "20", "10", "committed", t(2025, 1, 2)),
        ("t", "FF", "FF", "failed", t(2025, 2, 1)), ("t", "FF", None, None, None),
    ])
    got = {tuple(r) for r in ledger.due_files(manifest(spark, files), runs, book()).collect()}
    assert got == {(2, "transform"), (3, "append"), (4, "append"), (7, "append")}
    assert ledger.due_files(manifest(spark, []), runs, book()).count() == 0
    assert ledger.due_files(manifest(spark, files), checkpoints(spark, []), book()).count() == 6 - 1


def test_ledger_survives_failures(spark, tmp_path):
    book = ledger.WorkLedger(spark, f"file://{tmp_path}/book")
    assert book.state("2025-01-01").count() == 0
    items = spark.createDataFrame([(f"i{n}",) for n in range(6)], "item string")
    book.enqueue(items, "0")
    book.enqueue(items, "0")
    at = lambda m: f"2025-01-01 00:{m:02}:00"
    a = book.lease("a", "1", at(0), 60, 2)
    assert sorted(tuple(r) for r in a.collect()) == [("i0", 2), ("i1", 2)]  # the token is the commit's number
    assert sorted(tuple(r) for r in book.lease("a", "1", at(0), 60, 2).collect()) == [("i0", 2), ("i1", 2)]  # a retry leases nothing new
    b = book.lease("b", "1", at(0), 60, 2)
    assert {r.item for r in b.collect()} == {"i2", "i3"}
    book.complete("a", "1", a)
    c = book.lease("c", "1", at(5), 60, 10)  # b's leases ran out
    assert {(r.item, r.token) for r in c.collect()} == {("i2", 5), ("i3", 5), ("i4", 5), ("i5", 5)}
    assert {r.item for r in book.complete("b", "1", b).collect()} == {"i2", "i3"}  # stale tokens are refused
    state = {r.item: (r.state, r.worker) for r in book.state(at(5)).collect()}
    assert state["i0"] == ("done", "a") and state["i2"] == ("leased", "c")
    book.compact()  # one commit instead of all
    book.clean()
    assert len(book.commits()) == 1 and {r.item: (r.state, r.worker) for r in book.state(at(5)).collect()} == state
    assert {r.item for r in book.lease("a", "1", at(5), 60, 2).collect()} == {"i0", "i1"}  # still known after the summary
    book.complete("c", "1", c)
    assert {r.state for r in book.state(at(59)).collect()} == {"done"}


def test_a_null_item_and_an_empty_queue(spark, tmp_path):
    book = ledger.WorkLedger(spark, f"file://{tmp_path}/book")
    assert book.lease("a", "0", "2025-01-01", 60).count() == 0
    book.enqueue(spark.createDataFrame([(None,), ("x",), (None,)], "item string"), "0")
    held = book.lease("a", "1", "2025-01-01", 60)
    assert held.count() == 2 and book.complete("a", "1", held).count() == 0
    assert {(r.item, r.state) for r in book.state("2025-01-01").collect()} == {(None, "done"), ("x", "done")}
    assert book.lease("b", "1", "2026-01-01", 60).count() == 0


def test_two_controllers_never_complete_an_item_twice(spark, tmp_path, monkeypatch):
    """Both see the same state; the second one's commit comes between the first one's look and its commit."""
    books = [ledger.WorkLedger(spark, f"file://{tmp_path}/book") for _ in range(2)]
    books[0].enqueue(spark.createDataFrame([(f"i{n}",) for n in range(4)], "item string"), "0")
    now, taken, claim = "2025-01-01 00:00:00", [], books[0]._claim

    def race(number, entry):
        if not taken:
            taken.append(books[1].lease("b", "1", now, 60, 3))
        return claim(number, entry)

    with monkeypatch.context() as m:
        m.setattr(books[0], "_claim", race)
        mine = books[0].lease("a", "1", now, 60)
    held = [{(r.item, r.token) for r in x.collect()} for x in (mine, taken[0])]
    assert held[0] == {("i3", 3)} and held[1] == {("i0", 2), ("i1", 2), ("i2", 2)}
    # Even writers that overlook each other have different tokens, so one of them is stale.
    late = books[0].lease("c", "1", "2025-01-01 02:00:00", 60)
    assert books[0].complete("c", "1", late).count() == 0
    assert {r.item for r in books[1].complete("b", "1", taken[0]).collect()} == {"i0", "i1", "i2"}
    assert {(r.state, r.worker) for r in books[0].state(now).collect()} == {("done", "c")}
    (tmp_path / "book" / "commit-000000000099").touch()  # made but never filled: a writer died between
    books[0].enqueue(spark.createDataFrame([("i9",)], "item string"), "1")
    assert max(books[1].commits()) == 100 and books[1].state(now).count() == 5


@pytest.mark.parametrize("n", [5, 130, 500])
def test_ledger_works_off_all_items(spark, tmp_path, n):
    from changeloom.plans import live

    book = ledger.WorkLedger(spark, f"file://{tmp_path}/book")
    items = spark.range(n).select(F.format_string("%06d", F.col("id")).alias("item"))
    got = {r.item: (r.state, r.worker) for r in live._work_off(book, items).collect()}
    share = max(40, -(-n // 8))
    want = lambda i: ("done", "a" if i < share else "c")
    assert got == {f"{i:06}": want(i) for i in range(n)}


# A few keys holding most records


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_tree_equals_plain_aggregation(spark, fan_in):
    df = spark.range(10_000, numPartitions=13).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    df = df.withColumn("k", F.when(F.col("k") != 11, F.col("k")))
    states = {"n": treeagg.counted(), "odd": treeagg.counted(F.col("v") % 2 == 1), "lo": treeagg.smallest(F.col("v")), "hi": treeagg.largest(F.col("v"))}
    got = {tuple(r) for r in treeagg.tree_aggregate(df, ["k"], states, fan_in).collect()}
    want = {tuple(r) for r in df.groupBy("k").agg(F.count("*"), F.count_if(F.col("v") % 2 == 1), F.min("v"), F.max("v")).collect()}
    assert got == want


def test_hot_values(spark):
    rows = [change(i, "a", i, table="hot" if i < 60 else f"t{i}", xid=None if i % 2 else i % 40) for i in range(100)]
    got = {tuple(r) for r in treeagg.hot_values(log(spark, rows)).collect()}
    assert got == {("source_table", "hot")}
    assert treeagg.hot_values(log(spark, [])).count() == 0


# A stream of inserts, updates, deletes


def state(spark, rows, files=()):
    df = log(spark, rows)
    return {(r.source_table, r.row_key): (r.lsn, r.fields) for r in changefeed.current_fields(df, manifest(spark, list(files))).collect()}


def found(spark, rows, files=()):
    return {(r.source_table, r.row_key): int(r.lsn, 16) for r in changefeed.current_rows(log(spark, rows), manifest(spark, list(files))).collect()}


def test_change_feed_cases(spark):
    rows = [
        change(1, "churn", 1), change(2, "churn", 2, "d"), change(3, "churn", 3), change(4, "gone", 1), change(5, "gone", 9, "d"), change(6, "phantom", 4, "d"),
        change(7, "late", 8, "u"), change(8, "late", 2), change(9, "late", 8, "u"), change(10, "moved", 1), change(11, "to", 5, "u", old="moved"),
        change(12, "x", 7, table="u"), change(13, None, 8, "t", table="u"), change(14, "y", 9, table="u"), change(15, "z", 8, table="u"),
        change(16, "same", 3), change(17, "same", 6, "u", old="same"), change(18, "bad", None), change(19, "odd", 5, "?"), change(20, None, 5),
        change(21, "order", 2, commit=50), change(22, "order", 40, "d", commit=45),
    ]
    want = {("t", "churn"): 3, ("t", "late"): 8, ("t", "to"): 5, ("u", "y"): 9, ("t", "same"): 6, ("t", "order"): 2}
    assert found(spark, rows) == want
    assert found(spark, rows[::-1] + rows) == want
    assert {k: int(v[0], 16) for k, v in state(spark, rows).items()} == want
    assert found(spark, []) == {}


def test_spilled_rows_take_their_file_s_commit(spark):
    uri = "s3://b/1/p/t/00000000000000FF-s.parquet"
    rows = [change(1, "a", 3, commit="0", uri=uri.replace("s3:", "s3n:")), change(2, "a", 4, "d", commit=16)]
    assert found(spark, rows, [file(1, uri, "spill", "FF")]) == {("t", "a"): 3}
    assert found(spark, rows, [file(1, uri, "stream", "FF")]) == {}


def test_fields_take_their_last_writer(spark):
    rows = [
        change(1, "a", 1, data={"x": "1", "y": "1"}), change(2, "a", 2, "u", data={"x": "2", "y": None}, unset=["y"]), change(3, "a", 3, "u", data={"x": None, "y": None}, unset=["y"]),
        change(4, "b", 1, data={"x": "old", "y": "old"}), change(5, "b", 2, "d"), change(6, "b", 3, "u", data={"x": "n", "y": None}, unset=["y"]),
        change(7, "c", 1, data={"x": "1", "z": "1"}), change(8, "c", 2, "i", data={"x": "2"}),
    ]
    got = {k[1]: v[1] for k, v in state(spark, rows).items()}
    assert got["a"] == {"x": None, "y": "1"}
    assert got["b"].get("y") is None and got["b"]["x"] == "n"
    assert got["c"] == {"x": "2", "z": None} or got["c"] == {"x": "2"}


def test_key_changes_carry_unsent_fields(spark):
    rows = [
        change(1, "a", 1, data={"id": "a", "big": "B", "n": "1"}), change(2, "a", 2, "u", data={"id": "a", "big": None, "n": "2"}, unset=["big"]),
        change(3, "b", 3, "u", old="a", data={"id": "b", "big": None, "n": "3"}, unset=["big"]), change(4, "c", 4, "u", old="b", data={"id": "c", "big": None, "n": "4"}, unset=["big"]),
    ]
    got = {k[1]: v[1] for k, v in state(spark, rows).items()}
    assert got == {"c": {"id": "c", "big": "B", "n": "4"}}


def test_fields_follow_the_newest_version(spark):
    at, files, staged = versions(spark, ["id", "note", "gone", None], ["id", " Remark", "gone", None], ["id", "remark", None, "note"])
    put = lambda rid, key, pos, v, op="u", **kw: change(rid, key, pos, op, version=v, uri=at(v), **kw)
    rows = [
        put(1, "a", 1, 1, "i", data={"id": "a", "note": "N", "gone": "g"}), put(2, "a", 2, 2, data={"id": "a", "remark": None, "gone": "h"}, unset=["remark"]),
        put(3, "b", 3, 1, "i", data={"id": "b", "note": "N", "gone": "g"}), put(4, "b", 4, 3, data={"id": "b", "remark": "R", "note": "new"}),
        put(5, "c", 5, 1, "i", data={"id": "c", "note": "C", "gone": "g"}), put(6, "d", 6, 2, old="c", data={"id": "d", "remark": None, "gone": None}, unset=["remark"]),
        put(7, "e", 7, 1, "i", data={"id": "e", "note": "E", "gone": "g", "extra": "x"}),
    ]
    got = {r.row_key: r.fields for r in changefeed.current_fields(log(spark, rows), files, staged).collect()}
    assert got == {
        "a": {"id": "a", "remark": "N"}, "b": {"id": "b", "remark": "R", "note": "new"}, "d": {"id": "d", "remark": "C"},
        "e": {"id": "e", "remark": "E", "extra": "x"},
    }


def test_random_feeds_converge(spark):
    rnd = random.Random(3)
    rows, n = [], 0
    for i in range(600):
        op = rnd.choices("iudt", [4, 4, 2, 0.05])[0]
        key = None if op == "t" else f"k{rnd.randrange(30)}"
        old = f"k{rnd.randrange(30)}" if op == "u" and rnd.random() < 0.2 else None
        rows.append(change(i, key, 10 + i * 2, op, commit=1000 + i // 5, old=old, table=rnd.choice("tu")))
    live: dict = {}
    for r in rows:
        t = json.loads(r[9])["source_table"]
        if r[3] == "t":
            live = {k: v for k, v in live.items() if k[0] != t}
            continue
        if r[7] and r[7] != r[6]:
            live.pop((t, r[7]), None)
        if r[3] == "d":
            live.pop((t, r[6]), None)
        else:
            live[t, r[6]] = int(r[5], 16)
        n += 1
    rnd.shuffle(rows)
    assert found(spark, rows + rnd.sample(rows, 100)) == live and n > 500


def test_random_feeds_with_key_changes_against_a_replay(spark):
    """Chains of key changes, truncates and unsent values, in random order of arrival and with repeats."""
    rnd = random.Random(9)
    rows, live = [], {}
    for i in range(1, 500):
        op, key = rnd.choices("iudt", [3, 7, 1, 0.04])[0], f"k{rnd.randrange(8)}"
        if op == "t":
            rows.append(change(i, None, i, "t"))
            live = {}
            continue
        old = f"k{rnd.randrange(8)}" if op == "u" and rnd.random() < 0.5 else None
        unset = [f for f in "ab" if op == "u" and rnd.random() < 0.5]
        data = {f: None if f in unset else f"{f}{i}" for f in "ab"}
        rows.append(change(i, key, i, op, old=old, data=data, unset=unset))
        if op == "d":
            live.pop(key, None)
            continue
        before = live.pop(old, {}) if old and old != key else live.get(key, {}) if op == "u" else {}
        live[key] = {f: before[f] if f in unset else v for f, v in data.items() if f not in unset or f in before}
    rnd.shuffle(rows)
    got = {r.row_key: r.fields for r in changefeed.current_fields(log(spark, rows + rnd.sample(rows, 60)), manifest(spark, [])).collect()}
    assert got == live and len(live) > 3


# Far too many small files


def test_inventory_and_small_files(spark):
    a, b, c = (f"s3://b/1/p/t/000000000000000{n}-x.parquet" for n in (1, 2, 3))
    rows = [change(i, str(i), i, uri=a) for i in range(45)] + [change(100 + i, "k", 5, uri=b.replace("s3", "S3", 1)) for i in range(50)]
    got = {r.file_id: r.n_messages for r in compact.inventory(log(spark, rows), manifest(spark, [file(1, a), file(2, b), file(3, b), file(4, c)])).collect()}
    assert got == {1: 45, 2: 1, 4: 0}


def test_compaction_keeps_each_message_once(spark, tmp_path, monkeypatch):
    rows = [change(i, str(i % 30), i % 30, version=1 + i % 2, table=None if i % 7 == 0 else "t") for i in range(90)]
    rows = [r if i % 2 else (*r[:6], None, *r[7:]) for i, r in enumerate(rows)]
    df = log(spark, rows)
    target = f"file://{tmp_path}/merged"
    assert compact.read(spark, target) is None
    for _ in range(2):
        out = compact.compact(df, target, target_bytes=4_000)
        ids = ["epoch", "source_schema", "source_table", "row_key", "lsn"]
        assert out.count() == out.select(*ids).distinct().count() == compact.merged_messages(df).count()
    assert compact.merge_plan(df).agg(F.sum("n_rows")).first()[0] == out.count()
    with pytest.raises(compact.NotReconciled):
        compact.reconcile(df, out.limit(3))
    with pytest.raises(compact.NotReconciled):
        compact.reconcile(df, out.withColumn("row_key", F.concat("row_key", F.lit("!"))))
    assert compact.merged_messages(log(spark, [])).count() == 0
    # A run that fails before the swap leaves the data as it was; the next one cleans up.
    with monkeypatch.context() as m:
        m.setattr(compact, "reconcile", lambda *a: (_ for _ in ()).throw(compact.NotReconciled()))
        with pytest.raises(compact.NotReconciled):
            compact.compact(df.limit(5), target)
    assert compact.read(spark, target).count() == out.count()
    compact.compact(df, target)
    assert len([p for p in (tmp_path / "merged").iterdir() if p.name.startswith("data-")]) == 1


def test_files_have_the_target_size_and_stand_in_order(spark, tmp_path):
    rows = [change(i, str(i), i, version=1 + i % 2, table=f"t{i % 5}" if i % 3 else "hot", data={"x": "y" * (900 if i % 10 == 0 else 50)}) for i in range(3000)]
    df = log(spark, rows + [change(5000 + i, "dup", 7, table="hot") for i in range(1500)])
    target = 120_000
    cuts = compact.boundaries(df, target)
    merged = compact.clustered(compact.messages(df), cuts)
    sizes = {r.out_part: r.b for r in merged.groupBy("out_part").agg(F.sum(compact.row_bytes(merged)).alias("b")).collect()}
    assert len(sizes) > 8 and max(sizes.values()) < 1.7 * target and sorted(sizes) == list(range(len(sizes)))
    keys = [r.k for r in merged.select(compact.cluster_key().alias("k")).collect()]
    assert keys == sorted(keys) and len(keys) == 3001
    many = [f"{i:05d}" for i in range(0, 5000, 5)]
    got = spark.range(5000).select(F.col("id"), compact.range_of(F.lpad(F.col("id").cast("string"), 5, "0"), many).alias("p")).collect()
    assert all(r.p == r.id // 5 + 1 for r in got)
    compact.compact(df, f"file://{tmp_path}/merged", target)
    files = [p for p in (tmp_path / "merged").rglob("*.parquet")]
    assert len(files) == len(cuts) + 1


def test_extra_columns_with_clashing_names(spark):
    df = log(spark, [change(1, "a", 1), change(2, "a", 1)]).withColumns({"epoch": F.lit(9), "source_table": F.lit("x"), "object": F.lit("o"), "pos": F.lit("p"), "n": F.lit(1)})
    assert {tuple(r) for r in redelivery.repeated_rows(df).collect()} == {(1, 2)}
    assert changefeed.current_rows(df, manifest(spark, [])).first().source_table == "t"
    assert compact.inventory(df, manifest(spark, [file(1)])).first().n_messages == 1
    assert lsn.ZERO == "0" * 16

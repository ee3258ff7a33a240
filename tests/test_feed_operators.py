"""Mirror, raw log, evolution, wire decoder, control store and streams on small scripts."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changeloom.operators import evolve, mirror, rawlog
from changeloom.sources import wire
from changeloom.sources.control import ControlStore, StaleToken
from changeloom.streaming import frames, transactions

LOG = "id bigint, val string, op string, commit_lsn string, lsn string, unchanged array<string>"


def at(n):
    return f"{n:016X}"


def log(spark, events):
    """Events: (id, op, commit, lsn, value[, unchanged])."""
    return spark.createDataFrame([(e[0], e[4] if len(e) > 4 else None, e[1], at(e[2]), at(e[3]), list(e[5]) if len(e) > 5 else []) for e in events], LOG)


def base(spark, rows=()):
    return spark.createDataFrame([(k, v, at(c), at(p)) for k, v, c, p in rows], "id bigint, val string, _commit_lsn string, _lsn string")


def applied(spark, events, before=()):
    out = mirror.apply(base(spark, before), log(spark, events), ["id"], ["val"], unchanged="unchanged")
    return {r.id: r.val for r in out.collect()}


@pytest.mark.parametrize(
    ("events", "before", "want"),
    [
        ([(1, "i", 1, 1, "first"), (1, "d", 1, 2), (1, "i", 1, 3, "last")], (), {1: "last"}),
        ([(1, "i", 1, 1, "a"), (1, "d", 1, 2)], (), {}),
        ([(1, "i", 1, 1, "a"), (1, "u", 1, 2, "b"), (1, "d", 1, 3)], (), {}),
        ([(1, "d", 1, 1)], (), {}),
        ([(1, "d", 2, 1), (1, "i", 2, 2, "fresh")], [(1, "old", 0, 0)], {1: "fresh"}),
        ([(1, "i", 1, 1, "old"), (None, "t", 1, 5), (2, "i", 2, 6, "new")], [(99, "x", 0, 0)], {2: "new"}),
        ([(None, "t", 100, 1), (1, "i", 100, 2, "kept")], (), {1: "kept"}),
        ([(1, "i", 100, 1, "X"), (1, "u", 100, 2, None, ["val"])], (), {1: "X"}),
        ([(1, "u", 100, 1, None, ["val"])], [(1, "Y", 0, 0)], {1: "Y"}),
        ([(1, "i", 100, 1, None)], (), {1: None}),
        ([(1, "i", 100, 1, None), (1, "u", 100, 2, None, ["val"])], [(1, "stale", 0, 0)], {1: None}),
        ([(1, "u", 100, 1, None, ["v_l"])], [(1, "Y", 0, 0)], {1: None}),
        ([(1, "d", 100, 1), (1, "i", 100, 2, "late")], [(1, "current", 200, 9)], {1: "current"}),
        ([(1, "u", 50, 9, "no"), (2, "u", 200, 1, "yes")], [(1, "old", 100, 5), (2, "old", 100, 5)], {1: "old", 2: "yes"}),
        ([(1, "i", 100, 1, "snap"), (1, "u", 200, 5, "streamed")], (), {1: "streamed"}),
        ([], [(1, "a", 1, 1)], {1: "a"}),
    ],
)
def test_apply(spark, events, before, want):
    assert applied(spark, events, before) == want


def test_tombstones_stop_older_changes(spark):
    m = mirror.apply(base(spark), log(spark, [(1, "i", 1, 1, "a"), (1, "d", 9, 9)]), ["id"], ["val"], tombstones=True)
    m = mirror.apply(m, log(spark, [(1, "u", 5, 5, "older")]), ["id"], ["val"], tombstones=True)
    assert mirror.user_view(m).count() == 0
    m = mirror.apply(m, log(spark, [(1, "i", 10, 10, "newer")]), ["id"], ["val"], tombstones=True)
    assert [r.val for r in mirror.user_view(m).collect()] == ["newer"]


def test_rebuild_equals_incremental(spark):
    events = [(1, "i", 100, 1, "a"), (1, "u", 101, 2, "b"), (2, "i", 100, 3), (2, "d", 102, 4), (3, "i", 100, 5, "c")]
    out = mirror.rebuild(log(spark, events), base(spark, [(7, "kept", 1, 1), (1, "b", 101, 2)]), ["id"], ["val"])
    assert {r.id: r.val for r in out.collect()} == {1: "b", 3: "c", 7: "kept"}


def test_random_orders_and_replays_converge(spark):
    rnd = random.Random(11)
    events = [(rnd.randrange(12), rnd.choice("iud"), 10 + i // 4, 100 + i, f"v{i}") for i in range(200)]
    want = {k: e[4] for k, e in {e[0]: e for e in events}.items() if e[1] != "d"}
    for _ in range(2):
        rnd.shuffle(events)
        m = base(spark).withColumn("_deleted", F.lit(False))
        for part in (events[:90], events[60:150], events[100:]):
            m = mirror.apply(m, log(spark, part), ["id"], ["val"], tombstones=True)
        assert {r.id: r.val for r in mirror.user_view(m).collect()} == want
    ranked, best = (f(log(spark, events), ["id"]).select("id", "lsn").collect() for f in (mirror.winners_ranked, mirror.winners))
    assert sorted(map(tuple, ranked)) == sorted(map(tuple, best))


def test_mirror_versions(spark, tmp_path):
    store = mirror.MirrorStore(spark, f"file://{tmp_path}/m", ["id"], buckets=2)
    assert store.read() is None
    store.write(base(spark, [(1, "a", 1, 1)]), {"batch": 0})
    store.write(base(spark, [(1, "b", 2, 2)]), {"batch": 1})
    assert store.current()["batch"] == 1 and [r.val for r in store.read().collect()] == ["b"]
    store.vacuum()
    assert [r.val for r in store.read().collect()] == ["b"]


def test_rebuild_after_a_prune_keeps_unsent_values(spark):
    late = log(spark, [(1, "u", 200, 1, "")]).withColumn("unchanged", F.array(F.lit("val")))
    out = mirror.rebuild(late, base(spark, [(1, "Y", 100, 1), (2, "gone", 5, 5)]).withColumn("_deleted", F.col("id") == 2), ["id"], ["val"], "unchanged", tombstones=True)
    assert {(r.id, r.val, r._lsn, r._deleted) for r in out.collect()} == {(1, "Y", f"{1:016X}", False), (2, "gone", f"{5:016X}", True)}
    older = mirror.apply(out, log(spark, [(2, "u", 4, 4, "back")]), ["id"], ["val"], tombstones=True)
    assert [r.id for r in mirror.user_view(older).collect()] == [1]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = mirror.MirrorStore(spark, f"file://{tmp_path}/m", ["id"], buckets=4)
    store.apply(log(spark, [(i, "i", 1, i, "a") for i in range(1, 40)]), ["val"])
    before = store.current()["files"]
    store.apply(log(spark, [(7, "u", 2, 50, "b")]), ["val"])
    after = store.current()["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and mirror.user_view(store.read()).count() == 39
    store.apply(log(spark, [(None, "t", 3, 60), (8, "i", 4, 61, "c")]), ["val"])
    store.apply(log(spark, [(9, "u", 2, 55, "wiped")]), ["val"])  # from before the truncate, delivered after it
    assert [(r.id, r.val) for r in mirror.user_view(store.read()).collect()] == [(8, "c")]
    store.vacuum()
    assert mirror.user_view(store.read()).count() == 1
    small = mirror.MirrorStore(spark, f"file://{tmp_path}/s", ["id"], buckets=1, bucket_rows=10)
    for k in range(2):
        small.apply(log(spark, [(i, "i", 1, i, "a") for i in range(k * 30, k * 30 + 30)]), ["val"])
    assert small.current()["buckets"] == 4 and small.read().count() == 60


@pytest.mark.parametrize("step", ["_store", "move", "_publish"])
def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    store = mirror.MirrorStore(spark, f"file://{tmp_path}/m", ["id"])
    store.apply(log(spark, [(i, "i", 1, i, "a") for i in range(100)]), ["val"])
    with monkeypatch.context() as m:
        m.setattr(store.pointer if step == "move" else store, step, lambda *a, **k: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            store.apply(log(spark, [(i, "i", 2, i, "b") for i in range(200, 210)]), ["val"])
    assert store.read().count() == 100
    store.apply(log(spark, [(i, "i", 2, i, "b") for i in range(200, 210)]), ["val"])
    assert mirror.MirrorStore(spark, f"file://{tmp_path}/m", ["id"]).read().count() == 110


def test_key_changes_remove_the_old_key(spark):
    rows = log(spark, [(1, "i", 1, 1, "a"), (2, "u", 2, 2, "b"), (2, "u", 3, 3, "c")])
    rows = rows.withColumn("was", F.when(F.col("val") == "b", 1).when(F.col("val") == "c", 2))
    out = mirror.apply(base(spark), mirror.key_changes(rows, ["id"], ["was"]), ["id"], ["val"])
    assert [(r.id, r.val) for r in out.collect()] == [(2, "c")]


def test_queue_of_two_epochs_and_schemas(spark):
    files = spark.createDataFrame(
        [(1, 1, "p", "t", "stream", "ready", at(5)), (2, 2, "p", "t", "stream", "ready", at(5)), (3, 1, "q", "t", "stream", "ready", at(5)), (4, 1, "p", "t", "reload", "ready", at(7)),
         (5, 1, "p", "t", "stream", "ready", at(9)), (6, 1, "p", "t", "stream", "failed", at(1))],
        "file_id bigint, epoch bigint, source_schema string, source_table string, kind string, status string, lsn_end string",
    )
    reloads = spark.createDataFrame(
        [(1, 1, "p", "t", "reload", "complete", at(20)), (2, 1, "p", "t", "reload", "exporting", at(7)), (3, 1, "p", "t", "resync", "exporting", at(30))],
        "reload_id bigint, epoch bigint, source_schema string, source_table string, mode string, state string, first_lsn string",
    )
    assert {r.file_id for r in rawlog.claimable(files, reloads).collect()} == {2, 3, 4}
    assert {r.file_id for r in rawlog.superseded(files, rawlog.reload_floors(reloads)).collect()} == {1, 6}


def test_keyset_pages_cover_the_table(spark):
    df = spark.createDataFrame([(a, b) for a in range(4) for b in range(3)], "a int, b int")
    cursor, seen = None, []
    while page := [tuple(r) for r in mirror.keyset_page(df, ["a", "b"], cursor, 5).collect()]:
        seen += page
        cursor = page[-1]
    assert seen == sorted((a, b) for a in range(4) for b in range(3))


def test_append_is_idempotent(spark):
    cols = "id bigint, v string, sink_processed_at string, lsn string"
    a = spark.createDataFrame([(1, "x", "t1", "1"), (None, "n", "t1", "2")], cols)
    b = spark.createDataFrame([(1, "x", "t1", "1"), (None, "n", "t1", "2"), (2, "y", "t2", "3"), (2, "y", "t2", "3")], cols).withColumn("extra", F.lit(1))
    once = rawlog.append_once(a, b, ["id"])
    assert once.count() == 3 and rawlog.append_once(once, b, ["id"]).count() == 3 and "extra" in once.columns


def test_schema_diff():
    c = evolve.Column
    old = [c("id", "int4", "int", 1), c("a", "text", "string", 2), c("n", "int4", "int", 3), c("x", "text", "string", 4)]
    new = [c("id", "int8", "bigint", 1), c("b", "text", "string", 2), c("n", "text", "string", 3), c("new", "date", "date", 5)]
    d = evolve.diff(old, new)
    assert d.renamed == [("a", "b")] and [x.name for x in d.widened] == ["id"] and [x.name for x in d.lossy] == ["n"] and d.dropped == ["x"] and [x.name for x in d.added] == ["new"]
    assert evolve.diff(old, []).table_dropped and evolve.diff(old, old) == evolve.Diff()


def test_reconcile_skips_missing_versions(spark):
    c = evolve.Column
    versions = {1: [c("id", "int4", "int", 1), c("n", "text", "string", 2)], 3: [c("id", "int8", "bigint", 1), c("n", "int4", "int", 2)]}
    df = spark.createDataFrame([(1, "5"), (2, "bad"), (3, None)], "id int, n string")
    out, bad = evolve.reconcile(df, versions, 1, 9)
    assert {(r.id, r.n) for r in out.collect()} == {(1, 5), (3, None)} and dict(out.dtypes)["id"] == "bigint"
    assert [r.id for r in bad[0].collect()] == [2]


# Wire


def test_decoder_reads_what_the_encoder_writes():
    e = wire.Encoder
    assert wire.decode(e.begin(5, wire.EPOCH + 7, 9)) == {"tag": "B", "final_lsn": at(5), "time": wire.EPOCH + 7, "xid": 9}
    row = wire.decode(e.insert(3, ["a", None, ..., b"\x01"]))["new"]
    assert row == [("t", "a"), ("n", None), ("u", None), ("b", b"\x01")]
    u = wire.decode(e.update(3, ["b"], old=["a"]))
    assert u["key"] == [("t", "a")] and u["new"] == [("t", "b")]
    assert wire.decode(e.update(3, ["b"], old=["a"], key=False))["old"] == [("t", "a")]
    assert wire.decode(e.truncate([1, 2], 3)) == {"tag": "T", "cascade": True, "restart": True, "rels": [1, 2]}
    r = wire.decode(e.relation(7, "public", "orders", [("id", 23, -1, True), ("n", 1700, 655366, False)]))
    assert (r["schema"], r["name"], r["identity"]) == ("public", "orders", "d") and r["columns"][1] == {"is_key": False, "name": "n", "type_oid": 1700, "typmod": 655366}
    assert wire.decode(e.insert(3, ["a"], sub=4), in_stream=True)["sub_xid"] == 4


@pytest.mark.parametrize("payload", [b"", b"Z", b"B\0", wire.Encoder.insert(1, ["a"]) + b"x", wire.Encoder.insert(1, ["abc"])[:-1], b"I\0\0\0\1X\0\0"])
def test_malformed_payloads_are_refused(payload):
    with pytest.raises(wire.Malformed):
        wire.decode(payload)


def test_stream_context_is_threaded():
    e = wire.Encoder
    data = b"\n".join([e.stream_start(5, True), e.insert(1, ["a"], sub=6), e.stream_stop(), e.begin(1, wire.EPOCH, 8), e.insert(1, ["b"]), e.commit(1, 1, wire.EPOCH), e.stream_abort(5, 6)])
    assert [(m["tag"], m.get("sub_xid")) for m in wire.decode_stream(data)] == [("S", None), ("I", 6), ("E", None), ("B", None), ("I", None), ("C", None), ("A", 6)]


def test_recorded_frames_source(spark, tmp_path):
    e = wire.Encoder
    payloads = [e.begin(9, wire.EPOCH, 1), e.insert(7, ["1", "a"]), e.delete(7, ["2", None]), e.commit(9, 9, wire.EPOCH)]
    path = tmp_path / "frames.txt"
    path.write_text("".join(f"{i} {at(i)} {p.hex()}\n" for i, p in enumerate(payloads)))
    frames.register(spark)
    df = spark.read.format("recorded_frames").option("path", str(path)).load()
    rows = wire.decode_frames(df, 2).orderBy("frame_no").collect()
    assert [(r.tag, r.xid) for r in rows] == [("B", 1), ("I", 1), ("D", 1), ("C", 1)] and rows[2].old_is_key and rows[1].new[1]["value"] == "a"
    stream = spark.readStream.format("recorded_frames").option("path", str(path)).option("framesPerBatch", 3).load()
    q = stream.writeStream.format("memory").queryName("frames_seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.frame_no for r in spark.table("frames_seen").collect()) == [0, 1, 2, 3]


def test_transactions_become_visible_at_commit(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, transactions.MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        stream = spark.readStream.schema(transactions.MESSAGES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = transactions.committed(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.xid, r.payload) for r in spark.read.schema(transactions.OUT).parquet(f"{tmp_path}/out").collect())

    put(0, [(1, 1, "change", "1", "a"), (2, 2, "change", "2", "b"), (1, 11, "change", "3", "rolled back"), (3, 3, "change", "4", "open")])
    assert run() == []
    put(1, [(1, 11, "abort", "", None), (1, 1, "change", "5", "c"), (1, 1, "commit", "9", None), (2, 2, "abort", "", None)])
    assert run() == [(1, "a"), (1, "c")]
    put(2, [(3, 3, "commit", "A", None)])
    assert run() == [(1, "a"), (1, "c"), (3, "open")]


class Held:
    """A state variable of one key."""

    def __init__(self):
        self.d = {}

    def get(self):
        return self.d.get(())

    def update(self, value):
        self.d[()] = value

    def clear(self):
        self.d.clear()

    def getValue(self, key):  # noqa: N802
        return self.d[key]

    def updateValue(self, key, value):  # noqa: N802
        self.d[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.d[key]


@pytest.mark.parametrize("held", [1, 2000, 1 << 20])
def test_gate_equals_a_plain_loop_over_batches(monkeypatch, held):
    """Open for many batches, numbers used again, rollbacks before and after their rows, more than is held at once, parts of few rows."""
    for k, v in {"PIECE": 3, "PACKED": 2, "HELD_BYTES": held}.items():
        monkeypatch.setattr(transactions, k, v)
    index, rows = Held(), Held()
    gate = transactions._Gate()
    gate.init(type("Handle", (), {"getValueState": lambda *_: index, "getMapState": lambda *_: rows})())
    rnd, model, n = random.Random(7), {}, 0
    for batch in range(60):
        messages, ended = [], set()
        for _ in range(rnd.randrange(1, 60)):
            n, xid = n + 1, rnd.randrange(12)
            sub = rnd.choice([xid, xid, xid * 10 + 1, xid * 10 + 2, None])
            kind = rnd.choices(["change", "abort", "commit"], [60, 5 if sub != xid else 1, 6 if batch < 59 else 40])[0]
            if kind == "commit" and (xid in ended or ended.add(xid)):
                continue
            messages.append((xid, xid if kind == "commit" else sub, kind, at(n), str(n) if kind == "change" else None))
        want = []
        for xid in {m[0] for m in messages}:
            own, dead = model.setdefault(xid, ([], set()))
            own += [(xid, m[1], m[3], m[4]) for m in messages if m[0] == xid and m[2] == "change"]
            dead |= {m[1] for m in messages if m[0] == xid and m[2] == "abort" and m[1] is not None}
            commit = next((m[3] for m in messages if m[0] == xid and m[2] == "commit"), None)
            if xid in dead or commit:
                want += [(*r, commit) for r in own if xid not in dead and r[1] not in dead]
                del model[xid]
        table = pa.Table.from_pylist([dict(zip(["bucket", *transactions.MESSAGE.names], (0, *m), strict=True)) for m in messages], pa.schema([("bucket", pa.int64()), *transactions.MESSAGE]))
        packed = [b.to_pandas() for b in transactions._pack(iter(table.to_batches()))]
        got = [tuple(r.values()) for pdf in gate.handleInputRows((0,), iter(packed), None) for r in pa.Table.from_pandas(pdf, preserve_index=False).to_pylist()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert len(rows.d) <= sum(len(own) for own, _ in model.values()), "a part without an open row is gone"


def test_the_state_is_asked_by_bucket_not_by_transaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transactions, "BUCKETS", 8, raising=False)
    rows = [m for x in range(500) for m in ((x, x, "change", at(x), str(x)), (x, x, "commit" if x % 5 else "change", at(x + 1), None))]
    spark.createDataFrame(rows, transactions.MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(transactions.MESSAGES).parquet(f"{tmp_path}/in")
    q = transactions.committed(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.schema(transactions.OUT).parquet(f"{tmp_path}/out").count() == 400
    asked = sum(p.stateOperators[0].customMetrics[k] for p in q.recentProgress for k in ("rocksdbGetCount", "rocksdbPutCount"))
    assert asked < 100


# Control store


def test_queue_and_watermarks():
    s = ControlStore()
    e = s.next_epoch()
    ids = [s.add_ready(e, "p", "t", f"f{n}", "stream", 1, at(n), at(n), 1) for n in (3, 1, 2)]
    assert s.add_ready(e, "p", "t", "f3", "stream", 1, at(3), at(3), 1) == ids[0]
    assert [f.uri for f in s.claim_ready(e, "p", "t", 2)] == ["f1", "f2"]
    s.mark_failed(ids[1])
    s.appended(e, "p", "t", at(2), [ids[2]])
    s.appended(e, "p", "t", at(1), [])
    assert s.watermark(e, "p", "t") == (at(2), at(0)) and s.lag(e, "p", "t") == 3
    s.transformed(e, "p", "t", at(2))
    with pytest.raises(Exception, match="CHECK"):
        s.transformed(e, "p", "t", at(9))
    assert s.watermark(e, "p", "t") == (at(2), at(2))


def test_a_failed_step_changes_nothing():
    s = ControlStore()
    e = s.next_epoch()
    with pytest.raises(ZeroDivisionError), s.transaction():
        s.add_ready(e, "p", "t", "f", "stream", 1, at(1), at(1), 1)
        1 / 0
    assert s.claim_ready(e, "p", "t") == []


def test_leases_fence_stale_writers():
    s = ControlStore()
    assert s.acquire("t", "a", 10, now=0) == 1 and s.acquire("t", "b", 10, now=5) is None and s.acquire("t", "a", 10, now=6) == 1
    assert s.acquire("t", "b", 10, now=99) == 2
    with pytest.raises(StaleToken):
        s.require("t", 1)
    s.require("t", 2)


def test_reload_life():
    s = ControlStore()
    e = s.next_epoch()
    s.add_ready(e, "p", "t", "old", "stream", 1, at(1), at(1), 1)
    r = s.request_reload(e, "p", "t")
    with pytest.raises(Exception, match="UNIQUE"):
        s.request_reload(e, "p", "t")
    assert s.claim_ready(e, "p", "t") == [] and s.claim_reload(e) == r
    s.reload_chunk(r, "10", epoch=e, schema="p", table="t", uri="c1", rows=5, start=at(5), end=at(5), version=1)
    assert [f.uri for f in s.claim_ready(e, "p", "t")] == ["c1"] and s.delete_superseded(e, "p", "t", at(5)) == 1
    s.export_done(r, at(5))
    assert s.complete_reached(e, "p", "t") == []
    s.appended(e, "p", "t", at(5), [])
    s.transformed(e, "p", "t", at(5))
    assert s.complete_reached(e, "p", "t") == [r] and s.reload_state(r)[0] == "complete"
    n = s.request_reload(e, "p", "t")
    s.claim_reload(e)
    again = s.restart_reload(n, cap=1)
    assert s.reload_state(n)[0] == "failed" and s.claim_reload(e) == again and s.restart_reload(again, cap=1) is None


def test_schema_history(spark):
    s = ControlStore()
    e = s.next_epoch()
    for v in (1, 3):
        s.add_version(e, "p", "t", v, [{"name": f"c{v}"}])
    assert s.version(e, "p", "t") == (3, [{"name": "c3"}]) and s.version(e, "p", "t", 1) == (1, [{"name": "c1"}]) and s.version(e, "p", "t", 2) is None
    s.add_ddl(e, at(1), "ALTER TABLE", "p.t")
    s.add_ddl(e, at(1), "ALTER TABLE", "p.t")
    assert len(s.pending_ddl(e)) == 1 and s.frame(spark, "schema_version").count() == 2

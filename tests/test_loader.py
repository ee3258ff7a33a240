"""The loader end to end on staged files: replays, crashes, spills, schema steps, reloads; and the source contract."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from changeloom.sources import contract
from changeloom.sources.control import ControlStore
from changeloom.streaming.loader import Quarantined, TableLoader

V1 = [{"name": "id", "type": "int8", "spark": "bigint", "pos": 1}, {"name": "note", "type": "text", "spark": "string", "pos": 2}, {"name": "n", "type": "text", "spark": "string", "pos": 3}]
V2 = [V1[0], {"name": "memo", "type": "text", "spark": "string", "pos": 2}, V1[2], {"name": "extra", "type": "text", "spark": "string", "pos": 4}]
V3 = [V2[0], V2[1], {"name": "n", "type": "int4", "spark": "int", "pos": 3}, V2[3]]


def at(n):
    return f"{n:016X}"


class Bench:
    def __init__(self, spark, tmp):
        self.spark, self.tmp, self.control = spark, tmp, ControlStore()
        self.epoch = self.control.next_epoch()
        for v, cols in enumerate((V1, V2, V3), 1):
            self.control.add_version(self.epoch, "p", "t", v, cols)
        self.loader = TableLoader(spark, self.control, f"file://{tmp}/t", self.epoch, "p", "t", ["id"], buckets=2)
        self.n = 0

    def stage(self, rows, version=1, kind="stream", reload_id=None):
        """Rows: (op, commit, lsn, values, unsent)."""
        self.n += 1
        cols = {1: V1, 2: V2, 3: V3}[version]
        data = []
        for op, c, p, values, *unsent in rows:
            meta = {"op": op, "commit_lsn": at(c), "lsn": at(p), "unchanged_toast": unsent[0] if unsent else [], "sink_processed_at": "2025-01-01T00:00:00Z"}
            data.append((*[values.get(x["name"]) for x in cols], json.dumps(meta)))
        uri = f"file://{self.tmp}/staged/{self.n}"
        self.spark.createDataFrame(data, ", ".join(f"{x['name']} {x['spark']}" for x in cols) + ", sink_meta string").write.parquet(uri)
        tops = [r[1] for r in rows]
        return self.control.add_ready(self.epoch, "p", "t", uri, kind, len(rows), at(min(tops)), at(max(tops)), version, reload_id)

    def drain(self):
        while self.loader.tick():
            pass
        m = self.loader.mirror()
        return {} if m is None else {r.id: tuple(r[c] for c in m.columns if c != "id") for r in m.collect()}


def test_loader_from_files_to_mirror(spark, tmp_path):
    b = Bench(spark, tmp_path)
    assert b.drain() == {}
    b.stage([("i", 1, 1, {"id": 1, "note": "a", "n": "1"}), ("i", 1, 2, {"id": 2, "note": "b", "n": "2"})])
    b.stage([("u", 2, 3, {"id": 1, "note": None, "n": "5"}, ["note"]), ("d", 2, 4, {"id": 2})])
    assert b.drain() == {1: ("a", "5")}
    assert b.control.watermark(b.epoch, "p", "t") == (at(2), at(2)) and b.control.lag(b.epoch, "p", "t") == 0
    # An old file delivered late, and a spill whose rows take the file's commit.
    b.stage([("u", 1, 2, {"id": 2, "note": "late", "n": "0"})])
    b.stage([("i", 0, 9, {"id": 3, "note": "spilled", "n": "3"}), ("i", 7, 10, {"id": 4, "note": "spilled", "n": "4"})], kind="spill")
    assert b.drain() == {1: ("a", "5"), 3: ("spilled", "3"), 4: ("spilled", "4")}
    # A new version: one column renamed, one added; then an old-version file.
    b.stage([("u", 9, 11, {"id": 3, "memo": "new", "n": "6", "extra": "x"})], version=2)
    assert b.drain() == {1: ("a", "5", None), 3: ("new", "6", "x"), 4: ("spilled", "4", None)}
    b.stage([("i", 10, 12, {"id": 5, "note": "old name", "n": "7"})], version=1)
    want = {1: ("a", "5", None), 3: ("new", "6", "x"), 4: ("spilled", "4", None), 5: ("old name", "7", None)}
    assert b.drain() == want
    # Rebuilding from the log gives the same; so does rebuilding after pruning it.
    b.loader.rebuild()
    assert b.drain() == want
    assert b.loader.prune(lag=0) > 0
    b.loader.rebuild()
    assert b.drain() == want


def test_crash_between_data_and_control(spark, tmp_path, monkeypatch):
    b = Bench(spark, tmp_path)
    b.stage([("i", 1, 1, {"id": 1, "note": "a", "n": "1"})])
    with monkeypatch.context() as m:
        m.setattr(b.control, "appended", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            b.loader.append()
    with monkeypatch.context() as m:
        m.setattr(b.control, "transformed", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            b.loader.tick()
    assert b.drain() == {1: ("a", "1")} and len(b.loader.appended()) == 1


def test_rows_that_do_not_fit_are_quarantined(spark, tmp_path):
    b = Bench(spark, tmp_path)
    b.stage([("i", 1, 1, {"id": 1, "memo": "a", "n": "1", "extra": None}), ("i", 1, 2, {"id": 2, "memo": "b", "n": "bad", "extra": None})], version=2)
    b.drain()
    b.stage([("i", 2, 3, {"id": 3, "memo": "c", "n": 3, "extra": None})], version=3)
    for _ in range(2):
        with pytest.raises(Quarantined):
            b.drain()
    assert b.loader.mirror().count() == 2
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/t/quarantine/*").collect()] == [2]


def test_reload_replaces_and_resync_adds(spark, tmp_path):
    b = Bench(spark, tmp_path)
    b.stage([("i", 1, 1, {"id": 1, "note": "a", "n": "1"}), ("i", 1, 2, {"id": 99, "note": "phantom", "n": "0"})])
    b.drain()
    for mode, gone in (("resync", False), ("reload", True)):
        r = b.control.request_reload(b.epoch, "p", "t", mode)
        b.control.claim_reload(b.epoch)
        base = 16 if mode == "resync" else 64
        b.stage([("i", base, base, {"id": 1, "note": mode, "n": "1"}), ("i", base, base, {"id": 2, "note": mode, "n": "2"})], kind="reload", reload_id=r)
        b.control.export_done(r, at(base))
        b.stage([("u", base + 1, base + 1, {"id": 2, "note": "newer", "n": "3"})])
        got = b.drain()
        assert got[1] == (mode, "1") and got[2] == ("newer", "3") and (99 in got) != gone
        assert b.control.reload_state(r)[0] == "complete"


def test_a_crash_between_wipe_and_mark_wipes_again(spark, tmp_path, monkeypatch):
    b = Bench(spark, tmp_path)
    b.stage([("i", 1, 1, {"id": 99, "note": "phantom", "n": "0"})])
    b.drain()
    r = b.control.request_reload(b.epoch, "p", "t", "reload")
    b.control.claim_reload(b.epoch)
    b.stage([("i", 16, 16, {"id": 1, "note": "new", "n": "1"})], kind="reload", reload_id=r)
    b.control.export_done(r, at(16))
    with monkeypatch.context() as m:
        m.setattr(b.loader, "_wipe", lambda: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError, match="crash"):
            b.loader.append()
    assert b.drain() == {1: ("new", "1")}


def test_rebuild_keeps_tombstones_and_unsent_values(spark, tmp_path):
    b = Bench(spark, tmp_path)
    b.stage([("i", 1, 1, {"id": 1, "note": "kept", "n": "1"}), ("i", 1, 2, {"id": 2, "note": "b", "n": "2"}), ("d", 2, 3, {"id": 2})])
    b.drain()
    assert b.loader.prune(lag=0) == 0
    b.stage([("u", 9, 9, {"id": 1, "note": None, "n": "5"}, ["note"])])
    b.drain()
    assert b.loader.prune(lag=0) == 1
    b.loader.rebuild()
    b.stage([("u", 1, 2, {"id": 2, "note": "late", "n": "0"})])
    assert b.drain() == {1: ("kept", "5")}


def test_source_contract(spark):
    assert contract.on_slot(False) is contract.Action.RETRY and contract.on_slot(True) is contract.Action.FRESH
    assert contract.on_slot(True, True) is contract.Action.RESUME and contract.on_slot(True, True, True) is contract.Action.FRESH
    assert contract.acknowledge(at(9), at(5)) == at(5) and contract.acknowledge(at(9), None) == at(9)
    found = contract.identity_findings([{"name": "a", "identity": "d", "key": ["id"]}, {"name": "b", "identity": "f", "key": []}, {"name": "c", "identity": "n", "key": ["id"]}])
    assert [f.subject for f in found] == ["b", "c"]
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (3, 1)], "a int, b int")
    assert {tuple(r) for r in contract.key_findings(df, ["a", "b"]).collect()} == {("null key", 1), ("repeated key", 1)}
    assert contract.schema_findings({"x": ["b", "a"], "y": ["a"]}, ["a", "b"])[0].subject == "y"
    frames = spark.range(9_990, 10_020).where("id not in (9995, 10000, 10001, 10010)").select(F.col("id").alias("frame_no"))
    assert {tuple(r) for r in contract.frame_gaps(frames, 10).collect()} == {(9995, 9995), (10000, 10001), (10010, 10010)}

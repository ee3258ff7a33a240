"""Frames to mirrors, catalog checks, schema events, flow control, staging, plans, restarts, monitoring on small scripts."""

from __future__ import annotations

import datetime
import json
import threading

import pytest
from pyspark.sql import functions as F

from changeloom.functions import emit, pgtext
from changeloom.operators import ddl, mirror
from changeloom.sources import catalog, contract, staging, wire
from changeloom.sources.control import ControlStore
from changeloom.streaming import assemble, epochs, flow, monitor, plan
from changeloom.streaming.loader import TableLoader

E = wire.Encoder
COLUMNS = [("id", 20, -1, True), ("val", 25, -1, False), ("span", 1186, -1, False)]


def at(n):
    return f"{n:016X}"


def decoded(spark, payloads):
    frames = spark.createDataFrame([(i, at(i), p) for i, p in enumerate(payloads, 1)], "frame_no bigint, frame_lsn string, payload binary")
    return wire.decode_frames(frames, partitions=3)


def test_frames_become_typed_logs_by_shape(spark):
    wide = [*COLUMNS, ("more", 23, -1, False)]
    payloads = [
        E.begin(100, 0, 1), E.relation(7, "public", "t", COLUMNS), E.relation(8, "cdc_internal", "beat", COLUMNS[:1]), E.insert(7, ["1", "a", "1 day"]),
        E.insert(8, ["1"]), E.commit(100, 100, 0),
        E.stream_start(2, True), E.insert(7, ["5", "kept", None], sub=2), E.insert(7, ["6", "gone", None], sub=20), E.stream_stop(),
        E.begin(200, 0, 3), E.relation(7, "public", "t", COLUMNS), E.update(7, ["2", ..., "02:00:00"], ["1", None, None]), E.commit(200, 200, 0),
        E.stream_abort(2, 20), E.stream_commit(2, 300, 300, 0),
        E.begin(400, 0, 4), E.relation(7, "public", "t", wide), E.insert(7, ["9", "w", None, "4"]), E.commit(400, 400, 0), E.begin(500, 0, 5), E.truncate([7, 8]),
    ]
    (first, log), (second, more) = assemble.logs(decoded(spark, payloads))
    assert (first.name, first.version, second.version, first.keys) == ("t", 1, 2, ["id"])
    rows = {(r.id, r.op, r.val, r.span_days, r.span_micros, r.commit_lsn, tuple(r.unchanged), r.old_id) for r in log.collect()}
    assert rows == {
        (1, "i", "a", 1, 0, at(100), (), None), (2, "u", None, 0, 7_200_000_000, at(200), ("val",), 1), (5, "i", "kept", None, None, at(300), (), None),
    }
    assert {r.id: r.val for r in assemble.mirror_of(first, log).collect()} == {2: None, 5: "kept"}
    assert [(r.id, r.more) for r in more.collect()] == [(9, 4)]
    assert assemble.logs(decoded(spark, [E.begin(1, 0, 1), E.commit(1, 1, 0)])) == []


def test_a_row_of_the_wrong_length_fails(spark):
    payloads = [E.begin(1, 0, 1), E.relation(7, "public", "t", COLUMNS), E.insert(7, ["1", "a"]), E.commit(1, 1, 0)]
    ((_, log),) = assemble.logs(decoded(spark, payloads))
    with pytest.raises(Exception, match="3 columns, values: 2"):
        log.collect()
    with pytest.raises(assemble.EmptyRelation):
        assemble.row_schema([], spark)
    assert assemble.row_schema([emit.Source("id", 20, -1, True)], spark).fields[-1].nullable is False


def test_truncates_go_to_each_relation_and_commits_are_fenced(spark):
    payloads = [E.begin(9, 0, 1), E.relation(7, "public", "t", COLUMNS), E.relation(9, "public", "u", COLUMNS), E.truncate([7, 9], 3), E.commit(9, 9, 0)]
    d = decoded(spark, payloads)
    assert {(s.name, r.op) for s, log in assemble.logs(d) for r in log.collect()} == {("t", "t"), ("u", "t")}
    rows = spark.createDataFrame([(1, at(1)), (2, at(5)), (3, at(4)), (150_000, at(3)), (150_001, at(9))], "frame_no bigint, commit_lsn string")
    assert {r[0] for r in assemble.out_of_order(rows).collect()} == {at(4), at(3)}


@pytest.mark.parametrize("bad", [b"I\0\0\0\x07N\0\1t\0\0\0\x09a", b"D\0\0\0\x07N\0\0", b"U\0\0\0\x07K\0\0", b"I\0\0\0\x07N\0\1?", b"I\0\0", b"I\0\0\0\x07N\0\0!"])
def test_malformed_frames_fail_like_single_payloads(spark, bad):
    with pytest.raises(wire.Malformed):
        wire.decode(bad)
    rows = wire._Rows()
    with pytest.raises(wire.Malformed):
        rows.add(1, at(1), wire.State(), bad)


# Catalog


def test_checks_before_a_stream():
    good = catalog.Server(True, "logical", 150_000, 1, 10, 2, 10)
    assert catalog.server_findings(good) == []
    bad = catalog.server_findings(catalog.Server(False, "replica", 130_000, 10, 10, 3, 3))
    assert len(bad) == 5 and all(f.terminal for f in bad)
    needed = [("x", "a"), ("x", "b")]
    assert catalog.publication_findings(False, set(), needed, False)[0][0].check == "no publication"
    assert catalog.publication_findings(False, set(), needed, True) == ([], ['CREATE PUBLICATION {name} FOR TABLE "x"."a", "x"."b"'])
    assert catalog.publication_findings(True, {("x", "a")}, needed, True)[1] == ['ALTER PUBLICATION {name} ADD TABLE "x"."b"']
    assert [f.subject for f in catalog.publication_findings(True, {("x", "a")}, needed, False)[0]] == ["x.b"]
    taps = {("capture", "ddl_command_end"), ("capture_drop", "sql_drop")}
    assert catalog.capture_findings(taps, {"columns"}, True, True) == []
    assert len(catalog.capture_findings(set(), set(), False, False)) == 4 and len(catalog.capture_findings(taps, {"columns"}, True, False)) == 1


# Schema events


def test_versions_follow_structural_events(spark):
    rows = [(1, "p", "t", at(5), "ALTER TABLE"), (1, "p", "t", at(5), "ALTER TABLE"), (1, "p", "t", at(7), "comment"), (1, "p", "t", at(9), "alter table"), (1, "p", "u", None, "ALTER TABLE")]
    events = ddl.versions(spark.createDataFrame(rows, "epoch bigint, source_schema string, source_table string, lsn string, tag string"))
    assert sorted((r.lsn, r.schema_version, r.cuts) for r in events.collect()) == [(at(5), 2, True), (at(7), 2, False), (at(9), 3, True)]
    changes = spark.createDataFrame([(n, 1, "p", "t", at(n)) for n in (4, 5, 8, 9)] + [(99, 2, "p", "t", at(9))], "rid bigint, epoch bigint, source_schema string, source_table string, lsn string")
    assert {r.rid: r.schema_version for r in ddl.version_at(changes, events).collect()} == {4: 1, 5: 2, 8: 2, 9: 3, 99: 1}


def loader(spark, tmp_path, control=None):
    control = control or ControlStore()
    epoch = control.epoch() or control.next_epoch()
    control.add_version(epoch, "p", "t", 1, [{"name": "id", "type": "int8", "spark": "bigint", "pos": 1}, {"name": "v", "type": "text", "spark": "string", "pos": 2}])
    return TableLoader(spark, control, f"file://{tmp_path}/t", epoch, "p", "t", ["id"], buckets=1)


def test_events_of_a_table(spark, tmp_path):
    b = loader(spark, tmp_path)
    b.create(1)
    b.create(1)
    assert b.mirror().columns == ["id", "v"] and b.mirror().count() == 0
    assert b.consume(at(1), "COMMENT", comment=("v", "a note")) is None
    cols = [{"name": "id", "type": "int8", "spark": "bigint", "pos": 1}]
    assert b.consume(at(2), "ALTER TABLE", cols) == 2 and b.control.version(1, "p", "t")[0] == 2
    assert b.control.db.execute("SELECT column_name, text FROM comment").fetchall() == [("v", "a note")]
    b.control.set_comment(1, "p", "t", None, "v")
    assert b.control.db.execute("SELECT count(*) FROM comment").fetchone()[0] == 0
    new = b.rename("t2")
    assert new.control.version(1, "p", "t2")[0] == 2 and new.mirror().count() == 0
    new.control.add_ready(1, "p", "t2", "x", "stream", 1, at(1), at(2), 2)
    assert new.consume(at(3), "DROP TABLE") is None
    assert new.control.claim_ready(1, "p", "t2") == [] and new.mirror() is None and len(new.control.pending_ddl(1)) == 3


# Staging, restarts


def test_files_count_only_with_their_row(spark, tmp_path):
    control = ControlStore()
    writer = staging.Writer(spark, f"file://{tmp_path}/s", control)
    df = spark.range(10)
    uri = writer.write(df, 1, "p", "t", at(9))
    assert uri.startswith(f"file://{tmp_path}/s/1/p/t/{at(9)}-") and control.frame(spark, "file").count() == 0
    writer.discard(uri)
    writer.discard(uri)
    staged = writer.stage(df, 1, "p", "t", at(1), at(9), 1)
    assert [r.row_count for r in control.frame(spark, "file").collect()] == [10] and spark.read.parquet(staged).count() == 10
    assert staging.configure_store(spark, "http://store:9000", path_style=True, tls=False)["fs.s3a.path.style.access"] == "true"
    empty = spark.range(0)
    assert staging.key_ranges(empty, "id", 4) == [] and staging.export_ranges(empty, "id", 4, at(1)).count() == 0
    some = spark.createDataFrame([(1, bytearray(b"\xab")), (7, None), (None, None)], "id bigint, b binary")
    assert {(r.id, r.b, r.range_no) for r in staging.export_ranges(some, "id", 2, at(1)).collect()} == {("1", r"\xab", 0), ("7", None, 1), (None, None, -1)}


def test_spilled_rows_wait_for_their_commit(spark, tmp_path):
    control = ControlStore()
    spills = staging.Spills(staging.Writer(spark, f"file://{tmp_path}/s", control))
    kept, gone = (spills.spill(spark.range(n), 1, "p", "t", n, at(n), 1) for n in (3, 4))
    assert control.claim_ready(1, "p", "t") == [] and spills.abort(4) == 1 and spills.abort(4) == 0 and spills.commit(9, at(9)) == []
    (uri,) = spills.commit(3, at(77))
    (f,) = control.claim_ready(1, "p", "t")
    assert (f.uri, f.kind, f.row_count, f.lsn_end) == (uri, "spill", 3, at(77)) and f"{at(77)}-" in uri and spark.read.parquet(uri).count() == 3
    assert len(list((tmp_path / "s").rglob("*.parquet"))) == 1 and kept != uri and gone


def test_a_lost_stream_begins_a_new_epoch(spark, tmp_path):
    control = ControlStore()
    writer = staging.Writer(spark, f"file://{tmp_path}/s", control)
    tables = {("p", "t"): spark.createDataFrame([(1, "a")], "id bigint, v string")}
    first = epochs.begin(control, writer, tables, at(5))
    control.ensure_watermark(first, "p", "t")
    assert epochs.resume(control, writer, tables, at(6), True, True, False) == (contract.Action.RESUME, 1)
    assert epochs.resume(control, writer, tables, at(6), False, False, False) == (contract.Action.RETRY, 1)
    assert epochs.resume(control, writer, tables, at(2), True, True, True) == (contract.Action.FRESH, 2)
    assert not (tmp_path / "s" / "1").exists() and control.frame(spark, "file").select("epoch", "lsn_end").collect() == [(2, at(2))]
    b = loader(spark, tmp_path, control)
    while b.tick():
        pass
    assert [(r.id, r.v) for r in b.mirror().collect()] == [(1, "a")] and b.schemas.lookups == 1


# Flow and monitoring


def test_intake_stops_and_goes_on_with_hysteresis(spark):
    totals = [10, 85, 70, 61, 60, 84, 90, None]
    rows = spark.createDataFrame([("a", f"2025-01-01 00:00:{i:02}", t, 100) for i, t in enumerate(totals)] + [("z", "2025-01-01 00:00:00", 0, 0)], "instance string, at string, total int, ceiling int")
    got = {(r.instance, int(r.at[-2:])): r.paused for r in flow.backpressure(rows).collect()}
    assert [got["a", i] for i in range(8)] == [False, True, True, True, False, False, True, True] and got["z", 0]


def test_what_is_shed_first(spark):
    rows = [("a", "t", None, 50), ("a", "t", 1, 60), ("b", "t", 1, 70), ("b", "s", 2, 70), ("c", "t", 1, 10)]
    got = {r.instance: (r.action, r.source_table, r.xid) for r in flow.shed(spark.createDataFrame(rows, "instance string, source_table string, xid bigint, bytes bigint"), 100).collect()}
    assert got == {"a": ("flush committed", None, None), "b": ("spill open transaction", "s", 2), "c": (None, None, None)}


def test_returns_of_beats_are_found_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(flow, "BLOCK_BITS", 2, raising=False)
    day = lambda n: None if n is None else datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=n)
    beats = [("a", n, day(n)) for n in (-9, -8, 0, 1, 1, 3, 4, 7, 20, 41, 99)] + [("b", 5, day(5)), (None, 5, day(5)), ("a", None, day(5))]
    returns = [("a", n, day(m)) for n, m in ((-8, 2), (1, 50), (1, 40), (3, None), (9, 30), (9, 90), (40, 400), (41, 300), (90, 200), (None, 1))] + [("b", 4, day(6)), (None, 9, day(9))]
    schema = "instance string, seq bigint, at timestamp_ntz"
    df = flow.beat_health(spark.createDataFrame(beats, schema), spark.createDataFrame(returns, schema), 3600, "2025-01-01 01:30:00")
    first = {(i, n): min([t for j, m, t in returns if n is not None and i is not None and j == i and m is not None and m >= n and t], default=None) for i, n, _ in beats}
    want = [(i, n, at, first[i, n], (first[i, n] or day(90)) > at + datetime.timedelta(hours=1)) for i, n, at in beats]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert "unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString(), "such a frame is computed anew for each row"


def test_errors_and_health():
    class Other(Exception):
        pass

    chained = Other()
    chained.__cause__ = monitor.ServiceError("x", monitor.Exit.PREFLIGHT)
    assert monitor.exit_status(chained) is monitor.Exit.PREFLIGHT and monitor.exit_status(None) is monitor.Exit.SUCCESS
    assert monitor.exit_status(OSError()) is monitor.Exit.STORE and monitor.exit_status(ConnectionError()) is monitor.Exit.SOURCE and monitor.exit_status(Other()) == 70
    health, stop, done = monitor.Health(), threading.Event(), []
    assert health.probes() == {"startup": 503, "ready": 503, "healthz": 503}

    def step():
        done.append(1)
        if len(done) == 5:
            stop.set()  # the step at work ends
        return True

    assert monitor.run_until_drained(step, stop, health, every=2, upkeep=lambda: done.append(0)) == 4 and done == [1, 1, 0, 1, 1, 0]
    assert health.probes() == {"startup": 200, "ready": 503, "healthz": 200}


def test_alerts_hold_for_their_time(spark):
    rule = [monitor.Rule("high", "m", "value > 5", 20)]
    rows = [("m", "s", f"2025-01-01 00:00:{t:02}", v) for t, v in ((0, 6), (10, 7), (20, 9), (30, 1), (40, 8), (50, None))]
    samples = spark.createDataFrame(rows, "metric string, subject string, at string, value int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert [(str(r.since)[-2:], str(r.at)[-2:]) for r in monitor.alerts(samples, rule).collect()] == [("00", "20")]
    assert monitor.alerts(samples.where("false")).count() == 0


def test_plans_and_recombined_values(spark):
    p = plan.TablePlan.of("t", [emit.Source("id", 20, -1, True), emit.Source("r", 3904), emit.Source("v", 25)])
    assert p.keys == ["id"] and len(p.data_columns) == 6 and [f.resolvable for f in p.fields] == [False, False, True]
    df = spark.createDataFrame([(14, 1, 0), (0, 0, 0), (-1, 0, -3_600_000_001), (None, 1, 1)], "m int, d int, u bigint")
    assert [r[0] for r in df.select(pgtext.interval_text("m", "d", "u")).collect()] == ["1 year 2 mons 1 day", "00:00:00", "-1 mons -01:00:00.000001", None]
    wrong = spark.createDataFrame([(1 << 62,), (None,)], "t bigint")
    assert [r[0] for r in wrong.select(pgtext.wire_time("t")).collect()] == [None, None]
    with pytest.raises(Exception, match="not a time"):
        wrong.select(pgtext.wire_time("t", strict=True)).collect()
    assert plan.registered_schema([{"name": "id", "spark": "bigint"}]).names == ["id", "sink_meta"]


def test_key_changes_have_no_values(spark):
    log = spark.createDataFrame([(2, "x", "u", at(1), at(1), ["v"], 1)], "id bigint, v string, op string, commit_lsn string, lsn string, unchanged array<string>, old bigint")
    gone = [r for r in mirror.key_changes(log, ["id"], ["old"]).collect() if r.op == "d"]
    assert [(r.id, r.v, r.unchanged) for r in gone] == [(1, None, None)]


def test_exports_are_leased_and_go_chunk_by_chunk():
    c = ControlStore()
    r = c.request_reload(1, "p", "t")
    assert c.claim_reload(1, "a", 10, now=0) == r and c.stuck_reloads(1, now=5) == [] and c.adopt_reloads(1, "b", 10, now=5) == []
    assert c.adopt_reloads(1, "a", 10, now=5) == [r]  # its own, after a restart
    assert c.stuck_reloads(1, now=20) == [r] and c.adopt_reloads(1, "b", 10, now=20) == [r] and not c.renew_reload(r, "a", 10, now=21)
    assert c.advance_reload(r, 1, "k1", at(7), 3) and not c.advance_reload(r, 3, "k3", at(9), 3) and not c.advance_reload(r, 2, "k2", at(8), 4)
    assert c.reload_floor(1, "p", "t") == at(7)
    c.add_ready(1, "p", "t", "u", "reload", 1, at(7), at(7), 3, r)
    assert c.fail_reload(r, "gave up") == 1 and c.reload_floor(1, "p", "t") is None and c.reload_state(r)[0] == "failed"
    assert json.loads(json.dumps(c.verify_or_create("s", at(4)))) == [True, at(4)] and c.confirm("s", at(2)) == at(4)

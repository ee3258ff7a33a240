"""Positions, object names, envelopes and typed parsers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changeloom.functions import emit, envelope, lsn, objects, pgtext, pgtypes


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_positions_in_any_spelling(spark):
    texts = ["0/16B3748", "16b3748", "00000000016B3748", " 1/0 ", "FFFFFFFF/FFFFFFFF", "", "x", "1/2/3", None, "12345678901234567"]
    assert values(spark, texts, lsn.normal("t")) == [
        "00000000016B3748", "00000000016B3748", "00000000016B3748", "0000000100000000", "F" * 16, None, None, None, None, None,
    ]


def test_position_text_order_is_numeric_order(spark):
    numbers = [0, 1, 2**31, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(str(n),) for n in numbers], "n string").select(F.col("n").cast("decimal(20,0)").alias("n"))
    rows = df.select("n", lsn.from_number("n").alias("t")).orderBy("t").collect()
    assert [int(r["n"]) for r in rows] == numbers
    assert [r["t"] for r in rows] == [f"{n:016X}" for n in numbers]
    back = df.select(lsn.number(lsn.from_number("n")).alias("b"), "n").collect()
    assert all(r["b"] == r["n"] for r in back)


def test_position_arithmetic(spark):
    row = spark.range(1).select(
        lsn.minus(F.lit("0000000100000000"), 1).alias("a"), lsn.minus(F.lit("0" * 16), 5).alias("b"),
        lsn.lag(F.lit("0000000000000010"), F.lit("0000000000000001")).alias("c"), lsn.lag(F.lit("0" * 16), F.lit("F" * 16)).alias("d"),
        lsn.short(F.lit("00000001000000A0")).alias("e"), lsn.short(F.lit("0" * 16)).alias("f"),
    ).first()
    assert (row.a, row.b, int(row.c), int(row.d), row.e, row.f) == ("00000000FFFFFFFF", "0" * 16, 15, 0, "1/A0", "0/0")


def test_object_names(spark):
    same = ["s3://b/k/x.parquet", "S3://b/k/x.parquet", "s3a://b//k/x.parquet", "s3n://b/k/./x.parquet", "s3://b/./k/././x.parquet", "s3:///b///k/x.parquet"]
    assert set(values(spark, same, objects.object_name("t"))) == {"b/k/x.parquet"}
    assert values(spark, ["s3://b/k/.x/y..z", None], objects.object_name("t")) == ["b/k/.x/y..z", None]
    assert values(spark, ["b/1/s/t/00000000f9a00200-1-2.parquet", "b/x"], objects.object_position("t")) == ["00000000F9A00200", None]


def test_envelope_reads_any_spelling(spark):
    df = spark.createDataFrame(
        [('{"epoch":"2","xid":7,"unchanged_toast":["a_b"],"other":{"x":1}}',), ('{"xid":null,"epoch":2}',), ("broken",), (None,)], "sink_meta string"
    )
    rows = envelope.read(df, "epoch", "xid", "unchanged_toast").collect()
    assert [(r.m_epoch, r.m_xid, r.m_unchanged_toast) for r in rows] == [(2, "7", ["a_b"]), (2, None, None), (None, None, None), (None, None, None)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("INTEGER", "int4"), ("int", "int4"), ("character varying( 40 )", "varchar(40)"), ("numeric(10, 2)", "numeric(10,2)"), ("decimal(10,2)", "numeric(10,2)"),
        ("numeric(10)", "numeric(10,0)"), ("numeric", "numeric"), ("timestamp(3) with time zone", "timestamptz(3)"), ("timestamp without time zone", "timestamp"),
        ("double  precision", "float8"), ("float(10)", "float4"), ("float(30)", "float8"), ("char", "bpchar(1)"), ("bpchar", "bpchar"), ("int4[3]", "int4[]"),
        ("pg_catalog.int8", "int8"), ("mood", "mood"), ("", ""), (None, None),
    ],
)
def test_type_spellings(text, want):
    assert pgtypes.canonical(text) == want


def test_decimals_are_never_rounded(spark):
    assert [None if v is None else str(v) for v in values(spark, ["1.25", "1.255", "-3", ".5", "1e3", "", None, "123456789.00"], pgtext.decimal("t", 10, 2))] == [
        "1.25", None, "-3.00", "0.50", None, None, None, None,
    ]


def test_strict_parsers_fail(spark):
    with pytest.raises(Exception, match="not a value of type numeric"):
        values(spark, ["1.255"], pgtext.decimal("t", 10, 2, strict=True))


def test_scalars(spark):
    assert values(spark, ["t", "false", "yes", None], pgtext.boolean("t")) == [True, False, None, None]
    assert values(spark, ["\\x00ff", "\\x0", "00"], pgtext.binary("t")) == [bytearray(b"\x00\xff"), None, None]
    assert values(spark, ["{A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11}", "nope"], pgtext.uuid("t")) == ["a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", None]
    assert values(spark, ["32767", "32768", "1.0"], pgtext.integer("t", "smallint")) == [32767, None, None]
    assert values(spark, ["2024-01-02 03:04:05.678+02", "infinity"], pgtext.timestamp("t", zone=True).cast("string")) == ["2024-01-02 01:04:05.678", None]


def test_clock_and_zone(spark):
    assert values(spark, ["00:00:00.1234567", "23:59", "x"], pgtext.clock_micros("t")) == [123456, 86340 * 10**6, None]
    assert [tuple(v) if v else v for v in values(spark, ["01:02:03-05:30", "01:02:03+02", "01:02:03"], pgtext.timetz("t"))] == [
        (3723 * 10**6, -19800), (3723 * 10**6, 7200), None,
    ]


def test_intervals(spark):
    texts = ["1 year 2 mons 3 days 04:05:06.789", "-1 days +02:03:00", "@ 1 hour 5.5 secs ago", "00:00:00", "", "soon"]
    assert [tuple(v) if v else None for v in values(spark, texts, pgtext.interval("t"))] == [
        (14, 3, 14706789000), (0, -1, 7380000000), (0, 0, -3605500000), (0, 0, 0), None, None,
    ]


def test_ranges(spark):
    texts = ["[1,10)", "empty", "(,5]", "[3,)", '["a,b","c""d"]', "[1,2", None]
    assert [tuple(v) if v else None for v in values(spark, texts, pgtext.range_parts("t"))] == [
        ("1", "10", True, False, False), (None, None, False, False, True), (None, "5", False, True, False), ("3", None, True, False, False),
        ("a,b", 'c"d', True, True, False), None, None,
    ]
    multi = values(spark, ["{}", '{[1,2),["x,y",z]}', "{[1,2)", None], pgtext.multirange_parts("t"))
    assert multi[0] == [] and [r["lower"] for r in multi[1]] == ["1", "x,y"] and multi[2:] == [None, None]


def test_shapes(spark):
    assert values(spark, ["(1,-2.5)", "1,2"], pgtext.point("t")) == [(1.0, -2.5), None]
    assert [v and (v["is_closed"], len(v["points"])) for v in values(spark, ["[(1,2),(3,4)]", "((1,2),(3,4),(5,6))", "(1,2)"], pgtext.path("t"))] == [(False, 2), (True, 3), None]
    assert values(spark, ["<(1,2),3>"], pgtext.circle("t")) == [(1.0, 2.0, 3.0)]
    assert values(spark, ["{1,2,3}"], pgtext.line("t")) == [(1.0, 2.0, 3.0)]
    assert values(spark, ["(3,4),(1,2)"], pgtext.box("t")) == [(3.0, 4.0, 1.0, 2.0)]


def test_emission_by_type(spark):
    df = spark.createDataFrame([("1 day", "[1,5)", "12.50", "sad")], "iv string, r string, n string, m string")
    cols = [c for s in (emit.Source("iv", 1186), emit.Source("r", 3904), emit.Source("n", 1700, (10 << 16 | 2) + 4), emit.Source("m", 20000)) for c in emit.emit(s)]
    row = df.select(*cols).first().asDict()
    assert row["iv_days"] == 1 and row["r_lower"] == 1 and row["r_upper_inc"] is False and str(row["n"]) == "12.50" and row["m"] == "sad"
    assert [emit.tier(emit.Source("x", o)) for o in (23, 1186, 869, 1700)] == [1, 2, 3, 3]
    with pytest.raises(emit.Unsupported):
        emit.emit(emit.Source("x", 1))
    assert '"tier": 2' in emit.descriptor(emit.Source("x", 1266))

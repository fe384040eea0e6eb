"""Column expressions against hand-made edge fixtures (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from tallyscope.functions import inr_display, parse_amount, parse_timestamp, round_half_up, strip_markup
from tallyscope.functions.text import intent_flags, intent_primary

AMOUNTS = [
    ("₹1,23,456.50", 123456.5), ("(100)", 100.0), ("12abc", 12.0), ("12%", 12.0), ("$-7", -7.0),
    (".5", 0.5), ("1e3", 1000.0), (" 5 ", 5.0), ("-", None), ("N/A", None), ("na", None),
    ("null", None), ("NaN", None), ("undefined", None), ("", None), (None, None), ("abc", None),
    ("--5", None), ("1e400", None), ("Infinity", None), ("1.2.3", 1.2), ("0x1F", 0.0),
    (" 12 ", 12.0),
]


def test_parse_amount(spark):
    df = spark.createDataFrame([(s,) for s, _ in AMOUNTS], "s string")
    got = [r[0] for r in df.select(parse_amount(F.col("s"))).collect()]
    assert got == [v for _, v in AMOUNTS]


DATES = [
    ("2023-01-31", dt.datetime(2023, 1, 31)), ("12/31/2023", dt.datetime(2023, 12, 31)),
    ("31/12/2023", dt.datetime(2023, 12, 31)), ("31-12-2023", dt.datetime(2023, 12, 31)),
    ("31.12.2023", dt.datetime(2023, 12, 31)), ("01/02/2024", dt.datetime(2024, 1, 2)),
    ("2023/1/5", dt.datetime(2023, 1, 5)), ("Jan 5, 2024", dt.datetime(2024, 1, 5)),
    ("2029-01-01", None), ("2150-01-01", None), ("1850-01-01", None), ("2023-13-01", None),
    ("n/a", None), ("NA", None), ("null", None), ("", None), (None, None), ("12345", None),
]


def test_parse_timestamp(spark):
    df = spark.createDataFrame([(s,) for s, _ in DATES], "s string")
    got = [r[0] for r in df.select(parse_timestamp(F.col("s"), "2026-12-01")).collect()]
    assert got == [v for _, v in DATES]


def test_round_half_up(spark):
    vals = [(2.345, 2, 2.35), (-2.5, 0, -2.0), (1.005, 2, 1.0), (float("inf"), 2, 0.0),
            (float("nan"), 2, 0.0), (2.5, 0, 3.0), (-0.125, 2, -0.12)]
    df = spark.createDataFrame([(v,) for v, _, _ in vals], "v double")
    for (v, d, want), row in zip(vals, df.collect()):
        got = df.where(F.col("v").eqNullSafe(v) if v == v else F.isnan("v")) \
            .select(round_half_up(F.col("v"), d)).first()[0]
        assert got == want, (v, d, got)


def test_inr_display(spark):
    cases = [(999.5, "₹999.5"), (1000.0, "₹1,000"), (99999.4, "₹99,999"), (99999.7, "₹1,00,000"),
             (123456.0, "₹1.23L"), (12345678.0, "₹1.23Cr"), (-150000.0, "-₹1.5L"), (None, "N/A"),
             (float("nan"), "N/A"), (5.0, "₹5"), (0.1, "₹0.1")]
    df = spark.createDataFrame([(v,) for v, _ in cases], "v double")
    got = [r[0] for r in df.select(inr_display(F.col("v"))).collect()]
    assert got == [s for _, s in cases]


def test_strip_markup(spark):
    html = '<p onclick="x()">Hi <b>there</b></p><script>alert(1)</script> javascript:go  '
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(strip_markup(F.col("h"))).first()[0] == 'Hi there go'


def test_intent(spark):
    qs = [("Why is revenue down? any fraud?", "anomaly"), ("show the monthly trend", "trend"),
          ("top customers", "user"), ("best product", "category"), ("median please", "distribution"),
          ("is it clean", "quality"), ("hello", "overview")]
    df = spark.createDataFrame([(q,) for q, _ in qs], "q string")
    fl = intent_flags(F.col("q"))
    got = [r[0] for r in df.select(intent_primary(fl)).collect()]
    assert got == [p for _, p in qs]
    assert df.select(fl["has_premise"]).first()[0] is True


def test_read_json_lines_first_object_keys(spark, tmp_path):
    from tallyscope.sources.tables import read_json_table
    p = tmp_path / "t.json"
    p.write_text('{"b": 1, "a": null, "n": {"x": 2}}\n{"a": "z", "c": 5}\n')
    df = read_json_table(spark, str(p), multi_line=False)
    assert df.columns == ["b", "a", "n"]
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("1", "", '{"x":"2"}'), ("", "z", "")]


def test_read_delimited_separator_and_padding(spark, tmp_path):
    from tallyscope.sources.tables import read_delimited
    p = tmp_path / "t.csv"
    p.write_text('﻿amount;date;"note; x"\n"1,5";2024-01-02;ok\n\n;;\n7;2024-01-03\n')
    df = read_delimited(spark, str(p))
    assert df.columns == ["amount", "date", "note; x"]
    assert [tuple(r) for r in df.collect()] == [("1,5", "2024-01-02", "ok"), ("7", "2024-01-03", "")]


def test_read_json_array_first_object_keys(spark, tmp_path):
    from tallyscope.sources.tables import read_json_table
    p = tmp_path / "arr.json"
    p.write_text('[\n  {"zeta": 1, "alpha": "x"},\n  {"alpha": "y", "extra": true}\n]\n')
    df = read_json_table(spark, str(p), multi_line=True)
    assert df.columns == ["zeta", "alpha"]
    assert [tuple(r) for r in df.collect()] == [("1", "x"), ("", "y")]

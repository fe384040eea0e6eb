"""Order statistics by narrowing: brute force over awkward doubles, tiny slots and leaves, window bounds."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import order_stats as O
from tallyscope.operators.stats import PERCENTILES, describe_measure

SPECS = [O.disc("q1", .25), O.disc("mid", .5), O.disc("q3", .75), O.rank_spec("low", 0, "0"), O.rank_spec("high", 1, "n - 1"),
         O.rank_spec("second", 0, "1"), O.rank_spec("beyond", 1, "n + 5")]
AT = {"q1": lambda n: int(n * .25), "mid": lambda n: int(n * .5), "q3": lambda n: int(n * .75), "low": lambda n: 0,
      "high": lambda n: n - 1, "second": lambda n: min(1, n - 1), "beyond": lambda n: n - 1}


def order(x):
    return (1, 0) if math.isnan(x) else (0, x)


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in O.order_statistics(df, "v", ["g"], SPECS, **kw).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs.sort(key=order)
        assert got[g]["n"] == len(xs)
        for name, at in AT.items():
            want, have = xs[at(len(xs))], got[g][name]
            assert have == want or (math.isnan(have) and math.isnan(want)), (g, name, have, want)
        one = O.order_statistics(df.where(F.col("g").eqNullSafe(F.lit(g))), "v", [], SPECS, **kw).first()
        assert all(str(one[name]) == str(got[g][name]) for name in AT)


def any_double(rnd):
    return struct.unpack("<d", rnd.randbytes(8))[0]


def test_first_round_keeps_the_order(spark):
    rnd = random.Random(1)
    xs = [any_double(rnd) for _ in range(3000)] + [0.0, -0.0, 5e-324, -5e-324, math.inf, -math.inf, math.nan, 1.0, 2.0]
    for _ in range(500):
        x = abs(any_double(rnd))
        xs += [x, math.nextafter(x, math.inf), math.nextafter(x, 0)]
    xs.sort(key=order)
    df = spark.createDataFrame(list(enumerate(xs)), "i long, _v double")
    slots = [r[0] for r in df.orderBy("i").selectExpr(O._COARSE).collect()]
    assert slots == sorted(slots) and -135536 <= slots[0] and slots[-1] <= 135537
    assert len({s for s, x in zip(slots, xs) if x == 0}) == 1


@pytest.mark.parametrize("accuracy,leaf", [(2, 1), (7, 3), (None, 2), (None, O.LEAF_ROWS)])
def test_awkward_values(spark, accuracy, leaf):
    rnd = random.Random(leaf)
    rows = [("any", any_double(rnd)) for _ in range(60)]
    rows += [("ties", float(rnd.randint(0, 3))) for _ in range(80)] + [("same", 7.25)] * 30
    rows += [("near", 1000 + rnd.random() * 1e-9) for _ in range(60)]
    rows += [("small", v) for v in (-0.0, 0.0, 5e-324, -5e-324, 1e-310, -1e-310)]
    rows += [("ends", v) for v in (math.inf, -math.inf, 1.0, math.inf, 1.7976931348623157e308, -1.7976931348623157e308)]
    rows += [("one", 3.5), (None, 1.0), (None, 2.0), (None, None), ("none", None)]
    rnd.shuffle(rows)
    check(spark, rows, accuracy=accuracy, leaf_rows=leaf)


def test_windows_stay_within_their_bounds(spark, monkeypatch):
    seen = []
    real = O._running

    def counted(slots, keys, order):
        seen.append((order, slots.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_c").alias("rows")).agg(
            F.max("n"), F.max("rows")).first()))
        return real(slots, keys, order)

    monkeypatch.setattr(O, "_running", counted)
    rnd = random.Random(4)
    df = spark.createDataFrame([("g", 100 + rnd.random()) for _ in range(4000)], "g string, v double")
    for by in ([], ["g"]):
        seen.clear()
        O.order_statistics(df, "v", by, SPECS, accuracy=16, leaf_rows=20).collect()
        later = [n[0] for order, n in seen[1:] if order == "_slot"]
        assert later and max(later) <= 16
        assert all(n[1] <= 20 for order, n in seen if order == "_v")


def test_global_brackets_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(20_000).selectExpr("CAST(id AS DOUBLE) AS v").write.parquet(path)
    df = O.order_statistics(spark.read.parquet(path), "v", [], [O.disc("mid", .5)], leaf_rows=1000)
    assert df.first()["mid"] == 10_000.0
    assert "GreaterThanOrEqual(v," in df._jdf.queryExecution().toString()


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert O.order_statistics(df, "v", ["g"], SPECS).collect() == []
    r = O.order_statistics(df, "v", [], SPECS).first()
    assert r["n"] == 0 and r["mid"] is None


def test_describe_is_the_same_for_any_slots(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(rnd.choice("ab"), round(rnd.lognormvariate(3, 2), 2)) for _ in range(900)], "g string, v double")
    want = sorted(map(tuple, describe_measure(df, "v", ["g"]).collect()))
    assert sorted(map(tuple, describe_measure(df, "v", ["g"], accuracy=2).collect())) == want
    assert len(PERCENTILES) == 7


def test_small_groups_take_one_window(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(f"g{rnd.randint(0, 40)}", rnd.choice([any_double(rnd), 1.0, None])) for _ in range(600)]
    df, groups = spark.createDataFrame(rows, "g string, v double"), {}
    for g, v in rows:
        groups.setdefault(g, []).extend([] if v is None else [v])
    monkeypatch.setattr(O, "_first_round", None)  # no brackets are looked for
    for r in O.order_statistics(df, "v", ["g"], SPECS).collect():
        xs = sorted(groups[r["g"]], key=order)
        assert r["n"] == len(xs) and all(str(r[name]) == str(xs[at(len(xs))]) for name, at in AT.items())

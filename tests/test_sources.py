"""Readers: long and one-line JSON openings, arrays read from memory, JSON-first dispatch, trimmed cells, splittable files."""

import gzip
import json
import pathlib

import pytest

from tallyscope.operators.gate import hourly_quota_bans
from tallyscope.session import ensure_checkpoint_dir
from tallyscope.sources import tables
from tallyscope.sources.tables import read_delimited, read_json_table, read_table


@pytest.mark.parametrize("indent", [0, None])
@pytest.mark.parametrize("keys", [3, 250])
def test_columns_are_the_first_objects_keys(spark, tmp_path, indent, keys):
    first = {f"k{i}": i for i in range(keys)} | {"nest": {"a": {"b": "}"}}}
    p = tmp_path / "t.json"
    p.write_text(json.dumps([first, {"k1": 5, "later": 1}], indent=indent))
    df = read_json_table(spark, str(p))
    assert df.columns == list(first) and df.count() == 2


def _bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def _array(path, rows):
    text = ",\n".join(f'{{"id": {i}, "v": {i}.50, "n": {{"k": {i}.10}}, "s": "}}], "}}' for i in range(rows))
    path.write_text(f"[{text}]\n")
    return {(str(i), f"{i}.50", f'{{"k":"{i}.10"}}', "}], ") for i in range(rows)}


def test_numbers_of_an_array_are_not_read_one_by_one(spark, tmp_path):
    p = tmp_path / "t.json"
    want = _array(p, 3000)
    df = read_json_table(spark, str(p))
    before = _bytes_read(spark)
    rows = df.collect()
    assert _bytes_read(spark) - before < 4 * p.stat().st_size
    assert len(rows) == 3000 and {tuple(r) for r in rows} == want


def test_array_larger_than_a_split_is_read_once(spark, tmp_path):
    want = _array(tmp_path / "a.json", 3000)
    _array(tmp_path / "b.json", 10)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        df = read_json_table(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3010 and {tuple(r) for r in rows} == want


def test_huge_and_compressed_arrays_are_streamed(spark, tmp_path, monkeypatch):
    want = _array(tmp_path / "a.json", 30)
    (tmp_path / "z").mkdir()
    with gzip.open(tmp_path / "z" / "a.json.gz", "wt") as f:
        f.write((tmp_path / "a.json").read_text())
    assert tables._one_line_files(spark, str(tmp_path / "a.json"))
    assert not tables._one_line_files(spark, [str(tmp_path / "a.json"), str(tmp_path / "z")])
    assert read_json_table(spark, str(tmp_path / "z")).count() == 30
    monkeypatch.setattr(tables, "STREAM_BYTES", 100)
    assert not tables._one_line_files(spark, str(tmp_path / "a.json"))
    assert {tuple(r) for r in read_json_table(spark, str(tmp_path / "a.json")).collect()} == want


def test_array_roundtrip_writes_flat_files_with_all_keys(spark, tmp_path, monkeypatch):
    from tallyscope.plans import queries_io
    ev = spark.range(10_000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(int(id % 30)) AS ts", "id % 7 AS user_id",
        "if(id % 4096 = 0, null, 'buy') AS event_type", "if(id % 4096 = 0, null, id % 11 + 0.5D) AS value",
        "cast(null AS string) AS props")
    ev.union(ev.where("event_id < 100")).write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    monkeypatch.setattr(queries_io, "read_json_table", lambda s, p: seen.append(p) or read_json_table(s, p))
    got = {r.day: r.val for r in queries_io.q_json_array(spark, str(tmp_path)).collect()}
    want = {}
    for i in (i for i in range(10_000) if i % 4096):
        day = f"2024-01-{i % 30 + 1:02d}"
        want[day] = want.get(day, 0) + i % 11 + 0.5
    assert {str(k): v for k, v in got.items()} == want
    files = [json.loads(p.read_text()) for p in pathlib.Path(seen[0].removeprefix("file:")).glob("*.txt")]
    files = [f for f in files if f]
    assert sorted(len(f) for f in files) == [1808, 4096, 4196] and all(len(o) == 6 for f in files for o in f)


def test_broken_first_object_raises(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text('[{"a" 1}]')
    with pytest.raises(ValueError):
        read_json_table(spark, str(p))


def test_read_table_looks_for_json_first(spark, tmp_path):
    for name, text in (("a.txt", '\n [{"a": "1", "b": 2}]'), ("b.dat", '{"a": 1, "b": 2}\n{"a": 3, "b": 4}\n'),
                       ("c.txt", "a,b\n1,2\n")):
        (tmp_path / name).write_text(text)
        df = read_table(spark, str(tmp_path / name))
        assert df.columns == ["a", "b"] and tuple(df.first()) == ("1", "2")


def test_cells_are_trimmed_and_blank_rows_dropped(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a,b\n" x ",y\n"  ","\t"\n"p ""q"" ",\n')
    assert [tuple(r) for r in read_delimited(spark, str(p)).collect()] == [("x", "y"), ('p "q"', "")]


def test_large_file_is_split(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n" + "1,22222222\n" * 50_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert read_delimited(spark, str(p)).rdd.getNumPartitions() > 3
        assert read_delimited(spark, str(p)).count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_every_ban_of_a_client_is_found(spark):
    rows = spark.range(40).selectExpr("id", "'c' AS ip", "timestamp_seconds(id * 100) AS ts")
    bans = hourly_quota_bans(rows, quota=1, ban_seconds=150)
    want, end, hits = 0, -1, {}
    for t in range(0, 4000, 100):
        if t < end:
            continue
        hits[t // 3600, end] = hits.get((t // 3600, end), 0) + 1
        if hits[t // 3600, end] > 1:
            want, end = want + 1, t + 150
    assert bans.count() == want > 8


def test_cluster_needs_a_shared_folder(spark):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "local-cluster[2,1,1024]"
        getCheckpointDir = getConf = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context
    Context.getConf = staticmethod(lambda: Conf)
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)


def test_bounds_of_a_few_groups_are_broadcast(spark, monkeypatch):
    from tallyscope.model import Roles
    from tallyscope.operators import clean
    plans, real = {}, clean.land_table

    def landed(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(clean, "land_table", landed)
    df = spark.createDataFrame([("abc"[i % 3], float(i % 17)) for i in range(300)], "flag string, price double")
    facts = clean.build_facts(df, Roles(revenue="price"), ["flag"], land=True).df
    assert facts.count() == 51 and "BroadcastHashJoin" in plans["facts"] and "SortMergeJoin" not in plans["facts"]

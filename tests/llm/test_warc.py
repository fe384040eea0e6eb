"""WARC bundles: exact round trip, plain Zstandard readability and single-record seeks."""

import hashlib
import io

import zstandard

from tallyscope.llm import warc

ROWS = [(1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (3, "u", "x" * 999), (4, "u", "x" * 999),
        (5, None, None), (6, "é", "ünï" * 900), (6, "é", "ünï" * 900), (None, "n", "ünï" * 900), (7, "u\r\nX: y", ""),
        (8, "big", "long " * 400_000), (2, "http://b", "x" * 1500)]


def expect(rows):
    heads = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            heads[b] = max(heads.get(b, p), p)
    count = {}
    for _, _, h in rows:
        count[(h or "").encode()] = count.get((h or "").encode(), 0) + 1
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in heads and count[b] > 1 and p != heads[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response",
                    heads[b] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS salt")
    index, folder = warc.write_archives(pages.repartition(3), str(tmp_path / "w"))
    got = warc.read_archives(index, folder)
    rows = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == expect(ROWS)
    bodies = {r.record_id: (r.record_type, bytes(r.body)) for r in got.collect()}
    for r in index.collect():
        head, body = warc.read_record(r, folder)
        assert head["WARC-Record-ID"] == f"<{r.record_id}>"
        assert bodies[r.record_id] == (head["WARC-Type"], body)
    for name in {r.bundle for r in index.collect()}:  # frames and seek table are one valid stream
        data = (tmp_path / "w" / name).read_bytes()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == sum(r.bundle == name for r in index.collect())


def test_frames_and_bundles_split(spark, tmp_path, monkeypatch):
    out = io.BytesIO()
    w = warc.BundleWriter(out)
    sizes = [w.add(bytes([i]) * (1000 + i)) for i in range(5)]
    w.finish()
    data = out.getvalue()
    table = warc.seek_table(io.BytesIO(data), len(data))
    assert [(s[1], s[2]) for s in sizes] == [(t[0], t[1]) for t in table]
    assert [t[2] for t in table] == [1000 + i for i in range(5)]


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index, folder = warc.write_archives(pages, str(tmp_path / "e"))
    assert index.count() == 0 and warc.read_archives(index, folder).count() == 0


def test_frames_are_read_by_many_tasks(spark):
    rows = [(i, f"r{i}", f"b{i % 40:02d}.warc.zst", i // 80, 900 * (i // 80), 900, 50 * (i // 40 % 2), 50) for i in range(1600)]
    index = spark.createDataFrame(rows, warc.INDEX)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        found = warc.frames(index)
        tasks = found.groupBy(warc.F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(tasks) >= 36 and max(r["count"] for r in tasks) <= 3 * 800 / len(tasks)
    places = found.where("bundle = 'b07.warc.zst' and frame_start = 900").first().places
    assert [(p.offset, p.length, p.record_id) for p in places] == [(0, 50, "r87"), (50, 50, "r127")]


def test_revisits_name_the_record_they_refer_to(spark, tmp_path):
    pages = spark.createDataFrame([r for r in ROWS if r[0] != 8], "page_id long, url string, html string")
    index, folder = warc.write_archives(pages.repartition(2), str(tmp_path / "r"))
    ids = {r.record_id for r in index.collect()}
    heads = [warc.read_record(r, folder)[0] for r in index.collect()]
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert revisits and all(h["WARC-Refers-To"][1:-1] in ids for h in revisits)
    assert all(h["Content-Type"].startswith("text/html") for h in heads)
    again, other = warc.write_archives(pages.repartition(5), str(tmp_path / "s"))
    known = "page_id IS NOT NULL"
    assert {r.record_id for r in again.where(known).collect()} == {r.record_id for r in index.where(known).collect()}


def test_a_wrong_index_is_noticed(spark, tmp_path):
    import pytest
    pages = spark.createDataFrame(ROWS[:4], "page_id long, url string, html string").coalesce(1)
    index, folder = warc.write_archives(pages, str(tmp_path / "x"))
    with pytest.raises(Exception, match="does not cover"):
        warc.read_archives(index.where("page_id <> 1"), folder).collect()


def test_object_stores_go_by_both_names():
    assert warc._uri("s3a://bucket/a/b") == "s3://bucket/a/b" and warc._uri("file:///tmp/x") == "file:///tmp/x"
    assert warc._uri("/tmp/x") == "file:///tmp/x"

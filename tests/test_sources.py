import json

import pytest
from pyspark.sql import functions as F

from chronotext import schemas
from chronotext.session import new_dir
from chronotext.sources import feeds, golden, segments, snapshots, tables


def test_feed(spark, tmp_path):
    (tmp_path / "feed.tsv").write_text(
        "id1\tA title\t20230405\t12.5\t99\nid2\tB\tNA\tNA\tNA\nno tab here\n\nid3\tC\t20231345\t1.2.3\tx\nid4\tD\n")
    got = {r.video_id: r for r in feeds.read_feed(spark, str(tmp_path)).collect()}
    assert set(got) == {"id1", "id2", "id3", "id4"}
    assert (str(got["id1"].upload_date), got["id1"].duration_seconds, got["id1"].view_count) == ("2023-04-05", 12, 99)
    for k in ("id2", "id3", "id4"):
        assert (got[k].upload_date, got[k].duration_seconds, got[k].view_count) == (None, 0, 0)
    assert got["id1"].url.endswith("watch?v=id1")


def test_playlists(spark):
    df = spark.createDataFrame([("p1\t First ",), ("bad",)], "value string")
    assert [tuple(r) for r in feeds.parse_playlists(df).collect()] == [
        ("p1", "First", "https://www.youtube.com/playlist?list=p1")]


def test_segments(spark, tmp_path):
    rows = [{"video_id": "v", "channel_id": "c", "segments": [{"text": " a ", "start": 0, "duration": 2},
                                                              {"text": "b", "start": 2, "end": 5}]}]
    (tmp_path / "t.json").write_text("\n".join(json.dumps(r) for r in rows))
    t = segments.read_segments(spark, str(tmp_path))
    assert [tuple(r)[2:] for r in segments.segment_rows(t).collect()] == [(0, "a", 0.0, 2.0, 2.0), (1, "b", 2.0, 3.0, 5.0)]
    back = segments.gather_segments(segments.segment_rows(t))
    assert back.select(segments.full_text(F.col("segments"))).first()[0] == "a b"


def test_tiers(spark):
    def tier(**videos):
        return spark.createDataFrame([(k, [(t, 0.0, 1.0, 1.0) for t in v]) for k, v in videos.items()],
                                     "video_id string, segments array<struct<text:string,start:double,duration:double,"
                                     "end:double>>")
    got = segments.first_available([("one", tier(a=["x"], b=[])), ("two", tier(a=["y"], b=["z"], c=[]))])
    assert {(r.video_id, r.tier, r.segments[0].text) for r in got.collect()} == {("a", "one", "x"), ("b", "two", "z")}


def test_golden(spark, tmp_path):
    cases = [{"id": "1", "question": "q", "query_type": "t", "should_refuse": True},
             {"id": "2", "question": "r", "expected_answer_contains": ["x", "y"],
              "context_history": [{"role": "user", "content": "before"}]}]
    (tmp_path / "g.json").write_text(json.dumps(cases))
    got = golden.read_golden(spark, str(tmp_path / "g.json")).orderBy("id").collect()
    assert got[0].should_refuse and got[1].expected_answer_contains == ["x", "y"]
    assert got[1].context_history[0].content == "before"
    golden.write_report(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().a == 1


def test_catalog_schemas(spark):
    root = new_dir(spark, "catalog")
    for name, schema in schemas.CATALOG.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
        assert [f.name for f in tables.read_catalog(spark, root, name).schema] == [f.name for f in schema]


def test_write_upsert_touches_only_its_partitions(spark):
    path = new_dir(spark, "up")
    cols = "k int, v string, n int, ch string"
    df = lambda rows: spark.createDataFrame(rows, cols)
    put = lambda rows, **kw: tables.write_upsert(spark, path, df(rows), ["k"], [F.col("n")], "ch", **kw)
    put([(1, "a", 1, "x"), (1, "b", 2, "x"), (2, "c", 1, "y")])
    before = {r.file for r in spark.read.parquet(path).where("ch = 'y'").select(F.input_file_name().alias("file")).collect()}
    put([(1, "d", 3, "x"), (3, "e", 1, "x")])
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    after = {r.file for r in spark.read.parquet(path).where("ch = 'y'").select(F.input_file_name().alias("file")).collect()}
    assert got == {1: "d", 2: "c", 3: "e"} and before == after
    put([(1, "no", 9, "x"), (4, "f", 1, "y")], ignore_existing=True)
    assert {r.k: r.v for r in spark.read.parquet(path).collect()} == {1: "d", 2: "c", 3: "e", 4: "f"}


def test_paging_and_round_robin(spark):
    df = spark.createDataFrame([(i, i // 7, "ab"[i % 3 == 0]) for i in range(50)], "id int, day int, ch string")
    got = feeds.page(df, [F.col("id")], F.col("day"), 11, 5).orderBy("position").collect()
    assert [r.id for r in got] == [10, 11, 12, 13, 14]
    assert feeds.pages_of(df, [F.col("id")], F.col("day"), 10, scan_limit=20).count() == 20
    rr = feeds.round_robin(df, "ch", F.when(F.col("ch") == "b", 1).otherwise(2), [F.col("id")], F.col("day"), 2, cap=4)
    assert [(r.ch, r.id) for r in rr.orderBy("position").collect()] == [
        ("b", 0), ("b", 3), ("a", 1), ("a", 2), ("b", 6), ("b", 9), ("a", 4), ("a", 5)]


def test_merge_feeds_cap(spark):
    one = spark.createDataFrame([("a", 2), ("b", 1)], "id string, o int")
    two = spark.createDataFrame([("b", 0), ("c", 5), ("d", 4)], "id string, o int")
    got = feeds.merge_feeds([one, two], "id", [F.col("o")], cap=3).collect()
    assert [(r.id, r.feed) for r in got] == [("b", 0), ("a", 0), ("d", 1)]


def test_stub_parents(spark):
    parents = spark.createDataFrame([("a", "A", 1)], "video_id string, title string, n int")
    kids = spark.createDataFrame([("a",), ("b",), ("b",)], "video_id string")
    got = tables.ensure_parents(kids, parents, "video_id", {"title": F.lit("stub")})
    assert {tuple(r) for r in got.collect()} == {("a", "A", 1), ("b", "stub", None)}


def test_first_row_of_a_feed_wins_and_undated_rows_stay(spark):
    one = spark.createDataFrame([("a", 1, "first"), ("a", 2, "second")], "id string, o int, t string")
    two = spark.createDataFrame([("a", 0, "other"), ("b", 3, "b")], "id string, o int, t string")
    got = {r["id"]: r["t"] for r in feeds.merge_feeds([one, two], "id", [F.col("o")]).collect()}
    assert got == {"a": "first", "b": "b"}
    df = spark.createDataFrame([(1, None, "x"), (2, 5, None), (3, 4, "x"), (4, None, None)], "id int, day int, ch string")
    paged = feeds.pages_of(df, [F.col("day"), F.col("id")], F.col("day"), 2).collect()
    assert {r["id"]: r["position"] for r in paged} == {1: 1, 4: 2, 3: 3, 2: 4}
    assert feeds.round_robin(df, "ch", F.lit(1), [F.col("day"), F.col("id")], F.col("day")).count() == 4


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from chronotext.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_upsert_takes_a_null_key_as_a_key(spark):
    old = spark.createDataFrame([(None, 1, "old"), ("a", 1, "old"), ("b", 1, "old")], "k string, v int, x string")
    new = spark.createDataFrame([(None, 2, "new"), ("a", 3, "new"), (None, 3, "newer")], old.schema)
    rows = lambda ignore: {(r.k, r.x) for r in tables.upsert(old, new, ["k"], [F.col("v")], ignore).collect()}
    assert rows(False) == {(None, "newer"), ("a", "new"), ("b", "old")}
    assert rows(True) == {(None, "old"), ("a", "old"), ("b", "old")}


def test_snapshots(spark):
    path, keys, newest = new_dir(spark, "snap"), ["k"], [F.col("v")]
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    stored = lambda: sorted(((r.k or "", r.v) for r in snapshots.read_snapshot(spark, path, batch(("", 0)).schema).collect()))
    put = lambda n, *rows: snapshots.upsert_batch(spark, path, batch(*rows), n, keys, newest, 4)
    assert stored() == []
    assert put(0, ("a", 1), (None, 1), ("b", 5))
    held = snapshots.read_snapshot(spark, path, batch(("", 0)).schema)
    assert put(1, ("a", 2), ("b", 4), ("c", 1))
    assert stored() == [("", 1), ("a", 2), ("b", 5), ("c", 1)]  # an older version does not replace a newer one
    assert not put(1, ("a", 9)) and not put(0, ("a", 9))  # replayed batches
    assert sorted((r.k or "", r.v) for r in held.collect()) == [("", 1), ("a", 1), ("b", 5)]
    # files of a batch that died before its manifest are not seen
    batch(("z", 1)).write.parquet(f"{path}/data/000000000003-dead/_bucket=0")
    assert stored() == [("", 1), ("a", 2), ("b", 5), ("c", 1)]
    with pytest.raises(RuntimeError):  # the place of a commit is taken once
        snapshots._commit(spark, path, {"commit": 2, "batch": 2, "of": 4, "buckets": {}})

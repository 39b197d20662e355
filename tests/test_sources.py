import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import windows


def test_csv_with_line_breaks_blanks_and_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿id,paths,js,ms\n1," M a\n?? b","{""k"": 1}",1.5\n2,,,\n'.encode())
    df = files.read_csv(spark, str(p), "id int, paths string, js string, ms double")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, " M a\n?? b", '{"k": 1}', 1.5), (2, "", "", None)]
    with pytest.raises(ValueError, match="missing columns"):
        files.read_csv(spark, str(p), "id int, other string")
    out = str(tmp_path / "out")
    files.write_csv(df.fillna(0), out)
    back = files.read_csv(spark, out, "id int, paths string, js string, ms double")
    assert sorted(map(tuple, back.collect())) == [(1, " M a\n?? b", '{"k": 1}', 1.5), (2, "", "", 0.0)]
    with pytest.raises(Exception, match="exist"):
        files.write_csv(df, out)


def test_fragments(spark, tmp_path):
    for i, k in enumerate(["a", "b"]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"row_id": k, "n": i}, indent=1))
    assert files.read_fragments(spark, str(tmp_path), "row_id").count() == 2
    (tmp_path / "9.json").write_text(json.dumps({"row_id": "a", "n": 9}))
    with pytest.raises(Exception, match="repeated fragment a"):
        files.read_fragments(spark, str(tmp_path), "row_id").collect()


def test_json_sink(tmp_path):
    p = tmp_path / "s.json"
    files.write_json({"b": 1, "a": "é"}, str(p))
    assert p.read_bytes() == '{\n  "a": "é",\n  "b": 1\n}\n'.encode()


def test_a_pinned_version_does_not_move(spark, tmp_path):
    root = str(tmp_path / "t")
    assert files.latest(spark, root) == 0
    assert files.publish(spark.range(3).withColumn("s", F.lit("old")), root) == 1
    mine = files.pinned(spark, root)
    assert files.publish(spark.range(4).withColumn("s", F.lit("new")), root) == 2
    assert {r["s"] for r in mine.collect()} == {"old"} and {r["s"] for r in files.pinned(spark, root).collect()} == {"new"}
    assert files.latest(spark, root) == 2
    # the control: a reader of all versions does see a mixture
    assert {r["s"] for r in spark.read.parquet(f"{root}/v=*").collect()} == {"old", "new"}


def test_archive_is_the_same_and_refuses_changes(tmp_path):
    src = tmp_path / "src" / "indexes"
    src.mkdir(parents=True)
    (src / "a.db").write_bytes(b"one")
    a, b = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    hashes = files.pack(str(tmp_path / "src"), a)
    files.pack(str(tmp_path / "src"), b)
    assert open(a, "rb").read() == open(b, "rb").read()
    files.install_pack(a, hashes, str(tmp_path / "to"))
    assert (tmp_path / "to" / "indexes" / "a.db").read_bytes() == b"one"
    with pytest.raises(FileExistsError):
        files.install_pack(a, hashes, str(tmp_path / "to"))
    with pytest.raises(ValueError, match="changed"):
        files.verify_pack(a, {k: "0" * 64 for k in hashes})
    with pytest.raises(ValueError, match="expected"):
        files.verify_pack(a, {**hashes, "more": "0"})


def test_streams_give_what_batches_give(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    live = windows.stream(spark, sf, "event_id long, ts timestamp, user_id long, event_type string, value double, props string", "events.parquet")

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    want = windows.tumbling(batch, at="ts", by="event_type", value="value")
    got = drain(windows.tumbling(live, at="ts", by="event_type", value="value"), "tumbled", "complete")
    rounded = lambda d: sorted((str(r["window_start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in d.collect())
    assert rounded(got) == rounded(want)
    assert drain(windows.sliding(live, at="ts", by="event_type"), "slid", "complete").count() == windows.sliding(batch, at="ts", by="event_type").count()
    assert drain(windows.once(live, key="event_id", at="ts"), "once_", "append").count() == windows.once(batch, key="event_id", at="ts").count()
    # a session is handed on when the watermark has passed its end
    assert 0 < drain(windows.sessions(live, at="ts", by="user_id"), "sat", "append").count() <= windows.sessions(batch, at="ts", by="user_id").count()


def test_documents_are_written_one_a_file(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, ["y"]), ("a", None, [])], "k string, n int, xs array<string>")
    files.write_documents(df, str(tmp_path / "out"), name="k")
    assert (tmp_path / "out" / "b.json").read_bytes() == b'{\n  "k": "b",\n  "n": 2,\n  "xs": [\n    "y"\n  ]\n}\n'
    assert sorted(r["k"] for r in files.read_documents(spark, str(tmp_path / "out")).collect()) == ["a", "b"]


def test_vectors_as_bytes(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, None), (3, []), (4, [float("inf")])], "id int, v array<float>")
    there = files.vectors_to_bytes(df, "v", "blob")
    assert there.where("id = 1").first()["blob"] == bytes.fromhex("0000c03f000000c0")
    assert sorted((r["id"], r["w"]) for r in files.vectors_from_bytes(there, "blob", "w").collect()) == [(1, [1.5, -2.0]), (2, None), (3, []), (4, [float("inf")])]
    with pytest.raises(Exception, match="4-byte"):
        files.vectors_from_bytes(spark.createDataFrame([(bytearray(b"abc"),)], "blob binary"), "blob", "w").collect()


def test_tables_go_when_they_are_not_needed(spark):
    import os

    from tidemark import session

    folder = lambda t: t.tm_path.removeprefix("file://")
    kept = session.materialise(spark.range(3))
    with session.scope():
        inner = session.materialise(spark.range(4))
        assert inner.count() == 4
    assert not os.path.exists(folder(inner)) and kept.count() == 3
    session.discard(kept, spark.range(1))
    assert not os.path.exists(folder(kept))


def test_a_failing_import_leaves_the_core(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "xxhash", None)
    for m in [m for m in sys.modules if m.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, m)
    with pytest.warns(UserWarning, match="no llm queries") if __import__("importlib.util").util.find_spec("tidemark.llm") else __import__("contextlib").nullcontext():
        assert "certified_topk" in e.queries() and "p7_found" not in e.queries()

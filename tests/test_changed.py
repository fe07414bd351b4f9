"""Changed files: their rows are replaced by the command line, by the stream of listings and by the sinks."""

import json
import os

from pyspark.sql import functions as F

from palaver.__main__ import main
from palaver.sources import sinks, transcripts
from palaver.streaming import incremental


def write(path, text, at):
    path.write_text(json.dumps({"text": text, "segments": [{"start": 0.0, "end": 2.0, "text": text, "speaker": "A"}]}))
    os.utime(path, (at, at))


def test_merge_table(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda rows: spark.createDataFrame(rows, "k string, v int")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    read = lambda: sorted((r.k or "", r.v) for r in spark.read.parquet(path).collect())
    sinks.merge_table(table([("a", 1), ("a", 2), (None, 0)]), path, keys("a"))
    assert read() == [("", 0), ("a", 1), ("a", 2)]
    files = set(os.listdir(path))
    sinks.merge_table(table([("b", 3)]), path, keys("b", None))
    assert files <= set(os.listdir(path))  # appended, nothing rewritten
    for _ in range(2):  # the second time changes nothing
        sinks.merge_table(table([("a", 9)]), path, keys("a", "a"))
        assert read() == [("", 0), ("a", 9), ("b", 3)]
    sinks.merge_table(table([]), path, keys("b"))
    assert read() == [("", 0), ("a", 9)]
    os.rename(path, path + ".old")  # a swap that failed after its first move
    sinks.merge_table(table([("c", 4)]), path, keys("c"))
    assert read() == [("", 0), ("a", 9), ("c", 4)] and not os.path.exists(path + ".old")


def test_new_only_replaces_changed_files(spark, tmp_path, capsys):
    d, out = tmp_path / "in", str(tmp_path / "out")
    d.mkdir()
    write(d / "x.json", "we agreed to ship it.", 1_700_000_000)
    write(d / "y.json", "hello there.", 1_700_000_000)
    assert main(["analyze", str(d), "--out", out, "-q"]) == 0
    write(d / "x.json", "we agreed to wait for spring.", 1_700_000_100)
    write(d / "z.json", "a third call.", 1_700_000_100)
    for _ in range(2):
        assert main(["analyze", str(d), "--out", out, "--new-only", "-q"]) == 0, capsys.readouterr().err
        said = {r.call_id: r.text for r in spark.read.parquet(f"{out}/segments").collect()}
        assert said == {"x": "we agreed to wait for spring.", "y": "hello there.", "z": "a third call."}
        for name in ("segments", "metrics", "documents", "reports", "calls"):
            assert spark.read.parquet(f"{out}/{name}").count() == 3, name
        assert spark.read.parquet(f"{out}/manifest").count() == 3


def test_stream_of_versions(spark, tmp_path):
    d, log, out, seen = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "out"), []
    d.mkdir()

    def read(new):
        seen.append(sorted((r.path.rsplit("/", 1)[1], r.hash) for r in new.collect()))
        return transcripts.read_transcripts(spark, str(d)).select(F.col("source").alias("path"), "text").join(new.select("path"), "path", "left_semi")

    def run():  # a new query each time: a restart from the checkpoint
        incremental.list_files(spark, str(d), log)
        incremental.process_changed(incremental.listings(spark, log), read, out, str(tmp_path / "checkpoint"))
        return sorted(r.text for r in spark.read.parquet(out).collect())

    write(d / "x.json", "first", 1_700_000_000)
    write(d / "y.json", "other", 1_700_000_000)
    assert run() == ["first", "other"]
    assert run() == ["first", "other"] and len(seen) == 1  # the same listing again
    write(d / "x.json", "second", 1_700_000_100)
    assert run() == ["other", "second"]
    write(d / "x.json", "second", 1_700_000_200)  # touched only
    known = spark.read.schema(incremental.LISTING).json(log).where("path like '%y.json'").first().path
    (tmp_path / "log" / "late.json").write_text(json.dumps({"path": known, "mtime": 1.0, "size": 1, "hash": "old"}) + '\n{"path": null, "hash": "h"}\n')
    assert run() == ["other", "second"]
    assert [[f for f, _ in batch] for batch in seen] == [["x.json", "y.json"], ["x.json"]]


def test_runs_are_replaced_in_one_step(spark, tmp_path):
    run = lambda q: spark.createDataFrame([("t", q)], "timestamp string, quality double")
    for q in (1.0, 2.0):
        sinks.write_runs(run(q), str(tmp_path), "latest")
    assert [json.loads(x) for x in (tmp_path / "benchmark-latest.json").read_text().splitlines()] == [{"timestamp": "t", "quality": 2.0}]
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".part")]

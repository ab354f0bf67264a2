"""Sources, sinks, manifests and streams on temporary folders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dialoom.operators import sampling
from dialoom.sources import manifest as M
from dialoom.sources import tables as S
from dialoom.streaming import jobs as J

ENTRY = "group_id string, run_id string, num_logs long, labelled_dataset_path_or_name string, labelled_dataset_split_name string"


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    entries = lambda *rows: spark.createDataFrame([(g, r, n, "d", "train") for g, r, n in rows], ENTRY)
    M.add(spark, path, entries(("a", "1", 5), ("b", "1", 6)))
    M.add(spark, path, entries(("a", "1", 9), ("a", "2", 7)))
    assert sorted((r.run_id, r.num_logs) for r in M.group(spark, path, "a").collect()) == [("1", 5), ("2", 7)]
    M.add(spark, path, entries(("a", "1", 9)), overwrite=True)
    M.remove(spark, path, "a", "2")
    assert [(r.run_id, r.num_logs) for r in M.group(spark, path, "a").collect()] == [("1", 9)]
    M.remove(spark, path, "b", "1")
    assert M.group(spark, path, "b").count() == 0 and M.group(spark, path, "none").count() == 0
    with pytest.raises(Exception, match="blank or has no logs"):
        M.check(entries(("a", " ", 5))).collect()


def test_logs(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "r1"))
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "r2"))
    of = lambda n: spark.createDataFrame([("r1", 4), ("r2", n)], "run_id string, num_logs long")
    frames = [spark.read.parquet(str(tmp_path / r)).withColumn("run_id", F.lit(r)) for r in ("r1", "r2")]
    for r, f in zip(("r1", "r2"), frames):
        f.write.parquet(str(tmp_path / "logs" / r))
    assert M.logs(spark, of(2), str(tmp_path / "logs")).count() == 6
    with pytest.raises(ValueError, match="another count"):
        M.logs(spark, of(3), str(tmp_path / "logs"))


def test_publish_and_scan(spark, tmp_path):
    path = str(tmp_path / "data")
    M.publish(spark.range(3), path, "train")
    M.publish(spark.range(5), path, "validation")
    M.publish(spark.range(4), path, "train")
    assert (S.split(spark, path, "train").count(), S.split(spark, path, "validation").count(), S.split(spark, path, None)) == (4, 5, None)
    assert S.optional(spark, str(tmp_path / "nowhere")) is None
    labelled = spark.createDataFrame([("a",), ("b",), ("a",)], "dialogue_id string")
    name = M.dataset_name("g", labelled)
    assert name.startswith("g_2_") and name == M.dataset_name("g", labelled.orderBy(F.desc("dialogue_id")))
    M.write_json(spark.range(2), str(tmp_path / "json"))
    assert S.json_file(spark, str(tmp_path / "json"), "id long").count() == 2
    (tmp_path / "lines.txt").write_text(" a \nb\n")
    assert [r.value for r in S.lines(spark, str(tmp_path / "lines.txt")).collect()] == ["a", "b"]
    M.text_log(spark.createDataFrame([("d", 1, "m")], "dialogue_id string, turn_id int, message string"), "dst", str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first()[0] == "dst - d - 1 - m"
    assert "- n: 3" in M.card("x", {"n": "3"})
    seen = []
    log = M.StepLogger(lambda n, m: seen.append((n, m)))
    log.log({"a": 1}), log.log({"b": 2}), log.step(), log.step()
    assert seen == [(0, {"a": 1, "b": 2}), (1, {})]
    assert S.turn_type([("hotel", "area"), ("hotel", "name"), ("taxi", "type")])["slot_values"].dataType.fieldNames() == ["hotel", "taxi"]


def test_checkpointed_logs(spark, tmp_path):
    path = str(tmp_path / "running")
    M.checkpoint_logs(spark.range(3), path, "r", 0)
    M.checkpoint_logs(spark.range(2), path, "r", 1)
    M.checkpoint_logs(spark.range(2), path, "r", 1)
    assert spark.read.parquet(path).count() == 5


def test_queue(spark, tmp_path):
    folder, out = str(tmp_path / "queue"), str(tmp_path / "out")
    J.enqueue(spark.createDataFrame([("1", "a"), ("2", "b")], J.JOB), folder)
    run = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    J.drain(spark, folder, str(tmp_path / "ck"), run)
    J.enqueue(spark.createDataFrame([("3", "c")], J.JOB), folder)
    J.drain(spark, folder, str(tmp_path / "ck"), run)
    assert sorted(r.job_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_carried_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "conv_id long, turn long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    J.carried(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r.conv_id, r.turn, r.previous, r.position) for r in got.collect()) == [(1, 0, None, 0), (1, 1, "a", 1), (2, 0, None, 0)]


def test_waves(spark, tmp_path):
    turns = spark.createDataFrame([(c, t) for c in range(3) for t in range(c + 1)], "conv_id long, turn long")
    index = spark.createDataFrame([], "conv_id long, turn long, seen long")
    predict = lambda wave, known: wave.withColumn("seen", F.lit(known.count()))
    got = J.waves(turns, index, predict, str(tmp_path / "w"))
    assert sorted((r.turn, r.seen) for r in got.collect()) == [(0, 0), (0, 0), (0, 0), (1, 3), (1, 3), (2, 5)]
    assert J.waves(turns, index, predict, str(tmp_path / "w")).count() == 6


@pytest.mark.parametrize("share, want", [(0.25, 2), (1, 10), (2, 20), (2.5, 25)])
def test_shares(spark, share, want):
    assert sampling.head_share(spark.range(10), "id", share).count() == want


def test_split_is_disjoint(spark):
    got = sampling.split(spark.range(50).selectExpr("id % 10 as g", "id"), "g", 3)
    groups = {s: {r.g for r in got.where(F.col("split") == s).collect()} for s in ("train", "validation")}
    assert len(groups["validation"]) == 3 and not groups["train"] & groups["validation"]


def test_dialogue_files(spark, tmp_path):
    import json

    from dialoom.sources import tables as T

    for fold, ids in (("train", ["a", "b"]), ("test", ["c"])):
        (tmp_path / fold).mkdir()
        for k, i in enumerate(ids):
            (tmp_path / fold / f"dialogues_{k:03}.json").write_text(json.dumps([{"dialogue_id": i, "turns": [{"n": 0}]}], indent=1))
        (tmp_path / fold / "other.json").write_text("[]")
    (tmp_path / "acts.json").write_text("".join(json.dumps({"dialogue_id": "a", "turn_id": t, "acts": [f"x{t}"]}) + "\n" for t in (1, 0)))
    rows, counts = T.dialogue_files(spark, str(tmp_path), str(tmp_path / "acts.json"))
    got = {r.dialogue_id: (r.fold, r.acts and [x.acts for x in r.acts]) for r in rows.collect()}
    assert counts == {"train": 2, "test": 1} and got == {"a": ("train", [["x0"], ["x1"]]), "b": ("train", None), "c": ("test", None)}


def test_artifacts(spark, tmp_path):
    import dataclasses

    from dialoom.sources import tables as T

    (tmp_path / "old-run" / "x").mkdir(parents=True)
    (tmp_path / "old-run" / "log.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 3}\n')
    assert T.artifact(spark, str(tmp_path), "run", "log.json", "old-").count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        T.artifact(spark, str(tmp_path), "run", "log.json")
    assert [r.a for r in T.json_lines(spark, str(tmp_path / "lines.json")).orderBy("a").collect()] == [1, 3]
    rows = spark.createDataFrame([("one", "r", str(tmp_path / "old-run")), ("two", "s", "nowhere")], "name string, run_id string, path string")
    assert T.all_to_folder(spark, rows, "r", str(tmp_path / "out")) == 1 and (tmp_path / "out" / "one" / "log.json").exists()

    @dataclasses.dataclass
    class Inner:
        k: int

    @dataclasses.dataclass
    class Outer:
        name: str
        inner: dict
        size: int = 3

    assert T.strict(Outer, {"name": "x", "inner": {"k": 1}}) == Outer("x", {"k": 1}, 3)
    for bad in ({"name": "x"}, {"name": "x", "inner": {}, "other": 1}):
        with pytest.raises(ValueError):
            T.strict(Outer, bad)


def test_publishing(spark, tmp_path):
    from dialoom.sources import manifest as M

    path, root, out = (str(tmp_path / x) for x in ("manifest", "logs", "out"))
    for run, n in (("r1", 2), ("r2", 3)):
        spark.createDataFrame([(f"{run}-{i}", run, i) for i in range(n)], "dialogue_id string, run_id string, turn int").write.parquet(f"{root}/{run}")
    M.add(spark, path, spark.createDataFrame([("g", "r1", 2, "d", "train"), ("g", "r2", 3, "d", "train")], M.SCHEMA))
    name, text = M.publish_group(spark, path, "g", root, out, "train", lambda f: f.withColumn("label", F.lit(1)))
    again, _ = M.publish_group(spark, path, "g", root, out, "train", lambda f: f.withColumn("label", F.lit(1)))
    got = spark.read.parquet(f"{out}/{name}")
    assert name == again and name.startswith("g_5_") and "- logs: 5" in text and got.count() == 5 and {r.split for r in got.collect()} == {"train"}
    M.add(spark, path, spark.createDataFrame([("h", "r1", 9, "d", "train")], M.SCHEMA))
    with pytest.raises(ValueError):
        M.publish_group(spark, path, "h", root, out)
    rows = spark.range(40).select("id", (F.col("id") % 10).alias("d"))
    counts = M.publish_mixture({"a": (rows, 1.0), "b": (rows, 0.5)}, "id", out, "mix", held=2, group_key="d")
    assert sum(counts.values()) == 60 and set(counts) == {"train", "validation"}


def test_replay(spark):
    from dialoom.streaming import jobs

    turns = spark.createDataFrame([("a", t, f"x{t}") for t in range(5)], "d string, t int, x string")
    seen = []
    left = jobs.resumed(turns, turns.where("t < 2"), [lambda f: seen.append(f.count()), lambda f: seen.append(sorted(r.x for r in f.collect()))], "d", "t")
    assert sorted(r.t for r in left.collect()) == [2, 3, 4] and seen == [2, ["x0", "x1"]]
    assert jobs.resumed(turns, None, [], "d", "t").count() == 5

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlake.plans.release import Policy, Release
from skeinlake.plans.scoring import ScoringRun
from skeinlake.sources import files, jsonl, tabular
from skeinlake.streaming import incremental


def test_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("a", T.StructType([T.StructField("z", T.StringType()), T.StructField("y", T.IntegerType())]))])
    df = spark.createDataFrame([(1, ("é", 2)), (2, None)], schema)
    path = str(tmp_path / "x")
    assert jsonl.write_once(df, path) and not jsonl.write_once(df, path)
    with pytest.raises(FileExistsError):
        jsonl.write_once(df.limit(1), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"a":{"y":2,"z":"é"},"b":1}', '{"b":2}']
    assert jsonl.read_jsonl(spark, path, schema).count() == 2
    jsonl.write_jsonl(df, path + "a", drop_nulls=False, ascii_only=True)
    assert sorted(r.value for r in spark.read.text(path + "a").collect()) == ['{"a":null,"b":2}', '{"a":{"y":2,"z":"\\u00e9"},"b":1}']
    (tmp_path / "empty").write_text("")
    with pytest.raises(jsonl.EmptySource):
        jsonl.read_jsonl(spark, str(tmp_path / "empty"), schema)
    (tmp_path / "bad").write_text('{"b": 1}\nnot json\n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "bad"), schema).collect()
    assert jsonl.read_jsonl_lenient(spark, str(tmp_path / "bad"), schema).where("_corrupt is not null").cache().count() == 1
    (tmp_path / "comma").write_text('{"b": 1},\n{"b": 2}\n')
    assert jsonl.read_trailing_commas(spark, str(tmp_path / "comma"), schema).agg(F.sum("b")).first()[0] == 3


def test_rooted_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"questions": [{"q": 1}, {"q": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps({"train": [{"q": 1}], "test": [{"q": 2}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"q": 1}]))
    assert jsonl.read_rooted(spark, str(tmp_path / "a.json")).count() == 2
    assert {(r.q, r.split) for r in jsonl.read_rooted(spark, str(tmp_path / "b.json")).collect()} == {(1, "train"), (2, "test")}
    assert jsonl.read_rooted(spark, str(tmp_path / "c.json")).count() == 1


def test_tables_and_xml(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿component,x,y,width,height\nleft_kneeANT,1.9,2,3,4\n".encode())
    r = tabular.region_boxes(tabular.read_csv(spark, str(tmp_path / "r.csv"))).first()
    assert (r.part, r.view, r.region, r.bbox) == ("left_knee", "ANT", "left knee", [1, 2, 4, 6])
    (tmp_path / "p.tsv").write_text("12\tQUJD\nx\tQUJD\n13\n14\t!!\n")
    assert [(p.id, p.malformed) for p in tabular.read_payloads(spark, str(tmp_path / "p.tsv")).orderBy("id").collect()] == [("12", False), ("13", True), ("14", True), ("x", True)]
    obj = lambda n, x2: f"<object><name>{n}</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>{x2}</xmax><ymax>5</ymax></bndbox></object>"
    (tmp_path / "p7.xml").write_text(f"<annotation><size><width>20</width><height>20</height></size>{obj('Abnormal', 5)}{obj('Normal', 50)}</annotation>")
    assert [(h.stem, h.label, h.in_bounds) for h in tabular.read_hotspots(spark, str(tmp_path / "p7.xml")).orderBy("pos").collect()] == [("p7", "Abnormal", True), ("p7", "Normal", False)]
    caps = spark.createDataFrame([(1, "a"), (1, "b"), (9, "c")], "text_id int, text string")
    assert {(c.text_id, c.issue) for c in tabular.caption_issues(caps, 1, 2).collect()} == {(1, "texts_differ"), (2, "missing"), (9, "out_of_range")}


def test_inventory(spark, tmp_path):
    d = tmp_path / "tree"
    (d / "s").mkdir(parents=True)
    (d / "a.txt").write_text("one")
    (d / "s" / "b.txt").write_text("two")
    inv = files.inventory(spark, str(d))
    assert {r.file for r in inv.collect()} == {"a.txt", "s/b.txt"} and files.tree_digest(inv).first().bytes == 6
    files.write_checksums(inv, str(tmp_path / "sums"))
    sums = spark.read.text(str(tmp_path / "sums"))
    assert files.check_checksums(inv, sums).count() == 0
    (d / "a.txt").write_text("1")
    (d / "c.txt").write_text("new")
    assert {(r.file, r.issue) for r in files.check_checksums(files.inventory(spark, str(d)), sums).collect()} == {("a.txt", "changed"), ("c.txt", "unlisted")}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/x.jsonl", "{}")
    assert files.zip_members(spark, str(tmp_path / "z.zip")).first().member == "in/x.jsonl"
    assert files.gray_stats([0] * 10 + [4] + [0] * 245) == (10, 0, 0) and files.average_hash([0, 9, 9, 0]) == "6"
    assert "| 1 |" in files.markdown("T", {"x": spark.range(1, 2)})


def test_release_and_scoring(spark):
    box = [10, 10, 50, 50]
    ev = [(f"p{i}", "left knee", v, f"{v}{i}.jpg", [100, 100], box, "abnormal" if i % 4 == 0 else "normal", {"known_artifact": i == 7}, "p1" if i == 2 else None) for i in range(12) for v in ("ANT", "POST")]
    evidence = spark.createDataFrame(ev, "patient_id string, region string, view string, image string, image_size array<int>, bbox array<int>, diagnosis string, flags map<string,boolean>, duplicate_of string")
    spots = spark.createDataFrame([("s1", "p0", "ANT", [12, 12, 20, 20], "Abnormal"), ("s2", "p0", "ANT", [1, 1, 20, 20], "Abnormal")], "spot_id string, patient_id string, view string, bbox array<int>, label string")
    r = Release(evidence, spots, Policy())
    assert r.rejected.count() == 2 and r.pairs().count() == 11
    split = {x.patient_id: x.split for x in r.splits.collect()}
    assert split["p1"] == split["p2"] and len(split) == 11
    assert {x.spot_id: x.assignment for x in r.metastases.collect()} == {"s1": "unique_region", "s2": "unassigned"}
    bank = spark.createDataFrame([("vqa", "Is the {region} abnormal in the {view} view?"), ("grounding", "Box the {region}.")], "task_type string, template string")
    tasks = r.tasks(bank)
    assert tasks.count() == 11 * 3 * 2
    said = F.when(F.col("task_type") == "vqa", F.to_json(F.struct("task_type", "answer_label"))).otherwise("x")
    from skeinlake.functions.grammar import json_output

    truth = json_output(F.col("task_type"), F.lit("so it is"), F.col("label"), F.col("answer_label"), F.col("targets"))
    run = ScoringRun(tasks, tasks.select("task_id", truth.alias("prediction")), replicates=20)
    m = {x.task_type: x for x in run.metrics().collect()}
    assert m["vqa"].accuracy == 1.0 and m["grounding"].strict_accuracy == 1.0 and m["grounding"].mean_iou == 1.0
    bad = ScoringRun(tasks, tasks.select("task_id", said.alias("prediction")), replicates=20)
    assert {x.task_type: x.valid_rate for x in bad.metrics().collect()} == {"vqa": 0.0, "grounding": 0.0}
    p = {x.task_type: x for x in run.against(bad, "iou_at_50").collect()}
    assert p["grounding"].mean_difference == 1.0 and p["grounding"].p_holm <= 0.2
    with pytest.raises(ValueError):
        Policy(cuts=(("train", 0.9), ("val", 0.8)))


def test_stream_state_last_wins_and_resume(spark, tmp_path):
    src, schema = tmp_path / "in", "k string, seq bigint, v string"
    src.mkdir()
    state = incremental.StateTable(spark, str(tmp_path / "state"), "k", ["seq"], "f1")
    for n, data in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 3, "new"), ("c", 1, "z")], [("a", 2, "late"), (None, 9, "no key")])):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = state.follow(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "ck"))
        q.awaitTermination()
        assert n < 3
    assert {(r.k, r.v) for r in state.read().collect()} == {("a", "new"), ("b", "y"), ("c", "z")}
    state.merge(spark.createDataFrame([("a", 3, "new")], schema), 3)  # a replayed batch
    with pytest.raises(incremental.FingerprintMismatch):
        incremental.StateTable(spark, str(tmp_path / "state"), "k", ["seq"], "f2")
    work = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "o int, k string")
    assert incremental.resume_prefix(work, work.where("o < 2"), "k", "o").count() == 3
    with pytest.raises(ValueError):
        incremental.resume_prefix(work, work.where("o = 3"), "k", "o")


def test_stream_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").parquet(str(tmp_path / "ev"))
    q = incremental.windowed_counts(stream, "ts", ["event_type"], "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == spark.read.parquet(str(tmp_path / "ev")).count()

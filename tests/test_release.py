"""Review, manifests, exports, adapters and runs on small hand-made rows: nulls, empty tables, repeats, ties."""

import pytest
from pyspark.sql import functions as F

from skeinlake.operators import adapters as A
from skeinlake.operators import export as E
from skeinlake.operators import manifest as M
from skeinlake.operators import profile as P
from skeinlake.operators import relational as R
from skeinlake.operators import review as V
from skeinlake.operators import runs as N
from skeinlake.operators import standard as S
from skeinlake.session import Workspace, scratch

EVIDENCE = "evidence_id string, region string, view string, image string, bbox array<double>, diagnosis string"
RESPONSE = "review_id string, view string, reviewer_id string, diagnosis string, bbox_status string, corrected_bbox array<double>, overall_decision string"


def test_review_to_gold(spark):
    ev = spark.createDataFrame([(e, "knee", v, f"{e}{v}", [0.0, 0.0, 10.0, 10.0], "normal") for e in "xyz" for v in ("ANT", "POST")], EVIDENCE)
    queue, labels = V.blind(ev)
    assert not {"diagnosis", "evidence_id"} & set(queue.columns)
    ids = {r.evidence_id: r.review_id for r in labels.collect()}
    said = lambda who, change: spark.createDataFrame([(ids[e], v, who, *change.get((e, v), ("normal", "accept", None, "include"))) for e in "xyz" for v in ("ANT", "POST")], RESPONSE)
    a, b = said("a", {}), said("b", {("x", "ANT"): ("abnormal", "correct", [5.0, 5.0, 15.0, 15.0], "include"), ("y", "POST"): ("normal", "not_assessable", None, "exclude")})
    rows = {(r.review_id, r.view): r for r in V.compare_readers(queue, a, b).collect()}
    assert rows[ids["x"], "ANT"].differences == ["diagnosis:ANT", "bbox:ANT"] and abs(rows[ids["x"], "ANT"].iou - 25 / 175) < 1e-12
    assert rows[ids["y"], "POST"].differences == ["bbox_status:POST", "overall_decision"] and rows[ids["y"], "POST"].iou is None
    m = {r.measure: r for r in V.agreement(V.compare_readers(queue, a, b)).collect()}
    assert (m["fully_agreed"].n, m["fully_agreed"].agreed, m["bbox"].n, m["bbox"].agreed) == (3, 1, 5, 4)
    assert V.response_issues(queue, a).count() == 0
    odd = a.where(F.col("review_id") != ids["x"]).union(a.where(F.col("review_id") == ids["y"])).union(spark.createDataFrame([("ghost", "ANT", "c", None, None, None, None)], RESPONSE))
    assert {(r.review_id, r.issue) for r in V.response_issues(queue, odd).collect()} == {(ids["x"], "missing"), (ids["y"], "repeated"), ("ghost", "unexpected"), ("ghost", "other_reviewer")}
    final = spark.createDataFrame([(ids[e], v, d, [1.0, 1.0, 2.0, 2.0], dx) for e, d, dx in (("x", "include", "abnormal"), ("y", "exclude", "normal"), ("z", None, "normal")) for v in ("ANT", "POST")], "review_id string, view string, final_decision string, final_bbox array<double>, final_diagnosis string")
    kept, out = V.gold(ev, labels, final)
    assert {(r.source_evidence_id, r.pair_diagnosis) for r in kept.collect()} == {("x", "abnormal")} and {r.evidence_id for r in out.collect()} == {"y", "z"}
    assert V.compare_readers(queue.where("false"), a, b).count() == 0


def test_manifest_rules_and_gate(spark):
    df = spark.createDataFrame([(None, "p", "train", 1, 1), ("p1", None, None, None, 1), ("p2", None, "val", 2, 2)], "patient_id string, x string, split string, canonical_records long, paired_evidence_records long")
    assert {(r.rule, r.n) for r in M.violations(df, "patient_splits").collect()} == {("no_patient", 1), ("no_split", 1), ("no_counts", 1)}
    assert M.violations(df.where("false"), "patient_splits").count() == 0 and [r.rules for r in M.violating_rows(df, "patient_splits", "patient_id").where("key = 'p1'").collect()] == [["no_split", "no_counts"]]
    names, none = spark.createDataFrame([("a",)], "name string"), df.where("false")
    got = {r.check: (r.n, r.passed) for r in M.gate(names, ["a", "b"], M.violations(df, "patient_splits"), none).collect()}
    assert got == {"required_names": (1, False), "manifests_valid": (3, False), "no_leakage": (0, True)}


def test_location_tokens_and_rejects(spark):
    img = [("ANT", [100, 200]), ("POST", [100, 200])]
    rows = [("ok", "knee", img, [("ANT", [0, 0, 100, 200]), ("POST", [0, 0, 100, 200])]), ("order", None, img, [("POST", [0, 0, 1, 1]), ("ANT", [0, 0, 1, 1])]), ("none", "k", img, None), ("bad", "k", [("ANT", None)], [("ANT", [5, 5, 1, 1]), ("ANT", [0, 0, 500, 1]), (None, None)]), ("out", "k", img, [("ANT", [0, 0, 500, 1])])]
    df = spark.createDataFrame(rows, "task_id string, label string, images array<struct<view:string,image_size:array<int>>>, targets array<struct<view:string,bbox:array<int>>>")
    got = {r.task_id: r for r in E.token_rows(df).collect()}
    assert got["ok"].target == "<loc0000><loc0000><loc1023><loc0512> knee ; <loc0000><loc0512><loc1023><loc1023> knee" and got["ok"].reasons == []
    assert got["order"].reasons == ["view_order", "no_label"] and got["none"].reasons == ["no_targets"] and got["out"].reasons == ["out_of_image"]
    assert set(got["bad"].reasons) >= {"bad_box", "no_size", "unknown_view", "repeated_view"} and got["bad"].target is None


def test_names_and_parity(spark):
    paths = [("a/train-00000-of-00002.parquet",), ("a/train-00001-of-00002.parquet",), ("validation-00000-of-00002.parquet",), ("x/contest.json",), (None,)]
    df = spark.createDataFrame(paths, "path string")
    assert [r[0] for r in df.select(E.split_of_name(F.col("path"))).collect()] == ["train", "train", "val", None, None]
    assert {(r.split, r.stated, r.found) for r in E.shard_issues(df).collect()} == {("val", 2, 1)}
    t = spark.createDataFrame([("1", "p", "train", [("C:\\x\\a.png",)]), ("2", "p", "val", None)], "task_id string, prompt string, split string, images array<struct<image:string>>")
    e = spark.createDataFrame([("1", "p", "train", [("out/a.png",)]), ("2", None, "val", None), ("3", "q", None, [])], t.schema)
    assert {r.field: r.n_different for r in E.export_parity(t, e).collect()} == {"prompt": 1, "split": 0, "images": 0, "only_first": 0, "only_second": 1}
    assert {r.task_id for r in E.missing_images(e, df).collect()} == {"1"}


def test_adapters(spark):
    df = spark.createDataFrame([(1, "a.jpg", "Is it?", "Yes", "en"), (2, "b.jpg", "Was?", "Ja", "de"), (3, "c.jpg", "What?", None, "EN")], "qid int, img_name string, question string, answer string, q_lang string")
    good, lost = A.slake(df, spark.createDataFrame([("a.jpg",)], "path string"))
    g = good.first()
    assert (good.count(), g.record_id, g.task, g.answer, g.answer_type) == (1, "1", "vqa", "Yes", "yes_no") and [(r.qid, r.reason) for r in lost.collect()] == [(3, "no_image")]
    p = A.pathvqa(spark.createDataFrame([("x/test-00000-of-00001.parquet", ("i", "im.png"), "Where?", "here")], "path string, image struct<bytes:string,path:string>, question string, answer string")).first()
    assert (p.split, p.image_id, p.record_id) == ("test", "im.png", None)
    h = spark.createDataFrame([("1", "i", "Where is it?", ["left", " "], [3, 2, 3, 2, 6], 4), ("2", "i", "q", [], None, 4), ("3", "i", "q", None, [16], 4)], "id string, image string, question_text string, gt array<string>, mask_counts array<int>, mask_height int")
    got = {r.record_id: r for r in A.heal(h).collect()}
    assert [list(b.bbox) for b in got["1"].target_boxes] == [[0.0, 0.0, 3.0, 4.0]] and got["1"].answers == ["left"] and got["2"].target_boxes == [] and got["3"].target_boxes == []
    conv = spark.createDataFrame([(1, 0, "user", "In the second image, where?"), (1, 1, "assistant", "<BBX>1,2,3,4</BBX>"), (1, 2, "user", "and?"), (2, 0, "assistant", "hello")], "conv_id int, turn int, role string, text string")
    c = A.conversations(conv).collect()
    assert len(c) == 1 and c[0].place == 1 and list(c[0].boxes[0].bbox) == [1.0, 2.0, 3.0, 4.0]


def test_standard_form(spark):
    df = spark.createDataFrame([("q1", [(1.0, 2.0, 3.0, 4.0, "left_lesion", None)], {"w": 0}, ("10", "20"), " ", ["a ", "", "b"])], "qid string, boxes array<struct<x:double,y:double,width:double,height:double,category:string,image:string>>, extra map<string,int>, size struct<w:string,h:string>, split string, answers array<string>")
    r = S.standardise(df, "d", style="xywh").first()
    assert (r.record_id, r.image_size, r.split, r.answer, r.answers, r.task, r.target_granularity) == ("q1", [10.0, 20.0], None, "a", ["a", "b"], "grounding", "lesion_or_metastasis")
    assert list(r.target_boxes[0].bbox) == [1.0, 2.0, 4.0, 6.0] and r.target_boxes[0].label == "left_lesion"
    bare = spark.createDataFrame([(2, "Is it?"), (1, None)], "n int, query string")
    assert [(x.record_id, x.task, x.answer_type) for x in S.standardise(bare, "d", order=["n"]).orderBy("record_id").collect()] == [("d:0", "other", "missing"), ("d:1", "vqa", "yes_no")]
    assert S.standardise(bare.where("false"), "d").count() == 0
    lab = spark.createDataFrame([(" ", None, "Yes, it is!"), ("abnormal", "x", None), (None, None, None)], "answer_label string, lesion_class string, answer string")
    assert [r[0] for r in lab.select(S.answer_label(lab)).collect()] == ["yes it is", "abnormal", "missing"]


def test_runs(spark):
    log = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("a", 4, float("nan")), ("b", 1, None)], "run string, epoch int, score double")
    got = {r.run: r for r in N.best_epoch(log, "run", "epoch", "score").collect()}
    assert (got["a"].best_epoch, got["a"].best_score, got["a"].last_epoch, got["a"].undefined) == (2, 0.7, 4, 1) and got["b"].best_epoch is None
    assert {r.run for r in N.abandoned(log, "run", "epoch", 4).collect()} == {"b"}
    exp = spark.createDataFrame([("1",), ("2",), ("2",)], "task_id string")
    sc = spark.createDataFrame([("1", "x", 1.0), ("2", "x", 2.0), ("2", "x", 3.0), ("9", "x", 1.0), ("1", "y", 1.0), ("2", "y", None)], "task_id string, system string, score double")
    assert {tuple(r) for r in N.complete_systems(exp, sc).select("system", "task_id", "score").collect()} == {("x", "1", 1.0), ("x", "2", 3.0)}
    a = spark.createDataFrame([(1, ("u", (1, [1, 2])), None)], "k int, s struct<p:string,q:struct<r:int,t:array<int>>>, m string")
    b = spark.createDataFrame([(1, ("u", (2, [1])), None)], a.schema)
    assert {(r.path, r.first, r.second) for r in N.nested_diff(a, b, "k").collect()} == {("s.q.r", "1", "2"), ("s.q.t", "[1,2]", "[1]")}
    f = spark.createDataFrame([({"a": True, "b": True}, {"b": False}), (None, {"c": True}), (None, None)], "x map<string,boolean>, y map<string,boolean>")
    assert [r[0] for r in f.select(N.merge_flags(F.col("x"), F.col("y"))).collect()] == [{"a": True, "b": False}, {"c": True}, {}]


def test_containers_median_fingerprint_scratch(spark):
    import random

    rng = random.Random(2)
    box = lambda n: [float(x := rng.randrange(500)), float(y := rng.randrange(500)), float(x + rng.randrange(1, n)), float(y + rng.randrange(1, n))]
    reg = [(rng.choice("ab"), f"r{i}", box(400)) for i in range(200)] + [("a", "none", None), (None, "x", [0.0, 0.0, 9e9, 9e9])]
    spot = [(rng.choice("ab"), f"s{i}", box(40)) for i in range(200)] + [("a", "nobox", None), (None, "nokey", [1.0, 1.0, 2.0, 2.0])]
    got = {r.s: r.candidates for r in R.assign_containers(spark.createDataFrame(spot, "k string, s string, bbox array<double>"), spark.createDataFrame(reg, "k string, r string, region_box array<double>"), ["k"], "s", "r").collect()}
    inside = lambda o, i: o and i and o[0] <= i[0] and o[1] <= i[1] and o[2] >= i[2] and o[3] >= i[3]
    assert got == {s: sorted(r for q, r, o in reg if q == k and k and inside(o, i)) for k, s, i in spot} and sum(map(len, got.values())) > 100
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 4.0), ("a", None), (None, 2.0), (None, 3.0)], "k string, v double")
    assert {r.k: r.median for r in P.medians(df, ["k"], "v").collect()} == {"a": 4.0, None: 2.5}
    with scratch():
        work = Workspace(spark, "gone")
        assert work.save(df, "t").count() == 6
    with pytest.raises(Exception):
        spark.read.parquet(work.path("t")).count()

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import geometry as G
from skeinlake.functions import text as X
from skeinlake.functions.keys import clean_category, clean_digest, clean_key, clean_split
from skeinlake.operators import skew
from skeinlake.operators.components import connected_components
from skeinlake.operators.profile import fingerprint
from skeinlake.operators.relational import CoverageError, join_covered
from skeinlake.operators.sampling import class_balanced_epoch, interleave


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col).first()[0] if values else spark.range(1).select(col).first()[0]


def test_keys(spark):
    df = spark.createDataFrame([(" Bone-Region. ",), ("bone  region",), ("VALID",), ("",), (None,), ("\tP01 ",)], "c string")
    assert [r[0] for r in df.select(clean_category("c")).collect()] == ["bone_region", "bone_region", "valid", None, None, "p01"]
    assert [r[0] for r in df.select(clean_split("c")).collect()][2] == "val"
    assert [r[0] for r in df.select(clean_key("c")).collect()][3:] == ["", None, "p01"]
    h = "ab" * 32
    d = spark.createDataFrame([(h,), ("0x" + h.upper(),), (" sha256:" + h,), (h[:-1],), ("zz" * 32,), (None,)], "c string")
    assert [r[0] for r in d.select(clean_digest("c")).collect()] == [h, h, h, None, None, None]


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, G.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert one(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, G.iou(F.lit(None).cast("array<double>"), box(0, 0, 1, 1))) == 0
    assert one(spark, G.contains(box(0, 0, 9, 9), box(1, 1, 9, 9))) is True
    assert one(spark, G.coerce_box({"left": F.lit(1), "top": F.lit(2), "right": F.lit(3), "bottom": F.lit(4)})) == [1, 2, 3, 4]
    assert one(spark, G.coerce_box({"x": F.lit(1), "y": F.lit(2), "width": F.lit(3), "height": F.lit(4)}, "coco")) == [1, 2, 4, 6]
    assert one(spark, G.control_box(box(0, 0, 10, 10), F.array(F.lit(30), F.lit(30)))) == [20, 0, 30, 10]
    assert one(spark, G.is_box(F.lit(None).cast("array<double>"))) is None
    # 4 rows high, column-major: pixels 5..6 (column 1, rows 1-2) and 8..11 (all of column 2)
    assert one(spark, G.rle_box(F.array(*map(F.lit, (5, 2, 1, 4))), F.lit(4))) == [1, 0, 3, 4]


def test_text(spark):
    assert one(spark, X.skeleton(F.lit("Is the Left knee abnormal, left knee?"), ["left knee", "knee"])) == "is the <REGION> <CLASS> <REGION>"
    assert one(spark, X.question_type(F.lit("How many boxes?"), F.lit(False))) == "counting"
    assert one(spark, X.question_type(F.lit("Where is it"), F.lit(False))) == "localization"
    assert one(spark, X.question_type(F.lit(None).cast("string"), F.lit(False))) == "missing"
    assert one(spark, X.ngrams(F.array(*map(F.lit, "abcd")), 3)) == ["a b c", "b c d"]
    assert one(spark, X.ngrams(F.array(F.lit("a")), 3)) == []
    assert one(spark, X.last_ordinal(F.lit("the first or the Third one"))) == 2
    assert one(spark, X.find_region(F.lit("show the left knee now"), ["knee", "left knee"])) == "left knee"


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(None, "n01"), ("n01", None)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_running_sums_and_take_lowest(spark):
    rng = random.Random(1)
    data = [("a" if rng.random() < 0.7 else "b", i, rng.randrange(2**60), rng.randrange(1, 9)) for i in range(800)] + [(None, 900, 5, 1)]
    df = spark.createDataFrame(data, "g string, id bigint, h bigint, w bigint").repartition(5)
    run = {(r.g, r.id): r.s for r in skew.running_sums(df, ["g"], ["id"], {"s": "w"}).collect()}
    sums = {}
    for g, i, _, w in sorted(data, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + w
        assert run[(g, i)] == sums[g]
    quotas = spark.createDataFrame([("a", 100), ("b", 10**6)], "g string, quota bigint")
    got = skew.take_lowest(df, ["g"], "h", "id", quotas).collect()
    assert {r.id for r in got if r.g == "a"} == {i for _, i, _, _ in sorted((r for r in data if r[0] == "a"), key=lambda r: r[2])[:100]}
    assert sum(r.g == "b" for r in got) == sum(r[0] == "b" for r in data)
    sized = skew.take_lowest(df, ["g"], "h", "id", quotas, size="w").where("g = 'a'").agg(F.sum("w")).first()[0]
    assert 92 <= sized <= 100


def test_hot_join_equals_plain_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("zz", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = skew.hot_split_join(left, right, "k", how, hot=["hot"])
        b = left.join(right, "k", how)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_coverage_and_schedules(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    with pytest.raises(CoverageError):
        join_covered(a, spark.createDataFrame([("x",)], "k string"), "k").count()
    rows = spark.createDataFrame([(f"{b}{i}", b) for b, n in (("a", 3), ("b", 1), ("c", 2)) for i in range(n)], "id string, b string")
    order = [r.id for r in interleave(rows, "b", ["id"]).orderBy("position").collect()]
    assert order == ["a0", "b0", "c0", "a1", "c1", "a2"]
    t = spark.createDataFrame([(str(i), "vqa", i < 2) for i in range(11)], "id string, task string, p boolean")
    e = class_balanced_epoch(t, "task", "id", F.col("p"), "s")
    assert e.count() == 11 and e.where("p").count() == 5 and e.where("not p").distinct().count() == 6


def test_fingerprint_ignores_order(spark):
    df = spark.range(500).withColumn("k", F.col("id").cast("string"))
    a, b = fingerprint(df.repartition(3), "k").first(), fingerprint(df.orderBy(F.desc("id")), "k").first()
    assert a == b and a.n == 500
    assert fingerprint(df.where("id > 0"), "k").first().digest != a.digest


def test_shared_dir_is_read_from_the_session(spark):
    from skeinlake.session import Workspace, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    w = Workspace(spark, "x")
    assert w.save(spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp"), "t").count() == 1
    w.close()

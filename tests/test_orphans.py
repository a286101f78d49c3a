from datetime import datetime as D

from pyspark.sql import functions as F

from skeinlake.operators.orphans import Entity, Reference, ReferenceGraph


def graph(spark, parents, mid, leaves):
    p = spark.createDataFrame(parents, "id bigint, k string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, ref_key string")
    m = spark.createDataFrame(mid, "id bigint, k string, refs array<string>, ingested_at timestamp_ntz, tbl string")
    leaf = spark.createDataFrame(leaves, "id bigint, k string, up string, ingested_at timestamp_ntz")
    return ReferenceGraph([Entity("p", p, "id", "k", deleted="deleted_at"), Entity("m", m, "id", "k"), Entity("l", leaf, "id", "k")], [Reference("m", F.col("refs"), "p", many=True), Reference("l", F.col("up"), "m")])


def test_missing_late_deleted_and_inherited(spark, rows):
    t = lambda n: D(2024, 1, n)
    g = graph(
        spark,
        [(1, "A", t(2), None, "clash"), (2, " a\t", t(5), None, ""), (3, "b", t(1), t(4), ""), (4, None, t(1), None, ""), (5, "c", t(9), None, "")],
        [(1, "M1", ["a ", "A", None], t(3), ""), (2, "m2", ["b"], t(4), ""), (3, "m3", ["c", "zz"], t(5), ""), (4, "m4", None, t(5), ""), (5, "m5", ["a"], t(1), ""), (6, None, ["nope"], t(1), "")],
        [(1, "x", "m1", t(9)), (2, "y", "M2 ", t(9)), (3, "z", "gone", t(9)), (4, None, None, t(9))],
    )
    out = g.cascade()
    assert rows(out.select("tbl", "row_id", "ref_key", "cause", "depth")) == sorted([
        ("m", 2, "b", "deleted", 0), ("m", 3, "c", "late", 0), ("m", 3, "zz", "missing", 0), ("m", 5, "a", "late", 0), ("m", 6, "nope", "missing", 0), ("l", 3, "gone", "missing", 0), ("l", 2, "m2", "inherited", 1),
    ], key=lambda t: tuple((v is None, str(v)) for v in t))
    assert {(r.tbl, r.kind): r.n_refs for r in g.report(out).groupBy("tbl", "kind").agg(F.sum("n_refs").alias("n_refs")).collect()} == {("m", "direct"): 5, ("l", "direct"): 1, ("l", "inherited"): 1}


def test_empty_tables(spark):
    assert graph(spark, [], [], []).cascade().count() == 0
    assert graph(spark, [], [(1, "m", ["a"], None, "")], []).cascade().count() == 1


def test_cycle_ends(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "c", "x"), (4, "d", "c"), (5, "e", "d")], "id bigint, k string, up string").withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    out = ReferenceGraph([Entity("t", df, "id", "k")], [Reference("t", F.col("up"), "t")]).cascade()
    assert {(r.row_id, r.depth) for r in out.collect()} == {(3, 0), (4, 1), (5, 2)}

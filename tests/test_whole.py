"""The whole job: every value, row and replicate takes part. SQL here counts what the registered SQL leaves out."""

import hashlib
from collections import Counter

import duckdb

from skeinlake.operators.features import average_hash, term_counts
from skeinlake.operators.profile import duplicate_groups
from skeinlake.operators.stats import bootstrap_weights, intervals
from skeinlake.queries import audit, build, scoring
from skeinlake.queries.sqlkit import over
from tools_compare import TABLES, canon

from .oracle import SF


def same(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = query(spark, SF).toPandas(), con.execute(sql).df()
    assert len(want) and canon(got) == canon(want[list(got.columns)])


def test_images_of_every_place_leak(spark):
    from skeinlake.operators.profile import crossing

    df = spark.createDataFrame([("train", ["a", "b", "b"]), ("val", ["c", "b"]), ("test", ["a", None]), ("val", None), (None, ["c"])], "split string, i array<string>")
    assert sorted(map(tuple, crossing(df, {"image": df["i"]}).collect())) == [("image", "a", "test+train", 2), ("image", "b", "train+val", 2)]
    kinds = (("patient", "patient_id", "t"), ("evidence", "evidence_id", "t"), ("image", "image", "(SELECT DISTINCT task_id, split, unnest(images).image AS image FROM t)"))
    one = "SELECT '{0}' AS kind, {1} AS value, array_to_string(list_sort(list_distinct(list(split))), '+') AS splits, count(*) AS n FROM {2} WHERE split IS NOT NULL AND {1} IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1"
    same(spark, audit.split_leakage, over("tasks") + " UNION ALL ".join(one.format(*k) for k in kinds))


def test_sample_shows_images_of_every_place(spark):
    from skeinlake.operators.sampling import stratified_with_coverage, target_of

    df = spark.createDataFrame([(f"t{i}", "s", [f"a{i % 3}", f"b{i % 4}", None]) for i in range(40)] + [("u", "s", None)], "id string, s string, c array<string>")
    out = stratified_with_coverage(df, "id", "s", "c", 12, "r")
    shown = out.where("stage = 'forced'").join(df, "id").selectExpr("explode(c) v").where("v is not null").distinct().count()
    assert out.count() == out.select("id").distinct().count() == 12 and shown == 7
    rows = build.tasks(spark, SF).select("task_id", "images.image").toPandas()
    got = build.stratified_sample_with_coverage(spark, SF).toPandas()
    images = lambda ids: {i for t, a in zip(rows.task_id, rows.image) if t in ids for i in (a if a is not None else ()) if i}
    assert len(got) == len(set(got.task_id)) == target_of(len(rows), 0.3)
    best = {}
    for t, a in zip(rows.task_id, rows.image):
        h = int(hashlib.sha256(f"r3:{t}".encode()).hexdigest()[:15], 16)
        for i in a if a is not None else ():
            if i and (h, t) < best.get(i, (h + 1, t)):
                best[i] = (h, t)
    forced = set(got.task_id[got.stage == "forced"])
    assert forced == {t for _, t in best.values()} and images(forced) == images(set(rows.task_id))


def test_average_hash_takes_all_values(spark):
    rows = [(1, [1.0] * 16 + [0.0] * 47 + [9.0]), (2, [1.0] * 16 + [0.0] * 46 + [9.0, 0.0]), (3, [2.0] * 16 + [0.0] * 47 + [9.5]), (4, [0.0] * 99 + [1.0]), (5, [0.0] * 98 + [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert sorted(map(tuple, duplicate_groups(df, "id", average_hash(df["v"])).collect())) == [(1, 1, 2), (3, 1, 2)]
    assert audit.ahash_duplicate_groups(spark, SF).count() == 0


def test_bootstrap_has_2000_replicates(spark):
    df = spark.createDataFrame([(c,) for c in "edcba"], "c string")
    want = Counter((r, "abcde"[int(hashlib.sha256(f"boot:{r}:{k}".encode()).hexdigest()[:15], 16) % 5]) for r in range(scoring.R) for k in range(5))
    assert scoring.R == 2000 and {(x.replicate, x.c): x.weight for x in bootstrap_weights(df, "c", scoring.R).collect()} == want
    made = spark.createDataFrame([("k", r, r / 100) for r in range(2000)], "k string, replicate int, m double")
    i = intervals(made, ["k"], ["m"]).first()
    assert (i.low, i.high, i.used) == (0.5, 19.49, 2000)
    p = scoring.paired_bootstrap(spark, SF).first()
    assert p.n == 2000
    assert {x[0] for x in scoring.poisson_bootstrap(spark, SF).select("replicate").distinct().collect()} == set(range(2000))


def test_epoch_order_has_every_task(spark):
    same(spark, build.epoch_shuffle, over("tasks") + "SELECT task_id, row_number() OVER (ORDER BY sha256('8:' || task_id), task_id) AS position FROM t")


def test_every_term_is_counted(spark):
    from skeinlake.operators.features import text_clusters

    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(d, 9000, 2)),) for d in (0, 1)] + [("a b",)], "text string")
    for s in term_counts("text"):
        df = s.transform(df)
    assert [float(r["_c"].values.sum()) for r in df.collect()] == [8999.0, 8999.0, 3.0]
    docs = spark.createDataFrame([("knee left warm",), ("knee left hot",), ("rib pain",), ("rib pain now",), (None,), (" ",)], "text string")
    out = text_clusters(docs, "text", k=2, width=64).collect()
    assert len(out) == 4 and all(len(r.sv) == 2 and any(r.sv) for r in out)

import random

from pyspark.sql import functions as F

from skeinlake.llm import overlap
from skeinlake.llm.block_sample import Registry, block_sample, first_deliveries, number_units
from skeinlake.llm.group_split import assign_splits, entity_groups, split_conflicts, split_shares
from skeinlake.llm.proportional import ProportionalSample, _Search, Target


def task_rows(spark, n=2000, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"T{i % n}" if i % 50 else None, rng.choice(["a"] * 7 + ["B ", "b.", None, "c"]), rng.choice(["x"] * 5 + ["y"]), i, "clash") for i in range(n + 100)]
    return spark.createDataFrame(rows, "row_id bigint, task_id string, kind string, level string, ingested_at bigint, unit string")


def targets(spark, data):
    return spark.createDataFrame(data, "field_name string, category string, target_permille int, min_rows int")


def test_sample_meets_targets_and_floors(spark):
    t = targets(spark, [("kind", "a", 300, 1), ("kind", "B", 400, 10), ("kind", "missing", 200, 5), ("kind", "c", 100, 15), ("level", "x", 500, 1), ("level", "y", 500, 5)])
    s = ProportionalSample(task_rows(spark), t, "task_id", ["ingested_at", "row_id"], 0.1)
    got = s.sample().toPandas()
    assert len(got) == s.n_sample and got.unit.is_unique
    rep = {(r.field_name, r.category): r for r in s.report().collect()}
    assert s.cannot_be_met().count() == 0 and all(r.met and r.reason is None for r in rep.values())
    for (f, c), r in rep.items():
        assert abs(r.sample_rows - s.n_sample * r.target_permille / 1000) <= 1.01 and r.sample_rows >= r.min_rows, (f, c)
        assert r.sample_rows == (got[f] == c.lower()).sum()
    again = ProportionalSample(task_rows(spark).repartition(5), t, "task_id", ["ingested_at", "row_id"], 0.1).sample()
    assert {r.unit for r in again.collect()} == set(got.unit)


def test_targets_that_cannot_be_met(spark):
    t = targets(spark, [("kind", "a", 500, 1), ("kind", "none such", 500, 3), ("level", "y", 1000, 10**6), ("odd", "z", 10, 1)])
    s = ProportionalSample(task_rows(spark), t, "task_id", ["ingested_at", "row_id"], 0.5)
    assert {(r.field_name, r.category) for r in s.cannot_be_met().collect()} == {("kind", "none such"), ("level", "y"), ("odd", "z")}
    rep = {r.category: r for r in s.report().collect()}
    assert rep["none such"].reason == "too_few" and rep["none such"].short_by == rep["none such"].goal_rows and rep["y"].short_by == 10**6 - rep["y"].sample_rows
    assert s.sample().count() == s.n_sample
    empty = ProportionalSample(task_rows(spark).where("false"), t, "task_id", ["ingested_at", "row_id"])
    assert empty.sample().count() == 0 and empty.report().count() == 4
    none = ProportionalSample(task_rows(spark), t.where("false"), "task_id", ["ingested_at", "row_id"])
    assert none.report().count() == 0 and none.sample().count() == 0


def test_joint_limits_are_reported(spark):
    """Enough tasks have each category, but no sample can have both: all of b are y."""
    rows = [(i, f"t{i}", "a" if i < 50 else "b", "x" if i < 50 else "y", i) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id bigint, task_id string, kind string, level string, ingested_at bigint")
    t = targets(spark, [("kind", "b", 900, 1), ("level", "x", 900, 1), ("kind", "a", 100, 1)])
    rep = {r.category: r for r in ProportionalSample(df, t, "task_id", ["ingested_at"], 0.4).report().collect()}
    assert all(r.available >= r.goal_rows for r in rep.values()) and not (rep["b"].met and rep["x"].met)
    assert {r.reason for r in rep.values() if not r.met} == {"joint"} and any(r.short_by or r.over_by for r in rep.values())


def test_start_holds_floors():
    sigs = [(a, b) for a in "pqr" for b in "uvw"]
    ts = [Target("f", "p", 10, 7, "p"), Target("g", "w", 10, 9, "w"), Target("f", "q", 900, 1, "q")]
    for seed in range(5):
        s = _Search(sigs, [4] * 9, ["f", "g"], ts, 20, seed)
        assert s.x.sum() == 20 and (s.counts() >= s.floor).all() and (s.x <= s.n).all()


def test_no_single_exchange_would_help():
    rng = random.Random(8)
    sigs = [(a, b) for a in "pqr" for b in "uvw"]
    ts = [Target("f", a, rng.randrange(400), 3, a) for a in "pqr"] + [Target("g", b, rng.randrange(400), 3, b) for b in "uvw"]
    s = _Search(sigs, [rng.randrange(5, 80) for _ in sigs], ["f", "g"], ts, 120, 1)
    s.run()
    cost = lambda: s._cost(s.counts(), 1).sum()
    best = cost()
    assert s.x.sum() == 120 and (s.counts() >= s.floor).all()
    for i in range(9):
        for j in range(9):
            if i != j and s.x[i] > 0 and s.x[j] < s.n[j]:
                s.x[i] -= 1
                s.x[j] += 1
                assert cost() >= best - 1e-9
                s.x[i] += 1
                s.x[j] -= 1


def hashes(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(256) for _ in range(40)] + [0, (1 << 256) - 1]
    recs, shown = [], []
    for i in range(220):
        h = rng.choice(base)
        for b in rng.sample(range(256), rng.choice([0, 1, 5, 11, 12, 13, 14, 20])):
            h ^= 1 << b
        spelled = rng.choice([f"{h:064x}", f"0x{h:064X}", f" {h:064x}", None if i % 20 == 0 else f"{h:064x}", "bad" if i % 31 == 0 else f"{h:064x}"])
        sha = rng.choice([f"{rng.getrandbits(256):064x}", f"sha256:{i % 7:064x}", None])
        recs.append((i, f"p{i}", rng.choice(["s1", "s2", None]), sha, spelled, 0 if i % 37 == 0 else None if i % 41 == 0 else 9, "clash"))
        shown.append(([f"p{i}", None], rng.choice(["train", "Train ", "val", "valid", "TEST.", None])))
        if i % 10 == 0:
            shown.append(([f"p{i}"], "train"))
    rec = spark.createDataFrame(recs, "rec_id bigint, source_path string, source string, sha256 string, a_hash string, file_bytes bigint, hash string")
    task = spark.createDataFrame([(im, s) for im, s in shown] + [(None, "train"), ([], "val")], "p array<string>, split string").select(F.transform("p", lambda x: F.struct(x.alias("image"))).alias("images"), "split")
    return recs, shown, rec, task


def test_overlap_equals_brute_force(spark):
    recs, shown, rec, task = hashes(spark)
    name = lambda s: {"valid": "val"}.get((c := s.strip().rstrip(".").lower()), c) if s else None
    side = {}
    for im, s in shown:
        for p in im:
            if p and name(s):
                side.setdefault(p, set()).add("t" if name(s) == "train" else "e")

    def hexed(v):
        v = (v or "").strip().lower().removeprefix("0x").removeprefix("sha256:")
        return int(v, 16) if len(v) == 64 else None

    want = set()
    for a in recs:
        for b in recs:
            if a[0] != b[0] and a[5] != 0 and b[5] != 0 and "t" in side.get(a[1], ()) and "e" in side.get(b[1], ()):
                ha, hb = hexed(a[4]), hexed(b[4])
                same = hexed(a[3]) is not None and hexed(a[3]) == hexed(b[3])
                if same or (ha is not None and hb is not None and (ha ^ hb).bit_count() <= 12):
                    want.add((a[0], b[0]))
    got = {(r.rec_t, r.rec_e) for r in overlap.cross_split_pairs(rec, task).collect()}
    assert got == want and len(want) > 50
    near = {}
    for t, e in want:
        near.setdefault(e, set()).add(t)
    classes = {r.rec_id: r for r in overlap.overlap_classes(rec.union(rec), task).collect()}
    assert set(classes) == set(near) and all(r.class_id and r.train_rec in near[i] for i, r in classes.items())
    for shape in (overlap.Shingles(12, 16, 3), overlap.Shingles(12, 20, 6), overlap.Shingles(5, 10, 2)):
        d = 5 if len(shape.pieces) == 10 else 12
        found = {(r.hash_t, r.hash_e) for r in overlap.near_hashes(*2 * [rec.select(overlap.clean_digest("a_hash").alias("hash"))], d, shape).collect()}
        ints = {f"{h:064x}": h for h in (hexed(r[4]) for r in recs) if h is not None}
        assert found == {(x, y) for x, a in ints.items() for y, b in ints.items() if (a ^ b).bit_count() <= d}
    assert overlap.cross_split_pairs(rec.where("false"), task).count() == 0 and overlap.cross_split_pairs(rec, task.where("false")).count() == 0


def test_groups_and_splits(spark):
    links = spark.createDataFrame([("A ", "b", None), ("b", None, "G1"), ("c", None, "g1 "), ("d", "ghost", None), ("e", "ghost", None), (None, "a", "g1"), ("f", "f", None), ("g", None, None), ("g", None, None)], "patient_id string, duplicate_of_patient_id string, duplicate_group_id string")
    splits = spark.createDataFrame([("a", "train"), ("C", "VAL"), ("d", "test"), ("d", "Test."), ("e", None), ("h", "valid"), ("h", "val"), ("h", "train"), (None, "val")], "patient_id string, split string")
    groups = entity_groups([links, splits], links)
    comp = {r.patient_id: r.component for r in groups.collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g", "h": "h"}
    assert {r.patient_id for r in split_conflicts(groups, [splits]).collect()} == {"a", "b", "c", "h"}
    t = spark.createDataFrame([("train", 800), ("valid", 100), ("test", 100), (None, 5)], "split string, target_permille int")
    out = {r.patient_id: r.new_split for r in assign_splits(groups, t).collect()}
    assert out["a"] == out["b"] == out["c"]
    many = spark.range(20000).select(F.concat(F.lit("p"), "id").alias("patient_id")).withColumn("component", F.col("patient_id"))
    share = {r.new_split: r["count"] / 20000 for r in assign_splits(many, t).groupBy("new_split").count().collect()}
    assert set(share) == {"train", "val", "test"} and abs(share["train"] - 0.8) < 0.01
    shares = {r.split: r for r in split_shares(assign_splits(many, t), t).collect()}
    assert shares["train"].entities == shares["train"].components and abs(shares["train"].reached_permille - 800) < 10 and shares["val"].largest == 1
    empty = entity_groups([links.where("false")], links.where("false"))
    assert empty.count() == 0 and {r.new_split for r in assign_splits(groups, t.where("false")).collect()} == {None}


def test_sample_is_stable_as_deliveries_come(spark):
    rng = random.Random(7)
    rows = [(f" Task{i} " if i % 3 else f"task{i}", 1 + i // 900, "clash") for i in range(6000)]
    rows += [(f"TASK{rng.randrange(6000)}", rng.randrange(1, 9), "x") for _ in range(500)] + [(None, 1, "x"), ("nobatch", None, "x")]
    df = spark.createDataFrame(rows, "task_id string, batch int, seq string")
    sample = lambda d: {r.unit: r.seq for r in block_sample(number_units(first_deliveries(d, "task_id", "batch"))).collect()}
    whole = sample(df)
    assert sample(df.repartition(9)) == whole and sample(df.union(df)) == whole
    for upto in ("batch <= 3", "batch is null or batch <= 3"):
        before = sample(df.where(upto))
        assert before and before.items() <= whole.items()
    assert 0.13 < len(whole) / 6001 < 0.17
    full = [s for s in whole.values() if 0 <= s < 6000]
    assert all(sum(s // 1000 == b for s in full) == 150 for b in range(6))
    more = spark.createDataFrame([(f"odd{i}", None, "") for i in range(300)], df.schema)
    after = sample(df.union(more))
    assert {k: v for k, v in whole.items() if k != "nobatch"}.items() <= after.items()
    assert sample(df.where("false")) == {}


def test_registry_keeps_every_member(spark, tmp_path):
    rng = random.Random(5)
    make = lambda rows: first_deliveries(spark.createDataFrame(rows, "t string, b int"), "t", "b")
    reg = Registry(spark, str(tmp_path / "reg"))
    had: dict = {}
    steps = [
        [(f"t{i}", 2 + i // 1000) for i in range(3000)],
        [(f"n{i}", None) for i in range(700)] + [("t5", None)],  # no number
        [(f"late{i}", 1) for i in range(900)],  # an old delivery
        [(f"T{rng.randrange(3000)} ", rng.randrange(1, 9)) for _ in range(800)],  # redelivered
        [(f"t{i}", 9) for i in range(3000, 4000)] + [(None, 9), ("n3", 9)],
    ]
    for rows in steps:
        numbers = {r.unit: r.seq for r in reg.extend(make(rows)).collect()}
        sample = {r.unit: r.seq for r in block_sample(reg.numbers()).collect()}
        assert had.items() <= sample.items() and len(set(numbers.values())) == len(numbers)
        had = sample
    assert len(numbers) == 3000 + 700 + 900 + 1000 and len(had) > 700
    again = Registry(spark, str(tmp_path / "reg"))
    (tmp_path / "reg" / "part9").mkdir()  # a part that was never finished
    assert {r.unit: r.seq for r in again.extend(make(steps[0])).collect()} == numbers


def test_sample_plan_broadcasts_nothing(spark):
    numbers = spark.range(50_000_000).select(F.concat(F.lit("u"), "id").alias("unit"), F.col("id").alias("seq"))
    plan = block_sample(numbers)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan

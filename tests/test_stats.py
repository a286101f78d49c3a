import random

import pytest
from pyspark.sql import functions as F

from skeinlake.functions.rates import class_metrics, log_sum_exp
from skeinlake.operators import stats as S
from skeinlake.operators.textmetrics import _lcs, bleu, rouge_l


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("f", str(i), p) for i, p in enumerate((0.01, 0.04, 0.03, 0.005))] + [("g", "n", None)], "family string, test string, p double")
    got = {(r.family, r.test): r.p_holm for r in S.holm(df, ["family"]).collect()}
    assert [round(got[("f", str(i))], 9) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]
    assert got[("g", "n")] is None


def test_order_interval(spark):
    v = spark.range(2000).agg(F.collect_list(F.col("id").cast("double")).alias("v"))
    assert tuple(v.select(S.order_interval(F.col("v")).alias("i")).select("i.*").first()) == (50, 1949, 2000)
    none = spark.range(1).select(S.order_interval(F.array(F.lit(None).cast("double"))).alias("i")).select("i.*").first()
    assert tuple(none) == (None, None, 0)


def test_class_metrics_by_hand(spark):
    # tp=3, fp=3, fn=1, tn=5
    m = class_metrics(*[F.lit(x) for x in (4, 8, 3, 5, 3, 12)])
    r = spark.range(1).select(*[c.alias(n) for n, c in m.items()]).first()
    assert (r.balanced_accuracy, r.f1, r.negative_f1) == (0.6875, 0.6, pytest.approx(10 / 14, abs=1e-6))
    empty = spark.range(1).select(*[c.alias(n) for n, c in class_metrics(*[F.lit(0)] * 6).items()]).first()
    assert empty.accuracy is None and empty.balanced_accuracy is None


def test_auc_equals_pairwise(spark):
    rng = random.Random(5)
    data = [("a", rng.randrange(20), rng.random() < 0.4) for _ in range(200)] + [("b", 1, True)]
    got = {r.k: r.auc for r in S.auc(spark.createDataFrame(data, "k string, s int, y boolean"), ["k"], "s", F.col("y")).collect()}
    pos, neg = [s for k, s, y in data if k == "a" and y], [s for k, s, y in data if k == "a" and not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["a"] == pytest.approx(want) and got["b"] is None


def test_bootstrap_equals_naive(spark):
    per = spark.createDataFrame([(f"p{i}", i % 3, 1) for i in range(12)], "c string, x int, n int")
    w = S.bootstrap_weights(per, "c", 5)
    weights = {(r.replicate, r.c): r.weight for r in w.collect()}
    assert all(sum(v for (k, _), v in weights.items() if k == rep) == 12 for rep in range(5))
    got = {r.replicate: r.x for r in S.replicate_totals(per, w, "c", [], ["x"]).collect()}
    x = {f"p{i}": i % 3 for i in range(12)}
    assert got == {rep: sum(x[c] * v for (k, c), v in weights.items() if k == rep) for rep in range(5)}
    again = {(r.replicate, r.c): r.weight for r in S.bootstrap_weights(per.repartition(3), "c", 5).collect()}
    assert again == weights
    mean = S.poisson_totals(per, "c", [], ["n"], 400).agg(F.avg("n")).first()[0]
    assert 11 < mean < 13


def test_kappa_and_logsum(spark):
    same = spark.createDataFrame([("y", "y")] * 5, "a string, b string")
    assert S.kappa(same, [], "a", "b").first().kappa is None
    mixed = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "a string, b string")
    assert S.kappa(mixed, [], "a", "b").first().kappa == pytest.approx(0.4)
    assert spark.range(1).select(log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0] == pytest.approx(1000.693147)


def test_text_metrics(spark):
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(2)
    for _ in range(50):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(1, 12))], [rng.choice("abc") for _ in range(rng.randrange(0, 12))]
        assert _lcs(a, b) == plain(a, b)
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("", "x"), (None, "x")], "r string, c string")
    assert [r[0] for r in df.select(rouge_l("r", "c")).collect()] == [1.0, 0.0, None]
    four = spark.createDataFrame([("a b c d e", "a b c d e")], "r string, c string")
    assert bleu(four, [], F.col("r"), F.col("c")).first().bleu == 1.0

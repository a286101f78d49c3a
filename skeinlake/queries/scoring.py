"""Scoring: judged rows, metrics over strata, bootstrap, paired tests, AUC, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import hash_bits
from ..operators import judge as J
from ..operators import stats as S
from ..session import Workspace
from .base import judged, scored_tasks
from .catalog import Catalog
from .sqlkit import over, unit

C = Catalog()
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in J.COUNTS if c != "iou_sum") + ", round(sum(iou_sum), 4) AS iou_sum"
_R = "round({0}::DOUBLE / nullif({1}, 0), 6)"


def _metrics(rel: str, keys: str) -> str:
    """SQL: all metrics over summed counts of ``rel`` by ``keys``."""
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    r = _R.format
    return f"""SELECT {k}n, valid, accuracy, precision, recall, specificity, f1, negative_precision, negative_f1, (recall + specificity) / 2 AS balanced_accuracy, (f1 + negative_f1) / 2 AS macro_f1,
      valid_rate, mean_iou, iou_at_50, region_accuracy, strict_accuracy FROM (SELECT {k}n, valid, {r("(tp + tn)", "n")} AS accuracy, {r("tp", "(tp + fp)")} AS precision, {r("tp", "pos")} AS recall, {r("tn", "neg")} AS specificity,
      {r("(2 * tp)", "(tp + fp + pos)")} AS f1, {r("tn", "(tn + pos - tp)")} AS negative_precision, {r("(2 * tn)", "(2 * tn + pos - tp + fp)")} AS negative_f1, {r("valid", "n")} AS valid_rate, {r("iou_sum", "n_targets")} AS mean_iou,
      {r("iou_hit", "n_targets")} AS iou_at_50, {r("region_ok", "n")} AS region_accuracy, {r("strict", "n")} AS strict_accuracy FROM (SELECT {k}{_SUMS} FROM {rel}{g}))"""


def _with_metrics(sums, keys):
    sums = sums.withColumn("iou_sum", F.round("iou_sum", 4))
    return sums.select(*keys, "n", "valid", *[c.alias(n) for n, c in J.metric_columns().items()])


@C.add(over("judged") + "SELECT task_id, task_type, n::BIGINT AS n, valid::BIGINT AS valid, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, invalid::BIGINT AS invalid, n_targets::BIGINT AS n_targets, round(iou_sum, 4) AS iou_sum, iou_hit::BIGINT AS iou_hit, boxes::BIGINT AS boxes, region_ok::BIGINT AS region_ok, strict::BIGINT AS strict FROM j")
def judged_rows(spark, d):
    return judged(spark, d).select("task_id", "task_type", *[F.round(c, 4).alias(c) if c == "iou_sum" else c for c in J.COUNTS])


@C.add(over("judged") + _metrics("j", "task_type"))
def task_metrics(spark, d):
    return _with_metrics(J.totals(judged(spark, d), ["task_type"]), ["task_type"])


@C.add(over("judged") + " UNION ALL ".join(f"SELECT '{s}' AS stratum, {v} AS value, task_type, n, valid, balanced_accuracy, macro_f1, iou_at_50, strict_accuracy FROM ({_metrics('j', 'task_type' + k)})" for s, v, k in (("all", "NULL", ""), ("label", "label", ", label"), ("view_scope", "view_scope", ", view_scope"), ("region_level", "region_level", ", region_level"), ("split", "split", ", split"))))
def strata_metrics(spark, d):
    rows = judged(spark, d)
    dims = ["label", "view_scope", "region_level", "split"]
    sets = [F.struct(F.lit("all").alias("s"), F.lit(None).cast("string").alias("v")), *[F.struct(F.lit(x).alias("s"), F.col(x).alias("v")) for x in dims]]
    # one pass: each judged row joins its five strata and is combined map-side
    per = J.totals(rows.withColumn("_s", F.explode(F.array(*sets))).select("task_type", F.col("_s.s").alias("stratum"), F.col("_s.v").alias("value"), *J.COUNTS), ["stratum", "value", "task_type"])
    return _with_metrics(per, ["stratum", "value", "task_type"]).select("stratum", "value", "task_type", "n", "valid", "balanced_accuracy", "macro_f1", "iou_at_50", "strict_accuracy")


@C.add(over("judged") + f"SELECT round((max(CASE WHEN task_type = 'vqa' THEN balanced_accuracy END) + max(CASE WHEN task_type = 'grounding' THEN iou_at_50 END) + max(CASE WHEN task_type = 'grounded_vqa' THEN strict_accuracy END)) / 3, 6) AS selection_score FROM ({_metrics('j', 'task_type')})")
def selection_score(spark, d):
    return J.selection_score(task_metrics(spark, d))


@C.add(over("judged") + "SELECT task_type, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, sum(tp)::BIGINT AS tp, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, " + "sum(pos * (1 - tp) * (1 - invalid))::BIGINT AS fn_explicit, " + _R.format("sum(tp)", "(sum(tp) + sum(pos * (1 - tp) * (1 - invalid)))") + " AS recall_explicit, " + _R.format("sum(tp)", "sum(pos)") + " AS recall FROM j WHERE task_type <> 'grounding' GROUP BY task_type")
def invalid_rules(spark, d):
    """The two rules for invalid outputs side by side: misses, or left out of recall."""
    rows = judged(spark, d).where("task_type <> 'grounding'").withColumn("fn_explicit", F.col("pos") * (1 - F.col("tp")) * (1 - F.col("invalid")))
    s = rows.groupBy("task_type").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "tn", "fp", "fn_explicit", "n")])
    other = J.excluding_invalid(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn_explicit"), F.col("n"))
    return s.select("task_type", "pos", "neg", "tp", "tn", "fp", "fn_explicit", other["recall"].alias("recall_explicit"), J.metric_columns()["recall"].alias("recall"))


@C.add(over("judged") + "SELECT task_type, count(*) AS targets, " + ", ".join(f"sum((v >= {t})::INT)::BIGINT AS at_{int(t * 100)}" for t in (0.3, 0.5, 0.75, 0.9)) + " FROM (SELECT task_type, unnest(ious) AS v FROM j1) GROUP BY task_type")
def iou_threshold_sweep(spark, d):
    per = judged(spark, d).select("task_type", F.explode("ious").alias("v"))
    return per.groupBy("task_type").agg(F.count("*").alias("targets"), *[c.alias(n) for n, c in J.sweep(F.col("v")).items()])


@C.add(over("judged") + "SELECT task_type, count(*) AS regions, round(avg(m), 4) AS macro_iou FROM (SELECT task_type, label, sum(iou_sum) / sum(n_targets) AS m FROM j WHERE n_targets > 0 GROUP BY ALL) GROUP BY task_type")
def macro_region_iou(spark, d):
    per = judged(spark, d).where("n_targets > 0").groupBy("task_type", "label").agg((F.sum("iou_sum") / F.sum("n_targets")).alias("m"))
    return per.groupBy("task_type").agg(F.count("*").alias("regions"), F.round(F.avg("m"), 4).alias("macro_iou"))


@C.add(over("judged") + "SELECT split, task_type, answer_label, coalesce(said, 'invalid') AS said, count(*) AS n FROM j1 WHERE task_type <> 'grounding' GROUP BY ALL")
def confusion_by_split(spark, d):
    return judged(spark, d).where("task_type <> 'grounding'").groupBy("split", "task_type", "answer_label", F.coalesce("said", F.lit("invalid")).alias("said")).agg(F.count("*").alias("n"))


@C.add(over("judged") + """SELECT issue, count(*) AS n FROM (SELECT CASE WHEN h < 6 THEN 'not_json' WHEN h BETWEEN 30 AND 33 AND task_type <> 'vqa' THEN 'out_of_image' WHEN h BETWEEN 34 AND 36 AND task_type <> 'vqa' AND len(boxes) = 1 THEN 'no_boxes' WHEN h < 10 THEN 'wrong_task' END AS issue FROM j1) WHERE issue IS NOT NULL GROUP BY issue""")
def contract_issues(spark, d):
    """Outputs per first issue; a wrong task is named before what follows from it."""
    rows = judged(spark, d).where(F.size("issues") > 0)
    first = F.when(F.array_contains("issues", "wrong_task"), "wrong_task").otherwise(F.get("issues", F.lit(0)))
    return rows.groupBy(first.alias("issue")).agg(F.count("*").alias("n"))


@C.add(over("judged") + "SELECT task_id, task_type, label, round(iou_sum / n_targets, 6) AS mean_iou FROM j WHERE n_targets > 0 AND valid = 1 ORDER BY round(iou_sum / n_targets, 6), task_id LIMIT 20")
def worst_localisations(spark, d):
    rows = judged(spark, d).where("n_targets > 0 and valid = 1").select("task_id", "task_type", "label", F.round(F.col("iou_sum") / F.col("n_targets"), 6).alias("mean_iou"))
    return rows.orderBy("mean_iou", "task_id").limit(20)


_B = f"{unit('pred2', 'task_id')} % 100"
_TWO = over("judged", f"e AS (SELECT task_id, task_type, label, NOT (CASE WHEN task_type = 'grounding' THEN strict = 1 ELSE tp + tn = 1 END) AS wrong_a, {_B} < 12 AS wrong_b FROM j)")


def _two_models(spark, d):
    rows = judged(spark, d)
    wrong = ~F.when(F.col("task_type") == "grounding", F.col("strict") == 1).otherwise(F.col("tp") + F.col("tn") == 1)
    return rows.select("task_id", "task_type", "label", "patient_id", wrong.alias("wrong_a"), (F.pmod(hash_bits("pred2", "task_id", digits=8), F.lit(100)) < 12).alias("wrong_b"))


@C.add(_TWO + "SELECT task_type, CASE WHEN wrong_a AND wrong_b THEN 'shared' WHEN wrong_a THEN 'only_a' ELSE 'only_b' END AS who, count(*) AS n FROM e WHERE wrong_a OR wrong_b GROUP BY ALL")
def cross_model_errors(spark, d):
    who = F.when(F.col("wrong_a") & F.col("wrong_b"), "shared").when(F.col("wrong_a"), "only_a").otherwise("only_b")
    return _two_models(spark, d).where("wrong_a or wrong_b").groupBy("task_type", who.alias("who")).agg(F.count("*").alias("n"))


@C.add(_TWO + "SELECT label, count(*) AS n, sum(wrong_a::INT)::BIGINT AS wrong, round(avg(wrong_a::INT), 6) AS error_rate FROM e GROUP BY label")
def error_rate_by_region(spark, d):
    return _two_models(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("wrong_a").cast("long")).alias("wrong"), F.round(F.avg(F.col("wrong_a").cast("int")), 6).alias("error_rate"))


_KAPPA = """SELECT task_type, n, agree, round(agree::DOUBLE / n, 6) AS agreement, round((agree::DOUBLE / n - e::DOUBLE / (n * n)) / nullif(1 - e::DOUBLE / (n * n), 0), 6) AS kappa FROM (
  SELECT task_type, count(*) AS n, sum((a = b)::INT)::BIGINT AS agree, (sum(a::INT) * sum(b::INT) + sum(1 - a::INT) * sum(1 - b::INT))::DOUBLE AS e FROM (SELECT task_type, wrong_a AS a, wrong_b AS b FROM e) GROUP BY task_type)"""


@C.add(_TWO + _KAPPA)
def rater_agreement_kappa(spark, d):
    return S.kappa(_two_models(spark, d), ["task_type"], "wrong_a", "wrong_b")


@C.add(_TWO + "SELECT task_id, label FROM e WHERE wrong_a <> wrong_b")
def adjudication_queue(spark, d):
    return _two_models(spark, d).where("wrong_a <> wrong_b").select("task_id", "label")


#: Replicates of the queries and of their SQL.
R = 2000
_PATIENTS = "p AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS i, count(*) OVER () AS np FROM (SELECT DISTINCT patient_id FROM j))"
_DRAWS = f"w AS (SELECT r AS replicate, ('0x' || substr(sha256('boot:' || r || ':' || k), 1, 15))::BIGINT % (SELECT max(np) FROM p) AS i, count(*) AS weight FROM (SELECT unnest(range({R})) AS r), (SELECT unnest(range((SELECT max(np) FROM p))) AS k) GROUP BY 1, 2)"
_REPL = f"b AS (SELECT task_type, replicate, {', '.join(f'sum({c} * weight) AS {c}' for c in J.COUNTS)} FROM (SELECT task_type, patient_id, {', '.join(f'sum({c}) AS {c}' for c in J.COUNTS)} FROM j GROUP BY ALL) JOIN p USING (patient_id) JOIN w USING (i) GROUP BY ALL)"


def _replicates(spark, d):
    work = Workspace(spark, "boot")
    per = work.save(J.totals(judged(spark, d), ["task_type", "patient_id"]), "per_patient")
    weights = S.bootstrap_weights(per, "patient_id", R)
    return per, weights, S.replicate_totals(per, weights, "patient_id", ["task_type"], J.COUNTS)


@C.add(over("judged", _PATIENTS, _DRAWS) + "SELECT replicate, patient_id, weight FROM w JOIN p USING (i)")
def bootstrap_weights(spark, d):
    return _replicates(spark, d)[1]


@C.add(over("judged", _PATIENTS, _DRAWS, _REPL) + _metrics("b", "task_type, replicate").replace("precision, recall", "precision, recall"))
def bootstrap_replicate_metrics(spark, d):
    return _with_metrics(_replicates(spark, d)[2], ["task_type", "replicate"])


_LONG = "m AS (SELECT task_type, replicate, metric, value FROM (" + _metrics("b", "task_type, replicate") + ") UNPIVOT INCLUDE NULLS (value FOR metric IN (balanced_accuracy, macro_f1, mean_iou, iou_at_50, strict_accuracy)))"
_HEAD = ["balanced_accuracy", "macro_f1", "mean_iou", "iou_at_50", "strict_accuracy"]


@C.add(over("judged", _PATIENTS, _DRAWS, _REPL, _LONG) + "SELECT task_type, metric, v[1 + round_even((len(v) - 1) * 0.025, 0)::INT] AS low, v[1 + round_even((len(v) - 1) * 0.975, 0)::INT] AS high, len(v) AS used, undefined FROM (SELECT task_type, metric, coalesce(list_sort(list(value) FILTER (value IS NOT NULL)), []) AS v, count(*) FILTER (value IS NULL) AS undefined FROM m GROUP BY ALL)")
def bootstrap_intervals(spark, d):
    return S.intervals(_with_metrics(_replicates(spark, d)[2], ["task_type", "replicate"]), ["task_type"], _HEAD)


_PAIR = f"""pp AS (SELECT patient_id, count(*) AS n, sum((NOT wrong_a)::INT) AS a, sum((NOT wrong_b)::INT) AS b FROM e JOIN j USING (task_id) GROUP BY patient_id),
  pr AS (SELECT replicate, sum(a * weight)::DOUBLE / sum(n * weight) - sum(b * weight)::DOUBLE / sum(n * weight) AS d FROM pp JOIN p USING (patient_id) JOIN w USING (i) GROUP BY replicate)"""


@C.add(_TWO.rstrip() + ",\n" + ",\n".join((_PATIENTS, _DRAWS, _PAIR)) + "\nSELECT count(*) AS n, round(avg(d), 6) AS mean_difference, least(1.0, (least(sum((d <= 0)::INT), sum((d >= 0)::INT)) + 1) * 2 / (count(*) + 1)) AS p FROM pr")
def paired_bootstrap(spark, d):
    work = Workspace(spark, "paired")
    rows = _two_models(spark, d)
    per = work.save(rows.groupBy("patient_id").agg(F.count("*").alias("n"), F.sum((~F.col("wrong_a")).cast("long")).alias("a"), F.sum((~F.col("wrong_b")).cast("long")).alias("b")), "per_patient")
    repl = work.save(S.replicate_totals(per, S.bootstrap_weights(per, "patient_id", R), "patient_id", [], ["n", "a", "b"]), "replicates")
    one = lambda c: repl.select(F.lit(1).alias("all"), "replicate", (F.col(c) / F.col("n")).alias("v"))
    return S.paired(one("a"), one("b"), ["all"], "v").select("n", F.round("mean_difference", 6).alias("mean_difference"), "p")


_W = " + ".join(f"(u >= {p!r})::INT" for p in S.POISSON)


@C.add(over("judged", f"pw AS (SELECT task_type, patient_id, sum(n) AS n, sum(tp + tn) AS ok, unnest(range({R})) AS replicate FROM j GROUP BY 1, 2)") + f"SELECT task_type, replicate, sum(n * w)::BIGINT AS n, sum(ok * w)::BIGINT AS ok FROM (SELECT *, {_W} AS w FROM (SELECT *, ('0x' || substr(sha256('boot:' || replicate || ':' || patient_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM pw)) WHERE w > 0 GROUP BY ALL")
def poisson_bootstrap(spark, d):
    per = judged(spark, d).groupBy("task_type", "patient_id").agg(F.sum("n").alias("n"), F.sum(F.col("tp") + F.col("tn")).alias("ok"))
    out = S.poisson_totals(per, "patient_id", ["task_type"], ["n", "ok"], R)
    return out.select("task_type", F.col("replicate").cast("long").alias("replicate"), "n", "ok")


_SCORE = f"sc AS (SELECT task_type, region_level, answer_label IN ('yes', 'abnormal') AS y, ({unit('score', 'task_id')} % 60 + CASE WHEN answer_label IN ('yes', 'abnormal') THEN 15 ELSE 0 END)::BIGINT AS score FROM s WHERE task_type <> 'grounding')"
_AUC = "SELECT {0} auc, positives, negatives FROM (SELECT {0} CASE WHEN max(np) * max(nn) > 0 THEN sum(p * (below - n / 2.0)) / (max(np)::DOUBLE * max(nn)) END AS auc, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM (SELECT {0} p, n, sum(n) OVER ({1} ORDER BY score) AS below, sum(p) OVER ({1}) AS np, sum(n) OVER ({1}) AS nn FROM (SELECT {0} score, sum(y::INT) AS p, sum((NOT y)::INT) AS n FROM sc GROUP BY {0} score)) GROUP BY {2})"


def _scores(spark, d):
    y = F.col("answer_label").isin("yes", "abnormal")
    rows = scored_tasks(spark, d).where("task_type <> 'grounding'")
    return rows.select("task_id", "task_type", "region_level", "patient_id", y.alias("y"), (F.pmod(hash_bits("score", "task_id", digits=8), F.lit(60)) + F.when(y, 15).otherwise(0)).alias("score"))


@C.add(over("scored", _SCORE) + "SELECT task_type, round(auc, 6) AS auc, positives, negatives FROM (" + _AUC.format("task_type,", "PARTITION BY task_type", "task_type") + ")")
def rank_auc(spark, d):
    return S.auc(_scores(spark, d), ["task_type"], "score", F.col("y")).withColumn("auc", F.round("auc", 6))


@C.add(over("scored", _SCORE) + "SELECT task_type, region_level, round(auc, 6) AS auc, positives, negatives FROM (" + _AUC.format("task_type, region_level,", "PARTITION BY task_type, region_level", "task_type, region_level") + ")")
def auc_by_level(spark, d):
    return S.auc(_scores(spark, d), ["task_type", "region_level"], "score", F.col("y")).withColumn("auc", F.round("auc", 6))


@C.add(over("scored", _SCORE) + "SELECT task_type, score::DOUBLE AS threshold, sum(sum(y::INT)) OVER w::BIGINT AS tp, sum(sum((NOT y)::INT)) OVER w::BIGINT AS fp FROM sc GROUP BY task_type, score WINDOW w AS (PARTITION BY task_type ORDER BY score DESC) UNION ALL SELECT DISTINCT task_type, NULL, 0, 0 FROM sc".replace("sum(sum(y::INT)) OVER w::BIGINT", "(sum(sum(y::INT)) OVER w)::BIGINT").replace("sum(sum((NOT y)::INT)) OVER w::BIGINT", "(sum(sum((NOT y)::INT)) OVER w)::BIGINT"))
def roc_points(spark, d):
    return S.roc_points(_scores(spark, d), ["task_type"], "score", F.col("y"))


_P = f"tests AS (SELECT task_type AS family, coalesce(label, 'none') AS test, (min({unit('p', 'task_id')}) % 1000 + 1) / 20000.0 AS p FROM t GROUP BY 1, 2)"


@C.add(over("tasks", _P) + "SELECT family, test, p, max(least(1.0, (m - r) * p)) OVER (PARTITION BY family ORDER BY r) AS p_holm FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) - 1 AS r FROM tests)".replace("(min(", "(min(").replace("p, max", "p::DOUBLE AS p, max").replace("AS p_holm", "::DOUBLE AS p_holm").replace("ORDER BY r) ::DOUBLE", "ORDER BY r)::DOUBLE"))
def holm_adjust(spark, d):
    from .base import tasks

    t = tasks(spark, d).groupBy(F.col("task_type").alias("family"), F.coalesce("label", F.lit("none")).alias("test")).agg(((F.pmod(F.min(hash_bits("p", "task_id", digits=8)), F.lit(1000)) + 1) / 20000.0).alias("p"))
    return S.holm(t, ["family"]).select("family", "test", "p", "p_holm")


QUERIES, ORACLE = C.queries, C.sql

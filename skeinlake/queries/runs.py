"""Review, manifests, exports and runs over several systems, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import clean_key, hash_bits
from ..operators import baselines as B
from ..operators import export as E
from ..operators import judge as J
from ..operators import manifest as M
from ..operators import profile as P
from ..operators import review as V
from ..operators import runs as N
from ..operators import stats as S
from ..tables import table
from .audit import _CODE, _NB, split_leakage
from .audit import ORACLE as _AUDIT
from .base import tasks
from .build import _CANON, _PAIRS, canonical, pairs
from .catalog import Catalog
from .scoring import _TWO, _metrics, _scores, _two_models, iou_threshold_sweep, task_metrics
from .sqlkit import key, over, unit

C = Catalog()
_TABLES = {"canonical": "canonical", "paired_evidence": "paired_evidence", "metastases": "metastases", "patient_splits": "patient_splits", "whole_records": "whole_records", "vqa": "multitask", "grounding": "multitask", "grounded_vqa": "multitask", "lesion_vqa": "multitask", "lesion_grounding": "multitask"}
_WHERE = {"vqa": "task_type = 'vqa' and metastasis_id is null", "grounding": "task_type = 'grounding' and metastasis_id is null", "grounded_vqa": "task_type = 'grounded_vqa'", "lesion_vqa": "task_type = 'vqa' and metastasis_id is not null", "lesion_grounding": "task_type = 'grounding' and metastasis_id is not null"}
_BROKEN = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{n}' AS rule, count(*) AS n FROM {t} WHERE {_WHERE.get(k, 'true')} AND ({r.format(size='len')}) HAVING count(*) > 0" for k, t in _TABLES.items() for n, r in M.RULES[k].items())


@C.add(_BROKEN)
def manifest_violations(spark, d):
    out = None
    for kind, t in _TABLES.items():
        rows = M.violations(table(spark, d, t).where(_WHERE.get(kind, "true")), kind)
        out = rows if out is None else out.unionByName(rows)
    return out


@C.add(f"SELECT 'required_names' AS check, 1::BIGINT AS n, false AS passed UNION ALL SELECT 'manifests_valid', sum(n)::BIGINT, sum(n) = 0 FROM ({_BROKEN}) UNION ALL SELECT 'no_leakage', count(*), count(*) = 0 FROM ({_AUDIT['split_leakage']})")
def publication_gate(spark, d):
    """The gate of a release that lacks its licence file."""
    present = spark.createDataFrame([(t,) for t in set(_TABLES.values())], "name string")
    return M.gate(present, ["canonical", "multitask", "patient_splits", "license"], manifest_violations(spark, d), split_leakage(spark, d))


# the two views of a pair, if it has each of them once with a whole box
_CASES = f"""im AS (SELECT evidence_id, region, pair_diagnosis, diagnosis_by_view, unnest(images) AS x FROM pe), two AS (SELECT evidence_id FROM im WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) = 2 AND count(*) FILTER (x.view = 'ANT' AND len(x.bbox) = 4) = 1 AND count(*) FILTER (x.view = 'POST' AND len(x.bbox) = 4) = 1),
  ca AS (SELECT evidence_id, substr(sha256('review:' || evidence_id), 1, 16) AS review_id, x.view AS view, x.bbox AS bbox, coalesce(CASE WHEN x.view = 'ANT' THEN diagnosis_by_view.ANT ELSE diagnosis_by_view.POST END, 'normal') AS dx FROM im JOIN two USING (evidence_id) WHERE x IS NOT NULL)"""
_H = lambda who: f"(('0x' || substr(sha256('{who}:' || review_id || ':' || view), 1, 8))::UBIGINT::BIGINT % 100)"
_O = lambda who: f"(('0x' || substr(sha256('{who}:' || review_id), 1, 8))::UBIGINT::BIGINT % 100)"


def _said(who: str) -> str:
    return f"CASE WHEN {_H(who)} < 10 THEN CASE dx WHEN 'normal' THEN 'abnormal' ELSE 'normal' END ELSE dx END AS dx_{who}, CASE WHEN {_H(who)} < 20 THEN 'correct' WHEN {_H(who)} < 25 THEN 'not_assessable' ELSE 'accept' END AS st_{who}, CASE WHEN {_O(who)} < 5 THEN 'exclude' ELSE 'include' END AS od_{who}"


_MOVED = "(CASE WHEN st_{0} = 'correct' THEN 3 ELSE 0 END)"
_SHIFT = f"abs({_MOVED.format('a')} - {_MOVED.format('b')})"
_READ = f"""rd AS (SELECT *, CASE WHEN st_a <> 'not_assessable' AND st_b <> 'not_assessable' THEN CASE WHEN bw > {_SHIFT} AND bh > 0 THEN (bw - {_SHIFT}) * bh / (2 * bw * bh - (bw - {_SHIFT}) * bh) WHEN bw * bh > 0 THEN 0.0 ELSE 0.0 END END AS iou FROM (SELECT *, bbox[3] - bbox[1] AS bw, bbox[4] - bbox[2] AS bh, {_said('a')}, {_said('b')} FROM ca)),
  df AS (SELECT *, list_filter([CASE WHEN dx_a <> dx_b THEN 'diagnosis:' || view END, CASE WHEN iou IS NULL AND st_a <> st_b THEN 'bbox_status:' || view END, CASE WHEN iou IS NOT NULL AND (st_a <> st_b OR iou < 0.9) THEN 'bbox:' || view END, CASE WHEN od_a <> od_b THEN 'overall_decision' END], lambda x: x IS NOT NULL) AS diffs FROM rd)"""
_REVIEW = "WITH " + ",\n".join((_PAIRS, _CASES, _READ)) + "\n"


def _evidence(spark, d):
    x = pairs(spark, d).select("evidence_id", "region", "diagnosis_by_view", F.explode("images").alias("x")).where("x is not null")
    one = lambda v: F.sum(F.coalesce((F.col("x.view") == v) & (F.size("x.bbox") == 4), F.lit(False)).cast("int")) == 1
    two = x.groupBy("evidence_id").agg((F.count("*") == 2).alias("n"), one("ANT").alias("a"), one("POST").alias("p")).where("n and a and p").select("evidence_id")
    dx = F.coalesce(F.when(F.col("x.view") == "ANT", F.col("diagnosis_by_view.ANT")).otherwise(F.col("diagnosis_by_view.POST")), F.lit("normal"))
    return x.join(two, "evidence_id", "left_semi").select("evidence_id", "region", F.col("x.view").alias("view"), F.col("x.image").alias("image"), F.col("x.bbox").alias("bbox"), dx.alias("diagnosis"))


def _responses(cases, who):
    h, o = F.pmod(hash_bits(who, "review_id", "view", digits=8), F.lit(100)), F.pmod(hash_bits(who, "review_id", digits=8), F.lit(100))
    other = F.when(F.col("diagnosis") == "normal", "abnormal").otherwise("normal")
    b = lambda i: F.get("bbox", F.lit(i))
    return cases.select("review_id", "view", F.lit(who).alias("reviewer_id"), F.when(h < 10, other).otherwise(F.col("diagnosis")).alias("diagnosis"), F.when(h < 20, "correct").when(h < 25, "not_assessable").otherwise("accept").alias("bbox_status"), F.array(b(0) + 3, b(1), b(2) + 3, b(3)).alias("corrected_bbox"), F.when(o < 5, "exclude").otherwise("include").alias("overall_decision"))


def _compared(spark, d):
    ev = _evidence(spark, d)
    queue, labels = V.blind(ev)
    cases = labels.join(queue, ["review_id", "view"])
    return V.compare_readers(queue, _responses(cases, "a"), _responses(cases, "b"))


@C.add(_REVIEW + "SELECT unnest(diffs) AS difference, count(*) AS n FROM df GROUP BY 1")
def review_differences(spark, d):
    return _compared(spark, d).select(F.explode("differences").alias("difference")).groupBy("difference").agg(F.count("*").alias("n"))


@C.add(_REVIEW + """, v AS (SELECT count(*) AS n, count(*) FILTER (dx_a = dx_b) AS dx, count(*) FILTER (st_a = st_b) AS st, count(iou) AS nb, count(*) FILTER (iou >= 0.9) AS ob, avg(iou) AS mi,
    count(*) FILTER (dx_a = 'normal') AS na, count(*) FILTER (dx_b = 'normal') AS nbn FROM df), c AS (SELECT count(*) AS nc, count(*) FILTER (m = 0) AS full_, count(*) FILTER (o) AS od FROM (SELECT review_id, max(len(diffs)) AS m, bool_and(od_a = od_b) AS o FROM df GROUP BY 1))
  SELECT 'diagnosis' AS measure, n, dx AS agreed, round(dx::DOUBLE / n, 6) AS value FROM v UNION ALL SELECT 'diagnosis_kappa', n, dx, round((dx::DOUBLE / n - k.e) / (1 - k.e), 6) FROM v, (SELECT sum(x * y)::DOUBLE AS e FROM (SELECT dx, count(*) FILTER (w = 'a')::DOUBLE / (SELECT n FROM v) AS x, count(*) FILTER (w = 'b')::DOUBLE / (SELECT n FROM v) AS y FROM (SELECT dx_a AS dx, 'a' AS w FROM df UNION ALL SELECT dx_b, 'b' FROM df) GROUP BY dx)) k
  UNION ALL SELECT 'bbox_status', n, st, round(st::DOUBLE / n, 6) FROM v UNION ALL SELECT 'bbox', nb, ob, round(ob::DOUBLE / nb, 6) FROM v UNION ALL SELECT 'mean_iou', nb, ob, round(mi, 6) FROM v UNION ALL SELECT 'overall_decision', nc, od, round(od::DOUBLE / nc, 6) FROM c UNION ALL SELECT 'fully_agreed', nc, full_, round(full_::DOUBLE / nc, 6) FROM c""")
def review_agreement(spark, d):
    return V.agreement(_compared(spark, d))


@C.add(_REVIEW + """, g AS (SELECT evidence_id, review_id, od_a = 'exclude' OR od_b = 'exclude' AS out_, max((dx_a = 'abnormal')::INT) AS w FROM df GROUP BY ALL) SELECT CASE WHEN out_ THEN 'excluded' WHEN w = 1 THEN 'abnormal' ELSE 'normal' END AS outcome, count(*) AS n FROM g GROUP BY 1""")
def gold_outcomes(spark, d):
    """Adjudicated by the first reader's answers; a case either reader excludes is out."""
    ev = _evidence(spark, d)
    queue, labels = V.blind(ev)
    rows = _compared(spark, d)
    box = V.effective_box(F.col("bbox_status_a"), F.col("corrected_bbox_a"), F.col("bbox"))
    decisions = rows.select("review_id", "view", F.when((F.col("overall_decision_a") == "exclude") | (F.col("overall_decision_b") == "exclude"), "exclude").otherwise("include").alias("final_decision"), box.alias("final_bbox"), F.col("diagnosis_a").alias("final_diagnosis"))
    kept, out = V.gold(ev, labels, decisions)
    kept = kept.select("evidence_id", F.col("pair_diagnosis").alias("outcome")).distinct().groupBy("outcome").agg(F.count("*").alias("n"))
    return kept.unionByName(out.groupBy(F.lit("excluded").alias("outcome")).agg(F.count("*").alias("n")))


_VIEW = "list_filter(images, lambda y: y.view = '{0}')[1].image_size"
_GRID = "lpad((least(greatest(round_even({0} * 1023::DOUBLE / {1}, 0)::INT, 0), 1023))::VARCHAR, 4, '0')"
_TOKEN = "'<loc' || " + " || '><loc' || ".join(_GRID.format(c, s) for c, s in (("x.bbox[2]", "hh"), ("(x.bbox[1] + off)", "ww"), ("x.bbox[4]", "hh"), ("(x.bbox[3] + off)", "ww"))) + " || '>'"
_OK = "coalesce(len(x.bbox) = 4 AND x.bbox[1] >= 0 AND x.bbox[2] >= 0 AND x.bbox[1] < x.bbox[3] AND x.bbox[2] < x.bbox[4], false)"
_SZ = "(CASE x.view WHEN 'ANT' THEN sa WHEN 'POST' THEN sp END)"


def _any(cond: str) -> str:
    return f"len(list_filter(t, lambda x: coalesce({cond}, false))) > 0"


@C.add(over("tasks") + f"""SELECT task_id, CASE WHEN why = '' THEN array_to_string(list_transform(t, lambda x: {_TOKEN.replace("off", "(CASE WHEN x.view = 'POST' THEN coalesce(sa[1], 0) ELSE 0 END)")} || ' ' || label), ' ; ') END AS target, why AS reasons FROM (
  SELECT *, array_to_string(list_filter([CASE WHEN len(t) = 0 THEN 'no_targets' END, CASE WHEN {_any(f"NOT {_OK}")} THEN 'bad_box' END, CASE WHEN {_any(f"x.view IN ('ANT', 'POST') AND coalesce(len({_SZ}), 0) <> 2")} THEN 'no_size' END, CASE WHEN {_any(f"{_OK} AND (x.bbox[3] > {_SZ}[1] OR x.bbox[4] > {_SZ}[2])")} THEN 'out_of_image' END,
    CASE WHEN {_any("NOT coalesce(x.view IN ('ANT', 'POST'), false)")} THEN 'unknown_view' END, CASE WHEN len(list_distinct(vs)) + (len(list_filter(vs, lambda v: v IS NULL)) > 0)::INT < len(vs) THEN 'repeated_view' END, CASE WHEN list_sort(vs, 'ASC', 'NULLS LAST') <> vs THEN 'view_order' END, CASE WHEN label IS NULL THEN 'no_label' END], lambda r: r IS NOT NULL), ',') AS why
  FROM (SELECT task_id, label, t, list_transform(t, lambda x: x.view) AS vs, sa, sp, coalesce(sa[1], 0) + coalesce(sp[1], 0) AS ww, greatest(sa[2], sp[2]) AS hh FROM (SELECT task_id, label, coalesce(targets, []) AS t, {_VIEW.format("ANT")} AS sa, {_VIEW.format("POST")} AS sp FROM t WHERE task_type <> 'vqa')))""")
def location_token_rows(spark, d):
    rows = E.token_rows(tasks(spark, d).where("task_type <> 'vqa'"))
    return rows.select("task_id", "target", F.array_join("reasons", ",").alias("reasons"))


@C.add("SELECT rec_id, regexp_replace(regexp_replace(replace(replace(CASE rec_id % 3 WHEN 0 THEN 'C:\\data\\' WHEN 1 THEN '/mnt/x/datasets/' ELSE './' END || source_path, '\\', '/'), 'C:', ''), '^/mnt/x/', ''), '^(\\./|/)+', '') AS path, regexp_extract(source_path, '([^/]*)$', 1) AS name FROM whole_records")
def portable_paths(spark, d):
    w = table(spark, d, "whole_records")
    made = F.concat(F.when(F.col("rec_id") % 3 == 0, "C:\\data\\").when(F.col("rec_id") % 3 == 1, "/mnt/x/datasets/").otherwise("./"), "source_path")
    return w.select("rec_id", E.portable_path(made).alias("path"), E.base_name(F.col("source_path")).alias("name"))


@C.add(over("tasks") + f", x AS (SELECT *, {unit('exp', 'task_id')} % 100 AS h FROM t) SELECT 'prompt' AS field, count(*) FILTER (h < 3 AND prompt IS NOT NULL) AS n_different FROM x UNION ALL SELECT 'split', count(*) FILTER (h BETWEEN 10 AND 11 AND split IS DISTINCT FROM 'train') FROM x UNION ALL SELECT 'images', 0 UNION ALL SELECT 'only_first', count(*) FILTER (h = 50) FROM x UNION ALL SELECT 'only_second', 0")
def export_parity_fields(spark, d):
    """A release against an export with other folders, some changed prompts and splits, and some rows missing."""
    t = tasks(spark, d).select("task_id", "prompt", "split", "images")
    h = F.pmod(hash_bits("exp", "task_id", digits=8), F.lit(100))
    moved = F.transform("images", lambda i: F.struct(F.concat(F.lit("export/"), E.base_name(i["image"])).alias("image")))
    e = t.where(h != 50).select("task_id", F.when(h < 3, F.concat("prompt", F.lit("?!"))).otherwise(F.col("prompt")).alias("prompt"), F.when(h.between(10, 11), "train").otherwise(F.col("split")).alias("split"), moved.alias("images"))
    return E.export_parity(t, e)


@C.add("SELECT user_id, arg_min(day, (-score, day)) AS best_epoch, max(score) AS best_score, max(day) AS last_epoch, count(*) AS epochs, count(*) FILTER (score IS NULL) AS undefined FROM (SELECT user_id, day(ts)::INT AS day, round(avg(CASE WHEN event_type <> 'click' THEN value END), 4) AS score FROM events WHERE user_id IS NOT NULL GROUP BY ALL) GROUP BY user_id")
def best_epochs(spark, d):
    """Users as runs, days as epochs, mean values as scores."""
    log = table(spark, d, "events").where("user_id is not null").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.round(F.avg(F.when(F.col("event_type") != "click", F.col("value"))), 4).alias("score"))
    return N.best_epoch(log, "user_id", "day", "score")


_PRIOR = "pr AS (SELECT split, region_level, interaction_type, coalesce(coalesce(near.a, far.a) = t.answer_label, false)::INT AS ok FROM t LEFT JOIN near ON t.task_type = near.task_type AND t.label = near.label LEFT JOIN far ON t.task_type = far.task_type WHERE split IN ('val', 'test') AND t.answer_label IS NOT NULL)"
_MODE2 = "SELECT {0}, arg_min(answer_label, (-n, answer_label)) AS a FROM (SELECT {0}, answer_label, count(*) AS n FROM t WHERE split = 'train' AND answer_label IS NOT NULL GROUP BY ALL) GROUP BY ALL"


@C.add(over("tasks", f"near AS ({_MODE2.format('task_type, label')})", f"far AS ({_MODE2.format('task_type')})", _PRIOR) + " UNION ALL ".join(f"SELECT '{j}' AS job, {v} AS value, count(*) AS n, sum(ok)::BIGINT AS right, round(sum(ok)::DOUBLE / count(*), 6) AS accuracy FROM pr GROUP BY ALL" for j, v in (("level", "coalesce(region_level, 'none')"), ("interaction", "coalesce(interaction_type, 'none')"), ("level_interaction", "coalesce(region_level || '/' || interaction_type, 'none')"), ("split", "coalesce(split, 'none')"), ("pooled", "'all'"))))
def prior_run(spark, d):
    """Majority answers fitted on train, judged on val and test: per job and pooled."""
    t = tasks(spark, d)
    rows = B.majority_prior(t.where("split = 'train'"), t.where("split in ('val', 'test') and answer_label is not null").select("task_id", "task_type", "label", "split", "region_level", "interaction_type", "answer_label"), ["task_type", "label"], "answer_label", ["task_type"])
    jobs = {"level": F.col("region_level"), "interaction": F.col("interaction_type"), "level_interaction": F.concat("region_level", F.lit("/"), "interaction_type"), "split": F.col("split"), "pooled": F.lit("all")}
    return N.job_accuracy(rows, jobs, F.col("predicted") == F.col("answer_label"))


_WORDS = r"\b(left|right|chest|knee|ankle|elbow|shoulder|vertebra|pelvis|head)\b"
_VARIANT = {"whole": "coalesce(prompt, '')", "no_region": rf"regexp_replace(lower(coalesce(prompt, '')), '{_WORDS}', ' ', 'g')", "first_word": "split_part(lower(coalesce(prompt, '')), ' ', 1)"}


def _nb_variant(name: str) -> str:
    sql = _NB.replace(_CODE, _CODE.replace("coalesce(prompt, '')", _VARIANT[name]))
    for cte in ("tr", "cl", "tk", "den", "ev", "sc"):
        for before, after in ((f"{cte} AS (", f"{cte}_{name} AS ("), (f"FROM {cte} ", f"FROM {cte}_{name} {cte} "), (f"FROM {cte})", f"FROM {cte}_{name} {cte})"), (f"JOIN {cte} ", f"JOIN {cte}_{name} {cte} ")):
            sql = sql.replace(before, after)
    return sql.replace("FROM ev e", f"FROM ev_{name} e").replace(f"ev_{name} ev e", f"ev_{name} e")


_PICK = "SELECT '{0}' AS variant, p.task_type, count(*) AS n, sum((said = answer_label)::INT)::BIGINT AS right FROM (SELECT task_id, task_type, arg_min(answer_label, (-round(score, 9), answer_label)) AS said FROM sc_{0} GROUP BY ALL) p JOIN t USING (task_id) WHERE answer_label IS NOT NULL GROUP BY ALL"


@C.add(over("tasks", *map(_nb_variant, _VARIANT)) + " UNION ALL ".join(_PICK.format(v) for v in _VARIANT))
def control_decomposition(spark, d):
    """The text-only classifier on whole prompts, prompts without region words, and their first words: right answers on test."""
    t = tasks(spark, d).where("task_type <> 'grounding'")
    whole = F.coalesce("prompt", F.lit(""))
    text = {"whole": whole, "no_region": F.regexp_replace(F.lower(whole), _WORDS, " "), "first_word": F.split_part(F.lower(whole), F.lit(" "), F.lit(1))}
    out = None
    for name, col in text.items():
        rows = t.withColumn("_text", col)
        nb = B.NaiveBayes(rows.where("split = 'train'"), "task_type", "answer_label", "_text")
        test = rows.where("split = 'test'").where(F.size(B.code_tokens(F.col("_text"))) > 0)
        got = nb.predict(test.select("task_id", "task_type", "_text"), "task_id").join(test.select("task_id", "answer_label"), "task_id").where("answer_label is not null")
        one = got.groupBy(F.lit(name).alias("variant"), "task_type").agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("answer_label")).cast("long")).alias("right"))
        out = one if out is None else out.unionByName(one)
    return out


@C.add(_TWO + "SELECT coalesce(region_level, 'none') AS value, c AS condition, count(*) AS n, sum(CASE c WHEN 'real' THEN (NOT wrong_a)::INT ELSE (NOT wrong_b)::INT END)::BIGINT AS right FROM e JOIN t USING (task_id), (SELECT unnest(['real', 'blank']) AS c) GROUP BY ALL")
def blank_image_levels(spark, d):
    """Accuracy with the images and with blank ones (a second made output), by level."""
    rows = _two_models(spark, d).join(tasks(spark, d).select("task_id", "region_level"), "task_id")
    out = None
    for c, wrong in (("real", "wrong_a"), ("blank", "wrong_b")):
        one = N.job_accuracy(rows, {"level": F.col("region_level")}, ~F.col(wrong)).select("value", F.lit(c).alias("condition"), "n", "right")
        out = one if out is None else out.unionByName(one)
    return out


_SC = f"sc AS (SELECT task_id, task_type, answer_label IN ('yes', 'abnormal') AS y, ({unit('score', 'task_id')} % 60 + CASE WHEN answer_label IN ('yes', 'abnormal') THEN 15 ELSE 0 END)::BIGINT AS score FROM s WHERE task_type <> 'grounding')"


@C.add(over("scored", _SC) + "SELECT task_type, count(*) AS n, sum(((score >= 37) = y)::INT)::BIGINT AS agree, round(sum(((score >= 37) = y)::INT)::DOUBLE / count(*), 6) AS agreement FROM sc GROUP BY task_type")
def score_side_agreement(spark, d):
    return N.side_agreement(_scores(spark, d), ["task_type"], "score", F.col("y"), 37)


@C.add(over("scored", _SC) + ", u AS (SELECT 'whole' AS system, score, y FROM sc UNION ALL SELECT 'inverse', 100 - score, y FROM sc), w AS (SELECT system, score, sum(y::INT) AS p, sum((NOT y)::INT) AS n FROM u GROUP BY ALL) SELECT system, round(sum(p * (below - n / 2.0)) / (max(np)::DOUBLE * max(nn)), 6) AS auc, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM (SELECT *, sum(n) OVER (PARTITION BY system ORDER BY score) AS below, sum(p) OVER (PARTITION BY system) AS np, sum(n) OVER (PARTITION BY system) AS nn FROM w) GROUP BY system")
def complete_system_auc(spark, d):
    """AUC of the systems that score every task; a third one leaves some out and takes no part."""
    s = _scores(spark, d).select("task_id", "y", "score")
    made = s.select("task_id", F.explode(F.array(F.struct(F.lit("whole").alias("system"), F.col("score").alias("score")), F.struct(F.lit("inverse").alias("system"), (100 - F.col("score")).alias("score")), F.struct(F.lit("partial").alias("system"), F.when(F.col("score") > 3, F.col("score")).alias("score")))).alias("r")).select("task_id", "r.*")
    full = N.complete_systems(s, made.where("score is not null"))
    return S.auc(full.join(s.select("task_id", "y"), "task_id"), ["system"], "score", F.col("y")).withColumn("auc", F.round("auc", 6))


_FIVE = ("balanced_accuracy", "macro_f1", "mean_iou", "iou_at_50", "strict_accuracy")


@C.add(over("judged") + f"SELECT task_type, metric, value FROM ({_metrics('j', 'task_type')}) UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(_FIVE)})) UNION ALL SELECT task_type, 'at_' || t, round(sum((v >= t / 100.0)::INT)::DOUBLE / count(*), 6) FROM (SELECT task_type, unnest(ious) AS v FROM j1), (SELECT unnest([30, 50, 75, 90]) AS t) GROUP BY ALL")
def full_report(spark, d):
    """Metrics and the sweep of overlaps of every task as one long table."""
    long = lambda df, names: df.select("task_type", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")).select("task_type", "r.*")
    sweep = iou_threshold_sweep(spark, d)
    names = [c for c in sweep.columns if c.startswith("at_")]
    shares = sweep.select("task_type", *[J.rate(F.col(c), F.col("targets")).alias(c) for c in names])
    return long(task_metrics(spark, d), _FIVE).unionByName(long(shares, names))


@C.add("WITH " + _CANON + " SELECT flag, count(*) AS n FROM (SELECT unnest(map_entries(map_concat(coalesce(flags, MAP {}::MAP(VARCHAR, BOOLEAN)), MAP {'outlier': row_id % 5 = 0, 'seen': true}))) AS e FROM c), LATERAL (SELECT e.key AS flag) WHERE e.value GROUP BY flag")
def merged_flag_counts(spark, d):
    later = F.create_map(F.lit("outlier"), F.col("row_id") % 5 == 0, F.lit("seen"), F.lit(True))
    return P.flag_counts(canonical(spark, d).select(N.merge_flags(F.col("flags"), later).alias("flags")), "flags")


_LEAF = {"region": "region", "pair_diagnosis": "pair_diagnosis", "diagnosis_by_view.ANT": "diagnosis_by_view.ANT", "diagnosis_by_view.POST": "diagnosis_by_view.POST", "source_labels.ANT": "source_labels.ANT", "source_labels.POST": "source_labels.POST"}
_ENDS = f"e AS (SELECT {key('evidence_id')} AS k, region, pair_diagnosis, diagnosis_by_view, source_labels, row_number() OVER (PARTITION BY {key('evidence_id')} ORDER BY ingested_at, row_id) AS f, row_number() OVER (PARTITION BY {key('evidence_id')} ORDER BY ingested_at DESC, row_id DESC) AS l FROM paired_evidence WHERE evidence_id IS NOT NULL)"


@C.add(f"WITH {_ENDS} " + " UNION ALL ".join(f"SELECT '{n}' AS path, count(*) AS n FROM e a JOIN e b USING (k) WHERE a.f = 1 AND b.l = 1 AND a.{p} IS DISTINCT FROM b.{p} HAVING count(*) > 0" for n, p in _LEAF.items()))
def redelivery_changes(spark, d):
    """Leaves on which the first and the last delivery of an evidence differ."""
    fields = ["region", "pair_diagnosis", "diagnosis_by_view", "source_labels"]
    e = table(spark, d, "paired_evidence").withColumn("k", clean_key("evidence_id"))
    rows = e.where("k is not null").groupBy("k").agg(F.min_by(F.struct(*fields), F.struct("ingested_at", "row_id")).alias("a"), F.max_by(F.struct(*fields), F.struct("ingested_at", "row_id")).alias("b"))
    return N.nested_diff(rows.select("k", "a.*"), rows.select("k", "b.*"), "k").groupBy("path").agg(F.count("*").alias("n"))


@C.add(over("scored") + "SELECT CASE WHEN task_id IN (SELECT task_id FROM s) THEN 'scored' WHEN label IS NULL OR patient_id IS NULL THEN 'no_label_or_patient' WHEN answer_label = 'uncertain' THEN 'uncertain' ELSE 'unsound' END AS state, count(*) AS n FROM t GROUP BY 1")
def scored_states(spark, d):
    """Tasks that the scoring queries judge, and those they leave out by reason."""
    from .base import scored_tasks

    s = scored_tasks(spark, d).select("task_id", F.lit(True).alias("_s"))
    t = tasks(spark, d).select("task_id", "label", "patient_id", "answer_label").join(s, "task_id", "left")
    why = F.when(F.col("_s"), "scored").when(F.col("label").isNull() | F.col("patient_id").isNull(), "no_label_or_patient").when(F.col("answer_label") == "uncertain", "uncertain").otherwise("unsound")
    return t.groupBy(why.alias("state")).agg(F.count("*").alias("n"))


@C.add("WITH " + _CANON + " SELECT patient_id, view, count(*) AS boxes, count(*) FILTER (diagnosis = 'abnormal') AS red, count(*) FILTER (diagnosis IS DISTINCT FROM 'abnormal') AS green FROM c WHERE NOT coalesce(flags['low_precision_region'], false) AND patient_id IS NOT NULL AND view IS NOT NULL GROUP BY ALL")
def overlay_groups(spark, d):
    """Boxes to draw on each image, by colour, low-precision regions left out."""
    c = canonical(spark, d).where(~F.coalesce(F.try_element_at("flags", F.lit("low_precision_region")), F.lit(False))).where("patient_id is not null and view is not null")
    red = F.coalesce(F.col("diagnosis") == "abnormal", F.lit(False))
    return c.groupBy("patient_id", "view").agg(F.count("*").alias("boxes"), F.sum(red.cast("long")).alias("red"), F.sum((~red).cast("long")).alias("green"))


QUERIES, ORACLE = C.queries, C.sql

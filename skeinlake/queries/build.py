"""Dataset build: validation, boxes, joins, splits, samples, schedules, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import grammar as M
from ..functions import text as X
from ..functions.keys import clean_category, clean_key, clean_split, hash_bits
from ..operators import relational as R
from ..operators import sampling as P
from ..operators.components import connected_components
from ..tables import table
from .base import scored_tasks, tasks
from .catalog import Catalog
from .sqlkit import category, key, over, split, unit

C = Catalog()
_CANON = f"c AS (SELECT {key('record_id')} AS record_id, {key('patient_id')} AS patient_id, {split('split')} AS split, view, image, image_size, {category('diagnosis')} AS diagnosis, target, flags, row_id, ingested_at FROM canonical WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key('record_id')} ORDER BY ingested_at DESC, row_id DESC) = 1)"
_PAIRS = f"pe AS (SELECT {key('evidence_id')} AS evidence_id, {key('patient_id')} AS patient_id, region, {split('split')} AS split, images, diagnosis_by_view, {category('pair_diagnosis')} AS pair_diagnosis FROM paired_evidence WHERE evidence_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key('evidence_id')} ORDER BY ingested_at DESC, row_id DESC) = 1)"
_SPOTS = f"m AS (SELECT {key('metastasis_id')} AS metastasis_id, {key('patient_id')} AS patient_id, view, bbox, lower(trim(label)) AS label, assignment, list_sort(list_distinct(list_transform(list_filter(candidate_record_ids, lambda x: x IS NOT NULL), lambda x: {key('x')}))) AS candidates FROM metastases WHERE metastasis_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key('metastasis_id')} ORDER BY ingested_at DESC, row_id DESC) = 1)"
_W = "WITH "


def canonical(spark, d):
    rows = table(spark, d, "canonical").select(clean_key("record_id").alias("record_id"), clean_key("patient_id").alias("patient_id"), clean_split("split").alias("split"), "view", "image", "image_size", clean_category("diagnosis").alias("diagnosis"), "target", "flags", "row_id", "ingested_at")
    return R.last_per_key(rows, "record_id", ["ingested_at", "row_id"])


def pairs(spark, d):
    rows = table(spark, d, "paired_evidence").select(clean_key("evidence_id").alias("evidence_id"), clean_key("patient_id").alias("patient_id"), "region", clean_split("split").alias("split"), "images", "diagnosis_by_view", clean_category("pair_diagnosis").alias("pair_diagnosis"), "row_id", "ingested_at")
    return R.last_per_key(rows, "evidence_id", ["ingested_at", "row_id"])


def spots(spark, d):
    rows = table(spark, d, "metastases").select(
        clean_key("metastasis_id").alias("metastasis_id"), clean_key("patient_id").alias("patient_id"), "view", "bbox", F.lower(F.trim("label")).alias("label"), "assignment",
        F.array_sort(F.array_distinct(F.transform(F.filter("candidate_record_ids", lambda x: x.isNotNull()), clean_key))).alias("candidates"), "row_id", "ingested_at",
    )
    return R.last_per_key(rows, "metastasis_id", ["ingested_at", "row_id"])


@C.add(_W + _CANON + " SELECT record_id, patient_id, split, view, diagnosis, target.name AS name, target.bbox[1] AS x1, target.bbox[2] AS y1, target.bbox[3] AS x2, target.bbox[4] AS y2 FROM c")
def canonical_records(spark, d):
    b = F.col("target.bbox")
    return canonical(spark, d).select("record_id", "patient_id", "split", "view", "diagnosis", F.col("target.name").alias("name"), *[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


_REASONS = "list_filter([CASE WHEN flags['missing_image'] THEN 'missing_image' END, CASE WHEN flags['low_precision_region'] THEN 'low_precision_region' END, CASE WHEN flags['known_artifact'] THEN 'known_artifact' END, CASE WHEN flags['outlier'] THEN 'outlier_image' END, CASE WHEN flags['likely_corrupt_image'] THEN 'likely_corrupt_image' END, CASE WHEN target.kind = 'region' AND coalesce(diagnosis NOT IN ('normal', 'abnormal'), true) THEN 'unsupported_diagnosis' END], lambda x: x IS NOT NULL)"


# Flags a policy may exclude and the reason each gives.
EXCLUDED = {"missing_image": "missing_image", "low_precision_region": "low_precision_region", "known_artifact": "known_artifact", "outlier": "outlier_image", "likely_corrupt_image": "likely_corrupt_image"}


def reject_reasons(columns, exclude=tuple(EXCLUDED)):
    """Why a policy rejects a record: the excluded flags it has, a diagnosis regions may not have, and, where such columns are
    there, no question (``qa``) or no box template (``grounding``). ``exclude`` switches the flags."""
    flagged = [F.when(F.try_element_at("flags", F.lit(f)), F.lit(r)) for f, r in EXCLUDED.items() if f in exclude]
    odd = F.when((F.col("target.kind") == "region") & F.coalesce(~F.col("diagnosis").isin("normal", "abnormal"), F.lit(True)), F.lit("unsupported_diagnosis"))
    lists = {"qa": "no_verified_vqa_template", "grounding": "no_verified_grounding_template"}
    empty = [F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(r)) for c, r in lists.items() if c in columns]
    return F.array_compact(F.array(*flagged, odd, *empty))


@C.add(_W + _CANON + f" SELECT reason, count(*) AS n FROM (SELECT unnest({_REASONS}) AS reason FROM c) GROUP BY reason")
def policy_filter_reasons(spark, d):
    return canonical(spark, d).select(F.explode(reject_reasons(())).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@C.add(_W + _CANON + f" SELECT record_id, array_to_string({_REASONS}, ',') AS reasons, len({_REASONS}) = 0 AS accepted FROM c")
def policy_decisions(spark, d):
    r = canonical(spark, d).select("record_id", reject_reasons(()).alias("r"))
    return r.select("record_id", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("accepted"))


@C.add(f"SELECT 'task_id' AS field, {key('task_id')} AS id, count(*) AS n FROM multitask WHERE task_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'record_id', {key('record_id')}, count(*) FROM canonical WHERE record_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1")
def validate_duplicate_ids(spark, d):
    one = lambda t, k: table(spark, d, t).select(F.lit(k).alias("field"), clean_key(k).alias("id")).where("id is not null").groupBy("field", "id").agg(F.count("*").alias("n")).where("n > 1")
    return one("multitask", "task_id").unionByName(one("canonical", "record_id"))


_RULES = {
    "no_task_id": ("task_id IS NULL", lambda: F.col("task_id").isNull()),
    "no_prompt": ("coalesce(trim(prompt), '') = ''", lambda: F.coalesce(F.trim("prompt"), F.lit("")) == ""),
    "no_images": ("coalesce(len(images), 0) = 0", lambda: F.size(F.coalesce("images", F.array())) == 0),
    "no_split": ("split IS NULL", lambda: F.col("split").isNull()),
    "box_on_vqa": ("task_type = 'vqa' AND coalesce(len(targets), 0) > 0", lambda: (F.col("task_type") == "vqa") & (F.size(F.coalesce("targets", F.array())) > 0)),
    "no_box": ("task_type <> 'vqa' AND coalesce(len(targets), 0) = 0", lambda: (F.col("task_type") != "vqa") & (F.size(F.coalesce("targets", F.array())) == 0)),
    "no_label": ("task_type <> 'grounding' AND answer_label IS NULL", lambda: (F.col("task_type") != "grounding") & F.col("answer_label").isNull()),
}


@C.add("SELECT task_type, rule, count(*) AS n FROM (SELECT task_type, unnest(list_filter([" + ", ".join(f"CASE WHEN {s} THEN '{n}' END" for n, (s, _) in _RULES.items()) + "], lambda x: x IS NOT NULL)) AS rule FROM multitask) GROUP BY ALL")
def validate_rules(spark, d):
    broken = F.array_compact(F.array(*[F.when(c(), F.lit(n)) for n, (_, c) in _RULES.items()]))
    return table(spark, d, "multitask").select("task_type", F.explode(broken).alias("rule")).groupBy("task_type", "rule").agg(F.count("*").alias("n"))


_T = "b AS (SELECT row_id, x.view AS view, x.bbox AS box, i[1].image_size AS size FROM (SELECT row_id, unnest(targets) AS x, images FROM multitask) LEFT JOIN LATERAL (SELECT list_filter(images, lambda y: y.view = x.view) AS i) ON true)"


@C.add(_W + _T + " SELECT view, count(*) AS boxes, sum((box IS NULL)::INT)::BIGINT AS missing, sum((NOT ok)::INT)::BIGINT AS invalid, sum((ok AND (box[3] > size[1] OR box[4] > size[2]))::INT)::BIGINT AS out_of_bounds FROM (SELECT *, coalesce(len(box) = 4 AND box[1] >= 0 AND box[2] >= 0 AND box[1] < box[3] AND box[2] < box[4], false) AS ok FROM b) GROUP BY view")
def box_bounds_invalid(spark, d):
    m = table(spark, d, "multitask").select("images", F.explode("targets").alias("t"))
    b = m.select(F.col("t.view").alias("view"), F.col("t.bbox").alias("box"), F.get(F.filter("images", lambda y: y["view"] == F.col("t.view")), F.lit(0))["image_size"].alias("size"))
    ok = F.coalesce(G.is_box(F.col("box")), F.lit(False))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return b.groupBy("view").agg(F.count("*").alias("boxes"), one(F.col("box").isNull()).alias("missing"), one(~ok).alias("invalid"), F.sum((ok & ~G.in_image(F.col("box"), F.col("size"))).cast("long")).alias("out_of_bounds"))


@C.add("SELECT l_orderkey, l_linenumber, (l_partkey % 200)::DOUBLE AS x1, (l_suppkey % 90)::DOUBLE AS y1, (l_partkey % 200 + 8 + 4 * l_linenumber)::DOUBLE AS x2, (l_suppkey % 90 + l_quantity)::DOUBLE AS y2 FROM lineitem")
def box_coerce_xywh(spark, d):
    li = table(spark, d, "lineitem")
    box = G.coerce_box({"x": F.col("l_partkey") % 200, "y": F.col("l_suppkey") % 90, "width": 8 + 4 * F.col("l_linenumber"), "height": F.col("l_quantity")}, "xywh")
    return li.select("l_orderkey", "l_linenumber", *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


_LB = "bx AS (SELECT l_orderkey, l_linenumber, (l_partkey % 200)::DOUBLE AS x, (l_suppkey % 90)::DOUBLE AS y, (8 + 4 * l_linenumber)::DOUBLE AS w, l_quantity AS h, floor(100 * l_discount) AS s FROM lineitem)"


def _line_boxes(spark, d):
    x, y, w, h, s = F.col("l_partkey") % 200, F.col("l_suppkey") % 90, 8 + 4 * F.col("l_linenumber"), F.col("l_quantity"), F.floor(100 * F.col("l_discount"))
    dbl = lambda *c: F.array(*[v.cast("double") for v in c])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dbl(x, y, x + w, y + h).alias("a"), dbl(x + s, y + s, x + s + w, y + s + h).alias("b"))


@C.add(_W + _LB + " SELECT l_linenumber, count(*) AS n, sum((s < w AND s < h AND (w - s) * (h - s) / (2 * w * h - (w - s) * (h - s)) >= 0.5)::INT)::BIGINT AS hits, round(avg(CASE WHEN s < w AND s < h THEN (w - s) * (h - s) / (2 * w * h - (w - s) * (h - s)) ELSE 0 END), 4) AS mean_iou, sum((w / 2 >= s AND h / 2 >= s)::INT)::BIGINT AS centre_inside, round(avg(sqrt(2 * s * s)), 4) AS mean_distance FROM bx GROUP BY l_linenumber")
def localisation_by_level(spark, d):
    i, a, b = G.iou(F.col("a"), F.col("b")), F.col("a"), F.col("b")
    per = _line_boxes(spark, d).select("l_linenumber", i.alias("i"), G.centre_inside(b, a).alias("c"), G.centre_distance(a, b).alias("dist"))
    return per.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum((F.col("i") >= 0.5).cast("long")).alias("hits"), F.round(F.avg("i"), 4).alias("mean_iou"), F.sum(F.col("c").cast("long")).alias("centre_inside"), F.round(F.avg("dist"), 4).alias("mean_distance"))


_SPOT = "CASE WHEN w <= 256 AND h <= 100 AND NOT ({0} < x + w AND x < {0} + w AND {1} < y + h AND y < {1} + h) THEN {2} END"
_SPOTS6 = ", ".join(_SPOT.format(x, y, i) for i, (x, y) in enumerate((("0", "0"), ("(256 - w)", "0"), ("0", "(100 - h)"), ("(256 - w)", "(100 - h)"), ("floor((256 - w) / 2)", "0"), ("floor((256 - w) / 2)", "(100 - h)"))))


@C.add(_W + _LB + f" SELECT l_orderkey, l_linenumber, CASE s6 WHEN 0 THEN 0 WHEN 1 THEN 256 - w WHEN 2 THEN 0 WHEN 3 THEN 256 - w WHEN 4 THEN floor((256 - w) / 2) WHEN 5 THEN floor((256 - w) / 2) END::DOUBLE AS x1, CASE WHEN s6 IN (0, 1, 4) THEN 0 WHEN s6 IS NOT NULL THEN 100 - h END::DOUBLE AS y1 FROM (SELECT *, coalesce({_SPOTS6}) AS s6 FROM bx)")
def control_boxes(spark, d):
    """Where a control box of equal size goes: the first free corner or middle of the image."""
    rows = _line_boxes(spark, d).withColumn("c", G.control_box(F.col("a"), F.array(F.lit(256), F.lit(100))))
    return rows.select("l_orderkey", "l_linenumber", F.get("c", F.lit(0)).alias("x1"), F.get("c", F.lit(1)).alias("y1"))


@C.add(over("tasks") + "SELECT CASE WHEN f = 'what' THEN 'what' WHEN f IN ('where', 'locate', 'find', 'mark', 'identify', 'indicate', 'point', 'select', 'give', 'box') THEN 'where' WHEN f IN ('does', 'do') THEN 'does' WHEN f IN ('is', 'are', 'can', 'has', 'have') THEN 'is' ELSE 'other' END AS form, count(*) AS n FROM (SELECT regexp_split_to_array(trim(lower(prompt)), '\\s+')[1] AS f FROM t) GROUP BY 1")
def question_forms(spark, d):
    return tasks(spark, d).groupBy(X.question_form(F.col("prompt")).alias("form")).agg(F.count("*").alias("n"))


@C.add(_W + _CANON + ",\n" + _SPOTS + """ SELECT metastasis_id, coalesce(array_to_string(list_sort(list(record_id)), ','), '') AS candidates, CASE count(record_id) WHEN 0 THEN 'unassigned' WHEN 1 THEN 'unique_region' ELSE 'ambiguous_regions' END AS assignment
  FROM (SELECT metastasis_id, record_id FROM m LEFT JOIN c ON m.patient_id = c.patient_id AND m.view = c.view AND c.target.bbox[1] <= m.bbox[1] AND c.target.bbox[2] <= m.bbox[2] AND c.target.bbox[3] >= m.bbox[3] AND c.target.bbox[4] >= m.bbox[4]) GROUP BY metastasis_id""")
def containment_join_assignment(spark, d):
    s = spots(spark, d).select("metastasis_id", "patient_id", "view", "bbox")
    r = canonical(spark, d).select("patient_id", "view", "record_id", F.col("target.bbox").alias("region_box"))
    out = R.assign_containers(s, r, ["patient_id", "view"], "metastasis_id", "record_id")
    return out.select("metastasis_id", F.array_join("candidates", ",").alias("candidates"), "assignment")


_VIEWS = f"v AS (SELECT patient_id, regexp_replace(record_id, ':(ant|post)$', '') AS visit_region, view, diagnosis, target.bbox AS bbox FROM c WHERE patient_id IS NOT NULL), pv AS (SELECT patient_id, visit_region, max(diagnosis) FILTER (view = 'ANT') AS ant, max(diagnosis) FILTER (view = 'POST') AS post FROM v GROUP BY ALL HAVING count(*) FILTER (view = 'ANT') = 1 AND count(*) FILTER (view = 'POST') = 1)"


def _paired_views(spark, d):
    rows = canonical(spark, d).withColumn("visit_region", F.regexp_replace("record_id", ":(ant|post)$", ""))
    return R.pair_views(rows, ["patient_id", "visit_region"], "view", ["diagnosis", "record_id"])


@C.add(_W + _CANON + ",\n" + _VIEWS + " SELECT * FROM pv")
def pair_pivot_views(spark, d):
    return _paired_views(spark, d).select("patient_id", "visit_region", F.col("ANT.diagnosis").alias("ant"), F.col("POST.diagnosis").alias("post"))


@C.add(_W + _CANON + ",\n" + _VIEWS + " SELECT coalesce(ant, 'none') AS ant, coalesce(post, 'none') AS post, count(*) AS n FROM pv WHERE ant IS DISTINCT FROM post GROUP BY ALL")
def pair_disagreements(spark, d):
    p = pair_pivot_views(spark, d).where(~F.col("ant").eqNullSafe(F.col("post")))
    return p.groupBy(F.coalesce("ant", F.lit("none")).alias("ant"), F.coalesce("post", F.lit("none")).alias("post")).agg(F.count("*").alias("n"))


@C.add(_W + ",\n".join((_CANON, _PAIRS, _SPOTS)) + """, mc AS (SELECT metastasis_id, unnest(CASE WHEN coalesce(len(candidates), 0) = 0 THEN [NULL] ELSE candidates END) AS cand FROM m), x AS (SELECT m.metastasis_id, CASE WHEN cand IS NULL THEN 'no_candidate' WHEN c.record_id IS NULL THEN 'no_record' WHEN e.evidence_id IS NULL THEN 'no_pair' END AS reason
  FROM mc m LEFT JOIN c ON cand = c.record_id LEFT JOIN pe e ON e.evidence_id = replace(regexp_replace(c.record_id, ':(ant|post)$', ''), ':region:', ':pair:')) SELECT coalesce(reason, 'found') AS reason, count(*) AS n FROM x GROUP BY ALL""")
def lookup_reason_chain(spark, d):
    s = spots(spark, d).select("metastasis_id", F.explode_outer("candidates").alias("first"))
    rec = canonical(spark, d).select("record_id", F.replace(F.regexp_replace("record_id", ":(ant|post)$", ""), F.lit(":region:"), F.lit(":pair:")).alias("pair_id"))
    out = R.lookup_chain(s, [("record", rec, "first", "record_id"), ("pair", pairs(spark, d).select("evidence_id"), "pair_id", "evidence_id")])
    return out.groupBy(F.when(F.col("first").isNull(), "no_candidate").otherwise(F.coalesce("reason", F.lit("found"))).alias("reason")).agg(F.count("*").alias("n"))


@C.add(_W + ",\n".join((_CANON, _SPOTS)) + """, up AS (SELECT DISTINCT candidates[1] AS record_id FROM m WHERE assignment = 'unique_region' AND len(candidates) = 1 AND label IN ('abnormal', 'malignant')),
  h AS (SELECT c.record_id, patient_id, view, coalesce(diagnosis = 'abnormal', false) AS raw, coalesce(diagnosis = 'abnormal', false) OR up.record_id IS NOT NULL AS effective FROM c LEFT JOIN up USING (record_id))
  SELECT patient_id, view, count(*) AS regions, bool_or(raw) AS group_raw, bool_or(effective) AS group_effective, sum((raw <> effective)::INT)::BIGINT AS conflicts FROM h WHERE patient_id IS NOT NULL AND view IS NOT NULL GROUP BY ALL""")
def hierarchy_rollup_conflict(spark, d):
    out = R.hierarchy(canonical(spark, d), spots(spark, d), "record_id", ["patient_id", "view"], F.col("diagnosis") == "abnormal", F.col("label").isin("abnormal", "malignant"))
    return out.groupBy("patient_id", "view").agg(F.count("*").alias("regions"), F.first("group_raw").alias("group_raw"), F.first("group_effective").alias("group_effective"), F.first("conflicts").alias("conflicts"))


@C.add(over("tasks", _PAIRS) + "SELECT t.task_id, CASE WHEN pe.evidence_id IS NULL THEN 'missing' END AS issue FROM t LEFT JOIN pe USING (evidence_id) WHERE t.evidence_id IS NOT NULL AND pe.evidence_id IS NULL")
def anti_missing_refs(spark, d):
    t = tasks(spark, d).where("evidence_id is not null")
    return t.join(pairs(spark, d).select("evidence_id"), "evidence_id", "left_anti").select("task_id", F.lit("missing").alias("issue"))


@C.add(over("tasks", _PAIRS) + f"SELECT evidence_id, patient_id, region FROM pe WHERE evidence_id IN (SELECT evidence_id FROM t WHERE evidence_id IS NOT NULL AND {unit('core', 'task_id')} % 20 = 0)")
def semi_core_closure(spark, d):
    picked = tasks(spark, d).where(F.pmod(hash_bits("core", "task_id", digits=8), F.lit(20)) == 0).select("evidence_id")
    return pairs(spark, d).join(picked, "evidence_id", "left_semi").select("evidence_id", "patient_id", "region")


@C.add(f"SELECT DISTINCT {key('patient_id')} AS patient_id FROM multitask WHERE patient_id IS NOT NULL INTERSECT SELECT {key('patient_id')} FROM patient_splits WHERE patient_id IS NOT NULL")
def intersect_ids(spark, d):
    ids = lambda t: table(spark, d, t).select(clean_key("patient_id").alias("patient_id")).where("patient_id is not null")
    return ids("multitask").intersect(ids("patient_splits"))


@C.add(over("scored", f"g AS (SELECT task_id FROM s WHERE {unit('cov', 'task_id')} % 50 <> 0 UNION ALL SELECT 'extra:' || task_id FROM s WHERE {unit('cov', 'task_id')} % 50 = 1 UNION ALL SELECT task_id FROM s WHERE {unit('cov', 'task_id')} % 50 = 2)") + "SELECT task_id, CASE WHEN ng = 0 THEN 'missing' WHEN ne = 0 THEN 'unexpected' ELSE 'repeated' END AS issue FROM (SELECT task_id, sum(e) AS ne, sum(g) AS ng FROM (SELECT task_id, 1 AS e, 0 AS g FROM s UNION ALL SELECT task_id, 0, 1 FROM g) GROUP BY task_id) WHERE ne <> 1 OR ng <> 1")
def expected_prediction_coverage(spark, d):
    s = scored_tasks(spark, d).select("task_id", F.pmod(hash_bits("cov", "task_id", digits=8), F.lit(50)).alias("u"))
    ids = s.select("task_id")
    given = s.where("u <> 0").select("task_id").unionByName(s.where("u = 1").select(F.concat(F.lit("extra:"), "task_id").alias("task_id"))).unionByName(s.where("u = 2").select("task_id"))
    return R.coverage(ids, given, "task_id").select("task_id", "issue")


@C.add(f"WITH a AS (SELECT doc_id, text, lang, n_chars FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN upper(text) ELSE text END AS text, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 13 <> 0), f AS (SELECT a.text AS ta, b.text AS tb, a.lang AS al, b.lang AS bl, a.n_chars AS an, b.n_chars AS bn, b.doc_id AS bid FROM a LEFT JOIN b USING (doc_id))"
  " SELECT 'text' AS field, sum((bid IS NOT NULL AND ta IS DISTINCT FROM tb)::INT)::BIGINT AS n_different FROM f UNION ALL SELECT 'lang', sum((bid IS NOT NULL AND al IS DISTINCT FROM bl)::INT)::BIGINT FROM f UNION ALL SELECT 'n_chars', sum((bid IS NOT NULL AND an IS DISTINCT FROM bn)::INT)::BIGINT FROM f UNION ALL SELECT 'only_first', sum((bid IS NULL)::INT)::BIGINT FROM f UNION ALL SELECT 'only_second', 0")
def manifest_parity_fields(spark, d):
    a = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    b = a.where("doc_id % 13 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.upper("text")).otherwise(F.col("text"))).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("lang")))
    return R.parity(a, b, "doc_id", ["text", "lang", "n_chars"])


@C.add("SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS nation, coalesce(r_name, 'UNKNOWN') AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_join_default(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 5 <> 0")
    out = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("UNKNOWN")).alias("nation"), F.coalesce("r_name", F.lit("UNKNOWN")).alias("region"))


@C.add(over("tasks") + """, pos AS (SELECT task_id, patient_id, label FROM t WHERE answer_label IN ('yes', 'abnormal') AND patient_id IS NOT NULL), neg AS (SELECT task_id, patient_id, label FROM t WHERE coalesce(answer_label NOT IN ('yes', 'abnormal'), true) AND label IS NOT NULL AND patient_id IS NOT NULL)
  SELECT pos.task_id, pos.patient_id, pos.label, min(neg.task_id) AS alternate FROM pos LEFT JOIN neg ON pos.patient_id = neg.patient_id AND pos.label <> neg.label GROUP BY ALL""".replace("\n  SELECT", "\nSELECT"))
def alternate_negative_pick(spark, d):
    t = tasks(spark, d).where("patient_id is not null")
    out = R.pick_alternate(t, "patient_id", F.coalesce(F.col("answer_label").isin("yes", "abnormal"), F.lit(False)), "task_id", "label")
    return out.select("task_id", "patient_id", "label", "alternate")


_COMP = f"""ids AS (SELECT DISTINCT {key("patient_id")} AS p FROM canonical WHERE patient_id IS NOT NULL), l AS (SELECT DISTINCT {key("patient_id")} AS p, {key("duplicate_of_patient_id")} AS q FROM canonical WHERE {key("duplicate_of_patient_id")} IN (FROM ids) AND patient_id IS NOT NULL),
  ed AS (SELECT p, q FROM l UNION SELECT q, p FROM l), re AS (SELECT p, p AS q FROM ids UNION SELECT re.p, ed.q FROM re JOIN ed ON re.q = ed.p), comp AS (SELECT p AS patient_id, min(q) AS component FROM re GROUP BY p)"""


def _components(spark, d):
    c = table(spark, d, "canonical").select(clean_key("patient_id").alias("patient_id"), clean_key("duplicate_of_patient_id").alias("other"))
    return P.cluster_components(c, "patient_id", c, "patient_id", "other")


@C.add("WITH RECURSIVE " + _COMP + " SELECT * FROM comp")
def duplicate_components(spark, d):
    return _components(spark, d)


@C.add("WITH RECURSIVE " + _COMP + ", g AS (SELECT component, count(*) AS n FROM comp GROUP BY 1), o AS (SELECT *, sum(n) OVER (ORDER BY sha256('17:' || component), component) - n AS before, sum(n) OVER () AS total FROM g) SELECT component, n, CASE WHEN before < total * 0.8::DOUBLE THEN 'train' WHEN before < total * 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split FROM o")
def hash_split_80_10_10(spark, d):
    g = _components(spark, d).groupBy("component").agg(F.count("*").alias("n"))
    return P.cut_by_running_count(g, "component", "n", "17").select("component", "n", "split")


_ST = "st AS (SELECT task_id, coalesce(split, 'missing') || '|' || coalesce(region_level, 'missing') || '|' || coalesce(interaction_type, 'missing') || '|' || coalesce(answer_label, 'missing') AS stratum, list_transform(images, lambda x: x.image) AS covers, ('0x' || substr(sha256('r3:' || task_id), 1, 15))::BIGINT AS h FROM t)"


def _strata(spark, d):
    s = F.concat_ws("|", *[F.coalesce(c, F.lit("missing")) for c in ("split", "region_level", "interaction_type", "answer_label")])
    return tasks(spark, d).select("task_id", s.alias("stratum"), F.col("images.image").alias("cover"))


_Q = "q0 AS (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS total, ceil(sum(count(*)) OVER () * 0.3)::BIGINT AS target FROM st GROUP BY stratum), q1 AS (SELECT *, n * target // total AS f, n * target % total AS rem FROM q0), quota AS (SELECT stratum, n, f + (row_number() OVER (ORDER BY rem DESC, stratum) <= target - sum(f) OVER ())::INT AS quota, target FROM q1)"


@C.add(over("tasks", _ST, _Q) + "SELECT stratum, n, quota::BIGINT AS quota FROM quota")
def largest_remainder_quota(spark, d):
    counts = _strata(spark, d).groupBy("stratum").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return P.largest_remainder(counts, "stratum", "n", P.target_of(total, 0.3))


@C.add(over("tasks", _ST, _Q) + """, forced AS (SELECT DISTINCT arg_min(task_id, (h, task_id)) AS task_id FROM (SELECT task_id, h, unnest(covers) AS cover FROM st) WHERE cover IS NOT NULL GROUP BY cover), fr AS (SELECT st.* FROM st WHERE task_id NOT IN (FROM forced)),
  had AS (SELECT stratum, count(*) AS had FROM st WHERE task_id IN (FROM forced) GROUP BY 1), prop AS (SELECT fr.*, row_number() OVER (PARTITION BY fr.stratum ORDER BY h, task_id) AS r FROM fr),
  kept AS (SELECT task_id, h FROM prop JOIN quota USING (stratum) LEFT JOIN had USING (stratum) WHERE r <= quota - coalesce(had, 0) ORDER BY h, task_id LIMIT (SELECT max(target) FROM quota) - (SELECT count(*) FROM forced)),
  more AS (SELECT task_id FROM fr WHERE task_id NOT IN (SELECT task_id FROM kept) ORDER BY h, task_id LIMIT (SELECT max(target) FROM quota) - (SELECT count(*) FROM forced) - (SELECT count(*) FROM kept))
SELECT task_id, 'forced' AS stage FROM forced UNION ALL SELECT task_id, 'quota' FROM kept UNION ALL SELECT task_id, 'extra' FROM more""")
def stratified_sample_with_coverage(spark, d):
    from ..session import Workspace

    rows = Workspace(spark, "strata").save(_strata(spark, d), "rows")
    return P.stratified_with_coverage(rows, "task_id", "stratum", "cover", P.target_of(rows.count(), 0.3), "r3").select("task_id", "stage")


@C.add(over("tasks") + "SELECT task_id, label FROM (SELECT task_id, label, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(sha256('control:' || task_id), 1, 15))::BIGINT, task_id) AS r FROM t) WHERE r <= 3")
def hash_topk_controls(spark, d):
    return P.top_k_by_hash(tasks(spark, d).select("task_id", "label"), ["label"], "task_id", 3, "control")


@C.add(over("tasks") + "SELECT task_id, row_number() OVER (ORDER BY r, bucket) AS position FROM (SELECT task_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY task_id) AS r FROM (SELECT task_id, coalesce(region_level, '') || '|' || coalesce(interaction_type, '') AS bucket FROM t))")
def round_robin_interleave(spark, d):
    rows = tasks(spark, d).select("task_id", F.concat_ws("|", F.coalesce("region_level", F.lit("")), F.coalesce("interaction_type", F.lit(""))).alias("bucket"))
    return P.interleave(rows, "bucket", ["task_id"]).select("task_id", "position")


@C.add(over("tasks") + "SELECT task_id, region_level, answer_label, cnt < 25 AS short FROM (SELECT *, row_number() OVER (PARTITION BY region_level, answer_label ORDER BY ('0x' || substr(sha256('probe:' || task_id), 1, 15))::BIGINT, task_id) AS r, count(*) OVER (PARTITION BY region_level, answer_label) AS cnt FROM t WHERE region_level IS NOT NULL AND answer_label IS NOT NULL) WHERE r <= 25")
def balanced_probe(spark, d):
    rows = tasks(spark, d).where("region_level is not null and answer_label is not null").select("task_id", "region_level", "answer_label")
    return P.balanced_probe(rows, ["region_level", "answer_label"], "task_id", 25, "probe").select("task_id", "region_level", "answer_label", "short")


@C.add(over("scored") + """, b AS (SELECT task_id, task_type, answer_label IN ('yes', 'abnormal') AS pos, ('0x' || substr(sha256('epoch:' || task_id), 1, 15))::BIGINT AS h FROM s WHERE task_type <> 'grounding'),
  z AS (SELECT *, count(*) OVER w AS n, sum(pos::INT) OVER w AS np, row_number() OVER (PARTITION BY task_type, pos ORDER BY h, task_id) AS r FROM b WINDOW w AS (PARTITION BY task_type)),
  y AS (SELECT *, CASE WHEN pos THEN (n // 2) // np + (r <= (n // 2) % np)::INT ELSE (r <= n - n // 2)::INT END AS times FROM z)
SELECT task_id, task_type, unnest(range(1, times::BIGINT + 1))::BIGINT AS draw FROM y WHERE times > 0""")
def class_balanced_epoch(spark, d):
    rows = scored_tasks(spark, d).where("task_type <> 'grounding'").select("task_id", "task_type", "answer_label")
    return P.class_balanced_epoch(rows, "task_type", "task_id", F.col("answer_label").isin("yes", "abnormal"), "epoch").select("task_id", "task_type", "draw")


@C.add(over("tasks") + "SELECT task_id, row_number() OVER (ORDER BY sha256('8:' || task_id), task_id) AS position FROM t")
def epoch_shuffle(spark, d):
    return P.epoch_order(tasks(spark, d).select("task_id"), "task_id", 7, 2)


@C.add("SELECT doc_id FROM documents ORDER BY ('0x' || substr(sha256('reservoir:' || doc_id), 1, 15))::BIGINT, doc_id LIMIT 100")
def hash_reservoir(spark, d):
    return P.reservoir(table(spark, d, "documents").select("doc_id"), "doc_id", 100, "reservoir")


_TAG = "CASE WHEN {0} = 'POST' THEN 'PST' ELSE {0} END"
_TAGS = f"array_to_string(list_transform(targets, lambda x: '<' || {_TAG.format('x.view')} || '><BBX>' || array_to_string(x.bbox, ',') || '</BBX></' || {_TAG.format('x.view')} || '>'), '')"


@C.add(over("scored") + f"SELECT task_id, '<REG>' || replace(label, ' ', '_') || '</REG><CLS>' || answer_label || '</CLS>' || {_TAGS} AS target FROM s WHERE task_type = 'grounded_vqa'")
def tag_grammar_build(spark, d):
    return scored_tasks(spark, d).where("task_type = 'grounded_vqa'").select("task_id", M.grounded_tags(F.col("label"), F.col("answer_label"), F.col("targets")).alias("target"))


@C.add(over("scored") + f"SELECT task_id, replace(label, ' ', '_') AS region, answer_label, len(targets) AS n_boxes, list_sum(list_transform(targets, lambda x: x.bbox[1] + 2 * x.bbox[2] + 3 * x.bbox[3] + 5 * x.bbox[4]))::DOUBLE AS checksum FROM s WHERE task_type = 'grounded_vqa'")
def tag_grammar_parse(spark, d):
    """Round trip: the tags built from a task give back its region, class and boxes."""
    s = scored_tasks(spark, d).where("task_type = 'grounded_vqa'")
    p = s.select("task_id", M.parse_tags(M.grounded_tags(F.col("label"), F.col("answer_label"), F.col("targets"))).alias("p"))
    weigh = F.aggregate("p.boxes", F.lit(0.0), lambda a, b: a + b["bbox"][0] + 2 * b["bbox"][1] + 3 * b["bbox"][2] + 5 * b["bbox"][3])
    return p.select("task_id", "p.region", "p.answer_label", F.size("p.boxes").cast("long").alias("n_boxes"), weigh.alias("checksum"))


@C.add(over("scored") + "SELECT CASE WHEN h < 10 THEN 'tag_order' WHEN h < 20 THEN 'bad_box_block' ELSE '' END AS issues, count(*) AS n FROM s WHERE task_type = 'grounded_vqa' GROUP BY 1")
def tag_contract_issues(spark, d):
    """Strict tag contract over good outputs and made breaches of it."""
    s = scored_tasks(spark, d).where("task_type = 'grounded_vqa'")
    good = F.concat("answer", F.lit(" "), M.grounded_tags(F.col("label"), F.col("answer_label"), F.col("targets")))
    text = F.when(F.col("h") < 10, F.replace(good, F.lit("</CLS>"), F.lit(""))).when(F.col("h") < 20, F.concat(good, F.lit("<ANT>"))).otherwise(good)
    return s.select("task_id", F.array_join(M.tag_issues(text), ",").alias("issues")).groupBy("issues").agg(F.count("*").alias("n"))


@C.add(over("scored") + """SELECT task_id, CASE task_type WHEN 'vqa' THEN to_json({'task': task_type, 'answer': answer, 'class': answer_label})::VARCHAR WHEN 'grounding' THEN to_json({'task': task_type, 'region': replace(label, ' ', '_'), 'boxes': bx})::VARCHAR
  ELSE to_json({'task': task_type, 'answer': answer, 'region': replace(label, ' ', '_'), 'class': answer_label, 'boxes': bx})::VARCHAR END AS target FROM (SELECT *, list_transform(targets, lambda x: {'view': CASE WHEN x.view = 'POST' THEN 'PST' ELSE x.view END, 'bbox': x.bbox}) AS bx FROM s)""")
def json_emit(spark, d):
    return scored_tasks(spark, d).select("task_id", M.json_output(F.col("task_type"), F.col("answer"), F.col("label"), F.col("answer_label"), F.col("targets")).alias("target"))


@C.add(over("tasks") + "SELECT task_id, CASE WHEN task_type = 'vqa' THEN 'Answer the question about the ' || coalesce(view_scope, 'BOTH') || ' view: ' WHEN task_type = 'grounding' THEN 'Return boxes for ' || len(images) || ' image(s): ' ELSE 'Answer and return boxes for ' || len(images) || ' image(s): ' END || prompt AS message FROM t WHERE prompt IS NOT NULL AND images IS NOT NULL")
def prompt_messages(spark, d):
    n = F.size("images").cast("string")
    head = F.when(F.col("task_type") == "vqa", F.concat(F.lit("Answer the question about the "), F.coalesce("view_scope", F.lit("BOTH")), F.lit(" view: "))).when(F.col("task_type") == "grounding", F.concat(F.lit("Return boxes for "), n, F.lit(" image(s): "))).otherwise(F.concat(F.lit("Answer and return boxes for "), n, F.lit(" image(s): ")))
    return tasks(spark, d).where("prompt is not null and images is not null").select("task_id", F.concat(head, "prompt").alias("message"))


@C.add(over("tasks") + "SELECT task_id, v.variant, CASE v.variant WHEN 'one_view' THEN len(list_filter(images, lambda x: x.view = 'ANT')) ELSE len(images) END AS n_images, CASE v.variant WHEN 'blank' THEN 'blank.png' ELSE images[1].image END AS first_image FROM t, (SELECT unnest(['full', 'one_view', 'blank']) AS variant) v WHERE split = 'val' AND images IS NOT NULL")
def variant_cross_product(spark, d):
    t = tasks(spark, d).where("split = 'val' and images is not null")
    out = t.select("task_id", "images", F.explode(F.array(*map(F.lit, ("full", "one_view", "blank")))).alias("variant"))
    n = F.when(F.col("variant") == "one_view", F.size(F.filter("images", lambda x: x["view"] == "ANT"))).otherwise(F.size("images"))
    return out.select("task_id", "variant", n.cast("long").alias("n_images"), F.when(F.col("variant") == "blank", "blank.png").otherwise(F.get("images", F.lit(0))["image"]).alias("first_image"))


_SLOT = "regexp_replace(replace(lower(answer), lower(coalesce(label, '')), '<region>'), '[0-9]+', '<n>', 'g')"


@C.add(over("tasks") + f", a AS (SELECT task_type, region_level, answer_label, {_SLOT} AS form, count(*) AS n FROM t WHERE answer IS NOT NULL AND answer_label IS NOT NULL AND label IS NOT NULL AND region_level IS NOT NULL GROUP BY ALL) SELECT task_type, region_level, answer_label, form, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY task_type, region_level, answer_label), 6) AS share FROM a QUALIFY row_number() OVER (PARTITION BY task_type, region_level, answer_label ORDER BY n DESC, form) <= 5")
def candidate_bank_topk(spark, d):
    from pyspark.sql import Window

    form = F.regexp_replace(F.replace(F.lower("answer"), F.lower("label"), F.lit("<region>")), "[0-9]+", "<n>")
    keys = ["task_type", "region_level", "answer_label"]
    a = tasks(spark, d).where("answer is not null and answer_label is not null and label is not null and region_level is not null").groupBy(*keys, form.alias("form")).agg(F.count("*").alias("n"))
    all_ = a.groupBy(*keys).agg(F.sum("n").alias("_all"))  # few classes
    top = a.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "form"))).where("r <= 5").drop("r")  # k rows a task before the shuffle
    return top.join(all_, keys).withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")


@C.add(over("tasks") + f"SELECT task_id, ({unit('variant', 'task_id', 16).replace('::BIGINT', '')} % 7)::INT AS variant FROM t".replace("('0x' || substr(sha256('variant:' || task_id), 1, 16))::UBIGINT", "('0x' || substr(sha256('variant:' || task_id), 1, 16))::UBIGINT"))
def template_variant_choice(spark, d):
    return tasks(spark, d).select("task_id", X.pick_variant(F.concat(F.lit("variant:"), "task_id"), 7).alias("variant"))


@C.add("SELECT event_id, user_id, next_type FROM (SELECT event_id, user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events) WHERE event_type = 'view' AND next_type = 'click'")
def next_turn_pairs(spark, d):
    from pyspark.sql import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("next_type", nxt).where("event_type = 'view' and next_type = 'click'").select("event_id", "user_id", "next_type")


@C.add("SELECT image, count(*) AS rows, count(DISTINCT task_key) AS tasks, string_agg(DISTINCT x.view, ',' ORDER BY x.view) AS views FROM (SELECT task_id AS task_key, unnest(images) AS x FROM multitask), LATERAL (SELECT x.image AS image) WHERE image IS NOT NULL GROUP BY image")
def image_instances(spark, d):
    rows = table(spark, d, "multitask").select("task_id", F.explode("images").alias("x")).where("x.image is not null")
    return rows.groupBy(F.col("x.image").alias("image")).agg(F.count("*").alias("rows"), F.count_distinct("task_id").alias("tasks"), F.nullif(F.array_join(F.array_sort(F.collect_set("x.view")), ","), F.lit("")).alias("views"))


@C.add(over("tasks") + "SELECT image, arg_min(task_id, (('0x' || substr(sha256('meta:' || task_id), 1, 15))::BIGINT, task_id)) AS task_id FROM (SELECT task_id, unnest(images).image AS image FROM t) WHERE image IS NOT NULL GROUP BY image")
def metadata_question_seed(spark, d):
    rows = tasks(spark, d).select("task_id", F.explode("images.image").alias("image")).where("image is not null")
    return rows.groupBy("image").agg(F.min_by("task_id", F.struct(hash_bits("meta", "task_id"), "task_id")).alias("task_id"))


@C.add(over("scored") + r"""SELECT task_id, regexp_replace(regexp_replace(label, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name, regexp_replace(regexp_extract(patient_id, '(\d+)$', 1), '^0+(.)', '\1') AS number, trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')) = answer_label OR trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS plain,
  'See ' || label || ' (' || view_scope || ').' AS sentence, len(regexp_extract_all(lower(prompt), '[a-z]+')) AS words, '{"task":"vqa","answer":' || to_json(answer) || ',"class":"' || answer_label AS upto FROM s WHERE task_type = 'vqa' AND view_scope IS NOT NULL AND prompt IS NOT NULL""")
def spelled_forms(spark, d):
    """File names, plain numbers, any-of matches, filled templates, word counts and class prefixes of scored questions."""
    from ..sources.tabular import zero_stripped_id

    s = scored_tasks(spark, d).where("task_type = 'vqa' and view_scope is not null and prompt is not null")
    out = M.json_output(F.col("task_type"), F.col("answer"), F.col("label"), F.col("answer_label"), F.col("targets"))
    return s.select(
        "task_id", X.slug(F.col("label")).alias("name"), zero_stripped_id(F.col("patient_id")).alias("number"), X.matches_any(F.col("answer"), F.array("answer_label", "label")).alias("plain"),
        X.fill_template(F.lit("See {region} ({view})."), {"region": F.col("label"), "view": F.col("view_scope")}).alias("sentence"), F.size(X.letter_tokens(F.col("prompt"))).cast("bigint").alias("words"), M.json_prefix(out, F.col("answer_label")).alias("upto"),
    )


QUERIES, ORACLE = C.queries, C.sql

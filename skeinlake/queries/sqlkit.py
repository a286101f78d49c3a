"""SQL fragments (DuckDB) that restate the key, category and task rules for the oracles."""

from __future__ import annotations


def key(col: str) -> str:
    return f"lower(trim({col}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"


def category(col: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(lower({col}), '^\s+|\s*\.?\s*$', '', 'g'), '[\s_-]+', '_', 'g'), '')"


def split(col: str) -> str:
    return f"(CASE WHEN {category(col)} = 'valid' THEN 'val' ELSE {category(col)} END)"


def unit(seed: str, col: str, digits: int = 8) -> str:
    """Leading hex digits of sha256('seed:col') as an integer."""
    return f"('0x' || substr(sha256('{seed}:' || {col}), 1, {digits}))::UBIGINT::BIGINT"


TASKS = f"""t AS (SELECT {key("task_id")} AS task_id, {key("evidence_id")} AS evidence_id, {key("patient_id")} AS patient_id, {split("split")} AS split, task_type, {category("region_level")} AS region_level,
  {category("interaction_type")} AS interaction_type, label, view_scope, prompt, answer, {category("answer_label")} AS answer_label, images, targets, batch::BIGINT AS batch, row_id
  FROM multitask WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key("task_id")} ORDER BY ingested_at DESC, row_id DESC) = 1)"""

_BOX_OK = "x.view IN ('ANT', 'POST') AND len(x.bbox) = 4 AND x.bbox[1] >= 0 AND x.bbox[2] >= 0 AND x.bbox[1] < x.bbox[3] AND x.bbox[2] < x.bbox[4] AND x.bbox[3] <= 256 AND x.bbox[4] <= 1000"
_IMG_OK = "x.view IN ('ANT', 'POST') AND len(x.image_size) = 2 AND x.image_size[1] >= 256 AND x.image_size[2] >= 1000"
_ALL = "coalesce(len({0}), 0) > 0 AND len(list_filter({0}, lambda x: coalesce({1}, false))) = len({0})"
#: Tasks whose truth is sound enough to be scored, with h in 0..99 that says what their made prediction gets wrong.
SCORED = f"""s AS (SELECT *, {unit("pred", "task_id")} % 100 AS h, CASE WHEN task_type = 'vqa' THEN [] ELSE targets END AS boxes FROM t WHERE label IS NOT NULL AND patient_id IS NOT NULL AND answer_label IS DISTINCT FROM 'uncertain' AND
  {_ALL.format("images", _IMG_OK)} AND (
  (task_type = 'vqa' AND answer_label IN ('yes', 'no') AND trim(answer) <> '') OR
  (task_type IN ('grounding', 'grounded_vqa') AND {_ALL.format("targets", _BOX_OK)} AND len(list_distinct(list_transform(targets, lambda x: x.view))) = len(targets) AND
    (task_type = 'grounding' OR (answer_label IN ('normal', 'abnormal') AND trim(answer) <> '')))))"""
#: Judged rows: sufficient statistics of the made predictions, straight from the rule that made them.
JUDGED = f"""j0 AS (SELECT *, h >= 10 AND NOT (h BETWEEN 30 AND 33 AND task_type <> 'vqa') AND NOT (h BETWEEN 34 AND 36 AND task_type <> 'vqa' AND len(boxes) = 1) AS valid,
    CASE WHEN task_type = 'grounding' OR h < 10 THEN NULL WHEN h BETWEEN 10 AND 24 THEN CASE answer_label WHEN 'yes' THEN 'no' WHEN 'no' THEN 'yes' WHEN 'normal' THEN 'abnormal' ELSE 'normal' END ELSE answer_label END AS said0,
    CASE WHEN task_type = 'vqa' THEN 'yes' WHEN task_type = 'grounded_vqa' THEN 'abnormal' END AS p, CASE WHEN task_type = 'vqa' THEN 'no' WHEN task_type = 'grounded_vqa' THEN 'normal' END AS q FROM s),
  j1 AS (SELECT *, CASE WHEN task_type = 'vqa' OR valid THEN said0 END AS said,
    list_transform(range(1, len(boxes) + 1), lambda i: CASE WHEN NOT valid OR (h BETWEEN 34 AND 36 AND i = 1) THEN 0.0 WHEN h BETWEEN 25 AND 29 THEN
      greatest(0, boxes[i].bbox[3] - boxes[i].bbox[1] - 9)::DOUBLE / (2 * (boxes[i].bbox[3] - boxes[i].bbox[1]) - greatest(0, boxes[i].bbox[3] - boxes[i].bbox[1] - 9)) ELSE 1.0 END) AS ious FROM j0),
  j AS (SELECT task_id, patient_id, split, task_type, label, region_level, view_scope, answer_label, 1 AS n, valid::INT AS valid, coalesce(answer_label = p, false)::INT AS pos, coalesce(answer_label = q, false)::INT AS neg,
    coalesce(answer_label = p AND said = p, false)::INT AS tp, coalesce(answer_label = q AND said = q, false)::INT AS tn, coalesce(answer_label = q AND said = p, false)::INT AS fp, (task_type <> 'grounding' AND said IS NULL)::INT AS invalid,
    len(ious) AS n_targets, coalesce(list_sum(ious), 0.0) AS iou_sum, len(list_filter(ious, lambda v: v >= 0.5)) AS iou_hit,
    CASE WHEN NOT valid THEN 0 ELSE len(boxes) - (h BETWEEN 34 AND 36)::INT * (task_type <> 'vqa')::INT END AS boxes, (valid AND task_type <> 'vqa')::INT AS region_ok,
    (task_type <> 'vqa' AND valid AND (task_type = 'grounding' OR coalesce(said = answer_label, false)) AND len(list_filter(ious, lambda v: v >= 0.5)) = len(ious))::INT AS strict FROM j1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_K = {"tasks": (TASKS,), "scored": (TASKS, SCORED), "judged": (TASKS, SCORED, JUDGED)}


def over(level: str, *more: str) -> str:
    """A WITH clause giving t (tasks), s (scored) or j (judged) rows."""
    return with_(*_K[level], *more)

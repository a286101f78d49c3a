"""Blinded review by two readers, their agreement, adjudication and the gold records that come of it.

Queue, responses and decisions have one row per case and view, so every comparison is an equi-join on (review_id, view).

Defined results
- a case a reader left out, answered twice or that is not in the queue is an issue, as is a file of several readers or of none
- boxes are compared where both readers could judge them; a missing box has no overlap with anything
- an excluded case gives no gold record; null decisions count as ``exclude``; empty inputs give empty results
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.rates import rate
from .stats import kappa

KEY = ["review_id", "view"]


def blind(evidence: DataFrame, seed: str = "review") -> tuple[DataFrame, DataFrame]:
    """From (evidence_id, region, view, image, bbox, diagnosis): the queue without labels, and the labels by case apart from it."""
    cases = evidence.withColumn("review_id", F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "evidence_id"), 256), 1, 16))
    return cases.select("review_id", "view", "image", "bbox", "region"), cases.select("review_id", "view", "evidence_id", "diagnosis")


def effective_box(status: Column, corrected: Column, original: Column) -> Column:
    return F.when(status == "correct", corrected).otherwise(original)


def response_issues(queue: DataFrame, responses: DataFrame) -> DataFrame:
    """review_id, issue: missing, unexpected or repeated answers, answers of another reader than the file's first."""
    sides = queue.select(*KEY, F.lit(1).alias("q"), F.lit(0).alias("r")).unionByName(responses.select(*KEY, F.lit(0).alias("q"), F.lit(1).alias("r")))
    per = sides.groupBy(*KEY).agg(F.sum("q").alias("q"), F.sum("r").alias("r"))
    why = F.when(F.col("r") == 0, "missing").when(F.col("q") == 0, "unexpected").when(F.col("r") > 1, "repeated")
    who = F.trim("reviewer_id")
    first = responses.agg(F.min(F.nullif(who, F.lit(""))).alias("_who"))
    other = responses.join(F.broadcast(first)).where(~F.coalesce(who == F.col("_who"), F.lit(False))).select("review_id", F.lit("other_reviewer").alias("issue")).distinct()
    return per.withColumn("issue", why).where("issue is not null").select("review_id", "issue").distinct().unionByName(other)


def compare_readers(queue: DataFrame, a: DataFrame, b: DataFrame, threshold: float = 0.9) -> DataFrame:
    """A row per case and view: both readers' answers, the overlap of their boxes and ``differences``."""
    side = lambda df, s: df.select(*KEY, *[F.col(c).alias(f"{c}_{s}") for c in ("diagnosis", "bbox_status", "corrected_bbox", "overall_decision")])
    rows = queue.join(side(a, "a"), KEY).join(side(b, "b"), KEY)
    unseen = (F.col("bbox_status_a") == "not_assessable") | (F.col("bbox_status_b") == "not_assessable")
    box = lambda s: effective_box(F.col(f"bbox_status_{s}"), F.col(f"corrected_bbox_{s}"), F.col("bbox"))
    rows = rows.withColumn("iou", F.when(~unseen, F.when(box("a").isNull() | box("b").isNull(), 0.0).otherwise(iou(box("a"), box("b")))))
    said = lambda name: ~F.col(f"{name}_a").eqNullSafe(F.col(f"{name}_b"))
    named = lambda what, when: F.when(when, F.concat(F.lit(f"{what}:"), "view"))
    found = F.array_compact(F.array(named("diagnosis", said("diagnosis")), named("bbox_status", unseen & said("bbox_status")), named("bbox", ~unseen & (said("bbox_status") | (F.col("iou") < threshold))), F.when(said("overall_decision"), F.lit("overall_decision"))))
    return rows.withColumn("differences", found)


def agreement(compared: DataFrame, threshold: float = 0.9) -> DataFrame:
    """measure, n, agreed, value: diagnoses (with kappa), box states, boxes, decisions and whole cases."""
    yes = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    same = lambda n: F.col(f"{n}_a").eqNullSafe(F.col(f"{n}_b"))
    cases = compared.groupBy("review_id").agg(F.max(F.size("differences")).alias("d"), F.min(same("overall_decision")).alias("o"))
    v = compared.agg(F.count("*").alias("n"), yes(same("diagnosis")).alias("dx"), yes(same("bbox_status")).alias("st"), F.count("iou").alias("nb"), yes(F.col("iou") >= threshold).alias("ob"), F.avg("iou").alias("mi"))
    c = cases.agg(F.count("*").alias("nc"), yes(F.col("d") == 0).alias("full"), yes(F.col("o")).alias("od"))
    k = kappa(compared.withColumn("_k", F.lit(1)), ["_k"], "diagnosis_a", "diagnosis_b").select("kappa")
    one = v.crossJoin(F.broadcast(c)).join(F.broadcast(k), how="left")
    m = lambda name, n, got, value=None: F.struct(F.lit(name).alias("measure"), F.col(n).alias("n"), F.col(got).alias("agreed"), (rate(F.col(got), F.col(n)) if value is None else F.round(value, 6)).alias("value"))
    rows = F.array(m("diagnosis", "n", "dx"), m("diagnosis_kappa", "n", "dx", F.col("kappa")), m("bbox_status", "n", "st"), m("bbox", "nb", "ob"), m("mean_iou", "nb", "ob", F.col("mi")), m("overall_decision", "nc", "od"), m("fully_agreed", "nc", "full"))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def gold(evidence: DataFrame, cases: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adjudicated records and excluded cases. ``evidence`` has a row per evidence_id and view, ``cases`` names the evidence of a
    review_id, ``decisions`` gives per view final_decision, final_bbox and final_diagnosis."""
    held = cases.select("review_id", "evidence_id").distinct().join(decisions, "review_id")
    keep = F.coalesce(F.col("final_decision") != "exclude", F.lit(False))
    excluded = held.where(~keep).select("review_id", "evidence_id").distinct()
    rows = evidence.join(held.where(keep).select("evidence_id", "view", "review_id", "final_bbox", "final_diagnosis"), ["evidence_id", "view"])
    worst = rows.groupBy("evidence_id").agg(F.max((F.col("final_diagnosis") == "abnormal").cast("int")).alias("_w"))
    out = rows.join(worst, "evidence_id").select(F.concat("evidence_id", F.lit(":gold")).alias("evidence_id"), F.col("evidence_id").alias("source_evidence_id"), "view", "image", F.col("final_bbox").alias("bbox"), F.col("final_diagnosis").alias("diagnosis"), F.when(F.col("_w") == 1, "abnormal").otherwise("normal").alias("pair_diagnosis"), "review_id")
    return out, excluded

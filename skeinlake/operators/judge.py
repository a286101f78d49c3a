"""Judged rows (sufficient statistics of predictions) and the metrics that are sums of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.grammar import CLASSES, canonical_class, parse_output, region_token, tag_view
from ..functions.rates import class_metrics, mean_of, rate, total

COUNTS = ["n", "valid", "pos", "neg", "tp", "tn", "fp", "invalid", "n_targets", "iou_sum", "iou_hit", "boxes", "region_ok", "strict"]


def judge(rows: DataFrame, prediction: str = "prediction") -> DataFrame:
    """``rows`` (task_id, task_type, label, answer_label, images, targets and a prediction text) with the counts of each row.

    Class of vqa: read from any output of the right task; of grounded_vqa and all boxes: from valid outputs only. A missing box
    scores 0; of boxes with one view the last counts; strict wants class, region and every target at 0.5 or more.
    """
    parsed = rows.withColumn("_p", parse_output(F.col(prediction), F.col("task_type"), F.col("images")))
    task, valid = F.col("task_type"), F.col("_p.valid")
    label = F.when(task == "vqa", F.when(F.col("_p.task") == "vqa", canonical_class(F.col("_p.answer_label"), *CLASSES["vqa"]))).when(task == "grounded_vqa", F.when(valid, canonical_class(F.col("_p.answer_label"), *CLASSES["grounded_vqa"])))
    yes = F.when(task == "vqa", CLASSES["vqa"][0]).when(task == "grounded_vqa", CLASSES["grounded_vqa"][0])
    no = F.when(task == "vqa", CLASSES["vqa"][1]).when(task == "grounded_vqa", CLASSES["grounded_vqa"][1])
    boxes = F.when(valid & (task != "vqa"), F.col("_p.boxes")).otherwise(F.array().cast("array<struct<view:string,bbox:array<double>>>"))
    of_view = lambda v: F.try_element_at(F.filter(F.col("_boxes"), lambda b: b["view"] == v), F.lit(-1))["bbox"]
    targets = F.when(task == "vqa", F.array()).otherwise(F.coalesce("targets", F.array()))
    out = parsed.withColumn("_said", label).withColumn("_boxes", boxes).withColumn("_yes", yes).withColumn("_no", no)
    scored = F.transform(targets, lambda t: F.struct(of_view(tag_view(t["view"])).isNotNull().alias("found"), F.coalesce(iou(of_view(tag_view(t["view"])), t["bbox"]), F.lit(0.0)).alias("iou")))
    out = out.withColumn("_scores", scored)
    truth, said = F.col("answer_label"), F.col("_said")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    hits = F.size(F.filter("_scores", lambda s: s["iou"] >= 0.5))
    region = valid & (task != "vqa") & (F.col("_p.region") == region_token(F.col("label")))
    class_ok = F.when(task == "grounded_vqa", F.coalesce(said == truth, F.lit(False))).otherwise(True)
    return out.select(
        *rows.columns, F.lit(1).cast("long").alias("n"), one(valid).alias("valid"), one(truth == F.col("_yes")).alias("pos"), one(truth == F.col("_no")).alias("neg"),
        one((truth == F.col("_yes")) & (said == F.col("_yes"))).alias("tp"), one((truth == F.col("_no")) & (said == F.col("_no"))).alias("tn"), one((truth == F.col("_no")) & (said == F.col("_yes"))).alias("fp"),
        one((task != "grounding") & said.isNull()).alias("invalid"), F.size("_scores").cast("long").alias("n_targets"), F.aggregate("_scores", F.lit(0.0), lambda a, s: a + s["iou"]).alias("iou_sum"),
        hits.cast("long").alias("iou_hit"), F.size(F.filter("_scores", lambda s: s["found"])).cast("long").alias("boxes"), one(region).alias("region_ok"),
        one((task != "vqa") & class_ok & region & (hits == F.size("_scores"))).alias("strict"), F.col("_scores.iou").alias("ious"), F.col("_p.issues").alias("issues"), F.col("_said").alias("said"),
    )


def totals(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts summed by any keys: patients, strata, replicates."""
    return judged.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def metric_columns(digits: int = 6) -> dict[str, Column]:
    """Every metric as a column over summed counts."""
    c = F.col
    out = class_metrics(c("pos"), c("neg"), c("tp"), c("tn"), c("fp"), c("n"))
    return out | {
        "valid_rate": rate(c("valid"), c("n"), digits), "mean_iou": F.round(F.try_divide(c("iou_sum"), c("n_targets")), digits), "iou_at_50": rate(c("iou_hit"), c("n_targets"), digits),
        "region_accuracy": rate(c("region_ok"), c("n"), digits), "strict_accuracy": rate(c("strict"), c("n"), digits),
    }


def excluding_invalid(tp: Column, tn: Column, fp: Column, fn: Column, n: Column) -> dict[str, Column]:
    """The other rule: a miss needs an explicit negative answer, invalid outputs leave recall alone."""
    return class_metrics(tp + fn, tn + fp, tp, tn, fp, n, fn)


def selection_score(metrics: DataFrame) -> DataFrame:
    """Mean of three headline metrics of the three tasks; null if any is null."""
    pick = lambda task, m: F.max(F.when(F.col("task_type") == task, F.col(m)))
    return metrics.agg(F.round(mean_of(pick("vqa", "balanced_accuracy"), pick("grounding", "iou_at_50"), pick("grounded_vqa", "strict_accuracy")), 6).alias("selection_score"))


def sweep(ious: Column, thresholds: tuple[float, ...] = (0.3, 0.5, 0.75, 0.9)) -> dict[str, Column]:
    return {f"at_{int(t * 100)}": total(ious >= t) for t in thresholds}

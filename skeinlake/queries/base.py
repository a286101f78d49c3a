"""Task rows and made predictions shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grammar import json_output
from ..functions.keys import clean_category, clean_key, clean_split, hash_bits
from ..operators.judge import judge
from ..operators.relational import last_per_key
from ..tables import table


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """The last row of every task, keys and categories in one spelling."""
    m = table(spark, d, "multitask")
    rows = m.select(
        clean_key("task_id").alias("task_id"), clean_key("evidence_id").alias("evidence_id"), clean_key("patient_id").alias("patient_id"), clean_split("split").alias("split"), "task_type",
        clean_category("region_level").alias("region_level"), clean_category("interaction_type").alias("interaction_type"), "label", "view_scope", "prompt", "answer", clean_category("answer_label").alias("answer_label"),
        "images", "targets", F.col("batch").cast("long").alias("batch"), "row_id", "ingested_at",
    )
    keep = [c for c in rows.columns if c not in ("task_id", "ingested_at")]
    return last_per_key(rows, "task_id", ["ingested_at", "row_id"], keep)


def _every(arr, ok):
    return (F.size(F.coalesce(arr, F.array())) > 0) & F.forall(F.coalesce(arr, F.array()), lambda x: F.coalesce(ok(x), F.lit(False)))


def scored_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks sound enough to be scored, with ``h`` in 0..99 from the task's hash and a made ``prediction``.

    h below 6: no JSON; 6-9: another task; 10-24: the other class; 25-29: boxes 9 pixels to the right; 30-33: outside the
    image; 34-36: the first box left out; else the truth.
    """
    at = lambda b, i: F.get(b, F.lit(i))
    image_ok = lambda x: x["view"].isin("ANT", "POST") & (F.size(x["image_size"]) == 2) & (at(x["image_size"], 0) >= 256) & (at(x["image_size"], 1) >= 1000)
    b = lambda x: x["bbox"]
    box_ok = lambda x: x["view"].isin("ANT", "POST") & (F.size(b(x)) == 4) & (at(b(x), 0) >= 0) & (at(b(x), 1) >= 0) & (at(b(x), 0) < at(b(x), 2)) & (at(b(x), 1) < at(b(x), 3)) & (at(b(x), 2) <= 256) & (at(b(x), 3) <= 1000)
    kind, label, said = F.col("task_type"), F.col("answer_label"), F.coalesce(F.trim("answer") != "", F.lit(False))
    boxed = _every(F.col("targets"), box_ok) & (F.size(F.array_distinct(F.transform("targets", lambda x: x["view"]))) == F.size("targets"))
    sound = F.when(kind == "vqa", label.isin("yes", "no") & said).when(kind == "grounding", boxed).when(kind == "grounded_vqa", boxed & label.isin("normal", "abnormal") & said)
    rows = tasks(spark, d).where(F.col("label").isNotNull() & F.col("patient_id").isNotNull() & ~F.col("answer_label").eqNullSafe("uncertain")).where(_every(F.col("images"), image_ok)).where(F.coalesce(sound, F.lit(False)))
    rows = rows.withColumn("h", F.pmod(hash_bits("pred", "task_id", digits=8), F.lit(100))).withColumn("boxes_in", F.when(kind == "vqa", F.array()).otherwise(F.col("targets")))
    h = F.col("h")
    flipped = F.when(label == "yes", "no").when(label == "no", "yes").when(label == "normal", "abnormal").otherwise("normal")
    out_label = F.when(h.between(10, 24), flipped).otherwise(label)
    shift = F.when(h.between(25, 29), 9).when(h.between(30, 33), 5000).otherwise(0)
    moved = F.transform("boxes_in", lambda t: F.struct(t["view"].alias("view"), F.array(at(b(t), 0) + shift, at(b(t), 1), at(b(t), 2) + shift, at(b(t), 3)).alias("bbox")))
    boxes = F.when(h.between(34, 36), F.slice(moved, 2, 10)).otherwise(moved)
    other = F.when(kind == "vqa", "grounding").otherwise("vqa")
    text = json_output(kind, F.col("answer"), F.col("label"), out_label, boxes)
    return rows.withColumn("prediction", F.when(h < 6, F.concat(F.lit("the answer is "), F.coalesce("label", F.lit("?")))).when(h < 10, F.replace(text, F.concat(F.lit('"task":"'), kind), F.concat(F.lit('"task":"'), other))).otherwise(text)).drop("boxes_in")


def judged(spark: SparkSession, d: str) -> DataFrame:
    return judge(scored_tasks(spark, d))

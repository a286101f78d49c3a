"""Rules of the manifests of a release, by kind, and the gate a release passes before it is published.

A rule is a SQL condition that holds for a row that breaks it; ``{size}`` stands for the length of an array. A kind's rules are
checked in one pass; rows that break several come out once for each.

Defined results
- null and empty arrays are empty; a rule that compares with null is not broken by it unless it says so; an empty table breaks none
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TASK = {"no_task_id": "task_id is null", "no_evidence": "evidence_id is null and coalesce(region_level, '') not like 'whole%'", "no_patient": "patient_id is null", "no_split": "split is null", "no_images": "coalesce({size}(images), 0) = 0", "no_prompt": "coalesce(trim(prompt), '') = ''", "unknown_scope": "coalesce(view_scope, '') not in ('ANT', 'POST', 'BOTH')"}
_SAID = {"no_answer": "coalesce(trim(answer), '') = ''", "no_class": "answer_label is null"}
_BOXED = {"no_targets": "coalesce({size}(targets), 0) = 0"}
RULES: dict[str, dict[str, str]] = {
    "canonical": {"no_record_id": "record_id is null", "no_patient": "patient_id is null", "no_image": "coalesce(trim(image), '') = ''", "bad_size": "coalesce({size}(image_size), 0) <> 2", "unknown_view": "coalesce(view, '') not in ('ANT', 'POST')", "bad_box": "coalesce({size}(target.bbox), 0) <> 4", "no_target_name": "target.name is null"},
    "paired_evidence": {"no_evidence_id": "evidence_id is null", "no_patient": "patient_id is null", "no_region": "region is null", "not_two_images": "coalesce({size}(images), 0) <> 2", "no_diagnosis": "diagnosis_by_view.ANT is null or diagnosis_by_view.POST is null", "no_pair_diagnosis": "pair_diagnosis is null"},
    "metastases": {"no_id": "metastasis_id is null", "no_label": "label is null", "bad_box": "coalesce({size}(bbox), 0) <> 4", "unknown_assignment": "coalesce(assignment, '') not in ('unique_region', 'ambiguous_regions', 'unassigned')", "unique_without_one": "assignment = 'unique_region' and coalesce({size}(candidate_record_ids), 0) <> 1", "unassigned_with_some": "assignment = 'unassigned' and coalesce({size}(candidate_record_ids), 0) > 0"},
    "patient_splits": {"no_patient": "patient_id is null", "no_split": "split is null", "no_counts": "canonical_records is null or paired_evidence_records is null"},
    "vqa": _TASK | _SAID | {"has_targets": "coalesce({size}(targets), 0) > 0"},
    "grounding": _TASK | _BOXED | {"has_answer": "answer_label is not null"},
    "grounded_vqa": _TASK | _SAID | _BOXED,
    "lesion_vqa": _TASK | _SAID | {"no_lesion": "metastasis_id is null", "has_targets": "coalesce({size}(targets), 0) > 0"},
    "lesion_grounding": _TASK | _BOXED | {"no_lesion": "metastasis_id is null"},
    "whole_records": {"no_path": "source_path is null", "no_digest": "sha256 is null", "empty_file": "file_bytes = 0", "no_extent": "width is null or height is null"},
}


def violations(df: DataFrame, kind: str) -> DataFrame:
    """kind, rule, n: rows that break each rule of a kind."""
    hit = F.array_compact(F.array(*[F.when(F.expr(r.format(size="size")), F.lit(n)) for n, r in RULES[kind].items()]))
    return df.select(F.explode(hit).alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "rule", "n")


def violating_rows(df: DataFrame, kind: str, key: str) -> DataFrame:
    """Of every row that breaks a rule its key and the rules."""
    hit = F.array_compact(F.array(*[F.when(F.expr(r.format(size="size")), F.lit(n)) for n, r in RULES[kind].items()]))
    return df.select(F.col(key).alias("key"), hit.alias("rules")).where(F.size("rules") > 0)


def gate(present: DataFrame, required: list[str], broken: DataFrame, leaks: DataFrame) -> DataFrame:
    """check, n, passed: required names that are missing (``present`` has ``name``), rows that break rules (``n``), leaking values."""
    spark = present.sparkSession
    missing = spark.createDataFrame([(n,) for n in required], "name string").join(present.select("name"), "name", "left_anti")
    one = lambda name, df, value: df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") == 0).alias("passed"))
    return one("required_names", missing, F.count("*")).unionByName(one("manifests_valid", broken, F.sum("n"))).unionByName(one("no_leakage", leaks, F.count("*")))

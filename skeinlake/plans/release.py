"""Build of a release: regions and hotspots to evidence, policy, splits, pairs, tasks, sample."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import assign_containers, pair_views
from ..operators.sampling import cluster_components, cut_by_running_count
from ..session import Workspace


@dataclass(frozen=True)
class Policy:
    """Which flags exclude a record; a configuration with cross-checks."""

    exclude: tuple[str, ...] = ("missing_image", "low_precision_region", "known_artifact", "outlier", "likely_corrupt_image")
    diagnoses: tuple[str, ...] = ("normal", "abnormal")
    seed: str = "17"
    cuts: tuple[tuple[str, float], ...] = field(default=(("train", 0.8), ("val", 0.9)))

    def __post_init__(self):
        shares = [c for _, c in self.cuts]
        if shares != sorted(shares) or not all(0 < c <= 1 for c in shares):
            raise ValueError("cuts must rise within (0, 1]")

    def reasons(self):
        flag = [F.when(F.coalesce(F.try_element_at("flags", F.lit(f)), F.lit(False)), F.lit(f)) for f in self.exclude]
        odd = F.when(F.coalesce(~F.col("diagnosis").isin(*self.diagnoses), F.lit(True)), F.lit("unsupported_diagnosis"))
        return F.array_compact(F.array(*flag, odd))


class Release:
    """Evidence rows (patient_id, region, view, image, image_size, bbox, diagnosis, flags, duplicate_of) and hotspots (spot_id,
    patient_id, view, bbox, label) to the tables of a release. Each stage is written once and read by the next ones."""

    def __init__(self, evidence: DataFrame, hotspots: DataFrame, policy: Policy | None = None):
        self.policy = policy or Policy()
        self.work = Workspace(evidence.sparkSession, "release")
        marked = evidence.withColumn("record_id", F.concat_ws(":", "patient_id", F.replace("region", F.lit(" "), F.lit("_")), "view")).withColumn("reasons", self.policy.reasons())
        self.evidence = self.work.save(marked, "evidence")
        self.rejected = self.evidence.where(F.size("reasons") > 0).select("record_id", "reasons")
        accepted = self.evidence.where(F.size("reasons") == 0).drop("reasons")
        if accepted.isEmpty():
            raise ValueError("the policy accepts no record")
        parts = cluster_components(accepted, "patient_id", accepted, "patient_id", "duplicate_of")
        sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
        splits = cut_by_running_count(sizes, "component", "n", self.policy.seed, self.policy.cuts).select("component", "split")
        self.splits = self.work.save(parts.join(splits, "component").select("patient_id", "component", "split"), "splits")
        self.records = self.work.save(accepted.join(self.splits.select("patient_id", "split"), "patient_id"), "records")
        regions = self.records.select("patient_id", "view", "record_id", F.col("bbox").alias("region_box"))
        self.metastases = assign_containers(hotspots, regions, ["patient_id", "view"], "spot_id", "record_id")

    def pairs(self) -> DataFrame:
        """ANT and POST records of one region side by side."""
        both = pair_views(self.records, ["patient_id", "region", "split"], "view", ["record_id", "image", "image_size", "bbox", "diagnosis"])
        worst = F.when((F.col("ANT.diagnosis") == "abnormal") | (F.col("POST.diagnosis") == "abnormal"), "abnormal").otherwise("normal")
        return both.withColumn("evidence_id", F.concat_ws(":", "patient_id", F.replace("region", F.lit(" "), F.lit("_")))).withColumn("pair_diagnosis", worst)

    def tasks(self, bank: DataFrame) -> DataFrame:
        """Every pair in three scopes and every kind of task, worded by the bank (task_type, template with {region} and {view})."""
        scope = F.explode(F.array(*[F.lit(s) for s in ("ANT", "POST", "BOTH")])).alias("view_scope")
        rows = self.pairs().select("*", scope)
        label = F.when(F.col("view_scope") == "BOTH", F.col("pair_diagnosis")).when(F.col("view_scope") == "ANT", F.col("ANT.diagnosis")).otherwise(F.col("POST.diagnosis"))
        target = lambda v: F.struct(F.lit(v).alias("view"), F.col(f"{v}.bbox").alias("bbox"))
        targets = F.when(F.col("view_scope") == "BOTH", F.array(target("ANT"), target("POST"))).when(F.col("view_scope") == "ANT", F.array(target("ANT"))).otherwise(F.array(target("POST")))
        image = lambda v: F.struct(F.col(f"{v}.image").alias("image"), F.col(f"{v}.image_size").alias("image_size"), F.lit(v).alias("view"))
        view = F.when(F.col("view_scope") == "ANT", "front").when(F.col("view_scope") == "POST", "back").otherwise("both")
        joined = rows.crossJoin(F.broadcast(bank))  # the bank: a few wordings per task type
        prompt = F.replace(F.replace("template", F.lit("{region}"), F.col("region")), F.lit("{view}"), view)
        answer = F.when(F.col("task_type") == "vqa", F.when(label == "abnormal", "yes").otherwise("no")).when(F.col("task_type") == "grounded_vqa", label)
        return joined.select(
            F.concat_ws(":", "evidence_id", "task_type", F.lower("view_scope")).alias("task_id"), "evidence_id", "patient_id", "split", "task_type", F.col("region").alias("label"), "view_scope", prompt.alias("prompt"), answer.alias("answer_label"),
            F.array(image("ANT"), image("POST")).alias("images"), F.when(F.col("task_type") != "vqa", targets).alias("targets"),
        )


def export(tasks: DataFrame, path: str) -> None:
    """Training rows partitioned by task type and split, so that readers of one split scan nothing else."""
    tasks.write.mode("overwrite").partitionBy("task_type", "split").parquet(path)

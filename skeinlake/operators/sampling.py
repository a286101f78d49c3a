"""Hash-ordered splits, quotas, samples and schedules. Every random choice is a hash of (seed, id)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_bits
from ..session import Workspace
from .components import connected_components
from .skew import running_sums, take_lowest


def cluster_components(members: DataFrame, member: str, links: DataFrame, src: str, dst: str) -> DataFrame:
    """Every member with its component; links to what is no member are left out."""
    ids = members.select(F.col(member).alias("node")).where("node is not null").distinct()
    known = links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return ids.join(connected_components(known), "node", "left").select(F.col("node").alias(member), F.coalesce("component", "node").alias("component"))


def cut_by_running_count(groups: DataFrame, group: str, size: str, seed: str, cuts: tuple[tuple[str, float], ...] = (("train", 0.8), ("val", 0.9)), last: str = "test") -> DataFrame:
    """Groups in hash order; the members counted before a group decide its split: below 80 % train, below 90 % val, else test."""
    rows = groups.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group)), 256))
    total = rows.agg(F.sum(size)).first()[0] or 0
    run = running_sums(rows, [], ["_h", group], {"_upto": size})
    before, out = F.col("_upto") - F.col(size), F.lit(last)
    for name, share in reversed(cuts):
        out = F.when(before < total * share, name).otherwise(out)
    return run.withColumn("split", out).drop("_h", "_upto")


def largest_remainder(counts: DataFrame, stratum: str, n: str, target: int) -> DataFrame:
    """Quotas of a total per stratum: the floor of the share, and one more for the largest remainders (ties by stratum)."""
    total = counts.agg(F.sum(n)).first()[0] or 1
    exact = F.col(n) * target
    rows = counts.withColumn("quota", F.floor(exact / total).cast("long")).withColumn("_rem", exact - F.col("quota") * total)
    short = target - (rows.agg(F.sum("quota")).first()[0] or 0)
    rank = F.row_number().over(Window.orderBy(F.col("_rem").desc(), stratum))  # one row per stratum
    return rows.withColumn("quota", F.col("quota") + (rank <= short).cast("long")).drop("_rem")


def stratified_with_coverage(rows: DataFrame, key: str, stratum: str, cover: str, target: int, seed: str) -> DataFrame:
    """A hash sample of ``target`` rows near proportional strata that still shows every value of ``cover`` (an array: all its values).

    First the row with the least hash of every ``cover`` value (forced); then each stratum's least hashes up to its quota less
    its forced rows; then a global cut by hash to the capacity left, or a global top-up. Adds ``stage``.
    """
    work = Workspace(rows.sparkSession, "stratified")
    hashed = work.save(rows.select(key, stratum, cover, hash_bits(seed, key).alias("_h")), "hashed")
    shown = hashed.withColumn(cover, F.explode(cover)) if hashed.schema[cover].dataType.typeName() == "array" else hashed
    forced = shown.where(F.col(cover).isNotNull()).groupBy(cover).agg(F.min_by(F.struct(key, stratum), F.struct("_h", key)).alias("_f")).select("_f.*").distinct()
    forced = work.save(forced, "forced")
    n_forced = forced.count()
    if n_forced > target:
        raise ValueError(f"coverage needs {n_forced} rows, more than the target {target}")
    free = work.save(hashed.join(forced.select(key), key, "left_anti").select(key, stratum, "_h"), "free")
    quotas = largest_remainder(hashed.groupBy(stratum).agg(F.count("*").alias("n")), stratum, "n", target)
    had = forced.groupBy(stratum).agg(F.count("*").alias("_had"))
    need = quotas.join(had, stratum, "left").select(stratum, F.greatest(F.col("quota") - F.coalesce("_had", F.lit(0)), F.lit(0)).alias("quota"))
    proposed = work.save(take_lowest(free, [stratum], "_h", key, need).withColumn("_all", F.lit(1)), "proposed")
    one = lambda n: rows.sparkSession.createDataFrame([(1, n)], "_all int, quota long")
    capacity = target - n_forced
    kept = work.save(take_lowest(proposed, ["_all"], "_h", key, one(capacity)), "kept")
    rest = capacity - kept.count()
    out = forced.select(key, stratum, F.lit("forced").alias("stage")).unionByName(kept.select(key, stratum, F.lit("quota").alias("stage")))
    if rest > 0:
        more = take_lowest(free.join(kept.select(key), key, "left_anti").withColumn("_all", F.lit(1)), ["_all"], "_h", key, one(rest))
        out = out.unionByName(more.select(key, stratum, F.lit("extra").alias("stage")))
    return out


def top_k_by_hash(rows: DataFrame, groups: list[str], key: str, k: int, seed: str) -> DataFrame:
    """The k rows of least hash of every group. The window keeps k rows per task before the shuffle (top-k pushdown)."""
    w = Window.partitionBy(*groups).orderBy("_h", key)
    return rows.withColumn("_h", hash_bits(seed, key)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_h", "_r")


def interleave(rows: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """Round robin over buckets: ``position`` of each row when the buckets take turns in order of their name.

    The place within a bucket comes from range-partitioned running sums, so a bucket that holds most rows spans many tasks.
    """
    inside = running_sums(rows.withColumn("_one", F.lit(1)), [bucket], order, {"_r": "_one"}).drop("_one")
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_size"))  # one row per bucket
    names = sizes.select(F.collect_list(F.struct(F.col(bucket).alias("b"), F.col("_size").alias("n"))).alias("_all"))
    r, mine = F.col("_r"), F.col(bucket)
    before = F.aggregate("_all", F.lit(0).cast("long"), lambda a, s: a + F.least(s["n"], r - 1) + F.when((s["n"] >= r) & (s["b"] < mine), 1).otherwise(0))
    return inside.crossJoin(F.broadcast(names)).withColumn("position", before + 1).drop("_all", "_r")


def balanced_probe(rows: DataFrame, groups: list[str], key: str, k: int, seed: str) -> DataFrame:
    """k rows per group; groups that are too small come out whole with ``short`` true."""
    picked = top_k_by_hash(rows, groups, key, k, seed)
    n = picked.groupBy(*groups).agg((F.count("*") < k).alias("short"))
    return picked.join(F.broadcast(n), groups)


def class_balanced_epoch(rows: DataFrame, task: str, key: str, positive: Column, seed: str) -> DataFrame:
    """Per task as many draws as rows, half of them positive: positives in repeated passes, negatives without repetition.

    ``draw`` numbers the passes of a row. Tasks lacking a class are left as they are.
    """
    hashed = rows.withColumn("_pos", F.coalesce(positive, F.lit(False))).withColumn("_h", hash_bits(seed, key))
    hashed = Workspace(rows.sparkSession, "epoch").save(hashed, "hashed")
    size = hashed.groupBy(task).agg(F.count("*").alias("_n"), F.sum(F.col("_pos").cast("long")).alias("_np"))
    both = size.where("_np > 0 and _np < _n").withColumn("_want", F.floor(F.col("_n") / 2))
    plan = both.select(task, F.explode(F.array(F.struct(F.lit(True).alias("_pos"), F.floor(F.col("_want") / F.col("_np")).alias("_base"), (F.col("_want") % F.col("_np")).alias("quota")), F.struct(F.lit(False).alias("_pos"), F.lit(0).cast("long").alias("_base"), (F.col("_n") - F.col("_want")).alias("quota")))).alias("p")).select(task, "p.*")
    once = take_lowest(hashed, [task, "_pos"], "_h", key, plan).select(key, F.lit(1).alias("_more"))
    marked = hashed.join(F.broadcast(plan.drop("quota")), [task, "_pos"]).join(once, key, "left").withColumn("_times", F.col("_base") + F.coalesce("_more", F.lit(0)))
    draws = marked.where("_times > 0").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    whole = hashed.join(F.broadcast(both.select(task)), task, "left_anti").withColumn("draw", F.lit(1).cast("long"))
    return draws.select(*rows.columns, "draw").unionByName(whole.select(*rows.columns, "draw"))


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """A global order for an epoch: ``position`` from 1 by hash of (seed + epoch - 1, key)."""
    hashed = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed + epoch - 1}:"), F.col(key)), 256)).withColumn("_one", F.lit(1))
    return running_sums(hashed, [], ["_h", key], {"position": "_one"}).drop("_h", "_one")


def reservoir(rows: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """k random rows: the least hashes (per-task heaps, no full sort)."""
    return rows.withColumn("_h", hash_bits(seed, key)).orderBy("_h", key).limit(k).drop("_h")


def target_of(n: int, fraction: float) -> int:
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return math.ceil(round(n * fraction, 9))

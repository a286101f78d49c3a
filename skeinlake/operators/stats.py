"""Cluster bootstrap, intervals, paired tests, multiplicity, rank AUC and agreement, over pre-aggregated counts."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_bits
from ..functions.rates import rate
from ..functions.text import let
from .skew import running_sums

#: Cumulative Poisson(1) probabilities; beyond the last the weight is their number.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def bootstrap_weights(clusters: DataFrame, cluster: str, replicates: int, seed: str = "boot") -> DataFrame:
    """Multinomial weights: per replicate as many hash draws as there are clusters. ``replicate``, ``cluster``, ``weight`` > 0.

    Clusters are numbered in order of their id by range partitions. The draws are replicates x clusters rows, none of which
    leaves its task before they are counted.
    """
    named = clusters.select(cluster).where(F.col(cluster).isNotNull()).distinct().withColumn("_one", F.lit(1))
    indexed = running_sums(named, [], [cluster], {"_i": "_one"}).select(cluster, (F.col("_i") - 1).cast("long").alias("_i"))
    n = indexed.count()
    spark = clusters.sparkSession
    draws = spark.range(n * replicates).select((F.col("id") / n).cast("long").alias("replicate"), (F.col("id") % n).alias("_d")) if n else spark.range(0).select(F.col("id").alias("replicate"), F.col("id").alias("_d"))
    picked = draws.select("replicate", F.pmod(hash_bits(seed, "replicate", "_d"), F.lit(max(n, 1))).alias("_i")).groupBy("replicate", "_i").agg(F.count("*").alias("weight"))
    return picked.join(indexed, "_i").select("replicate", cluster, "weight")


def poisson_weight(seed: str, replicate: Column, cluster: Column) -> Column:
    """Poisson(1) weight of a cluster in a replicate, from its hash alone: no draw has to be shared or joined."""
    u = hash_bits(seed, replicate, cluster, digits=13) / F.lit(float(2**52))
    return let(u, lambda v: sum(((v >= p).cast("long") for p in POISSON[1:]), (v >= POISSON[0]).cast("long")))


def replicate_totals(per_cluster: DataFrame, weights: DataFrame, cluster: str, keys: list[str], counts: list[str]) -> DataFrame:
    """Weighted sums of cluster counts per replicate and key: clusters x keys rows are joined, never the rows behind them."""
    return per_cluster.join(weights, cluster).groupBy(*keys, "replicate").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in counts])


def poisson_totals(per_cluster: DataFrame, cluster: str, keys: list[str], counts: list[str], replicates: int, seed: str = "boot") -> DataFrame:
    """Replicate sums under Poisson weights, without a join: each cluster row is expanded and combined map-side.

    Clusters are few beside replicates x clusters, so they are spread over all tasks before they are expanded.
    """
    parts = max(int(per_cluster.sparkSession.conf.get("spark.sql.shuffle.partitions")), per_cluster.sparkSession.sparkContext.defaultParallelism)
    chunk = 50
    spread = per_cluster.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // chunk)))).repartition(parts, "_k", cluster)
    here = F.sequence(F.col("_k") * chunk, F.least(F.col("_k") * chunk + chunk - 1, F.lit(replicates - 1)))
    rows = spread.withColumn("replicate", F.explode(here)).withColumn("_w", poisson_weight(seed, F.col("replicate"), F.col(cluster))).where("_w > 0")
    return rows.groupBy(*keys, "replicate").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in counts])


def order_interval(values: Column, level: float = 0.95) -> Column:
    """Struct(low, high, used): order statistics of an array at Python-rounded places; nulls are left out, none gives nulls."""
    tail = round((1 - level) / 2, 10)
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    at = lambda q: F.get(kept, F.bround((F.size(kept) - 1) * F.lit(q), 0).cast("int"))
    return F.struct(at(tail).alias("low"), at(round(1 - tail, 10)).alias("high"), F.size(kept).cast("long").alias("used"))


def intervals(replicates: DataFrame, keys: list[str], metrics: Iterable[str]) -> DataFrame:
    """Percentile intervals per key and metric; a key's replicate values (their number is fixed) are gathered and sorted."""
    long = replicates.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("r")).select(*keys, "r.*")
    return long.groupBy(*keys, "metric").agg(order_interval(F.collect_list("value")).alias("i"), F.sum(F.col("value").isNull().cast("long")).alias("undefined")).select(*keys, "metric", "i.*", "undefined")


def paired(a: DataFrame, b: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Differences a - b replicate by replicate: mean, interval and the two-sided p min(1, 2 (min(#<=0, #>=0) + 1) / (n + 1))."""
    d = a.select(*keys, "replicate", F.col(metric).alias("_a")).join(b.select(*keys, "replicate", F.col(metric).alias("_b")), [*keys, "replicate"]).withColumn("_d", F.col("_a") - F.col("_b")).where("_d is not null")
    low, high = F.sum((F.col("_d") <= 0).cast("long")), F.sum((F.col("_d") >= 0).cast("long"))
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_difference"), order_interval(F.collect_list("_d")).alias("i"), F.least(low, high).alias("_m"))
    return out.select(*keys, "n", "mean_difference", "i.low", "i.high", F.least(F.lit(1.0), (F.col("_m") + 1) * 2 / (F.col("n") + 1)).alias("p"))


def holm(tests: DataFrame, family: list[str], p: str = "p", tie: str = "test") -> DataFrame:
    """Step-down adjusted p within each family: the running maximum of min(1, (m - rank) p). A family is one table's tests."""
    by = Window.partitionBy(*family)
    ranked = tests.withColumn("_m", F.count(p).over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.col(p).asc_nulls_last(), tie)) - 1)
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r")) * F.col(p))
    return ranked.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max(step).over(by.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)))).drop("_m", "_r")


def auc(rows: DataFrame, keys: list[str], score: str, positive: Column, weight: Column | None = None) -> DataFrame:
    """Rank AUC per key, ties half; null where a class is absent. Rows are first collapsed to distinct scores."""
    w = F.lit(1).cast("long") if weight is None else weight
    ties = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.when(positive, w).otherwise(0)).alias("_p"), F.sum(F.when(positive, 0).otherwise(w)).alias("_n"))
    run = running_sums(ties, keys, ["_s"], {"_below": "_n"})
    wins = F.sum(F.col("_p") * (F.col("_below") - F.col("_n") / 2))
    return run.groupBy(*keys).agg(F.try_divide(wins.cast("double"), (F.sum("_p") * F.sum("_n")).cast("double")).alias("auc"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))


def roc_points(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Cumulative true and false positives from the highest score down, with the start (0, 0, null)."""
    ties = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(positive.cast("long")).alias("_p"), F.sum((~positive).cast("long")).alias("_n")).withColumn("_down", -F.col("threshold"))
    run = running_sums(ties, keys, ["_down"], {"tp": "_p", "fp": "_n"}).select(*keys, "threshold", "tp", "fp")
    start = ties.select(*keys).distinct().withColumns({"threshold": F.lit(None).cast("double"), "tp": F.lit(0).cast("long"), "fp": F.lit(0).cast("long")}) if keys else rows.sparkSession.sql("select cast(null as double) threshold, 0L tp, 0L fp")
    return run.withColumn("threshold", F.col("threshold").cast("double")).unionByName(start)


def kappa(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa and plain agreement of two raters; null where chance agreement is certain."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_c"))
    n = cells.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_c")).otherwise(0)).alias("agree"))
    left = cells.groupBy(*keys, F.col("_a").alias("_v")).agg(F.sum("_c").alias("_l"))
    right = cells.groupBy(*keys, F.col("_b").alias("_v")).agg(F.sum("_c").alias("_r"))
    chance = left.join(right, [*keys, "_v"]).groupBy(*keys).agg(F.sum(F.col("_l") * F.col("_r")).alias("_e"))
    out = n.join(chance, keys, "left") if keys else n.join(F.broadcast(chance), how="left")
    po, pe = F.col("agree") / F.col("n"), F.coalesce("_e", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*keys, "n", "agree", rate(F.col("agree"), F.col("n")).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))

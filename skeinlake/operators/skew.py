"""Operators that stay whole and even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key that holds more than one of this many rows is hot; there can be no more hot keys than this.
HOT_PARTS = 64


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS) -> list:
    """Keys that hold more than 1/parts of the non-null rows: at most ``parts`` values, counted over all rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    if total < 100_000:
        return []
    return [r[0] for r in counts.where(F.col("_rows") * parts > total).select(key).collect()]


def hot_split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join whose right side has one row per key and whose left side may be skewed.

    The rows of the (at most ``HOT_PARTS``) hot keys join against those few right rows by broadcast; all
    others are shuffled. ``how`` is inner, left, left_semi or left_anti. Null keys match nothing.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    return left.where(is_hot).join(few, key, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def take_lowest(df: DataFrame, groups: list[str], order: str, tie: str, quotas: DataFrame, size: str | None = None, bits: int = 14) -> DataFrame:
    """Of each group, the rows lowest in ``order`` (ties by ``tie``) up to the group's quota.

    ``order`` holds non-negative longs below 2**60 spread evenly (a hash). ``quotas`` has one row per group with
    column ``quota``: a number of rows, or with ``size`` a sum of that column which the taken rows do not exceed.
    Exact, without sorting a whole group: a histogram over 2**bits ranges of ``order`` finds the range in which the
    quota is reached, rows below it are taken unsorted and only that range's rows are ranked. ``df`` is read three
    times, so it should be a written table. Groups without a quota or with null group values give nothing.
    """
    amount = F.col(size).cast("double") if size else F.lit(1.0)
    cell = F.shiftrightunsigned(F.col(order), 60 - bits).cast("int")
    hist = df.groupBy(*groups, cell.alias("_cell")).agg(F.sum(amount).alias("_n"))
    w = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        hist.withColumn("_upto", F.sum("_n").over(w)).join(quotas.select(*groups, "quota"), groups)
        .groupBy(*groups, "quota")
        .agg(F.min(F.when(F.col("_upto") > F.col("quota"), F.struct("_cell", (F.col("_upto") - F.col("_n")).alias("_before")))).alias("_edge"))
    )
    marked = df.withColumn("_c", cell).join(edge, groups)
    below = marked.where(F.col("_edge").isNull() | (F.col("_c") < F.col("_edge._cell")))
    ranked = Window.partitionBy(*groups, "_c").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    at = (
        marked.where(F.col("_c") == F.col("_edge._cell"))
        .withColumn("_run", F.col("_edge._before") + F.sum(amount).over(ranked))
        .where(F.col("_run") <= F.col("quota")).drop("_run")
    )
    return below.unionByName(at).select(*df.columns)


def salted_pairs(left: DataFrame, right: DataFrame, key: str, on: Column | None = None, salts: int = 8) -> DataFrame:
    """All pairs of equal ``key`` where both sides may repeat it.

    Every group is cut into ``salts`` parts on the left, met by a copy of the right side each, so that no task
    holds the pairs of one key alone; adaptive skew splitting acts on top of it.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = a.join(b, [key, "_salt"]).drop("_salt")
    return out.where(on) if on is not None else out


def running_sums(df: DataFrame, groups: list[str], order: list[str], amounts: dict[str, str], parts: int | None = None) -> DataFrame:
    """``df`` with, for each ``{new: column}``, the sum of the column over the rows of the group up to and including this one.

    ``order`` must be unique within a group. Rows are range-partitioned by (group, order), so one group may span many
    tasks; the totals per task and group (a row each) give every task its offset. Null amounts count as 0.
    """
    from ..session import Workspace

    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*groups, *order]]
    placed = Workspace(spark, "running").save(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "placed")
    names = list(amounts)
    totals = placed.groupBy(*groups, "_part").agg(*[F.sum(F.coalesce(F.col(amounts[n]), F.lit(0))).alias(f"_t{i}") for i, n in enumerate(names)])
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_opart"), *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(names))])
    w = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("_opart") == F.col("_part")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = placed.join(F.broadcast(offsets) if not groups else offsets, on)
    return out.select(*df.columns, *[(F.col(f"_o{i}") + F.sum(F.coalesce(F.col(amounts[n]), F.lit(0))).over(w)).alias(n) for i, n in enumerate(names)])

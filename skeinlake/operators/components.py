"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from .skew import hot_keys, hot_split_join


def _star(edges: DataFrame, large: bool, hot: list) -> DataFrame:
    """One step over edges (u, v), u > v.

    Large: every node links its larger neighbours to the least node it sees. Small: every node links its smaller
    neighbours and itself to that least one. The least neighbour is a map-side combined minimum, and it goes back to the
    edges by a join that splits hot nodes off, so no task ever holds the neighbours of one node together.
    """
    if large:
        sided = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = sided.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        linked = hot_split_join(sided.where(F.col("o") > F.col("n")), least, "n", hot=hot).select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.col("u").alias("n"), F.col("v").alias("o"))
        least = down.groupBy("n").agg(F.min("o").alias("m"))
        linked = hot_split_join(down, least, "n", hot=hot).select(F.col("o").alias("u"), F.col("m").alias("v"))
        linked = linked.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return linked.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``component`` (the least node of the component), one row per node of any edge.

    Null ends and loops link nothing; repeated edges count once; no edges give no rows. Each round is written to the
    shared folder, the earlier one deleted; it ends when a round changes no edge.
    """
    spark, work = edges.sparkSession, Workspace(edges.sparkSession, "components")
    pair = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    current = work.save(pair.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(current)
    for k in range(1, max_rounds + 1):
        hot = hot_keys(current.select(F.explode(F.array("u", "v")).alias("n")), "n") if before[0] else []
        now = work.save(_star(_star(current, True, hot), False, hot), str(k))
        after = mark(now)
        if k > 1:
            work.drop(str(k - 1))
        current = now
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

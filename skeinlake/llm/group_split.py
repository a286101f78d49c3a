"""Splits that keep related records together: linked entities form components, components are hashed into ranges.

Defined results
- null entity: no node; spellings in other case or with blanks at the ends are one entity
- a link to an entity found in no table links nothing; null or repeated links, links to oneself add nothing
- null split: says nothing; no targets: every component gets a null split; empty tables give empty results
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import clean_key, clean_split, hash_bits
from ..operators.components import connected_components
from ..session import Workspace

#: Hub nodes start with this; it sorts behind all letters and digits, so a component is named by an entity.
HUB = "~group~"


def entity_groups(entities: list[DataFrame], links: DataFrame, entity: str = "patient_id", other: str = "duplicate_of_patient_id", group: str = "duplicate_group_id") -> DataFrame:
    """``entity`` and its ``component``, for every entity found in any table.

    A link is a row of ``links`` naming another found entity, or sharing a group id; a group is one hub node, so its members
    are never paired.
    """
    spark = links.sparkSession
    work = Workspace(spark, "groups")
    found = None
    for df in entities:
        ids = df.select(clean_key(entity).alias("node")).where("node is not null").distinct()
        found = ids if found is None else found.unionByName(ids)
    found = work.save(found.distinct(), "entities")
    rows = links.select(clean_key(entity).alias("src"), clean_key(other).alias("dst"), clean_key(group).alias("g")).where("src is not null")
    named = rows.where("dst is not null").select("src", "dst").distinct().join(found.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    hubs = rows.where("g is not null").select("src", F.concat(F.lit(HUB), "g").alias("dst")).distinct()
    parts = connected_components(named.unionByName(hubs))
    return found.join(parts, "node", "left").select(F.col("node").alias(entity), F.coalesce("component", "node").alias("component"))


def assign_splits(groups: DataFrame, targets: DataFrame, seed: str = "group-split") -> DataFrame:
    """``groups`` with ``new_split``: the hash of the component falls into one of the ranges the permille targets cut.

    ``targets`` has one row per split by nature; ranges follow the split names in order, so they do not depend on layout.
    """
    rows = targets.select(clean_split("split").alias("s"), "target_permille").where("s is not null and target_permille > 0").groupBy("s").agg(F.sum("target_permille").alias("p"))
    ranges = sorted((r[0], int(r[1])) for r in rows.collect())
    total, upto, new = sum(p for _, p in ranges), 0, F.lit(None).cast("string")
    place = F.pmod(hash_bits(seed, "component"), F.lit(max(total, 1)))
    for name, p in reversed(ranges):
        low = total - upto - p
        new = F.when((place >= low) & (place < low + p), F.lit(name)).otherwise(new)
        upto += p
    return groups.withColumn("new_split", new)


def split_conflicts(groups: DataFrame, stated: list[DataFrame], entity: str = "patient_id") -> DataFrame:
    """Entities of components whose stated non-null splits are more than one: entity, component, least and greatest split."""
    said = None
    for df in stated:
        s = df.select(clean_key(entity).alias(entity), clean_split("split").alias("s")).where(f"{entity} is not null and s is not null").distinct()
        said = s if said is None else said.unionByName(s)
    per = said.distinct().join(groups, entity).groupBy("component").agg(F.min("s").alias("first_split"), F.max("s").alias("last_split"), F.count_distinct("s").alias("n_splits"))
    return groups.join(per.where("n_splits > 1"), "component")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target split: its target, entities, components, the largest component and the permille of entities reached.

    Components are never cut, so a large one moves its split's share by its size.
    """
    want = targets.select(clean_split("split").alias("split"), "target_permille").where("split is not null").groupBy("split").agg(F.sum("target_permille").cast("int").alias("target_permille"))
    parts = assigned.where("new_split is not null").groupBy(F.col("new_split").alias("split"), "component").agg(F.count("*").alias("n"))
    per = parts.groupBy("split").agg(F.sum("n").alias("entities"), F.count("*").alias("components"), F.max("n").alias("largest"))
    all_ = F.sum("entities").over(Window.partitionBy())  # one row per target split
    out = want.join(per, "split", "left").na.fill(0, ["entities", "components", "largest"])
    return out.withColumn("reached_permille", F.round(F.try_divide(F.col("entities") * 1000.0, all_), 3))

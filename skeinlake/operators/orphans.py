"""References to records that are missing, deleted or late, and what hangs below them.

All references of all tables are written once, keyed by parent and key. Direct orphans come from one join of them with the
key histories of all parents. Inherited orphans come from a fixpoint: records that hold an orphan reference are orphaned
themselves, the references to them are orphans by inheritance, and so on down the foreign-key graph. A round is one
semi-join of the written references that are still sound with the keys orphaned by the round before; it ends when a round
orphans no new key (cycles end as well, as a key is orphaned once).

Defined results
- null reference, null array element: no reference; a key repeated within a row counts once
- reference spelled in other case or with blanks at its ends: the same key; an empty string is a key like any other
- null period time of the referring row: the key is judged by whether it ever came (deletions are not applied)
- null first time of a parent row: it was present from the start; null key: the parent row is no record
- empty parent: every reference is an orphan; empty child: no rows
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clean_key
from ..session import Workspace
from .skew import hot_keys, hot_split_join


@dataclass(frozen=True)
class Entity:
    """A table of records: its row id, its own key, when a row came and when it was deleted (or None)."""

    name: str
    df: DataFrame
    row_id: str
    key: str
    came: str = "ingested_at"
    deleted: str | None = None


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``column`` (a string column, or a column expression giving an array of strings) of ``child``."""

    child: str
    column: Column
    parent: str
    many: bool = False


@dataclass
class ReferenceGraph:
    entities: list[Entity]
    references: list[Reference]
    _by: dict[str, Entity] = field(init=False)

    def __post_init__(self):
        self._by = {e.name: e for e in self.entities}

    def histories(self) -> DataFrame:
        """One row per key of every parent: parent, ``ref_key``, first time present, time deleted."""
        out = None
        for parent in dict.fromkeys(r.parent for r in self.references):
            e = self._by[parent]
            at = F.coalesce(F.col(e.came), F.lit("0001-01-01").cast("timestamp_ntz"))
            gone = F.col(e.deleted) if e.deleted else F.lit(None).cast("timestamp_ntz")
            rows = e.df.select(F.lit(parent).alias("parent"), clean_key(e.key).alias("ref_key"), at.alias("_came"), gone.alias("_gone")).where("ref_key is not null")
            out = rows if out is None else out.unionByName(rows)
        return out.groupBy("parent", "ref_key").agg(F.min("_came").alias("first_at"), F.min("_gone").alias("gone_at"))

    def all_references(self) -> DataFrame:
        """All references, distinct per row: tbl, row_id, own_key, parent, ref_key, at."""
        out = None
        for r in self.references:
            e = self._by[r.child]
            keys = F.array_distinct(F.transform(r.column, clean_key)) if r.many else F.array(clean_key(r.column))
            rows = e.df.select(F.lit(r.child).alias("tbl"), F.col(e.row_id).alias("row_id"), clean_key(e.key).alias("own_key"), F.lit(r.parent).alias("parent"), F.explode(keys).alias("ref_key"), F.col(e.came).alias("at"))
            rows = rows.where("ref_key is not null")
            out = rows if out is None else out.unionByName(rows)
        return out

    def cascade(self, max_rounds: int = 50) -> DataFrame:
        """Direct and inherited orphans: tbl, row_id, own_key, parent, ref_key, at, cause, depth (0 = direct)."""
        work = Workspace(self.entities[0].df.sparkSession, "orphans")
        node = lambda table, key: F.concat_ws("\x00", table, key).alias("node")
        refs = work.save(self.all_references().withColumn("node", node("parent", "ref_key")), "references")
        hot = hot_keys(refs, "node")
        seen = hot_split_join(refs, self.histories().select(node("parent", "ref_key"), "first_at", "gone_at"), "node", "left", hot)
        late, gone = F.col("at") < F.col("first_at"), F.coalesce(F.col("at") >= F.col("gone_at"), F.lit(False))
        cause = F.when(F.col("first_at").isNull(), "missing").when(late, "late").when(gone, "deleted")
        judged = work.save(seen.withColumn("cause", cause).drop("first_at", "gone_at"), "judged")
        columns = ["tbl", "row_id", "own_key", "parent", "ref_key", "at", "cause"]
        found = judged.where("cause is not null").select(*columns, F.lit(0).alias("depth"))
        sound = judged.where("cause is null")
        parents = list(dict.fromkeys(r.parent for r in self.references))
        lost_of = lambda df: df.where(F.col("own_key").isNotNull() & F.col("tbl").isin(parents)).select(node("tbl", "own_key")).distinct()
        keys = work.save(lost_of(found), "keys0")
        known = keys
        for depth in range(1, max_rounds + 1):
            if keys.isEmpty():
                break
            newest = work.save(hot_split_join(sound, keys, "node", "left_semi", hot).select(*columns[:-1], F.lit("inherited").alias("cause"), F.lit(depth).alias("depth")), f"depth{depth}")
            found = found.unionByName(newest)
            keys = work.save(lost_of(newest).join(known, "node", "left_anti"), f"keys{depth}")
            known = known.unionByName(keys)
        else:
            raise RuntimeError(f"the cascade did not settle in {max_rounds} rounds")
        work.drop("references")
        return found

    def report(self, orphans: DataFrame | None = None) -> DataFrame:
        """Orphan references and rows per referring table, month of arrival and kind (direct or inherited)."""
        orphans = self.cascade() if orphans is None else orphans
        return orphans.groupBy("tbl", F.date_format("at", "yyyy-MM").alias("month"), F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("kind"), "cause").agg(
            F.count("*").alias("n_refs"), F.countDistinct("row_id").alias("n_rows")
        )
